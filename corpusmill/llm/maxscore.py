"""Exact top-k search by MaxScore over integer vectors.

A vector's components are its terms: for every dimension a shard keeps a posting list, the shard's
values in vector order, with the largest and smallest value as score bounds.  For a query the terms
are sorted by what they can add at most.  Terms whose bounds together cannot lift a vector over the
threshold are non-essential: the essential postings are traversed for all vectors, then the others
are probed, largest bound first, only for vectors that are still competitive.  Each shard returns its
best ``k``, and the shards' lists are merged.  The result is exact; ties go to the smaller id.

Queries and vectors meet in blocks of bounded size, each pair of blocks in one task.  So that no shard
starts from nothing, a query first meets one bounded sample of the vectors; its ``k``-th best score
there is a threshold that holds for all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.ann import usable_vectors
from corpusmill.plans.staging import ship_package, stage


class Shard:
    """Posting lists of one block of vectors: ``ids`` ascending, ``lists[d]`` the values of term d."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.lists = ids[order], np.ascontiguousarray(values[order].T)
        self.high, self.low = self.lists.max(axis=1), self.lists.min(axis=1)

    def top(self, own: int, q: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best for weights ``q`` without ``own``, best first."""
        bound = np.where(q >= 0, q * self.high, q * self.low)
        terms = np.argsort(-(bound - np.where(q >= 0, q * self.low, q * self.high)), kind="stable")  # widest first
        rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])  # rest[i]: terms i.. add this at most
        n = len(self.ids)
        seed = np.unique(np.linspace(0, n - 1, min(n, 8 * (k + 1))).astype(np.int64))
        seen = np.sort((q[:, None] * self.lists[:, seed]).sum(axis=0)[self.ids[seed] != own])[::-1]
        threshold = seen[k - 1] if len(seen) >= k else None
        if floor is not None:
            threshold = floor if threshold is None else max(threshold, floor)
        if threshold is None:
            acc = q @ self.lists
            live = np.arange(n)
        else:
            # essential: the shortest run of leading terms without which the threshold can be missed
            need = int(np.searchsorted(-rest, -threshold, "right"))  # rest[need] < threshold
            need = max(1, min(need, len(terms)))
            acc = q[terms[:need]] @ self.lists[terms[:need]]
            live = np.flatnonzero(acc + rest[need] >= threshold)
            acc = acc[live]
            for i in range(need, len(terms)):
                t = terms[i]
                acc = acc + q[t] * self.lists[t][live]
                if i % 4 == 3:
                    keep = acc + rest[i + 1] >= threshold
                    live, acc = live[keep], acc[keep]
        good = self.ids[live] != own
        live, acc = live[good], acc[good]
        if len(acc) > 4 * k:  # keeps ties with the k-th
            least = np.partition(acc, len(acc) - k)[len(acc) - k]
            live, acc = live[acc >= least], acc[acc >= least]
        o = np.lexsort((self.ids[live], -acc))[:k]
        return self.ids[live][o], acc[o]


def block_search(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    empty = pd.DataFrame({"query_id": [], "ids": [], "scores": []}).astype({"query_id": "int64"})
    if not len(vectors) or not len(queries):
        return empty
    shard = Shard(vectors["vec_id"].to_numpy(), np.stack(vectors["w"].to_numpy()).astype(np.int64))
    each = zip(queries["vec_id"], queries["w"], queries["least"], strict=True)
    ids, scores = zip(*(shard.top(a, np.asarray(w, np.int64), k, None if pd.isna(f) else int(f)) for a, w, f in each), strict=True)
    return pd.DataFrame({"query_id": queries["vec_id"].to_numpy(), "ids": ids, "scores": scores})


def quantised(df: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, w)``: components as ``floor(scale * x)`` in double precision; zero vectors stay.

    Components are held within plus and minus the square root of ``2**62 / length``, beyond which an inner
    product need not fit 64 bits.
    """
    vectors = usable_vectors(df, id_col, vec_col, allow_zero=True)
    most = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.size("v")))
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    return vectors.select("vec_id", F.transform("v", lambda x: F.greatest(-most, F.least(most, whole(x)))).alias("w"))


def thresholds(asked: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    """``asked (vec_id, w)`` with ``least``, the ``k``-th best score among others in the sample; null if it has fewer.

    The sample is bounded by its parameter and travels with the tasks.
    """
    rows = sample.toPandas()
    ids, x = rows["vec_id"].to_numpy(np.int64), np.stack(rows["w"].to_numpy()).astype(np.int64) if len(rows) else np.zeros((0, 1), np.int64)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            least = []
            for own, w in zip(pdf["vec_id"], pdf["w"], strict=True):
                scores = (x @ np.asarray(w, np.int64))[ids != own] if len(ids) else ids
                least.append(int(np.partition(scores, len(scores) - k)[-k]) if len(scores) >= k else None)
            yield pdf.assign(least=pd.array(least, "Int64"))

    return asked.mapInPandas(run, "vec_id long, w array<long>, least long")


def search(vectors: DataFrame, queries: Column, k: int = 5, shard_rows: int = 8192, query_rows: int = 8192, sample_rows: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: exactly the ``k`` largest inner products of each query.

    ``vectors``: ``(vec_id long, w array<long>)``, ids unique; ``queries``: a condition on ``vec_id``.
    A query is not its own candidate.  Fewer candidates than ``k``: all of them.  Empty: empty.
    """
    ship_package(vectors.sparkSession)
    vectors = stage(vectors, "maxscore")
    n, m = vectors.count(), vectors.where(queries).count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    deal = lambda salt, parts: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts)).cast("int")
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = vectors.select(deal(1, shards).alias("shard"), spread(blocks).alias("block"), "vec_id", "w")
    sample = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < min(1.0, sample_rows / max(1, n)) * (1 << 30)).limit(2 * sample_rows)
    asked = stage(thresholds(vectors.where(queries).select("vec_id", "w"), sample, k), "maxscore-queries") if shards > 1 else vectors.where(queries).withColumn("least", F.lit(None).cast("long"))
    right = asked.select(spread(shards).alias("shard"), deal(2, blocks).alias("block"), "vec_id", "w", "least")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return block_search(a, b, k)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(meet, "query_id long, ids array<long>, scores array<long>")
    each = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("query_id", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
