"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives each vector a long hash string: 64 signs of inner products with random directions
(an orthogonal set, so one string has 64 distinct directions).  A tree is the sorted array of these
strings.  A query descends to the longest prefix it shares with a tree's strings, and all trees
ascend together, one character at a time, until the prefixes of all trees hold enough candidates.

* Copies of one vector are one entry of the forest with its smallest ids, so a vector that a third of
  the rows repeat is searched once; only the ``k + 1`` smallest ids of a vector can be in an answer.
* The number of candidates needed grows as a power of the number of vectors below one.
* The sorted arrays are dealt out by prefix ("cells"); a cell with too many entries is dealt in
  chunks, and a query visits each chunk of each cell below its prefix.  A cell that many queries visit
  is there once for each block of them, so a task holds a bounded number of either.  Vectors travel with
  their strings, so candidates are scored where they lie and only the best ``k + 1`` leave a task.
* Inner products of unequal norms: strings are taken of the vector extended to a common norm.

Null, empty, zero and non-finite vectors, null ids, and vectors of another length than the
commonest (ties: the shorter) take no part.  Repeated ids keep their smallest vector.  Components stay as
they are stored, 32 or 64 bits; scores are sums in double precision, and ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.plans.staging import ship_package, stage

BITS = 64
#: Depth to which prefixes are counted for the common ascent: 2 ** COUNTED counters a tree.
COUNTED = 12
#: Queries of a task.
QUERY_ROWS = 8192


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, allow_zero: bool = False) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part, one row an id."""
    v = F.col(vec_col)
    ok = v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0)
    ok &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if not allow_zero:
        ok &= F.exists(v, lambda x: x != 0)
    kind = "float" if dict(df.dtypes)[vec_col] == "array<float>" else "double"
    # adding 0.0 turns -0.0 into 0.0, so equal vectors are equal keys
    flat = df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).cast(f"array<{kind}>").alias("v"))
    one = flat.groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = one.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return one.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def directions(dim: int, trees: int, seed: int) -> np.ndarray:
    """``(trees, dim, BITS)`` random directions, orthogonal in runs of ``dim``."""
    rng = np.random.default_rng(seed)
    runs = -(-BITS // dim)
    return np.stack([np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(runs)], axis=1)[:, :BITS] for _ in range(trees)])


def hash_strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """``(rows, trees)`` unsigned 64-bit strings, first character in the highest bit."""
    shifts = np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    out = np.empty((len(x), len(planes)), np.uint64)
    for t, p in enumerate(planes):
        out[:, t] = ((x @ p > 0).astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64)
    return out


def extended(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """One more component: vectors get the common norm, queries get 0, inner products stay."""
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def matrix(col: pd.Series, packed: str = "<f4") -> np.ndarray:
    """Rows of arrays, or of bytes of this type, in double precision."""
    if not len(col):
        return np.zeros((0, 1))
    rows = col.to_numpy()
    if isinstance(rows[0], bytes | bytearray):
        return np.frombuffer(b"".join(rows), packed).reshape(len(rows), -1).astype(np.float64)
    return np.stack(rows).astype(np.float64)


def prefix_sums(counts: np.ndarray) -> np.ndarray:
    """Cumulated leaf counts with a leading 0, so a prefix's count is a difference."""
    return np.concatenate([np.zeros((len(counts), 1), np.int64), np.cumsum(counts, axis=1)], axis=1)


def common_depth(strings: np.ndarray, sums: np.ndarray, needed: int) -> np.ndarray:
    """Deepest depth at which a query's prefixes of all trees hold ``needed`` entries (0: the roots)."""
    leaf = (strings >> np.uint64(BITS - COUNTED)).astype(np.int64)
    depth = np.zeros(len(strings), np.int64)
    trees = np.arange(strings.shape[1])[None, :]
    for d in range(1, COUNTED + 1):
        lo = (leaf >> (COUNTED - d)) << (COUNTED - d)
        held = (sums[trees, lo + (1 << (COUNTED - d))] - sums[trees, lo]).sum(axis=1)
        depth[held >= needed] = d
    return depth


def search_cell(left: pd.DataFrame, right: pd.DataFrame, k: int, needed: int, packed: str = "<f4") -> pd.DataFrame:
    """The ``k`` best of one sorted array (or chunk of it) for each query that visits it.

    ``needed``: a query whose prefix of counted depth still holds more descends on its own here, to
    the longest prefix that holds that many, never below ``k`` entries.
    """
    empty = pd.DataFrame({"q": [], "ids": [], "scores": []}, dtype=object).astype({"q": "int64"})
    if not len(left) or not len(right):
        return empty
    left = left.sort_values(["s", "rep"], kind="stable")
    s = left["s"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
    order = np.argsort(s, kind="stable")
    s, ids, x = s[order], left["rep"].to_numpy()[order], matrix(left["v"], packed)[order]
    qs = right["s"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
    qd, qid, q = right["depth"].to_numpy().astype(np.int64), right["q"].to_numpy(), matrix(right["v"], packed)

    def span(strings: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.where(depth > 0, ~np.uint64(0) >> depth.astype(np.uint64), ~np.uint64(0))
        low = np.where(depth >= BITS, np.uint64(0), low)
        return np.searchsorted(s, strings & ~low, "left"), np.searchsorted(s, strings | low, "right")

    lo, hi = span(qs, qd)
    deep = qd >= COUNTED
    for _ in range(BITS - COUNTED):  # dense prefixes only: longer and longer while enough remains
        go = deep & (hi - lo > max(needed, k + 1)) & (qd < BITS)
        if not go.any():
            break
        nlo, nhi = span(qs, qd + 1)
        go &= nhi - nlo >= max(needed, k + 1)
        if not go.any():
            break
        lo, hi, qd, deep = np.where(go, nlo, lo), np.where(go, nhi, hi), np.where(go, qd + 1, qd), go
    out_q, out_ids, out_scores = [], [], []
    ranges, which = np.unique(np.stack([lo, hi], 1), axis=0, return_inverse=True)
    which = which.ravel()
    for r, (a, b) in enumerate(ranges):
        if b <= a:
            continue
        rows = np.flatnonzero(which == r)
        for at in range(0, len(rows), 512):
            some = rows[at : at + 512]
            best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(some)
            least = np.full(len(some), -np.inf)
            for b0 in range(a, b, 8192):
                sc = q[some] @ x[b0 : min(b, b0 + 8192)].T
                if sc.shape[1] > k:
                    least = np.maximum(least, np.partition(sc, sc.shape[1] - k, axis=1)[:, -k])
                # products differ from exact sums by rounding; whatever may tie with the k-th stays
                close = sc >= (least - 1e-9 * np.abs(least))[:, None]
                for i in range(len(some)):
                    best[i] = np.concatenate([best[i], np.flatnonzero(close[i]) + b0])
            for i, row in enumerate(some):
                exact = (q[row] * x[best[i]]).sum(axis=1)  # one order of summation everywhere
                o = np.lexsort((ids[best[i]], -exact))[:k]
                out_q.append(qid[row])
                out_ids.append(ids[best[i]][o])
                out_scores.append(exact[o])
    return pd.DataFrame({"q": np.array(out_q, np.int64), "ids": out_ids, "scores": out_scores}) if out_q else empty


def nearest(
    df: DataFrame,
    queries: Column,
    k: int = 20,
    trees: int = 16,
    needed: tuple[float, float] = (8.0, 0.8),
    cell_rows: int = 4096,
    seed: int = 42,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products found for each query.

    ``queries`` is a condition on ``vec_id``.  ``needed`` = (a, b): the trees ascend together until
    their prefixes hold ``a * n ** b`` entries in all, for ``n`` different vectors.
    A query is never its own neighbour; copies of its vector under other ids are.
    """
    ship_package(df.sparkSession)
    vectors = stage(usable_vectors(df, id_col, vec_col), "ann-vectors")
    few = Window.partitionBy("v").orderBy("vec_id")
    members = stage(
        vectors.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= k + 1).withColumn("rep", F.min("vec_id").over(Window.partitionBy("v"))),
        "ann-members",
    )
    reps = members.where("nth = 1").select("rep", "v")
    facts = reps.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("sq")).first()
    n, dim, norm = facts["n"], facts["dim"] or 1, math.sqrt(facts["sq"] or 0.0)
    planes = directions(dim + 1, trees, seed)
    need = max(k + 1, math.ceil(needed[0] * max(n, 1) ** needed[1]))
    flip = np.uint64(1 << 63)  # signed order of the stored strings is their unsigned order

    def strings(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = matrix(pdf["v"])
                h = hash_strings(extended(x, norm, False), planes)
                yield pd.DataFrame({"rep": pdf["rep"], "v": [r.tobytes() for r in x.astype(packed)], "s": list((h ^ flip).view(np.int64))})

    # from here on vectors travel as bytes, as wide as they came
    packed = "<f4" if dict(reps.dtypes)["v"] == "array<float>" else "<f8"
    entries = stage(reps.mapInPandas(strings, "rep long, v binary, s array<long>"), "ann-strings")
    at = entries.select(F.posexplode("s").alias("t", "s"))
    leaf = F.shiftrightunsigned(F.col("s").bitwiseXOR(F.lit(-(1 << 63)).cast("long")), BITS - COUNTED)
    counts = np.zeros((trees, 1 << COUNTED), np.int64)
    for r in at.groupBy("t", leaf.alias("leaf")).count().collect():  # at most trees * 4096 rows
        counts[r["t"], r["leaf"]] = r["count"]
    sums = prefix_sums(counts)
    cell_bits = min(COUNTED, max(0, math.ceil(math.log2(max(1, n) / cell_rows))))
    cells = counts.reshape(trees, 1 << cell_bits, -1).sum(axis=2)
    chunks = np.maximum(1, -(-cells // (2 * cell_rows)))

    def visited(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each tree: strings, depths, and the cells each query visits as (query, cell)."""
        h = hash_strings(extended(x, norm, True), planes)
        depth = common_depth(h, sums, need)
        for t in range(trees):
            wide = np.maximum(0, cell_bits - depth)
            own = (h[:, t] >> np.uint64(BITS - cell_bits)).astype(np.int64) if cell_bits else np.zeros(len(h), np.int64)
            first = (own >> wide) << wide
            span = np.int64(1) << wide
            i = np.repeat(np.arange(len(h)), span)
            cell = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(span) - span, span)
            full = cells[t, cell] > 0
            yield t, h[:, t], depth, i[full], cell[full]

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in it:
            for start in range(0, len(whole), 256):
                for t, _, _, _, cell in visited(matrix(whole["v"].iloc[start : start + 256], packed)):
                    n_of = np.bincount(cell, minlength=1 << cell_bits)
                    yield pd.DataFrame({"t": np.int32(t), "cell": np.flatnonzero(n_of), "n": n_of[n_of > 0]})

    asked = stage(vectors.where(queries).join(members.where("nth = 1").select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), "rep"), "ann-asked")
    ask_reps = stage(entries.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v"), "ann-queries")
    blocks = np.ones((trees, 1 << cell_bits), np.int64)
    for r in ask_reps.mapInPandas(count, "t int, cell long, n long").groupBy("t", "cell").agg(F.sum("n").alias("n")).collect():  # as many as cells
        blocks[r["t"], r["cell"]] = -(-r["n"] // QUERY_ROWS)
    mixed = lambda ids, salt: (ids.to_numpy().astype(np.uint64) * np.uint64(salt)) >> np.uint64(33)

    def deal(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            s = np.stack(pdf["s"].to_numpy())
            c = ((s.view(np.uint64) ^ flip) >> np.uint64(BITS - cell_bits)).astype(np.int64) if cell_bits else np.zeros(s.shape, np.int64)
            for t in range(trees):
                chunk = (mixed(pdf["rep"], 0x9E3779B97F4A7C15) % chunks[t, c[:, t]].astype(np.uint64)).astype(np.int64)
                i = np.repeat(np.arange(len(pdf)), blocks[t, c[:, t]])
                block = np.arange(len(i)) - np.searchsorted(i, i)
                yield pd.DataFrame({"t": np.int32(t), "cell": c[i, t], "chunk": chunk[i], "block": block, "rep": pdf["rep"].to_numpy()[i], "s": s[i, t], "v": pdf["v"].to_numpy()[i]})

    def ask(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in it:
            for start in range(0, len(whole), 256):
                pdf = whole.iloc[start : start + 256]
                v, rep, part = pdf["v"].to_numpy(), pdf["rep"].to_numpy(), mixed(pdf["rep"], 0xC2B2AE3D27D4EB4F)
                for t, h, depth, i, cell in visited(matrix(pdf["v"], packed)):
                    many = chunks[t, cell]
                    j = np.repeat(np.arange(len(i)), many)
                    chunk = np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many)
                    i, cell = i[j], cell[j]
                    block = (part[i] % blocks[t, cell].astype(np.uint64)).astype(np.int64)
                    yield pd.DataFrame({"t": np.int32(t), "cell": cell, "chunk": chunk, "block": block, "q": rep[i], "s": (h[i] ^ flip).view(np.int64), "depth": depth[i], "v": v[i]})

    index = entries.mapInPandas(deal, "t int, cell long, chunk long, block long, rep long, s long, v binary")
    visits = ask_reps.mapInPandas(ask, "t int, cell long, chunk long, block long, q long, s long, depth long, v binary")
    by = ["t", "cell", "chunk", "block"]

    def cell_search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search_cell(left, right, k + 1, need, packed)

    found = index.groupBy(*by).cogroup(visits.groupBy(*by)).applyInPandas(cell_search, "q long, ids array<long>, scores array<double>")
    pairs = found.select("q", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("q", F.col("p.ids").alias("rep"), F.col("p.scores").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    top = pairs.groupBy("q", "rep").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.select("query_id", F.col("rep").alias("q"))
        .join(top.select("q", "rep", "score"), "q")
        .join(members.select("rep", "vec_id"), "rep")
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
