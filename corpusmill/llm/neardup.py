"""Near-duplicate detection: MinHash with tensored banding, links confirmed on full shingle sets.

A document's set holds the distinct ``width``-word shingles of its text; words are runs of characters
other than ASCII white space, with A-Z lower-cased.  A text of fewer words is one shingle; no words:
an empty set, linked with nothing.  Two documents are linked if ``100 * |A & B| >= pct * |A | B|``.

*Tensored banding.*  ``m`` small collections of ``band`` minhashes each are computed, and the tables'
keys are the pairs of collections: ``m * (m - 1) / 2`` tables of ``2 * band`` minhashes from
``m * band`` computed ones.  ``m`` is the least number for which a link at the threshold shares no
table with a probability of at most ``miss``.  Pairs are formed only of collection values that
several documents have, so that most documents never reach a table.

*Groups.*  Documents with one set are one class, so exact copies cost a row of aggregation.  In every
bucket of a table, one pivot is compared with the others, not all pairs.  Buckets that then still
hold several components are searched again: only the outsiders, documents outside the bucket's largest
component, are compared with the rest, and only across components, by size and sketch.  Where the
pairs left are few, they are confirmed one by one; where they are many, the outsiders are compared
through an inverted index of full sets.  Outsiders and members are dealt out in blocks of bounded rows
and shingles, and each task holds a block of either.  There is no cap on buckets or partners, and no
pair of a bucket that can join two components is left out.

*Parities.*  Full sets are long, so a pair is first held to the parities of its sets: of each of at least
twice as many bins as the set has shingles, whether it holds an odd number of them.  Two sets differ in at
least as many shingles as parities, so a pair with too many is no link, whatever its sets; no link is lost.

Components are found by alternating star contraction, all of it in tables.

Nulls: a null text is empty.  A null id takes part; ``component_id`` is the smallest id of the
component that is not null.  Repeated rows are copies.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.staging import join_side, ship_package, small_batches, stage

BAND = 3
#: Documents and shingles of a block of an open bucket.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
ONE_TASK = 500_000
#: Narrow rows up to which a side of a join is broadcast, by count; about 100 MB.
SIDE_ROWS = 2_000_000
_ODD = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """Hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_digest(word)
        return h


#: One a Python worker, kept from task to task.
_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, width: int, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    split = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not split:
        return np.zeros(0, np.uint64)
    w = np.frombuffer(b"".join(map(words.__getitem__, split)), "<u8")
    with np.errstate(over="ignore"):
        if len(w) < width:
            return _mix(np.array([int(sum(int(x) * int(_ODD[i]) for i, x in enumerate(w)) + len(w)) & (2**64 - 1)], np.uint64))
        h = np.full(len(w) - width + 1, width, np.uint64)
        for j in range(width):
            h += w[j : len(w) - width + 1 + j] * _ODD[j]
        return np.unique(_mix(h))


@cache
def plan(pct: int, band: int = BAND, miss: float = 2e-4) -> tuple[int, int]:
    """Number of collections, and the least agreement of whole sketches that a link can have."""
    s = pct / 100
    p = s**band
    m = 2
    while (1 - p) ** m + m * p * (1 - p) ** (m - 1) > miss:
        m += 1
    n = m * band
    tail, least = 0.0, 0
    for k in range(n + 1):
        tail += math.comb(n, k) * s**k * (1 - s) ** (n - k)
        if tail > 1e-6:
            least = k
            break
    return m, least


def sketches(sets: list[np.ndarray], functions: int) -> np.ndarray:
    """``(sets, functions)`` minima of 64-bit hash functions; empty sets are not allowed."""
    rng = np.random.default_rng(11)
    mul = rng.integers(0, 1 << 63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, functions, dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
    out = np.empty((len(sets), functions), np.uint64)
    for j in range(functions):
        v = flat * mul[j] + add[j]
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, j] = np.minimum.reduceat(v, starts)
    return out


def parities(hashes: np.ndarray) -> bytes:
    """Whether each bin holds an odd number of the set's hashes; the number of bins is a power of two."""
    bins = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes % np.uint64(bins)).astype(np.int64), minlength=bins).astype(np.uint8) & 1).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """What :func:`parities` are with fewer bins, ``size`` bytes of them."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


class Parities:
    """The parities of the sets of a cell, at every size that occurs."""

    def __init__(self, column) -> None:
        own = [np.frombuffer(x, np.uint8) for x in column]
        self.size = np.array([len(x) for x in own])
        self.at = {k: (np.cumsum(self.size >= k) - 1, np.stack([folded(x, k) for x in own if len(x) >= k])) for k in np.unique(self.size)}

    def differ(self, k: int, some: np.ndarray) -> np.ndarray:
        """In how many parities each of ``some`` differs from ``k``: no more than the sets differ in shingles."""
        out = np.zeros(len(some), np.int64)
        common = np.minimum(self.size[some], self.size[k])
        for size in np.unique(common):
            (row, bits), here = self.at[size], common == size
            out[here] = np.bitwise_count(bits[row[some[here]]] ^ bits[row[k]]).sum(axis=1, dtype=np.int64)
        return out


def near_enough(differ: np.ndarray, sizes: np.ndarray, pct: int) -> np.ndarray:
    """Whether sets that differ in this many shingles at least can be links; ``sizes`` is the sum of both."""
    return (100 + pct) * differ <= (100 - pct) * sizes


def signatures(docs: DataFrame, width: int, pct: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, rid, row, n, fp, bits, bands, mins)`` of each row; the last four are null for an empty set."""
    m, _ = plan(pct)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words

        def done(part: pd.DataFrame, sets: list[np.ndarray]) -> pd.DataFrame:
            full = [s for s in sets if len(s)]
            bands, mins = iter([]), iter([])
            if full:
                sk = sketches(full, m * BAND)
                b = np.zeros((len(full), m), np.uint64)
                for j in range(BAND):
                    b = _mix(b * np.uint64(31) + sk[:, j::BAND] + np.arange(m, dtype=np.uint64))
                bands, mins = iter(list(b.view(np.int64))), iter([x.tobytes() for x in (sk >> np.uint64(32)).astype("<u4")])
            return pd.DataFrame({
                "doc_id": part["doc_id"], "rid": part["rid"], "row": part["row"], "n": [len(s) for s in sets],
                "fp": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "bits": [parities(s) if len(s) else None for s in sets],
                "bands": [next(bands) if len(s) else None for s in sets], "mins": [next(mins) if len(s) else None for s in sets],
            })

        for pdf in it:
            at, sets, size = 0, [], 0
            for i, text in enumerate(pdf["text"].to_numpy()):
                sets.append(shingle_set(text, width, words))
                size += len(sets[-1])
                if size > 400_000 or i == len(pdf) - 1:
                    yield done(pdf.iloc[at : i + 1], sets)
                    at, sets, size = i + 1, [], 0

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("rid"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return own.mapInPandas(_nullable_ids(run), "doc_id long, rid long, row long, n long, fp binary, bits binary, bands array<long>, mins binary")


def _nullable_ids(f):
    """Ids stay integers when some are null."""

    def g(it):
        return f(pdf.assign(doc_id=pdf["doc_id"].astype("Int64")) for pdf in it)

    return g


def row_key(id_col: str, text_col: str) -> Column:
    """Stands for the rows of one id and one text."""
    return F.xxhash64(F.col(id_col).cast("long"), text_col)


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(fp, hashes)``: the sets of the classes in ``wanted (row)``, one row each.

    A class is asked for by one of its rows, so its copies stay where they are.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words
        for pdf in it:
            for at in range(0, len(pdf), 256):
                sets = [shingle_set(t, width, words).tobytes() for t in pdf["text"].iloc[at : at + 256]]
                yield pd.DataFrame({"fp": [xxhash.xxh3_128_digest(s) for s in sets], "hashes": sets})

    one = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")).join(wanted, "row", "left_semi")
    return one.groupBy("row").agg(F.first("text").alias("text")).select("text").mapInPandas(run, "fp binary, hashes binary")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()


def among(table: DataFrame, wanted: DataFrame, label: str) -> DataFrame:
    """The rows of ``table`` whose class is in ``wanted (fp)``."""
    return table.join(join_side(stage(wanted, label), SIDE_ROWS // 2), "fp", "left_semi")


def confirm(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs ``(a, b)`` that are links, by their full sets."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            keep = []
            for x, y in zip(pdf["ha"], pdf["hb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= pct * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["a", "b"]]

    with_b = pairs.join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("hb")), "b")
    both = with_b.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("ha")), "a")
    return both.select("a", "b", "ha", "hb").mapInPandas(run, "a binary, b binary")


def _union(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Roots of all nodes of the edges of one task."""
    up: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p] if p in up else p
        return x

    for pdf in it:
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for at in range(0, len(nodes), 10_000):
        some = [(x, find(x)) for x in nodes[at : at + 10_000]]
        yield pd.DataFrame([r for r in some if r[0] != r[1]], columns=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)`` but the roots: the least node reachable.

    Rounds of star contraction, until the edges left are counted to be at most :data:`ONE_TASK`; these
    are joined up in one task of bounded memory.
    """
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        if state[0] <= ONE_TASK:
            return stage(now.coalesce(1).mapInPandas(_union, "node binary, root binary"), "roots")
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(mins, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(mins.select("a", F.col("m").alias("b")).unionByName(moved).distinct(), "edges")


def can_link(n: np.ndarray, sk: np.ndarray, held: Parities, comp: np.ndarray, rest: np.ndarray, k: int, least: int, pct: int) -> np.ndarray:
    """Which of the members ``rest`` can be linked with ``k``, of another component, by size, sketch and parities."""
    m = n[rest]
    some = rest[(comp[rest] != comp[k]) & (100 * np.minimum(m, n[k]) >= pct * np.maximum(m, n[k]))]
    some = some[(sk[some] == sk[k]).sum(axis=1) >= least]
    return some[near_enough(held.differ(k, some), n[some] + n[k], pct)]


def plausible_pairs(fp: np.ndarray, comp: np.ndarray, n: np.ndarray, sk: np.ndarray, held: Parities, out: np.ndarray, least: int, pct: int) -> tuple[list, list] | None:
    """Pairs of an outsider (``out``) and a member in different components that can be links; None if they
    are many more than the rows."""
    a, b = [], []
    rest = np.flatnonzero(~out)
    for k in np.flatnonzero(out):
        can = can_link(n, sk, held, comp, rest, k, least, pct)
        if len(a) + len(can) > 2 * len(fp):
            return None
        for y in fp[can]:
            a.append(max(fp[k], y))
            b.append(min(fp[k], y))
    return a, b


def dense_links(fp: np.ndarray, comp: np.ndarray, sk: np.ndarray, hashes: list[np.ndarray], out: np.ndarray, least: int, pct: int) -> tuple[list, list]:
    """Links that join all components that are linked between outsiders and members, found on full sets."""
    n = np.array([len(x) for x in hashes])
    rest = np.flatnonzero(~out)
    if not len(rest):
        return [], []
    held = Parities(map(parities, hashes))
    known = np.concatenate([hashes[i] for i in rest])
    owner = np.repeat(rest.astype(np.int32), n[rest])
    order = np.argsort(known, kind="stable")
    known, posts = known[order], owner[order]  # an inverted index: runs of equal shingles
    comp = comp.copy()
    a, b = [], []
    central = np.zeros(len(fp))
    for j in range(sk.shape[1]):
        _, inv, cnt = np.unique(sk[:, j], return_inverse=True, return_counts=True)
        central += cnt[inv]
    outsiders = np.flatnonzero(out)
    for k in outsiders[np.argsort(-central[outsiders], kind="stable")]:  # those that most resemble the others link most
        can = can_link(n, sk, held, comp, rest, k, least, pct)
        if not len(can):
            continue
        lo, hi = np.searchsorted(known, hashes[k], "left"), np.searchsorted(known, hashes[k], "right")
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum()))
        both = np.bincount(posts[at], minlength=len(fp))[can]
        for x in can[100 * both >= pct * (n[can] + n[k] - both)]:
            if comp[x] != comp[k]:
                a.append(max(fp[k], fp[x]))
                b.append(min(fp[k], fp[x]))
                comp[comp == comp[x]] = comp[k]
    return a, b


def _by_bucket(f):
    """Call ``f`` with the rows of whole buckets, for rows sorted by (key, i, j)."""

    def g(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: list[pd.DataFrame] = []
        for pdf in it:
            if not len(pdf):
                continue
            last = pdf[["key", "i", "j"]].iloc[-1]
            tail = ((pdf["key"] == last["key"]) & (pdf["i"] == last["i"]) & (pdf["j"] == last["j"])).to_numpy()
            if not tail.all():
                yield f(pd.concat([*left, pdf[~tail]]))
                left = []
            left.append(pdf[tail])
        if left:
            yield f(pd.concat(left))

    return g


def _buckets(pdf: pd.DataFrame) -> Iterator[slice]:
    key, i, j = (pdf[c].to_numpy() for c in ("key", "i", "j"))
    at = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0), [True]]))
    return (slice(x, y) for x, y in zip(at[:-1], at[1:], strict=True))


def _sketch_search(least: int, pct: int):
    """Plausible pairs of sparse cells, and the cells that are dense."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, n, comp, out = pdf["fp"].to_numpy(), pdf["n"].to_numpy(), pd.factorize(pdf["comp"])[0], pdf["out"].to_numpy()
        key, i, j = (pdf[c].to_numpy() for c in ("key", "i", "j"))
        sk, bits = np.stack([np.frombuffer(x, "<u4") for x in pdf["mins"]]), pdf["bits"].to_numpy()
        pairs, dense = {}, []
        for s in _buckets(pdf):
            found = plausible_pairs(fp[s], comp[s], n[s], sk[s], Parities(bits[s]), out[s], least, pct)
            if found is None:
                dense.append((key[s][0], i[s][0], j[s][0]))
            else:
                pairs.update(dict.fromkeys(zip(*found, strict=True)))
        # a 64-bit key stays whole beside missing ones only in a nullable integer column
        none = [None] * len(pairs)
        cell = {c: pd.array([*none, *(d[k] for d in dense)], t) for k, (c, t) in enumerate((("key", "Int64"), ("i", "Int32"), ("j", "Int32")))}
        blank = [None] * len(dense)
        return pd.DataFrame({"a": [*(p[0] for p in pairs), *blank], "b": [*(p[1] for p in pairs), *blank], **cell})

    return _by_bucket(search)


def _dense_search(least: int, pct: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for s in _buckets(pdf):
            part = pdf.iloc[s]
            sk = np.stack([np.frombuffer(x, "<u4") for x in part["mins"]])
            sets = [np.frombuffer(x, np.uint64) for x in part["hashes"]]
            found = dense_links(part["fp"].to_numpy(), pd.factorize(part["comp"])[0], sk, sets, part["out"].to_numpy(), least, pct)
            a.extend(found[0])
            b.extend(found[1])
        return pd.DataFrame({"a": a, "b": b})

    return _by_bucket(search)


def _cells(opened: DataFrame) -> DataFrame:
    """``(key, i, j, fp, n, comp, out)``: block i of a bucket's outsiders beside block j of all its members.

    ``opened (key, fp, n, comp)``.  An outsider is there in both roles.
    """
    parts = opened.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    shape = parts.groupBy("key").agg(F.max(F.struct("c", "s", "comp")).alias("g"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    blocks = lambda c, s: F.greatest(F.lit(1), F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    shape = shape.select("key", F.col("g.comp").alias("large"), blocks(F.col("c"), F.col("s")).alias("all"), blocks(F.col("c") - F.col("g.c"), F.col("s") - F.col("g.s")).alias("few"))
    dealt = opened.join(join_side(stage(shape, "shapes"), SIDE_ROWS), "key").withColumn("i", F.pmod(F.xxhash64("fp", F.lit(1)), "few").cast("int")).withColumn("j", F.pmod(F.xxhash64("fp"), "all").cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    member = F.transform(upto("few"), lambda x: F.struct(x.alias("i"), F.col("j"), F.lit(False).alias("out")))
    outsider = F.transform(upto("all"), lambda x: F.struct(F.col("i"), x.alias("j"), F.lit(True).alias("out")))
    cells = F.when(F.col("comp") == F.col("large"), member).otherwise(F.concat(member, outsider))
    return dealt.select("key", F.explode(cells).alias("x"), "fp", "n", "comp").select("key", "x.i", "x.j", "fp", "n", "comp", "x.out")


def near_duplicates(docs: DataFrame, width: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, class_fp, root_fp, rid)``, a row for each row of ``docs``.

    ``kept``: the id is the component's (null-safe, so a component without ids keeps its rows).
    ``class_fp`` is equal for equal sets, ``root_fp`` for a component; both null for an empty set;
    ``rid`` is ``xxhash64`` of the text.
    """
    ship_package(docs.sparkSession)
    with small_batches(docs.sparkSession):  # all that Python sees is staged in here
        return _near_duplicates(docs, width, pct, id_col, text_col)


def _near_duplicates(docs: DataFrame, width: int, pct: int, id_col: str, text_col: str) -> DataFrame:
    _, least = plan(pct)
    sig = stage(signatures(docs, width, pct, id_col, text_col), "signatures")
    classes = stage(
        sig.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"), F.first("mins").alias("mins")),
        "classes",
    )
    values = classes.select("fp", "n", F.explode("bands").alias("h"))
    common = join_side(stage(values.groupBy("h").count().where("count > 1").select("h"), "common"), SIDE_ROWS)
    live = values.join(common, "h", "left_semi").groupBy("fp").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("h")).alias("hs")).where(F.size("hs") > 1)
    pairs_of = F.flatten(F.transform("hs", lambda x, i: F.transform(F.slice("hs", i + 2, F.size("hs")), lambda y: F.xxhash64(x, y))))
    tables = stage(live.select("fp", "n", F.explode(pairs_of).alias("key")), "tables")
    # the pivot differs from table to table, so a large group is compared with many of its members
    pivots = stage(
        tables.groupBy("key").agg(F.min(F.struct(F.xxhash64("fp", "key").alias("o"), "fp", "n")).alias("p"), F.count("*").alias("c")).where("c > 1").select("key", F.col("p.fp").alias("pivot"), F.col("p.n").alias("pn"), "c"),
        "pivots",
    )
    sized = F.lit(100) * F.least("n", "pn") >= F.lit(pct) * F.greatest("n", "pn")
    star = tables.join(pivots, "key").where((F.col("fp") != F.col("pivot")) & sized).select(F.greatest("fp", "pivot").alias("a"), F.least("fp", "pivot").alias("b")).distinct()
    marks = classes.select("fp", "n", "mins", "bits")

    def alike(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = np.stack([np.frombuffer(v, "<u4") for v in pdf["ma"]])
                y = np.stack([np.frombuffer(v, "<u4") for v in pdf["mb"]])
                pdf = pdf[(x == y).sum(axis=1) >= least]
                differ = np.array([Parities(p).differ(0, np.array([1]))[0] for p in zip(pdf["xa"], pdf["xb"], strict=True)], np.int64)
                yield pdf.loc[near_enough(differ, pdf["na"].to_numpy() + pdf["nb"].to_numpy(), pct), ["a", "b"]]

    side = lambda x: marks.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("mins").alias(f"m{x}"), F.col("bits").alias(f"x{x}"))
    sketched = star.join(side("b"), "b").join(side("a"), "a")
    star = stage(sketched.select("a", "b", "na", "nb", "ma", "mb", "xa", "xb").mapInPandas(alike, "a binary, b binary"), "pairs")

    def sets_for(wanted: DataFrame) -> DataFrame:
        rows = stage(classes.select("fp", "row").join(wanted, "fp", "left_semi").select("row"), "wanted")
        return stage(full_sets(docs, join_side(rows, SIDE_ROWS), width, id_col, text_col), "sets")

    star_sets = sets_for(ends(star))
    links = stage(confirm(star, star_sets, pct), "links")
    # buckets that still hold several components, those of the same documents once
    roots = join_side(components(links), SIDE_ROWS // 2)
    labelled = tables.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("root", "fp")).drop("root")
    buckets = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.sum(F.xxhash64("fp").cast("decimal(20,0)")).alias("who"))
    open_keys = buckets.where("lo != hi and c > 2").groupBy("who", "c").agg(F.min("key").alias("key"))
    open_keys = join_side(stage(open_keys.select("key"), "open-keys"), SIDE_ROWS)
    opened = stage(labelled.join(open_keys, "key", "left_semi").select("key", "fp", "n", "comp"), "open")
    grid = stage(_cells(opened), "cells")
    marks = stage(among(marks.drop("n"), opened.select("fp").distinct(), "members"), "marks")
    bucket = ["key", "i", "j"]
    in_order = lambda df: df.repartition(*bucket).sortWithinPartitions(*bucket)
    chosen = stage(in_order(grid.join(marks, "fp")).mapInPandas(_sketch_search(least, pct), "a binary, b binary, key long, i int, j int"), "plausible")
    pairs = stage(chosen.where("a is not null").select("a", "b").distinct().join(star, ["a", "b"], "left_anti"), "pairs")
    dense = stage(grid.join(chosen.where("key is not null").select(*bucket), bucket, "left_semi"), "dense")
    more = sets_for(ends(pairs).union(dense.select("fp")).distinct().join(star_sets.select("fp"), "fp", "left_anti"))
    sets = star_sets.unionByName(more)
    searched = among(sets, dense.select("fp").distinct(), "searched").join(marks.select("fp", "mins"), "fp")
    inside = in_order(dense.join(searched, "fp")).mapInPandas(_dense_search(least, pct), "a binary, b binary")
    links = links.unionByName(stage(confirm(pairs, among(sets, ends(pairs), "ends"), pct).unionByName(inside), "links"))
    roots = components(links)
    rooted = classes.select("fp", "id").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stage(rooted, "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root")
    out = sig.select("doc_id", F.col("n").alias("n_shingles"), "fp", "rid").join(named.select("fp", "root", "component_id"), "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.col("fp").alias("class_fp"), F.col("root").alias("root_fp"), "rid")


#: Every pair of sets that share a shingle, and all that can be reached: for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
k AS (SELECT r, doc_id, len(sh) AS n, CASE WHEN len(sh) > 0 THEN md5(array_to_string(list_sort(sh), chr(10))) END AS cls, sh FROM s),
c AS (SELECT cls, any_value(n) AS n, any_value(sh) AS sh, min(doc_id) AS id FROM k WHERE cls IS NOT NULL GROUP BY cls),
e AS (SELECT cls, unnest(sh) AS g FROM c),
meet AS (SELECT a.cls AS a, b.cls AS b, count(*) AS m FROM e a JOIN e b ON a.g = b.g AND a.cls < b.cls GROUP BY 1, 2),
link AS (SELECT a, b FROM meet JOIN c x ON x.cls = a JOIN c y ON y.cls = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT cls AS a, cls AS b FROM c UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
least AS (SELECT reach.a AS cls, min(c.id) AS id FROM reach JOIN c ON c.cls = reach.b GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(least.id, doc_id) AS component_id, doc_id = coalesce(least.id, doc_id) AS kept FROM k LEFT JOIN least USING (cls)"""
