"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to column expressions.

1. Statistics of the text are built-in column functions (:func:`statistics`).
2. On a bounded sample of labelled rows, small trees are boosted on the driver; every path from a root
   to a node is a conjunctive rule.
3. Logistic regression with a lasso penalty over the rules keeps a few of them with weights.
4. The kept rules are compiled into one Spark expression, so scoring is a projection of the scan.

A null text is empty.  Labels that are null are not learned from; without labels every score is 0.5.
Rows are kept as they are, repeated ids included; statistics use columns named ``__f_*``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "__f_"


def statistics(text: Column) -> dict[str, Column]:
    """Counts from which :data:`RATIOS` are made; each reads the text once."""
    t = F.coalesce(text, F.lit(""))
    left = lambda cls: F.char_length(F.regexp_replace(t, f"[^{cls}]+", "")).cast("double")
    words = F.split(t, r"[\x20\x09-\x0D]+")
    lines = F.split(t, "\n")
    return {
        "chars": F.char_length(t).cast("double"),
        "words": F.size(words).cast("double"),
        "distinct": F.size(F.array_distinct(words)).cast("double"),
        "lines": F.size(lines).cast("double"),
        "dlines": F.size(F.array_distinct(lines)).cast("double"),
        "letters": left(r"\p{L}"),
        "upper": left(r"\p{Lu}"),
        "digits": left("0-9"),
        "stops": left(".,;"),
        "marks": left(r"!?|#$%&*=_<>{}\[\]\\/~^+@"),
        "short": F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,3}(?![^\x20\x09-\x0D])")).cast("double"),
    }


def ratios(c: dict[str, Column]) -> dict[str, Column]:
    """What rules are about, from the counts."""
    per = lambda a, b: F.col(f"{PREFIX}{a}") / F.greatest(F.col(f"{PREFIX}{b}"), F.lit(1.0))
    return {
        "words": F.col(f"{PREFIX}words"),
        "word_length": per("chars", "words"),
        "distinct": per("distinct", "words"),
        "line_words": per("words", "lines"),
        "same_lines": per("dlines", "lines"),
        "letters": per("letters", "chars"),
        "upper": per("upper", "letters"),
        "digits": per("digits", "chars"),
        "stops": per("stops", "words"),
        "marks": per("marks", "words"),
        "short": per("short", "words"),
    }


FEATURES = ("words", "word_length", "distinct", "line_words", "same_lines", "letters", "upper", "digits", "stops", "marks", "short")


class Rule(NamedTuple):
    """All of ``feature <= x`` (True) or ``feature > x`` (False)."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, below, at in self.tests:
            out &= (x[:, f] <= at) == below
        return out


class Model(NamedTuple):
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in self.rules:
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, features: dict[str, Column]) -> Column:
        names = list(FEATURES)
        z = F.lit(float(self.bias))
        for rule, w in self.rules:
            test = F.lit(True)
            for f, below, at in rule.tests:
                c = features[names[f]]
                test = test & (c <= F.lit(float(at)) if below else c > F.lit(float(at)))
            z = z + F.when(test, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, tests: tuple, out: list, some: np.ndarray, least: int) -> None:
    """Grow by the best second-order gain; appends (rule, row mask leaves) to ``out``."""
    gs, hs = g[rows].sum(), h[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        for f in some:
            b = bins[rows, f]
            k = len(edges[f]) + 1
            cg, ch, cn = (np.cumsum(np.bincount(b, weights=v, minlength=k))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
            ok = (cn >= least) & (len(rows) - cn >= least)
            gain = np.where(ok, cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1), -1)
            j = int(gain.argmax()) if len(gain) else -1
            if j >= 0 and gain[j] > best[0]:
                best = (gain[j], (f, j))
    if best[1] is None:
        out.append((None, rows, -gs / (hs + 1)))
        return
    f, j = best[1]
    low = bins[rows, f] <= j
    for side, part in ((True, rows[low]), (False, rows[~low])):
        deeper = (*tests, (int(f), side, float(edges[f][j])))
        out.append((Rule(deeper), None, 0.0))
        _tree(x, bins, edges, g, h, part, depth - 1, deeper, out, some, least)


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, rng: np.random.Generator) -> list[Rule]:
    edges = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1]))
        edges.append(np.array([float(f"{v:.6g}") for v in q]))
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    z = np.full(len(y), np.log(p / (1 - p)))
    rules: dict[Rule, None] = {}
    least = max(5, len(y) // 200)
    for _ in range(trees):
        pr = 1 / (1 + np.exp(-z))
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        some = np.sort(rng.choice(x.shape[1], min(x.shape[1], 6), replace=False))
        out: list = []
        _tree(x, bins, edges, pr - y, pr * (1 - pr), rows, depth, (), out, some, least)
        tree_rules = [r for r, _, _ in out if r is not None]
        rules.update(dict.fromkeys(tree_rules))
        # leaves in the order of growth: re-apply to all rows through their deepest rules
        path: list[Rule] = []
        for r, _, value in out:
            if r is not None:
                path = [q for q in path if len(q.tests) < len(r.tests)] + [r]
            else:
                z += rate * value * (path[-1].holds(x) if path else 1.0)
    return list(rules)


def lasso(a: np.ndarray, y: np.ndarray, strength: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the bias is free."""
    n, k = a.shape
    mean, sd = a.mean(0), a.std(0) + 1e-9
    s = (a - mean) / sd
    w, b, vw, vb, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    step = 4.0 / (np.linalg.norm(s, 2) ** 2 / n + 1)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(s @ vw + vb))) - y
        nw = vw - step * (s.T @ r) / n
        nw = np.sign(nw) * np.maximum(0, np.abs(nw) - step * strength)
        nb = vb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b - float((w * mean / sd).sum()), w / sd


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, strength: float = 0.004, seed: int = 42) -> Model:
    if not len(y):
        return Model(0.0, ())
    if y.min() == y.max():
        return Model(4.0 if y[0] else -4.0, ())
    rules = boosted_rules(x, y, trees, depth, 0.2, np.random.default_rng(seed))
    if not rules:
        p = y.mean()
        return Model(float(np.log(p / (1 - p))), ())
    bias, w = lasso(np.stack([r.holds(x) for r in rules], 1).astype(np.float64), y, strength)
    kept = [(r, float(f"{v:.6g}")) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-3]
    return Model(float(f"{bias:.6g}"), tuple(kept))


def held_out(doc_id: Column, modulus: int = 3, rest: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


def with_features(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    counts = statistics(F.col(text_col))
    return docs.withColumns({f"{PREFIX}{k}": c for k, c in counts.items()}), ratios(counts)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 3, rest: int = 1) -> Model:
    """Learn from about ``sample`` labelled rows, chosen by a hash of the id; held-out ids are never read."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), modulus, rest))
    n = usable.count()
    share = min(1.0, sample / max(1, n))
    some = usable.where(F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(3)), F.lit(1 << 30)) < share * float(1 << 30))
    some = some.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y"))
    # the sample's size is bounded by the parameter, so it may be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col)).join(F.broadcast(some), "__id")
    feats, r = with_features(rows, text_col)
    got = feats.select("__id", "__y", *[r[k].alias(k) for k in FEATURES]).toPandas().sort_values(["__id", "__y", *FEATURES], kind="stable")
    return train(got[list(FEATURES)].to_numpy(np.float64), got["__y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score, 0 to 1, higher for better."""
    feats, r = with_features(docs, text_col)
    feats = feats.withColumns({f"{PREFIX}r_{k}": c for k, c in r.items()})
    column = model.column({k: F.col(f"{PREFIX}r_{k}") for k in FEATURES})
    return feats.withColumn(name, column).select(*[c for c in docs.columns if c != name], name)


def keep(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more.

    A filter that is pushed below the projection would put every statistic in place of its name, once for
    each test of each rule.  What is observed between them counts all scored rows, so the filter has to stay
    above, and every statistic is computed once a row.
    """
    scored = score(docs, model, text_col, "__score")
    counted = scored.observe("quality", F.count(F.lit(1)).alias("scored"), F.count_if(F.col("__score") < least).alias("rejected"))
    return counted.where(F.col("__score") >= least).select(*docs.columns)
