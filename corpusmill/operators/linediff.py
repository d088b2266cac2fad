"""Shortest edit scripts on lines, and their replay, as functions and as Arrow-batched columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "array<struct<kind:string,lines:array<string>>>"
ARROW_OPS = pa.list_(pa.struct([("kind", pa.string()), ("lines", pa.list_(pa.string()))]))
#: Lines of both sides up to which a script is kept, and scripts that are kept.
KEPT_LINES, KEPT = 500, 1000


def diff(a: list[str], b: list[str]) -> list[tuple[str, list[str]]]:
    """Runs of ``=``, ``-`` and ``+`` that turn ``a`` into ``b`` with the fewest lines changed.

    A script depends only on which lines are equal, and texts that fill in one template are alike in that, so
    scripts are kept by numbers that stand for the lines.
    """
    numbers: dict[str, int] = {}
    x, y = (tuple(numbers.setdefault(line, len(numbers)) for line in lines) for lines in (a, b))
    out, i, j = [], 0, 0
    for kind, n in (_kept if len(x) + len(y) <= KEPT_LINES else _runs)(x, y):
        out.append((kind, b[j : j + n] if kind == "+" else a[i : i + n]))
        i, j = i + n * (kind != "+"), j + n * (kind != "-")
    return out


def _runs(a: tuple, b: tuple) -> list[tuple[str, int]]:
    return [(kind, len(some)) for kind, some in _shortest(a, b)]


_kept = lru_cache(KEPT)(_runs)


def _shortest(a: tuple, b: tuple) -> list[tuple[str, list]]:
    """Every diagonal holds how far its best path comes and that path, a chain of steps of which paths share
    what they have in common; what no best path needs any more is forgotten.
    """
    if not a or not b:
        return [("-", a)] if a else [("+", b)] if b else []
    goal, best = len(a) - len(b), {1: (0, None)}
    for d in range(len(a) + len(b) + 1):
        for k in range(-d, d + 1, 2):
            insert = k == -d or (k != d and best[k - 1][0] < best[k + 1][0])
            at, path = best[k + 1] if insert else best[k - 1]
            at += not insert
            end = at
            while end < len(a) and end - k < len(b) and a[end] == b[end - k]:
                end += 1
            best[k] = end, (d and ("+" if insert else "-"), at, end, k, path)
            if k == goal and end >= len(a):
                return _script(best[k][1], a, b)
    raise AssertionError("some script always turns a into b")


def _script(path: tuple | None, a: tuple, b: tuple) -> list[tuple[str, list]]:
    steps: list[tuple] = []  # from the end
    while path:
        kind, at, end, k, path = path
        steps.extend(("=", line) for line in reversed(a[at:end]))
        if kind:
            steps.append((kind, b[at - k - 1] if kind == "+" else a[at - 1]))
    return [(kind, [line for _, line in run]) for kind, run in groupby(reversed(steps), key=lambda s: s[0])]


def apply_ops(base: list[str], ops: list[tuple[str, list[str]]]) -> list[str]:
    """Replay a script; ``=`` and ``-`` beyond the base are an error, lines never reached are dropped."""
    out, at = [], 0
    for kind, lines in ops:
        if kind == "+":
            out.extend(lines)
            continue
        if at + len(lines) > len(base):
            raise ValueError("edit script runs past its base")
        if kind == "=":
            out.extend(base[at : at + len(lines)])
        at += len(lines)
    return out


def line_diff(a: Column, b: Column) -> Column:
    """Edit script between two array<string> columns; null if either is."""

    def one(p: list[str], q: list[str]) -> list[dict]:
        return [{"kind": k, "lines": v} for k, v in diff(p, q)]

    @F.arrow_udf(OPS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([None if p is None or q is None else one(p, q) for p, q in _pairs(x, y)], ARROW_OPS)

    return run(a, b)


def _pairs(x: pa.Array, y: pa.Array) -> Iterator[tuple]:
    """Values side by side, of which few are Python's at a time."""
    for at in range(0, len(x), 500):
        yield from zip(x.slice(at, 500).to_pylist(), y.slice(at, 500).to_pylist(), strict=True)


def replayed(base: Column, ops: Column) -> Column:
    """What a script makes of an array<string>; null if either is."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([None if p is None or q is None else apply_ops(p, [(o["kind"], o["lines"]) for o in q]) for p, q in _pairs(x, y)], pa.list_(pa.string()))

    return run(base, ops)


def changed(ops: Column, kind: str) -> Column:
    """Number of lines of one kind in a script."""
    return F.aggregate(ops, F.lit(0), lambda acc, o: acc + F.when(o["kind"] == kind, F.size(o["lines"])).otherwise(0))
