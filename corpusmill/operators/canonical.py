"""Canonical JSON and log templates."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.lines import split_lines


def json_applicable(rel_path: Column, size: Column) -> Column:
    return (size > 0) & (size <= 10 * 1024 * 1024) & F.lower(rel_path).rlike(r"(?s)(?:^|/)[^/]*\.json$")


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys, JVM-side; null where the text is no JSON (or repeats a key)."""
    return F.to_json(F.try_parse_json(text))


def _exact(text: str | None) -> str | None:
    def number(x: str) -> float | int:
        f = float(x)
        return int(f) if f.is_integer() and abs(f) < 1e21 else f

    try:
        value = json.loads(text, parse_int=number, parse_float=number, parse_constant=lambda _: 1 / 0)
    except (TypeError, ValueError, ZeroDivisionError, RecursionError):
        return None
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for c, e in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        out = out.replace(c, e)
    return out


def exact_canonical_json(text: Column) -> Column:
    """As :func:`canonical_json`, with numbers as doubles, HTML-safe escapes, and the last of repeated keys."""

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(_exact, na_action="ignore")

    return run(text)


def log_applicable(rel_path: Column, size: Column) -> Column:
    base = F.substring_index(rel_path, "/", -1)
    return size.between(1024, 50 * 1024 * 1024) & (base.isin("syslog", "messages", "kern.log") | base.rlike(r"(?s)\.log(?:\.[^.]*)?$"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i > n) | (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n)).cast("int")


def log_template(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``template`` (null: not handled), ``n_lines`` and ``suffixes``.

    The template is the longest prefix of the first non-empty line that more than half of the lines
    share.  Its length is an order statistic of the common prefix lengths, so one sort of small
    integers replaces trying every length.  A line without the prefix is marked by a leading 0x00.
    """
    lines = split_lines(F.col(content))
    lines = F.when(F.try_element_at(lines, F.lit(-1)) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    step = files.withColumn("__lines", lines).withColumn("n_lines", F.size("__lines"))
    step = step.withColumn("__first", F.try_element_at(F.filter("__lines", lambda x: x != ""), F.lit(1)))
    step = step.withColumn("__lcp", F.sort_array(F.transform("__lines", lambda x: shared_prefix(x, F.col("__first"))), asc=False))
    length = F.try_element_at("__lcp", (F.floor(F.col("n_lines") / 2) + 1).cast("int"))
    fits = (F.col("n_lines") >= 10) & F.col("__first").isNotNull()
    step = step.withColumn("template", F.when(fits, F.when(length > 0, F.substring(F.col("__first"), F.lit(1), length))))
    mark = lambda x: F.when(F.startswith(x, F.col("template")), F.substring(x, F.length("template") + 1, F.length(x))).otherwise(F.concat(F.lit("\x00"), x))
    step = step.withColumn("suffixes", F.when(F.col("template").isNotNull(), F.array_join(F.transform("__lines", mark), "\n")))
    return step.drop("__lines", "__first", "__lcp")


def log_restore(template: Column, suffixes: Column) -> Column:
    """The content of a template and its suffixes; a final newline is always written."""
    back = lambda x: F.when(F.startswith(x, F.lit("\x00")), F.substring(x, F.lit(2), F.length(x))).otherwise(F.concat(template, x))
    return F.concat(F.array_join(F.transform(F.split(suffixes, "\n", -1), back), "\n"), F.lit("\n"))
