"""Licence recognition by fingerprints, and line diffs against the recognised template.

Templates are a small table ``(spdx, text)``: the fixed ones or the caller's own, for instance read
with :func:`read_templates` from a folder of licence files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import functions as fn
from corpusmill.operators.dedup import sha
from corpusmill.operators.fixed import LICENSES
from corpusmill.operators.linediff import apply_ops, diff

MOST_PARAMS = 900
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"


def applicable(rel_path: Column) -> Column:
    return F.substring_index(rel_path, "/", -1).rlike(r"(?is)^(?:licen[cs]e|copying|notice)(?:\..+)?$")


def normalised(text: Column) -> Column:
    return F.btrim(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit(SPACES))


def body(text: Column) -> Column:
    """The normalised text without lines that begin with "copyright"."""
    return F.array_join(F.filter(F.split(normalised(text), "\n", -1), lambda x: ~x.rlike(r"(?i)^\s*copyright")), "\n")


def templates(spark: SparkSession, notices: dict[str, str] | None = None) -> DataFrame:
    """``(spdx, template, full_sha, body_sha)``."""
    rows = list((LICENSES if notices is None else notices).items())
    df = fn.literal_table(spark, rows, "spdx string, text string")
    return df.select("spdx", normalised(F.col("text")).alias("template"), sha(normalised(F.col("text"))).alias("full_sha"), sha(body(F.col("text"))).alias("body_sha"))


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Licence texts ``<spdx>.txt`` of a folder on any store that Spark reads; a table for people, so it is small."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("spdx"), F.col("content").cast("string").alias("text"))
    return {r["spdx"]: r["text"] for r in named.orderBy("spdx").collect()}


def detect(files: DataFrame, known: DataFrame, content: str = "content") -> DataFrame:
    """Add ``spdx`` and ``match`` (``full``, ``body`` or null); ``known`` is a table that Spark broadcasts by its size."""
    text = F.col(content)
    hashed = lambda c: F.when(text.isNotNull(), sha(c))
    h = files.withColumns({"__full": hashed(normalised(text)), "__body": hashed(body(text))})
    h = h.join(known.select(F.col("full_sha").alias("__full"), F.col("spdx").alias("__s1")), "__full", "left")
    h = h.join(known.select(F.col("body_sha").alias("__body"), F.col("spdx").alias("__s2")), "__body", "left")
    return h.withColumn("spdx", F.coalesce("__s1", "__s2")).withColumn("match", F.when(F.col("__s1").isNotNull(), "full").when(F.col("__s2").isNotNull(), "body")).drop("__full", "__body", "__s1", "__s2")


def _compact(spdx: str, ops: list[tuple[str, list[str]]], newline: bool) -> str:
    out = []
    for kind, lines in ops:
        if kind == "=":
            out.append({"k": "=", "n": len(lines)})
        else:
            out.extend({"k": kind, "l": line} for line in lines)
    return json.dumps({"spdx": spdx, **({"ops": out} if out else {}), **({"nl": True} if newline else {})}, ensure_ascii=False, separators=(",", ":"))


def apply_rule(files: DataFrame, known: DataFrame, content: str = "content") -> DataFrame:
    """Add ``spdx``, ``match``, ``template`` and ``params``: how the file follows from its template; null if it is not
    one, if the params exceed 900 bytes, or if they would not restore the content byte for byte."""
    found = detect(files, known, content).join(known.select("spdx", "template"), "spdx", "left")

    @F.pandas_udf("string")
    def params(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for spdx, match, template, content in batches:
            out = []
            for s, m, t, c in zip(spdx, match, template, content, strict=True):
                if s is None or c is None:
                    out.append(None)
                    continue
                text = c.replace("\r\n", "\n").strip(SPACES)
                ops = [] if m == "full" else diff(t.split("\n"), text.split("\n"))
                p = _compact(s, ops, c.endswith("\n"))
                out.append(p if len(p.encode()) <= MOST_PARAMS and restore(t, p) == c else None)
            yield pd.Series(out, dtype=object)

    return found.withColumn("params", params("spdx", "match", "template", F.when(F.col("spdx").isNotNull(), F.col(content))))


def restored(template: Column, params: Column) -> Column:
    """What :func:`restore` makes of a template and params; null if either is."""

    @F.pandas_udf("string")
    def run(t: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else restore(x, y) for x, y in zip(t, p, strict=True)], dtype=object)

    return run(template, params)


def restore(template: str, params: str) -> str:
    p = json.loads(params)
    lines = template.split("\n")
    if p.get("ops"):
        ops, at = [], 0
        for o in p["ops"]:
            if o["k"] == "=":
                ops.append(("=", lines[at : at + o.get("n", 0)]))
                at += o.get("n", 0)
            else:
                ops.append((o["k"], [o.get("l", "")]))
                at += o["k"] == "-"
        lines = apply_ops(lines, ops)
    return "\n".join(lines) + ("\n" if p.get("nl") else "")
