"""The ordered rules a planner chooses from, as column builders.

A rule says where it applies (by path and size only, so planning reads no content), what it is
expected to save and to cost, what it stores and how that is restored.  The first applicable rule whose
gain exceeds its cost and that handles the content wins.  Rules of one's own are :class:`Rule` objects:
the registry is an argument of planning, building and restoring.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import functions as fn
from corpusmill.operators import canonical, license, lines


class Context(NamedTuple):
    """The small tables that rules look things up in."""

    dictionary: DataFrame
    templates: DataFrame


def context(spark: SparkSession, dictionary: DataFrame | None = None, templates: DataFrame | None = None) -> Context:
    return Context(lines.fixed_dictionary(spark) if dictionary is None else dictionary, license.templates(spark) if templates is None else templates)


class Rule(NamedTuple):
    """``store(df, text, context, out, params)`` adds two columns: what is stored for the string column ``text``,
    null where the rule does not handle it, and what it takes besides to restore it, a string or null.
    ``text`` is null where the rule need not look.  ``restore(df, stored, params, context, out)`` adds the text
    again; it too sees nulls in the rows of other rules.  Without a ``store`` a rule handles nothing; without a
    ``restore`` what is stored is the text.
    """

    id: str
    applicable: Callable[[Column, Column], Column]
    gain: Callable[[Column], Column]
    cost: Callable[[Column], Column]
    default: bool = False
    lossless: bool = False
    store: Callable[[DataFrame, str, Context, str, str], DataFrame] | None = None
    restore: Callable[[DataFrame, str, str, Context, str], DataFrame] | None = None
    stub: bool = False


def _div(n: int) -> Callable[[Column], Column]:
    return lambda s: F.floor(s / n)


def _nothing(df: DataFrame, params: str) -> DataFrame:
    return df.withColumn(params, F.lit(None).cast("string"))


def _store_lines(df: DataFrame, text: str, c: Context, out: str, params: str) -> DataFrame:
    done = lines.encode(df, c.dictionary, out, text)
    return _nothing(done.withColumn(out, F.when(F.col(text).isNotNull(), F.col(out))), params)


def _restore_lines(df: DataFrame, stored: str, params: str, c: Context, out: str) -> DataFrame:
    done = lines.decode(df, c.dictionary, stored, out)
    return done.withColumn(out, F.when(F.col(stored).isNotNull(), F.col(out)))


def _store_license(df: DataFrame, text: str, c: Context, out: str, params: str) -> DataFrame:
    own = ("spdx", "match", "template", "params")
    kept = {n: f"__kept_{n}" for n in own if n in df.columns}
    done = license.apply_rule(df.withColumnsRenamed(kept), c.templates, text)
    done = done.withColumns({out: F.when(F.col("params").isNotNull(), F.col("template")), params: F.col("params")})
    return done.drop(*[n for n in own if n != params]).withColumnsRenamed({v: k for k, v in kept.items()})


def _restore_license(df: DataFrame, stored: str, params: str, c: Context, out: str) -> DataFrame:
    return df.withColumn(out, license.restored(F.col(stored), F.col(params)))


def _store_json(df: DataFrame, text: str, c: Context, out: str, params: str) -> DataFrame:
    return _nothing(df.withColumn(out, canonical.canonical_json(F.col(text))), params)


def _store_log(df: DataFrame, text: str, c: Context, out: str, params: str) -> DataFrame:
    own = ("template", "n_lines", "suffixes")
    kept = {n: f"__kept_{n}" for n in own if n in df.columns}
    done = canonical.log_template(df.withColumnsRenamed(kept), text)
    done = done.withColumns({out: F.col("suffixes"), params: F.when(F.col("template").isNotNull(), F.to_json(F.struct(F.col("template").alias("tmpl"))))})
    return done.drop(*own).withColumnsRenamed({v: k for k, v in kept.items()})


def _restore_log(df: DataFrame, stored: str, params: str, c: Context, out: str) -> DataFrame:
    return df.withColumn(out, canonical.log_restore(F.get_json_object(params, "$.tmpl"), F.col(stored)))


DEDUP = Rule("dedup/v1", lambda p, s: s > 0, lambda s: s, _div(1024), True, True)
LINES = Rule("go-line-subst/v1", lambda p, s: (s > 0) & p.rlike(r"(?s)\.go$"), _div(10), _div(1024), True, True, _store_lines, _restore_lines)
LICENSE = Rule("license-canonical/v1", lambda p, s: license.applicable(p), lambda s: s, lambda s: F.lit(512), True, True, _store_license, _restore_license)
JSON = Rule("json-canonical/v1", canonical.json_applicable, _div(4), _div(512), store=_store_json)
LOG = Rule("log-template/v1", canonical.log_applicable, _div(3), _div(256), store=_store_log, restore=_restore_log)
NEAR = Rule("near-dup-delta/v1", lambda p, s: F.lit(False), lambda s: F.lit(0), lambda s: F.lit(0), stub=True)

ALL = (DEDUP, LINES, LICENSE, JSON, LOG, NEAR)
DEFAULT = tuple(r for r in ALL if r.default)


def states(rules: tuple[Rule, ...] = ALL) -> list[tuple[int, str, str, bool]]:
    return [(i, r.id, "default" if r.default else "stub" if r.stub else "opt-in", r.lossless) for i, r in enumerate(rules)]


def registry(spark: SparkSession, rules: tuple[Rule, ...] = ALL) -> DataFrame:
    """``(position, id, state, lossless)`` of every known rule."""
    return fn.literal_table(spark, states(rules), "position int, id string, state string, lossless boolean")
