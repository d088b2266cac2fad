"""Cost-based choice of one rule a file, with a log of every decision.

Order matters to exact dedup: a file is a hit if bytes equal to its own were stored for a file written
before.  What a file stores without dedup is a narrow expression; the first writer of each stored hash is
one aggregation, and the hit test one join.  Where a hit changes what later files find (bytes that only
a rewritten file would have stored), the test is repeated until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.dedup import sha
from corpusmill.operators.ordering import numbered
from corpusmill.plans import rules as R
from corpusmill.plans.staging import stage


def extension(rel_path: Column) -> Column:
    return F.regexp_extract(F.substring_index(rel_path, "/", -1), r"(?s)(\.[^.]*)$", 1)


def write_order(entries: DataFrame) -> DataFrame:
    """Add ``seq`` (order of the scan, by path components) and ``entry_id`` (order of writing: directories in
    scan order, then everything else by extension, then scan order).  ``entries (rel_path, kind, ...)``."""
    entries = stage(entries, "entries")
    rows = entries.count()
    scanned = numbered(entries, [F.split("rel_path", "/"), F.col("rel_path")], "seq", rows=rows)
    last = F.when(F.col("kind") == "dir", F.lit("")).otherwise(extension(F.col("rel_path")))
    return numbered(scanned, [(F.col("kind") != "dir"), last, F.col("seq")], "entry_id", rows=rows)


def applicability(files: DataFrame, rules: tuple[R.Rule, ...] = R.ALL) -> DataFrame:
    """``(file_id, rule, gain, cost)`` for every rule that applies to a file; content is not read."""
    p, s = F.col("rel_path"), F.col("size")
    each = F.array(*[F.when(r.applicable(p, s), F.struct(F.lit(r.id).alias("rule"), r.gain(s).cast("long").alias("gain"), r.cost(s).cast("long").alias("cost"))) for r in rules])
    return files.select("file_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("a")).select("file_id", "a.*")


#: What a decision rests on, beside the columns that name a file.
SLIM = ("size", "sha", "own", "own_sha", "own_len", "params", "skip")


def candidates(files: DataFrame, context: R.Context, rules: tuple[R.Rule, ...] = R.DEFAULT, disabled: tuple[str, ...] = ()) -> DataFrame:
    """``files (rel_path, content, size, ...)`` with what each would store were there no other: the rule
    ``own`` (null: none), ``own_sha``, ``own_len`` and ``bytes`` of what it stores, ``params``, and the last
    rule that was skipped for its cost.  A narrow projection; contents are looked at only where a rule
    applies and pays, and bytes that are no valid UTF-8 by none.
    """
    live = [r for r in rules if r.id not in disabled]
    p, s = F.col("rel_path"), F.col("size")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    df, tried = files, []
    for i, r in enumerate(live):
        if r.store is None:
            continue
        df = df.withColumn("__text", F.when(r.applicable(p, s) & (r.gain(s) > r.cost(s)) & valid, F.col("content").cast("string")))
        df = r.store(df, "__text", context, f"__out_{i}", f"__params_{i}")
        tried.append((r.id, F.col(f"__out_{i}"), F.col(f"__params_{i}")))
    df = df.drop("__text")
    raw = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    own = F.coalesce(*[F.when(out.isNotNull(), F.lit(k)) for k, out, _ in tried], F.lit(None).cast("string"))
    params = F.coalesce(*[F.when(out.isNotNull(), F.coalesce(q, F.lit(""))) for _, out, q in tried], F.lit(None).cast("string"))
    of = lambda r: F.struct(F.lit(r.id).alias("id"), r.gain(s).cast("long").alias("gain"), r.cost(s).cast("long").alias("cost"))
    none = F.lit(None).cast("struct<id:string,gain:long,cost:long>")
    skip = F.coalesce(*[F.when(r.applicable(p, s) & (r.gain(s) <= r.cost(s)), of(r)) for r in reversed(live)], none)
    df = df.withColumns({"own": own, "params": F.nullif(params, F.lit("")), "bytes": F.coalesce(*[out.cast("binary") for _, out, _ in tried], raw), "sha": sha(F.col("content")), "skip": skip})
    df = df.withColumns({"own_sha": F.when(F.col("own").isNull(), F.col("sha")).otherwise(sha(F.col("bytes"))), "own_len": F.octet_length("bytes").cast("long")})
    return df.select(*[c for c in files.columns if c != "content"], *[c for c in SLIM if c not in files.columns], "bytes")


def decide(slim: DataFrame, rules: tuple[R.Rule, ...] = R.DEFAULT, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Of staged candidates with an ``entry_id``: ``(file_id, entry_id, sha, stored_sha, transform,
    transform_id, gain, cost, applied, reason, params)``.

    ``transform`` is null for raw storage; gain, cost and reason are those of the applied rule, or of the
    last that was skipped for its cost.  A rule that does not handle a file leaves no trace.
    """
    live = [r for r in rules if r.id not in disabled]
    s = F.col("size")
    done = _dedup_hits(slim) if any(r.id == R.DEDUP.id for r in live) else slim.withColumn("hit", F.lit(False))
    rule = F.when(F.col("hit"), F.lit(R.DEDUP.id)).otherwise(F.col("own"))
    of = lambda r: F.when(F.col("transform") == r.id, F.struct(r.gain(s).cast("long").alias("gain"), r.cost(s).cast("long").alias("cost")))
    chosen = F.coalesce(*[of(r) for r in live], F.lit(None).cast("struct<gain:long,cost:long>"))
    skipped = F.concat(F.lit("gain ("), F.col("skip.gain").cast("string"), F.lit(") <= cpu cost ("), F.col("skip.cost").cast("string"), F.lit("), skipped"))
    done = done.withColumn("transform", rule).withColumn("c", chosen)
    reason = F.when(F.col("transform").isNotNull(), F.concat("transform", F.lit(" selected"))).when(F.col("skip").isNotNull(), skipped).otherwise(F.lit("no applicable transform"))
    return done.select(
        "file_id", "entry_id", "sha", F.when(F.col("hit"), F.col("sha")).otherwise(F.col("own_sha")).alias("stored_sha"), "transform", F.coalesce("transform", "skip.id").alias("transform_id"),
        F.coalesce("c.gain", "skip.gain", F.lit(0)).alias("gain"), F.coalesce("c.cost", "skip.cost", F.lit(0)).alias("cost"), F.col("transform").isNotNull().cast("int").alias("applied"),
        reason.alias("reason"), F.when(~F.col("hit"), F.col("params")).alias("params"),
    )


def plan(files: DataFrame, dictionary: DataFrame, templates: DataFrame, rules: tuple[R.Rule, ...] = R.DEFAULT, disabled: tuple[str, ...] = (), order: DataFrame | None = None) -> DataFrame:
    """Decide for every file, see :func:`decide`.

    ``files (file_id, rel_path, content, size)`` with their ``entry_id``, or with ``order (file_id, entry_id)``
    beside, so that only narrow rows are joined.
    """
    slim = candidates(files, R.Context(dictionary, templates), rules, disabled).drop("bytes")
    if order is not None:
        slim = slim.join(order, "file_id")
    return decide(stage(slim.select("file_id", "entry_id", *SLIM), "plan"), rules, disabled)


def _dedup_hits(slim: DataFrame) -> DataFrame:
    """Add ``hit``: an earlier file stored bytes of this file's hash."""
    writers = slim.groupBy(F.col("own_sha").alias("sha")).agg(F.min("entry_id").alias("first"))
    hit = lambda rows, w: rows.join(w, "sha", "left").withColumn("hit", F.coalesce(F.col("first") < F.col("entry_id"), F.lit(False)) & (F.col("size") > 0)).drop("first")
    done = stage(hit(slim, writers), "hits")
    while True:
        # a hit stores nothing of its own; if what it would have stored is what it has found, that is there already
        if done.where("hit and own_sha <> sha").isEmpty():
            return done
        real = done.where(~F.col("hit")).groupBy(F.col("own_sha").alias("sha")).agg(F.min("entry_id").alias("first"))
        again = stage(hit(done.drop("hit"), real), "hits")
        if again.join(done.select("entry_id", F.col("hit").alias("was")), "entry_id").where("hit <> was").isEmpty():
            return again
        done = again


def summary(log: DataFrame) -> DataFrame:
    """``(transform, applied, skipped, gain)`` a rule; raw decisions under ``raw``."""
    return log.groupBy(F.coalesce("transform_id", F.lit("raw")).alias("transform")).agg(
        F.sum(F.when(F.col("applied") == 1, 1).otherwise(0)).alias("applied"),
        F.sum(F.when(F.col("applied") == 0, 1).otherwise(0)).alias("skipped"),
        F.sum(F.when(F.col("applied") == 1, F.col("gain")).otherwise(0)).alias("gain"),
    )
