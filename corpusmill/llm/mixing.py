"""Mixing sources to target weights by systematic sampling.

Targets: sources share ``share`` times all words by weight; a target stops at ``most`` times its
source's words, and the excess goes to the others by weight until none is above its stop.  The fixed
point has a closed form: with sources sorted by stop / weight, the first ones are stopped and the rest
share what is left by weight.

Sampling: every document of a source is expected ``target / source words`` times.  Expected copies
are summed in order of the documents' sizes, one random offset a source is added, and a document is
emitted once for each integer its interval crosses: never more than ``ceil(most)`` times.  Neighbours
in the order have like sizes, so the words taken stay close to the target; of ``draws`` random offsets
a source keeps the one that comes nearest.

The prefix sums need no ordered pass over a source: documents are counted by size class and by a slice
of a hash within it, the few counts are cumulated, and positions are numbered within slices of
bounded size.  Everything random is an MD5 of ids and texts, so reruns agree, and SQL can say the same.

Nulls: a null text has size 0, a null source is a source of its own, after the others; a source
without words takes nothing.  Repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.plans.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
SLICE = 1000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _number(text: Column, digits: int) -> Column:
    """The first hex digits of an MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def _marked(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def row_key(id_: Column, source: Column, text: Column) -> Column:
    """Stands for the rows of one id, source and text: 60 bits."""
    return _number(F.concat(_marked(id_), F.lit("\x1f"), _marked(source), F.lit("\x1f"), _marked(text)), 15)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row a source.

    Weights repeat over the sources by code point, null last.  The windows here are over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    stop = F.lit(float(most)) * F.col("source_size")
    everything = Window.partitionBy(F.lit(1))
    base = sizes.withColumn("w", w).withColumn("stop", stop).withColumn("ratio", F.col("stop") / F.col("w"))
    base = base.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    base = base.withColumn("level", level)
    # the first source that its level does not stop sets the level of all that follow
    base = base.withColumn("open", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything))
    target = F.when(F.col("open").isNull() | (F.col("ratio") < F.col("open.ratio")), F.col("stop")).otherwise(F.least("stop", F.col("open.level") * F.col("w")))
    return base.select("source", "source_size", target.alias("target"))


def size_class(size: Column) -> Column:
    """Like sizes: exact to 8, then eight classes for each doubling."""
    power = F.length(F.bin(size)) - 1
    return F.when(size < 8, size).otherwise(power * 8 + F.floor(size / F.pow(F.lit(2.0), power - 3)) % 8).cast("int")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    draws: int = 16,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, rk, size, source, source_size, target, copies)``, a row for each row of ``docs``.

    ``rk`` is the :func:`row_key`, by which :func:`emit` finds the rows again.
    """
    id_ = F.col(id_col).cast("long")
    own = docs.select(id_.alias("doc_id"), row_key(id_, F.col(source_col), F.col(text_col)).alias("rk"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    own = stage(own.withColumn("class", size_class(F.col("size"))), "mix-sizes")
    classes = stage(own.groupBy("source", "class").agg(F.count("*").alias("docs"), F.sum("size").alias("words")), "mix-classes")
    goal = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    slices = F.ceil(F.col("docs") / SLICE)
    spread = own.join(classes.select("source", "class", slices.alias("slices")).withColumnsRenamed({"source": "s2", "class": "c2"}), F.col("source").eqNullSafe(F.col("s2")) & (F.col("class") == F.col("c2")))
    spread = spread.withColumn("slice", F.col("rk") % F.col("slices")).select("doc_id", "rk", "source", "size", "class", "slice")
    counts = stage(spread.groupBy("source", "class", "slice").agg(F.count("*").alias("n")), "mix-slices")
    earlier = Window.partitionBy("source").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    starts = starts.join(goal.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    within = Window.partitionBy("source", "class", "slice").orderBy("size", "rk")
    placed = spread.withColumn("i", F.row_number().over(within) - 1)
    placed = placed.join(starts.withColumnsRenamed({"source": "s2", "class": "c2", "slice": "l2"}), F.col("source").eqNullSafe(F.col("s2")) & (F.col("class") == F.col("c2")) & (F.col("slice") == F.col("l2")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = placed.select("doc_id", "rk", "size", "source", "source_size", "target", rate.alias("rate"), (F.col("start") + F.col("i")).alias("at"))
    placed = stage(placed, "mix-placed")
    named = lambda k: F.concat_ws(":", _marked(F.col("source")), F.lit(str(seed)), k.cast("string") if isinstance(k, Column) else F.lit(str(k)))
    offset = lambda k: _number(named(k), 7) / F.lit(float(1 << 28))
    crossed = lambda o: F.floor(o + F.col("rate") * (F.col("at") + 1)) - F.floor(o + F.col("rate") * F.col("at"))
    # of a few random offsets, each source keeps the one whose words come nearest to the target
    tried = placed.groupBy("source").agg(*[F.sum(crossed(offset(k)) * F.col("size")).alias(f"w{k}") for k in range(draws)], F.first("target").alias("t"))
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{k}") - F.col("t")).alias("d"), F.lit(k).alias("k")) for k in range(draws)]))
    chosen = tried.select(F.col("source").alias("s2"), nearest.getField("k").alias("draw"))
    drawn = placed.join(chosen, F.col("source").eqNullSafe(F.col("s2")))
    return drawn.select("doc_id", "rk", "size", "source", "source_size", "target", crossed(offset(F.col("draw"))).alias("copies"))


def emit(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; equal rows share their copies out."""
    rk = row_key(F.col(id_col).cast("long"), F.col(source_col), F.col(text_col))
    # a count of copies for each distinct row, and one of the rows that stands for it
    copies = mixed.groupBy("rk").agg(F.sum("copies").alias("__copies"))
    one = docs.withColumn("__rk", rk).join(copies.where("__copies > 0").withColumnRenamed("rk", "__rk"), "__rk")
    one = one.withColumn("__same", F.count("*").over(Window.partitionBy("__rk"))).withColumn("__nth", F.row_number().over(Window.partitionBy("__rk").orderBy(F.lit(1))))
    each = F.floor(F.col("__copies") / F.col("__same")) + F.when(F.col("__nth") <= F.col("__copies") % F.col("__same"), 1).otherwise(0)
    some = one.withColumn("__each", each).where("__each > 0")
    return some.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__each").cast("int")))).drop("__rk", "__copies", "__same", "__nth", "__each", "__copy")


_ROWS = r"""
WITH m AS (SELECT *, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
    CAST('0x' || substr(md5(coalesce('v' || doc_id, 'n') || chr(31) || coalesce('v' || source, 'n') || chr(31) || coalesce('v' || text, 'n')), 1, 15) AS BIGINT) AS rk FROM documents),
o AS (SELECT doc_id, source, CAST(size AS BIGINT) AS size, rk, CASE WHEN size < 8 THEN size ELSE (length(bin(size)) - 1) * 8 + ((size >> CAST(length(bin(size)) - 4 AS INTEGER)) & 7) END AS class FROM m),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM o GROUP BY 1),
a AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w, 2.0::DOUBLE * source_size AS stop, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM sizes),
b AS (SELECT *, stop / w AS ratio FROM a),
c AS (SELECT *, (total - coalesce(sum(stop) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b),
f AS (SELECT min(ratio) AS ratio, arg_min(level, ratio) AS level FROM c WHERE ratio > level),
goal AS (SELECT source, source_size, CASE WHEN f.ratio IS NULL OR c.ratio < f.ratio THEN stop ELSE least(stop, f.level * w) END AS target FROM c LEFT JOIN f ON true)"""
ORACLE = (
    _ROWS
    + f""",
n AS (SELECT *, count(*) OVER (PARTITION BY source, class) AS docs FROM o),
l AS (SELECT *, rk % CAST(ceil(docs / {SLICE}.0) AS BIGINT) AS slice FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, slice, size, rk) - 1 AS at_ FROM l),
r AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM p JOIN goal ON p.source IS NOT DISTINCT FROM goal.source),
k AS (SELECT source, d AS draw, CAST('0x' || substr(md5(coalesce('v' || source, 'n') || ':42:' || d), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS off FROM sizes, range(16) AS t(d)),
x AS (SELECT k.source, draw, off, abs(sum((floor(off + rate * (at_ + 1)) - floor(off + rate * at_)) * size) - any_value(target)) AS miss FROM r JOIN k ON r.source IS NOT DISTINCT FROM k.source GROUP BY 1, 2, 3),
best AS (SELECT source, off FROM x QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, draw) = 1)
SELECT doc_id, size, source_size, target, CAST((floor(off + rate * (at_ + 1)) - floor(off + rate * at_)) * size AS BIGINT) AS taken FROM r JOIN best ON r.source IS NOT DISTINCT FROM best.source"""
)
