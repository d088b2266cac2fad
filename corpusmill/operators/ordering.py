"""Global numbering that never brings more than a counted number of rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.plans.staging import stage


#: Rows that are numbered in one task, by count.
ONE_TASK = 100_000


def numbered(df: DataFrame, by: list[Column], name: str = "seq", total: Column | None = None, total_name: str = "before", rows: int | None = None) -> DataFrame:
    """Add ``name``: 1-based position in the order ``by``, which must be total; and, for ``total``, the
    sum of that column over all rows before.

    Up to :data:`ONE_TASK` rows are numbered by one window.  Otherwise rows are range-partitioned and
    staged with their partition; only a count (and a sum) a partition meets in one place, and rows are
    numbered within partitions.  ``rows``: the number of rows of a staged ``df``, if it is known.
    """
    keys = {f"__k{i}": c for i, c in enumerate(by)}
    if rows is None:
        df = stage(df, "to-number")
        rows = df.count()
    amount, past = F.lit(0) if total is None else total, (Window.unboundedPreceding, -1)
    dealt = df.withColumns(keys)
    if rows <= ONE_TASK:
        whole = Window.orderBy(*keys)
        out = dealt.withColumn(name, F.row_number().over(whole).cast("long"))
        if total is not None:
            out = out.withColumn(total_name, F.coalesce(F.sum(amount).over(whole.rowsBetween(*past)), F.lit(0)))
        return out.drop(*keys)
    # range partitioning sorts ties together, so a row's place depends on its keys alone
    placed = stage(dealt.repartitionByRange(*[F.col(k) for k in keys]).withColumn("__p", F.spark_partition_id()), "numbered")
    sums = placed.groupBy("__p").agg(F.count("*").alias("__n"), F.sum(amount).alias("__s"))
    earlier = Window.orderBy("__p").rowsBetween(*past)
    starts = sums.select("__p", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"), F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__base"))
    own = Window.partitionBy("__p").orderBy(*keys)
    out = placed.join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + F.row_number().over(own))  # one row a partition
    if total is not None:
        out = out.withColumn(total_name, F.col("__base") + F.coalesce(F.sum(amount).over(own.rowsBetween(*past)), F.lit(0)))
    return out.drop("__p", "__start", "__base", *keys)
