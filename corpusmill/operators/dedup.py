"""Content hashing, cheap prefilters and exact deduplication.

Files are rows ``(file_id, rel_path, content, size)``; null content is empty content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEAD = 4096


def raw(content: Column) -> Column:
    return F.coalesce(content.cast("binary"), F.lit(b""))


def sha(content: Column) -> Column:
    return F.sha2(raw(content), 256)


def entry_hash(kind: Column, size: Column, content: Column) -> Column:
    """Hash of a file with bytes; all zeros for an empty file, a directory or a link, which are not hashed."""
    return F.when((kind == "file") & (size > 0), sha(content)).otherwise(F.lit("0" * 64))


def quick_signature(content: Column) -> Column:
    """32 hex digits of a hash of all bytes, or of the first and last 4096 above 8192 bytes; size is not mixed in."""
    c = raw(content)
    ends = F.concat(F.substring(c, 1, HEAD), F.substring(c, -HEAD, HEAD))
    return F.substring(F.sha2(F.when(F.octet_length(c) <= 2 * HEAD, c).otherwise(ends), 256), 1, 32)


def with_hash(files: DataFrame, name: str = "sha") -> DataFrame:
    return files.withColumn(name, sha(F.col("content")))


def unique_blobs(hashed: DataFrame) -> DataFrame:
    """One row a content: ``sha``, ``first_id``, ``copies``, ``size``; partial aggregation absorbs hot contents."""
    return hashed.groupBy("sha").agg(F.min("file_id").alias("first_id"), F.count("*").alias("copies"), F.max("size").alias("size"))


def duplicates(hashed: DataFrame) -> DataFrame:
    """Every row that is not its content's first, with the first's id."""
    firsts = unique_blobs(hashed).where("copies > 1").select("sha", "first_id")
    return hashed.select("file_id", "sha").join(firsts, "sha").where("file_id <> first_id").select("file_id", "first_id", "sha")


def dedup_summary(hashed: DataFrame) -> DataFrame:
    return unique_blobs(hashed).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("entries"),
        F.count("*").alias("blobs"),
        F.coalesce(F.sum(F.col("copies") * F.col("size")), F.lit(0)).alias("original_bytes"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"),
    )


def multipass_duplicates(files: DataFrame) -> DataFrame:
    """Rows with a copy, by size, then quick signature, then full hash: content is hashed in full only
    where the cheaper keys collide.  ``(file_id, sha)``."""
    sizes = files.groupBy("size").count().where("count > 1").select("size")
    some = files.join(sizes, "size", "left_semi").withColumn("sig", quick_signature(F.col("content")))
    sigs = some.groupBy("size", "sig").count().where("count > 1").select("size", "sig")
    full = some.join(sigs, ["size", "sig"], "left_semi").select("file_id", sha(F.col("content")).alias("sha"))
    shas = full.groupBy("sha").count().where("count > 1").select("sha")
    return full.join(shas, "sha", "left_semi").select("file_id", "sha")


def rank_in_content(hashed: DataFrame) -> DataFrame:
    """``(file_id, sha, nth)`` with the number of each row among its copies."""
    return hashed.select("file_id", "sha", F.row_number().over(Window.partitionBy("sha").orderBy("file_id")).alias("nth"))
