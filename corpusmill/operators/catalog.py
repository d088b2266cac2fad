"""The relational catalog: names, entries, paths, blobs, links and what can be asked of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ordering import numbered
from corpusmill.plans.staging import stage


@dataclass
class Catalog:
    """Tables of one archive; ``blocks`` holds the compressed payloads."""

    meta: DataFrame
    names: DataFrame
    entries: DataFrame
    blobs: DataFrame
    entry_blobs: DataFrame
    plan_log: DataFrame | None
    blocks: DataFrame

    TABLES = ("meta", "names", "entries", "blobs", "entry_blobs", "plan_log", "blocks")


#: What entries of a scanned tree have besides.
META = ("mode", "mtime_ns", "uid", "gid", "link_target")


def parent_path(rel_path: Column) -> Column:
    """Null for a root."""
    parts = F.split(rel_path, "/", -1)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))


def base_name(rel_path: Column) -> Column:
    return F.substring_index(rel_path, "/", -1)


def with_directories(entries: DataFrame) -> DataFrame:
    """``entries (rel_path, size, ...)`` with a row for each directory above one that is not a row itself.

    Without a ``kind``, every row is a file.  Other columns are null for added directories.
    """
    own = entries if "kind" in entries.columns else entries.select("rel_path", F.lit("file").alias("kind"), "file_id", "size")
    parts = F.split("rel_path", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dirs = entries.where(F.size(parts) > 1).select(F.explode(F.array_distinct(above)).alias("rel_path")).distinct()
    if "kind" in entries.columns:
        dirs = dirs.join(entries.where("kind = 'dir'").select("rel_path"), "rel_path", "left_anti")
    return own.unionByName(dirs.select("rel_path", F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("size")), allowMissingColumns=True)


def names(entries: DataFrame) -> DataFrame:
    """``(id, name)``: distinct base names, numbered by name."""
    return numbered(entries.select(base_name(F.col("rel_path")).alias("name")).distinct(), [F.col("name")], "id").select("id", "name")


def tree_entries(ordered: DataFrame, named: DataFrame) -> DataFrame:
    """``(id, parent_id, name_id, kind, size, file_id)`` and :data:`META` where ``ordered`` has them; an unknown or
    missing parent is null."""
    keyed = ordered.withColumns({"parent": parent_path(F.col("rel_path")), "name": base_name(F.col("rel_path"))})
    parents = ordered.where("kind = 'dir'").select(F.col("rel_path").alias("parent"), F.col("entry_id").alias("parent_id"))
    joined = keyed.join(parents, "parent", "left").join(named.withColumnRenamed("id", "name_id"), "name")
    return joined.select(F.col("entry_id").alias("id"), "parent_id", "name_id", "kind", "size", "file_id", *[c for c in META if c in ordered.columns])


def paths(entries: DataFrame, named: DataFrame) -> DataFrame:
    """``(id, path)`` rebuilt from parents and names; an unknown parent counts as a root.

    Directories find their paths by pointer doubling: each round joins the part of a path that is known to
    the part of the directory where it ends, so rounds grow with the logarithm of the depth.  All others
    take their directory's path and are joined once.  Entries below themselves have no path.
    """
    nodes = stage(entries.join(named.withColumnRenamed("id", "name_id"), "name_id").select("id", "parent_id", "name", "kind"), "nodes")
    dirs = nodes.where("kind = 'dir'").select("id", "parent_id", "name")
    known = dirs.select(F.col("id").alias("parent_id"), F.col("id").alias("up"))
    parts = dirs.join(known, "parent_id", "left").select("id", "up", F.col("name").alias("path"))
    # below the root itself, which is named ".", paths begin anew
    joined = lambda above, end, own: F.when(end.isNull() & (above == "."), own).otherwise(F.concat_ws("/", above, own))
    left = before = None
    while left is None or (left and left != before):  # if a round ends none, only loops are left
        upper = parts.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        both = parts.join(upper, "up", "left")
        open_ = F.col("up").isNotNull()
        parts = stage(both.select("id", F.when(open_, F.col("next")).alias("up"), F.when(open_, joined(F.col("above"), F.col("next"), F.col("path"))).otherwise(F.col("path")).alias("path")), "dir-paths")
        left, before = parts.where("up is not null").count(), left
    above = parts.select(F.col("id").alias("parent_id"), F.col("up").alias("end"), F.col("path").alias("above"))
    rest = nodes.where("kind <> 'dir'").join(above, "parent_id", "left").where("end is null")
    own = F.when(F.col("above").isNull(), F.col("name")).otherwise(joined(F.col("above"), F.col("end"), F.col("name")))
    return parts.where("up is null").select("id", "path").unionByName(rest.select("id", own.alias("path")))


def blob_table(log: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(blob_id, sha, ulen, first_entry)``: stored contents numbered by their first writer."""
    first = log.groupBy(F.col("stored_sha").alias("sha")).agg(F.min("entry_id").alias("first_entry"))
    return numbered(first.join(sizes, "sha"), [F.col("first_entry")], "blob_id").select("blob_id", "sha", "ulen", "first_entry")


def entry_blobs(log: DataFrame, blobs: DataFrame) -> DataFrame:
    """``(entry_id, seq, blob_id)``; here every entry has one blob, at position 0."""
    return log.join(blobs.select(F.col("sha").alias("stored_sha"), "blob_id"), "stored_sha").select("entry_id", F.lit(0).alias("seq"), "blob_id")


def dir_sizes(files: DataFrame) -> DataFrame:
    """``(dir, files, bytes)`` below each directory, at any depth."""
    parts = F.split("rel_path", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.where(F.size(parts) > 1).select(F.explode(above).alias("dir"), "size").groupBy("dir").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def overview(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Counts and sums; a block's compressed length counts once.  Works without block columns, as in older tables."""
    e = entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("original_bytes"))
    if "block_id" not in blobs.columns:
        b = blobs.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("ulen"), F.lit(0)).alias("unique_bytes"), F.coalesce(F.sum("clen"), F.lit(0)).alias("stored_bytes"), F.lit(0).cast("long").alias("blocks"))
    else:  # a row a block, then one row
        by = blobs.groupBy("block_id").agg(F.count("*").alias("n"), F.sum("ulen").alias("u"), F.sum("clen").alias("c"), F.max("clen").alias("m"))
        b = by.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("blobs"),
            F.coalesce(F.sum("u"), F.lit(0)).alias("unique_bytes"),
            F.coalesce(F.sum(F.when(F.col("block_id").isNull(), F.col("c")).otherwise(F.col("m"))), F.lit(0)).alias("stored_bytes"),
            F.count("block_id").alias("blocks"),
        )
    both = e.unionByName(b, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("entries", "original_bytes", "blobs", "unique_bytes", "stored_bytes", "blocks")])


def ratios(view: DataFrame) -> DataFrame:
    """Percentages of an overview; 0 where the whole is 0."""
    pct = lambda part, whole: F.when(F.col(whole) == 0, 0.0).otherwise(F.lit(100.0) * F.col(part) / F.col(whole))
    return view.withColumns({"unique_pct": pct("unique_bytes", "original_bytes"), "stored_pct": pct("stored_bytes", "original_bytes"), "block_pct": pct("stored_bytes", "unique_bytes")})
