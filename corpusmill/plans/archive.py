"""From files to a catalog with packed blocks, and back."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill import functions as fn
from corpusmill.operators import catalog, solid
from corpusmill.plans import planner
from corpusmill.plans import rules as R
from corpusmill.plans.staging import small_batches, stage


def build(
    files: DataFrame,
    dictionary: DataFrame | None = None,
    known: DataFrame | None = None,
    rules: tuple[R.Rule, ...] = R.DEFAULT,
    disabled: tuple[str, ...] = (),
    block_bytes: int = solid.DEFAULT_BLOCK,
    level: int = 3,
    keep_log: bool = True,
    compressor: str = "zstd",
    train: str | None = None,
) -> catalog.Catalog:
    """Catalog of ``files (rel_path, content, size)``, with ``kind`` (else all are files), ``file_id`` (else
    the entry's number) and the metadata of a scanned tree where given.  Missing directories are added.

    ``block_bytes`` 0: every blob is stored on its own, by ``compressor`` (``zstd`` or ``none``) and, with
    ``train``, with a dictionary of a bounded sample of the files (``prescan``) or of the first blobs
    (``simple``; later blobs use it).
    """
    spark = files.sparkSession
    context = R.context(spark, dictionary, known)
    if "kind" not in files.columns:
        files = files.withColumn("kind", F.lit("file"))
    every = planner.write_order(catalog.with_directories(files.drop("content", "path")))
    if "file_id" not in files.columns:
        every = every.withColumn("file_id", F.when(F.col("kind") == "file", F.col("entry_id")))
    every = stage(every, "order")
    own = files.where("kind = 'file'").select("rel_path", "size", "content")
    # contents are worked on once, where they are read; what is decided and numbered are narrow rows
    kept = stage(planner.candidates(own, context, rules, disabled), "candidates")
    slim = kept.drop("bytes").join(every.where("kind = 'file'").select("rel_path", "entry_id", "file_id"), "rel_path")
    log = planner.decide(slim, rules, disabled)  # a projection of a staged table
    sizes = slim.groupBy(F.col("own_sha").alias("sha")).agg(F.max("own_len").alias("ulen"))
    blobs = stage(catalog.blob_table(log, sizes), "blobs")
    # a blob's bytes are those of the file that first stored it
    holders = blobs.join(every.select(F.col("entry_id").alias("first_entry"), "rel_path"), "first_entry").select("rel_path", "blob_id")
    contents_of = lambda rows: kept.select("rel_path", "bytes").join(rows, "rel_path").drop("rel_path")
    meta = [("version", "1"), ("transforms", ",".join(r.id for r in rules))]
    if block_bytes:
        packed = stage(solid.pack(blobs, block_bytes), "packed")
        with small_batches(spark):
            blocks = stage(solid.blocks(contents_of(holders.join(packed, "blob_id")), level=level), "blocks")
        # a block's length is on every row of it; a trailing run of empty blobs may have no block
        full = blobs.join(packed.select("blob_id", "block_id", "block_offset"), "blob_id").join(blocks.select("block_id", "clen"), "block_id", "left").withColumn("compressed", F.lit(solid.SOLID))
    else:
        payload, after, trained = contents_of(holders), 0, None
        if train == "prescan":
            ordered = own.join(every.where("kind = 'file'").select("rel_path", "entry_id"), "rel_path")
            trained = solid.train_dictionary(ordered.select(F.col("entry_id").alias("file_id"), "size", "content"))
        elif train == "simple":
            small = payload.select(F.col("blob_id").alias("file_id"), F.octet_length("bytes").cast("long").alias("size"), F.col("bytes").alias("content"))
            sample = stage(solid.online_samples(small), "samples")
            trained, after = solid.train_dictionary(small, sample), sample.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
        if trained:
            meta.append(("dict", base64.b64encode(trained).decode()))
        with small_batches(spark, 256):
            singles = stage(solid.single(payload, compressor, level, trained, after), "blocks")
        blocks = singles.drop("compressed")
        full = blobs.join(singles.select("blob_id", "block_id", "clen", "compressed"), "blob_id").withColumn("block_offset", F.lit(None).cast("long"))
    named = catalog.names(every)
    entries = catalog.tree_entries(every, named).join(log.select(F.col("entry_id").alias("id"), "transform", "params"), "id", "left")
    links = catalog.entry_blobs(log, blobs)
    return catalog.Catalog(fn.literal_table(spark, meta, "key string, value string"), named, entries, full, links, log.drop("params") if keep_log else None, blocks)


def check_transforms(entries: DataFrame, rules: tuple[R.Rule, ...] = R.ALL) -> DataFrame:
    """Rule ids in use that this registry does not know."""
    return used_transforms(entries).where(~F.col("transform").isin([r.id for r in rules]))


def used_transforms(entries: DataFrame) -> DataFrame:
    return entries.where("transform is not null").select("transform").distinct()


def restore(c: catalog.Catalog, dictionary: DataFrame | None = None, rules: tuple[R.Rule, ...] = R.ALL, known: DataFrame | None = None) -> DataFrame:
    """``(id, rel_path, kind, content)`` and the entries' metadata; an unknown rule id is an error before any output."""
    context = R.context(c.entries.sparkSession, dictionary, known)
    used = {r["transform"] for r in used_transforms(c.entries).limit(len(rules) + 1).collect()}
    if unknown := sorted(used - {r.id for r in rules}):
        raise ValueError(f"unknown transforms: {unknown}")
    trained = [base64.b64decode(r["value"]) for r in c.meta.where("key = 'dict'").collect()]
    data = solid.unpack(c.blobs, c.blocks, trained[0] if trained else None)
    meta = [m for m in catalog.META if m in c.entries.columns]
    # narrow rows are joined first, contents once
    paths = catalog.paths(c.entries, c.names).withColumnRenamed("path", "rel_path")
    whole = c.entries.select("id", "kind", "transform", "params", *meta).join(paths, "id").join(c.entry_blobs.where("seq = 0").select(F.col("entry_id").alias("id"), "blob_id"), "id", "left")
    whole = whole.join(data, "blob_id", "left").withColumn("__stored", F.col("bytes").cast("string")).drop("bytes")
    content = F.col("__stored")
    for i, r in enumerate(rules):
        if r.restore is None or r.id not in used:
            continue
        mine = F.col("transform") == r.id
        whole = whole.withColumns({"__own": F.when(mine, F.col("__stored")), "__params": F.when(mine, F.col("params"))})
        whole = r.restore(whole, "__own", "__params", context, f"__back_{i}")
        content = F.when(mine, F.col(f"__back_{i}")).otherwise(content)
    return whole.select("id", "rel_path", "kind", F.when(F.col("kind") == "file", content).alias("content"), *meta)
