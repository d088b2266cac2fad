"""Catalogs on a shared store: Parquet tables, visible once their manifest names them.

Every save writes its tables to a folder of its own; the manifest, which a rename puts in place at once, says
which folder counts and what each table holds.  A save that fails leaves the catalog that was there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.catalog import Catalog

MANIFEST = "_manifest.json"
VERSION = 2


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place, then rename it over what is there."""
    jvm = spark.sparkContext._jvm
    fs, target = _fs(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(draft), fs.makeQualified(target), over)


def _get(spark: SparkSession, path: str) -> str | None:
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def table_sum(df: DataFrame) -> tuple[int, int]:
    """Rows, and the sum of a hash of each: equal for equal tables, in whatever order."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return row["n"], int(row["s"])


def save(catalog: Catalog, path: str) -> None:
    """Write all tables, then the manifest; the folder of the save before goes when the new one counts."""
    spark = catalog.entries.sparkSession
    earlier = _get(spark, f"{path}/{MANIFEST}")
    folder, tables = f"tables-{uuid.uuid4().hex}", {}
    for name in Catalog.TABLES:
        df = getattr(catalog, name)
        if df is not None:
            df.write.parquet(f"{path}/{folder}/{name}")
            tables[name] = table_sum(spark.read.parquet(f"{path}/{folder}/{name}"))
    _put(spark, f"{path}/{MANIFEST}", json.dumps({"version": VERSION, "folder": folder, "tables": tables}))
    if earlier:
        fs, old = _fs(spark, f"{path}/{json.loads(earlier)['folder']}")
        fs.delete(old, True)


def _manifest(spark: SparkSession, path: str) -> dict:
    text = _get(spark, f"{path}/{MANIFEST}")
    if text is None:
        raise ValueError(f"{path}: no catalog")
    manifest = json.loads(text)
    if manifest["version"] != VERSION:
        raise ValueError(f"{path}: catalog version {manifest['version']}, not {VERSION}")
    return manifest


def load(spark: SparkSession, path: str) -> Catalog:
    m = _manifest(spark, path)
    return Catalog(**{n: spark.read.parquet(f"{path}/{m['folder']}/{n}") if n in m["tables"] else None for n in Catalog.TABLES})


def verify(spark: SparkSession, path: str) -> dict[str, str]:
    """What is wrong with a stored catalog, by table: its rows or their contents differ from what was saved."""
    m, wrong = _manifest(spark, path), {}
    for name, (rows, total) in m["tables"].items():
        try:
            got = table_sum(spark.read.parquet(f"{path}/{m['folder']}/{name}"))
        except Exception as e:  # a table that cannot be read is what this looks for
            wrong[name] = f"cannot be read: {str(e).splitlines()[0][:200]}"
            continue
        if got != (rows, total):
            wrong[name] = f"{got[0]} rows, {rows} saved" if got[0] != rows else "contents differ"
    return wrong
