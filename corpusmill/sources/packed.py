"""Packed archives: one file (blob chunks, a compressed SQLite catalog, a footer), or for reading also an
SQLite file with a ``.blobs`` file beside it.

Neither payloads nor rows of the catalog pass the driver.  Lengths give every chunk its place, and executors write
chunks there; one task fills the SQLite file, a table at a time.  For reading, the catalog is copied from any store
to the shared folder, where executors read ranges of its rows; payloads are read range by range.  The file and the
shared folder are on mounts that driver and executors share.

The footer's checksum is the first 8 bytes of the SHA-256 of all bytes before the footer; archives made
elsewhere may hold another, so reading checks it only if asked to.
"""

from __future__ import annotations

import hashlib
import json
import os
import sqlite3
import struct
import urllib.parse
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.catalog import Catalog
from corpusmill.operators.ordering import numbered
from corpusmill.plans.staging import local_dir, ship_package, small_batches, stage

# Fixed values of the format.
FOOTER, CHUNK_HEADER = ">QQ8s", ">BI"
BLOB_CHUNK, CATALOG_CHUNK, SOLID_CHUNK = 1, 2, 3
MOST_CHUNK = (1 << 32) - 1
LINK_BIT = 1 << 27
LEAST_BYTES = 32
#: Of a catalog, decompressed; it goes to a file, so this guards the disk.  Other readers may stop at 512 MB.
MOST_CATALOG = 16 << 30
#: Rows of the catalog that a task reads.
RANGE_ROWS = 50_000
#: Blocks whose places are broadcast.
SIDE_ROWS = 2_000_000
PIECE = 8 << 20
#: Of the file with the payloads, about, that a task reads.
PART_BYTES = 16 << 20
SQLITE = b"SQLite format 3\x00"
DIR_BIT = 1 << 31
META = "key string, value string"
NAMES = "id long, name string"
ENTRIES = "id long, parent_id long, name_id long, mode long, mtime_ns long, size long, uid long, gid long, transform string, params string, link_target string"
BLOBS = "blob_id long, sha string, offset long, clen long, ulen long, compressed int, block_id long, block_offset long"
LINKS = "entry_id long, seq int, blob_id long"
#: Tables of the catalog inside.
DDL = """CREATE TABLE meta (key TEXT PRIMARY KEY, value TEXT);
CREATE TABLE names (id INTEGER PRIMARY KEY, name TEXT NOT NULL UNIQUE);
CREATE TABLE entries (id INTEGER PRIMARY KEY, parent_id INTEGER, name_id INTEGER, mode INTEGER, mtime_ns INTEGER, size INTEGER, uid INTEGER, gid INTEGER, transform TEXT, params BLOB, symlink_target TEXT);
CREATE TABLE blobs (id INTEGER PRIMARY KEY, sha BLOB UNIQUE, offset INTEGER, clen INTEGER, ulen INTEGER, compressed INTEGER, block_id INTEGER, block_offset INTEGER);
CREATE TABLE entry_blobs (entry_id INTEGER, seq INTEGER, blob_id INTEGER, PRIMARY KEY (entry_id, seq));
CREATE TABLE plan_log (entry_id INTEGER, transform_id TEXT, estimated_gain INTEGER, estimated_cpu INTEGER, applied INTEGER, reason TEXT);"""
TABLES = ("meta", "names", "entries", "blobs", "entry_blobs", "plan_log")
LOG = "entry_id long, transform_id string, gain long, cost long, applied int, reason string"


def _read(spark: SparkSession, path: str, at: int, n: int) -> bytes:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        stream.seek(at)
        return bytes(jvm.org.apache.commons.io.IOUtils.readFully(stream, n))
    finally:
        stream.close()


def _length(spark: SparkSession, path: str) -> int:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).getLen()


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else os.path.abspath(path)


def write_packed(catalog: Catalog, path: str, magic: bytes) -> None:
    """Write one file, in place of what is there once it is whole; ``path`` is on a mount of driver and executors.

    Chunks lie in the order of their ids, those of single blobs first."""
    if len(magic) != 8:
        raise ValueError("the leading bytes are eight")
    spark = catalog.entries.sparkSession
    ship_package(spark)
    path = _local(path)
    draft, inner = f"{path}.part", f"{path}.catalog"
    lengths = stage(catalog.blocks.select("block_id", "blob_id", F.octet_length("payload").cast("long").alias("n")), "lengths")
    total = lengths.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if total["most"] > MOST_CHUNK:
        raise ValueError("a chunk holds 4 GB at most")
    ahead = struct.calcsize(CHUNK_HEADER)
    placed = numbered(lengths, [F.col("block_id"), F.col("blob_id")], "seq", F.col("n") + ahead, "offset", rows=total["rows"])
    places = stage(placed.select("block_id", "blob_id", (F.col("offset") + len(magic)).alias("offset")), "places")
    end = len(magic) + total["n"] + ahead * total["rows"]
    try:
        with open(draft, "wb") as f:
            f.write(magic)
        _put_chunks(catalog.blocks, places, total["rows"], draft)
        if os.path.getsize(draft) != end:
            raise ValueError(f"{draft}: its chunks do not end where they should; do executors share this folder?")
        _fill(inner, catalog, places)
        size = os.path.getsize(inner)
        if size > MOST_CATALOG:
            raise ValueError(f"the catalog has more than {MOST_CATALOG} bytes")
        with open(draft, "r+b") as f:
            with open(inner, "rb") as db:
                f.seek(end + ahead)
                zstandard.ZstdCompressor(level=9).copy_stream(db, f, size=size)
            length = f.tell() - end - ahead
            if length > MOST_CHUNK:
                raise ValueError("a chunk holds 4 GB at most")
            f.seek(end)
            f.write(struct.pack(CHUNK_HEADER, CATALOG_CHUNK, length))
            f.seek(0)
            sums = hashlib.sha256()
            while piece := f.read(PIECE):
                sums.update(piece)
            f.write(struct.pack(FOOTER, end, len(magic), sums.digest()[:8]))
        os.replace(draft, path)
    finally:
        for left in (draft, inner):
            if os.path.exists(left):
                os.remove(left)


def _put_chunks(blocks: DataFrame, places: DataFrame, rows: int, draft: str) -> None:
    """Every chunk at its place; one that is written twice is the same."""
    side = places.select(F.col("block_id").alias("__block"), F.col("blob_id").alias("__blob"), "offset")
    side = F.broadcast(side) if rows <= SIDE_ROWS else side.hint("merge")
    same = F.col("block_id").eqNullSafe(F.col("__block")) & F.col("blob_id").eqNullSafe(F.col("__blob"))

    def put(rows) -> None:
        with open(draft, "r+b") as f:
            for r in rows:
                f.seek(r.offset)
                f.write(struct.pack(CHUNK_HEADER, BLOB_CHUNK if r.block_id is None else SOLID_CHUNK, len(r.payload)))
                f.write(r.payload)

    blocks.join(side, same).select("block_id", "offset", "payload").foreachPartition(put)


def _fill(inner: str, c: Catalog, places: DataFrame) -> None:
    if os.path.exists(inner):
        os.remove(inner)
    db = sqlite3.connect(inner)
    db.executescript(DDL)
    db.close()

    def rows(table: DataFrame, into: str, order: str) -> None:
        """One task inserts the table in one transaction, so a task that is run again finds it empty."""
        marks = ", ".join("?" * len(table.columns))

        def put(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            db, n = sqlite3.connect(inner, timeout=600), 0
            db.execute("PRAGMA synchronous = OFF")
            db.execute("PRAGMA cache_size = -65536")
            with db:
                db.execute(f"DELETE FROM {into}")
                for batch in it:
                    db.executemany(f"INSERT INTO {into} VALUES ({marks})", zip(*(x.to_pylist() for x in batch.columns), strict=True))
                    n += batch.num_rows
            db.close()
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        with small_batches(table.sparkSession):
            table.toDF(*[f"c{i}" for i in range(len(table.columns))]).repartition(1).sortWithinPartitions(order).mapInArrow(put, "n long").collect()

    def given(name: str, kind: str = "long") -> Column:
        return F.col(name) if name in c.entries.columns else F.lit(None).cast(kind)

    bits = F.when(F.col("kind") == "dir", F.lit(DIR_BIT)).when(F.col("kind") == "link", F.lit(LINK_BIT)).otherwise(F.lit(0))
    mode = F.coalesce(given("mode"), F.when(F.col("kind") == "dir", 0o755).otherwise(0o644)).bitwiseAND(F.lit(0o7777)).bitwiseOR(bits.cast("long"))
    zero = lambda n: F.coalesce(given(n), F.lit(0))
    rows(c.meta.select("key", "value"), "meta", "c0")
    rows(c.names.select("id", "name"), "names", "c0")
    rows(c.entries.select("id", "parent_id", "name_id", mode, zero("mtime_ns"), F.coalesce("size", F.lit(0)), zero("uid"), zero("gid"), "transform", F.col("params").cast("binary"), given("link_target", "string")), "entries", "c0")
    # a blob lies in its block's chunk, or in its own
    solid = F.col("compressed") == 3
    whole = places.where("block_id is not null").select(F.col("block_id").alias("__block"), F.col("offset").alias("__of_block"))
    alone = places.where("block_id is null").select(F.col("blob_id").alias("__blob"), F.col("offset").alias("__of_blob"))
    blobs = c.blobs.join(whole, F.col("block_id") == F.col("__block"), "left").join(alone, F.col("blob_id") == F.col("__blob"), "left")
    offset = F.coalesce(F.when(solid, F.col("__of_block")).otherwise(F.col("__of_blob")), F.lit(-1))
    rows(blobs.select("blob_id", F.unhex("sha"), offset, F.coalesce("clen", F.lit(0)), "ulen", "compressed", "block_id", "block_offset"), "blobs", "c0")
    rows(c.entry_blobs.select("entry_id", "seq", "blob_id"), "entry_blobs", "c0")
    if c.plan_log is not None:
        rows(c.plan_log.select("entry_id", "transform_id", "gain", "cost", "applied", "reason"), "plan_log", "c0")


def _stream(spark: SparkSession, path: str, at: int, n: int, out) -> None:
    """Bytes of a file of any store into a stream, both on the JVM's side."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        stream.seek(at)
        if jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, n) != n:
            raise ValueError(f"{path}: ends early")
    finally:
        stream.close()


def verify(spark: SparkSession, path: str) -> None:
    """A ``ValueError`` if a one-file archive does not have the checksum of its footer."""
    size = _length(spark, path)
    if size < LEAST_BYTES:
        raise ValueError(f"{path}: too small for an archive")
    jvm = spark.sparkContext._jvm
    sums = jvm.java.security.MessageDigest.getInstance("SHA-256")
    _stream(spark, path, 0, size - 24, jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), sums))
    if struct.unpack(FOOTER, _read(spark, path, size - 24, 24))[2] != bytes(sums.digest())[:8]:
        raise ValueError(f"{path}: its bytes do not have the checksum in its footer")


def layout(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of a one-file archive: whole, blob region, catalog chunk, overhead."""
    size = _length(spark, path)
    if size < LEAST_BYTES:
        raise ValueError(f"{path}: too small for an archive")
    catalog_at, blobs_at, _ = struct.unpack(FOOTER, _read(spark, path, size - 24, 24))
    return {"bytes": size, "blob_region": catalog_at - blobs_at, "catalog": size - catalog_at - 24, "overhead": 32}


def _database(spark: SparkSession, path: str, magic: bytes | None) -> tuple[str, dict[str, dict], str, int]:
    """The catalog as an SQLite file in the shared folder, its tables' columns and row ids, the file that holds the
    payloads, and the bytes before each payload."""
    size = _length(spark, path)
    head = _read(spark, path, 0, min(size, 16))
    split = head == SQLITE
    if split:
        at, n = 0, size
    else:
        if size < LEAST_BYTES or (magic is not None and head[:8] != magic):
            raise ValueError(f"{path}: not an archive")
        catalog_at = struct.unpack(FOOTER, _read(spark, path, size - 24, 24))[0]
        if not 8 <= catalog_at <= size - 24 - 5:
            raise ValueError(f"{path}: damaged footer")
        kind, n = struct.unpack(CHUNK_HEADER, _read(spark, path, catalog_at, 5))
        at = catalog_at + 5
        if kind != CATALOG_CHUNK or at + n > size - 24:
            raise ValueError(f"{path}: no catalog where the footer points")
    folder = local_dir(spark, "catalog")
    os.makedirs(folder)
    copied, inner = f"{folder}/copied", f"{folder}/db"
    out = spark.sparkContext._jvm.java.io.FileOutputStream(copied)
    try:
        _stream(spark, path, at, n, out)
    finally:
        out.close()

    def look(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in it:
            try:
                found = _look(copied, inner, split)
            except (zstandard.ZstdError, sqlite3.DatabaseError):
                found = "damaged catalog"
            except OverflowError:
                found = f"catalog above {MOST_CATALOG} bytes"
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(found)])], ["found"])

    found = json.loads(spark.range(0, 1, 1, 1).mapInArrow(look, "found string").first()["found"])
    if isinstance(found, str):
        raise ValueError(f"{path}: {found}")
    return inner, found, f"{path}.blobs" if split else path, 0 if split else 5


def _look(copied: str, inner: str, split: bool) -> dict[str, dict]:
    if split:
        os.replace(copied, inner)
    elif not os.path.exists(inner):
        draft = f"{inner}-{os.getpid()}"
        with open(copied, "rb") as f, open(draft, "wb") as out:
            reader, n = zstandard.ZstdDecompressor().stream_reader(f), 0
            while piece := reader.read(PIECE):
                n += out.write(piece)
                if n > MOST_CATALOG:
                    raise OverflowError
        os.replace(draft, inner)
    db, found = _open(inner), {}
    db.execute("SELECT count(*) FROM entries").fetchone()
    for t in TABLES:
        columns = [r[1] for r in db.execute(f"PRAGMA table_info({t})")]
        try:
            ids = db.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {t}").fetchone() if columns else None
        except sqlite3.OperationalError:  # a table without row ids
            ids = None
        found[t] = {"columns": columns, "ids": ids}
    db.close()
    return found


def _open(inner: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{urllib.parse.quote(inner)}?mode=ro&immutable=1", uri=True)


def _rows(spark: SparkSession, inner: str, ids: list | None, columns: str, table: str, schema: str) -> DataFrame:
    """A table of the catalog, staged; tasks read ranges of row ids."""
    low, high, n = ids or (None, None, 0)
    parts = -(-n // RANGE_ROWS) or 1
    step = -(-(high - low + 1) // parts) if n else 0
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    into = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _open(inner)
        for batch in it:
            for i in batch.column(0).to_pylist():
                some = f" WHERE rowid >= {low + i * step} AND rowid <= {min(high, low + i * step + step - 1)}" if n else ""
                rows = db.execute(f"SELECT {columns} FROM {table}{some}")
                while got := rows.fetchmany(2000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), into.types, strict=True)], schema=into)
        db.close()

    return stage(spark.range(0, parts, 1, parts).mapInArrow(read, schema), f"packed-{table}")


def read_packed(spark: SparkSession, path: str, magic: bytes | None = None, check: bool = False) -> Catalog:
    """The archive as catalog tables, with its payloads; ``magic``: the eight leading bytes to insist on;
    ``check``: compare the checksum first.

    Damaged input is a ``ValueError``.  Older catalogs without block columns are read as unblocked.
    """
    ship_package(spark)
    if check:
        verify(spark, path)
    inner, found, blob_file, skip = _database(spark, path, magic)
    has = lambda table, column: column in found[table]["columns"]
    table = lambda columns, name, schema: _rows(spark, inner, found[name]["ids"], columns, name, schema)
    block = "block_id, block_offset" if has("blobs", "block_id") else "NULL, NULL"
    try:
        entries = table("id, parent_id, name_id, mode, mtime_ns, size, uid, gid, transform, CAST(params AS TEXT), symlink_target", "entries", ENTRIES)
        blobs = table(f"id, lower(hex(sha)), offset, clen, ulen, compressed, {block}", "blobs", BLOBS)
        links = table("entry_id, seq, blob_id", "entry_blobs", LINKS)
        log = table("entry_id, transform_id, estimated_gain, estimated_cpu, applied, reason", "plan_log", LOG) if has("plan_log", "entry_id") else None
        meta, names = table("key, CAST(value AS TEXT)", "meta", META), table("id, name", "names", NAMES)
    except PythonException as e:
        if "sqlite3." not in str(e) and "pyarrow.lib.Arrow" not in str(e):
            raise
        raise ValueError(f"{path}: damaged catalog") from e
    kind = F.when(F.col("link_target").isNotNull(), "link").when(F.col("mode").bitwiseAND(F.lit(DIR_BIT)) != 0, "dir").otherwise("file")
    solid = blobs.where("compressed = 3")
    chunks = solid.groupBy("block_id").agg(F.first("offset").alias("offset"), F.first("clen").alias("clen"), F.sum("ulen").alias("ulen")).withColumn("blob_id", F.lit(None).cast("long"))
    alone = blobs.where("compressed <> 3").select("block_id", "offset", "clen", "ulen", "blob_id")
    blocks = _payloads(chunks.unionByName(alone), blob_file, skip)
    return Catalog(meta, names, entries.withColumn("kind", kind), blobs.drop("offset"), links, log, blocks)


def _payloads(chunks: DataFrame, path: str, skip: int) -> DataFrame:
    local = _local(path)

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(local, "rb") as f:
            for pdf in it:
                for r in pdf.itertuples(index=False):
                    f.seek(int(r.offset) + skip)
                    data = f.read(int(r.clen))
                    yield pd.DataFrame({"block_id": pd.array([r.block_id], "Int64"), "blob_id": pd.array([r.blob_id], "Int64"), "payload": [data], "ulen": [r.ulen], "clen": [r.clen]})

    typed = chunks.select("block_id", "blob_id", "offset", "clen", "ulen").where("clen > 0")
    # narrow rows that stand for large chunks, so they are dealt out by the bytes of the file, not by their own
    dealt = typed.repartition(max(1, -(-_length(chunks.sparkSession, path) // PART_BYTES)), "offset")
    return dealt.mapInPandas(read, "block_id long, blob_id long, payload binary, ulen long, clen long")
