"""Packing unique blobs into shared compression blocks, compressing blobs on their own, and unpacking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.plans.staging import ship_package

DEFAULT_BLOCK = 4 << 20
NONE, ZSTD, ZSTD_DICT, SOLID = 0, 1, 2, 3
#: Blobs of a run, by number.
RUN_ROWS = 100_000
STORED = "block_id long, blob_id long, payload binary, ulen long, clen long"


def block_starts(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty blobs in order: running sums with a leading 0, and for a block that starts at blob i,
    the blob that starts the next one (``len(sizes)``: none)."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    nxt = np.searchsorted(sums, sums[:-1] + most, "right") - 1
    return sums, np.maximum(nxt, np.arange(1, len(sizes) + 1))


def _first_break(sums: np.ndarray, used: int, most: int) -> int:
    """The first blob that no longer fits after ``used`` bytes; none are used: the block that begins with blob 0."""
    return max(0, int(np.searchsorted(sums, most - used, "right")) - 1)


def _outcomes(pdf: pd.DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every blob that can be a run's first break: sums through it, and how many blocks more and bytes
    in the last one the run then ends with."""
    sizes = pdf.sort_values("blob_id")["ulen"].to_numpy(np.int64)
    sizes = sizes[sizes > 0]
    sums, nxt = block_starts(sizes, most)
    n = len(sizes)
    more, used = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        j = nxt[i]
        more[i], used[i] = (0, sums[n] - sums[i]) if j == n else (more[j] + 1, used[j])
    can = min(n, _first_break(sums, 0, most) + 1)
    return sums[1 : can + 1], more[:can], used[:can]


def pack(blobs: DataFrame, most: int = DEFAULT_BLOCK) -> DataFrame:
    """``(blob_id, ulen, block_id, block_offset)``: in id order, a blob starts a new block if the current one
    has bytes and would exceed ``most``; an empty blob never does.

    The rule depends on all rows before, but only through the bytes used so far.  Runs are ids within
    :data:`RUN_ROWS` of each other; each run tells, for every blob that may be its first to start a block (those within its
    first ``most`` bytes), how it would end.  One row a run is then chained, and the runs place their
    blobs side by side.  Contents stay where they are.
    """
    ship_package(blobs.sparkSession)
    slim = blobs.select(F.col("blob_id").cast("long").alias("blob_id"), F.col("ulen").cast("long").alias("ulen"))
    runs = slim.withColumn("run", F.floor(F.col("blob_id") / RUN_ROWS))

    def outcome(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        through, more, used = _outcomes(pdf, most)
        return pd.DataFrame({"run": [key[0]], "total": [int(pdf["ulen"].sum())], "through": [through], "more": [more], "used": [used]})

    def chain(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, used = 0, 0
        for pdf in it:
            starts = []
            for r in pdf.itertuples(index=False):
                starts.append((r.run, block, used))
                if used + r.total <= most:
                    used += int(r.total)
                elif not used:
                    block, used = block + int(r.more[0]), int(r.used[0])
                else:
                    j = int(np.searchsorted(np.asarray(r.through), most - used, "right"))
                    block, used = block + 1 + int(r.more[j]), int(r.used[j])
            yield pd.DataFrame(starts, columns=["run", "block", "used"])

    ends = runs.groupBy("run").applyInPandas(outcome, "run long, total long, through array<long>, more array<long>, used array<long>")
    # a row for each run, so the stream that chains them is short
    starts = ends.repartition(1).sortWithinPartitions("run").mapInPandas(chain, "run long, block long, used long")

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, block, used = (int(x) for x in key)
        pdf = pdf.sort_values("blob_id", ignore_index=True)
        sizes = pdf["ulen"].to_numpy(np.int64)
        some = sizes > 0
        sums, nxt = block_starts(sizes[some], most)
        n = len(nxt)
        begins = np.zeros(n, np.int64)
        at = _first_break(sums, used, most) if used else (int(nxt[0]) if n else 0)
        while at < n:
            begins[at] = 1
            at = int(nxt[at])
        base = np.maximum.accumulate(np.where(begins > 0, sums[:-1], -1)) if n else np.zeros(0, np.int64)
        offsets = np.where(base >= 0, sums[:-1] - base, sums[:-1] + used)
        # block and bytes used after k non-empty blobs; an empty blob takes none
        ids = np.concatenate([[block], block + np.cumsum(begins)])
        ends = np.concatenate([[used], offsets + sizes[some]])
        k = np.cumsum(some)
        return pdf.assign(block_id=ids[k], block_offset=ends[k] - sizes)[["blob_id", "ulen", "block_id", "block_offset"]]

    return runs.join(starts, "run").groupBy("run", "block", "used").applyInPandas(place, "blob_id long, ulen long, block_id long, block_offset long")


def compressed(content: Column, level: int = 3, dictionary: bytes | None = None) -> Column:
    """Zstandard frame of a binary column; null stays null."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        c = zstandard.ZstdCompressor(level=level, dict_data=d)
        for s in batches:
            yield s.map(c.compress, na_action="ignore")

    return run(content.cast("binary"))


def decompressed(frame: Column, dictionary: bytes | None = None) -> Column:
    """The bytes of a frame, with or without a content size in its header."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for s in batches:
            yield s.map(lambda x: d.decompressobj().decompress(x), na_action="ignore")

    return run(frame)


def blocks(contents: DataFrame, packed: DataFrame | None = None, level: int = 3) -> DataFrame:
    """:data:`STORED` rows, one a block; ``contents (blob_id, bytes)``, with the columns of ``packed`` if that is not
    given.  A block is at most ``most`` bytes, or one blob."""
    ship_package(contents.sparkSession)

    into = pa.schema([("block_id", pa.int64()), ("blob_id", pa.int64()), ("payload", pa.binary()), ("ulen", pa.int64()), ("clen", pa.int64())])

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks follow each other, so a task streams through its many small ones."""
        c = zstandard.ZstdCompressor(level=level)

        def whole(block: int, pieces: list[bytes]) -> pa.RecordBatch:
            data = b"".join(pieces)
            frame = c.compress(data)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, None, frame, len(data), len(frame)), into.types, strict=True)], schema=into)

        now, pieces = None, []
        for batch in it:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if pieces and block != now:
                    yield whole(now, pieces)
                    pieces = []
                now = block
                pieces.append(data)
        if pieces:
            yield whole(now, pieces)

    joined = contents if packed is None else contents.join(packed, "blob_id")
    dealt = joined.select("block_id", "block_offset", "blob_id", "bytes").repartition("block_id").sortWithinPartitions("block_id", "block_offset", "blob_id")
    return dealt.select("block_id", "bytes").mapInArrow(build, STORED)


def single(contents: DataFrame, compressor: str = "zstd", level: int = 3, dictionary: bytes | None = None, dict_after: int = 0) -> DataFrame:
    """:data:`STORED` rows with ``compressed``, one a blob: as it is (``none``), as a frame of its own, or, for
    ids above ``dict_after``, as a frame with the dictionary."""
    if compressor not in ("zstd", "none"):
        raise ValueError(f"unknown compressor: {compressor}")
    if compressor == "none":
        out = contents.withColumn("payload", F.col("bytes")).withColumn("compressed", F.lit(NONE))
    elif dictionary is None:
        out = contents.withColumn("payload", compressed(F.col("bytes"), level)).withColumn("compressed", F.lit(ZSTD))
    else:
        early = contents.where(F.col("blob_id") <= dict_after).withColumn("payload", compressed(F.col("bytes"), level)).withColumn("compressed", F.lit(ZSTD))
        late = contents.where(F.col("blob_id") > dict_after).withColumn("payload", compressed(F.col("bytes"), level, dictionary)).withColumn("compressed", F.lit(ZSTD_DICT))
        out = early.unionByName(late)
    return out.select(F.lit(None).cast("long").alias("block_id"), "blob_id", "payload", F.octet_length("bytes").cast("long").alias("ulen"), F.octet_length("payload").cast("long").alias("clen"), "compressed")


def unpack(blobs: DataFrame, stored: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """``(blob_id, bytes)`` of ``blobs (blob_id, ulen, block_id, block_offset, compressed)``: every block is
    decoded once, and its blobs are cut out there.  A blob that the store lacks is empty."""
    ship_package(blobs.sparkSession)
    # an empty blob needs no block, so a block's list has an entry for each of its bytes at most
    parts = blobs.where((F.col("compressed") == SOLID) & (F.col("ulen") > 0)).groupBy("block_id").agg(F.collect_list(F.struct("blob_id", "block_offset", "ulen")).alias("parts"))
    empty = blobs.where((F.col("compressed") == SOLID) & ~(F.col("ulen") > 0)).select("blob_id", F.lit(b"").alias("bytes"))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in it:
            for payload, own in zip(batch.column(0), batch.column(1), strict=True):
                data = b"" if payload.as_py() is None else d.decompressobj().decompress(payload.as_py())
                own = own.as_py()
                for at in range(0, len(own), 1000):
                    some = own[at : at + 1000]
                    pieces = [data[x["block_offset"] : x["block_offset"] + x["ulen"]] for x in some]
                    yield pa.RecordBatch.from_arrays([pa.array([x["blob_id"] for x in some], pa.int64()), pa.array(pieces, pa.binary())], ["blob_id", "bytes"])

    # payloads are never broadcast: what Python makes is of a size that Spark does not know
    solid = parts.join(stored.where("block_id is not null").select("block_id", "payload").hint("merge"), "block_id", "left").select("payload", "parts").mapInArrow(cut, "blob_id long, bytes binary").unionByName(empty)
    alone = blobs.where(F.col("compressed") != SOLID).select("blob_id", "compressed").join(stored.where("blob_id is not null").select("blob_id", "payload").hint("merge"), "blob_id", "left")
    raw = alone.where(F.col("compressed") == NONE).select("blob_id", F.col("payload").alias("bytes"))
    plain = alone.where(F.col("compressed") == ZSTD).select("blob_id", decompressed(F.col("payload")).alias("bytes"))
    with_dict = alone.where(F.col("compressed") == ZSTD_DICT).select("blob_id", decompressed(F.col("payload"), dictionary).alias("bytes"))
    every = solid.unionByName(raw).unionByName(plain).unionByName(with_dict)
    return every.select("blob_id", F.coalesce("bytes", F.lit(b"")).alias("bytes"))


def dict_samples(files: DataFrame, most: int = 500, least_bytes: int = 1, most_bytes: int = 64 << 10, total: int = 8 << 20) -> DataFrame:
    """``(file_id, n, before)``: the files, in id order, from which a dictionary is trained: until there are
    ``most`` of them or ``total`` bytes."""
    return _sampled(files, most, least_bytes, most_bytes).where(F.col("before") < total)


def online_samples(files: DataFrame, most: int = 500, least_bytes: int = 1, most_bytes: int = 64 << 10, least: int = 8, enough: int = 32 << 10) -> DataFrame:
    """As :func:`dict_samples`, for training while writing: until there are ``least`` files with ``enough``
    bytes together, or ``most`` files."""
    return _sampled(files, most, least_bytes, most_bytes).where((F.col("n") <= least) | (F.col("before") < enough))


def _sampled(files: DataFrame, most: int, least_bytes: int, most_bytes: int) -> DataFrame:
    some = files.where(F.col("size").between(least_bytes, most_bytes)).select("file_id", "size")
    # nothing after the first ``most`` can be taken, so only these reach the window
    head = some.orderBy("file_id").limit(most)
    order = Window.orderBy("file_id")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return head.withColumn("n", F.row_number().over(order)).withColumn("before", before).select("file_id", "n", "before")


def train_dictionary(files: DataFrame, samples: DataFrame | None = None, size: int = 32 << 10, least: int = 8) -> bytes | None:
    """A zstd dictionary of the bounded sample, or None if there are too few files or the trainer gives up."""
    ids = dict_samples(files) if samples is None else samples
    # at most 500 ids and 8 MiB, the bounds of the sample
    sample = files.join(F.broadcast(ids.select("file_id")), "file_id").orderBy("file_id").select(F.col("content").cast("binary").alias("c"))
    data = [bytes(r["c"]) for r in sample.collect()]
    if len(data) < least:
        return None
    try:
        return zstandard.train_dictionary(size, data).as_bytes()
    except zstandard.ZstdError:
        return None
