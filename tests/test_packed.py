"""Import of packed archives, whole and damaged."""

import os
import sqlite3
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from corpusmill.operators import solid
from corpusmill.plans import archive
from corpusmill.sources import packed

MAGIC = b"ARCHIVE1"
DDL = """CREATE TABLE meta (key TEXT, value TEXT); CREATE TABLE names (id INTEGER, name TEXT);
CREATE TABLE entries (id INTEGER, parent_id INTEGER, name_id INTEGER, mode INTEGER, mtime_ns INTEGER, size INTEGER, uid INTEGER, gid INTEGER, transform TEXT, params BLOB, symlink_target TEXT);
CREATE TABLE blobs (id INTEGER, sha BLOB, offset INTEGER, clen INTEGER, ulen INTEGER, compressed INTEGER, block_id INTEGER, block_offset INTEGER);
CREATE TABLE entry_blobs (entry_id INTEGER, seq INTEGER, blob_id INTEGER);
CREATE TABLE plan_log (entry_id INTEGER, transform_id TEXT, estimated_gain INTEGER, estimated_cpu INTEGER, applied INTEGER, reason TEXT);"""


@pytest.fixture
def whole():
    """A directory with two files in one block, one file of its own, and a link."""
    db, out = sqlite3.connect(":memory:"), bytearray(MAGIC)
    db.executescript(DDL)
    block = zstandard.compress(b"first\n\t\x00\x01\n")
    for kind, data in ((3, block), (1, b"plain bytes \xff")):
        db.execute("INSERT INTO meta VALUES (?, ?)", (f"at{kind}", str(len(out))))
        out += struct.pack(">BI", kind, len(data)) + data
    at = {k: int(v) for k, v in db.execute("SELECT key, value FROM meta")}
    db.executemany("INSERT INTO names VALUES (?, ?)", [(1, "d"), (2, "a.txt"), (3, "b.go"), (4, "c.bin"), (5, "link")])
    file = lambda i, parent, name, transform=None: (i, parent, name, 0o644, 0, 1, 0, 0, transform, None, None)
    db.executemany("INSERT INTO entries VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", [(1, None, 1, 1 << 31 | 0o755, 0, 0, 0, 0, None, None, None), file(2, 1, 2), file(3, 1, 3, "go-line-subst/v1"), file(4, None, 4), (5, None, 5, 0o777, 0, 0, 0, 0, None, None, "c.bin")])
    db.executemany("INSERT INTO blobs VALUES (?, ?, ?, ?, ?, ?, ?, ?)", [(1, b"1", at["at3"], len(block), 6, 3, 1, 0), (2, b"2", at["at3"], len(block), 4, 3, 1, 6), (3, b"3", at["at1"], 13, 13, 0, None, None)])
    db.executemany("INSERT INTO entry_blobs VALUES (?, 0, ?)", [(2, 1), (3, 2), (4, 3)])
    db.commit()
    catalog_at, catalog = len(out), zstandard.compress(db.serialize())
    out += struct.pack(">BI", 2, len(catalog)) + catalog + struct.pack(">QQ8s", catalog_at, 8, b"unused..")
    return bytes(out)


def test_read_packed(spark, whole, tmp_path):
    path = tmp_path / "x.bin"
    path.write_bytes(whole)
    c = packed.read_packed(spark, str(path), MAGIC)
    got = {r["rel_path"]: (r["kind"], r["content"]) for r in archive.restore(c).selectExpr("rel_path", "kind", "cast(content as binary) content").collect()}
    assert got == {"d": ("dir", None), "d/a.txt": ("file", b"first\n"), "d/b.go": ("file", b'\t"bytes"\n'), "c.bin": ("file", b"plain bytes \xff"), "link": ("link", None)}
    sizes = packed.layout(spark, str(path))
    assert sizes["bytes"] == len(whole) == sizes["blob_region"] + sizes["catalog"] + sizes["overhead"]


def test_damaged(spark, whole, tmp_path):
    n = len(whole)
    for i, data in enumerate([b"", whole[:4], whole[:24], whole[: n // 2], whole[:-1], whole[:-24] + b"\xff" * 24, b"x" + whole[1:]]):
        path = tmp_path / f"bad{i}"
        path.write_bytes(data)
        with pytest.raises(ValueError):
            packed.read_packed(spark, str(path), MAGIC)


def files_of(spark):
    rows = [(i, f"d{i % 3}/{i}.bin", bytes([i % 251]) * (i % 40)) for i in range(300)]
    return spark.createDataFrame(rows, "file_id long, rel_path string, content binary").withColumn("size", F.octet_length("content").cast("long"))


@pytest.mark.parametrize("block_bytes", [1000, 0])
def test_nothing_large_passes_the_driver(spark, tmp_path, monkeypatch, block_bytes):
    """Executors write chunks and rows of the catalog; the driver iterates over neither, and all comes back."""
    built, path = archive.build(files_of(spark), block_bytes=block_bytes), str(tmp_path / "a.pack")
    kind = type(built.blocks)

    def none(*_, **__):
        raise AssertionError("rows on the driver")

    with monkeypatch.context() as m:
        m.setattr(kind, "toLocalIterator", none)
        m.setattr(kind, "toPandas", none)
        m.setattr(packed, "RANGE_ROWS", 7)
        packed.write_packed(built, path, MAGIC)
        m.setattr(type(spark), "createDataFrame", none)
        c = packed.read_packed(spark, path, MAGIC, check=True)
    assert sorted(os.listdir(tmp_path)) == ["a.pack"]
    back = {r["rel_path"]: bytes(r["content"]) for r in archive.restore(c).where("kind = 'file'").selectExpr("rel_path", "cast(content as binary) content").collect()}
    assert back == {r["rel_path"]: bytes(r["content"]) for r in files_of(spark).collect()}
    # chunks lie side by side, in the order of their ids
    data, at, kinds = open(path, "rb").read(), 8, []
    while at < len(data) - 24:
        kind, n = struct.unpack(">BI", data[at : at + 5])
        kinds.append(kind)
        at += 5 + n
    assert at == len(data) - 24 and kinds == [3 if block_bytes else 1] * (len(kinds) - 1) + [2] and len(kinds) == built.blocks.count() + 1
    assert packed.layout(spark, path)["blob_region"] == len(data) - 24 - 8 - packed.layout(spark, path)["catalog"]


def test_payloads_are_not_broadcast(spark, whole, tmp_path):
    path = tmp_path / "x.bin"
    path.write_bytes(whole)
    c = packed.read_packed(spark, str(path), MAGIC)
    plan = solid.unpack(c.blobs, c.blocks)._jdf.queryExecution().executedPlan().toString()
    assert "payload" in plan and not [x for x in plan.split("BroadcastExchange")[1:] if "payload" in x.split("\n")[1]]


def test_tables_without_row_ids(spark, whole, tmp_path):
    """A split archive whose table of links has no row ids."""
    size = struct.unpack(">Q", whole[-24:-16])[0]
    db = sqlite3.connect(":memory:")
    db.deserialize(zstandard.decompress(whole[size + 5 : -24]))
    db.executescript("CREATE TABLE l (entry_id INTEGER, seq INTEGER, blob_id INTEGER, PRIMARY KEY (entry_id, seq)) WITHOUT ROWID; INSERT INTO l SELECT * FROM entry_blobs; DROP TABLE entry_blobs; ALTER TABLE l RENAME TO entry_blobs; UPDATE blobs SET offset = offset + 5; VACUUM;")
    (tmp_path / "s.db").write_bytes(db.serialize())
    (tmp_path / "s.db.blobs").write_bytes(whole)
    got = {r["rel_path"]: bytes(r["content"]) for r in archive.restore(packed.read_packed(spark, str(tmp_path / "s.db"))).where("kind = 'file'").selectExpr("rel_path", "cast(content as binary) content").collect()}
    assert got == {"d/a.txt": b"first\n", "d/b.go": b'\t"bytes"\n', "c.bin": b"plain bytes \xff"}
