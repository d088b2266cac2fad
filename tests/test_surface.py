"""The command line, stored and packed archives with their checksums, rules of one's own, trees that are hard to read."""

import json
import os
import random
import stat

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill import cli
from corpusmill.operators import catalog, dedup, lines, solid
from corpusmill.operators import ordering
from corpusmill.plans import archive, planner, report, staging
from corpusmill.plans import rules as R
from corpusmill.sources import packed, store, tree


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "src"
    (src / "deep/er/down").mkdir(parents=True)
    go = "package main\n\nimport (\n\t\"fmt\"\n)\n\nfunc f() error {\n\tif err != nil {\n\t\treturn err\n\t}\n\treturn nil\n}\n"
    (src / "a.go").write_text(go * 3)
    (src / "copy.go").write_text(go * 3)
    (src / "bad.go").write_bytes(b"import (\n\xff\xfe x\n)\n" + go.encode())
    (src / "nul.go").write_bytes(b"import (\n\x00 x\n)\n" + go.encode())
    (src / "deep/er/down/t.txt").write_text("some words\n" * 50)
    (src / "deep/u.txt").write_text("some words\n" * 50)
    (src / "empty").write_bytes(b"")
    os.symlink("a.go", src / "deep/link")
    os.chmod(src / "deep/u.txt", 0o640)
    return src


def tree_of(top):
    out = {}
    for d, dirs, files in os.walk(top):
        for n in dirs + files:
            p = os.path.join(d, n)
            s = os.lstat(p)
            body = os.readlink(p) if stat.S_ISLNK(s.st_mode) else open(p, "rb").read() if stat.S_ISREG(s.st_mode) else None
            out[os.path.relpath(p, top)] = (stat.S_IFMT(s.st_mode), None if stat.S_ISLNK(s.st_mode) else stat.S_IMODE(s.st_mode), s.st_uid, s.st_gid, body, None if stat.S_ISLNK(s.st_mode) else s.st_mtime_ns)
    return out


@pytest.mark.parametrize("options", [["--packed"], ["--no-solid", "--final-compressor", "none"], ["--solid-block-size", "1KB", "--disable-transform", "dedup/v1"]])
def test_archive_inspect_and_extract(spark, folder, tmp_path, capsys, options):
    out = str(tmp_path / "arc")
    assert cli.main(["archive", out, str(folder), "--keep-plan-log", "--explain", *options]) == 0
    said = capsys.readouterr().out
    assert "12 (7 files, 4 directories, 1 links)" in said and "go-line-subst/v1" in said
    assert cli.main(["extract", out, "-C", str(tmp_path / "back"), "--verify"]) == 0
    assert tree_of(folder) == tree_of(tmp_path / "back")
    assert cli.main(["inspect", out, "--raw", "--verify"]) == 0
    view = json.loads(capsys.readouterr().out)
    assert view["entries"] == 12 and view["files"] == 7 and ("catalog" in view) == ("--packed" in options)
    assert cli.main(["inspect", out, "--plan-log"]) == 0
    # the two texts are copies; both sources of one content go through the line rule, the damaged ones through none
    assert f"7 files, {2 if '--disable-transform' in options else 3} under a rule" in capsys.readouterr().out
    assert cli.main(["inspect", out, "--plan-log", "--raw"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 7


def test_other_commands(spark, folder, tmp_path, capsys):
    assert cli.main(["--version", "-v"]) == 0
    said = capsys.readouterr().out
    assert all(r.id in said for r in R.ALL) and "near-dup-delta/v1       stub" in said
    assert cli.main(["analyze", str(folder), "--pattern", "*.txt", "-n", "1"]) == 0
    assert capsys.readouterr().out == "100\tsome words\n"
    assert cli.main(["bench", str(folder), "--json", "--output", str(tmp_path / "r.json")]) == 0
    r = json.loads((tmp_path / "r.json").read_text())
    assert r["files"] == 7 and r["source_bytes"] == sum(p.stat().st_size for p in folder.rglob("*") if p.is_file() and not p.is_symlink())
    assert r["archive_mb_s"] > 0 and r["ratio_pct"] > 0 and r["peak_memory_bytes"] > 0 and {x["transform"] for x in r["rules"]} >= {"raw", "go-line-subst/v1"}
    assert cli.main([]) == 2
    for bad in (["inspect", str(tmp_path / "none")], ["archive", str(tmp_path / "x"), str(folder), "--disable-transform", "z"], ["archive", str(tmp_path / "x"), str(folder), "--solid-block-size", "0"], ["archive", str(tmp_path / "x"), str(tmp_path / "none")]):
        assert cli.main(bad) == 1
    assert cli.main(["archive", str(tmp_path / "y"), str(folder)]) == 0 and cli.main(["inspect", str(tmp_path / "y"), "--plan-log"]) == 1


def test_sizes_and_rates():
    assert [report.size_of(x) for x in ("4MB", "512 kb", "12", "1GB", "7B")] == [4 << 20, 512 << 10, 12, 1 << 30, 7]
    for bad in ("", "0", "-1", "x", "1TB", "1.5MB"):
        with pytest.raises(ValueError):
            report.size_of(bad)
    assert report.rates(0, 5, 1, 1) == {"archive_mb_s": 0.0, "extract_mb_s": 0.0, "ratio_pct": 0.0}
    assert report.rates(2 << 20, 1 << 20, 2, 0.5) == {"archive_mb_s": 1.0, "extract_mb_s": 4.0, "ratio_pct": 50.0}


# --- checksums and damage


@pytest.fixture
def small(spark):
    files = spark.createDataFrame([(f"d/{i}.txt", f"text {i % 3}\n" * 20, 140) for i in range(6)], "rel_path string, content string, size long")
    return archive.build(files, block_bytes=256)


def test_a_save_that_fails_leaves_the_catalog_that_was(spark, small, tmp_path):
    path = str(tmp_path / "cat")
    store.save(small, path)
    before = sorted(archive.restore(store.load(spark, path)).collect(), key=str)
    broken = catalog.Catalog(small.meta, small.names, small.entries, small.blobs, small.entry_blobs, None, small.blocks.withColumn("clen", F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        store.save(broken, path)
    assert sorted(archive.restore(store.load(spark, path)).collect(), key=str) == before and store.verify(spark, path) == {}
    store.save(small, path)
    assert len([x for x in os.listdir(path) if x.startswith("tables-")]) == 2  # the failed one's and the one that counts
    with pytest.raises(ValueError, match="no catalog"):
        store.load(spark, str(tmp_path / "none"))


def test_stored_damage_is_found(spark, small, tmp_path):
    path = tmp_path / "cat"
    store.save(small, str(path))
    tables = next(path.glob("tables-*"))
    spark.createDataFrame([(9, "other")], "id long, name string").write.mode("append").parquet(str(tables / "names"))
    small.blocks.withColumn("ulen", F.col("ulen") + 1).write.parquet(str(tables / "b2"))
    os.rename(tables / "blocks", tables / "b1")
    os.rename(tables / "b2", tables / "blocks")
    wrong = store.verify(spark, str(path))
    assert sorted(wrong) == ["blocks", "names"] and wrong["blocks"] == "contents differ"
    assert cli.main(["extract", str(path), "-C", str(tmp_path / "x"), "--verify"]) == 1


def test_packed_damage_is_found(spark, small, tmp_path):
    path = str(tmp_path / "a.pack")
    packed.write_packed(small, path, cli.MAGIC)
    data = open(path, "rb").read()
    packed.verify(spark, path)
    rng = random.Random(3)
    for at in [0, 8, 13, len(data) - 1, *(rng.randrange(len(data) - 24) for _ in range(6))]:
        bad = bytearray(data)
        bad[at] ^= 1 << rng.randrange(8)
        with open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(ValueError):
            packed.read_packed(spark, path, cli.MAGIC, check=True)
    with pytest.raises(ValueError, match="eight"):
        packed.write_packed(small, path, b"short")


def test_directories_are_listed_together(tmp_path):
    """A scan makes a table for thousands of nodes, not one for each directory."""
    for i in range(300):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "x").write_bytes(b"1")
    dirs = pd.DataFrame({"path": [str(tmp_path / f"d{i}") for i in range(300)], "rel_path": [f"d{i}" for i in range(300)]})
    assert [len(x) for x in tree._walk(iter([dirs[:150], dirs[150:]]))] == [300]
    some = list(tree._walk(iter([dirs]), 7))
    assert max(map(len, some)) == 7 and sorted(pd.concat(some)["rel_path"]) == sorted(f"d{i}/x" for i in range(300))


def test_random_bytes_are_no_archive(spark, tmp_path):
    rng = random.Random(5)
    for i in range(8):
        path = tmp_path / f"r{i}"
        path.write_bytes(rng.randbytes(rng.randrange(200)))
        with pytest.raises(ValueError):
            packed.read_packed(spark, str(path))


# --- rules of one's own


def backwards(spark):
    def store_(df, text, context, out, params):
        return df.withColumns({out: F.when(~F.contains(text, F.lit("keep")), F.reverse(text)), params: F.concat(F.lit("n="), F.length(text).cast("string"))})

    def restore(df, stored, params, context, out):
        return df.withColumn(out, F.when(params_ok(F.col(params), F.col(stored)), F.reverse(stored)))

    def params_ok(p, s):
        return p == F.concat(F.lit("n="), F.length(s).cast("string"))

    return R.Rule("backwards/v1", lambda p, s: p.endswith(".txt"), lambda s: s, lambda s: F.lit(10), store=store_, restore=restore)


def test_a_rule_of_ones_own(spark):
    rows = [("a.txt", "some text that is long"), ("b.txt", "keep this one as it is"), ("c.txt", "short"), ("d.bin", "other bytes than those"), ("e.txt", "some text that is long")]
    files = spark.createDataFrame([(p, c, len(c)) for p, c in rows], "rel_path string, content string, size long")
    mine = (R.DEDUP, backwards(spark))
    built = archive.build(files, rules=mine)
    paths = catalog.paths(built.entries, built.names)
    used = {r["path"]: r["transform"] for r in built.entries.join(paths, "id").collect()}
    assert used == {"a.txt": "backwards/v1", "b.txt": None, "c.txt": None, "d.bin": None, "e.txt": "backwards/v1"}
    assert {r["rel_path"]: r["content"] for r in archive.restore(built, rules=mine).collect()} == dict(rows)
    with pytest.raises(ValueError, match="backwards/v1"):
        archive.restore(built)
    off = archive.build(files, rules=mine, disabled=("backwards/v1",))
    assert off.entries.where("transform = 'backwards/v1'").isEmpty()


def test_bytes_that_are_no_text_stay(spark):
    bad = [b"import (\n\xff\xfe x\n)\n", b"\x80" * 40, "import (\né\n".encode() + b"\xc3", b"import (\n\x00\n"]
    files = spark.createDataFrame([(f"f{i}.go", bytearray(c), len(c)) for i, c in enumerate(bad)] + [("ok.go", bytearray(b"import (\nx\n"), 11)], "rel_path string, content binary, size long")
    back = {r["rel_path"]: bytes(r["c"]) for r in archive.restore(archive.build(files)).select("rel_path", F.col("content").cast("binary").alias("c")).collect()}
    assert back == {f"f{i}.go": c for i, c in enumerate(bad)} | {"ok.go": b"import (\nx\n"}
    got = lines.encode(files.select("rel_path", F.col("content").cast("string").alias("content")), lines.fixed_dictionary(spark)).where("encoded is not null").collect()
    assert [r["rel_path"] for r in got] == ["ok.go"]


def test_contents_are_looked_at_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(R, "LINES", R.LINES)
    first = R.LINES._replace(store=lambda df, *a: (seen.append(1), R.LINES.store(df, *a))[1])
    archive.build(spark.createDataFrame([("a.go", "import (\n" * 5, 45)], "rel_path string, content string, size long"), rules=(R.DEDUP, first))
    assert len(seen) == 1


# --- trees


def test_what_cannot_be_read_is_left_out(spark, folder, monkeypatch, tmp_path):
    rows = {r["rel_path"] for r in tree.scan(spark, [str(folder)]).collect()}
    assert "deep/er/down/t.txt" in rows and len(rows) == 12
    gone = tmp_path / "gone"
    assert list(tree._inside(str(gone), "gone")) == [] and tree._row(str(gone), "gone") is None
    os.mkfifo(folder / "pipe")
    assert {r["rel_path"] for r in tree.scan(spark, [str(folder)]).collect()} == rows


@pytest.mark.skipif(os.geteuid() != 0, reason="only root may give files away")
def test_owners_come_back(spark, folder, tmp_path):
    os.chown(folder / "a.go", 1234, 2345)
    os.chown(folder / "deep", 1235, 2345)
    os.lchown(folder / "deep/link", 1236, 2346)
    os.chmod(folder / "a.go", 0o4755)
    tree.write_tree(tree.with_content(tree.scan(spark, [str(folder)])), str(tmp_path / "back"))
    assert tree_of(tmp_path / "back") == tree_of(folder)


def test_owners_that_may_not_be_set_stay(monkeypatch, tmp_path):
    from types import SimpleNamespace

    def no(*_):
        raise PermissionError

    monkeypatch.setattr(os, "lchown", no)
    (tmp_path / "f").write_text("x")
    tree._touch(str(tmp_path / "f"), SimpleNamespace(uid=1, gid=1, mode=0o600, mtime_ns=10**18))
    assert (tmp_path / "f").stat().st_mtime_ns == 10**18


# --- numbering, packing, paths


def test_numbering_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ONE_TASK", 10)
    data = [(random.Random(i).randrange(50), i) for i in range(2000)]
    got = ordering.numbered(spark.createDataFrame(data, "a int, b int"), [F.col("a"), F.col("b")], "n", F.col("a"), "before").orderBy("n").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(data) and [r["n"] for r in got] == list(range(1, 2001))
    assert [r["before"] for r in got] == [sum(a for a, _ in sorted(data)[:i]) for i in range(2000)]


def test_packing_in_runs(spark, monkeypatch):
    monkeypatch.setattr(solid, "RUN_ROWS", 7)
    rng = random.Random(1)
    sizes = [rng.choice([0, 1, 5, 40, 99, 100, 101, 250]) for _ in range(200)]
    got = solid.pack(spark.createDataFrame(list(enumerate(sizes, 1)), "blob_id long, ulen long"), 100).orderBy("blob_id").collect()
    block = used = 0
    for r, n in zip(got, sizes, strict=True):
        if used and n and used + n > 100:
            block, used = block + 1, 0
        assert (r["block_id"], r["block_offset"]) == (block, used)
        used += n


def test_paths_of_odd_trees(spark):
    #    root ".", a deep chain, a nested ".", an unknown parent, and two directories below each other
    rows = [(1, None, ".", "dir"), (2, 1, "a", "dir"), (3, 1, "f", "file")] + [(10 + i, 9 + i if i else 2, f"d{i}", "dir") for i in range(40)]
    rows += [(60, 49, "end", "file"), (61, 2, ".", "dir"), (62, 61, "x", "file"), (63, 999, "lost", "file"), (64, 998, "lost2", "dir"), (65, 64, "y", "file"), (70, 71, "l", "dir"), (71, 70, "m", "dir"), (72, 70, "n", "file")]
    names = sorted({r[2] for r in rows})
    entries = spark.createDataFrame([(i, p, names.index(n), k) for i, p, n, k in rows], "id long, parent_id long, name_id long, kind string")
    named = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {r["id"]: r["path"] for r in catalog.paths(entries, named).collect()}
    chain = "a/" + "/".join(f"d{i}" for i in range(40))
    assert got[1] == "." and got[2] == "a" and got[3] == "f" and got[49] == chain and got[60] == f"{chain}/end"
    assert got[61] == "a/." and got[62] == "a/./x" and got[63] == "lost" and got[65] == "lost2/y"
    assert not {70, 71, 72} & set(got) and len(got) == len(rows) - 3


def test_entry_hash(spark):
    df = spark.createDataFrame([("file", 1, "x"), ("file", 0, ""), ("dir", 0, None), ("link", 0, None)], "kind string, size long, content string")
    got = [r[0] for r in df.select(dedup.entry_hash(F.col("kind"), F.col("size"), F.col("content"))).collect()]
    assert got[1:] == ["0" * 64] * 3 and len(got[0]) == 64 and set(got[0]) != {"0"}


def test_hits_on_bytes_that_only_a_rewritten_file_stores(spark):
    # b stores what a's text is after its rule, and c is a copy of what b stores
    text = "keep\n"
    rows = [(1, "a.txt", "abcdefghijkl"), (2, "b.bin", "lkjihgfedcba"), (3, "c.txt", "lkjihgfedcba"), (4, "d.txt", "abcdefghijkl"), (5, "e.bin", text), (6, "f.txt", text * 4), (7, "g.txt", text * 4)]
    files = spark.createDataFrame([(i, p, c, i, len(c)) for i, p, c in rows], "file_id long, rel_path string, content string, entry_id long, size long")
    mine = (R.DEDUP, backwards(spark))
    slim = staging.stage(planner.candidates(files, R.context(spark), mine).drop("bytes"))
    got = {r["file_id"]: r["transform"] for r in planner.decide(slim, mine).collect()}
    stored, want = set(), {}
    for i, p, c in rows:  # the rule in order, file by file
        if c in stored:
            want[i] = "dedup/v1"
            continue
        own = p.endswith(".txt") and len(c) > 10 and "keep" not in c
        stored.add(c[::-1] if own else c)
        want[i] = "backwards/v1" if own else None
    assert got == want
