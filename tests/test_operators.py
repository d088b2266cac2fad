"""Boundaries of single operators on small made-up inputs."""

import functools
import os
import random

import pandas as pd
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill import functions as fn
from corpusmill import registry
from corpusmill.operators import canonical, catalog, dedup, fixed, license, linediff, lines, solid
from corpusmill.operators.ordering import numbered
from corpusmill.plans import archive, planner, staging
from corpusmill.plans import rules as R
from corpusmill.sources import store, tree

MIB = 1 << 20


def flags(spark, rule, cases):
    df = spark.createDataFrame([(p, s) for p, s, _ in cases], "p string, s long")
    return [r[0] for r in df.select(F.coalesce(rule(F.col("p"), F.col("s")), F.lit(False))).collect()] == [x for *_, x in cases]


def test_applicability(spark):
    assert flags(spark, R.LINES.applicable, [("main.go", 1024, True), ("pkg/utils/helper.go", 512, True), ("empty.go", 0, False), ("readme.md", 9, False), ("config.json", 9, False), ("main.go/readme.txt", 9, False), ("a.GO", 9, False)])
    assert flags(spark, R.JSON.applicable, [("data.json", 100, True), ("CONFIG.JSON", 9, True), ("a.js", 9, False), ("a.yaml", 9, False), ("a.json", 0, False), ("a.json", 11 * MIB, False)])
    assert flags(spark, R.LOG.applicable, [(p, 2048, True) for p in ("access.log", "logs/error.log", "app.log.1", "app.log.gz", "syslog", "messages", "kern.log")] + [("main.go", 2048, False), ("notes.txt", 2048, False), ("a.log", 512, False), ("a.log", 60 * MIB, False)])
    assert flags(spark, R.LICENSE.applicable, [(p, 1, True) for p in ("LICENSE", "COPYING", "NOTICE", "license.txt", "License.md", "LICENCE", "licence", "x/COPYING.txt")] + [(p, 1, False) for p in ("main.go", "README.md", "Makefile", "go.mod", "LICENSES")])
    assert flags(spark, R.NEAR.applicable, [("a.txt", 10, False)])
    assert flags(spark, R.DEDUP.applicable, [("a", 1, True), ("a", 0, False)])


def test_line_codes(spark):
    df = spark.range(lines.MOST_ENTRIES).select("id", lines.code_of(F.col("id")).alias("c")).withColumn("back", lines.index_of(F.col("c")))
    got = df.collect()
    assert all(r["id"] == r["back"] and r["c"] not in (0, 10) and r["c"] <= 255 for r in got)
    assert len({r["c"] for r in got}) == lines.MOST_ENTRIES


def test_line_substitution(spark):
    known = spark.createDataFrame([(i, f"return value {i}", lines_code(i)) for i in range(254)], "idx int, line string, code int")
    texts = ["\treturn value 3\n  return value 200\nplain", "none\n", "return value 8", "x\x00y", "", "\n\n", "return value 3\r\n", "\t return value 253\n"]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id int, content string")
    out = lines.decode(lines.encode(files, known), known).orderBy("file_id").collect()
    assert [r["encoded"] is None for r in out] == [False, False, False, True, False, False, False, False]
    assert all(r["decoded"] == r["content"] for r in out if r["encoded"] is not None)
    assert out[0]["encoded"].split("\n")[0] == "\t\x00" + chr(lines_code(3))
    assert out[6]["encoded"] == texts[6]


def lines_code(i):
    return i + 2 if i + 1 >= 10 else i + 1


def test_json(spark):
    df = spark.createDataFrame([('{"b":1,"a":2}',), ("not json",), ('{"z":{"y":[1, 2],"x":null}}',), (None,), ('{"a":1,"a":2}',), ('"<x&y>"',)], "t string")
    got = [tuple(r) for r in df.select(canonical.canonical_json(F.col("t")), canonical.exact_canonical_json(F.col("t"))).collect()]
    assert [g[1] for g in got] == ['{"a":2,"b":1}', None, '{"z":{"x":null,"y":[1,2]}}', None, '{"a":2}', '"\\u003cx\\u0026y\\u003e"']
    assert [g[0] for g in got[:4]] == ['{"a":2,"b":1}', None, '{"z":{"x":null,"y":[1,2]}}', None]


def test_log_template(spark):
    many = "".join(f"2024-01-15 10:30:{i:02d} INFO request id={i}\n" for i in range(60))
    texts = [many, "".join(f"{i % 10} line\n" for i in range(20)), "a\n" * 9, "", "\n" * 12, "same\n" * 11 + "other\n"]
    got = canonical.log_template(spark.createDataFrame(list(enumerate(texts)), "k int, content string")).orderBy("k").withColumn("back", canonical.log_restore(F.col("template"), F.col("suffixes"))).collect()
    assert [r["template"] is None for r in got] == [False, True, True, True, True, False]
    assert got[0]["template"] == "2024-01-15 10:30:" and got[5]["template"] == "same"
    assert got[0]["back"] == many and got[5]["back"] == texts[5]


def test_license(spark):
    known = license.templates(spark)
    text = fixed.LICENSES["MIT"]
    cases = [text, text.replace("[year] [fullname]", "2020 Ann"), text.replace("\n", "\r\n"), "  " + text, text + "\n", "something else", "", None, text.replace("[year] [fullname]", "x" * 2000)]
    files = spark.createDataFrame([(i, "LICENSE", c) for i, c in enumerate(cases)], "file_id int, rel_path string, content string")
    got = license.apply_rule(files, known).orderBy("file_id").collect()
    assert [r["match"] for r in got] == ["full", "body", "full", "full", "full", None, None, None, "body"]
    # what would not come back byte for byte is left alone
    assert [r["params"] is not None for r in got] == [True, True, False, False, True, False, False, False, False]


@pytest.mark.parametrize("name", ["compress_sizes", "compress_roundtrip", "compress_dict_roundtrip"])
def test_contents_reach_python_in_small_batches(spark, tmp_path, monkeypatch, name):
    """However many rows a task has, and whatever the session says; its settings are as before."""
    spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "concat('text ', id) text", "'s' source", "'en' lang").write.parquet(str(tmp_path / "documents.parquet"))
    real = solid.compressed

    def compressed(content, level=3, dictionary=None):
        @F.pandas_udf("binary")
        def few(s: pd.Series) -> pd.Series:
            assert len(s) <= 256
            return s

        return real(few(content), level, dictionary)

    monkeypatch.setattr(solid, "compressed", compressed)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 3000
    assert registry.QUERIES[name](spark, str(tmp_path)).distinct().count() == 3000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_blocks_stream(spark):
    """Blocks are built in one stream a task, not a call a block, across batches of any size."""
    rows = [(i // 7, 10 * (i % 7), i, b"%d," % i) for i in range(700)]
    random.Random(4).shuffle(rows)
    contents = spark.createDataFrame(rows, "block_id long, block_offset long, blob_id long, bytes binary")
    built = solid.blocks(contents)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    with staging.small_batches(spark, 3):
        got = built.collect()
    assert {r["block_id"]: zstandard.decompress(bytes(r["payload"])) for r in got} == {b: b"".join(b"%d," % i for i in range(7 * b, 7 * b + 7)) for b in range(100)}
    assert len(got) == 100 and all(r["clen"] == len(r["payload"]) and r["blob_id"] is None for r in got)


def test_diffs_of_one_template(spark, tmp_path, monkeypatch):
    """Texts that differ from a template alike share a search, and rows of one small file make several tasks."""
    seen = []
    monkeypatch.setattr(linediff, "_kept", functools.lru_cache(9)(lambda a, b: seen.append(a) or linediff._runs(a, b)))
    for i in range(50):
        assert linediff.diff(["x", "name", "y", "x"], ["x", f"Ann {i}", "y", "x"]) == [("=", ["x"]), ("-", ["name"]), ("+", [f"Ann {i}"]), ("=", ["y", "x"])]
    assert len(seen) == 1
    spark.range(0, 45_000, 1, 1).selectExpr("id c_custkey", "concat('Customer#', id) c_name").write.parquet(str(tmp_path / "customer.parquet"))
    done = registry.QUERIES["line_diff_replay"](spark, str(tmp_path))
    assert done.rdd.getNumPartitions() == 3
    want = registry.licensed(spark, str(tmp_path)).select("file_id", dedup.sha(license.normalised(F.col("content"))).alias("sha"))
    assert done.count() == 45_000 and done.exceptAll(want).isEmpty()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_diff_is_shortest_and_replays(a, b):
    ops = linediff.diff(a, b)
    assert linediff.apply_ops(a, ops) == b
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
    assert sum(len(x) for k, x in ops if k != "=") == len(a) + len(b) - 2 * n[-1][-1]
    assert all(x != y for (x, _), (y, _) in zip(ops, ops[1:], strict=False))


def test_diff_overflow():
    with pytest.raises(ValueError):
        linediff.apply_ops(["a"], [("=", ["a", "b"])])
    assert linediff.diff([], []) == [] and linediff.diff([], ["x"]) == [("+", ["x"])] and linediff.diff(["x"], []) == [("-", ["x"])]


def test_quick_signature(spark):
    big = b"a" * 32768
    cases = [b"x", big, big[:16000] + b"b" + big[16001:], b"c" * 8192, b"c" * 8191 + b"d", b"", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "c binary").select(dedup.quick_signature(F.col("c"))).collect()]
    assert got[1] == got[2] and got[3] != got[4] and got[5] == got[6] and all(len(g) == 32 for g in got)


def test_numbering_needs_no_single_task(spark):
    rng = random.Random(1)
    data = [(rng.randrange(50), i) for i in range(3000)]
    got = numbered(spark.createDataFrame(data, "a int, b int"), [F.col("a"), F.col("b")], "n", F.col("a"), "before").orderBy("n").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(data) and [r["n"] for r in got] == list(range(1, 3001))
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["a"]


@pytest.mark.parametrize("seed", range(3))
def test_pack(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 40, 99, 100, 101, 250]) for _ in range(200)]
    got = solid.pack(spark.createDataFrame(list(enumerate(sizes, 1)), "blob_id long, ulen long"), 100).orderBy("blob_id").collect()
    block, used = 0, 0
    for r, n in zip(got, sizes, strict=True):
        if used and n and used + n > 100:
            block, used = block + 1, 0
        assert (r["block_id"], r["block_offset"]) == (block, used)
        used += n


def test_sizes_and_paths(spark):
    df = spark.createDataFrame([("4MB",), ("512 kb",), ("12",), ("1GB",), ("0",), ("-1",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(fn.parse_byte_size(F.col("t"))).collect()] == [4 * MIB, 512 << 10, 12, 1 << 30, None, None, None, None, None]
    n = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 * MIB,), (3 << 30,)], "n long")
    assert [r[0] for r in n.select(fn.human_bytes(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 GB"]
    paths = ["a/b", "../x", "a/../../y", "a/../b", "", "..", "a//b/.", "....", "/etc/passwd"]
    p = spark.createDataFrame([(x,) for x in paths], "p string").select(fn.escapes("/srv/out", F.col("p")), fn.clean_path(F.col("p"))).collect()
    assert [r[0] for r in p] == [os.path.relpath(os.path.normpath("/srv/out/" + x), "/srv/out").startswith("..") and os.path.normpath("/srv/out/" + x).split("/")[:3] != ["", "srv", "out"] for x in paths]
    assert [r[1] for r in p] == [os.path.normpath(x) if x else "" for x in paths]


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    shared = b"the same bytes\n" * 30
    for name in ("a.txt", "b.txt", "sub/c.txt"):
        (src / name).write_bytes(shared)
    (src / "main.go").write_text("package main\n\treturn nil, err\n" * 20)
    (src / "LICENSE").write_text(fixed.LICENSES["MIT"].replace("[year] [fullname]", "2020 Ann") * 1 + "\n")
    (src / "empty").write_bytes(b"")
    os.symlink("a.txt", src / "link")
    os.chmod(src / "sub" / "c.txt", 0o600)
    os.utime(src / "sub", ns=(10**18, 10**18 + 123))
    return src


def test_tree_round_trip(spark, folder, tmp_path):
    entries = tree.with_content(tree.scan(spark, [str(folder)])).cache()
    kinds = {r["rel_path"]: r["kind"] for r in entries.collect()}
    assert kinds == {".": "dir", "a.txt": "file", "b.txt": "file", "sub": "dir", "sub/c.txt": "file", "main.go": "file", "LICENSE": "file", "empty": "file", "link": "link"}
    assert tree.source_stats(entries).first()["files"] == 6
    tree.write_tree(entries, str(tmp_path / "out"))
    for p, k in kinds.items():
        a, b = folder / p, tmp_path / "out" / p
        if k == "file":
            assert a.read_bytes() == b.read_bytes() and a.stat().st_mode == b.stat().st_mode and a.stat().st_mtime_ns == b.stat().st_mtime_ns
    assert os.readlink(tmp_path / "out" / "link") == "a.txt" and (tmp_path / "out" / "sub").stat().st_mtime_ns == 10**18 + 123


def test_roots_and_guards(spark, folder, tmp_path):
    other = tmp_path / "x" / "src"
    other.mkdir(parents=True)
    for bad in ([], ["/"], [str(folder), str(other)]):
        with pytest.raises(ValueError):
            tree.resolve_roots(bad)
    with pytest.raises(FileNotFoundError):
        tree.resolve_roots([str(tmp_path / "none")])
    (tmp_path / "y").mkdir()
    names = {r["rel_path"] for r in tree.scan(spark, [str(folder), str(tmp_path / "y")]).collect()}
    assert "src/sub/c.txt" in names and "y" in names and "." not in names
    rows = spark.createDataFrame([("../x", "file", None)], "rel_path string, kind string, link_target string")
    with pytest.raises(Exception, match="outside the destination"):
        tree.guarded(rows, "/srv/out").collect()
    rows = spark.createDataFrame([("a/b", "link", "../../x")], "rel_path string, kind string, link_target string")
    with pytest.raises(Exception, match="outside the destination"):
        tree.guarded(rows, "/srv/out").collect()


def test_archive(spark, folder, tmp_path):
    files = tree.with_content(tree.scan(spark, [str(folder)])).where("kind = 'file'").withColumn("content", F.col("content").cast("string"))
    files = numbered(files.select("rel_path", "content", "size"), [F.col("rel_path")], "file_id")
    known, words = license.templates(spark), lines.line_dictionary(lines.line_frequency(files))
    built = archive.build(files, words, known, block_bytes=512)
    store.save(built, str(tmp_path / "cat"))
    again = store.load(spark, str(tmp_path / "cat"))
    assert again.entries.count() == 7 and again.blobs.count() == 4  # the text, the lines, the notice, nothing
    log = {r["rel_path"]: r["transform_id"] for r in again.plan_log.join(files.select("file_id", "rel_path"), "file_id").collect()}
    assert log["sub/c.txt"] == "dedup/v1" and log["main.go"] == "go-line-subst/v1" and log["empty"] is None
    back = {r["rel_path"]: r["content"] for r in archive.restore(again, words).where("kind = 'file'").collect()}
    assert back == {r["rel_path"]: r["content"] for r in files.collect()}
    view = catalog.ratios(catalog.overview(again.entries, again.blobs)).first()
    assert view["entries"] == 7 and view["blobs"] == 4 and view["stored_bytes"] > 0
    wrong = catalog.Catalog(again.meta, again.names, again.entries.withColumn("transform", F.lit("other/v9")), again.blobs, again.entry_blobs, None, again.blocks)
    with pytest.raises(ValueError, match="unknown transforms"):
        archive.restore(wrong, words)


@pytest.mark.parametrize("options", [{"compressor": "none"}, {"train": "simple"}, {"train": "prescan", "keep_log": False}])
def test_tree_through_an_archive(spark, folder, tmp_path, options):
    for i in range(40):
        (folder / f"n{i}.txt").write_text(f"number {i}\n" + "words that all of these files share " * 40 + str(i * i))
    entries = staging.stage(tree.with_content(tree.scan(spark, [str(folder)])))
    built = archive.build(entries, block_bytes=0, **options)
    modes = {r["compressed"] for r in built.blobs.select("compressed").distinct().collect()}
    assert modes == ({0} if options.get("compressor") == "none" else {1, 2} if options["train"] == "simple" else {2})
    tree.write_tree(archive.restore(built), str(tmp_path / "back"))
    for r in entries.where("kind <> 'dir'").collect():
        a, b = folder / r["rel_path"], tmp_path / "back" / r["rel_path"]
        assert os.readlink(a) == os.readlink(b) if r["kind"] == "link" else a.read_bytes() == b.read_bytes()


def test_plan_skips_for_cost(spark):
    rows = [(1, "a.go", "x := 1", 1), (2, "LICENSE", "short", 2), (3, "b.txt", "x := 1", 3), (4, "c.txt", "", 4), (5, "d.txt", None, 5)]
    files = spark.createDataFrame(rows, "file_id long, rel_path string, content string, entry_id long").withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long"))
    words = spark.createDataFrame([], "line string, code int")
    got = {r["file_id"]: r for r in planner.plan(files, words, license.templates(spark)).collect()}
    assert got[1]["reason"] == "gain (0) <= cpu cost (0), skipped" and got[1]["transform_id"] == "go-line-subst/v1" and got[1]["applied"] == 0
    assert got[2]["reason"] == "gain (5) <= cpu cost (512), skipped"
    assert got[3]["transform"] == "dedup/v1" and got[3]["stored_sha"] == got[1]["stored_sha"]
    assert got[4]["reason"] == got[5]["reason"] == "no applicable transform" and got[4]["gain"] == 0


def test_staged_tables_are_removed(spark):
    path = staging.new_dir(spark, "x")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path)
    kept = {k: list(v) for k, v in staging._written.items()}
    staging._written[spark.sparkContext.applicationId] = [path]
    staging.release(spark)
    assert not os.path.exists(path)
    staging._written.update({k: [p for p in v if p != path] for k, v in kept.items()})
