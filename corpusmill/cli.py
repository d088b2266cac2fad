"""Command line: archive, extract, inspect, bench, analyze."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpusmill
from corpusmill.operators import catalog, lines, solid
from corpusmill.plans import archive, report
from corpusmill.plans import rules as R
from corpusmill.plans.staging import release, shared_dir, stage
from corpusmill.sources import packed, store, tree

MAGIC = b"CRPSMILL"


def session(workers: int | None) -> SparkSession:
    """The session that is there, one of ``spark-submit``, or a local one with so many threads."""
    builder = SparkSession.builder.appName("corpusmill")
    if workers or not os.environ.get("SPARK_ENV_LOADED"):
        builder = builder.master(f"local[{workers or '*'}]")
    spark = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def open_archive(spark: SparkSession, path: str, check: bool = False) -> catalog.Catalog:
    """A stored catalog (a folder with a manifest) or a packed archive (a file)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        raise ValueError(f"{path}: no archive")
    if fs.getFileStatus(target).isDirectory():
        if check and (wrong := store.verify(spark, path)):
            raise ValueError(f"{path}: {wrong}")
        return store.load(spark, path)
    return packed.read_packed(spark, path, check=check)


def build(spark: SparkSession, sources: list[str], a: argparse.Namespace) -> tuple[catalog.Catalog, DataFrame]:
    entries = stage(tree.scan(spark, sources), "tree")
    known = {r.id for r in R.ALL}
    if unknown := sorted(set(a.disable_transform) - known):
        raise ValueError(f"unknown transforms: {unknown}")
    block = 0 if a.no_solid else report.size_of(a.solid_block_size)
    built = archive.build(tree.with_content(entries), disabled=tuple(a.disable_transform), block_bytes=block, compressor=a.final_compressor, train=a.dict_compress or None)
    return built, entries


def cmd_archive(spark: SparkSession, a: argparse.Namespace) -> None:
    built, _ = build(spark, a.source, a)
    log = built.plan_log
    if not a.keep_plan_log:
        built.plan_log = None
    if a.packed:
        packed.write_packed(built, a.out, MAGIC)
    else:
        store.save(built, a.out)
    print(report.overview_text(report.overview(built)))
    if a.explain:
        print(report.rules_text(report.rule_counts(log)))


def cmd_extract(spark: SparkSession, a: argparse.Namespace) -> None:
    restored = archive.restore(open_archive(spark, a.archive, a.verify))
    tree.write_tree(restored, a.dest)


def cmd_inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    c = open_archive(spark, a.archive, a.verify)
    if a.plan_log:
        if c.plan_log is None:
            raise ValueError("the archive has no plan log; make it with --keep-plan-log")
        if a.raw:
            for r in c.plan_log.orderBy("entry_id").toLocalIterator():
                print(r["entry_id"], r["transform_id"] or "raw", r["gain"], r["cost"], r["applied"], r["reason"], sep="\t")
        else:
            print(report.rules_text(report.rule_counts(c.plan_log)))
        return
    view = report.overview(c)
    if os.path.isfile(a.archive):
        view |= packed.layout(spark, a.archive)
    print(json.dumps(view) if a.raw else report.overview_text(view) + "".join(f"\n{k:<12}{report.human(view[k])}" for k in ("bytes", "blob_region", "catalog", "overhead") if k in view))


def bench(spark: SparkSession, sources: list[str], a: argparse.Namespace) -> dict[str, Any]:
    """Make an archive of the sources and restore it, both in the shared folder, and tell what it took."""
    top = f"{shared_dir(spark).removeprefix('file:')}/bench-{uuid.uuid4().hex}"

    def make() -> tuple[catalog.Catalog, DataFrame]:
        built, entries = build(spark, sources, a)
        store.save(built, f"{top}/archive")
        return built, entries

    try:
        (built, entries), archive_s = report.timed(make)
        source = tree.source_stats(entries).first()
        _, extract_s = report.timed(lambda: tree.write_tree(archive.restore(store.load(spark, f"{top}/archive")), f"{top}/back"))
        payload = built.blocks.agg(F.coalesce(F.sum("clen"), F.lit(0)).alias("n")).first()["n"]
        size = report.stored_bytes(spark, f"{top}/archive")
        out = {"files": source["files"], "source_bytes": source["bytes"], "archive_bytes": size, "payload_bytes": payload, "archive_s": round(archive_s, 3), "extract_s": round(extract_s, 3)}
        return out | report.rates(source["bytes"], size, archive_s, extract_s) | {"peak_memory_bytes": report.peak_memory(spark), "rules": report.rule_counts(built.plan_log)}
    finally:
        shutil.rmtree(top, ignore_errors=True)


def cmd_bench(spark: SparkSession, a: argparse.Namespace) -> None:
    out = bench(spark, a.source, a)
    text = json.dumps(out) if a.json else "\n".join([*(f"{k:<20}{report.human(v) if k.endswith('bytes') else v}" for k, v in out.items() if k != "rules"), report.rules_text(out["rules"])])
    if a.output:
        with open(a.output, "w") as f:
            f.write(text + "\n")
    else:
        print(text)


def cmd_analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    files = None
    for folder in a.folder:
        own = tree.contents(spark, folder, a.pattern).select(F.col("content").cast("string").alias("content"))
        files = own if files is None else files.unionByName(own)
    for n, line in report.line_report(lines.line_frequency(files), a.n):
        print(f"{n}\t{line}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusmill", description="Archives of file trees on Spark")
    p.add_argument("--version", action="store_true", help="show the version, with -v the state of every rule")
    p.add_argument("-v", "--verbose", action="store_true")
    commands = p.add_subparsers(dest="command")

    def command(name: str, f, help_: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=help_)
        c.set_defaults(run=f)
        c.add_argument("--workers", type=int, help="threads of a local session")
        return c

    def making(c: argparse.ArgumentParser) -> None:
        c.add_argument("--final-compressor", "--compressor", choices=("zstd", "none"), default="zstd", help="of blobs that are in no block")
        c.add_argument("--dict-compress", choices=("prescan", "simple"), default="", help="train a dictionary for blobs that are in no block")
        c.add_argument("--no-solid", action="store_true", help="store every blob on its own")
        c.add_argument("--solid-block-size", default=f"{solid.DEFAULT_BLOCK >> 20}MB")
        c.add_argument("--disable-transform", action="append", default=[], metavar="ID")

    c = command("archive", cmd_archive, "make an archive of file trees")
    c.add_argument("out")
    c.add_argument("source", nargs="+")
    making(c)
    c.add_argument("--packed", action="store_true", help="write one file instead of a folder of tables")
    c.add_argument("--keep-plan-log", action="store_true")
    c.add_argument("--explain", action="store_true", help="show what each rule did")
    c = command("extract", cmd_extract, "restore the tree of an archive")
    c.add_argument("archive")
    c.add_argument("-C", "--dest", default=".")
    c.add_argument("--verify", action="store_true", help="compare checksums first")
    c = command("inspect", cmd_inspect, "show what an archive holds")
    c.add_argument("archive")
    c.add_argument("--plan-log", action="store_true")
    c.add_argument("--raw", action="store_true")
    c.add_argument("--verify", action="store_true", help="compare checksums first")
    c = command("bench", cmd_bench, "time making and restoring an archive")
    c.add_argument("source", nargs="+")
    making(c)
    c.add_argument("--output")
    c.add_argument("--json", action="store_true")
    c = command("analyze", cmd_analyze, "show the commonest lines")
    c.add_argument("folder", nargs="+")
    c.add_argument("--pattern")
    c.add_argument("-n", type=int, default=50)
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.version:
        print(f"corpusmill {corpusmill.__version__}")
        if a.verbose:
            for _, rule, state, lossless in R.states():
                print(f"  {rule:<24}{state:<10}{'lossless' if lossless else 'lossy'}")
        return 0
    if not a.command:
        p.print_help()
        return 2
    spark = session(a.workers)
    try:
        a.run(spark, a)
    except (ValueError, OSError) as e:
        print(f"corpusmill: {e}", file=sys.stderr)
        return 1
    finally:
        release(spark)
    return 0
