"""File trees as tables, and tables back to file trees."""

from __future__ import annotations

import logging
import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import functions as fn
from corpusmill.plans.staging import ship_package, stage

log = logging.getLogger(__name__)

ENTRY = "rel_path string, kind string, size long, mode long, mtime_ns long, uid long, gid long, link_target string, path string"


def resolve_roots(roots: list[str]) -> list[str]:
    """Absolute roots; an empty list, ``/``, a missing root, or two roots of one name are errors."""
    if not roots:
        raise ValueError("no source given")
    full = [os.path.abspath(r) for r in roots]
    seen: dict[str, str] = {}
    for r in full:
        name = os.path.basename(r)
        if not name:
            raise ValueError("/ cannot be a source")
        if not os.path.lexists(r):
            raise FileNotFoundError(r)
        if name in seen:
            raise ValueError(f"{seen[name]} and {r} have the same name")
        seen[name] = r
    return full


def _row(path: str, rel: str) -> tuple | None:
    """A node as a row; None for other kinds of node, and for one that cannot be looked at, which is logged."""
    try:
        s = os.lstat(path)
        kind = "dir" if stat.S_ISDIR(s.st_mode) else "link" if stat.S_ISLNK(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else None
        if kind is None:
            return None
        return (rel, kind, s.st_size if kind == "file" else 0, stat.S_IMODE(s.st_mode), s.st_mtime_ns, s.st_uid, s.st_gid, os.readlink(path) if kind == "link" else None, path)
    except OSError as e:
        log.warning("skipped %s: %s", path, e)
        return None


def _inside(path: str, rel: str) -> Iterator[tuple]:
    """The nodes of one directory; one that cannot be read is logged and has none."""
    try:
        names = sorted(os.listdir(path))
    except OSError as e:
        log.warning("skipped what is in %s: %s", path, e)
        return
    for name in names:
        row = _row(os.path.join(path, name), name if rel == "." else f"{rel}/{name}")
        if row is not None:
            yield row


def _walk(it: Iterator[pd.DataFrame], most: int = 5000) -> Iterator[pd.DataFrame]:
    """The nodes of directories, ``most`` at a time: many directories hold few."""
    columns, rows = [c.split()[0] for c in ENTRY.split(", ")], []
    for pdf in it:
        for path, rel in pdf[["path", "rel_path"]].itertuples(index=False):
            for row in _inside(path, rel):
                rows.append(row)
                if len(rows) == most:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
    yield pd.DataFrame(rows, columns=columns)


def scan(spark: SparkSession, roots: list[str], tasks: int = 64) -> DataFrame:
    """Files, directories and symlinks below the roots, without content; other nodes are left out.

    One root is listed relative to itself (itself as ``.``), several below their names.  Executors, which
    must see the same mount, read one level of directories after the other, dealt out anew each time, so a
    deep root is no single task.  What cannot be read is logged and left out; a missing root is an error.
    """
    ship_package(spark)
    full = resolve_roots(roots)
    tops = [row for r in full if (row := _row(r, "." if len(full) == 1 else os.path.basename(r))) is not None]
    level = spark.createDataFrame(tops, ENTRY)
    found = level
    while not (dirs := level.where("kind = 'dir'")).isEmpty():
        level = stage(dirs.repartition(tasks, "path").mapInPandas(_walk, ENTRY), "scan")
        found = found.unionByName(level)
    return found


def contents(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """``(path, size, content)`` of all files below a folder of any store that Spark reads."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).select("path", F.col("length").alias("size"), "content")


def with_content(entries: DataFrame) -> DataFrame:
    """Add ``content``: the bytes of regular files, read where the row is."""
    ship_package(entries.sparkSession)

    @F.pandas_udf("binary")
    def read(paths: pd.Series) -> pd.Series:
        def one(p: str) -> bytes:
            with open(p, "rb") as f:
                return f.read()

        return paths.map(one, na_action="ignore")

    return entries.withColumn("content", read(F.when(F.col("kind") == "file", F.col("path"))))


def source_stats(entries: DataFrame) -> DataFrame:
    return entries.where("kind = 'file'").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def guarded(entries: DataFrame, dest: str) -> DataFrame:
    """Fail the job on a path or a link target outside ``dest``."""
    bad = fn.escapes(dest, F.col("rel_path")) | (F.col("link_target").isNotNull() & fn.link_escapes(dest, F.col("rel_path"), F.col("link_target")))
    return entries.withColumn("rel_path", F.when(bad, F.raise_error(F.concat(F.lit("outside the destination: "), "rel_path"))).otherwise(F.col("rel_path")))


def write_tree(entries: DataFrame, dest: str) -> None:
    """Write ``(rel_path, kind, mode, mtime_ns, uid, gid, link_target, content)`` below ``dest``, a mount that
    executors share; owners are optional.

    Directories first, then files and links, then the directories' owners, modes and times.  An owner that
    may not be set is logged and left.
    """
    ship_package(entries.sparkSession)
    top = os.path.abspath(dest)
    owner = [F.col(c) if c in entries.columns else F.lit(None).cast("long").alias(c) for c in ("uid", "gid")]
    safe = guarded(entries, top).select("rel_path", "kind", "mode", "mtime_ns", *owner, "link_target", F.when(F.col("kind") == "file", F.col("content").cast("binary")).alias("content"))

    def put(rows) -> None:
        for r in rows:
            path = os.path.normpath(os.path.join(top, r.rel_path))
            os.makedirs(path if r.kind == "dir" else os.path.dirname(path), exist_ok=True)
            if r.kind == "link":
                if os.path.lexists(path):
                    os.unlink(path)
                os.symlink(r.link_target, path)
                _own(path, r)
            elif r.kind == "file":
                with open(path, "wb") as f:
                    f.write(r.content or b"")
                _touch(path, r)

    def times(rows) -> None:
        for r in rows:
            _touch(os.path.normpath(os.path.join(top, r.rel_path)), r)

    os.makedirs(top, exist_ok=True)
    safe.where("kind = 'dir'").select("rel_path", "kind").foreachPartition(put)
    safe.where("kind <> 'dir'").foreachPartition(put)
    safe.where("kind = 'dir'").select("rel_path", "mode", "mtime_ns", "uid", "gid").foreachPartition(times)


def _own(path: str, r) -> None:
    """Before the mode, since a change of owner clears bits of it."""
    if r.uid is None or r.gid is None:
        return
    try:
        os.lchown(path, r.uid, r.gid)
    except (OSError, OverflowError) as e:
        log.debug("owner of %s stays: %s", path, e)


def _touch(path: str, r) -> None:
    _own(path, r)
    if r.mode is not None:
        os.chmod(path, r.mode & 0o7777)
    if r.mtime_ns:
        os.utime(path, ns=(r.mtime_ns, r.mtime_ns))
