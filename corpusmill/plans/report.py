"""What an archive holds and what making it took, as dictionaries and as text."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import catalog
from corpusmill.plans import planner


def size_of(text: str) -> int:
    """Bytes of ``4MB``, ``512 kb``, ``123``; a ``ValueError`` for anything that is no positive size."""
    m = re.fullmatch(r"([0-9]{1,15})\s*(GB|MB|KB|B)?", text.strip().upper())
    value = int(m[1]) << {"GB": 30, "MB": 20, "KB": 10}.get(m[2] or "", 0) if m else 0
    if value <= 0:
        raise ValueError(f"no size: {text}")
    return value


def human(n: int) -> str:
    for shift, unit in ((30, "GB"), (20, "MB"), (10, "KB")):
        if n >= 1 << shift:
            return f"{n / (1 << shift):.1f} {unit}"
    return f"{n} B"


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path of any store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def peak_memory(spark: SparkSession) -> int:
    """Bytes that the driver's JVM has held at most; 0 where the system does not tell."""
    pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    try:
        with open(f"/proc/{pid}/status") as f:
            return next((int(line.split()[1]) << 10 for line in f if line.startswith("VmHWM")), 0)
    except OSError:
        return 0


def rule_counts(log: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict() for r in planner.summary(log).orderBy("transform").collect()]  # a row a rule


def overview(c: catalog.Catalog) -> dict[str, Any]:
    view = catalog.ratios(catalog.overview(c.entries, c.blobs)).first().asDict()
    kinds = {r["kind"]: r["count"] for r in c.entries.groupBy("kind").count().collect()}  # three kinds
    return view | {"files": kinds.get("file", 0), "dirs": kinds.get("dir", 0), "links": kinds.get("link", 0)}


def overview_text(o: dict[str, Any]) -> str:
    rows = [("entries", f"{o['entries']} ({o['files']} files, {o['dirs']} directories, {o['links']} links)"), ("blobs", f"{o['blobs']} in {o['blocks']} blocks"), ("original", human(o["original_bytes"]))]
    rows += [("unique", f"{human(o['unique_bytes'])}, {o['unique_pct']:.1f} %"), ("stored", f"{human(o['stored_bytes'])}, {o['stored_pct']:.1f} %")]
    return "\n".join(f"{k:<10}{v}" for k, v in rows)


def rules_text(rules: list[dict[str, Any]]) -> str:
    head = f"{'rule':<24}{'applied':>10}{'skipped':>10}{'gain':>12}"
    total = f"{sum(r['applied'] + r['skipped'] for r in rules)} files, {sum(r['applied'] for r in rules)} under a rule"
    return "\n".join([head, *(f"{r['transform']:<24}{r['applied']:>10}{r['skipped']:>10}{human(r['gain']):>12}" for r in rules), total])


def timed(f: Callable[[], Any]) -> tuple[Any, float]:
    began = time.perf_counter()
    return f(), time.perf_counter() - began


def rates(source_bytes: int, archive_bytes: int, archive_s: float, extract_s: float) -> dict[str, float]:
    """Throughput in MB (2**20) a second and size as a share; 0 for an empty source."""
    speed = lambda s: float(f"{source_bytes / (1 << 20) / s:.4g}") if s > 0 else 0.0
    return {"archive_mb_s": speed(archive_s), "extract_mb_s": speed(extract_s), "ratio_pct": round(100 * archive_bytes / source_bytes, 2) if source_bytes else 0.0}


def line_report(frequency: DataFrame, k: int) -> list[tuple[int, str]]:
    return [(r["n"], r["line"]) for r in frequency.orderBy(F.desc("n"), "line").limit(k).collect()]  # a report of k lines
