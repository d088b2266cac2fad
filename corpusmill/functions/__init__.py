"""Small functions: tables and maps as constants, sizes in bytes, path guards, format sniffing."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that is a constant of the plan, so its size is known and no Python worker makes it."""
    names = [c.split()[0] for c in schema.split(", ")]
    data = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    typed = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{typed}>>")))


def lookup(pairs: dict[str, str]) -> Callable[[Column], Column]:
    """A function from a column to what a small constant map holds for it, or null; maps lie in buckets of a hash, so
    a look-up does not go through all pairs."""
    n = max(1, len(pairs) // 2)
    buckets: list[dict[str, str]] = [{} for _ in range(n)]
    for k, v in pairs.items():
        buckets[zlib.crc32(k.encode()) % n][k] = v
    index = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")
    return lambda key: F.try_element_at(F.get(index, F.pmod(F.crc32(key.cast("binary")), F.lit(n)).cast("int")), key)


def human_bytes(n: Column) -> Column:
    """``512 B``, ``1.5 KB``, ... with 1024 to the next unit; exact halves go to the even tenth."""

    def unit(k: int, name: str) -> Column:
        rest = n.bitwiseAND(F.lit((1 << k) - 1)) * 10
        down, left = F.shiftright(rest, k), rest.bitwiseAND(F.lit((1 << k) - 1))
        up = (left > 1 << (k - 1)) | ((left == 1 << (k - 1)) & (down % 2 == 1))
        tenths = F.shiftright(n, k) * 10 + down + up.cast("long")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {name}"))

    return F.when(n >= 1 << 30, unit(30, "GB")).when(n >= 1 << 20, unit(20, "MB")).when(n >= 1 << 10, unit(10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def parse_byte_size(text: Column) -> Column:
    """Bytes of ``4MB``, ``512 kb``, ``123``; null where the text is no positive size."""
    number = F.regexp_extract(F.upper(F.trim(text)), r"^([0-9]{1,15})\s*(GB|MB|KB|B)?$", 1)
    unit = F.regexp_extract(F.upper(F.trim(text)), r"^([0-9]{1,15})\s*(GB|MB|KB|B)?$", 2)
    factor = F.when(unit == "GB", 1 << 30).when(unit == "MB", 1 << 20).when(unit == "KB", 1 << 10).otherwise(1)
    value = F.when(number != "", number.cast("long"))
    return F.when(value > 0, F.try_multiply(value, factor.cast("long")))


def clean_path(path: Column) -> Column:
    """Lexical normal form: no empty or ``.`` parts, ``..`` resolved; leading ``..`` of a relative path stay."""
    parts = F.split(path, "/", -1)
    rooted = F.startswith(path, F.lit("/"))

    def step(acc: Column, x: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "..")
        return (
            F.when((x == "") | (x == "."), acc)
            .when((x == "..") & up, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when((x == "..") & rooted, acc)
            .otherwise(F.array_append(acc, x))
        )

    done = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(done, "/"))


def escapes(dest: str, rel_path: Column) -> Column:
    """Whether ``dest``/``rel_path`` lies outside the absolute folder ``dest``."""
    top = "/" + "/".join(p for p in dest.split("/") if p)
    full = clean_path(F.concat(F.lit(top.rstrip("/") + "/"), rel_path))
    return ~(F.startswith(full, F.lit(top.rstrip("/") + "/")) | (full == top))


def link_escapes(dest: str, rel_path: Column, target: Column) -> Column:
    """Whether a symlink's target, from the folder of the link, lies outside ``dest``; absolute targets inside are fine."""
    parts = F.split(rel_path, "/", -1)
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    top = "/" + "/".join(p for p in dest.split("/") if p)
    full = F.when(F.startswith(target, F.lit("/")), clean_path(target)).otherwise(clean_path(F.concat(F.lit(top.rstrip("/") + "/"), folder, F.lit("/"), target)))
    return ~(F.startswith(full, F.lit(top.rstrip("/") + "/")) | (full == top))


def sniff_format(content: Column, magic: bytes) -> Column:
    """``single``, ``split`` (an SQLite file) or null, by the leading bytes."""
    sqlite = b"SQLite format 3\x00"
    return F.when(F.substring(content, 1, len(magic)) == F.lit(magic), F.lit("single")).when(F.substring(content, 1, len(sqlite)) == F.lit(sqlite), F.lit("split"))


def footer_bytes(catalog_offset: Column, blob_offset: Column, checksum: Column) -> Column:
    """24 bytes: two offsets, big-endian, and the first 8 bytes of a checksum in hex digits."""
    big = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))
    return F.concat(big(catalog_offset), big(blob_offset), F.unhex(F.substring(checksum, 1, 16)))


def footer(content: Column) -> Column:
    """``(catalog_offset, blob_offset, checksum)`` of the last 24 bytes, big-endian; null below 32 bytes."""
    tail = F.hex(F.substring(content, -24, 24))
    number = lambda at: F.conv(F.substring(tail, at, 16), 16, 10).cast("decimal(20,0)").cast("long")
    return F.when(F.octet_length(content) >= 32, F.struct(number(1).alias("catalog_offset"), number(17).alias("blob_offset"), F.lower(F.substring(tail, 33, 16)).alias("checksum")))
