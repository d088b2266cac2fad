"""Line frequencies, a line dictionary, and reversible substitution of dictionary lines.

Lines are separated by ``\\n``; for frequencies, leading blanks and tabs are stripped, and lines of
more than 5 bytes count.  A dictionary maps up to 254 lines to single bytes that are neither 0x00 nor
0x0A; an encoded line is its indent, a 0x00 and that byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill import functions as fn
from corpusmill.operators.fixed import GO_LINES

MOST_ENTRIES = 254


def split_lines(content: Column) -> Column:
    return F.split(F.coalesce(content, F.lit("")), "\n", -1)


def bare(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t"))


def line_frequency(files: DataFrame, min_count: int = 3) -> DataFrame:
    """``(line, n)``: stripped lines longer than 5 bytes that occur at least ``min_count`` times.

    A trailing carriage return is not part of a line.
    """
    lines = files.select(F.explode(split_lines(F.col("content"))).alias("l")).select(bare(F.when(F.endswith("l", F.lit("\r")), F.left("l", F.length("l") - 1)).otherwise(F.col("l"))).alias("line"))
    return lines.where(F.octet_length("line") > 5).groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def top_lines(frequency: DataFrame, k: int = 50) -> DataFrame:
    return frequency.orderBy(F.desc("n"), "line").limit(k)


def code_of(index: Column) -> Column:
    """Byte of a 0-based entry: skips 0x00 and 0x0A."""
    b = index + 1
    return F.when(b >= 10, b + 1).otherwise(b)


def index_of(code: Column) -> Column:
    """Entry of a byte; null for bytes that code nothing."""
    return F.when((code > 0) & (code < 10), code - 1).when((code > 10) & (code <= 255), code - 2)


def line_dictionary(frequency: DataFrame, entries: int = MOST_ENTRIES) -> DataFrame:
    """``(idx, line, code)``: the commonest lines, at most 254."""
    top = top_lines(frequency, min(entries, MOST_ENTRIES))  # a top-k before the window
    ranked = top.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("n"), "line")) - 1)
    return ranked.select("idx", "line", code_of(F.col("idx")).alias("code"))


def fixed_dictionary(spark: SparkSession) -> DataFrame:
    """``(idx, line, code)`` of the lines of Go sources that ``go-line-subst/v1`` stands for."""
    rows = fn.literal_table(spark, list(enumerate(GO_LINES)), "idx int, line string")
    return rows.withColumn("code", code_of(F.col("idx")))


def pairs(dictionary: DataFrame) -> list[tuple[str, str]]:
    """Lines and the characters that stand for them, at most 254; a dictionary that is dear to compute is staged first."""
    return [(r["line"], chr(r["code"])) for r in dictionary.select("line", "code").collect()]


def encode(files: DataFrame, dictionary: DataFrame, name: str = "encoded", content: str = "content") -> DataFrame:
    """Add the encoded content; null where the content holds a 0x00 or is no valid UTF-8 and cannot be encoded."""
    there = fn.lookup({line: f"\x00{code}" for line, code in pairs(dictionary)})

    def one(line: Column) -> Column:
        hit = there(bare(line))
        indent = F.substring(line, F.lit(1), F.length(line) - F.length(bare(line)))
        return F.when(hit.isNotNull(), F.concat(indent, hit)).otherwise(line)

    text = F.coalesce(F.col(content), F.lit(""))
    body = F.array_join(F.transform(split_lines(text), one), "\n")
    return files.withColumn(name, F.when(~F.contains(text, F.lit("\x00")) & F.is_valid_utf8(text), body))


def decode(files: DataFrame, dictionary: DataFrame, encoded: str = "encoded", name: str = "decoded") -> DataFrame:
    """Invert :func:`encode`; a line whose byte codes nothing stays as it is."""
    back = fn.lookup({code: line for line, code in pairs(dictionary)})

    def one(line: Column) -> Column:
        at = F.instr(line, "\x00")
        hit = F.when(at > 0, back(F.substring(line, at + 1, F.lit(1))))
        return F.when(hit.isNotNull(), F.concat(F.substring(line, F.lit(1), at - 1), hit)).otherwise(line)

    return files.withColumn(name, F.array_join(F.transform(split_lines(F.col(encoded)), one), "\n"))


def encoded_bytes(encoded: Column) -> Column:
    """Size in the byte coding: a code is one byte there, while codes above 127 take two in a string."""
    two = F.regexp_count(encoded, F.lit("\x00[\u0080-ÿ]"))
    return (F.octet_length(encoded) - two).cast("long")
