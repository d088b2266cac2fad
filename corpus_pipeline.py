"""A pipeline from raw documents to token ids, each stage one of the operators of ``corpusmill.llm``.

Every stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet and reread as the
next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import linededup, mixing, neardup, quality, sentencepiece
from corpusmill.plans.staging import ship_package, stage

#: Documents that score below are rejected.
LEAST_QUALITY = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: learned from the labelled rows that are not held out; rejected documents go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model, LEAST_QUALITY)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: a line of ten documents or more stays in the document with the smallest id only."""
    done = linededup.dedup_lines(docs, min_docs=10, keep_first=True)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: five words, similarity 0.8; of each group the smallest id stays, once.

    Texts without a word are in no group and stay.
    """
    found = neardup.near_duplicates(docs, width=5, pct=80)
    chosen = found.where("root_fp is not null").groupBy("root_fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("one"))
    chosen = chosen.select(F.col("one.doc_id").alias("__id"), F.col("one.rid").alias("__rid"))
    keyed = docs.withColumns({"__id": F.col("doc_id"), "__rid": F.xxhash64("text")})
    no_word = ~F.coalesce(F.rlike("text", F.lit(mixing.WORD)), F.lit(False))
    some = keyed.where(~no_word).join(chosen, keyed["__id"].eqNullSafe(chosen["__id"]) & (keyed["__rid"] == chosen["__rid"]), "left_semi")
    return some.dropDuplicates(["__id", "__rid"]).select(*docs.columns).unionByName(docs.where(no_word))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents as often as the mix takes them, repeats as repeated rows."""
    return mixing.emit(docs, mixing.mix(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row, with a check that they decode to the text."""
    return sentencepiece.encode(docs, sentencepiece.load())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_near),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL cannot express the first, third and last stage; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
