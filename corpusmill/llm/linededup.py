"""Line dedup over levelled sorted runs of line hashes; DataFrame functions only.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased.  A run holds rows
``(h, n, first)``: the 64-bit hash of a key, how many documents of its batches hold it, and the smallest
id among these.  Runs of a level are appended to one table, bucketed and sorted by ``h``; as soon as a
level has ``fanout`` of them they are merged, bucket by bucket, into one run of the next level (sums of
``n``, least ``first``).  A line's hash is rewritten once a level, a lookup reads a logarithmic number of
tables, and neither merging nor looking up moves what the runs hold: only a batch is dealt out by ``h``.

:meth:`LineRuns.fresh_lines` is the incremental use: a new batch merge-anti-joins the runs, keeps what
they do not hold, and adds its own.  :func:`dedup_lines` takes a whole table in batches, in order of
ids: each batch merge-anti-joins the runs of lines known to be in ``min_docs`` documents, whose counts
need not go on, and adds its own to the others; compaction moves lines that have reached the count.  In
the end the runs are merged into one, and lines found in ``min_docs`` documents are removed.  A line's
smallest id comes in the first batch that holds it, so it is not lost with what the anti-join leaves out.

Rows are documents, whatever their ids: repeated rows count separately.  A null or empty text is one
empty line; empty keys are never dropped.  Other columns pass through.  Keys are equal if their hashes
are: among 10**11 distinct lines, 10**8 of them frequent, less than one line in all is taken for another.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.staging import join_side, new_dir, stage

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "h long, n long, first long"
#: Frequent lines up to which they are broadcast, by count; beyond, lines are joined under so many salts.
SIDE_ROWS, SALTS = 2_000_000, 16


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACE))
    # lower() changes other letters too, so it serves pure ASCII lines only
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hash(line: Column, min_chars: int) -> Column:
    """Null for a key shorter than ``min_chars`` code points."""
    key = line_key(line)
    return F.when(F.char_length(key) >= max(1, min_chars), F.xxhash64(key))


class LineRuns:
    """The runs below one folder of the shared store.

    ``enough``: lines of so many documents are kept apart, in ``frequent`` runs, as soon as a merge finds them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4, enough: int | None = None):
        self.spark, self.fanout, self.enough = spark, max(2, fanout), enough
        self.path = path or new_dir(spark, "line-runs")
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.tables: dict[str, str] = {}
        self.levels: list[int] = []  # runs in each level

    def _append(self, run: DataFrame, name: str) -> None:
        if name not in self.tables:
            self.tables[name] = f"line_runs_{uuid.uuid4().hex}"
        out = run.select("h", "n", "first").write.mode("append").format("parquet")
        out.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{self.tables[name]}").saveAsTable(self.tables[name])

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {self.tables.pop(name)}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.tables[name])

    def _merged(self, name: str) -> DataFrame:
        """The runs of a table as one; a bucket is merged where it lies."""
        return self.table(name).groupBy("h").agg(F.sum("n").alias("n"), F.min("first").alias("first"))

    def _add_run(self, run: DataFrame, level: int) -> None:
        """Runs come dealt out by ``h``, which is how buckets are written."""
        while len(self.levels) <= level:
            self.levels.append(0)
        self._append(run, f"level{level}")
        self.levels[level] += 1
        if self.levels[level] >= self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        whole, self.levels[level] = self._merged(f"level{level}"), 0
        if self.enough is not None:
            self._append(whole.where(F.col("n") >= self.enough), "frequent")
            whole = whole.where(F.col("n") < self.enough)
        self._add_run(whole, level + 1)
        self._drop(f"level{level}")

    def unseen(self, batch: DataFrame, *names: str) -> DataFrame:
        """Rows of ``batch (h, ...)`` that the tables of these names (none: all) do not hold."""
        for name in names or list(self.tables):
            if name in self.tables:
                batch = batch.join(self.table(name).select("h"), "h", "left_anti")
        return batch

    def merged(self) -> DataFrame:
        """``(h, n, first)`` over all runs, which become one."""
        if not self.tables:
            return self.spark.createDataFrame([], RUN)
        for name in [x for x in self.tables if x != "all"]:
            self._append(self._merged(name), "all")
            self._drop(name)
        self.levels = []
        return self._merged("all")

    def close(self) -> None:
        for name in list(self.tables):
            self._drop(name)

    def add(self, batch: DataFrame) -> None:
        """Add a batch ``(doc_id, hs)``: the distinct line hashes of each document."""
        own = batch.select("doc_id", F.explode("hs").alias("h"))
        run = own.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
        self._add_run(self.unseen(run, "frequent"), 0)

    def fresh_lines(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
        """``(doc_id, pos, line)``: lines that no run holds, each key's first of the batch by (id, position,
        line); lines without a key stay.  The batch's hashes are then added to the runs."""
        flat = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
        flat = stage(flat.withColumn("h", line_hash(F.col("line"), min_chars)), "batch-lines")
        keyed = flat.where("h is not null")
        # a hot line is one row of the batch before it meets the runs
        first = keyed.groupBy("h").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "pos", "line")).alias("f"))
        kept = self.unseen(first).select("f.doc_id", "f.pos", "f.line").unionByName(flat.where("h is null").select("doc_id", "pos", "line"))
        kept = stage(kept, "fresh-lines")
        self._add_run(keyed.groupBy("h").agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("first")), 0)
        return kept


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    batches: int = 4,
    fanout: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with the lines removed from the text, and ``n_lines``, ``n_dropped``.

    ``keep_first``: the documents with a line's smallest id keep it, so that no text leaves the corpus.
    A null text of which nothing is removed stays null.  Own columns clash with none of ``docs`` but
    ``n_lines`` and ``n_dropped``, which are replaced.
    """
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    rk = F.xxhash64(id_, text)
    hashes = F.array_distinct(F.filter(F.transform(lines_of(text), lambda x: line_hash(x, min_chars)), lambda h: h.isNotNull()))
    lines = stage(docs.select(id_.alias("doc_id"), rk.alias("rk"), hashes.alias("hs")), "line-hashes")
    runs = LineRuns(docs.sparkSession, fanout=fanout, enough=min_docs)
    # batches of about equal size in order of ids, null ids last; any cuts in this order are right
    cuts = sorted(set(lines.stat.approxQuantile("doc_id", [b / batches for b in range(1, batches)], 0.01))) if batches > 1 else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        after = F.lit(True) if low is None else F.col("doc_id") > int(low)
        runs.add(lines.where(F.coalesce(after & (F.lit(True) if high is None else F.col("doc_id") <= int(high)), F.lit(high is None))))
    frequent = stage(runs.merged().where(F.col("n") >= min_docs).select("h", "first"), "frequent-lines")
    runs.close()
    own = lines.select("doc_id", "rk", F.explode("hs").alias("h"))
    if frequent.count() <= SIDE_ROWS:
        found = own.join(join_side(frequent, SIDE_ROWS), "h")
    else:  # a line may be in a third of all documents
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = own.withColumn("salt", F.pmod(F.hash("rk"), F.lit(SALTS))).join(salted, ["h", "salt"])
    if keep_first:
        found = found.where(~F.col("first").eqNullSafe(F.col("doc_id")))
    hits = found.groupBy("rk").agg(F.collect_set("h").alias("hits"))
    # a key of another row could only add hashes of frequent lines, which go anyway
    joined = docs.drop("n_lines", "n_dropped").withColumn("__rk", rk).join(hits.select(F.col("rk").alias("__rk"), F.col("hits").alias("__hits")), "__rk", "left")
    kept = F.filter(lines_of(text), lambda x: ~F.coalesce(F.array_contains(F.col("__hits"), line_hash(x, min_chars)), F.lit(False)))
    kept = F.when(F.col("__hits").isNotNull(), kept)
    joined = joined.withColumn("__kept", kept).withColumn("n_lines", F.size(lines_of(text)).cast("long"))
    joined = joined.withColumn("n_dropped", F.when(F.col("__kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("__kept")).cast("long"))
    joined = joined.withColumn(text_col, F.when(F.col("__kept").isNull(), text).otherwise(F.array_join("__kept", "\n")))
    return joined.drop("__rk", "__hits", "__kept")
