"""Registered queries over the table folder and, for each, DuckDB SQL with the same result.

``documents`` stand in for a tree of files, ``events`` for logs and JSON files, ``pages`` for paths, and
``customer`` for licence holders.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import functions as fn
from corpusmill.operators import canonical, catalog, dedup, fixed, license, linediff, lines, solid
from corpusmill.operators.ordering import numbered
from corpusmill.plans import archive, planner
from corpusmill.plans import rules as R
from corpusmill.plans.staging import dealt_out, local_dir, new_dir, ship_package, small_batches, stage
from corpusmill.sources import packed as packed_source
from corpusmill.sources import store as store_source
from corpusmill.sources import tree as tree_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BLOCK = 64 << 10
#: Whole contents that Python is handed at once, within the bytes of a batch.
WHOLE_ROWS = 256
#: Templates whose texts customers hold in the licence queries.
HELD_NAMES = ("MIT", "ISC")


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    kind = F.col("doc_id") % 6
    end = F.when(kind == 0, ".txt").when(kind == 1, ".go").when(kind == 2, ".json").when(kind == 3, ".log").when(kind == 4, "/LICENSE").otherwise("")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), end))
    return d.select(F.col("doc_id").alias("file_id"), path.alias("rel_path"), text.alias("content"), F.octet_length(text).cast("long").alias("size"))


FILES = """files AS (SELECT doc_id AS file_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id ||
    CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.go' WHEN 2 THEN '.json' WHEN 3 THEN '.log' WHEN 4 THEN '/LICENSE' ELSE '' END AS rel_path,
    coalesce(text, '') AS content, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha FROM documents)"""
LINES = """rawlines AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM files),
    freq AS (SELECT ltrim(line, ' ' || chr(9)) AS line, count(*) AS n FROM rawlines GROUP BY 1 HAVING octet_length(encode(ltrim(line, ' ' || chr(9)))) > 5 AND count(*) > 2),
    dict AS (SELECT line, row_number() OVER (ORDER BY n DESC, line) - 1 AS idx FROM freq QUALIFY idx < 254),
    codes AS (SELECT line, idx, CASE WHEN idx + 1 >= 10 THEN idx + 2 ELSE idx + 1 END AS code FROM dict)"""
ENCODED = """enc AS (SELECT r.file_id, string_agg(CASE WHEN c.line IS NULL THEN r.line ELSE left(r.line, length(r.line) - length(c.line)) || chr(0) || chr(CAST(c.code AS INTEGER)) END, chr(10) ORDER BY pos) AS encoded,
      count(c.line) AS hits, count(*) AS n_lines, coalesce(sum(CASE WHEN c.code > 127 THEN 1 ELSE 0 END), 0) AS wide
    FROM rawlines r LEFT JOIN codes c ON ltrim(r.line, ' ' || chr(9)) = c.line GROUP BY r.file_id)"""
TREE = """parts AS (SELECT *, string_split(rel_path, '/') AS p FROM files),
    dirs AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS rel_path FROM (SELECT p, unnest(range(1, len(p))) AS i FROM parts)),
    every AS (SELECT rel_path, 'file' AS kind, file_id, size FROM files UNION ALL SELECT rel_path, 'dir', NULL, 0 FROM dirs),
    scanned AS (SELECT *, row_number() OVER (ORDER BY string_split(rel_path, '/')) AS seq FROM every),
    ordered AS (SELECT *, row_number() OVER (ORDER BY kind <> 'dir', CASE WHEN kind = 'dir' THEN '' ELSE regexp_extract(regexp_extract(rel_path, '[^/]*$'), '(\\.[^.]*)$', 1) END, seq) AS entry_id FROM scanned)"""
PLAN = f"""{FILES}, {LINES}, {ENCODED}, {TREE},
    own AS (SELECT f.file_id, o.entry_id, f.size, f.rel_path, f.sha, f.rel_path LIKE '%.go' AND f.size > 0 AS go_may, f.size // 10 > f.size // 1024 AS go_pays, encoded FROM files f JOIN ordered o USING (file_id) JOIN enc USING (file_id)),
    stored AS (SELECT *, CASE WHEN go_may AND go_pays THEN sha256(encoded) ELSE sha END AS own_sha FROM own),
    firsts AS (SELECT own_sha, min(entry_id) AS first FROM stored GROUP BY 1),
    lic AS (SELECT s.*, regexp_matches(regexp_extract(rel_path, '[^/]*$'), '(?i)^(licen[cs]e|copying|notice)(\\..+)?$') AS lic_may, coalesce(f.first < s.entry_id, false) AND size > 0 AS hit FROM stored s LEFT JOIN firsts f ON s.sha = f.own_sha),
    log AS (SELECT *, CASE WHEN hit THEN 'dedup/v1' WHEN go_may AND go_pays THEN 'go-line-subst/v1' END AS transform,
        CASE WHEN lic_may AND size <= 512 THEN 'license-canonical/v1' WHEN go_may AND NOT go_pays THEN 'go-line-subst/v1' WHEN false THEN '' END AS skip FROM lic),
    plan_log AS (SELECT file_id, entry_id, coalesce(transform, skip) AS transform_id, CAST(transform IS NOT NULL AS INTEGER) AS applied,
        CASE WHEN transform = 'dedup/v1' THEN size WHEN transform IS NOT NULL THEN size // 10 WHEN skip = 'license-canonical/v1' THEN size WHEN skip IS NOT NULL THEN size // 10 ELSE 0 END AS gain,
        CASE WHEN transform IS NOT NULL THEN size // 1024 WHEN skip = 'license-canonical/v1' THEN 512 WHEN skip IS NOT NULL THEN size // 1024 ELSE 0 END AS cost,
        CASE WHEN hit THEN sha ELSE own_sha END AS stored_sha,
        CASE WHEN transform IS NOT NULL THEN transform || ' selected' WHEN skip = 'license-canonical/v1' THEN 'gain (' || size || ') <= cpu cost (512), skipped'
             WHEN skip IS NOT NULL THEN 'gain (' || size // 10 || ') <= cpu cost (' || size // 1024 || '), skipped' ELSE 'no applicable transform' END AS reason FROM log)"""
BLOBS = f"""{PLAN},
    sizes AS (SELECT own_sha AS s, max(CASE WHEN go_may AND go_pays THEN octet_length(encode(encoded)) ELSE size END) AS ulen FROM stored GROUP BY 1),
    blobs AS (SELECT row_number() OVER (ORDER BY min(entry_id)) AS blob_id, stored_sha AS sha, any_value(ulen) AS ulen, min(entry_id) AS first_entry FROM plan_log JOIN sizes ON s = stored_sha GROUP BY stored_sha)"""
UNIQUE = f"{FILES}, ids AS (SELECT sha, row_number() OVER (ORDER BY min(file_id)) AS blob_id, max(size) AS ulen FROM files GROUP BY sha)"
PACKED = f"""{UNIQUE}, packed AS (SELECT blob_id, ulen, 0 AS block_id, 0 AS block_offset, ulen AS used FROM ids WHERE blob_id = 1 UNION ALL
    SELECT i.blob_id, i.ulen, CASE WHEN p.used > 0 AND i.ulen > 0 AND p.used + i.ulen > {BLOCK} THEN p.block_id + 1 ELSE p.block_id END,
      CASE WHEN p.used > 0 AND i.ulen > 0 AND p.used + i.ulen > {BLOCK} THEN 0 ELSE p.used END,
      CASE WHEN p.used > 0 AND i.ulen > 0 AND p.used + i.ulen > {BLOCK} THEN i.ulen ELSE p.used + i.ulen END
    FROM packed p JOIN ids i ON i.blob_id = p.blob_id + 1)"""


# --- hashing and exact dedup


@query(f"WITH {FILES} SELECT file_id, size, sha FROM files")
def content_hash(spark, sf):
    return dedup.with_hash(corpus(spark, sf)).select("file_id", "size", "sha")


@query(f"WITH {FILES} SELECT sha, min(file_id) AS first_id, count(*) AS copies, max(size) AS size FROM files GROUP BY sha")
def dedup_blobs(spark, sf):
    return dedup.unique_blobs(dedup.with_hash(corpus(spark, sf)))


@query(f"WITH {FILES}, r AS (SELECT file_id, sha, first_value(file_id) OVER (PARTITION BY sha ORDER BY file_id) AS first_id FROM files) SELECT file_id, first_id, sha FROM r WHERE file_id <> first_id")
def dedup_duplicates(spark, sf):
    return dedup.duplicates(dedup.with_hash(corpus(spark, sf)))


@query(f"""WITH {FILES}, u AS (SELECT sha, max(size) AS size FROM files GROUP BY sha)
    SELECT (SELECT count(*) FROM files) AS entries, (SELECT count(*) FROM u) AS blobs, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM files) AS original_bytes, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM u) AS unique_bytes""")
def dedup_summary(spark, sf):
    return dedup.dedup_summary(dedup.with_hash(corpus(spark, sf)))


@query(f"WITH {FILES} SELECT file_id, sha, row_number() OVER (PARTITION BY sha ORDER BY file_id) AS nth FROM files")
def dedup_rank(spark, sf):
    return dedup.rank_in_content(dedup.with_hash(corpus(spark, sf)))


@query(f"WITH {FILES} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files")
def source_stats(spark, sf):
    return tree_source.source_stats(corpus(spark, sf).withColumn("kind", F.lit("file")))


@query(f"""WITH {FILES}, h AS (SELECT file_id, size, hex(encode(content)) AS x FROM files)
    SELECT file_id, left(sha256(unhex(CASE WHEN size <= 8192 THEN x ELSE left(x, 8192) || right(x, 8192) END)), 32) AS sig FROM h""")
def quick_sig(spark, sf):
    return corpus(spark, sf).select("file_id", dedup.quick_signature(F.col("content")).alias("sig"))


@query(f"WITH {FILES} SELECT file_id, sha FROM files WHERE sha IN (SELECT sha FROM files GROUP BY sha HAVING count(*) > 1)")
def multipass_candidates(spark, sf):
    return dedup.multipass_duplicates(corpus(spark, sf))


# --- lines


@query(f"WITH {FILES}, {LINES} SELECT line, n FROM freq")
def line_frequency(spark, sf):
    return lines.line_frequency(corpus(spark, sf))


@query(f"WITH {FILES}, {LINES} SELECT line, n FROM freq ORDER BY n DESC, line LIMIT 50")
def top_lines(spark, sf):
    return lines.top_lines(lines.line_frequency(corpus(spark, sf)), 50)


def dictionary(spark, sf) -> DataFrame:
    return lines.line_dictionary(lines.line_frequency(corpus(spark, sf)))


@query(f"WITH {FILES}, {LINES} SELECT idx, line, CAST(code AS INTEGER) AS code FROM codes")
def line_dictionary(spark, sf):
    return dictionary(spark, sf)


@query(f"""WITH {FILES}, {LINES} SELECT count(*) AS lines, count(f.line) AS repeated, round(100.0 * count(f.line) / count(*), 6) AS pct
    FROM rawlines r LEFT JOIN freq f ON ltrim(r.line, ' ' || chr(9)) = f.line""")
def repeated_line_share(spark, sf):
    files = corpus(spark, sf)
    every = files.select(F.explode(lines.split_lines(F.col("content"))).alias("l")).select(lines.bare(F.col("l")).alias("line"))
    # lines are counted before the join, so it sees one row a distinct line
    counted = every.groupBy("line").agg(F.count("*").alias("c"))
    marked = counted.join(lines.line_frequency(files).select("line", F.lit(1).alias("hit")), "line", "left")
    total = marked.agg(F.sum("c").alias("lines"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("c"))), F.lit(0)).alias("repeated"))
    return total.withColumn("pct", F.round(F.lit(100.0) * F.col("repeated") / F.col("lines"), 6))


@query(f"WITH {FILES}, {LINES}, {ENCODED} SELECT file_id, n_lines, hits, CAST(octet_length(encode(encoded)) - wide AS BIGINT) AS encoded_bytes FROM enc")
def line_subst_stats(spark, sf):
    done = lines.encode(corpus(spark, sf), dictionary(spark, sf))
    return done.select("file_id", F.size(lines.split_lines(F.col("content"))).cast("long").alias("n_lines"), F.regexp_count("encoded", F.lit("\x00")).cast("long").alias("hits"), lines.encoded_bytes(F.col("encoded")).alias("encoded_bytes"))


@query(f"WITH {FILES} SELECT file_id, sha FROM files")
def line_subst_roundtrip(spark, sf):
    d = stage(dictionary(spark, sf), "dictionary")
    back = lines.decode(lines.encode(corpus(spark, sf), d), d)
    return back.select("file_id", dedup.sha(F.col("decoded")).alias("sha"))


# --- JSON and logs


@query("SELECT event_id, CAST(json(props) AS VARCHAR) AS canonical FROM events")
def json_canonical(spark, sf):
    return table(spark, sf, "events").select("event_id", canonical.canonical_json(F.col("props")).alias("canonical"))


@query("SELECT event_id, CAST(json(props) AS VARCHAR) AS canonical FROM events")
def json_canonical_exact(spark, sf):
    return table(spark, sf, "events").select("event_id", canonical.exact_canonical_json(F.col("props")).alias("canonical"))


@query("SELECT CAST(json(props) AS VARCHAR) AS canonical, count(*) AS copies, min(event_id) AS first_id FROM events GROUP BY 1")
def json_canonical_dedup(spark, sf):
    return table(spark, sf, "events").groupBy(canonical.canonical_json(F.col("props")).alias("canonical")).agg(F.count("*").alias("copies"), F.min("event_id").alias("first_id"))


LOGS = """evt AS (SELECT user_id, event_id, 'user=' || user_id || ' type=' || event_type || ' value=' || CAST(floor(value) AS BIGINT) || ' id=' || event_id AS line FROM events),
    grp AS (SELECT user_id, count(*) AS n, arg_min(line, event_id) AS first, CAST(sum(length(line) + 1) AS BIGINT) AS bytes FROM evt GROUP BY 1),
    lens AS (SELECT user_id, n, first, bytes, unnest(range(1, length(first) + 1)) AS k FROM grp),
    fit AS (SELECT l.user_id, l.k FROM lens l JOIN evt e ON l.user_id = e.user_id AND starts_with(e.line, left(l.first, CAST(l.k AS INTEGER))) GROUP BY l.user_id, l.k, l.n HAVING 2 * count(*) > l.n),
    tmpl AS (SELECT g.user_id, g.n, g.bytes, CASE WHEN g.n >= 10 THEN left(g.first, CAST(max(f.k) AS INTEGER)) END AS template FROM grp g LEFT JOIN fit f USING (user_id) GROUP BY g.user_id, g.n, g.first, g.bytes)"""


def logs(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    line = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(" type="), "event_type", F.lit(" value="), F.floor("value").cast("string"), F.lit(" id="), F.col("event_id").cast("string"))
    whole = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("l"))
    return whole.select("user_id", F.concat(F.array_join(F.col("l.line"), "\n"), F.lit("\n")).alias("content"))


@query(f"WITH {LOGS} SELECT user_id, CAST(n AS INTEGER) AS n_lines, template FROM tmpl")
def log_template(spark, sf):
    return canonical.log_template(logs(spark, sf)).select("user_id", "n_lines", "template")


@query(f"""WITH {LOGS}, s AS (SELECT t.user_id, sum(CASE WHEN template IS NULL THEN NULL WHEN starts_with(line, template) THEN length(line) - length(template) ELSE length(line) + 1 END) + any_value(n) - 1 AS b FROM tmpl t JOIN evt USING (user_id) GROUP BY 1)
    SELECT count(*) AS logs, count(template) AS handled, CAST(sum(bytes) AS BIGINT) AS original_bytes, CAST(sum(CASE WHEN template IS NULL THEN bytes ELSE b + length(template) END) AS BIGINT) AS stored_bytes FROM tmpl JOIN s USING (user_id)""")
def log_suffix_savings(spark, sf):
    t = canonical.log_template(logs(spark, sf))
    stored = F.when(F.col("template").isNull(), F.octet_length("content")).otherwise(F.octet_length("suffixes") + F.octet_length("template"))
    return t.agg(F.count("*").alias("logs"), F.count("template").alias("handled"), F.sum(F.octet_length("content")).cast("long").alias("original_bytes"), F.sum(stored).cast("long").alias("stored_bytes"))


@query(f"WITH {LOGS} SELECT user_id, sha256(string_agg(line || chr(10), '' ORDER BY event_id)) AS sha FROM evt GROUP BY 1")
def log_roundtrip(spark, sf):
    t = canonical.log_template(logs(spark, sf)).withColumn("back", F.when(F.col("template").isNull(), F.col("content")).otherwise(canonical.log_restore(F.col("template"), F.col("suffixes"))))
    return t.select("user_id", dedup.sha(F.col("back")).alias("sha"))


# --- licences and diffs


def licensed(spark, sf) -> DataFrame:
    # texts and scripts of narrow rows: a task is as long as its rows are many, whatever the bytes of the file
    c = dealt_out(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    texts = [fixed.LICENSES[n] for n in HELD_NAMES]
    fill = lambda t: F.replace(F.lit(t), F.lit("[year] [fullname]"), F.concat(F.lit("2024 "), "c_name"))
    kind = F.col("c_custkey") % 4
    content = F.when(kind == 0, fill(texts[0])).when(kind == 1, fill(texts[1])).when(kind == 2, F.lit(texts[0] + "\n")).otherwise(F.concat(fill(texts[1]), F.lit("\nOne more line.")))
    return c.select(F.col("c_custkey").alias("file_id"), F.lit("LICENSE").alias("rel_path"), content.alias("content"))


_T = [t.replace("'", "''").replace("\n", "' || chr(10) || '") for t in (fixed.LICENSES[n] for n in HELD_NAMES)]
_NAMES = HELD_NAMES
HELD = f"""lic AS (SELECT c_custkey AS file_id, CASE c_custkey % 4 WHEN 0 THEN replace('{_T[0]}', '[year] [fullname]', '2024 ' || c_name) WHEN 1 THEN replace('{_T[1]}', '[year] [fullname]', '2024 ' || c_name)
      WHEN 2 THEN '{_T[0]}' || chr(10) ELSE replace('{_T[1]}', '[year] [fullname]', '2024 ' || c_name) || chr(10) || 'One more line.' END AS content FROM customer),
    body AS (SELECT file_id, content, trim(content, ' ' || chr(10)) AS norm, array_to_string(list_filter(string_split(trim(content, ' ' || chr(10)), chr(10)), lambda x: NOT regexp_matches(x, '(?i)^\\s*copyright')), chr(10)) AS b FROM lic),
    known AS (SELECT '{_NAMES[0]}' AS spdx, '{_T[0]}' AS t UNION ALL SELECT '{_NAMES[1]}', '{_T[1]}'),
    kb AS (SELECT spdx, sha256(t) AS fs, sha256(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '(?i)^\\s*copyright')), chr(10))) AS bs FROM known),
    det AS (SELECT file_id, coalesce(f.spdx, g.spdx) AS spdx, CASE WHEN f.spdx IS NOT NULL THEN 'full' WHEN g.spdx IS NOT NULL THEN 'body' END AS match
      FROM body LEFT JOIN kb f ON sha256(norm) = f.fs LEFT JOIN kb g ON sha256(b) = g.bs)"""


@query(f"WITH {HELD} SELECT file_id, spdx, match FROM det")
def license_detect(spark, sf):
    return license.detect(licensed(spark, sf), license.templates(spark)).select("file_id", "spdx", "match")


@query(f"WITH {HELD} SELECT spdx, match, count(*) AS files FROM det GROUP BY ALL")
def license_summary(spark, sf):
    return license.detect(licensed(spark, sf), license.templates(spark)).groupBy("spdx", "match").agg(F.count("*").alias("files"))


@query(f"WITH {HELD} SELECT file_id, sha256(content) AS sha FROM lic JOIN det USING (file_id) WHERE spdx IS NOT NULL")
def license_roundtrip(spark, sf):
    known = license.templates(spark)
    done = license.apply_rule(licensed(spark, sf), known).where("params is not null")
    return done.select("file_id", dedup.sha(license.restored(F.col("template"), F.col("params"))).alias("sha"))


@query(f"""WITH {HELD}, split AS (SELECT file_id, d.spdx, match, string_split(k.t, chr(10)) AS a, string_split(norm, chr(10)) AS b, content FROM det d JOIN known k USING (spdx) JOIN body USING (file_id)),
    -- these files differ from their template in the copyright line only, so the lines before and after it are equal
    pos AS (SELECT *, list_position(list_transform(a, lambda x: regexp_matches(x, '(?i)^\\s*copyright')), true) AS i FROM split),
    q AS (SELECT *, replace(a[i], '"', chr(92) || '"') AS old, replace(b[i], '"', chr(92) || '"') AS new FROM pos)
    SELECT file_id, CASE WHEN match = 'full' THEN '{{"spdx":"' || spdx || '"' ELSE '{{"spdx":"' || spdx || '","ops":[' || CASE WHEN i > 1 THEN '{{"k":"=","n":' || (i - 1) || '}},' ELSE '' END
        || '{{"k":"-","l":"' || old || '"}},{{"k":"+","l":"' || new || '"}},{{"k":"=","n":' || (len(a) - i) || '}}]' END || CASE WHEN content LIKE '%' || chr(10) THEN ',"nl":true' ELSE '' END || '}}' AS params
    FROM q""")
def license_params(spark, sf):
    return license.apply_rule(licensed(spark, sf), license.templates(spark)).where("params is not null").select("file_id", "params")


@query("""SELECT line, count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
    WHERE regexp_matches(line, '(?i)licen[cs]ed? (under|to)|all rights reserved|copyright') GROUP BY line""")
def license_lines(spark, sf):
    flat = corpus(spark, sf).select(F.explode(lines.split_lines(F.col("content"))).alias("line"))
    return flat.where(F.col("line").rlike("(?i)licen[cs]ed? (under|to)|all rights reserved|copyright")).groupBy("line").agg(F.count("*").alias("n"))


@query(f"""WITH {HELD} SELECT file_id, CASE WHEN file_id % 4 = 2 THEN 0 WHEN file_id % 4 = 3 THEN 2 ELSE 1 END AS inserted, CASE WHEN file_id % 4 = 2 THEN 0 ELSE 1 END AS deleted FROM lic""")
def line_diff_stats(spark, sf):
    d, names = licensed(spark, sf), F.array(*[F.lit(fixed.LICENSES[n]) for n in HELD_NAMES])
    base = F.element_at(names, F.when(F.col("file_id") % 4 % 2 == 0, 1).otherwise(2))
    ops = d.select("file_id", linediff.line_diff(F.split(base, "\n", -1), F.split(license.normalised(F.col("content")), "\n", -1)).alias("ops"))
    return ops.select("file_id", linediff.changed(F.col("ops"), "+").alias("inserted"), linediff.changed(F.col("ops"), "-").alias("deleted"))


@query(f"WITH {HELD} SELECT file_id, sha256(norm) AS sha FROM body")
def line_diff_replay(spark, sf):
    d = licensed(spark, sf)
    base, own = F.split(F.lit(fixed.LICENSES[HELD_NAMES[0]]), "\n", -1), F.split(license.normalised(F.col("content")), "\n", -1)
    back = d.select("file_id", linediff.replayed(base, linediff.line_diff(base, own)).alias("back"))
    return back.select("file_id", dedup.sha(F.array_join("back", "\n")).alias("sha"))


# --- planning


def file_order(spark, sf) -> DataFrame:
    """``(file_id, entry_id, rel_path)`` of the files of the tree."""
    every = planner.write_order(catalog.with_directories(corpus(spark, sf).select("file_id", "rel_path", "size")))
    return every.where("kind = 'file'").select("file_id", "entry_id", "rel_path")


def planned(spark, sf, disabled: tuple[str, ...] = (), order: DataFrame | None = None) -> DataFrame:
    order = file_order(spark, sf) if order is None else order
    return planner.plan(corpus(spark, sf), stage(dictionary(spark, sf), "dictionary"), license.templates(spark), disabled=disabled, order=order.select("file_id", "entry_id"))


@query(f"""WITH {FILES}, b AS (SELECT *, regexp_extract(rel_path, '[^/]*$') AS base FROM files)
    SELECT file_id, 'dedup/v1' AS rule, size AS gain, size // 1024 AS cost FROM b WHERE size > 0
    UNION ALL SELECT file_id, 'go-line-subst/v1', size // 10, size // 1024 FROM b WHERE size > 0 AND base LIKE '%.go'
    UNION ALL SELECT file_id, 'license-canonical/v1', size, 512 FROM b WHERE regexp_matches(base, '(?i)^(licen[cs]e|copying|notice)(\\..+)?$')
    UNION ALL SELECT file_id, 'json-canonical/v1', size // 4, size // 512 FROM b WHERE size BETWEEN 1 AND 10485760 AND lower(base) LIKE '%.json'
    UNION ALL SELECT file_id, 'log-template/v1', size // 3, size // 256 FROM b WHERE size BETWEEN 1024 AND 52428800 AND (base IN ('syslog', 'messages', 'kern.log') OR regexp_matches(base, '\\.log(\\.[^.]*)?$'))""")
def plan_applicability(spark, sf):
    return planner.applicability(corpus(spark, sf))


@query(f"WITH {PLAN} SELECT file_id, entry_id, transform_id, gain, cost, applied, reason FROM plan_log")
def plan_decisions(spark, sf):
    return planned(spark, sf).select("file_id", "entry_id", "transform_id", "gain", "cost", "applied", "reason")


SUMMARY = "SELECT coalesce(transform_id, 'raw') AS transform, CAST(sum(applied) AS BIGINT) AS applied, CAST(sum(1 - applied) AS BIGINT) AS skipped, CAST(sum(gain * applied) AS BIGINT) AS gain FROM"


@query(f"WITH {PLAN} {SUMMARY} plan_log GROUP BY 1")
def plan_summary(spark, sf):
    return planner.summary(planned(spark, sf))


@query(f"WITH {PLAN}, s AS ({SUMMARY} plan_log GROUP BY 1) SELECT CAST(sum(applied + skipped) AS BIGINT) AS total, CAST(sum(applied) AS BIGINT) AS applied FROM s")
def plan_totals(spark, sf):
    return planner.summary(planned(spark, sf)).agg(F.sum(F.col("applied") + F.col("skipped")).alias("total"), F.sum("applied").alias("applied"))


@query(f"""WITH {PLAN}, off AS (SELECT CASE WHEN go_may AND go_pays THEN 'go-line-subst/v1' ELSE skip END AS transform_id, CAST(go_may AND go_pays AS INTEGER) AS applied, size // 10 AS gain FROM log)
    {SUMMARY} off GROUP BY 1""")
def plan_summary_disabled(spark, sf):
    return planner.summary(planned(spark, sf, (R.DEDUP.id,)))


@query("""SELECT * FROM (VALUES (0, 'dedup/v1', 'default', true), (1, 'go-line-subst/v1', 'default', true), (2, 'license-canonical/v1', 'default', true),
    (3, 'json-canonical/v1', 'opt-in', false), (4, 'log-template/v1', 'opt-in', false), (5, 'near-dup-delta/v1', 'stub', false)) AS t(position, id, state, lossless)""")
def rule_registry(spark, sf):
    return R.registry(spark)


# --- catalog


@query(f"WITH {FILES}, {TREE} SELECT rel_path, kind, seq, entry_id FROM ordered")
def write_order(spark, sf):
    return planner.write_order(catalog.with_directories(corpus(spark, sf))).select("rel_path", "kind", "seq", "entry_id")


@query(f"WITH {FILES}, {TREE} SELECT (entry_id - 1) // 1000 AS batch, count(*) AS entries, max(entry_id) AS last_entry FROM ordered GROUP BY 1")
def batch_numbers(spark, sf):
    every = planner.write_order(catalog.with_directories(corpus(spark, sf)))
    return every.groupBy(F.floor((F.col("entry_id") - 1) / 1000).alias("batch")).agg(F.count("*").alias("entries"), F.max("entry_id").alias("last_entry"))


NAMED = f"{FILES}, {TREE}, named AS (SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT regexp_extract(rel_path, '[^/]*$') AS name FROM ordered))"


@query(f"WITH {NAMED} SELECT id, name FROM named")
def names_interned(spark, sf):
    return catalog.names(catalog.with_directories(corpus(spark, sf)))


def tree(spark, sf) -> tuple[DataFrame, DataFrame]:
    every = planner.write_order(catalog.with_directories(corpus(spark, sf)))
    named = catalog.names(every)
    return catalog.tree_entries(every, named), named


ENTRIES = f"""{NAMED}, ent AS (SELECT o.entry_id AS id, p.entry_id AS parent_id, n.id AS name_id, o.kind, o.size, o.file_id, o.rel_path FROM ordered o
    JOIN named n ON n.name = regexp_extract(o.rel_path, '[^/]*$') LEFT JOIN ordered p ON p.kind = 'dir' AND p.rel_path = regexp_extract(o.rel_path, '^(.*)/[^/]*$', 1))"""


@query(f"WITH {ENTRIES} SELECT id, parent_id, name_id, kind, size, file_id FROM ent")
def tree_entries(spark, sf):
    return tree(spark, sf)[0]


@query(f"WITH {ENTRIES} SELECT id, rel_path AS path FROM ent")
def tree_paths(spark, sf):
    return catalog.paths(*tree(spark, sf))


@query(f"WITH {BLOBS} SELECT entry_id, rel_path, l.transform_id, b.blob_id FROM plan_log l JOIN ordered o USING (entry_id) JOIN blobs b ON b.sha = l.stored_sha")
def walk_entries(spark, sf):
    order = stage(file_order(spark, sf), "order")
    log = stage(planned(spark, sf, order=order), "log")
    blobs = catalog.blob_table(log, log.select(F.col("stored_sha").alias("sha"), F.lit(0).alias("ulen")).distinct())
    links = catalog.entry_blobs(log, blobs)
    return log.select("entry_id", "transform_id").join(order.select("entry_id", "rel_path"), "entry_id").join(links.select("entry_id", "blob_id"), "entry_id")


@query(f"WITH {FILES}, parts AS (SELECT *, string_split(rel_path, '/') AS p FROM files), u AS (SELECT array_to_string(p[1:i], '/') AS dir, size FROM (SELECT p, size, unnest(range(1, len(p))) AS i FROM parts)) SELECT dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM u GROUP BY 1")
def dir_sizes(spark, sf):
    return catalog.dir_sizes(corpus(spark, sf))


def url_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[?#].*$|/$", "")


@query("""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$|/$', '', 'g') AS rel_path FROM pages WHERE url IS NOT NULL),
    u AS (SELECT string_split(rel_path, '/') AS s FROM p), n AS (SELECT s, unnest(range(1, len(s))) AS i FROM u)
    SELECT array_to_string(s[1:i], '/') AS dir, count(*) AS files, CAST(i AS INTEGER) AS depth FROM n GROUP BY ALL""")
def url_tree(spark, sf):
    urls = table(spark, sf, "pages").where("url is not null").select(url_path(F.col("url")).alias("rel_path")).distinct()
    sizes = catalog.dir_sizes(urls.withColumn("size", F.lit(0).cast("long")))
    return sizes.select("dir", "files", F.size(F.split("dir", "/")).alias("depth"))


@query(f"WITH {BLOBS} SELECT blob_id, sha, ulen, first_entry FROM blobs")
def blob_ids(spark, sf):
    context = R.Context(stage(dictionary(spark, sf), "dictionary"), license.templates(spark))
    cands = planner.candidates(corpus(spark, sf), context).drop("bytes", "rel_path")
    slim = stage(cands.join(file_order(spark, sf).select("file_id", "entry_id"), "file_id"), "plan")
    sizes = slim.groupBy(F.col("own_sha").alias("sha")).agg(F.max("own_len").alias("ulen"))
    return catalog.blob_table(stage(planner.decide(slim), "log"), sizes)


@query(f"WITH {UNIQUE} SELECT blob_id, sha FROM ids")
def blob_sha_list(spark, sf):
    return numbered(dedup.unique_blobs(dedup.with_hash(corpus(spark, sf))), [F.col("first_id")], "blob_id").select("blob_id", "sha")


# --- blocks


def unique_contents(spark, sf) -> DataFrame:
    hashed = dedup.with_hash(corpus(spark, sf))
    return numbered(dedup.unique_blobs(hashed), [F.col("first_id")], "blob_id").select("blob_id", "sha", "first_id", F.col("size").alias("ulen"))


@query(f"WITH RECURSIVE {PACKED} SELECT blob_id, ulen, CAST(block_id AS BIGINT) AS block_id, CAST(block_offset AS BIGINT) AS block_offset FROM packed")
def solid_blocks(spark, sf):
    return solid.pack(unique_contents(spark, sf), BLOCK)


@query(f"WITH RECURSIVE {PACKED} SELECT CAST(block_id AS BIGINT) AS block_id, count(*) AS blobs, CAST(sum(ulen) AS BIGINT) AS ulen FROM packed GROUP BY 1")
def block_sizes(spark, sf):
    return solid.pack(unique_contents(spark, sf), BLOCK).groupBy("block_id").agg(F.count("*").alias("blobs"), F.sum("ulen").alias("ulen"))


@query(f"WITH RECURSIVE {PACKED} SELECT count(DISTINCT block_id) AS blocks FROM packed")
def block_count(spark, sf):
    return solid.pack(unique_contents(spark, sf), BLOCK).agg(F.countDistinct("block_id").alias("blocks"))


@query(f"""WITH RECURSIVE {PACKED}, w AS (SELECT block_id, sum(ulen) AS clen FROM packed GROUP BY 1)
    SELECT (SELECT count(*) FROM files) AS entries, (SELECT CAST(sum(size) AS BIGINT) FROM files) AS original_bytes, (SELECT count(*) FROM packed) AS blobs, (SELECT CAST(sum(ulen) AS BIGINT) FROM packed) AS unique_bytes,
      (SELECT CAST(sum(clen) AS BIGINT) FROM w) AS stored_bytes, (SELECT count(*) FROM w) AS blocks""")
def solid_overview(spark, sf):
    packed = solid.pack(unique_contents(spark, sf), BLOCK)
    lengths = packed.groupBy("block_id").agg(F.sum("ulen").alias("clen"))
    return catalog.overview(corpus(spark, sf).select("size"), packed.join(lengths, "block_id"))


@query(f"""WITH {FILES}, s AS (SELECT (SELECT sum(size) FROM files) AS o, (SELECT sum(z) FROM (SELECT max(size) AS z FROM files GROUP BY sha)) AS u)
    SELECT CASE WHEN o = 0 THEN 0.0 ELSE 100.0 * u / o END AS unique_pct, CASE WHEN o = 0 THEN 0.0 ELSE 100.0 * u / o END AS stored_pct, CASE WHEN u = 0 THEN 0.0 ELSE 100.0 END AS block_pct FROM s""")
def overview_ratios(spark, sf):
    files = dedup.with_hash(corpus(spark, sf))
    blobs = dedup.unique_blobs(files).select(F.col("size").alias("ulen"), F.col("size").alias("clen"))
    return catalog.ratios(catalog.overview(files.select("size"), blobs)).select("unique_pct", "stored_pct", "block_pct")


@query(f"""WITH {FILES}, h AS (SELECT file_id, size, row_number() OVER (ORDER BY file_id) AS n, coalesce(sum(size) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM files WHERE size BETWEEN 1 AND 65536)
    SELECT file_id, n, CAST(before AS BIGINT) AS before FROM h WHERE n <= 500 AND before < 8388608""")
def dict_samples(spark, sf):
    return solid.dict_samples(corpus(spark, sf))


MIXED = f"""{PACKED}, mixed AS (SELECT blob_id, ulen, CASE WHEN blob_id % 5 = 0 THEN NULL ELSE CAST(block_id AS BIGINT) END AS block_id FROM packed),
    lens AS (SELECT block_id, CAST(sum(ulen) AS BIGINT) // 2 + 7 AS clen FROM mixed WHERE block_id IS NOT NULL GROUP BY 1)"""


@query(f"""WITH RECURSIVE {MIXED} SELECT (SELECT count(*) FROM files) AS entries, (SELECT CAST(sum(size) AS BIGINT) FROM files) AS original_bytes, (SELECT count(*) FROM mixed) AS blobs, (SELECT CAST(sum(ulen) AS BIGINT) FROM mixed) AS unique_bytes,
      CAST((SELECT coalesce(sum(clen), 0) FROM lens) + (SELECT coalesce(sum(ulen // 3 + 1), 0) FROM mixed WHERE block_id IS NULL) AS BIGINT) AS stored_bytes, (SELECT count(*) FROM lens) AS blocks""")
def mixed_overview(spark, sf):
    """Blobs in blocks beside blobs on their own, with lengths that differ from the contents'."""
    packed = solid.pack(unique_contents(spark, sf), BLOCK).withColumn("block_id", F.when(F.col("blob_id") % 5 != 0, F.col("block_id")))
    lengths = packed.where("block_id is not null").groupBy("block_id").agg((F.floor(F.sum("ulen") / 2) + 7).alias("c"))
    blobs = packed.join(lengths, "block_id", "left").withColumn("clen", F.coalesce("c", F.floor(F.col("ulen") / 3) + 1))
    return catalog.overview(corpus(spark, sf).select("size"), blobs)


@query(f"WITH {FILES} SELECT file_id, sha FROM files")
def compress_roundtrip(spark, sf):
    c = corpus(spark, sf).withColumn("frame", solid.compressed(F.encode("content", "utf-8")))
    with small_batches(spark, WHOLE_ROWS):
        return stage(c.select("file_id", F.sha2(solid.decompressed(F.col("frame")), 256).alias("sha")), "shas")


@query(f"WITH {FILES} SELECT file_id, sha FROM files")
def compress_dict_roundtrip(spark, sf):
    """With a dictionary of the bounded sample, for which the first files by id are taken."""
    files = corpus(spark, sf)
    trained = solid.train_dictionary(files)
    c = files.withColumn("frame", solid.compressed(F.encode("content", "utf-8"), dictionary=trained))
    with small_batches(spark, WHOLE_ROWS):
        return stage(c.select("file_id", F.sha2(solid.decompressed(F.col("frame"), trained), 256).alias("sha")), "shas")


@query(f"WITH {UNIQUE} SELECT blob_id, CAST(ulen AS BIGINT) AS ulen, CAST(ulen AS BIGINT) AS clen, 0 AS compressed FROM ids")
def stored_plain(spark, sf):
    return solid.single(blob_bytes(spark, sf), "none").select("blob_id", "ulen", "clen", "compressed")


def blob_bytes(spark, sf) -> DataFrame:
    bytes_of = corpus(spark, sf).select(F.col("file_id").alias("first_id"), F.encode("content", "utf-8").alias("bytes"))
    return unique_contents(spark, sf).join(bytes_of, "first_id").select("blob_id", "bytes")


@query(f"WITH {FILES} SELECT file_id, size, true AS bounded FROM files")
def compress_sizes(spark, sf):
    """A frame is never longer than its content by more than the format's own bound."""
    c = corpus(spark, sf).select("file_id", "size", F.octet_length(solid.compressed(F.encode("content", "utf-8"))).alias("clen"))
    with small_batches(spark, WHOLE_ROWS):
        c = stage(c, "lengths")
    return c.select("file_id", "size", (F.col("clen") <= F.col("size") + F.floor(F.col("size") / 256) + 64).alias("bounded"))


@query(f"WITH RECURSIVE {PACKED} SELECT CAST(block_id AS BIGINT) AS block_id, CAST(sum(ulen) AS BIGINT) AS ulen, true AS smaller FROM packed GROUP BY 1 HAVING sum(ulen) > 0")
def solid_compress_sizes(spark, sf):
    """A block of texts is smaller than its contents."""
    blobs = stage(unique_contents(spark, sf), "blobs")
    with small_batches(spark):
        done = stage(solid.blocks(blob_bytes(spark, sf), solid.pack(blobs, BLOCK)).drop("payload"), "lengths")
    return done.where("ulen > 0").select("block_id", "ulen", (F.col("clen") < F.col("ulen")).alias("smaller"))


@query(f"WITH {FILES} SELECT rel_path, sha FROM files")
def restore_mismatches(spark, sf):
    """Every file after archiving and restoring, by the hash of what came back."""
    d, known = stage(dictionary(spark, sf), "dictionary"), license.templates(spark)
    back = archive.restore(archive.build(corpus(spark, sf), d, known, block_bytes=BLOCK), d)
    return back.where("kind = 'file'").select("rel_path", dedup.sha(F.col("content")).alias("sha"))


@query(f"""WITH {FILES}, a AS (SELECT sha FROM files WHERE file_id % 2 = 0), b AS (SELECT sha FROM files WHERE file_id % 3 = 0)
    SELECT 'left' AS side, sha FROM (SELECT sha FROM a EXCEPT ALL SELECT sha FROM b) UNION ALL SELECT 'right', sha FROM (SELECT sha FROM b EXCEPT ALL SELECT sha FROM a)""")
def set_difference(spark, sf):
    """Hash lists of two overlapping parts of the corpus, compared both ways as multisets."""
    hashed = dedup.with_hash(corpus(spark, sf))
    a, b = (hashed.where(F.col("file_id") % n == 0).select("sha") for n in (2, 3))
    return a.exceptAll(b).select(F.lit("left").alias("side"), "sha").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "sha"))


@query(f"""WITH {FILES} SELECT file_id, CASE WHEN file_id % 4 = 3 THEN 'dir' ELSE 'file' END AS kind, CASE WHEN file_id % 4 = 3 OR size = 0 THEN repeat('0', 64) ELSE sha END AS sha FROM files""")
def entry_hashes(spark, sf):
    kind = F.when(F.col("file_id") % 4 == 3, "dir").otherwise("file")
    return corpus(spark, sf).select("file_id", kind.alias("kind"), dedup.entry_hash(kind, F.col("size"), F.col("content")).alias("sha"))


# --- sources and sinks


@query(f"""WITH {FILES}, {TREE} SELECT rel_path, kind, size, CASE WHEN kind = 'dir' THEN 493 WHEN file_id % 2 = 0 THEN 384 ELSE 420 END AS mode, CASE WHEN kind = 'dir' THEN 1000000000000000000 ELSE 1000000000000000000 + file_id * 1001 END AS mtime_ns,
    CASE WHEN size > 0 THEN (SELECT sha FROM files f WHERE f.file_id = every.file_id) ELSE repeat('0', 64) END AS sha FROM every""")
def tree_roundtrip(spark, sf):
    """The corpus written as a file tree and scanned again, with modes and times."""
    folder = local_dir(spark, "tree")
    every = catalog.with_directories(corpus(spark, sf).withColumns({"kind": F.lit("file"), "link_target": F.lit(None).cast("string")}))
    is_dir, base = F.col("kind") == "dir", F.lit(10**18)
    mode = F.when(is_dir, 0o755).when(F.col("file_id") % 2 == 0, 0o600).otherwise(0o644)
    tree_source.write_tree(every.withColumns({"mode": mode, "mtime_ns": F.when(is_dir, base).otherwise(base + F.col("file_id") * 1001)}), folder)
    # a directory's files were listed by one task; they are read by many
    found = tree_source.with_content(dealt_out(tree_source.scan(spark, [folder]), "path")).where("rel_path <> '.'")
    with small_batches(spark, WHOLE_ROWS):
        return stage(found.select("rel_path", "kind", "size", "mode", "mtime_ns", dedup.entry_hash(F.col("kind"), F.col("size"), F.col("content")).alias("sha")), "found")


@query(f"""WITH {BLOBS}, named AS (SELECT count(DISTINCT regexp_extract(rel_path, '[^/]*$')) AS n FROM ordered)
    SELECT 'names' AS name, n AS rows FROM named UNION ALL SELECT 'entries', count(*) FROM ordered UNION ALL SELECT 'blobs', count(*) FROM blobs
    UNION ALL SELECT 'entry_blobs', count(*) FROM files UNION ALL SELECT 'plan_log', count(*) FROM files""")
def stored_tables(spark, sf):
    """Rows of the tables of a saved catalog that verifies."""
    path = new_dir(spark, "catalog")
    store_source.save(archive.build(corpus(spark, sf), stage(dictionary(spark, sf), "dictionary"), block_bytes=BLOCK), path)
    if wrong := store_source.verify(spark, path):
        raise ValueError(f"the saved catalog differs: {wrong}")
    c = store_source.load(spark, path)
    each = [getattr(c, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in ("names", "entries", "blobs", "entry_blobs", "plan_log")]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).unionByName(each[4])


@query(f"WITH {FILES} SELECT rel_path, size, sha FROM files")
def packed_roundtrip(spark, sf):
    """The corpus packed into one file, checked, read and restored."""
    folder = local_dir(spark, "packed")
    os.makedirs(folder)
    d = stage(dictionary(spark, sf), "dictionary")
    packed_source.write_packed(archive.build(corpus(spark, sf), d, block_bytes=BLOCK), f"{folder}/a.pack", b"CRPSMILL")
    back = archive.restore(packed_source.read_packed(spark, f"{folder}/a.pack", b"CRPSMILL", check=True), d).where("kind = 'file'")
    return back.select("rel_path", F.octet_length("content").cast("long").alias("size"), dedup.sha(F.col("content")).alias("sha"))


# --- guards and small functions


@query("""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a/b/c' WHEN 1 THEN '../x' WHEN 2 THEN 'a/../../y' WHEN 3 THEN 'a/./b/../c' ELSE 'a/../b' END AS rel_path FROM pages)
    SELECT page_id, rel_path, page_id % 5 IN (1, 2) AS outside FROM p""")
def escape_guard(spark, sf):
    k = F.col("page_id") % 5
    path = F.when(k == 0, "a/b/c").when(k == 1, "../x").when(k == 2, "a/../../y").when(k == 3, "a/./b/../c").otherwise("a/../b")
    return table(spark, sf, "pages").select("page_id", path.alias("rel_path")).withColumn("outside", fn.escapes("/srv/out", F.col("rel_path")))


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$|/$', '', 'g') AS rel_path FROM pages WHERE url IS NOT NULL),
    u AS (SELECT *, repeat('../', CAST(page_id % 6 AS INTEGER)) || 'x' AS target, len(string_split(rel_path, '/')) - 1 AS depth FROM p)
    SELECT page_id, rel_path, target, page_id % 6 > depth AS outside FROM u""")
def link_guard(spark, sf):
    """A link may climb as far as its own folder is deep."""
    p = table(spark, sf, "pages").where("url is not null").select("page_id", url_path(F.col("url")).alias("rel_path"))
    p = p.withColumn("target", F.concat(F.repeat(F.lit("../"), (F.col("page_id") % 6).cast("int")), F.lit("x")))
    return p.withColumn("outside", fn.link_escapes("/srv/out", F.col("rel_path"), F.col("target")))


@query("SELECT DISTINCT event_type || '/v9' AS transform FROM events WHERE length(event_type) % 2 = 1")
def unknown_transform_check(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.length("event_type") % 2 == 0, R.LINES.id).otherwise(F.concat("event_type", F.lit("/v9"))).alias("transform"))
    return archive.check_transforms(e)


@query(f"""WITH {FILES}, s AS (SELECT file_id, size * size AS n FROM files) SELECT file_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0)
    WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE n || ' B' END AS human FROM s""")
def human_bytes(spark, sf):
    return corpus(spark, sf).select("file_id", fn.human_bytes(F.col("size") * F.col("size")).alias("human"))


@query("""SELECT p_partkey, p_partkey || CASE p_partkey % 4 WHEN 0 THEN 'MB' WHEN 1 THEN 'kb' WHEN 2 THEN '' ELSE ' x' END AS text,
    CASE p_partkey % 4 WHEN 0 THEN p_partkey * 1048576 WHEN 1 THEN p_partkey * 1024 WHEN 2 THEN p_partkey END AS bytes FROM part WHERE p_partkey > 0""")
def parse_byte_size(spark, sf):
    k = F.col("p_partkey") % 4
    text = F.concat(F.col("p_partkey").cast("string"), F.when(k == 0, "MB").when(k == 1, "kb").when(k == 2, "").otherwise(" x"))
    return table(spark, sf, "part").where("p_partkey > 0").select("p_partkey", text.alias("text")).withColumn("bytes", fn.parse_byte_size(F.col("text")))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'split' END AS format FROM pages""")
def format_sniff(spark, sf):
    k = F.col("page_id") % 3
    head = F.when(k == 0, F.lit(b"CRPSMILL")).when(k == 1, F.lit(b"SQLite format 3\x00")).otherwise(F.lit(b"other"))
    return table(spark, sf, "pages").select("page_id", fn.sniff_format(F.concat(head, F.col("html").cast("binary")), b"CRPSMILL").alias("format"))


@query("SELECT page_id, page_id * 1000 AS catalog_offset, page_id AS blob_offset, '00000000000000ff' AS checksum FROM pages")
def footer_fields(spark, sf):
    big = lambda n: F.unhex(F.lpad(F.hex(n), 16, "0"))
    data = F.concat(F.col("html").cast("binary"), F.lit(bytes(32)), big(F.col("page_id") * 1000), big(F.col("page_id")), big(F.lit(255).cast("long")))
    return table(spark, sf, "pages").select("page_id", fn.footer(data).alias("f")).select("page_id", "f.*")


@query("SELECT count(DISTINCT sha256(coalesce(text, ''))) AS blobs FROM documents")
def stream_dedup(spark, sf):
    """Documents arrive as a stream in two runs; the store holds every content once."""
    from corpusmill import streaming

    folder = new_dir(spark, "arriving")
    files = corpus(spark, sf)
    for half in range(2):
        files.where(F.pmod("file_id", F.lit(2)) == half).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(files.schema).parquet(f"{folder}/in")
        streaming.ingest(arriving, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/store").agg(F.countDistinct("sha").alias("blobs"))


