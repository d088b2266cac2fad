"""Operators on texts against plain Python, with awkward rows."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import langid, linededup, mixing, neardup, pii, quality, queries, sentencepiece, urlfilter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EMAILS = "x@y.zz-a@b.cc_d@e.ff, a@b..c, @a.b, q@r.s.t. u@v w.x@y-z.q1@p.o"
TEXTS = [None, "", " ", "\n", "one", "one two", "a b c\na b c\n A B C ", "é É ö\n" * 12, "x" * 200_000, "1" * 50_000, "a@" * 20_000, "\u2581 \u2028 \x00 \U0001f600 e\u0301", "the same line\nthe same line\nThe Same Line\t", EMAILS,
         "call +1 (212) 555-0000 or +49-30-123456-, 4111 1111 1111 1111, 4111-1111-1111-1112 10.0.0.1 1.2.3.4.5.6.7.8 256.1.1.1 007.08.9.10", "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not DE89370400440532013001; SSN 123-45-6789 but 123-45-6789"]


def odd(spark, extra=0):
    """All awkward texts, some twice, with null ids, sources and labels, and columns of clashing names."""
    rows = [(i, t, ("en", None, "de")[i % 3], ("s1", None, "")[i % 3], None) for i, t in enumerate(TEXTS)]
    rows += [(None, "one two three four five six", "en", "s2", 1), (3, "\n", None, None, 2), (3, "\n", None, None, 2), (100, TEXTS[12], None, "s1", 3)]
    rows += [(200 + i, f"filler {i} text\nshared line here", "en", "s1", 1) for i in range(extra)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("size", "rank", "key", "h", "hits", "rk", "score", "n", "class", "i", "at", "url", "findings", "fp"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, w):
    ws = words(t)
    return {tuple(ws[i : i + w]) for i in range(len(ws) - w + 1)} if len(ws) >= w else {tuple(ws)} if ws else set()


def groups(docs, w, pct):
    """Component id (index of the first row) of each row, by comparing all pairs."""
    sets, up = [shingles(t, w) for _, t in docs], list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= pct * max(len(a), len(b)) and 100 * len(a & b) >= pct * len(a | b):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(docs))], sets


# --- near duplicates


def near_table(rng, n=120):
    base = [f"w{x}" for x in rng.integers(0, 4000, 150)]
    docs = []
    for _ in range(n):  # a dense group around the threshold
        d = list(base)
        for p in rng.integers(0, 150, rng.integers(0, 6)):
            d[p] = f"n{rng.integers(0, 10**6)}"
        docs.append(" ".join(d))
    passage = " ".join(f"p{x}" for x in range(60))
    docs += [passage + " " + " ".join(f"q{x}" for x in rng.integers(0, 10**6, 20)) for _ in range(60)]
    docs += [" ".join(f"z{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(60)] + [docs[0]] * 20
    return docs


@pytest.mark.parametrize("width,pct,seed", [(3, 85, 0), (5, 80, 1)])
def test_near_duplicates(spark, width, pct, seed, monkeypatch):
    docs = [(i, t) for i, t in enumerate(near_table(np.random.default_rng(seed)))]
    want, sets = groups(docs, width, pct)
    if seed:  # small blocks, and star contraction all the way
        monkeypatch.setattr(neardup, "BLOCK", 16)
        monkeypatch.setattr(neardup, "ONE_TASK", 0)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("n", F.lit("clash"))
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df, width, pct).collect()}
    assert [got[i]["component_id"] for i, _ in docs] == want
    assert [got[i]["n_shingles"] for i, _ in docs] == [len(s) for s in sets]
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_no_link_of_the_documents_is_lost(spark):
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(zip(d["doc_id"], d["text"], strict=True))
    want, sets = groups(rows, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in queries.op6_neardup(spark, "/root/testdata/sf0.01").collect()}
    assert [got[i] for i, _ in rows] == [rows[g][0] for g in want]
    assert len(set(want)) < len(rows)


def test_blocks_of_long_texts(spark, monkeypatch):
    # blocks bounded by shingles, cells of several blocks on both sides, all cells searched on full sets
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 2000)
    docs = [(i, t) for i, t in enumerate(near_table(np.random.default_rng(2)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r["component_id"] for r in neardup.near_duplicates(df, 3, 85).orderBy("doc_id").collect()] == groups(docs, 3, 85)[0]


def test_cells_grow_with_outsiders_only(spark):
    rows = [(7, f"{i:05}".encode(), 100, b"0" if i < 4990 else f"{i:05}".encode()) for i in range(5000)]
    cells = neardup._cells(spark.createDataFrame(rows, "key long, fp binary, n long, comp binary"))
    assert cells.where("not out").count() == 5000 and cells.where("out").count() == 10 * -(-5000 // neardup.BLOCK)


def test_parities_lose_no_link():
    rng = np.random.default_rng(4)
    sets = [rng.choice(np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), n, replace=False) for n in (1, 2, 31, 33, 60, 70, 700, 1000, 1100, 3900, 4000)]
    sets += [s[: len(s) - len(s) // 9] for s in sets]
    held = neardup.Parities(map(neardup.parities, sets))
    every = np.arange(len(sets))
    for k, a in enumerate(sets):
        differ = held.differ(k, every)
        apart = np.array([len(np.setxor1d(a, b)) for b in sets])
        assert (differ <= apart).all() and differ[k] == 0
        sizes = np.array([len(a) + len(b) for b in sets])
        both = (sizes - apart) // 2
        for pct in (80, 85):
            near = neardup.near_enough(differ, sizes, pct)
            assert near[100 * both >= pct * (sizes - both)].all()
            assert not near[(2 * both < sizes - both) & (np.abs(sizes - 2 * len(a)) < len(a) / 5) & (len(a) >= 60)].any()


def test_full_sets_only_where_parities_allow_a_link(spark, monkeypatch):
    # documents of one form, alike to sketches but no links
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in range(150)]
    docs = [(i, " ".join(f"n{rng.integers(0, 10**6)}" if p % 25 == rng_at else w for p, w in enumerate(base))) for i, rng_at in enumerate(rng.integers(0, 25, 60))]
    docs += [(100, docs[0][1] + " end")]
    staged, stage = {}, neardup.stage

    def counted(df, label):
        out = stage(df, label)
        staged[label] = staged.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(neardup, "stage", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r["component_id"] for r in neardup.near_duplicates(df, 3, 85).orderBy("doc_id").collect()] == [*range(60), 0]
    assert staged["open"] > 60 and staged["sets"] == 2 and staged["dense"] == 0


def test_near_duplicates_odd(spark):
    df = odd(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = neardup.near_duplicates(df, 3, 85).collect()
    assert len(got) == len(rows)
    want, sets = groups(rows, 3, 85)
    by = {}
    for (i, _), g in zip(rows, want, strict=True):
        by.setdefault(g, []).append(i)
    expect = Counter((i, len(s), i if not s else min((x for x in by[g] if x is not None), default=None)) for (i, _), g, s in zip(rows, want, sets, strict=True))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expect
    assert neardup.near_duplicates(empty(spark), 3, 85).count() == 0


def test_miss_is_bounded():
    for pct in (80, 85, 90):
        m, least = neardup.plan(pct)
        p = (pct / 100) ** neardup.BAND
        assert (1 - p) ** m + m * p * (1 - p) ** (m - 1) <= 2e-4 and 0 < least < m * neardup.BAND


# --- lines


def line_result(rows, least):
    strip = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    count = Counter(k for _, t in rows for k in {strip(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not strip(x) or count[strip(x)] < least]
        out.append((i, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("least,batches", [(10, 3), (2, 1), (2, 7)])
def test_line_dedup(spark, least, batches):
    df = odd(spark, 15)
    got = linededup.dedup_lines(df, min_docs=least, batches=batches, fanout=2)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    digest = got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    assert Counter(tuple(r) for r in digest.collect()) == line_result([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], least)
    assert linededup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_keeps_first(spark):
    rows = [(i, f"own {i}\nCommon line\n") for i in range(12)] + [(None, "common line")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 10, keep_first=True).collect()}
    assert got[0] == "own 0\nCommon line\n" and got[1] == "own 1\n" and got[None] == ""


def test_runs_are_levelled_and_incremental(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    out = []
    for b in range(5):
        batch = spark.createDataFrame([(10 * b, f"always\nbatch {b}\n batch {b}"), (10 * b + 1, "always\nbatch 0")], "doc_id long, text string")
        out.append(sorted((r["doc_id"], r["pos"], r["line"]) for r in runs.fresh_lines(batch).collect()))
    assert out[0] == [(0, 0, "always"), (0, 1, "batch 0")] and out[3] == [(30, 1, "batch 3")]
    assert runs.levels == [1, 0, 1] and sorted(runs.tables) == ["level0", "level2"]  # five batches, merged in twos
    for name in runs.tables:
        for f in {r[0] for r in runs.table(name).select(F.input_file_name()).distinct().collect()}:
            h = [r["h"] for r in spark.read.parquet(f).collect()]
            assert h == sorted(h)
    held = {r["h"]: r["n"] for r in runs.merged().collect()}
    assert len(held) == 6 and max(held.values()) == 10
    runs.close()


def test_runs_are_merged_and_looked_up_in_place(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = linededup.LineRuns(spark, fanout=3, enough=8)
        batch = lambda k: spark.createDataFrame([(i, [1, 2, i]) for i in range(10 * k, 10 * k + 4)], "doc_id long, hs array<long>")
        for k in range(3):
            runs.add(batch(k))
        assert sorted(runs.tables) == ["frequent", "level1"]  # what has reached the count is kept apart
        assert sorted(r["h"] for r in runs.table("frequent").collect()) == [1, 2]
        runs.add(batch(3))
        assert sorted(r["h"] for r in runs.table("level0").collect()) == [30, 31, 32, 33]  # the others need no more counting
        assert "Exchange" not in plan(runs._merged("level1"))
        look = plan(runs.unseen(spark.range(10).select(F.col("id").alias("h")), "level1"))
        assert look.count("Exchange") == 1 and "LeftAnti" in look  # the batch's
        assert {r["h"]: r["first"] for r in runs.merged().collect() if r["n"] >= 8} == {1: 0, 2: 0}
        runs.close()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("keep_first", [False, True])
def test_frequent_lines_beyond_a_broadcast(spark, monkeypatch, keep_first):
    rows = [(i, f"own {i}\nCommon line\n") for i in (*range(40, 60), *range(40))] + [(None, "common line"), (None, "x\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    done = lambda: Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in linededup.dedup_lines(df, 10, keep_first=keep_first).collect())
    want = done()
    monkeypatch.setattr(linededup, "SIDE_ROWS", 0)
    assert done() == want and want[(0, "own 0\nCommon line\n" if keep_first else "own 0\n", 0 if keep_first else 1)] == 1


# --- personal data


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 1) % 9 + 1 if c != "0" else 0 for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    gate = {"email": "@", "ip": ".", "card": "", "phone": "+"}  # without it a long text would only cost time
    return sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(kinds.items()) if gate[k] in (t or "") for m in re.finditer(p, t or "") if ok[k](m[0]))


def check_pii(rows, got):
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        s = base_spans(t if t is None or t.count("a@") < 1000 else "")
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
        want[(i, *(sum(x[2] == k for x in s) for k in ("email", "ip", "card", "phone")), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want


def test_pii(spark):
    df = odd(spark)
    got = pii.digest(pii.find(df)).collect()
    check_pii([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], got)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert re.sub(r":\d+:\d+", "", spans[15]) == "iban,iban,ssn,ssn"
    assert pii.digest(pii.find(empty(spark))).count() == 0


def test_pii_context_reaches_over_other_matches(spark):
    ssn = "123-45-6789"
    near = [f"ssn {ssn} but {ssn}", f"{ssn} {ssn} {ssn} ssn", f"ssn{'.' * 26}{ssn}{ssn}", f"{ssn} a@b.c 1.2.3.4 +1 2 SSN"]
    far = [f"ssn {'x' * 38} {ssn}", f"{ssn} {'x' * 38} ssn"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(near + far)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].count("ssn:") for r in pii.digest(pii.find(df)).collect()}

    def want(t):
        return sum("ssn" in (t[max(0, m.start() - 40) : m.start()] + " " + t[m.end() : m.end() + 40]).lower() for m in re.finditer(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", t))

    assert [got[i] for i in range(6)] == [want(t) for t in near + far] and got[0] == 2 and got[4] == got[5] == 0


def test_pii_of_many_matches(spark):
    n = 30_000
    t = "ssn 123-45-6789 but a@b.cd 1.2.3.4 " * n
    r = pii.digest(pii.find(spark.createDataFrame([(1, t)], "doc_id long, text string"))).collect()[0]
    assert (r["n_email"], r["n_ip"], r["spans"].count("ssn")) == (n, n, n) and r["spans"].endswith(f"email:{35 * n - 15}:{35 * n - 9},ip:{35 * n - 8}:{35 * n - 1}")


def test_pii_random(spark):
    rng = np.random.default_rng(2)
    alphabet = list("ab.@-_ 019+()") + ["12", "4111 1111 1111 1111", "é", "\n", "10.0.0.1", "a@b.c"]
    rows = [(i, "".join(rng.choice(alphabet, 60))) for i in range(1500)]
    check_pii(rows, pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect())


def test_pii_context_and_redaction(spark):
    rows = [("number 123-45-6789 here",), ("social security 123-45-6789",), ("mail a@b.cd now",)]
    out = pii.redact(pii.find(spark.createDataFrame(rows, "text string")), name="r").collect()
    assert [len(r["findings"]) for r in out] == [0, 1, 1]
    assert [r["r"] for r in out] == ["number 123-45-6789 here", "social security <ssn>", "mail <email> now"]
    assert out[2]["findings"][0]["score"] == pytest.approx(0.9)


def test_redaction_of_many_and_overlapping_spans(spark):
    rng = np.random.default_rng(7)
    bits = ["4111 1111 1111 1111", "+1 212 555 0000", "a@b.cd", "10.0.0.1", "é\U0001f600", " plain ", "\n", "+4111111111111111"]
    rows = [(i, "".join(rng.choice(bits, n))) for i, n in enumerate([0, 1, 3, 30, 400, 3000])] + [(9, None)]
    got = pii.redact(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    for r in got:
        if not r["text"]:
            assert r["redacted"] == r["text"]
            continue
        at, out = 0, ""
        for f in r["findings"]:
            if f["start"] >= at:
                out += r["text"][at : f["start"]] + f"<{f['kind']}>"
            at = max(at, f["end"])
        assert r["redacted"] == out + r["text"][at:]
    assert len(got) == 7 and "findings" in got[0].asDict()


# --- mixing


def test_mixing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.lognormal(3, 1))), ["a", "a", "a", "b", "c", "d", None][i % 7]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    again = mixing.mix(df.repartition(7)).toPandas()
    assert got.set_index("doc_id")["copies"].to_dict() == again.set_index("doc_id")["copies"].to_dict()
    assert len(got) == 3000 and got["copies"].between(0, 2).all()
    size = np.array([len(words(t)) for _, t, _ in rows])
    assert got.sort_values("doc_id")["size"].tolist() == size.tolist()
    by = {s: sum(n for n, (_, _, x) in zip(size, rows, strict=True) if x == s) for s in ("a", "b", "c", "d", None)}
    weights, total = dict(zip(("a", "b", "c", "d", None), (5, 2, 1, 5, 2), strict=True)), 1.5 * sum(by.values())
    stopped = set()
    while True:  # excess is shared again until nothing is above its stop
        left = total - sum(2 * by[s] for s in stopped)
        open_ = {s: left * weights[s] / sum(weights[x] for x in by if x not in stopped) for s in by if s not in stopped}
        over = {s for s, t in open_.items() if t > 2 * by[s]}
        if not over:
            break
        stopped |= over
    target = {s: 2 * by[s] if s in stopped else open_[s] for s in by}
    for s, part in got.groupby("source", dropna=False):
        s = None if pd.isna(s) else s
        assert part["target"].iloc[0] == pytest.approx(target[s]) and part["source_size"].iloc[0] == by[s]
        assert (part["copies"] * part["size"]).sum() == pytest.approx(target[s], rel=0.02)
    assert mixing.emit(df, mixing.mix(df)).count() == got["copies"].sum()


def test_mixing_odd(spark):
    df = odd(spark)
    got = mixing.mix(df).toPandas()
    assert len(got) == df.count() and (got.loc[got["size"] > 0, "copies"] <= 2).all()
    assert mixing.emit(df, mixing.mix(df)).columns == df.columns
    assert mixing.mix(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["copies"]) for r in mixing.mix(nothing).collect()] == [(0, 0), (0, 0)]


# --- URLs


def url_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest, maxsplit=1)[0])
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    best = None
    for rule, verdict in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")):
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best and best[0], best and best[1]


def test_urls(spark):
    urls = [None, "", "http://", "no scheme", "http://NET/", "http://a.net", "http://a.net/x", "https://Example.NET/en/1?x#y", "http://example.net/en", "http://xexample.net/en/1", "http://b.example.com/de/?q", "http://b.example.com/DE/", "x://org/fr/", "x://a.b.org/fr/x#", "http://a.net?://b.org/fr/", "http://a.org/fr/://x.net/", "http://a.com/login", "http://free-casino.com/", "http://a.com/casino", "http://a.net/\n/x", "http://exa\nmple.net/en/"]
    rows = list(enumerate(urls)) + [(3, urls[6]), (None, urls[6])]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "name": F.lit("clash"), "token": F.lit("t")})).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = url_verdict(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r["url"]
        if verdict:
            assert r["verdict"] == verdict
    by = {r["url"]: r["verdict"] for r in got}
    assert by["http://a.com/login"] == by["http://free-casino.com/"] == "block" and by["http://a.com/casino"] == by["no scheme"] == by[None] == "allow"
    tokens = urlfilter.rarest_tokens(spark.createDataFrame([("http://example.net/en/",), ("http://example.net/",)], "url string"), urlfilter.HOST_RULES)
    assert tokens[1] == "en"
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_rules_of_any_number(spark, monkeypatch, tmp_path):
    names = [f"h{i}.example/p{i % 7}/" for i in range(300)]
    (tmp_path / "rules.txt").write_text("# kept by people\n\nallow ~/q[0-9]+/ example\n" + "".join(f"block {n}\n" for n in names))
    rules = urlfilter.read_rules(spark, str(tmp_path / "rules.txt"))
    assert [r.name for r in rules] == ["/q[0-9]+/", *names]
    # a URL in a third of all rows is no group of its own: nothing is dealt out
    urls = [f"http://a.H{i}.example/p{i % 5}/x" for i in range(300)] + ["http://h7.example/p0/"] * 150 + ["http://z.example/q1/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = [f"h{i}.example/p{i % 7}/" if i % 7 == i % 5 else None for i in range(300)] + ["h7.example/p0/"] * 150 + [None]
    for size in (1 << 20, 5000):
        monkeypatch.setattr(urlfilter, "INDEX_BYTES", size)
        got = urlfilter.judge(df, rules, "pass")
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and "Python" not in got._jdf.queryExecution().executedPlan().toString()
        rows = got.orderBy("page_id").collect()
        assert [r["rule"] for r in rows] == want and rows[-1]["verdict"] == "allow" and rows[4]["verdict"] == "block"
        assert {r["verdict"] for r, w in zip(rows[:-1], want, strict=False) if w is None} == {"pass"}


def spellings(nodes):
    """A text for each way through a parsed pattern: every branch, optional part and listed character."""
    out = [""]
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            some = [chr(arg)]
        elif name == "IN":
            some = ["q"] if str(arg[0][0]) == "NEGATE" else [chr(x) for _, x in arg]
        elif name == "MAX_REPEAT":
            some = [t for n in {arg[0], min(arg[1], 1)} for t in ([""] if n == 0 else spellings(arg[2]))]
        elif name == "SUBPATTERN":
            some = spellings(arg[3])
        elif name == "BRANCH":
            some = [t for x in arg[1] for t in spellings(x)]
        else:
            assert name == "AT", name
            some = [""]
        out = [x + y for x in out for y in some]
    return out


def test_every_pattern_alternative_is_fetched(spark):
    urls = []
    for rule in urlfilter.PATTERN_RULES:
        for t in spellings(re._parser.parse(rule.regex)):
            for x in (t, t.upper()):
                start = "http" if x.startswith("://") else "http://a.com"
                urls += [start + x + end for end in ("", "x", "-x", "_x", ".com/", "/x", "?x=y")]
    assert {"http://a.com/sign-up", "http://a.com/signup", "http://a.com/wp-login.php?", "http://a.com/SHOPPING-CART/"} <= set(urls)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = urlfilter.judge(df).toPandas().sort_values("page_id")
    fitting = [[r.name for r in urlfilter.PATTERN_RULES if re.search(r.regex, u.lower())] for u in urls]
    assert {n for names in fitting for n in names} == {r.name for r in urlfilter.PATTERN_RULES}
    assert got["rule"].isna().all()
    assert [u for u, v, p, names in zip(urls, got["verdict"], got["pattern"], fitting, strict=True) if (v == "block") != bool(names) or (names and p not in names)] == []
    db = duckdb.connect()
    db.register("pages", pd.DataFrame({"page_id": range(len(urls)), "url": urls}))
    assert got["verdict"].tolist() == db.execute(urlfilter.ORACLE).df().sort_values("page_id")["verdict"].tolist()


# --- quality and language


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").select("doc_id", "score", "quality", quality.held_out(F.col("doc_id")).alias("out")).toPandas()
    assert got["out"].tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]
    out = got[got["out"]]
    assert ((out["score"] >= 0.5) == (out["quality"] == 1)).mean() >= 0.95
    # the compiled column and the rules in Python agree
    feats, r = quality.with_features(docs)
    x = feats.select("doc_id", *[r[k].alias(k) for k in quality.FEATURES]).toPandas()
    assert np.allclose(model.scores(x[list(quality.FEATURES)].to_numpy()), quality.score(docs, model).select("doc_id", "score").toPandas().set_index("doc_id").loc[x["doc_id"], "score"])


def test_rejected_rows_are_counted_and_statistics_computed_once(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    kept = quality.keep(docs, model)
    nodes = [line.strip(" +-:") for line in kept._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    kinds = [n.split()[0] for n in nodes]
    assert kinds.count("Filter") == 1 and kinds.index("Filter") < kinds.index("CollectMetrics") and "split" not in nodes[kinds.index("Filter")]
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.score(docs, model).where("score >= 0.5").collect()}


def test_quality_odd(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)] + [(None, 1), (4, None)], "doc_id long, quality int")
    df = odd(spark)
    for lab in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality.score(df, quality.fit(df, lab)).toPandas()
        assert len(got) == df.count() and got["score"].between(0, 1).all()
    assert quality.score(empty(spark), quality.fit(empty(spark), labels)).count() == 0


def naive_phrases(text, sample):
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        n, at = n + 1, at + k
    return n


def test_cross_parsing_counts():
    rng = np.random.default_rng(0)
    a, b = ("".join(rng.choice(list("abcde "), 400)) for _ in range(2))
    model = langid.Model({"x": a, "y": b})
    texts = ["".join(rng.choice(list("abcdefg "), n)) for n in (1, 7, 100, langid.SEGMENT, langid.SEGMENT + 1, 1500)]
    got = model.phrases(texts)
    for t, row in zip(texts, got, strict=True):
        parts = [t[i : i + langid.SEGMENT] for i in range(0, len(t), langid.SEGMENT)]
        assert row.tolist() == [sum(naive_phrases(p, s) for p in parts) for s in (a, b)]


def test_cross_parsing_of_unknown_characters():
    model = langid.Model({"x": "abc"})
    assert [int(model.phrases([t])[0, 0]) for t in ("a", "afa", "abcfabc", "f", "ffff", "fab", "abca")] == [1, 3, 3, 1, 4, 2, 2]
    assert langid.Model({"x": "a"}).phrases(["aab"])[0, 0] == 3  # a sample of one character


def test_only_letters_make_a_language():
    assert langid.normal("\u00b2 \u00bd \u2460 12 _") == "" and langid.normal("\u0301") == ""
    assert langid.normal("\u0939\u093f\u0928\u094d\u0926\u0940 2x") == " \u0939\u093f\u0928\u094d\u0926\u0940 x "  # marks stay in their word
    model = langid.Model({"x": " abc "})
    assert model.predict(["\u00b2", "\u2460 1", None, "a"])[0] == ["und", "und", "und", "x"]


def test_an_alphabet_of_thousands(spark):
    # 3,000 characters in 60,000: too wide for a table, so edges are searched; and a tiny sample beside it
    rng = np.random.default_rng(9)
    wide = lambda n: "".join(chr(0x4E00 + int(x)) for x in rng.zipf(1.3, n) % 3000)
    rows = [(i, wide(800), "zh") for i in range(80)] + [(100 + i, "plain words of the other one " * 3, "en") for i in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.automata[model.langs.index("zh")].bytes > langid.TABLE_BYTES
    assert model.predict([wide(300), "other plain words", wide(30)])[0] == ["zh", "en", "zh"]


def test_sample_texts_are_cut_on_executors(spark):
    seen = {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(langid, "Model", lambda samples: seen.update(samples))
        langid.fit(spark.createDataFrame([("1 " * 10_000 + "abc " * 100_000, "xx")], "text string, lang string"), sample_chars=50)
    assert seen == {"xx": (" " + "abc " * 100)[:50]}


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    got = langid.identify(docs, langid.fit(docs.where(~out))).join(docs.select("doc_id", "lang", out.alias("out")), "doc_id").toPandas()
    assert got["out"].tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]
    assert (got[got["out"]]["lang_pred"] == got[got["out"]]["lang"]).mean() >= 0.97
    df = odd(spark)
    some = langid.identify(df, langid.fit(docs.where(~out))).toPandas()
    assert len(some) == df.count() and some["score"].between(0, 1).all()
    by = some.dropna(subset=["doc_id"]).set_index("doc_id")["lang_pred"]
    assert all(by[i] == "und" for i in (0, 1, 2, 9)) and by[4] != "und"
    assert set(langid.identify(df, langid.fit(empty(spark))).toPandas()["lang_pred"]) == {"und"}
    assert langid.identify(empty(spark), langid.fit(docs)).count() == 0


@pytest.mark.parametrize("stray", ["a", "the", "on line", "read more here"])
def test_language_with_a_rare_label(spark, stray):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    rare = spark.createDataFrame([(-1, stray, "zz")], docs.schema)
    got = langid.identify(docs.where(out), langid.fit(docs.where(~out).unionByName(rare))).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() >= 0.97


def test_a_short_sample_is_learned_and_weakens_only_itself():
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").dropna(subset=["text", "lang"])
    out = d["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    full = {k: "".join(map(langid.normal, g["text"]))[:60_000] for k, g in d[~out].groupby("lang")}
    test = d[out]
    for rare in full:
        model = langid.Model(full | {rare: full[rare][:300]})
        right = np.array(model.predict([t[:512] for t in test["text"]])[0]) == test["lang"].to_numpy()
        assert right.mean() >= 0.97 and right[test["lang"] == rare].mean() >= 0.9


def test_every_label_is_learned(spark):
    rng = np.random.default_rng(5)
    words_of = {f"l{k:02}": ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(40)] for k in range(70)}
    text = lambda k: " ".join(rng.choice(words_of[k], 50))
    rows = [(i, text(k), k) for i, k in enumerate(k for k in words_of for _ in range(2 if k < "l06" else 4))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted(words_of)
    ask = spark.createDataFrame([(i, text(k), k) for i, k in enumerate(words_of)], "doc_id long, text string, lang string")
    got = langid.identify(ask, model).join(ask.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang_pred"] == got["lang"]).all() and len(got) == 70


def test_counts_whatever_the_room_for_tables(monkeypatch):
    rng = np.random.default_rng(6)
    samples = {k: "".join(rng.choice(list(a), 500)) for k, a in (("x", "abcde "), ("y", "cdefgh "), ("z", "\u4e00\u4e01ab "))}
    texts = ["".join(rng.choice(list("abcdefgh\u4e00\u4e01q "), n)) for n in (1, 100, langid.SEGMENT + 1, 1500)]
    model = langid.Model(samples)
    want = model.phrases(texts).tolist()
    assert len(model.kept) == 3
    sizes = [a.bytes for a in model.automata]
    for room, kept in ((max(sizes), 1), (0, 0)):
        monkeypatch.setattr(langid, "TABLE_BYTES", room)
        model = langid.Model(samples)
        assert model.phrases(texts).tolist() == want and len(model.kept) == kept
    assert [langid.Model({k: s}).phrases(texts)[:, 0].tolist() for k, s in samples.items()] == np.array(want).T.tolist()


def test_sample_is_of_distinct_texts(spark):
    # 2000 copies of each of five texts, and one text in letters among many without
    rows = [(f"copied text {'abcde'[i % 5] * 3} number {'vwxyz'[i % 5] * 4}", "xx") for i in range(10_000)]
    rows += [(f"{i} {i * 7}", "yy") for i in range(5000)] + [("only these letters", "yy")]
    rows += [("one and the same", "ww")] * 3000 + [(f"own {chr(97 + i // 26) * 2}{chr(97 + i % 26) * 3}", "ww") for i in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    seen = {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(langid, "Model", lambda samples: seen.update(samples))
        langid.fit(df)
    for lang in ("xx", "yy", "ww"):
        want = {langid.normal(t) for t, k in rows if k == lang} - {""}
        assert sorted(seen[lang].strip().split("  ")) == sorted(x.strip() for x in want)


# --- SentencePiece


@pytest.fixture(scope="module")
def coder():
    if not os.path.exists(sentencepiece.DEFAULT_MODEL):
        pytest.skip("no vocabulary")
    return sentencepiece.Coder(sentencepiece.load())


def best_score(coder, v, text):
    """The best total over all segmentations, by plain dynamic programming."""
    import math

    scores = {p.replace("\u2581", " "): -math.log(max(0.0, -s) + math.e) for p, s, t in zip(v.pieces, v.scores, v.types, strict=True) if t in (1, 4)}
    longest = max(map(len, scores))
    best = [0.0] + [-math.inf] * len(text)
    for e in range(1, len(text) + 1):
        for b in range(max(0, e - longest), e):
            if text[b:e] in scores:
                best[e] = max(best[e], best[b] + scores[text[b:e]])
        if text[e - 1] not in scores:
            best[e] = max(best[e], best[e - 1] + coder.miss)
    return best[-1], scores


def random_texts():
    rng = np.random.default_rng(11)
    parts = [*"aeinost ", " the", "ing", "  ", "\n", "tion", "\u2581", "\u65e5", "\u00e9", "\U0001f600", "1", "12", "&", "aa", "\t"]
    return ["".join(rng.choice(parts, n)) for n in rng.integers(1, 60, 150)]


@pytest.mark.parametrize("text", ["Hello world, this is  a test\nof   pieces\t", "\u65e5\u672c\u8a9e \u00e9 \u00f1 \u2581", "&&&& $$$ 12345", "x", "aaaaaaaaaaaaaaaaa", *random_texts()])
def test_viterbi_is_best(coder, text):
    v = sentencepiece.load()
    want, scores = best_score(coder, v, " " + text)
    total = 0.0
    ids = coder.encode(text).tolist()
    run = b""
    for i in ids + [None]:
        if i is not None and v.types[i] == sentencepiece.BYTE:
            run += coder.bytes_of[i]
            continue
        total += coder.miss * len(run.decode())
        run = b""
        if i is not None:
            total += scores[v.pieces[i].replace("\u2581", " ")]
    assert total == pytest.approx(want, abs=1e-6)
    assert coder.decode(ids) == text


def test_ties_go_to_the_longer_last_piece():
    tie = sentencepiece.Vocabulary(("<unk>", "a", "b", "c", "ab", "bc"), (0.0, -1.0, -1.0, -1.0, -2.0, -2.0), (2, 1, 1, 1, 1, 1), sentencepiece.UNIGRAM, False)
    assert sentencepiece.Coder(tie).encode("abc").tolist() == [1, 5] and sentencepiece.Coder(tie).encode("ab").tolist() == [4]


def test_encode_and_decode(spark, coder):
    df = odd(spark)
    v = sentencepiece.load()
    enc = sentencepiece.encode(df, v).toPandas()
    assert len(enc) == df.count() and enc["round_trip"].dropna().all() and enc["round_trip"].isna().sum() == 1
    assert enc["n_tokens"].tolist() == [0 if i is None else len(i) for i in enc["ids"]]
    back = sentencepiece.decode(sentencepiece.encode(df, v), v)
    assert Counter(r["text"] for r in back.collect()) == Counter(r["text"] for r in df.select("text").collect())
    assert sentencepiece.encode(empty(spark), v).count() == 0


# --- registered queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.execute(queries.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()), key=str)
    assert rows(got) == rows(want)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    from corpusmill.plans.staging import stage

    for name, f in corpus_pipeline.STAGES:
        before, docs = docs, stage(f(spark, docs, SF), "t")
        seen.append((name, before.count(), docs.count()))
        if f is not corpus_pipeline.encode:
            assert docs.columns == columns
        texts = {r["doc_id"]: r["text"] for r in before.collect()}
        if name == "quality classifier":
            model = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r["doc_id"]: r["text"] for r in quality.score(before, model).where("score >= 0.5").collect()}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == want and 0 < len(want) < len(texts)
        if name == "line dedup":
            strip = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
            where = {}
            for i, t in texts.items():
                for k in {strip(x) for x in (t or "").split("\n")} - {""}:
                    where.setdefault(k, set()).add(i)
            goes = lambda i, x: len(where.get(strip(x), ())) >= 10 and i != min(where[strip(x)])
            want = {i: t if t is None else "\n".join(x for x in t.split("\n") if not goes(i, x)) for i, t in texts.items()}
            got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
            assert {i: t for i, (t, _) in got.items()} == want and all(n == len(t) for t, n in got.values() if t is not None) and want != texts
        if name == "mixing":
            taken = Counter((r["doc_id"], r["text"]) for r in docs.collect())
            assert max(taken.values()) <= 2 and all(texts[i] == t for i, t in taken)
            words_in = lambda rows: sum(len(words(t)) * n for (_, t), n in rows)
            assert words_in(taken.items()) == pytest.approx(1.5 * words_in(((i, t), 1) for i, t in texts.items()), rel=0.1)
        if name == "near-dedup":
            rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
            want = groups(rows, 5, 80)[0]
            keep = {rows[i][0] for i, g in enumerate(want) if i == g or not words(rows[i][1])}
            assert {r["doc_id"] for r in docs.collect()} == keep
    assert [n for n, *_ in seen] == ["quality classifier", "line dedup", "near-dedup", "mixing", "sentencepiece"]
    assert seen[1][1] == seen[1][2] and docs.where("not round_trip").count() == 0
    back = sentencepiece.decode(docs, sentencepiece.load())
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], r["text"]) for r in before.collect())
    df = odd(spark, 12).select("doc_id", "text", "lang", "source", "n_chars")
    for _, f in corpus_pipeline.STAGES:
        df = stage(f(spark, df, SF), "t")
    assert corpus_pipeline.run(spark, SF).count() == seen[-1][2]
