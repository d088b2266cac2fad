"""Language identification by cross-parsing against suffix automata.

Per language, a bounded sample of labelled text becomes a suffix automaton.  A text is parsed greedily
into the longest phrases that occur in a language's sample; the fewer phrases a character, the closer
the text to the language: phrases are normalised to ``phrases * log2(sample + SMOOTH) / characters``,
the cross-parsing estimate of bits a character, by the length of the language's own sample.  Without
``SMOOTH`` a sample of a few letters would name its phrases in so few bits that it wins every text; a
phrase that is a character the sample lacks takes ``LITERAL`` bits more.
The language with the fewest bits wins; ties go to the smaller name.

Every label is learned.  Automata are held by their edges and laid out one language at a time as a
table ``next[state, class]`` whose low bit says that a phrase begins, so a whole batch of texts advances
one character at a time in numpy; tables stay as far as ``TABLE_BYTES`` go.  Texts are read whole, in segments of
fixed length that are parsed side by side; a phrase never crosses a segment.

Letters, with the marks that belong to them, are lower-cased; runs of anything else are one space.  Null
texts and texts without a letter are ``und`` with score 0.  The score compares the two best: ``1 - best / second``, mapped to 0.5..1
by ``1 / (1 + exp(-20 x))``; with one learned language it is 1, with none every text is ``und``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.plans.staging import ship_package

SEGMENT = 512
SMOOTH = 256
LITERAL = 4
#: Of the laid-out automata a Python worker keeps, and of the largest it lays out.
TABLE_BYTES = 256 << 20
LETTER = r"\p{L}"
_LETTER, _SPACE = regex.compile(LETTER), regex.compile(r"[^\p{L}\p{M}]+")


def normal(text: str | None) -> str:
    """Lower-cased letters and their marks with single spaces around each run; empty without letters."""
    if not text or not _LETTER.search(text):
        return ""
    return f" {_SPACE.sub(' ', text.lower()).strip()} "


class Alphabet:
    """Characters of the samples as classes 1..; 0 is any other."""

    def __init__(self, chars: str):
        self.chars = "".join(sorted(set(chars)))
        self.size = len(self.chars) + 1
        points = np.array([ord(c) for c in self.chars], np.int64)
        self.table = np.zeros(int(points.max()) + 2 if len(points) else 1, np.int32)
        self.table[points] = np.arange(1, self.size)

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        return self.table[np.minimum(points, len(self.table) - 1)]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions by state; state 0 is the root, and every path from it spells a substring."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Automaton:
    """The automaton of one sample over its own characters, an entry an edge."""

    def __init__(self, codes: np.ndarray):
        self.chars = np.unique(codes)
        self.size = len(self.chars) + 1
        nxt = suffix_automaton((np.searchsorted(self.chars, codes) + 1).tolist())
        self.bytes = len(nxt) * self.size * 4  # of the table
        root = np.zeros(self.size, np.int64)
        for c, to in nxt[0].items():
            root[c] = to
        # no phrase is open in state 0, so every character begins one there: before the first character, and
        # after one that the sample lacks, which is a phrase by itself
        nxt[0] = {}
        self.miss = root * self.size * 2 + 1
        end = np.iinfo(np.int64).max  # there is always an entry to find
        self.keys = np.array([*(s * self.size + c for s, edges in enumerate(nxt) for c in sorted(edges)), end], np.int64)
        self.to = np.array([*(edges[c] for edges in nxt for c in sorted(edges)), 0], np.int32)

    def own(self, classes: int) -> np.ndarray:
        """The class here of each class of the shared alphabet."""
        out = np.zeros(classes, np.int32)
        out[self.chars] = np.arange(1, self.size)
        return out

    def table(self) -> np.ndarray:
        """``table[state * size + class]`` = next state * size * 2 + 1 if this character begins a phrase."""
        table = np.empty((self.bytes // 4 // self.size, self.size), np.int32)
        table[:] = self.miss
        table = table.ravel()
        table[self.keys[:-1]] = self.to[:-1] * self.size * 2
        return table

    def search(self, at: np.ndarray) -> np.ndarray:
        """What the table holds at these places, without the table."""
        i = np.searchsorted(self.keys, at)
        return np.where(self.keys[i] == at, self.to[i].astype(np.int64) * (self.size * 2), self.miss[at % self.size])


class Model:
    """Automata of the samples, each of its own length, by language."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.alphabet = Alphabet("".join(samples.values()))
        self.bits = np.log2([len(samples[k]) + SMOOTH for k in self.langs])
        self.automata = [Automaton(self.alphabet.encode(samples[k])) for k in self.langs]
        self.kept: dict[int, np.ndarray] = {}

    def table(self, lang: int) -> np.ndarray | None:
        """Kept as long as all kept tables have room, else made anew; none for a table that is larger alone."""
        if lang in self.kept:
            return self.kept[lang]
        auto = self.automata[lang]
        if auto.bytes > TABLE_BYTES:
            return None
        table = auto.table()
        if sum(t.nbytes for t in self.kept.values()) + auto.bytes <= TABLE_BYTES:
            self.kept[lang] = table
        return table

    def phrases(self, texts: list[str]) -> np.ndarray:
        """``(texts, languages)`` phrase counts of normalised texts."""
        return self.parsed(texts)[0]

    def parsed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The phrase counts, and how many of them are characters that the language's sample lacks."""
        codes = [self.alphabet.encode(t) for t in texts]
        flat, text_of = np.concatenate([np.zeros(0, np.int32), *codes]), np.repeat(np.arange(len(texts)), [len(c) for c in codes])
        owner = np.repeat(np.arange(len(texts)), [-(-len(c) // SEGMENT) for c in codes])
        parts = [c[i : i + SEGMENT] for c in codes for i in range(0, len(c), SEGMENT)]
        lengths = np.array([len(p) for p in parts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        wide = np.zeros((SEGMENT, len(parts)), np.int32)
        for k, i in enumerate(order):
            wide[: lengths[i], k] = parts[i]
        live = np.searchsorted(-lengths[order], -np.arange(SEGMENT), "left")  # segments longer than t
        out, lacked = (np.zeros((len(texts), len(self.langs)), np.int64) for _ in range(2))
        for lang, auto in enumerate(self.automata):
            table, own = self.table(lang), auto.own(self.alphabet.size)
            state = np.zeros(len(parts), np.int64 if table is None else np.int32)
            count = np.zeros(len(parts), np.int64)
            for t in range(SEGMENT):
                n = live[t]
                if not n:
                    break
                at = state[:n] + own[wide[t, :n]]
                v = auto.search(at) if table is None else table[at]
                count[:n] += v & 1
                state[:n] = v >> 1
            out[:, lang] = np.bincount(owner[order], weights=count, minlength=len(texts))
            lacked[:, lang] = np.bincount(text_of[own[flat] == 0], minlength=len(texts))
        return out, lacked

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        normals = [normal(t) for t in texts]
        some = [i for i, t in enumerate(normals) if t]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not some or not self.langs:
            return langs, scores
        phrases, lacked = self.parsed([normals[i] for i in some])
        bits = (phrases * self.bits + lacked * LITERAL) / np.array([len(normals[i]) for i in some])[:, None]
        for i, row in zip(some, bits, strict=True):
            best = int(row.argmin())
            second = np.delete(row, best).min() if len(row) > 1 else math.inf
            langs[i] = self.langs[best]
            scores[i] = 1.0 if second == math.inf else 1.0 / (1.0 + math.exp(-20.0 * (1.0 - row[best] / second)))
        return langs, scores


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


def fit(labelled: DataFrame, sample_chars: int = 60_000, sample_docs: int = 400, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of a bounded sample: of each language, distinct texts that hold a letter, in order of a
    hash, at most ``sample_docs``, until ``sample_chars`` normalised characters.  Texts are normalised and
    cut to what can be wanted of them before they leave the executors."""
    ship_package(labelled.sparkSession)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normal(t)[:sample_chars])

    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    near = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col, F.lit(7)).alias("h"))
    near = near.where(F.rlike("text", F.lit(LETTER)))
    # by the counts, about twice the texts wanted pass the hash, however many there are; copies pass together
    rate = near.groupBy("lang").agg(F.least(F.lit(1.0), 2.0 * sample_docs / F.count_distinct("h")).alias("rate"))
    near = near.join(F.broadcast(rate), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("rate") * float(1 << 30))  # a row a language
    near = near.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "h", cut("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("h")
    chars = F.sum(F.char_length("text")).over(first.rowsBetween(Window.unboundedPreceding, -1))
    taken = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample_docs).withColumn("before", F.coalesce(chars, F.lit(0))).where(F.col("before") < sample_chars)
    texts: dict[str, list[str]] = {}
    for r in taken.orderBy("lang", "h").select("lang", "text").toLocalIterator():
        texts.setdefault(r["lang"], []).append(r["text"])
    joined = {k: "".join(v)[:sample_chars] for k, v in texts.items()}
    return Model({k: v for k, v in joined.items() if v})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)``, a row for each row of ``docs``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample sizes

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in it:
            at, size, lengths = 0, 0, pdf["text"].str.len().fillna(0).to_numpy()
            for i in range(len(pdf)):
                size += lengths[i]
                if size > 2_000_000 or i == len(pdf) - 1:
                    part = pdf.iloc[at : i + 1]
                    langs, scores = m.predict(list(part["text"]))
                    yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "lang_pred": langs, "score": scores})
                    at, size = i + 1, 0

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, lang_pred string, score double")
