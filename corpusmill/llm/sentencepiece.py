"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The automaton holds the normal pieces of a vocabulary file.  It reads a text once; at every position
its output links name all pieces that end there, longest first, and each relaxes the best score of the
position.  Following the best pieces back gives the segmentation of the highest total score; ties go
to the longer last piece.  A character that is no piece costs ``min score - 10`` and becomes byte
pieces (or the unknown id, if the vocabulary has none).

Scores: a unigram file's own.  A BPE file holds merge ranks; its pieces score ``-ln(rank + e)``, so that
few and common pieces win.

Spaces: the pieces' U+2581 stands for a space, and a dummy space goes before a text where the file
says so; the text itself is not escaped, so a U+2581 in it survives through byte pieces and
``decode(encode(x)) == x`` holds for every text, given byte pieces.

A text is cut where no piece can reach across: before a space that follows another character, and
around control characters that are in no longer piece.  Segments of up to 48 characters are remembered.

Null text: null ids, 0 tokens; empty text: no ids.  Vocabulary files are read by the driver and
broadcast; the path is a parameter.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.staging import ship_package

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1
REMEMBERED, LONGEST = 300_000, 48


class Vocabulary(NamedTuple):
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    types: tuple[int, ...]
    model_type: int
    dummy_prefix: bool


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: numbers as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


def read_vocabulary(data: bytes) -> Vocabulary:
    pieces, scores, types = [], [], []
    model_type, dummy = UNIGRAM, True
    for number, value in _fields(data):
        if number == 1:
            entry = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            pieces.append(entry[1].decode())
            scores.append(struct.unpack("<f", entry[2])[0])
            types.append(entry[3])
        elif number == 2:
            model_type = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            dummy = bool(dict(_fields(value)).get(3, 1))
    return Vocabulary(tuple(pieces), tuple(scores), tuple(types), model_type, dummy)


class Coder:
    """Encoder and decoder of one vocabulary; one is kept in each Python worker."""

    def __init__(self, v: Vocabulary):
        self.dummy = v.dummy_prefix
        self.automaton = ahocorasick.Automaton()
        self.bytes_of: list[bytes] = []
        self.byte_ids = [-1] * 256
        self.unknown = next((i for i, t in enumerate(v.types) if t == UNKNOWN), 0)
        worst, longer, inner = 0.0, set(), False
        for i, (piece, score, kind) in enumerate(zip(v.pieces, v.scores, v.types, strict=True)):
            text = piece.replace("▁", " ")
            if kind == BYTE:
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
                continue
            self.bytes_of.append(b"" if kind in (UNKNOWN, CONTROL) else text.encode())
            if kind not in (NORMAL, USER) or not text:
                continue
            if v.model_type != UNIGRAM:
                score = -math.log(max(0.0, -score) + math.e)
            worst = min(worst, score)
            self.automaton.add_word(text, (len(text), score, i))
            longer |= set(text) if len(text) > 1 else set()
            inner |= re.search("[^ ] ", text) is not None
        self.automaton.make_automaton()
        self.miss = worst - 10.0
        cut = "".join(c for c in "\n\t\r" if c not in longer)
        other = f"[^ {cut}]" if cut else "[^ ]"
        self.segments = re.compile((f"[{cut}]|" if cut else "") + f" *{other}+| +") if not inner else re.compile("(?s).+")
        self.memory = _Memory(self)

    def viterbi(self, text: str) -> bytes:
        """Ids of the best segmentation, packed as 32-bit integers."""
        n = len(text)
        best = [0.0] + [-math.inf] * n
        came = [None] * (n + 1)
        at, miss = 0, self.miss
        for end, (size, score, piece) in self.automaton.iter(text):
            end += 1
            while at < end - 1:  # characters at which no piece ends
                at += 1
                if best[at - 1] + miss > best[at]:
                    best[at], came[at] = best[at - 1] + miss, (1, -1)
            if at < end:
                at = end
                single = False
            s = best[end - size] + score
            if s > best[end] + 1e-9:  # sums of one set of pieces differ by rounding
                best[end], came[end] = s, (size, piece)
            single = single or size == 1
            # output links go from long to short, so the single character comes last if it is a piece
            if not single and came[end] is None:
                best[end], came[end] = best[end - 1] + miss, (1, -1)
        while at < n:
            at += 1
            if best[at - 1] + miss > best[at]:
                best[at], came[at] = best[at - 1] + miss, (1, -1)
        out, at = [], n
        while at:
            size, piece = came[at]
            if piece >= 0:
                out.append(piece)
            else:
                raw = text[at - 1].encode("utf-8", "surrogatepass")
                out.extend([self.byte_ids[b] for b in reversed(raw)] if self.byte_ids[0] >= 0 else [self.unknown])
            at -= size
        return np.array(out[::-1], "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        whole = " " + text if self.dummy else text
        return np.frombuffer(b"".join(map(self.memory.__getitem__, self.segments.findall(whole))), "<i4")

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


class _Memory(dict):
    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, segment: str) -> bytes:
        ids = self.coder.viterbi(segment)
        if len(segment) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[segment] = ids
        return ids


_coders: dict[int, Coder] = {}


def _coder(v: Vocabulary) -> Coder:
    key = hash(v)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(v)
    return _coders[key]


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    with open(path, "rb") as f:  # on the driver; executors get it by broadcast
        return read_vocabulary(f.read())


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, round_trip)``: the ids, and whether they decode to the text itself."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(1).to_pylist()
                ids = [None if t is None else coder.encode(t) for t in texts]
                same = [None if i is None else coder.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
                n = np.array([0 if i is None else len(i) for i in ids], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.int32())
                flat = np.concatenate([np.zeros(0, np.int32), *[i for i in ids if i is not None]])
                mask = pa.array([i is None for i in ids], pa.bool_())
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()), mask=mask)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), lists, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)``; null ids give a null text."""
    ship_package(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            texts = [None if i is None else coder.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
