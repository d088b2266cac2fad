"""Personal data: patterns propose, checksums confirm, nearby words adjust; DataFrame functions only.

Kinds, in this order: ``email``, ``ip``, ``card`` (Luhn), ``phone`` and, beyond these base kinds,
``iban`` (mod 97) and ``ssn`` (only with a word near it that names it).  Each kind is found leftmost
and without overlaps in the whole text; a match that its validator drops is not tried again.  Spans are
code points, end exclusive.

Positions come from splitting the text by the kind's pattern: the lengths of the pieces and of the
matches between them add up.  The context of a match is the 40 characters of the text on either side,
other matches included; it is put together from the ends of the pieces and matches around.  The patterns
are written so that a failed start is left at once (possessive runs, and starts only where a run of the
first class begins or where the last match ended), and positions are summed in runs of about the square
root of their number, so long texts and texts of many matches are no trouble.

A null or empty text has no spans.  Rows are kept as they are, repeated ids and nulls included.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40
#: So many matches, the shortest of 4 characters, fill a context.
AROUND = NEAR // 4
#: Characters of the blocks from which redaction cuts its pieces.
CUT = 1000


class Kind(NamedTuple):
    name: str
    pattern: str
    gate: str  # a character without which no match is possible; empty: none
    score: float
    bonus: float
    words: str  # of the context, as a pattern


BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, 0.1, r"e-?mail|contact|write to|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, 0.3, r"\bip\b|address|host|server|adresse"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){13})[0-9]++(?:[\x20-][0-9]++)*+", "", 0.7, 0.3, r"card|visa|master|credit|kredit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, 0.3, r"phone|call|tel\b|mobile|fax|telefon|t[eé]l[eé]"),
)
MORE = (
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", "", 0.8, 0.2, r"iban|account|konto|cuenta|compte"),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "-", 0.3, 0.5, r"ssn|social security"),
)
KINDS = BASE + MORE
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def mod97(m: Column) -> Column:
    """Remainder of an account number by ISO 7064: first four characters to the end, letters as 10 to 35."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    values = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.when(code(i) >= 65, code(i) - 55).otherwise(code(i) - 48))
    return F.aggregate(values, F.lit(0), lambda acc, v: F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)).cast("int"))


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits(m)).between(14, 19) & F.call_function("luhn_check", digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(m) == 1)
    return F.lit(True)


def _running(values: Column, base: Column, op: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """For each value of a short array, ``base`` and the values before it under ``op``."""
    none = F.array().cast("array<long>")
    step = lambda acc, x: F.struct(op(acc["at"], x.cast("long")).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    return F.aggregate(values, F.struct(base.cast("long").alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _runs(values: Column) -> Column:
    """A non-empty array cut into runs of about the square root of its length."""
    length = F.ceil(F.sqrt(F.size(values))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / length).cast("int") - 1), lambda i: F.slice(values, i * length + 1, length))


def _found(rank: int, kind: Kind, z: Column, runs: Column, before: Column) -> Column:
    """Valid matches as structs ``(start, rank, end, score)``."""
    starts = F.flatten(F.transform(F.arrays_zip(runs.alias("r"), before.alias("b")), lambda x: _running(x["r"], x["b"])))

    def one(x: Column, i: Column) -> Column:
        left = F.concat(F.array_join(F.transform(F.slice(z, F.greatest(i - AROUND + 1, F.lit(1)), F.least(i, F.lit(AROUND))), lambda y: y["upto"]), ""), x["b"])
        right = F.concat(x["a"], F.array_join(F.transform(F.slice(z, i + 2, F.lit(AROUND)), lambda y: y["from"]), ""))
        near = F.lower(F.concat(F.right(left, F.lit(NEAR)), F.lit(" "), F.left(right, F.lit(NEAR))))
        return F.struct(x["m"].alias("m"), x["lb"].alias("lb"), x["lm"].alias("lm"), near.alias("near"))

    placed = F.transform(F.arrays_zip(F.transform(z, one).alias("x"), starts.alias("s")), lambda y: F.struct(y["x"]["m"].alias("m"), y["x"]["near"].alias("near"), (y["s"] + y["x"]["lb"]).cast("int").alias("start"), (y["s"] + y["x"]["lb"] + y["x"]["lm"]).cast("int").alias("end")))
    sure = F.filter(placed, lambda x: valid(kind.name, x["m"]))
    score = lambda x: F.lit(kind.score) + F.when(x["near"].rlike(kind.words), kind.bonus).otherwise(0.0)
    scored = F.transform(sure, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), score(x).alias("score")))
    return scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= 0.5)


def _with_pieces(m: Column, pieces: Column) -> Column:
    """Each match with its length, the piece before's, and the ends of what surrounds it."""
    ends = lambda f, x: f(x, F.lit(NEAR))

    def one(x: Column, i: Column) -> Column:
        b, a = F.get(pieces, i), F.get(pieces, i + 1)
        before, after = ends(F.right, b), ends(F.left, a)
        return F.struct(
            x.alias("m"), F.char_length(b).alias("lb"), F.char_length(x).alias("lm"), before.alias("b"), after.alias("a"),
            ends(F.right, F.concat(before, ends(F.right, x))).alias("upto"), ends(F.left, F.concat(ends(F.left, x), after)).alias("from"),
        )

    return F.transform(m, one)


def find(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``findings``: ``array<struct<kind, start, end, score>>`` by start, then kind.

    Columns whose names begin with ``__`` are used in between.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    m = {k.name: F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)) for k in KINDS}
    # without matches nothing is split
    gated = {f"__m_{k.name}": F.when(F.contains(text, F.lit(k.gate)), m[k.name]) if k.gate else m[k.name] for k in KINDS}
    each = lambda p, f: {f"__{p}_{k.name}": f(k) for k in KINDS}
    col = lambda p, k: F.col(f"__{p}_{k.name}")
    step = df.withColumns(gated)
    step = step.withColumns(each("s", lambda k: F.when(F.size(col("m", k)) > 0, F.split(text, k.pattern, -1))))
    step = step.withColumns(each("z", lambda k: F.when(col("s", k).isNotNull(), _with_pieces(col("m", k), col("s", k)))))
    step = step.withColumns(each("l", lambda k: F.transform(col("z", k), lambda x: x["lb"] + x["lm"])))
    step = step.withColumns(each("r", lambda k: F.when(col("l", k).isNotNull(), _runs(col("l", k)))))
    sums = lambda k: F.transform(col("r", k), lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x))
    step = step.withColumns(each("t", lambda k: F.when(col("r", k).isNotNull(), _running(sums(k), F.lit(0)))))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,score:double>>")
    found = [F.coalesce(F.when(col("z", k).isNotNull(), _found(i, k, col("z", k), col("r", k), col("t", k))), none) for i, k in enumerate(KINDS)]
    step = step.withColumn("__all", F.array_sort(F.concat(*found)))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    named = F.transform("__all", lambda x: F.struct(F.element_at(names, x["rank"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))
    return step.withColumn("findings", named).drop("__all", *[f"__{p}_{k.name}" for p in "mszlrt" for k in KINDS])


def redact(found: DataFrame, mark: str = "<{}>", text_col: str = "text", name: str = "redacted") -> DataFrame:
    """The result of :func:`find` with the text in which every span is replaced by its kind's mark; overlapping spans
    are one, under the first kind.  Pieces are cut from blocks of the text, so many spans in a long text are no trouble."""
    begin, end = mark.split("{}")
    text, all_ = F.coalesce(F.col(text_col), F.lit("")), F.col("__ends")
    step = found.withColumn("__ends", F.when(F.size("findings") > 0, F.transform("findings", lambda x: x["end"].cast("long"))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text) / CUT).cast("int")), lambda i: F.substring(text, i * CUT + 1, F.lit(CUT)))
    step = step.withColumns({"__runs": F.when(all_.isNotNull(), _runs(all_)), "__blocks": F.when(all_.isNotNull(), blocks)})
    step = step.withColumn("__tops", F.when(all_.isNotNull(), _running(F.transform("__runs", F.array_max), F.lit(0), F.greatest)))
    reached = F.flatten(F.transform(F.arrays_zip(F.col("__runs").alias("r"), F.col("__tops").alias("b")), lambda x: _running(x["r"], x["b"], F.greatest)))
    step = step.withColumn("__reached", F.when(all_.isNotNull(), reached))

    def piece(at: Column, to: Column) -> Column:
        first, last = F.floor(at / CUT).cast("int"), F.floor(to / CUT).cast("int")
        held = F.array_join(F.slice(F.col("__blocks"), first + 1, last - first + 1), "")
        return F.substring(held, (at - first * CUT + 1).cast("int"), (to - at).cast("int"))

    def one(x: Column, i: Column) -> Column:
        at = F.get(F.col("__reached"), i)
        return F.when(x["start"] >= at, F.concat(piece(at, x["start"].cast("long")), F.lit(begin), x["kind"], F.lit(end))).otherwise(F.lit(""))

    rest = piece(F.array_max(all_), F.char_length(text).cast("long"))
    marked = F.when(all_.isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(F.transform("findings", one), ""), rest))
    return step.withColumn(name, marked).drop("__ends", "__runs", "__blocks", "__tops", "__reached")


def digest(found: DataFrame) -> DataFrame:
    """``(doc_id, n_*, base_sha256, spans)`` of the result of :func:`find`."""
    base = [k.name for k in BASE]
    text_of = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    n = [of(k) for k in base]
    return found.select("doc_id", *n, F.sha2(text_of(F.filter("findings", lambda x: x["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), text_of(F.col("findings")).alias("spans"))


def _oracle() -> str:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": MORE[0].pattern,
        "ssn": MORE[1].pattern,
    }
    digit = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(length({digit})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({digit}), CAST(i + 1 AS INTEGER), 1) AS INTEGER)
        ELSE CAST(substr('0246813579', CAST(substr(reverse({digit}), CAST(i + 1 AS INTEGER), 1) AS INTEGER) + 1, 1) AS INTEGER) END)) % 10 = 0"""
    bare = "replace(m, ' ', '')"
    turned = f"(substr({bare}, 5) || substr({bare}, 1, 4))"
    mod = f"""list_reduce(list_prepend(0, list_transform(range(length({turned})), lambda i: CASE WHEN substr({turned}, CAST(i + 1 AS INTEGER), 1) ~ '[0-9]'
        THEN CAST(ascii(substr({turned}, CAST(i + 1 AS INTEGER), 1)) - 48 AS INTEGER) ELSE CAST(ascii(substr({turned}, CAST(i + 1 AS INTEGER), 1)) - 55 AS INTEGER) END)),
        lambda acc, v: (acc * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"""
    checks = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda x: CAST(substr('0000' || ltrim(x, '0'), -4) AS INTEGER) + 1000 * CAST(length(ltrim(x, '0')) > 3 AS INTEGER))) <= 255",
        "card": f"length({digit}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"length({digit}) BETWEEN 10 AND 15",
        "iban": f"length({bare}) BETWEEN 15 AND 34 AND {mod}",
        "ssn": f"lower(substr(t, greatest(1, s - {NEAR - 1}), least({NEAR}, s)) || ' ' || substr(t, s + length(m) + 1, {NEAR})) ~ '.*(?:{MORE[1].words}).*'",
    }
    found = " UNION ALL ".join(
        f"""SELECT r, '{k}' AS kind, {i} AS rank, s AS start, s + length(m) AS stop FROM (
            SELECT r, t, m, CAST(off AS BIGINT) AS s FROM (
              SELECT r, t, unnest(ms) AS m,
                     unnest(list_transform(range(len(ms)), lambda i: list_sum(list_transform(ps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0))) AS off
              FROM (SELECT r, t, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM d) WHERE len(ms) > 0)) WHERE {checks[k]}"""
        for i, (k, p) in enumerate(patterns.items())
    )
    base = "'email', 'ip', 'card', 'phone'"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in BASE)
    joined = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({found})
        SELECT any_value(d.doc_id) AS doc_id, {counts}, sha256(coalesce({joined} FILTER (WHERE kind IN ({base})), '')) AS base_sha256, coalesce({joined}, '') AS spans
        FROM d LEFT JOIN f USING (r) GROUP BY d.r"""


ORACLE = _oracle()
