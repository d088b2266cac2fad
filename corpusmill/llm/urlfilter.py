"""URL rules fetched by their rarest literal token; DataFrame functions only.

A rule is a pattern with literal tokens.  Every rule is indexed under that of its tokens which is
rarest among the URLs at hand, so that common tokens (``https``, ``com``) fetch nothing.  The index is a
constant of the plan, maps from token to rules in buckets of a hash: the tokens of a URL fetch its
candidate rules where the row is, without any exchange, and only candidates run their regular
expression.  Rules beyond a size are dealt into several such constants, so there is no bound on them.
The longest fitting rule decides; where none fits, the default verdict.

Host rules (``net/``, ``example.net/en/``) fit a host and its subdomains if the path starts with the
rule's path.  Pattern rules are regular expressions over the lower-cased URL with stated tokens; they
decide only where no host rule fits.

Null or ``://``-less URLs have an empty host and path and fit no host rule.  Rows are kept as they are,
whatever their ids and however often a URL is repeated.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of rules in one constant of the plan.
INDEX_BYTES = 1 << 20
INDEX = "array<map<string,array<struct<is_host:boolean,n:int,name:string,verdict:string,regex:string>>>>"
TOKEN = "[^a-z0-9]+"


class Rule(NamedTuple):
    name: str
    verdict: str
    regex: str  # over host || path for host rules, over the lower-cased URL for patterns
    tokens: tuple[str, ...]
    is_host: bool


def host_rule(name: str, verdict: str) -> Rule:
    host, slash, path = name.partition("/")
    quoted = re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", host) + slash + re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", path)
    # a token of the path is sure to be a whole token of the URL only if the rule itself ends it
    inner = [t for t in re.split(TOKEN, host.lower()) if t]
    inner += [t for t in re.split(TOKEN, path[: len(path) - len(re.split("[^A-Za-z0-9]", path)[-1])].lower()) if t]
    return Rule(name, verdict, rf"^(?:[^/]*\.)?{quoted}", tuple(inner), True)


def pattern_rule(name: str, verdict: str, regex: str, *tokens: str) -> Rule:
    return Rule(name, verdict, regex, tokens, False)


HOST_RULES = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"))
#: Pages that hold no prose of their own, whatever their host.
PATTERN_RULES = (
    pattern_rule("login", "block", r"/(?:wp-)?login(?:\.php)?(?:[/?#]|$)", "login"),
    # every stated token must be a whole token of every URL that fits, so each spelling is a rule
    pattern_rule("signup", "block", r"/signup(?:[/?#]|$)", "signup"),
    pattern_rule("sign-up", "block", r"/sign-up(?:[/?#]|$)", "sign", "up"),
    pattern_rule("cart", "block", r"/(?:shopping-)?cart(?:[/?#]|$)", "cart"),
    pattern_rule("checkout", "block", r"/checkout(?:[/?#]|$)", "checkout"),
    *(pattern_rule(t, "block", rf"://[^/?#]*\b{t}\b", t) for t in ("casino", "bets", "pills", "spam", "adult", "porn", "ads", "adserver")),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.split(F.lower(url), TOKEN))


def read_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """Rules of a text file on any store that Spark reads: ``verdict host/path`` a line, or ``verdict ~regex
    token token``; lines that are empty or begin with ``#`` are left out."""
    rules = []
    for line in (r["value"] for r in spark.read.text(path).collect()):  # a list that people keep
        verdict, _, rest = line.strip().partition(" ")
        if not rest or verdict.startswith("#"):
            continue
        if rest.startswith("~"):
            regex, *tokens = rest[1:].split()
            if not tokens:
                raise ValueError(f"a pattern rule names its tokens: {line}")
            rules.append(pattern_rule(regex, verdict, regex, *tokens))
        else:
            rules.append(host_rule(rest, verdict))
    return tuple(rules)


def rarest_tokens(urls: DataFrame, rules: tuple[Rule, ...]) -> list[str]:
    """For each rule, that of its tokens which the fewest of ``urls (url)`` hold."""
    wanted = sorted({t for r in rules for t in r.tokens})
    # the counts come back for the rules' own tokens only
    seen = urls.select(F.explode(tokens_of(F.col("url"))).alias("token")).where(F.col("token").isin(wanted)).groupBy("token").count()
    count = {r["token"]: r["count"] for r in seen.collect()}
    return [min(r.tokens, key=lambda t: (count.get(t, 0), t)) for r in rules]


def _parts(rules: Iterable[tuple[str, Rule]]) -> list[list[tuple[str, Rule]]]:
    parts, size = [[]], 0
    for token, r in rules:
        own = len(token) + len(r.name) + len(r.regex) + 64
        if parts[-1] and size + own > INDEX_BYTES:
            parts.append([])
            size = 0
        parts[-1].append((token, r))
        size += own
    return parts


def _index(rules: list[tuple[str, Rule]]) -> tuple[Column, int]:
    """The index as a constant, and its number of buckets."""
    n = max(1, len(rules) // 2)
    buckets: list[dict[str, list[dict]]] = [{} for _ in range(n)]
    for token, r in rules:
        entry = {"is_host": r.is_host, "n": len(r.name), "name": r.name, "verdict": r.verdict, "regex": r.regex}
        buckets[zlib.crc32(token.encode()) % n].setdefault(token, []).append(entry)
    return F.from_json(F.lit(json.dumps(buckets)), INDEX), n


def judge(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, default: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (of the deciding host rule, else null), ``verdict`` and
    ``pattern`` (the deciding pattern rule, where no host rule fits)."""
    url = F.col(url_col)
    indexed = zip(rarest_tokens(pages.select(url.alias("url")), rules), rules, strict=True)
    target = lambda c: F.when(c["is_host"], F.concat(host_of(url), path_of(url))).otherwise(F.lower(url))
    best = []
    for part in _parts(indexed):
        index, n = _index(part)
        held = F.transform(tokens_of(url), lambda t: F.try_element_at(F.get(index, F.pmod(F.crc32(t.cast("binary")), F.lit(n)).cast("int")), t))
        candidates = F.flatten(F.filter(held, lambda x: x.isNotNull()))
        fits = F.filter(candidates, lambda c: F.rlike(target(c), c["regex"]))
        best.append(F.array_max(F.transform(fits, lambda c: F.struct(c["is_host"].alias("is_host"), c["n"].alias("n"), c["name"].alias("name"), c["verdict"].alias("verdict")))))
    joined = pages.drop("host", "path", "rule", "verdict", "pattern").withColumn("__best", F.greatest(*best) if len(best) > 1 else best[0])
    by_host = F.coalesce(F.col("__best.is_host"), F.lit(False))
    return (
        joined.withColumn("host", host_of(url))
        .withColumn("path", path_of(url))
        .withColumn("rule", F.when(by_host, F.col("__best.name")))
        .withColumn("pattern", F.when(~by_host, F.col("__best.name")))
        .withColumn("verdict", F.coalesce(F.col("__best.verdict"), F.lit(default)))
        .drop("__best")
    )


ORACLE = """
    WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
    h AS (SELECT page_id, u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
    r AS (SELECT *, CASE
            WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
    SELECT page_id, host, path, rule, CASE
        WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
        WHEN regexp_matches(lower(u), '/(wp-)?login(\\.php)?([/?#]|$)|/sign-?up([/?#]|$)|/(shopping-)?cart([/?#]|$)|/checkout([/?#]|$)|://[^/?#]*\\b(casino|bets|pills|spam|adult|porn|ads|adserver)\\b') THEN 'block'
        ELSE 'allow' END AS verdict FROM r"""
