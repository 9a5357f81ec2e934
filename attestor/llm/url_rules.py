"""URL filter: pattern rules indexed by their rarest literal token (DataFrame functions only).

Each rule is a regular expression over host and path that can only match where certain literal tokens (runs of ASCII
letters and digits) occur. Of these the index holds the one that is rarest among the URLs at hand. The tokens of a URL
fetch its candidate rules by an equi-join, and only those expressions run.

List rules name a host (with all its subdomains) and the beginning of a path; the longest that fits decides, of equal
lengths the last by code point. Pattern rules block by wildcards, separators and anchors; they decide where no list rule
fits, and what nothing matches is allowed.

A null URL, or one without `://`, has an empty host and path; such a URL is blocked. Very long URLs are read whole, and a
token that is repeated in one fetches its rules once. Repeated rows and null ids are each returned; an empty table gives
no rows; columns beside id and URL are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this number are broadcast; more are joined by token.
BROADCAST = 20_000
#: Words in hosts that the method blocks: fixed values of this filter.
BLOCKED_WORDS = ("ads", "adult", "bets", "betting", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx")


@dataclass(frozen=True)
class Rule:
    """`pattern` runs over host + path; every URL it matches has all `literals` among its tokens."""

    pattern: str
    verdict: str
    literals: tuple[str, ...]
    name: str | None = None


def list_rule(verdict: str, prefix: str) -> Rule:
    """A rule for a host, its subdomains and a beginning of paths, such as example.org/es/. The last token of the path may
    go on in a URL, so it's a literal only if something ends it."""
    host, slash, path = prefix.partition("/")
    whole = re.sub(r"[A-Za-z0-9]+$", "", host + slash + path)
    return Rule(rf"^(?:[^/]*\.)?{re.escape(prefix)}", verdict, tuple(re.findall("[A-Za-z0-9]+", whole)), prefix)


def word_rule(word: str) -> Rule:
    """Blocks hosts that have this word between dots or hyphens."""
    return Rule(rf"^(?:[^/]*[^a-z0-9/])?{word}(?![a-z0-9])", "block", (word,))


_PIECE = re.compile(r"[A-Za-z0-9]+|.", re.DOTALL)


def pattern_rule(pattern: str, verdict: str = "block") -> Rule:
    """A rule in the style of filter lists: || begins at the host or one of its domains, | at either end is the URL's own,
    * stands for any characters, ^ for a separator or the end. A run of letters and digits is a literal token unless it
    may go on: beside a * or at an end that isn't anchored."""
    body, head, tail = pattern, "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], "$"
    pieces = _PIECE.findall(body)
    bounded = [bool(head), *[p != "*" and not p.isalnum() for p in pieces], bool(tail)]
    literals = tuple(p for i, p in enumerate(pieces) if p.isascii() and p.isalnum() and bounded[i] and bounded[i + 2])
    spelled = {"*": "(?s:.*)", "^": "(?:[^A-Za-z0-9_.%-]|$)"}
    return Rule(head + "".join(spelled.get(p) or re.escape(p) for p in pieces) + tail, verdict, literals)


LIST = (
    list_rule("allow", "org/"), list_rule("block", "example.org/es/"), list_rule("block", "example.org/en/1"),
    list_rule("allow", "com/fr/"), list_rule("block", "com/de/"),
)
#: Patterns of paths and hosts that the method blocks: fixed values of this filter.
BLOCKED_PATTERNS = (
    "/ads/", "/adserver^", "/banner^*^click^", "/cgi-bin/*.exe|", "/wp-login.php|", "/xmlrpc.php|", "/track/*/pixel.", "/popunder^", "/phishing/",
    "||adserver.", "||doubleclick.", "||free-download^", "-casino-online^", "/porn/", "^affiliate^*^redirect^",
)
RULES = (*LIST, *map(word_rule, BLOCKED_WORDS), *map(pattern_rule, BLOCKED_PATTERNS))


def host(url: Column) -> Column:
    """What stands after the first :// up to a slash, question mark, number sign or the end; A-Z in lower case."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _tokens(place: Column) -> Column:
    return F.array_distinct(F.filter(F.split(place, "[^A-Za-z0-9]+"), lambda t: t != ""))


def index(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(token, pattern, verdict, name): each rule under the literal that the fewest of `urls` (column _place) have, of equals
    the least."""
    spark = urls.sparkSession
    rows = [(i, r.pattern, r.verdict, r.name, list(r.literals)) for i, r in enumerate(rules)]
    frame = spark.createDataFrame(rows, "id int, pattern string, verdict string, name string, literals array<string>")
    tokens = frame.select(F.explode("literals").alias("token")).distinct()
    seen = urls.select(F.explode(_tokens(F.col("_place"))).alias("token"))
    small = F.broadcast if len(rules) <= BROADCAST else (lambda x: x)
    counts = seen.join(small(tokens), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rare = frame.select("id", F.explode("literals").alias("token")).join(small(counts), "token", "left")
    rare = rare.groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return rare.join(frame.drop("literals"), "id").drop("id")


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, candidates): candidates is the number of expressions that ran for the URL."""
    if any(not r.literals for r in rules):
        raise ValueError("a rule without a literal token can't be indexed")
    url = F.col(url_col).cast("string")
    urls = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), host(url).alias("host"), path(url).alias("path"))
    urls = urls.withColumn("_place", F.concat("host", "path"))
    by_token = index(urls, rules)
    small = F.broadcast if len(rules) <= BROADCAST else (lambda x: x)
    each = urls.select("*", F.explode_outer(_tokens(F.col("_place"))).alias("token"))
    fetched = each.join(small(by_token), "token", "left")
    fits = F.coalesce(F.expr("_place RLIKE pattern"), F.lit(False))
    longest = F.max(F.when(fits & F.col("name").isNotNull(), F.struct(F.length("name").alias("n"), "name", "verdict")))
    grouped = fetched.groupBy("_row").agg(
        F.first(F.struct(id_col, "host", "path")).alias("_url"), longest.alias("_best"),
        F.coalesce(F.bool_or(fits & F.col("name").isNull()), F.lit(False)).alias("_bad"), F.count("pattern").alias("candidates"),
    )
    own = F.when(F.col("_bad") | (F.col("_url.host") == ""), "block").otherwise("allow")
    return grouped.select(
        F.col("_url")[id_col].alias(id_col), F.col("_url.host").alias("host"), F.col("_url.path").alias("path"),
        F.col("_best.name").alias("rule"), F.coalesce("_best.verdict", own).alias("verdict"), "candidates",
    )


def report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of `pages`."""
    return judged(pages, RULES, id_col, url_col).drop("candidates")


ORACLE = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(name, h, p, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
j AS (
  SELECT u.*, (SELECT max(struct_pack(n := length(name), name := name, verdict := verdict)) FROM r
               WHERE (u.host = h OR u.host LIKE '%.' || h) AND starts_with(u.path, p)) AS best FROM u)
SELECT page_id, host, path, best.name AS rule,
  coalesce(best.verdict, CASE WHEN host = '' OR regexp_matches(host, '(^|[^a-z0-9])({"|".join(BLOCKED_WORDS)})([^a-z0-9]|$)')
    OR regexp_matches(host || path, '{"|".join(pattern_rule(p).pattern for p in BLOCKED_PATTERNS)}') THEN 'block' ELSE 'allow' END) AS verdict
FROM j
"""
