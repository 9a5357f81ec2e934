"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score (DataFrame functions only).

Base kinds are email, ip, card (Luhn) and phone. The method adds iban (mod-97) and, where words nearby speak for them,
national phone numbers (`local`) and social security numbers (`ssn`).

The patterns are anchored so that each run of characters is tried once, also in very long texts; `\\G` keeps matches
that begin where the one before ended. Null texts count as empty; rows without spans are returned with empty results;
repeated rows and repeated or null ids are kept apart; spans of different kinds that begin at one place are all reported, in
the order of the kinds, and in redaction the first of them wins; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .spans import Kind

#: Confidence of a span by kind, the gain by a context word, and the least score of an added span.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "local": 0.4, "ssn": 0.4}
CONTEXT_GAIN, LEAST = 0.3, 0.7
WORDS = {
    "email": "mail|contact|write", "ip": "ip|addr|host|server", "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|bank|account", "local": "phone|tel|call|mobile|fax",
    "ssn": "ssn|social|security",
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        double = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((F.length(digits) - i) % 2 == 1, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number (letters and digits) leaves 1 modulo 97 after its first four characters go last."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def step(rest: Column, c: Column) -> Column:
        at = F.instr(letters, c)
        return F.when(at > 0, rest * 100 + at + 9).otherwise(rest * 10 + F.when(at > 0, F.lit("0")).otherwise(c).cast("int")) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


#: Length of an account number by its country code (ISO 13616).
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
LEAST_ACCOUNT, MOST_ACCOUNT = 15, 34


def _let(value: Column, of) -> Column:
    """`of` the value, which is computed once."""
    return F.transform(F.array(value), of)[0]


def _account(hit: Column) -> Column:
    bare = F.replace(hit, F.lit(" "), F.lit(""))
    return hit.rlike("^[A-Z]{2}[0-9]{2}") & F.length(bare).between(LEAST_ACCOUNT, MOST_ACCOUNT) & mod97(bare)


def _accounts(run: Column) -> Column:
    """A run of words cut at its account numbers: from left to right, each begins with a word and ends with one. Of
    several ends that pass the checksum the length of its country decides, or else the longest."""
    none = F.array().cast("array<struct<gap:string,hit:string>>")
    length = F.create_map(*[F.lit(x) for n, codes in LENGTHS.items() for c in codes.split() for x in (c, n)])

    def best(window: Column) -> Column:
        """(is of its country's length, words, text) of the best number at the beginning of the words."""
        ends = F.transform(F.sequence(F.lit(1), F.size(window)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(window, 1, n), " ").alias("hit")))
        right = lambda e: F.coalesce(F.length(F.replace(e["hit"], F.lit(" "), F.lit(""))) == length[F.left(e["hit"], F.lit(2))], F.lit(False))
        good = F.filter(ends, lambda e: _account(e["hit"]))
        return F.array_max(F.transform(good, lambda e: F.struct(right(e).alias("right"), e["n"].alias("n"), e["hit"].alias("hit"))))

    def text(words: Column, at: Column, n: Column) -> Column:
        """n words from `at`, with the blank before them."""
        return F.concat(F.when((at > 1) & (n > 0), F.lit(" ")).otherwise(F.lit("")), F.array_join(F.slice(words, at, n), " "))

    def of(words: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.get(words, i - 1).rlike("^[A-Z]{2}[0-9]{2}"))

        def step(s: Column, i: Column) -> Column:
            def taken(b: Column) -> Column:
                gap = F.concat(text(words, s["at"], i - s["at"]), F.when(i > 1, F.lit(" ")).otherwise(F.lit("")))
                more = F.array(F.struct(gap.alias("gap"), b["hit"].alias("hit")))
                now = F.struct((i + b["n"]).cast("int").alias("at"), F.concat(s["parts"], more).cast("array<struct<gap:string,hit:string>>").alias("parts"))
                return F.when(b.isNull(), s).otherwise(now)

            # a word has one character at least, and an account at most MOST_ACCOUNT
            return F.when(i < s["at"], s).otherwise(_let(best(F.slice(words, i, MOST_ACCOUNT)), taken))

        def end(s: Column) -> Column:
            left = F.struct(F.lit("").alias("gap"), text(words, s["at"], F.size(words) - s["at"] + 1).alias("hit"))
            return F.when(s["at"] > F.size(words), s["parts"]).otherwise(F.concat(s["parts"], F.array(left)))

        return F.aggregate(heads, F.struct(F.lit(1).alias("at"), none.alias("parts")), step, end)

    return _let(F.split(run, " "), of)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _card(hit: Column, *_: Column) -> Column:
    d = _digits(hit)
    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)


def _near(kind: str, before: Column, after: Column) -> Column:
    return F.concat(before, F.lit(" "), after).rlike(rf"(?i)(?<![a-z])(?:{WORDS[kind]})")


def score(kind: str, before: Column, after: Column) -> Column:
    return F.lit(SCORES[kind]) + F.when(_near(kind, before, after), CONTEXT_GAIN).otherwise(0.0)


def _scored(kind: str):
    return lambda h, b, a: score(kind, b, a) >= LEAST


KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0, lambda t: t.contains("@"), lambda h, b, a: h.isNotNull(), tag="[EMAIL]"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 1, lambda t: t.rlike(r"[0-9]\.[0-9]"),
         lambda h, b, a: F.forall(F.split(h, r"\."), lambda p: p.cast("double") <= 255), tag="[IP]"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 2, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _card, tag="[CARD]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 3, lambda t: t.contains("+"), lambda h, b, a: F.length(_digits(h)).between(9, 15), tag="[PHONE]"),
    # whole words from the first that may begin an account number, with one blank between them
    Kind("iban", r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11})[A-Z0-9]++(?![a-z])(?:\x20[A-Z0-9]++(?![a-z]))*+", 4, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]"),
         lambda h, b, a: _account(h), base=False, tag="[IBAN]", cut=_accounts),
    Kind("local", r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", 5, lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), _scored("local"), base=False, tag="[PHONE]"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 6, lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"), _scored("ssn"), base=False, tag="[SSN]"),
]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans with their scores: `_row`, id, kind, ord, start, end, hit, base, score. A row without spans has one
    record whose kind is null."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    parts = spans.found(rows, KINDS, "_row", "_text", [id_col])
    scored = F.lit(None).cast("double")
    for k in KINDS:
        scored = F.when(F.col("kind") == k.name, score(k.name, F.col("before"), F.col("after"))).otherwise(scored)
    return parts.select("_row", id_col, "kind", "ord", "start", "end", "hit", "base", F.round(scored, 2).alias("score"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: base counts, the digest of base spans, all spans and the highest score."""
    return spans.digest(scan(docs, id_col, text_col), "_row", id_col, KINDS, [F.max("score").alias("max_score")])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with each span replaced by the tag of its kind; null texts stay null."""
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    out = spans.redacted(docs.select(others.alias("_doc"), F.col(text_col).cast("string").alias("_new")), KINDS, "_new")
    return out.select(*[F.col("_new").alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
