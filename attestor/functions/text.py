"""Text expressions: normal forms, tokens, redaction, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The quotation marks that plain ones replace.
SMART, PLAIN = "‘’“”", "''\"\""
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, of) -> Column:
    """`of` a value that is computed once; an expression that a lambda uses would be computed for each element."""
    return F.transform(F.array(value), of)[0]


def normal(text: Column) -> Column:
    """Lower case, plain quotes, one blank between words."""
    plain = F.translate(F.coalesce(text, F.lit("")), SMART, PLAIN)
    return F.lower(F.btrim(F.regexp_replace(plain, BLANKS, " ")))


def alphanumeric(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", " "), " +", " "))


def tokens(text: Column) -> Column:
    """Lower-cased runs of three or more ASCII letters, digits, underscores and hyphens."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_-]+"), lambda t: F.length(t) >= 3)


def word_hit(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands in the text with no letter or digit beside it."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("(?:^|[^a-z0-9])(?:" + "|".join(words) + ")(?:[^a-z0-9]|$)")


_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_NET = rf"\b((?:{_OCTET}\.){{2}}{_OCTET})\.{_OCTET}\b"
#: A number with a country code or a leading zero, and no digit beside it.
PHONE = r"(?:\+(?:91|44|1)[\s-]|(?:91|44)-|0)[0-9][0-9\s-]{7,10}[0-9]"
MARKER = " (IP masked)"


def masked(text: Column, addresses: str = "mask") -> Column:
    """E-mail addresses, then addresses of hosts, then phone numbers. "mask" hides the last part of a host's address and says
    so once, at the first; "redact" takes whole addresses out; "keep" leaves them."""
    # each pattern is tried only where a cheap sign of it is found
    out = F.when(text.contains("@"), F.regexp_replace(text, r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z]{2,}", "[EMAIL REDACTED]")).otherwise(text)
    if addresses != "keep":
        hide = _hidden if addresses == "mask" else lambda t: F.regexp_replace(t, _NET, "[IP REDACTED]")
        out = let(out, lambda t: F.when(t.rlike(r"[0-9]\.[0-9]"), hide(t)).otherwise(t))
    return let(out, lambda t: F.when(t.rlike(r"[0-9][0-9\s-]{7}"), F.regexp_replace(t, rf"(?<![0-9]){PHONE}(?![0-9])", "[PHONE REDACTED]")).otherwise(t))


def _hidden(text: Column) -> Column:
    """Addresses without their last part, the marker behind the first: what stands between them is joined by what is left."""
    gaps, found = F.split(text, _NET, -1), F.regexp_extract_all(text, F.lit(_NET), F.lit(1))
    parts = F.zip_with(gaps, found, lambda g, f: F.concat(g, F.coalesce(F.concat(f, F.lit(".xxx")), F.lit(""))))
    marked = F.transform(parts, lambda p, i: F.when(i == 0, F.concat(p, F.lit(MARKER))).otherwise(p))
    return F.when(F.size(found) > 0, F.array_join(marked, "")).otherwise(text)


def stripped(text: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def pairs(text: Column) -> Column:
    """map of label to value for "label: value" in a text, yes and no standing for all words of their kind; of equal labels
    the first counts. The text is cut at colons and equals signs: a value begins what follows, a label ends what is before.
    Words that text recognition glues to a label are taken off."""
    flat = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))

    def value_of(part: Column) -> Column:
        """The word that a part begins with, if it is a value."""
        word = F.regexp_extract(F.ltrim(part), "^[a-z0-9_]+", 0)
        return F.when(F.ltrim(part).rlike("^n/a(?![a-z0-9_])"), "n/a").when(word.isin(*YES, *NO), word)

    def label_of(part: Column, value: Column) -> Column:
        """The words that a part ends with, at most 41 characters, after the value it begins with."""
        rest = F.when(value.isNotNull(), F.substr(F.ltrim(part), F.length(value) + 1)).otherwise(part)
        tail = F.right(F.regexp_extract(F.rtrim(rest), "[a-z /_-]*$", 0), F.lit(41))
        words = F.trim(F.regexp_replace(F.translate(tail, "/_-", "   "), " +", " "))
        return words

    def unglued(own: Column) -> Column:
        first = F.get(F.filter(F.transform(own, lambda w, i: F.when(~w.isin(*GLUED), i)), lambda i: i.isNotNull()), F.lit(0))
        # the last word is never taken off
        return F.array_join(F.slice(own, F.least(F.coalesce(first, F.size(own) - 1), F.size(own) - 1) + 1, F.size(own)), " ")

    def entries(parts: Column) -> Column:
        return let(F.transform(parts, value_of), lambda values: of_values(parts, values))

    def of_values(parts: Column, values: Column) -> Column:
        at = F.filter(F.transform(values, lambda v, i: F.when((i > 0) & v.isNotNull(), i)), lambda i: i.isNotNull())

        def entry(i: Column) -> Column:
            value = F.get(values, i)
            before = F.when(i > 1, F.get(values, i - 1))  # a first part begins with no value
            label = let(F.split(label_of(F.get(parts, i - 1), before), " "), unglued)
            return F.struct(label.alias("label"), F.when(value.isin(*YES), "yes").when(value.isin(*NO), "no").otherwise(value).alias("value"))

        return F.transform(at, entry)

    def firsts(found: Column) -> Column:
        return let(F.transform(found, lambda e: e["label"]), lambda labels: F.filter(found, lambda e, i: F.array_position(labels, e["label"]) == i + 1))

    return F.map_from_entries(let(F.filter(let(F.split(flat, "[:=]"), entries), lambda e: F.length(e["label"]) >= 3), firsts))


# Words that don't belong to a label, and words of one meaning.
GLUED = ("a", "the", "cache", "config", "dbus", "db", "local", "java", "root", "tmp", "var", "etc", "usr", "bin")
YES, NO = ("true", "on", "enabled", "active", "present", "yes"), ("false", "off", "disabled", "inactive", "absent", "no")


def contradictions(quote: Column, source: Column) -> Column:
    """Labels that a quote and its source both have, with different values. Both are read once, and only where both have a
    colon or an equals sign, since others have no pair."""
    may = lambda c: c.contains(":") | c.contains("=")
    differing = lambda p: F.filter(F.map_keys(p["said"]), lambda k: F.map_contains_key(p["truth"], k) & (p["said"][k] != p["truth"][k]))
    both = let(F.struct(pairs(quote).alias("said"), pairs(source).alias("truth")), differing)
    return F.when(may(quote) & may(source), both).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Zero where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def sentences(text: Column, least: int = 4) -> Column:
    """Sentences of at least so many words, with the mark that ends them."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), stripped), lambda s: n_words(s) >= least)


def content_key(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 12)
