"""Secret scan with multipart credential linking (DataFrame functions only).

Strong kinds (assignments, access identifiers, long hexadecimal strings) are always reported. Weak parts are reported
only when a complementary part starts within `SCOPE` code points of them in the same document:

* `account` (a login or client identifier): beside a secret;
* `opaque` (a 40-character token or a value called pwd, bearer, ...): beside an access identifier or an endpoint;
* `endpoint` (a URL with a service scheme): beside both an access identifier and a secret.

The interval join is a range frame over the parts of one document, so no pairs are made; the frame spans at most
2 * SCOPE code points and therefore holds a bounded number of parts.

`credentials` links them: each secret with the nearest identifier and the nearest endpoint whose starts lie within the
scope, found by range frames before and after it. Parts whose starts follow one another within the scope form a group.

Null texts count as empty; rows without any span are returned with empty results; very long texts are scanned whole, in
linear time; spans of equal start come in the order of the kinds, and of two parts equally near the one before counts;
repeated rows and repeated or null ids are kept apart; an empty table gives no rows; columns beside the id and the text
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import spans
from .spans import Kind

#: Code points between the starts of two parts that belong together.
SCOPE = 240

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)" + _VALUE + r"([A-Za-z0-9+/_.=-]+)"


def _has(*needles: str):
    def guard(t: Column) -> Column:
        out = t.contains(needles[0])
        for n in needles[1:]:
            out = out | t.contains(n)
        return out

    return guard


def _always(hit: Column, before: Column, after: Column) -> Column:
    return hit.isNotNull()


KINDS = [
    Kind("assign", ASSIGN, 0, _has(":", "="), lambda h, b, a: F.length(F.regexp_extract(h, ASSIGN, 1)) >= 8),
    Kind("access", r"AKIA[A-Z0-9]+", 1, _has("AKIA"), lambda h, b, a: F.length(h) >= 16),
    Kind("hex", r"(?:(?<![0-9a-f])|\G)[0-9a-f]{32,}", 2, lambda t: t.rlike("[0-9a-f]{32}"), _always),
    Kind("account", r"(?i:access_?key_?id|client_?id|user_?name|user|login|account)" + _VALUE + r"[A-Za-z0-9@._-]{3,}", 3, _has(":", "="), _always, base=False),
    Kind("opaque", r"(?i:pwd|pass|client_?secret|secret_?key|bearer)" + _VALUE + r"[A-Za-z0-9+/_.=-]{6,}|(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 4,
         lambda t: t.rlike(r"[:=]|[A-Za-z0-9+/]{40}"), lambda h, b, a: ~h.rlike(r"^[0-9a-f]+$|^[A-Za-z]+$"), base=False),
    Kind("endpoint", r"(?i:https?|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|amqp|redis|s?ftp)://[A-Za-z0-9@:._/-]+", 5, _has("://"), _always, base=False),
]

_IDENTIFIERS, _SECRETS = ("access", "account"), ("assign", "hex", "opaque")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """All reported spans: `_row` (one value for each input row), id, kind, ord, start, end, hit, base, n_linked.
    A row without spans has one record whose kind is null."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    parts = spans.found(rows, KINDS, "_row", "_text", [id_col])
    near = W.partitionBy("_row").orderBy("start").rangeBetween(-scope, scope)
    kind = F.col("kind")
    n = lambda names: F.coalesce(F.sum(kind.isin(*names).cast("int")).over(near), F.lit(0))
    parts = parts.withColumns({"_ids": n(_IDENTIFIERS), "_secrets": n(_SECRETS), "_ends": n(("endpoint",))})
    linked = (
        F.when(kind == "account", F.col("_secrets"))
        .when(kind == "opaque", F.col("_ids") + F.col("_ends"))
        .when(kind == "endpoint", F.least("_ids", "_secrets"))
        .when(kind.isin(*_IDENTIFIERS), F.col("_secrets") + F.col("_ends"))
        .otherwise(F.col("_ids") + F.col("_ends"))
    )
    shown = F.col("base") | (linked > 0)
    return parts.select(
        "_row", id_col, F.when(shown, kind).alias("kind"), "ord", "start", "end", "hit", F.col("base"),
        F.when(shown, linked).alias("n_linked"),
    )


def _nearest(names: tuple[str, ...], scope: int) -> Column:
    """(kind, start, end) of the nearest reported part of these kinds within the scope."""
    part = F.when(F.col("kind").isin(*names), F.struct("kind", "start", "end"))
    by = W.partitionBy("_row").orderBy("start")
    before = F.last(part, True).over(by.rangeBetween(-scope, 0))
    after = F.first(part, True).over(by.rangeBetween(1, scope))
    nearer = F.coalesce(F.col("start") - before["start"], F.lit(scope + 1)) <= F.coalesce(after["start"] - F.col("start"), F.lit(scope + 1))
    return F.when(nearer, before).otherwise(after)


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """`parts` with group (of the parts whose starts follow one another within the scope, numbered in each row of the
    input), identifier and endpoint: the nearest of each kind as kind, start, end, or null."""
    by = W.partitionBy("_row").orderBy("start", "ord")
    start = F.when(F.col("kind").isNotNull(), F.col("start"))
    last = F.last(start, True).over(by.rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("_begins", F.coalesce(start - last > scope, last.isNull()).cast("int") * start.isNotNull().cast("int"))
    group = F.sum("_begins").over(by.rowsBetween(W.unboundedPreceding, 0)).cast("int")
    return parts.withColumns({"group": group, "identifier": _nearest(_IDENTIFIERS, scope), "endpoint": _nearest(("endpoint",), scope)}).drop("_begins")


def _is_linked() -> Column:
    return F.col("kind").isin(*_SECRETS) & (F.col("identifier").isNotNull() | F.col("endpoint").isNotNull())


def credentials(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each secret with an identifier or an endpoint near it: the columns of `scan` and `linked`."""
    return linked(scan(docs, id_col, text_col, scope), scope).filter(_is_linked())


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row of `docs`: base counts, the digest of base spans, all spans, the number of linked spans, and the linked
    credentials as group|identifier|secret|endpoint, each part as kind:start:end or empty, joined by semicolons."""
    span = lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))
    text = F.concat_ws("|", F.col("group").cast("string"), span(F.col("identifier")), span(F.struct("kind", "start", "end")), span(F.col("endpoint")))
    found = F.array_sort(F.collect_list(F.when(_is_linked(), F.struct("start", "ord", text.alias("text")))))
    n_linked = F.count_if(F.col("n_linked") > 0).alias("linked_spans")
    joined = F.array_join(F.transform(found, lambda x: x["text"]), ";").alias("credentials")
    return spans.digest(linked(scan(docs, id_col, text_col, scope), scope), "_row", id_col, KINDS, [n_linked, joined])
