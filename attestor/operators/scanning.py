"""Scans of configuration texts for cryptography: ordered rules whose places exclude each other, then dictionaries of codes.

A text is read by lines, as no name spans two, so a long text is no larger a task than its lines. Null texts have no line;
lines that are comments are left out; equal lines of a text give one finding with the number of times. Repeated files are
one file; an empty table gives no rows. Other columns than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto as C
from ..session import written

#: Up to so many codes are broadcast.
BROADCAST = 200_000
FINDING = ("rule", "name", "status", "category", "severity")


def lines(docs: DataFrame, file: str = "file", text: str = "content") -> DataFrame:
    """(file, at, line): the lines that are no comments, numbered from 1."""
    rows = docs.select(F.col(file).alias("file"), F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("at", "line"))
    return rows.filter((F.trim("line") != "") & ~C.is_comment(F.col("line"))).withColumn("at", F.col("at") + 1)


def by_rules(rows: DataFrame, terms: Sequence[C.Term] = C.TERMS, settings: Sequence[C.Setting] = C.SETTINGS) -> DataFrame:
    """(file, at, start, FINDING, evidence): what the rules find in `lines`."""
    found = rows.select("file", "at", "line", F.explode(C.accepted(F.col("line"), terms, settings)).alias("x"))
    table = [(i, r.rule, r.shown, r.status, r.category, *(r.severity if isinstance(r.severity, tuple) else (None, r.severity, r.severity))) for i, r in enumerate((*terms, *settings))]
    rules = rows.sparkSession.createDataFrame(table, "nth int, rule string, shown string, status string, category string, limit int, low string, high string")
    joined = found.join(F.broadcast(rules), F.col("x.rule") == F.col("nth"))  # as many rows as rules
    number = F.regexp_extract("x.hit", "([0-9]+)[^0-9]*$", 1)
    named = F.when(F.col("rule") == "pqc-hybrid-kem", F.col("x.hit")).otherwise(F.replace("shown", F.lit("#"), number))
    graded = F.when(F.col("limit").isNull() | (number.cast("long") <= F.col("limit")), F.col("low")).otherwise(F.col("high"))
    return joined.select("file", "at", F.col("x.start").alias("start"), "rule", named.alias("name"), "status", "category", graded.alias("severity"), F.trim("line").alias("evidence"))


def codes_in(line: Column) -> Column:
    """array of (kind, code): dotted numbers, hexadecimal suite codes and words that a line may be looked up by."""
    none = F.array().cast("array<string>")
    # most lines hold neither, and need no pattern for it
    pairs = F.when(line.contains("0x") | line.contains("0X"), F.regexp_extract_all(line, F.lit(r"(?i)0x[0-9a-f]{2}[,\s]+0x[0-9a-f]{2}(?![0-9a-f])|0x[0-9a-f]{4}"), F.lit(0))).otherwise(none)
    coded = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("code")))
    suites = F.transform(pairs, lambda p: F.upper(F.regexp_replace(F.lower(p), r"0x|[,\s]", "")))
    oids = F.when(line.contains("."), F.regexp_extract_all(line, F.lit(r"(?<![0-9.])[0-9]+(?:\.[0-9]+){3,}(?![0-9])"), F.lit(0))).otherwise(none)
    words = F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9_-]{3,}"), F.lit(0))
    return F.array_distinct(F.concat(coded("oid", oids), coded("suite", suites), coded("word", words)))


def by_codes(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """(file, at, kind, code, name, status, category, severity, evidence): the first line of each file with each code."""
    seen = rows.select("file", "at", F.trim("line").alias("evidence"), F.explode(codes_in(F.col("line"))).alias("c")).select("file", "at", "evidence", "c.*")
    known = F.broadcast(codes) if codes.count() <= BROADCAST else codes
    first = seen.join(known, ["kind", "code"]).groupBy("file", "kind", "code").agg(F.min_by(F.struct("at", "evidence", "name", "status", "category", "severity"), "at").alias("f"))
    return first.select("file", "kind", "code", "f.*")


def uncovered(found: DataFrame, coded: DataFrame) -> DataFrame:
    """The coded findings that no finding of their file covers: one whose name holds the first word of theirs (of a suite's,
    its key exchange). They are taken in order (identifiers, suites, words, then by line), each covering those after it."""
    names = found.groupBy("file").agg(F.collect_set(F.upper("name")).alias("names"))
    order = F.when(F.col("kind") == "oid", 0).when(F.col("kind") == "suite", 1).otherwise(2)
    key = F.when(F.col("kind") == "suite", F.split_part(F.regexp_replace("name", "^TLS_", ""), F.lit("_"), F.lit(1))).when(F.col("kind") == "word", F.col("code")).otherwise(F.split_part("name", F.lit(" "), F.lit(1)))
    # at most as many rows a file as there are codes
    one = coded.withColumn("x", F.struct(order.alias("o"), "at", "code", F.upper(key).alias("key"), F.upper("name").alias("said"), "kind", "name", "status", "category", "severity", "evidence"))
    per = one.groupBy("file").agg(F.array_sort(F.collect_list("x")).alias("xs")).join(names, "file", "left")
    kind = per.schema["xs"].dataType.simpleString()
    start = F.struct(F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.array().cast(kind).alias("kept"))

    def take(state: Column, x: Column) -> Column:
        hidden = F.exists(state["names"], lambda n: n.contains(x["key"]))
        return F.when(hidden, state).otherwise(F.struct(F.concat(state["names"], F.array(x["said"])).alias("names"), F.concat(state["kept"], F.array(x)).alias("kept")))

    kept = per.select("file", F.explode(F.aggregate("xs", start, take, lambda s: s["kept"])).alias("x")).select("file", "x.*")
    ready = (F.col("status") == "SAFE") & ((F.col("kind") == "word") | F.upper("category").contains("PQC"))
    rule = F.when(ready, "pqc-dictionary").otherwise(F.concat(F.lit("dictionary-"), "kind"))
    return kept.select("file", "at", rule.alias("rule"), "name", "status", "category", "severity", "evidence")


def scan(docs: DataFrame, codes: DataFrame | None = None, file: str = "file", text: str = "content") -> DataFrame:
    """(file, at, FINDING, n, evidence): findings of each file. A rule's hits of one name on equal lines are one finding at the
    first of them. What only says that a file lacks post-quantum cryptography goes where the file has some."""
    spark = docs.sparkSession
    codes = codes if codes is not None else spark.createDataFrame(list(C.CODES), "kind string, code string, name string, status string, category string, severity string")
    rows = lines(docs, file, text)
    hits = by_rules(rows)
    found = written(hits.groupBy("file", *FINDING, "evidence").agg(F.min("at").alias("at"), F.count("*").alias("n")), "rule-findings")
    more = uncovered(found.select("file", "name"), by_codes(rows, codes)).withColumn("n", F.lit(1).cast("long"))
    columns = ["file", "at", *FINDING, "n", "evidence"]
    both = written(found.select(columns).unionByName(more.select(columns)), "findings")
    ready = both.filter(F.col("rule").isin(*C.READY)).select("file").distinct()
    gaps = both.filter(F.col("rule").isin(*C.GAPS)).join(ready, "file", "left_anti").select(columns)
    return both.filter(~F.col("rule").isin(*C.GAPS)).unionByName(gaps)
