"""What becomes of a finding after it was grounded: an ordered chain of rules, each of which sees what those before it did.

A rule has a condition on a finding's state and the fields that it changes; some end the chain. The names of the rules that
applied are kept in order in `decided`, so that every verdict can be traced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from .labels import injects, leaks

STATE = ("status", "check", "quote", "review", "note")
# Names of states and notes that stored reports use.
SURE = ("GROUNDED", "GROUNDED_WITH_OCR_WARNING")
FUZZY_NOTE = "Potential OCR distortion: Cited evidence was grounded via fuzzy correlation. Verify exact spelling in PDF."
CLAIMED_NOTE = "Grounding validation failed: cited evidence quote was not found in policy document text."
POTENTIAL_NOTE = "Potential evidence found. Human verification needed."
OUTSIDE = ("FALSE_POSITIVE", "FALSE POSITIVE", "OUT_OF_SCOPE", "OUT OF SCOPE", "INAPPLICABLE")
IN_FORCE = ("CURRENT", "UNKNOWN")
NOTHING = ("", "N/A", "NA", "NONE", "NOT FOUND", "NOT_FOUND")


@dataclass(frozen=True)
class Rule:
    name: str
    applies: Callable[[], Column]
    changes: dict[str, Callable[[], Column]]
    ends: bool = False


def _up(c: str) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))


def _noted(note: str | Column) -> Callable[[], Column]:
    """The note after what is noted already, once."""

    def out() -> Column:
        new, old = (F.lit(note) if isinstance(note, str) else note), F.coalesce("note", F.lit(""))
        return F.when(old == "", new).when(old.contains(new), old).otherwise(F.concat_ws(" ", old, new))

    return out


def _is(c: str, *values: str) -> Callable[[], Column]:
    return lambda: F.col(c).isin(*values)


def _outside() -> Column:
    up = _up("status")
    out = up.contains(OUTSIDE[0])
    for w in OUTSIDE[1:]:
        out = out | up.contains(w)
    return out


def keywords_of(control: Column) -> Column:
    """The words of a control's name behind its number, letters and digits only, of more than three characters."""
    words = F.transform(F.slice(F.split(F.coalesce(control, F.lit("")), " "), 2, 2**30), lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z0-9]", "")))
    return F.filter(words, lambda w: F.length(w) > 3)


def _named() -> Column:
    low = F.lower(F.coalesce("document", F.lit("")))
    return F.exists(keywords_of(F.col("control")), lambda w: low.contains(w))


_true = lambda: F.lit(True)
_value = lambda v: lambda: F.lit(v)
#: Gates: is the quote real, does it say what its source says, and does the verdict stand without it?
GATES = (
    Rule("leak", lambda: leaks(F.col("quote"), F.col("hint")) | injects(F.col("quote")), {"status": _value("NON_COMPLIANT"), "check": _value("PROMPT_LEAK"), "quote": _value("")}, ends=True),
    Rule("fuzzy", lambda: (F.col("check") == "NOT_GROUNDED") & F.col("fuzzy"), {"check": _value("GROUNDED_WITH_OCR_WARNING"), "review": _true, "note": _noted(FUZZY_NOTE)}),
    Rule("contradiction", lambda: F.col("check").isin(*SURE) & (F.size("differs") > 0), {
        "check": _value("VALUE_CONTRADICTION"), "review": _true, "note": lambda: F.concat(F.lit("HELD FOR REVIEW - the finding states a value the evidence does not: "), F.array_join("differs", "; "))}),
    Rule("out of scope", lambda: _outside(), {"status": _value("FALSE_POSITIVE"), "check": _value("OUT_OF_SCOPE")}),
    Rule("claimed without evidence", lambda: (F.col("check") == "NOT_GROUNDED") & _up("status").isin("COMPLIANT", "PARTIAL", "PARTIALLY_COMPLIANT"), {
        "status": _value("NON_COMPLIANT"), "review": _true, "note": _value(CLAIMED_NOTE)}),
    Rule("no evidence", lambda: (F.col("check") == "NOT_GROUNDED") & ~_up("status").isin("COMPLIANT", "PARTIAL", "PARTIALLY_COMPLIANT") & (F.coalesce("note", F.lit("")) != CLAIMED_NOTE), {
        "status": _value("NON_COMPLIANT"), "quote": _value("NOT_FOUND")}),
    Rule("compliant", lambda: _up("status").contains("COMPLIANT") & ~_up("status").contains("NON") & ~_up("status").contains("PARTIAL"), {"status": _value("COMPLIANT")}),
    Rule("not compliant", lambda: ~F.col("status").isin("COMPLIANT", "FALSE_POSITIVE") | F.col("status").isNull(), {"status": _value("NON_COMPLIANT")}),
)
_off = lambda *conditions: lambda: (F.col("status") != "FALSE_POSITIVE") & ~F.col("settled") & conditions[0]()
#: The policy: who decides, and what a control needs. Rules that settle the verdict set `settled`; the first of them counts.
POLICY = (
    Rule("blocked", lambda: _up("override") == "BLOCK", {}, ends=True),
    Rule("question", lambda: _up("mode") == "RAG", {}, ends=True),
    Rule("potential evidence", lambda: (F.col("status") == "NON_COMPLIANT") & ~F.col("check").isin(*SURE) & _named(), {"review": _true, "note": _noted(POTENTIAL_NOTE)}),
    *[
        Rule(name, _off(applies), {"status": _value("NON_COMPLIANT"), "settled": _true})
        for name, applies in (
            ("policy missing", lambda: (_up("mode") != "CUSTOMIZE") & (_up("policy_status") != "FOUND")),
            ("policy inadequate", lambda: (_up("mode") != "CUSTOMIZE") & (_up("policy_assessment") == "NON_COMPLIANT")),
            ("evidence missing", lambda: _up("evidence_status") != "FOUND"),
            ("evidence inadequate", lambda: _up("evidence_assessment") != "COMPLIANT"),
            ("policy out of date", lambda: ~F.coalesce(F.nullif(_up("policy_validity"), F.lit("")), F.lit("UNKNOWN")).isin(*IN_FORCE)),
            ("evidence out of date", lambda: ~F.coalesce(F.nullif(_up("evidence_freshness"), F.lit("")), F.lit("UNKNOWN")).isin(*IN_FORCE)),
        )
    ],
    Rule("both found", _off(lambda: F.lit(True)), {"status": _value("COMPLIANT"), "settled": _true}),
)


def apply(findings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """`findings` after the rules, with `decided` (names of those that applied) and `ended`."""
    for c, start in (("decided", F.array().cast("array<string>")), ("ended", F.lit(False)), ("settled", F.lit(False))):
        if c not in findings.columns:
            findings = findings.withColumn(c, start)
    for r in rules:
        hit = F.col("_hit")
        findings = findings.withColumn("_hit", ~F.col("ended") & F.coalesce(r.applies(), F.lit(False)))
        new = {c: F.when(hit, of()).otherwise(F.col(c)) for c, of in r.changes.items()}
        new["decided"] = F.when(hit, F.concat("decided", F.array(F.lit(r.name)))).otherwise(F.col("decided"))
        if r.ends:
            new["ended"] = F.col("ended") | hit
        findings = findings.withColumns(new)
    return findings.drop("_hit")


def judged(findings: DataFrame) -> DataFrame:
    """Findings after gates and policy. Needed columns: status, check (what grounding says), fuzzy, quote, source, hint, note, review,
    document, control, override, mode, policy_status, policy_assessment, policy_validity, evidence_status, evidence_assessment,
    evidence_freshness; others pass through. Null texts count as empty; rows are judged each by itself."""
    f = findings.withColumn("review", F.coalesce("review", F.lit(False))).withColumn("check", F.coalesce("check", F.lit("NOT_GROUNDED"))).withColumn("fuzzy", F.coalesce("fuzzy", F.lit(False)))
    return apply(apply(f.withColumn("differs", X.contradictions(F.col("quote"), F.col("source"))), GATES), POLICY).drop("differs", "settled", "ended")


def within_lock(finding_file: Column, locked: Column) -> Column:
    """The file a finding names, or the first locked one where it names another; nothing is changed without a lock."""
    name = F.trim(F.coalesce(finding_file, F.lit("")))
    return F.when((F.coalesce(F.size(locked), F.lit(0)) > 0) & (name != "") & ~F.array_contains(locked, name), F.get(locked, F.lit(0))).otherwise(finding_file)


def quoted_within_lock(quote: Column, locked: Column, context: Column, most: int = 800) -> Column:
    """The quote, or the first paragraph of more than 20 characters of the locked context where there is none to speak of."""
    bare = F.btrim(X.stripped(F.coalesce(quote, F.lit(""))), F.lit("\"'"))
    empty = F.upper(bare).isin(*NOTHING) | (F.length(bare) < 10)
    text = X.stripped(F.coalesce(context, F.lit("")))
    long = F.filter(F.transform(F.split(text, "\n\n"), X.stripped), lambda p: F.length(p) > 20)
    chosen = F.left(F.coalesce(F.get(long, F.lit(0)), text), F.lit(most))
    return F.when((F.coalesce(F.size(locked), F.lit(0)) > 0) & empty & (text != ""), chosen).otherwise(quote)
