"""Statuses, verdicts, validity and risk levels of controls, with the clock as a parameter.

The words are fixed values: they have to be those that auditors' tools send.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import has_any
from .severity import cases, status

# Statuses that assert a pass, that affirm what is recorded, that only say what became of a finding, that
# assert a shortfall, and the one of a fixed finding.
ACCEPTING = ("COMPLIANT", "PASS", "PASSED", "SATISFIED")
AFFIRMING = ("ACCEPTED", "CONFIRMED")
WORKFLOW = ("REJECTED", "DISMISSED", "FALSE_POSITIVE", "OUT_OF_SCOPE", "EXCLUDED")
FAILING = ("NON_COMPLIANT", "NONCOMPLIANT", "FAIL", "FAILED", "GAP", "PARTIAL_COMPLIANT", "PARTIALLY_COMPLIANT", "PARTIAL")
CLOSED = "CLOSED"
# Targets that name no system.
PLACEHOLDERS = (
    "", "web application endpoint", "n/a", "na", "none", "unknown", "localhost", "target", "host", "-", "not recorded", "scoped target systems",
)
# Words by which a text says that it is out of date.
STALE = (
    "expired", "deprecated", "decommissioned", "no longer valid", "no longer used", "no longer in use", "superseded", "obsolete", "discontinued",
    "retired", "end of life", "end-of-life", "sunset", "not in use",
)
# Levels of the 3 x 3 matrix of likelihood and impact, and the severities that go with them.
LEVELS = ("LOW", "MODERATE", "HIGH")
MATRIX = {
    ("LOW", "LOW"): "LOW", ("LOW", "MODERATE"): "LOW", ("LOW", "HIGH"): "MEDIUM", ("MODERATE", "LOW"): "LOW", ("MODERATE", "MODERATE"): "MEDIUM",
    ("MODERATE", "HIGH"): "HIGH", ("HIGH", "LOW"): "MEDIUM", ("HIGH", "MODERATE"): "HIGH", ("HIGH", "HIGH"): "CRITICAL",
}
PRIORITIES = {"LOW": "P4 Low", "MEDIUM": "P3 Medium", "HIGH": "P2 High", "CRITICAL": "P1 Critical"}
# Likelihood and impact by what was found of policy, evidence and its assessment (null: any).
DEFAULTS = {
    ("FOUND", "NOT_FOUND", None): ("LOW", "MODERATE"), ("NOT_FOUND", "NOT_FOUND", None): ("MODERATE", "HIGH"),
    ("NOT_FOUND", "FOUND", None): ("LOW", "LOW"), ("FOUND", "FOUND", "NON_COMPLIANT"): ("MODERATE", "MODERATE"),
}
# Words by which a requirement asks for a document, or for an implementation.
POLICY_WORDS = (
    "policy", "policies", "procedure", "procedures", "documented procedure", "written standard", "governance framework", "documented strategy",
    "shall document", "shall define", "approved policy", "documented rules", "formal procedure",
)
TECHNICAL_WORDS = (
    "shall configure", "shall implement", "shall synchronize", "shall monitor", "system log", "access log", "metric", "status output",
    "configuration setting", "time server", "audit trail",
)
#: Ways to write a day and a month, tried in this order; the first that takes the whole text counts.
DAYS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "M/d/yyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyy/M/d", "d-MMM-yyyy", "d.M.yyyy")
MONTHS = ("MMMM yyyy", "MMM yyyy", "yyyy-M", "M/yyyy", "M-yyyy", "yyyy/M")


def verdict(raw: Column, recorded: Column) -> Column:
    """What a status makes of the recorded verdict. Unknown words are never a pass."""
    s = status(raw)
    kept = F.coalesce(F.nullif(F.upper(F.trim(recorded)), F.lit("")), F.lit("NON_COMPLIANT"))
    return cases([(s.isin(*ACCEPTING), "COMPLIANT"), (s.isin(*AFFIRMING, *WORKFLOW), kept), (s == CLOSED, CLOSED)], "NON_COMPLIANT")


def passed(raw: Column, recorded: Column) -> Column:
    """Whether a report shows the control as met: an explicit verdict in the status wins over the recorded one."""
    s = status(raw)
    return cases([(s.isin(*ACCEPTING), True), (s.isin(*FAILING), False)], status(recorded) == "COMPLIANT")


def recognised(raw: Column) -> Column:
    return status(raw).isin(*ACCEPTING, *AFFIRMING, *WORKFLOW, *FAILING)


def closed(raw: Column, recorded: Column) -> Column:
    """A finding that is fixed: so by its status, or affirmed with a verdict that says so."""
    return (status(raw) == CLOSED) | (status(raw).isin(*AFFIRMING) & (status(recorded) == CLOSED))


def target_of(key: Column) -> Column:
    """The target in a key, empty if it has none."""
    k = F.coalesce(key, F.lit(""))
    return F.when(k.contains("|target:"), F.lower(F.trim(F.substring_index(k, "|target:", -1)))).otherwise("")


def suppressible(key: Column) -> Column:
    """Whether a key names one instance of a finding."""
    return (F.coalesce(key, F.lit("")) != "") & ~target_of(key).isin(*PLACEHOLDERS)


def thrown_out(raw: Column) -> Column:
    return status(raw).isin(*WORKFLOW)


def nist(status_: Column, final: Column, likelihood: Column, impact: Column, policy: Column, evidence: Column, assessment: Column) -> Column:
    """struct(likelihood, impact, level, severity). Stated values count if they are levels, else those that go with what was
    found; a pass has no risk, and what was never evaluated or can't be told is undetermined."""
    up = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    s, l0, i0 = up(status_), up(likelihood), up(impact)
    l_ok, i_ok = l0.isin(*LEVELS), i0.isin(*LEVELS)
    p, e, a = up(policy), up(evidence), up(assessment)
    fits = [((p == x) & (e == y) & (F.lit(True) if z is None else a == z), pair) for (x, y, z), pair in DEFAULTS.items()]
    known = cases([(c, True) for c, _ in fits], False) | (l_ok & i_ok)
    lh = F.when(l_ok, l0).otherwise(cases([(c, pair[0]) for c, pair in fits]))
    im = F.when(i_ok, i0).otherwise(cases([(c, pair[1]) for c, pair in fits]))
    # looked up by one key: a CASE would compute both sides for each cell
    both = F.concat(lh, F.lit("/"), im)
    level, severity = (F.element_at(F.create_map(*[F.lit(x) for (a, b), v in MATRIX.items() for x in (f"{a}/{b}", of(v))]), both) for of in (str, PRIORITIES.get))
    never = (s == "NOT_EVALUATED") | (F.coalesce(final, F.lit("")) == "NOT_EVALUATED")
    free = s.isin("COMPLIANT", "FALSE_POSITIVE") | (F.coalesce(final, F.lit("")) == "COMPLIANT")
    rated = ~never & ~free & known
    return F.struct(
        F.when(rated, lh).otherwise("N/A").alias("likelihood"), F.when(rated, im).otherwise("N/A").alias("impact"),
        F.when(rated, level).when(free & ~never, "N/A").otherwise("UNDETERMINED").alias("level"),
        F.when(rated, severity).otherwise("N/A").alias("severity"),
    )


def loose_date(text: Column) -> Column:
    """A timestamp from any of the ways to write a day, else the last second of a month; null if none fits."""
    day = F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in DAYS])
    month = F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in MONTHS])
    return F.coalesce(day, F.last_day(month).cast("timestamp") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"))


def date_grounded(date: Column, source: Column) -> Column:
    """Whether a source has a year of the date and a number of one or two digits of it, where the date has such."""
    tokens = F.regexp_extract_all(F.coalesce(date, F.lit("")), F.lit("[0-9]+"), F.lit(0))
    text = F.lower(F.coalesce(source, F.lit("")))
    some = lambda keep: F.filter(tokens, keep)
    ok = lambda found: (F.size(found) == 0) | F.exists(found, lambda t: text.contains(t))
    years, others = some(lambda t: F.length(t) == 4), some(lambda t: F.length(t) <= 2)
    return (F.size(tokens) > 0) & (text != "") & ok(years) & ok(others)


def stale(text: Column) -> Column:
    return has_any(F.lower(F.coalesce(text, F.lit(""))), STALE)


def freshness(date: Column, quote: Column, source: Column) -> Column:
    """struct(date, freshness): a date that no source has is dropped. Age alone never makes evidence stale, its words do."""
    kept = F.when(date_grounded(date, F.concat_ws(" ", source, quote)), F.trim(date)).otherwise("")
    return F.struct(kept.alias("date"), F.when(stale(quote), "STALE").otherwise("UNKNOWN").alias("freshness"))


def validity(expiry: Column, review: Column, policy: Column, source: Column, as_of: Column) -> Column:
    """EXPIRED by the policy's own words, else by its expiry, else by its review date; UNKNOWN without a grounded date."""
    grounded = lambda d: F.when(date_grounded(d, F.concat_ws(" ", source, policy)), loose_date(d))
    ends, due = grounded(expiry), grounded(review)
    return (
        F.when(stale(policy), "EXPIRED").when(ends < as_of, "EXPIRED").when(ends.isNotNull(), "CURRENT")
        .when(due < as_of, "REVIEW_OVERDUE").when(due.isNotNull(), "CURRENT").otherwise("UNKNOWN")
    )


def policy_required(requirement: Column, control: Column, name: Column) -> Column:
    """Whether a requirement asks for a document: by its words, else not if it asks for an implementation, else by its clause."""
    text = F.lower(F.concat_ws(" ", F.coalesce(requirement, F.lit("")), F.coalesce(name, F.lit(""))))
    clause = F.regexp_extract(F.coalesce(control, F.lit("")), r"^\s*([0-9]+)\.", 1)
    return cases([(has_any(text, POLICY_WORDS), True), (has_any(text, TECHNICAL_WORDS), False)], clause.isin("5", "6", "7"))
