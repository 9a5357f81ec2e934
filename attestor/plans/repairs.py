"""Queries of answers that are put right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import repair
from ..session import bound_batches, ship
from . import twin as T
from .registry import Tables, query

_c = F.col
ANSWERS = (
    '{"remediations": {"0": {"remediation": "Update the server", "actionable": "apt upgrade"}, "1": {"remediation": "Set the flag", "actionable": null}}}',
    'Here it is:\n```json\n{"remediations": {"0": {"remediation": "Rotate the key", "actionable": "see docs"}}}\n```\nDone.', '{"remediations": {"0": {"remediation": "Look in C:\\Program Files", "actionable": "use \\d+ as pattern"}}}',
    '{"remediations": {"0": {"remediation": "Say "no" to it", "actionable": "a, b"}, "1": {"remediation": "cut sh', '{"remediations": {"0": "A bare text", "2": {"remediation": "line\nbreak", "actionable": ["one", "two"]}}}', "no object here", None, "", '{"other": 1}', '{"remediations": []}',
)
_READ = (
    (("0", "Update the server", "apt upgrade"), ("1", "Set the flag", None)), (("0", "Rotate the key", "see docs"),), (("0", "Look in C:\\Program Files", "use \\d+ as pattern"),), (("0", 'Say "no" to it', "a, b"),),
    (("0", "A bare text", None), ("2", "line\nbreak", "one\ntwo")), (), (), (), (), (),
)


@query("hlp27_salvaged_json")
def _(t: Tables) -> DataFrame:
    """The advice in each answer; answers of models are picked by the keys of orders."""
    o = t("orders").select("o_orderkey", repair.advice(T.pick(_c("o_orderkey"), ANSWERS)).alias("a"))
    return o.select("o_orderkey", F.explode("a").alias("nth", "x")).select("o_orderkey", "nth", "x.remediation", "x.actionable")


def quotes(t: Tables) -> DataFrame:
    """(doc_id, quote, text): words 4 to 9 of each document, in upper case and spread over lines."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    quote = F.translate(F.array_join(F.slice(words, 4, 6), "\n "), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return t("documents").select("doc_id", quote.alias("quote"), "text")


@query("hlp34_completed_quotes")
def _(t: Tables) -> DataFrame:
    """Each quote as the sentence of its document that it begins."""
    rows = quotes(t)
    bound_batches(rows.sparkSession)
    ship(rows.sparkSession)
    return rows.select("doc_id", repair.complete("quote", "text").alias("completed"))
