"""Answers of models put right: objects out of broken JSON, and quotes completed from the text they were taken from.

Spark reads what is well-formed; only what it can't read goes to a reader in Python, which gives back all members that are
complete. A quote is looked for in the normal form of its text (lower case, plain quotation marks, one blank between words);
a map of places leads back, so that what is cut out is the original. Rows are independent of each other, so work is spread by
rows. Null and empty texts give null; very long texts are read whole, in time proportional to their length.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import PLAIN, SMART, let

ADVICE = "struct<remediations:map<string,struct<remediation:string,actionable:string>>>"
#: Characters by which a quote may be completed.
MOST = 450
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "\\": "\\", "/": "/"}
_END = object()


class Loose:
    """A reader of JSON as models write it. A quotation mark ends a string only if a comma, a colon, a closing bracket or the end
    follows; a backslash before a character that can't be escaped is itself; line breaks may stand in strings. Where the text
    breaks off or can't be read, what is complete before that place counts."""

    def __init__(self, text: str):
        self.text, self.at, self.broken = text, 0, False

    def _blank(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at] if self.at < len(self.text) else ""

    def _ends(self, at: int) -> bool:
        rest = at + 1
        while rest < len(self.text) and self.text[rest].isspace():
            rest += 1
        if rest >= len(self.text) or self.text[rest] in ":}]":
            return True
        if self.text[rest] != ",":
            return False
        rest += 1  # a comma within a sentence isn't followed by another member
        while rest < len(self.text) and self.text[rest].isspace():
            rest += 1
        return rest >= len(self.text) or self.text[rest] in "\"{[}]" or self.text[rest].isdigit() or self.text.startswith(("true", "false", "null", "-"), rest)

    def _string(self) -> object:
        out, at = [], self.at + 1
        while at < len(self.text):
            c = self.text[at]
            if c == '"' and self._ends(at):
                self.at = at + 1
                # two escapes may be the halves of one character
                return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            if c == "\\" and at + 1 < len(self.text):
                following = self.text[at + 1]
                code = self.text[at + 2 : at + 6]
                if following == "u" and re.fullmatch("[0-9a-fA-F]{4}", code):
                    out.append(chr(int(code, 16)))
                    at += 6
                    continue
                # a path such as C:\temp has no tab in it; a line break before a word is meant
                out.append(_ESCAPES[following] if following in _ESCAPES else "\\" + following)
                at += 2
                continue
            out.append(c)
            at += 1
        self.broken = True
        return _END

    def value(self) -> object:
        c = self._blank()
        if c == '"':
            return self._string()
        if c in ("{", "["):
            return self._members(c == "{")
        found = re.compile(r"true|false|null|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?").match(self.text, self.at)
        if not found:
            self.broken = True
            return _END
        self.at = found.end()
        return json.loads(found.group())

    def _members(self, named: bool) -> object:
        out: dict | list = {} if named else []
        self.at += 1
        while True:
            c = self._blank()
            if c in ("}", "]"):
                self.at += 1
                return out
            if c == ",":
                self.at += 1
                continue
            if not c or named and c != '"':
                self.broken = True
                return out
            key = self._string() if named else None
            if named and (key is _END or self._blank() != ":"):
                self.broken = True
                return out
            self.at += named
            member = self.value()
            whole = member is not _END and not (self.broken and not isinstance(member, (dict, list)))
            if whole and (not self.broken or member):
                if named:
                    out[key] = member
                else:
                    out.append(member)
            if self.broken:
                return out


def loose(raw: str | None) -> object:
    """What a text holds, from its first brace on; None without one."""
    at = (raw or "").find("{")
    return None if at < 0 else Loose(raw[at:]).value()


def _advice(raw: str | None) -> str | None:
    found = loose(raw)
    members = found.get("remediations") if isinstance(found, dict) else None
    if not isinstance(members, dict):
        return None
    said = lambda v: v if isinstance(v, str) else "\n".join(map(str, v)) if isinstance(v, list) else None if v is None else str(v)
    # a bare text stands for the first of the two fields
    both = {k: {f: said(v.get(f)) for f in ("remediation", "actionable")} if isinstance(v, dict) else {"remediation": said(v), "actionable": None} for k, v in members.items()}
    return json.dumps({"remediations": both})


@F.pandas_udf(StringType())
def _repaired(raw: pd.Series) -> pd.Series:
    return raw.map(_advice)


def advice(raw: Column) -> Column:
    """map of number to (remediation, actionable) out of a model's answer, null if it holds none. A fence around the object and
    words before and after it are left out; well-formed answers never leave the JVM."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    text = F.when(fenced != "", fenced).otherwise(F.trim(raw))
    body = let(text, lambda t: F.substr(t, F.instr(t, "{"), F.length(t) - F.locate("}", F.reverse(t)) + 2 - F.instr(t, "{")))
    good = F.from_json(body, ADVICE)["remediations"]
    whole = good.isNotNull() & F.forall(F.map_values(good), lambda v: v.isNotNull())
    return F.when(whole, good).otherwise(F.from_json(_repaired(F.when(~F.coalesce(whole, F.lit(False)), text)), ADVICE)["remediations"])


_PLAIN = dict(zip(SMART, PLAIN, strict=True))


def normal_places(text: str) -> tuple[str, list[int]]:
    """The normal form of a text, and for each of its characters the place of the one it comes from."""
    out, places = [], []
    for i, c in enumerate(text):
        if c.isspace():
            if out and out[-1] != " ":
                out.append(" ")
                places.append(i)
            continue
        for low in _PLAIN.get(c, c).lower():
            out.append(low)
            places.append(i)
    if out and out[-1] == " ":
        out.pop()
        places.pop()
    return "".join(out), places


def located(quote: str, text: str) -> tuple[int, int] | None:
    """Where a quote stands in a text, compared in normal form; places of the original, the end exclusive."""
    q, (t, places) = normal_places(quote)[0], normal_places(text)
    at = t.find(q) if q else -1
    return None if at < 0 else (places[at], places[at + len(q) - 1] + 1)


#: Words with a full stop that ends no sentence.
_SHORT = re.compile(r"(?:^|[^A-Za-z])(?:[A-Za-z]|i\.e|e\.g|vs|no|cf)\.$", re.IGNORECASE)


def completed(quote: str | None, text: str | None, most: int = MOST) -> str | None:
    """The original of a quote up to the end of its sentence or paragraph, at most `most` characters further on; the quote itself where
    it isn't found or is too short (fewer than eight characters) to be looked for."""
    bare = (quote or "").strip()
    where = located(bare, text) if len(bare) >= 8 and text else None
    if where is None:
        return quote if quote is None else bare
    start, end = where
    if not bare.endswith((".", "!", "?")):
        limit = min(len(text), end + most)
        for i in range(end, limit):
            if text[i] in ".!?" and (i + 1 == len(text) or text[i + 1].isspace() or text[i + 1] in "\"'”’") and not _SHORT.search(text[max(start, i - 5) : i + 1]):
                end = i + 1
                break
            if text[i] == "\n" and text[i + 1 : i + 2] in ("\n", "\r"):
                end = i
                break
        else:
            end = limit
    return text[start:end].strip().rstrip("\"' \n\r")


@F.pandas_udf(StringType())
def complete(quote: pd.Series, text: pd.Series) -> pd.Series:
    """`completed` as a column function."""
    return pd.Series([completed(q, t) for q, t in zip(quote, text, strict=True)], dtype=object)
