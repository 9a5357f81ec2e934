"""Exact token counts at every prefix by dynamic programming.

For byte-pair encoding, the encoding of a prefix ends in the one token t that may follow the last token of what is
before it: encoding both together gives just these two. So `last[i]` and `count[i] = count[i - len(t)] + 1` follow
from shorter prefixes, each pair being tested once. Pieces of text that the tokenizer never joins are counted once per
worker and reused; a text's table is the pieces' tables one after another, with a step of one byte per code point.

The table answers how many tokens any prefix has (`count_at`), and how much of a text fits a budget (`fitting`),
without encoding again. Counts are those of the prefix itself: they may fall as a word is completed.

Null texts count as empty (no tokens, an empty table). Very long texts are counted whole; long pieces aren't remembered. Strings of special tokens count as the special token, as is the
library's default. Of tokens that may end a prefix the encoding has exactly one, so there are no
ties. Repeated rows and null ids are kept; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import bound_batches, ship

LIMIT = 1024
#: Pieces whose tables a worker remembers, their greatest length, and pairs of tokens it remembers.
REMEMBERED, LONGEST, PAIRS = 400_000, 64, 1_000_000
#: White space and what it leads to. Contractions stand as the vocabulary's pattern has them, and need no blank before.
_S, _L, _N = r"\p{White_Space}", r"\p{L}", r"\p{N}"
_PIECE = regex.compile(rf"[{_S}]*(?:(?<! )'(?:[stmd]|re|ve|ll)|{_L}+|{_N}+|[^{_S}{_L}{_N}]+)|[{_S}]+")
_PARTS = regex.compile(rf"([{_S}]*)(.*)", regex.DOTALL)
_STEP = [bytes((n,)) for n in range(256)]
_CONTRACTION = regex.compile(r"'(?:[stmd]|re|ve|ll)")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files of byte-level encodings: printable Latin-1 characters
    stand for themselves, the others for the letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Remembered(dict):
    """Steps by piece; a missing piece's are made, and kept unless it is long."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        steps = self.make(piece)
        if len(piece) <= LONGEST:
            self[piece] = steps
        return steps


class Prefixes:
    """Tables of a byte-level BPE vocabulary file. A table is bytes: signed steps of the count, one per code point."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        of = _byte_letters()
        as_bytes = lambda s: bytes(of[c] for c in s)
        special = {x["content"] for x in data["added_tokens"]}
        self.ids = {as_bytes(s): i for s, i in data["model"]["vocab"].items() if s not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        merges = [(self.ids[as_bytes(a)], self.ids[as_bytes(b)], self.ids[as_bytes(a + b)]) for a, b in pairs]
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.parts = {t: (r, a, b) for r, (a, b, t) in enumerate(merges)}
        lengths: dict[bytes, set[int]] = {}
        for t in self.ids:
            if len(t) > 3:
                lengths.setdefault(t[-4:], {3, 2, 1}).add(len(t))
        self.lengths = {tail: tuple(sorted(n, reverse=True)) for tail, n in lengths.items()}  # of tokens that end so
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known = _Remembered(self._piece)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[bytes, tuple[bytes, int, int]] = {b"": (b"", 0, -1)}  # by prefix: steps, count, last token

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token that lie at one of its ends while it is being built, each with the rank of the merge that
        takes it up."""
        out, rank = [], float("inf")
        while True:
            out.append((token, rank))
            if token not in self.parts:
                return out
            rank, *pair = self.parts[token]
            token = pair[side]

    def _follows(self, a: int, b: int) -> bool:
        """Whether b stays apart from a before it: no parts that lie at their border at the same time are merged before
        a merge within a or b takes one of them up. Of equal merges the left one comes first."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known, rank = True, self.rank
            lefts = self._edge(a, 1)
            for y, right in self._edge(b, 0):
                for x, left in lefts:
                    r = rank.get((x, y))
                    if r is not None and r < left and r <= right:
                        known = False
            self.pairs[a, b] = known
        return known

    def _end(self, word: bytes, end: int, last: Callable[[int], int]) -> tuple[int, int]:
        """Where the last token of word[:end] begins, and the token; `last` gives the last token of a shorter prefix."""
        ids = self.ids
        for n in self.lengths.get(word[end - 4 : end], (3, 2, 1)) if end > 3 else range(end, 0, -1):
            if n <= end:
                begin = end - n
                token = ids.get(word[begin:end])
                if token is not None and (not begin or self._follows(last(begin), token)):
                    return begin, token
        raise ValueError(f"no token ends {word[:end]!r}")

    def steps(self, word: bytes) -> bytes:
        """Steps of the count over the bytes of a word that the tokenizer takes as one. Words share the states of the
        prefixes they share, unless they are long."""
        if len(word) > LONGEST:
            count, tokens = [0], [-1]
            for end in range(1, len(word) + 1):
                begin, token = self._end(word, end, tokens.__getitem__)
                count.append(count[begin] + 1)
                tokens.append(token)
            return bytes([(b - a) & 0xFF for a, b in zip(count, count[1:], strict=False)])
        states, known = self.states, len(word)
        while (state := states.get(word[:known])) is None:
            known -= 1
        ids, pairs, lengths = self.ids, self.pairs, self.lengths  # the loop below is `_end`, written out as it runs most
        for end in range(known + 1, len(word) + 1):
            for n in lengths.get(word[end - 4 : end], (3, 2, 1)) if end > 3 else range(end, 0, -1):
                if n > end or (token := ids.get(word[end - n : end])) is None:
                    continue
                before = states[word[: end - n]]
                apart = n == end or pairs.get((before[2], token))
                if apart or apart is None and self._follows(before[2], token):
                    break
            count = before[1] + 1
            state = states[word[:end]] = (state[0] + _STEP[(count - state[1]) & 0xFF], count, token)
        return state[0]

    def counts(self, word: bytes) -> list[int]:
        """Tokens of each prefix of such a word, from the empty one on."""
        return [0, *accumulate(s - 256 if s > 127 else s for s in self.steps(word))]

    def _at_letters(self, word: str) -> list[int]:
        """Tokens of each prefix of whole code points, without the empty one."""
        if word == " ":
            return [1]
        data = word.encode()
        count = self.counts(data)
        if len(data) == len(word):
            return count[1:]
        return [count[i] for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]

    def _piece(self, piece: str) -> bytes:
        """The steps over white space and the word after it. White space is one word as long as nothing follows; then its
        last character goes with the word if it is a blank, or stands alone."""
        first = piece[0]
        if piece.isascii() and not (piece[1:2].isspace() or piece == " " if first == " " else first.isspace() or first == "'"):
            return self.steps(piece.encode())  # one word of the tokenizer, and a code point is a byte
        blanks, word = _PARTS.fullmatch(piece).groups()
        levels = [0, *(self._at_letters(blanks) if blanks else [])]
        if word:
            lead, before = "", levels[-1]
            if blanks.endswith(" "):
                lead, before = " ", levels[-2]
            elif len(blanks) > 1:
                before = levels[-2] + self.counts(blanks[-1].encode())[-1]
            after = self._at_letters(lead + word)[len(lead) :]
            if len(word) > 2 and not lead and _CONTRACTION.fullmatch(word):
                after[1] = after[0] + self.counts(word[1].encode())[-1]  # an apostrophe and one letter aren't joined
            levels += [before + n for n in after]
        return bytes([(b - a) & 0xFF for a, b in zip(levels, levels[1:], strict=False)])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, _PIECE.findall(text)))

    def table(self, text: str) -> bytes:
        """The steps of a whole text. Inside the string of a special token it is still ordinary text; at its end the
        count is that of the text before it and one more."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.states) > 2 * REMEMBERED:
            self.states = {b"": self.states[b""]}
        if self.special is None or not (found := list(self.special.finditer(text))):
            return self._plain(text)
        out, at = [], 0
        for m in found:
            head = self._plain(text[at : m.start()])
            steps = np.frombuffer(self._plain(text[at : m.end()]), np.int8)[len(head) :].copy()
            # up to its last character the prefix is ordinary text, also where its blanks were one run before
            total = int(np.frombuffer(head, np.int8).sum(dtype=np.int64))
            levels = total + np.cumsum(steps, dtype=np.int64)
            levels[-1] = total + 1
            out += [head, np.diff(levels, prepend=total).astype(np.int8).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


_tables: dict[str, Prefixes] = {}


def prefixes_of(path: str) -> Prefixes:
    """One per worker process and vocabulary."""
    if path not in _tables:
        _tables[path] = Prefixes(path)
    return _tables[path]


def levels(table: bytes) -> np.ndarray:
    """Token counts of all prefixes of a text, the empty one first."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)))


def longest(table: bytes, budget: int) -> int:
    """Code points of the longest prefix that has at most `budget` tokens."""
    return int(np.flatnonzero(levels(table) <= budget)[-1])


def prefix_tables(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, fit_chars, prefix): prefix is the table of the whole text, fit_chars the number of its code
    points that `limit` tokens hold."""
    bound_batches(docs.sparkSession, 256)
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = prefixes_of(tokenizer)
        for b in batches:
            steps = [tables.table(x or "") for x in b.column(1).to_pylist()]
            tokens = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
            # a prefix may have more tokens than the whole text, but only a long one can pass the limit
            fits = [len(s) if len(s) <= limit else longest(s, limit) for s in steps]
            columns = [b.column(0), b.column(2), pa.array(tokens, pa.int64()), pa.array(fits, pa.int64()), pa.array(steps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_tokens", "fit_chars", "prefix"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"), F.octet_length(text).cast("long").alias("_bytes"))
    return rows.mapInArrow(of, f"`{id_col}` {kind}, n_bytes long, n_tokens long, fit_chars long, prefix binary")


@F.pandas_udf(LongType())
def count_at(prefix: pd.Series, chars: pd.Series) -> pd.Series:
    """Tokens of the first `chars` code points (all, if there are fewer)."""
    return pd.Series([int(np.frombuffer(p, np.int8)[: max(0, n)].sum(dtype=np.int64)) for p, n in zip(prefix, chars, strict=True)])


def fitting(prefix: Column, budget: int) -> Column:
    """Code points of the longest prefix that has at most `budget` tokens."""

    @F.pandas_udf("long")
    def fits(tables: pd.Series) -> pd.Series:
        return pd.Series([longest(t, budget) for t in tables])

    return fits(prefix)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fit_chars): whether a text passes the limit and how much of it the limit holds."""
    rows = prefix_tables(docs, public_tokenizers.path("byte_bpe_50k.json"), id_col, text_col, limit)
    return rows.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")
