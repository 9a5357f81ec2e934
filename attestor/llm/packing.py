"""Sum-of-squares online packing of tokenised documents into fixed windows.

Documents arrive one by one in each partition. Whole windows are cut off long documents; the rest of a document goes to
the fill level that minimises the sum over levels of (number of windows partially filled to it) squared. The numbers
stand in a level array, and each level keeps its open windows.

A document is placed whole, in an open window or a new one. As sizes are told apart by level, few windows stay open: about
550 after 10,000 documents. Only where sizes never fit each other could they be as many as documents, so `SPACE` bounds them: beyond
it a document that fits into no open window is cut to fill one, the level chosen by the same sum of squares (a forced cut).

Windows that are open at the end of a partition stay as they are: nothing is placed again. One that lacks `PADDING` tokens
at most is padded; any other is cut into powers of two, which need no padding.

Open windows hold their token ids (at most `SPACE` times `WINDOW`). A partition is packed on its own, so memory doesn't
grow with the input and a lost task is repeated alone; sequence ids hold the partition's number in their upper bits.

Null texts count as empty: such a document has the closing id only. A text longer than a window gives whole windows and
a rest; it is encoded in one task. Ties between levels go to the fullest. Repeated rows and null ids are packed like any
other row. An empty table gives no rows. Columns beside id and text are not read.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched, compress, pairwise
from operator import not_

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, ship
from .byte_ids import counted, joined, numbered

WINDOW, CLOSING = 2048, 1
#: Open windows of a partition (64 MB of ids at most), and tokens that a padded window may lack.
SPACE, PADDING = 8192, 64
#: Chunks of text and words whose ids a worker remembers, and the longest such chunk in bytes.
REMEMBERED, WORDS, LONGEST = 700_000, 1_200_000, 64
#: Punctuation that may follow a word. An apostrophe isn't: it may begin a contraction.
TAIL = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Ids:
    """Token ids of texts as little-endian 32-bit bytes. The tokenizer drops white space and never joins over it, so the
    ids of a text are those of its chunks between ASCII blanks, most of which have been seen before. Nor does it join
    letters with the punctuation after them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}

    def _apart(self, chunks: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in codes]

    def _learn(self, words: list[bytes]) -> None:
        """Words of letters: many are encoded as one text and cut where a word ends."""
        for some in batched(words, 4096):
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) == len(some):
                data = ids.tobytes()
                self.words.update(zip(some, (data[i:j] for i, j in zip([0, *cuts.tolist()], cuts.tolist())), strict=True))
            else:  # a letter that its normal form splits
                self.words.update(zip(some, self._apart([w.decode() for w in some]), strict=True))

    def _encoded(self, chunks: pa.StringArray) -> dict[bytes, bytes]:
        if len(self.words) > WORDS:
            self.words.clear()
        names = chunks.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        cut = pc.ascii_rtrim(chunks, TAIL.decode())
        letters = pc.ascii_is_alpha(cut).to_numpy(zero_copy_only=False).tolist()  # ASCII letters, at least one
        lower = pc.ascii_lower(cut).cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        plain, words = list(compress(names, letters)), list(compress(lower, letters))
        odd = []
        for c in compress(names, map(not_, letters)):
            word = c.rstrip(TAIL)
            if not word.isascii() and unicodedata.normalize("NFC", word.decode()).lower().isalpha():
                plain.append(c)
                words.append(word)
            else:  # also where a mark comes off a letter, which may join the punctuation
                odd.append(c)
        self._learn(list(set(words).difference(self.words)))
        known = self.words
        out = {c: known[w] if len(c) == len(w) else known[w] + self._tail(c[len(w) :]) for c, w in zip(plain, words, strict=True)}
        for some in batched(odd, 4096):
            out.update(zip(some, self._apart([c.decode() for c in some]), strict=True))
        return out

    def _tail(self, tail: bytes) -> bytes:
        ids = self.tails.get(tail)
        if ids is None:
            ids = self._apart([tail.decode()])[0]
            if len(tail) <= LONGEST and len(self.tails) < REMEMBERED:
                self.tails[tail] = ids
        return ids

    def __call__(self, texts: pa.StringArray) -> Iterator[bytes]:
        """The ids of each text. Chunks are told apart and numbered by Arrow, so that each is looked up once a batch."""
        if not len(texts):
            return
        if len(self.known) > REMEMBERED:
            self.known.clear()
        names, code, borders = numbered(pc.ascii_split_whitespace(texts))
        chunks = names.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, chunks))
        learned = self._encoded(names.filter(pa.array([i is None and c != b"" for i, c in zip(ids, chunks, strict=True)], pa.bool_())))
        self.known.update(learned if max(map(len, learned), default=0) <= LONGEST else {c: i for c, i in learned.items() if len(c) <= LONGEST})
        ids = [learned.get(c, b"") if i is None else i for c, i in zip(chunks, ids, strict=True)]
        flat, at = joined(ids, counted(ids), code, borders)
        for i, j in pairwise(at.tolist()):
            yield flat[i:j]


_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One per worker process and vocabulary; it lives on for the worker's next tasks."""
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


@dataclass
class Piece:
    doc: object
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.doc_tokens), Piece(self.doc, self.start + n, self.ids[4 * n :], self.doc_tokens)


@dataclass
class Packer:
    """Packs pieces one after another; `done` collects sequences as lists of pieces. `placed` counts the windows that were
    filled as documents came, `forced` the cuts of documents that found no room, `closed` the sequences made at the end."""

    window: int = WINDOW
    space: int = SPACE
    done: list[list[Piece]] = field(default_factory=list)
    placed: int = 0
    forced: int = 0
    closed: int = 0

    def __post_init__(self) -> None:
        self.count = np.zeros(self.window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def add(self, doc: object, ids: bytes) -> None:
        rest = Piece(doc, 0, ids, len(ids) // 4)
        while len(rest) >= self.window:
            full, rest = rest.cut(self.window)
            self._finish([full])
        if len(rest):
            self._place(rest)

    def _level(self, n: int, may_open: bool = True) -> int:
        """The level whose choice leaves the least sum of squares; the fullest of equals; 0 opens a window. Without room
        for another window it is the level that the piece fits into, or else the level that it is cut to fill."""
        here = self.count[1 : self.window - n + 1]
        cost = 2 * (self.count[n + 1 : self.window + 1] - here) + 2
        cost[-1] = 1 - 2 * here[-1]  # a window that gets full leaves the array
        cost = np.where(here > 0, cost, np.iinfo(np.int64).max)
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))
        if may_open:
            return best + 1 if cost[best] <= 2 * self.count[n] + 1 else 0
        if here[best]:
            return best + 1
        # a cut takes one window off its level, so the highest count falls most; of equals the emptiest takes most of the piece
        return int(np.argmax(self.count[1:])) + 1

    def _place(self, piece: Piece) -> None:
        while len(piece):
            n = len(piece)
            level = self._level(n, self.n_open < self.space)
            self.forced += level + n > self.window
            held, rest = [], piece.cut(n)[1]
            if level:
                held = self._taken(level)
                piece, rest = piece.cut(min(n, self.window - level))
            held.append(piece)
            filled = level + len(piece)
            if filled == self.window:
                self._finish(held)
            else:
                self.open.setdefault(filled, []).append(held)
                self.count[filled] += 1
                self.n_open += 1
            piece = rest

    def _taken(self, level: int) -> list[Piece]:
        self.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _finish(self, held: list[Piece]) -> None:
        self.done.append(held)
        self.placed += 1

    def close(self) -> None:
        """Give up the open windows, the fullest first: pad them, or cut each into powers of two."""
        for level in np.flatnonzero(self.count)[::-1].tolist():
            while self.count[level]:
                rest = self._taken(level)
                if self.window - level <= PADDING:
                    self._close([rest])
                    continue
                parts, left = [], level
                while left:
                    room = 1 << (left.bit_length() - 1)
                    left -= room
                    parts.append([])
                    while room:
                        piece = rest.pop(0)
                        if len(piece) > room:
                            piece, more = piece.cut(room)
                            rest.insert(0, more)
                        parts[-1].append(piece)
                        room -= len(piece)
                self._close(parts)

    def _close(self, parts: list[list[Piece]]) -> None:
        self.done += parts
        self.closed += len(parts)


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. `tokenizer` is a file path."""
    bound_batches(docs.sparkSession, 256)
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = ids_of(tokenizer), Packer(window)
        closing, number = np.array([CLOSING], "<u4").tobytes(), TaskContext.get().partitionId() << 33

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal number
            out = []
            for held in packer.done:
                at = 0
                for p in held:
                    out.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, number, at))
                    at += len(p)
                number += 1
            packer.done.clear()
            if out:
                names = [f"`{id_col}` {kind}", *SCHEMA.split(", ")]
                columns = list(zip(*out, strict=True))
                types = [id_type, *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[n.split(" ")[0].strip("`") for n in names])

        id_type = pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                packer.add(doc, ids + closing)
            yield from rows()
        packer.close()
        yield from rows()

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return rows.mapInArrow(of, f"`{id_col}` {kind}, {SCHEMA}")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), id_col, text_col)
