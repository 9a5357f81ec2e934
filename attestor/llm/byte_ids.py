"""Token ids of whole texts for a byte-level BPE vocabulary file, with the ids of words remembered by each worker."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import batched, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks and words a worker remembers, and the longest such chunk in characters.
REMEMBERED, WORDS, LONGEST = 700_000, 1_200_000, 64
#: Punctuation that may follow a word. An apostrophe isn't: it may begin a contraction.
TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Characters that may not be letters in every version of Unicode.
_NEW = "[^\\x{0}-\\x{4ff}]"
#: Stands for the ids of a chunk that begins or ends with white space, which the tokenizer may take together with what is beside it.
JOINED = b""


def numbered(split: pa.ListArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(distinct chunks, the number of each chunk, where the chunks of each text begin and end)."""
    coded = split.values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()


def counted(ids: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def joined(ids: list[bytes], n_ids: np.ndarray, code: np.ndarray, borders: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids of all chunks one after another, and at which byte those of each text begin and end."""
    first = np.concatenate(([0], np.cumsum(n_ids)))[:-1]
    n = n_ids[code]
    ends = np.concatenate(([0], np.cumsum(n)))
    flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])] if ends[-1] else np.empty(0, "<u4")
    return flat.tobytes(), 4 * ends[borders]


class ByteIds:
    """Ids as little-endian 32-bit bytes. Where every run of white space is a single character, a text is chunks that begin
    with a line end or a blank (which is left out of their names), and the tokenizer never joins over their borders; most
    chunks have been seen before. Nor does it join a word with the punctuation after it. Other texts, and those that name a
    special token, are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        blank = "Ġ"  # how the vocabulary spells a blank
        self.line = vocabulary["Ċ"]
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith(blank)]] = True
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _apart(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Words of letters: many are encoded as one text and cut where they begin."""
        lines = [w for w in words if w[0] == "\n"]
        for own, first in ((lines, ""), (list(set(words).difference(lines)), " ")):
            for some in batched(own, 4096):
                ids = np.array(self.tokenizer.encode_batch_fast([first + first.join(some)], add_special_tokens=False)[0].ids, "<u4")
                cuts = 4 * np.flatnonzero(self.begins[ids] if first else ids == self.line)
                if len(cuts) == len(some) and not cuts[0]:
                    data, cuts = ids.tobytes(), cuts.tolist()
                    self.words.update(zip(some, (data[i:j] for i, j in zip(cuts, [*cuts[1:], len(data)], strict=True)), strict=True))
                else:
                    self.words.update(zip(some, self._apart([first + w for w in some]), strict=True))

    def _tail(self, tail: str) -> bytes:
        ids = self.tails.get(tail)
        if ids is None:
            ids = self._apart([tail])[0]
            if len(tail) <= LONGEST and len(self.tails) < REMEMBERED:
                self.tails[tail] = ids
        return ids

    def _encoded(self, chunks: pa.StringArray) -> dict[str, bytes]:
        if len(self.words) > WORDS:
            self.words.clear()
        names = chunks.to_numpy(zero_copy_only=False).tolist()
        cut = pc.utf8_rtrim(chunks, TAIL)
        letters = pc.utf8_is_alpha(pc.utf8_ltrim(cut, "\n"))  # at least one
        letters = pc.and_(pc.and_(letters, pc.less_equal(pc.utf8_length(cut), LONGEST)), pc.invert(pc.match_substring_regex(cut, _NEW))).to_numpy(zero_copy_only=False)
        same = pc.equal(pc.binary_length(cut), pc.binary_length(chunks)).to_numpy(zero_copy_only=False)
        whole = list(compress(names, (letters & same).tolist()))
        tailed = (letters & ~same).tolist()
        plain, words = list(compress(names, tailed)), cut.filter(pa.array(tailed, pa.bool_())).to_numpy(zero_copy_only=False).tolist()
        odd, out = [], {}
        for c in compress(names, (~letters).tolist()):
            if c[-1].isspace() or c[c[0] == "\n"].isspace():
                out[c] = JOINED
            else:
                odd.append(c)
        known = self.words
        self._learn([w for w in {*whole, *words} if w not in known])
        out.update(zip(whole, map(known.__getitem__, whole), strict=True))
        out.update((c, known[w] + self._tail(c[len(w) :])) for c, w in zip(plain, words, strict=True))
        for some in batched(odd, 4096):
            out.update(zip(some, self._apart([c if c[0] == "\n" else " " + c for c in some]), strict=True))
        return out

    def __call__(self, texts: list[str] | pa.StringArray) -> Iterator[bytes]:
        """The ids of each text. Chunks are told apart and numbered by Arrow, so that each is looked up once a batch."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return
        if not self.known or len(self.known) > REMEMBERED:
            # nothing between two blanks, or a line end by itself: a longer run of white space
            self.known = {"": JOINED, "\n": JOINED}
        split = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        names, code, borders = numbered(split)
        chunks = names.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, chunks))
        new = [i is None for i in ids]
        learned = self._encoded(names.filter(pa.array(new, pa.bool_())))
        self.known.update(learned if max(map(len, learned), default=0) <= LONGEST else {c: i for c, i in learned.items() if len(c) <= LONGEST})
        for i in np.flatnonzero(new).tolist():
            ids[i] = learned[chunks[i]]
        n_ids = counted(ids)
        whole = np.add.reduceat((n_ids == 0)[code], borders[:-1]) == 0  # texts without a chunk that has no ids; each text has a chunk
        for s in self.special:
            whole &= ~pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        flat, at = joined(ids, n_ids, code, borders)
        for k, (i, j, known) in enumerate(zip(at.tolist(), at[1:].tolist(), whole.tolist(), strict=False)):
            if known:  # without the line end that was put before the text
                yield flat[i + 4 : j]
            else:
                yield self._apart([text])[0] if (text := texts[k].as_py()) else b""


_ids: dict[str, ByteIds] = {}


def byte_ids_of(path: str) -> ByteIds:
    """One per worker process and vocabulary; it lives on for the worker's next tasks."""
    if path not in _ids:
        _ids[path] = ByteIds(path)
    return _ids[path]
