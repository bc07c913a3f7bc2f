"""Token ids of whole texts with a tokenizer file of the ``tokenizers`` library.

Encoding runs inside Arrow batches.  Neither supported kind of file joins characters
across a single blank or newline, so a text is cut there into units and the ids of
frequent units are remembered: the concatenated ids of the units equal the ids of the text
(``tests/llm/test_tokens.py`` compares both).  Nor does either kind join a letter and the
mark or digit after it, so a new unit of letters and a tail takes the ids of the two.
Where a file's tokens keep blanks, a text with other or repeated white space is encoded in
one piece.  The memo is bounded, only saves time and never changes an id.
"""

from __future__ import annotations

import itertools
import os
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_OTHER_SPACES = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
#: A unit of Latin-1 letters (letters by any Unicode version, and no normal form joins them
#: to ASCII) with a tail that begins with an ASCII mark or digit.
_TAILED = re.compile(r"([\r\n]?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-@\[-`{-~].*)", re.S)
MEMO_UNITS = 1_200_000
CHARS_AT_ONCE = 1 << 22

_ENCODERS: dict[tuple, "Encoder"] = {}


def default_path(name: str) -> str:
    """Path of a public tokenizer file installed on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def encoder(path: str, blanks: bool) -> "Encoder":
    """The worker's encoder of ``path`` (loaded once per Python worker)."""
    if (path, blanks) not in _ENCODERS:
        _ENCODERS[path, blanks] = Encoder(path, blanks)
    return _ENCODERS[path, blanks]


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as bytes.

    ``blanks``: whether the file's tokens keep blanks (byte-level files do; files with
    word ends drop them).
    """

    def __init__(self, path: str, blanks: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.blanks = blanks
        #: Number of a unit; a unit that follows one blank is named without it, the first
        #: unit of a text has a carriage return before its name.  Number 0 has no ids:
        #: what is left between blanks that stand together or at an end of the text.
        self.memo: dict[str, int] = dict.fromkeys(["", "\n", "\r"] if blanks else [""], 0)
        self.n_units = 1
        self.starts = np.zeros(2, np.int64)  # unit k has flat[starts[k]:starts[k + 1]]
        self.flat = np.empty(0, "<u4")
        if blanks:  # byte-level: a character of a token's name is a byte
            added = self.tokenizer.get_added_tokens_decoder()
            self.n_bytes = np.asarray([len(added[i].content.encode()) if i in added else len(self.tokenizer.id_to_token(i) or "")
                                       for i in range(self.tokenizer.get_vocab_size())], np.int64)

    def plain(self, text: str) -> bytes:
        """Ids of ``text`` encoded in one piece."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _remember(self, units: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Number new units; ``ids`` are those of all units in turn, ``counts`` how many each has."""
        first, begin = self.n_units, int(self.starts[self.n_units])
        self.n_units += len(units)
        if len(self.starts) <= self.n_units:
            self.starts = np.resize(self.starts, 2 * self.n_units + 1)
        if len(self.flat) < begin + len(ids):
            self.flat = np.resize(self.flat, 2 * (begin + len(ids)))
        self.starts[first + 1:self.n_units + 1] = begin + np.cumsum(counts)
        self.flat[begin:begin + len(ids)] = ids
        self.memo.update(zip(units, range(first, self.n_units)))

    def _joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered units in turn, and how many each has."""
        starts = self.starts[numbers]
        counts = self.starts[numbers + 1] - starts
        ends = np.cumsum(counts)
        return self.flat[np.arange(counts.sum()) + np.repeat(starts - ends + counts, counts)], counts

    def _each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units in turn, each encoded by itself, and how many each has."""
        spelt = [u[1:] if u[0] == "\r" else u if u[0] == "\n" else " " + u for u in units]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(spelt, add_special_tokens=False)]
        return np.asarray([i for ids in got for i in ids], "<u4"), np.asarray([len(ids) for ids in got], np.int64)

    def _in_one(self, units: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same from one call over all units side by side, told apart by the bytes of the ids.

        A unit without white space before it gets a newline, whose id is then dropped.  None
        if the bytes of the ids do not tell where the units are."""
        if not self.blanks or not units:
            return None
        spelt = [u if u[0] == "\n" else ("\n" + u[1:] if u[0] == "\r" else " " + u) for u in units]
        got = self.tokenizer.encode_batch_fast(["".join(spelt)], add_special_tokens=False)[0].ids
        ids = np.asarray(got, "<u4")
        ends = np.concatenate(([0], np.cumsum(self.n_bytes[ids])))
        bytes_to = np.cumsum([len(u.encode()) for u in spelt])
        if ends[-1] != bytes_to[-1]:
            return None
        alone = np.asarray([u[0] == "\r" for u in units])
        begins = np.concatenate(([0], bytes_to[:-1])) + alone
        first, last = np.searchsorted(ends, begins), np.searchsorted(ends, bytes_to)
        if last[-1] < len(ids) or (ends[first] != begins).any() or (ends[last] != bytes_to).any():
            return None
        return np.delete(ids, first[alone] - 1), last - first

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of new units; those with a tail take them from their parts."""
        memo, parts, tailed = self.memo, {}, {}
        for unit in new:
            if cut := _TAILED.fullmatch(unit):
                tailed[unit] = both = cut[1], "\r" + cut[2]
                parts.update(dict.fromkeys([p for p in both if p not in memo]))
            else:
                parts[unit] = None
        self._remember(list(parts), *(self._in_one(list(parts)) or self._each(list(parts))))
        ids, counts = self._joined(np.asarray([memo[p] for both in tailed.values() for p in both], np.int64))
        self._remember(list(tailed), ids, counts.reshape(-1, 2).sum(axis=1))

    def _forget(self) -> None:
        """Keep half of the units: frequent ones were met first, they stay."""
        for unit in list(self.memo)[MEMO_UNITS // 2 + 3:]:
            del self.memo[unit]
        self.n_units = next(reversed(self.memo.values())) + 1

    def _by_units(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without other white space than blanks and newlines, where the file keeps it."""
        spaced = ["\r" + t.replace("\n", " \n") if self.blanks else t.replace("\n", " ") for t in texts]
        units = pc.split_pattern(pa.array(spaced, pa.string()), " ")
        coded, edges = units.values.dictionary_encode(), units.offsets.to_numpy()
        listed = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        names = pc.binary_join(listed, " ")[0].as_py().split(" ")  # faster than a Python string at a time
        if len(self.memo) > MEMO_UNITS:
            self._forget()
        known = np.fromiter(map(self.memo.get, names, itertools.repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(known < 0).tolist()
        if new:
            self._learn([names[k] for k in new])
            known[new] = [self.memo[names[k]] for k in new]
        numbers = known[coded.indices.to_numpy()]
        ids, counts = self._joined(numbers)
        ends = np.concatenate(([0], np.cumsum(counts)))[edges] * 4
        ids = ids.tobytes()
        whole = np.zeros(len(texts), bool)  # blanks stand together or at an end: encoded in one piece
        if self.blanks:
            whole[np.searchsorted(edges, np.flatnonzero(numbers == 0), "right") - 1] = True
        return [self.plain(t) if one else ids[a:b] for t, one, a, b in zip(texts, whole.tolist(), ends.tolist(), ends[1:].tolist())]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null or empty: none)."""
        out, some, chars = [b""] * len(texts), [], 0
        for k, text in enumerate(texts):
            if text and self.blanks and any(c in text for c in _OTHER_SPACES):
                out[k] = self.plain(text)
            elif text:
                some.append(k)
                chars += len(text)
            if some and (chars >= CHARS_AT_ONCE or k == len(texts) - 1):
                for at, ids in zip(some, self._by_units([texts[i] for i in some])):
                    out[at] = ids
                some, chars = [], 0
        return out
