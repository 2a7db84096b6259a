"""Cutting texts into chunks whose encodings join to the encoding of the whole text.

The published split pattern never puts a boundary elsewhere than before a
single space, or around a single line end, that stands between two non-blank
characters, if only such are looked at; so a text is cut there, and what a chunk
encodes to can be remembered for all texts.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from foliant.llm.common import keep_in_worker
from foliant.llm.shingles import mixed, powers

# Fixed value: the split pattern for which chunks() holds; texts for other patterns are not cut.
PUBLISHED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SIGNS = ".,!?;:"
_GROUP = 1 << 20
_UNSAFE = re.compile(r"\s\s|\A\s|\s\Z")


def chunks(text: str) -> list[str]:
    """Parts that give the text; a new piece starts at each of them. Before each but the first and those that begin with a line end stands a space."""
    if not _UNSAFE.search(text):
        return text.replace("\n", " \n").split(" ")
    parts = text.split(" ")
    out: list[list[str]] = [[parts[0]]]
    for p in parts[1:]:
        before = out[-1][-1]
        if p and before and not p[0].isspace() and not before[-1].isspace():
            out.append([p])
        else:
            out[-1].append(p)
    return [" ".join(x) if len(x) > 1 else x[0] for x in out]


def pattern(published: str):
    """The split pattern for the regex module, with the blanks of the Unicode property, as other regex engines have them."""
    import regex

    return regex.compile(published.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Remembered(dict):
    """Encodings by chunk. Forgets all when full, and doesn't keep long chunks, so that its size is bounded."""

    def __init__(self, encode, most: int = 300_000, longest: int = 48):
        super().__init__()
        self.encode, self.most, self.longest = encode, most, longest

    def __missing__(self, chunk):
        got = self.encode(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = got
        return got


class WordTable:
    """Numbers of words by a 64-bit key and a second mark (length, last bytes and what stands before); open addressing, whole arrays at a time."""

    def __init__(self, bits: int = 21):
        self.shift, self.mask, self.n = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys, self.marks = (np.zeros(1 << bits, dtype=np.uint64) for _ in range(2))
        self.number = np.zeros(1 << bits, dtype=np.int32)

    def find(self, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Numbers, -1 for words that aren't there. Keys are not 0."""
        slot = (keys >> self.shift).astype(np.int64)
        got = self.keys[slot]
        out = np.where((got == keys) & (self.marks[slot] == marks), self.number[slot], -1)
        rest = np.flatnonzero((out < 0) & (got != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            at = slot[rest]
            got = self.keys[at]
            hit = (got == keys[rest]) & (self.marks[at] == marks[rest])
            out[rest[hit]] = self.number[at[hit]]
            rest = rest[~hit & (got != 0)]
        return out

    def add(self, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Give numbers, in order, to words that are not there and differ."""
        numbers = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        slot, rest = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(rest):
            at = slot[rest]
            free = self.keys[at] == 0
            mine = rest[free]
            self.number[slot[mine]] = numbers[mine]  # of several for one slot the last stays
            won = mine[self.number[slot[mine]] == numbers[mine]]
            self.keys[slot[won]], self.marks[slot[won]] = keys[won], marks[won]
            lost = np.ones(len(keys), dtype=bool)
            lost[won] = False
            rest = rest[lost[rest]]
            slot[rest] = (slot[rest] + 1) & self.mask
        return numbers


class LibraryEncoder:
    """Token ids by the tokenizers library; a word seen before is not encoded again.

    Texts are cut into words by whole arrays of bytes; words are numbered, and
    their ids lie one behind the other in one array. Words are found by a key
    and compared byte by byte; texts with a word whose key another one has go to
    the library whole, like those with blanks beside each other or at an end, or
    with rarer blanks.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already; idle threads of the library would only spin
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # one character for each byte in this alphabet
        self.most = most
        self.byte = mixed(np.arange(1, 257, dtype=np.uint64))
        self.odd, self.sign, self.alnum = (np.zeros(256, dtype=bool) for _ in range(3))
        self.odd[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True  # other blanks, or what begins their bytes
        self.sign[list(SIGNS.encode())] = True
        self.alnum[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        self.sign_number = np.zeros(256, dtype=np.int64)
        self._start_over()

    def _start_over(self) -> None:
        self.table = WordTable()
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.start, self.size, self.word = (np.zeros(1 << 16, dtype=np.int64) for _ in range(3))
        self.bytes = np.zeros(1 << 18, dtype=np.uint8)  # of the words one behind the other; word: where each begins
        self.filled, self.bytes_filled = 0, 0
        for c in SIGNS:  # signs are the first entries, without keys
            self.sign_number[ord(c)] = self.table.n
            got = self.whole([c])[0]
            self._store(got, np.array([len(got)]), [b""], self.table.n)
            self.table.n += 1

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray, sizes: np.ndarray, words: list[bytes], n: int) -> None:
        k, body, lengths = len(sizes), np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
        for name, more in (("start", n + k), ("size", n + k), ("word", n + k), ("ids", self.filled + len(ids)), ("bytes", self.bytes_filled + len(body))):
            if more > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate((old, np.zeros(max(more, 2 * len(old)) - len(old), old.dtype))))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.bytes[self.bytes_filled : self.bytes_filled + len(body)] = body
        self.size[n : n + k] = sizes
        self.start[n : n + k] = self.filled + np.cumsum(sizes) - sizes
        self.word[n : n + k] = self.bytes_filled + np.cumsum(lengths) - lengths
        self.filled += len(ids)
        self.bytes_filled += len(body)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        size = self.size[at]
        end = np.cumsum(size)
        return self.ids[np.repeat(self.start[at] - end + size, size) + np.arange(end[-1] if len(end) else 0)]

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words that each begin with a space or line end and hold no other: encoded as one text, which is cut where their bytes begin."""
        text = "".join(words).encode()
        ids = self.whole([text.decode()])[0]
        raw = np.frombuffer(text, dtype=np.uint8)
        begins = np.flatnonzero((raw == 32) | (raw == 10))
        cut = np.searchsorted(np.cumsum(self.width[ids]) - self.width[ids], begins)
        return ids, np.diff(np.append(cut, len(ids)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids end)."""
        raws, out, i = [t.encode() for t in texts], [], 0
        while i < len(raws):  # groups of about 1 MB
            j, size = i, 0
            while j < len(raws) and (j == i or size + len(raws[j]) < _GROUP):
                size += len(raws[j]) + 1
                j += 1
            out += self._group(texts[i:j], raws[i:j])
            i = j
        ends = np.cumsum([len(x) for x in out]) if out else np.zeros(0, np.int64)
        return np.concatenate(out) if out else np.zeros(0, "<u4"), ends

    def _group(self, texts: list[str], raws: list[bytes]) -> list[np.ndarray]:
        raw = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
        if len(raw) > 2 * _GROUP:
            return self.whole(texts)
        ends = np.cumsum([len(r) + 1 for r in raws])
        blank = np.flatnonzero((raw == 32) | (raw == 10))
        beside = blank[1:][np.diff(blank) == 1]
        wrong = np.concatenate((np.flatnonzero(self.odd[raw]), beside, blank[:1][blank[:1] == 0]))
        if len(wrong):  # a blank at a text's end stands beside the one that was put between texts; that of the next text's beginning belongs to both
            bad = np.zeros(len(texts), dtype=bool)
            bad[np.searchsorted(ends, wrong, side="right")] = True
            bad[np.searchsorted(ends, np.maximum(beside - 1, 0), side="right")] = True
            fine = np.flatnonzero(~bad).tolist()
            got = dict(zip(np.flatnonzero(bad).tolist(), self.whole([texts[k] for k in np.flatnonzero(bad)])))
            if fine:
                got |= zip(fine, self._group([texts[k] for k in fine], [raws[k] for k in fine]))
            return [got[k] for k in range(len(texts))]
        out, wrong = self._plain(raw, blank, ends)
        for k, ids in zip(wrong, self.whole([texts[k] for k in wrong])):
            out[k] = ids
        return out

    def _plain(self, raw: np.ndarray, blank: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        """(ids of each text, the texts for which they don't count, as one of their words isn't the one stored by its key)."""
        start, end = np.concatenate(([0], blank[:-1] + 1)), blank
        last = np.searchsorted(end, ends - 1)  # each text's last word
        first = np.concatenate(([0], last[:-1] + 1))
        before = raw[start - 1].astype(np.uint64)  # a space or line end; at a text's start neither counts
        before[first] = 0
        signed = self.sign[raw[end - 1]] & (end - start > 1) & self.alnum[raw[end - 2]]
        stop = end - signed
        up, down = powers()
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.byte[raw] * up[: len(raw)], dtype=np.uint64)))
        length = (stop - start).astype(np.uint64)
        keys = mixed((sums[stop] - sums[start]) * down[start] + (length << np.uint64(8) | before)) | np.uint64(1)
        marks = length << np.uint64(32) | before
        for k in range(1, 4):
            marks |= raw[stop - np.minimum(k, stop - start)].astype(np.uint64) << np.uint64(8 * k)
        if self.table.n > self.most:
            self._start_over()
        at = self.table.find(keys, marks).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            _, once = np.unique(keys[missing], return_index=True)
            self._learn(raw, start, stop, before, keys, marks, missing[once])
            at[missing] = self.table.find(keys[missing], marks[missing])
        unlike = at < 0
        at[unlike] = 0
        inside = np.ones(len(raw), dtype=bool)
        inside[blank] = False
        inside[stop[signed]] = False
        size = stop - start
        size[unlike] = 0
        for k in np.flatnonzero(unlike).tolist():
            inside[start[k] : stop[k]] = False
        until = np.cumsum(size)
        stored = np.repeat((self.word[at] - until + size).astype(np.int32), size) + np.arange(until[-1], dtype=np.int32)
        other = np.flatnonzero(self.bytes[stored] != raw[inside])
        unlike[np.searchsorted(until, other, side="right")] = True
        wrong = np.unique(np.searchsorted(last, np.flatnonzero(unlike))).tolist()
        shift = np.cumsum(signed)
        items = np.empty(len(at) + int(shift[-1]), dtype=np.int64)
        items[np.arange(len(at)) + shift - signed] = at
        behind = np.flatnonzero(signed)
        items[behind + shift[behind]] = self.sign_number[raw[end[behind] - 1]]
        total = np.concatenate(([0], np.cumsum(self.size[items])))
        return np.split(self._gather(items), total[(last + shift[last] + 1)[:-1]]), wrong

    def _learn(self, raw, start, stop, before, keys, marks, new: np.ndarray) -> None:
        body = raw.tobytes()
        kind = before[new]
        for which, head in ((32, " "), (10, "\n"), (0, "")):
            some = new[kind == which]
            plain = [body[i:j] for i, j in zip(start[some].tolist(), stop[some].tolist())]
            words = [head + w.decode() for w in plain]
            if not words:
                continue
            if head:
                ids, sizes = self._encoded(words)
            else:
                got = self.whole(words)
                ids, sizes = np.concatenate(got), np.array([len(g) for g in got])
            n = self.table.n
            self.table.add(keys[some], marks[some])
            self._store(ids, sizes, plain, n)


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    keep_in_worker("library", library_encoder.cache_clear)
    return LibraryEncoder(path)
