"""Byte-level BPE by dynamic programming over prefixes.

For every byte prefix there is exactly one token with which its encoding ends,
so one number for each prefix holds the encodings of all of them: appended
bytes only add numbers, and after an edit only numbers behind it change.
A token may follow another one exactly if merging their joined bytes gives
back those two tokens, which their edges decide: ranks grow with each merge.

Defined cases: a null text counts as empty; an empty text has no ids, and the
digests of no bytes; rows are independent, so repeated rows give repeated
results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from foliant.llm.common import arrow_map, bounded_batches, keep_in_worker
from foliant.llm.pieces import PUBLISHED, SIGNS, Remembered, chunks, pattern


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PrefixEncoder:
    """Encodes one piece (a match of the split pattern) at a time, as repeated lowest-rank merging would."""

    def __init__(self, ranks: dict[bytes, int], most: int = 300_000):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.usable, self.halves = {}, {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.usable[token] = rank
            elif b"".join(halves := self.parts(token, 2)) == token and len(halves) == 2:
                self.usable[token], self.halves[token] = rank, halves
        self.right = {r: self._spine(t, 1) for t, r in self.usable.items()}
        self.left = {r: self._spine(t, 0) for t, r in self.usable.items()}
        self.follows: dict[int, bool] = {}
        self.known: dict[bytes, int] = {}
        self.most = most

    def parts(self, piece: bytes, least: int = 1) -> list[bytes]:
        """Plain repeated merging of the leftmost adjacent pair of lowest rank, until so many parts are left or none can merge."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            joined = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            if (best := min(joined)) == 1 << 60:
                break
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def merged(self, piece: bytes) -> list[int]:
        return [self.ranks[p] for p in self.parts(piece)]

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """What stands at a token's edge while it is being merged: (bytes, rank at which it forms, rank at which it is merged on)."""
        out, until = [], 1 << 60
        while True:
            rank = self.ranks[token]
            out.append((token, rank if len(token) > 1 else -1, until))
            if len(token) == 1:
                return out
            token, until = self.halves[token][side], rank

    def _pair(self, a: int, b: int) -> bool:
        """Whether the boundary between two tokens survives: no merge across it comes before those that end both edges."""
        if len(self.follows) >= 2 * self.most:
            self.follows.clear()
        get, ok = self.ranks.get, True
        for x, from_x, until_x in self.right[a]:
            for y, from_y, until_y in self.left[b]:
                if from_x < until_y and from_y < until_x:
                    across = get(x + y)
                    if across is not None and across < until_x and across <= until_y:
                        ok = False
        self.follows[a << 20 | b] = ok
        return ok

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """last[i]: the token with which the encoding of piece[:i] ends; goes on from what last holds. last[0] is -1."""
        get, known, follows, longest = self.usable.get, self.known, self.follows.get, self.longest
        for i in range(len(last), len(piece) + 1):
            if i <= 32 and (t := known.get(piece[:i])) is not None:
                last.append(t)
                continue
            for j in range(i - 1, i - longest - 1 if i > longest else -1, -1):
                if (t := get(piece[j:i])) is None:
                    continue
                if not j:
                    break
                if (ok := follows(last[j] << 20 | t)) is None:
                    ok = self._pair(last[j], t)
                if ok:
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte of the text")
            last.append(t)
            if i <= 32:
                if len(known) >= self.most:
                    known.clear()
                known[piece[:i]] = t
        return last

    def tokens_of(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= len(self.tokens[last[i]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if (t := self.ranks.get(piece)) is not None:  # a piece that is a token is that token
            return [t]
        return self.tokens_of(self.extend(piece, [-1])) if piece else []


class EditablePiece:
    """A piece with the last tokens of its prefixes; appending and editing redo only what lies behind the change."""

    def __init__(self, encoder: PrefixEncoder, piece: bytes = b""):
        self.encoder, self.piece = encoder, piece
        self.last = encoder.extend(piece, [-1])

    def append(self, more: bytes) -> None:
        self.piece += more
        self.encoder.extend(self.piece, self.last)

    def replace(self, start: int, end: int, by: bytes) -> None:
        self.piece = self.piece[:start] + by + self.piece[end:]
        del self.last[start + 1 :]
        self.encoder.extend(self.piece, self.last)

    def ids(self) -> list[int]:
        if self.piece in self.encoder.ranks:
            return [self.encoder.ranks[self.piece]]
        return self.encoder.tokens_of(self.last)


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class TextEncoder:
    """Whole texts: pieces by the published pattern, each encoded separately; chunks between plain spaces are remembered. Texts for another pattern than the published one are given to it whole."""

    def __init__(self, path: str, published: str):
        self.pieces = PrefixEncoder(read_ranks(path))
        self.split, self.known = pattern(published).findall, published == PUBLISHED
        self.pieces_of = pattern(published).finditer
        self.by_piece = Remembered(lambda p: pack_ids(self.pieces.encode(p.encode())), most=100_000)
        self.bare = Remembered(self._chunk, most=50_000)
        self.lead = Remembered(self._word, most=500_000)

    def _word(self, word: str) -> bytes:
        """A word behind a space (or beginning with a line end); letters alone, or with a sign behind them, need no search for pieces."""
        if word.isalpha():
            return pack_ids(self.pieces.encode(b" " + word.encode()))
        if word[-1:] in SIGNS and word[:-1].isalpha():
            return self.lead[word[:-1]] + self.by_piece[word[-1]]
        return self._chunk(word if word[:1] == "\n" else " " + word)

    def _chunk(self, chunk: str) -> bytes:
        parts = self.split(chunk)
        if len(parts) == 1:
            return pack_ids(self.pieces.encode(chunk.encode()))
        return b"".join([self.lead[p[1:]] if p[0] == " " and p[1:2] not in ("", "\n") else self.by_piece[p] for p in parts])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.known:
            return b"".join([self.by_piece[m.group()] for m in self.pieces_of(text) if m.group()])
        first, *rest = chunks(text)
        return b"".join([self.bare[first], *map(self.lead.__getitem__, rest)])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def text_encoder(path: str, published: str) -> TextEncoder:
    keep_in_worker("byte_bpe", text_encoder.cache_clear)
    return TextEncoder(path, published)


def encode_documents(docs: DataFrame, path: str, published: str, text: str = "text", doc_id: str = "doc_id", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip; with ids also the array token_ids.

    path: a file of ranks that every executor can read; published: its split pattern.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]

    def work(batches):
        encoder = text_encoder(path, published)
        for batch in batches:
            out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "token_ids")}
            for t in batch.column("text").to_pylist():
                raw = encoder.encode(t or "")
                back = encoder.decode(np.frombuffer(raw, dtype="<u4"))
                out["n_tokens"].append(len(raw) // 4)
                out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                out["round_trip"].append(back == (t or "").encode())
                if ids:
                    out["token_ids"].append(np.frombuffer(raw, dtype="<u4").astype(np.int32))
            yield out | {"doc_id": batch.column("doc_id")}

    from pyspark.sql import functions as F

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", token_ids array<int>" * ids
    return arrow_map(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), work, schema, keeps="byte_bpe")
