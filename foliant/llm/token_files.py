"""Token ids in files of 64-bit words (Simple-8b), for training jobs to read.

A word has a selector in its upper four bits, and 60 bits that hold a number of
ids of equal width. Selector 0 is the escape: the next word is one id as it is.
Ids are packed in blocks of BLOCK ids, each from a word of its own; the file
lists where each block begins, so any block can be read and decoded alone, by
whole arrays at a time.

A file holds documents in ascending doc_id: a header of 9 unsigned 64-bit
little-endian integers (magic, documents, ids, blocks, words, ids before the
file in its part, part, number in the part, ids a block), then doc_id (int64),
1 for each null doc_id (uint8, padded to 8), each document's end in ids
(uint64), each block's first word and the number of words (uint64), the words.

Defined cases: a null text counts as empty and gives the end id alone; null
doc_ids come first; repeated doc_ids are ordered by their text's hash, so equal
rows give equal results in either order; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, bounded_batches, fresh_path, open_fs, partitions_for, stage, write_whole
from foliant.llm.pieces import library_encoder

MAGIC = int.from_bytes(b"FOLS8B01", "little")
BLOCK = 4096
#: Ids a word, by selector; 0 is the escape.
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = tuple(60 // n if n else 64 for n in COUNTS)
_ESCAPED = np.uint64(1) << np.uint64(60)


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    where = np.arange(n, dtype=np.int64)
    left = np.minimum((where // block + 1) * block, n) - where
    best = np.ones(n, dtype=np.int64)
    fits = None  # where the ids were narrow enough so far; narrower widths can only fit there
    for count, bits in sorted(zip(COUNTS[1:], BITS[1:]))[1:]:
        limit = np.uint64(1 << bits)
        if fits is None and n and ids.max() < limit:
            best[left >= count] = count
            continue
        if fits is None or len(fits) * count > 4 * n:
            seen = np.concatenate(([0], np.cumsum(ids >= limit, dtype=np.int32)))
            fits = np.flatnonzero(seen[count:] == seen[:-count])
        else:
            fits = fits[fits <= n - count]
            for k in range(count):
                fits = fits[ids[fits + k] < limit]
        fits = fits[left[fits] >= count]
        best[fits] = count
    steps, starts, i = best.tolist(), [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    at = np.array(starts, dtype=np.int64)
    size = best[at]
    escaped = (size == 1) & (ids[at] >= _ESCAPED) if n else np.zeros(0, bool)
    place = np.arange(len(at)) + np.concatenate(([0], np.cumsum(escaped)))[:-1].astype(np.int64) if n else at
    words = np.zeros(len(at) + int(escaped.sum()), dtype=np.uint64)
    for selector in range(1, len(COUNTS)):
        count, bits = COUNTS[selector], BITS[selector]
        mine = np.flatnonzero((size == count) & ~escaped)
        word = np.full(len(mine), selector << 60, dtype=np.uint64)
        for k in range(count if len(mine) else 0):
            word |= ids[at[mine] + k] << np.uint64(k * bits)
        words[place[mine]] = word
    words[place[escaped] + 1] = ids[at[escaped]]
    first = place[np.searchsorted(at, np.arange(0, n, block))] if n else place
    return words, first.astype(np.uint64)


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of words that begin at a block's first word."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    plain = np.ones(len(words), dtype=bool)
    for i in np.flatnonzero(selector == 0).tolist():  # escapes are rare; a literal word may look like an escape itself
        if plain[i]:
            plain[i + 1] = False
    escapes = np.flatnonzero(plain & (selector == 0))
    size = np.where(plain, np.array(COUNTS + (0,))[selector], 0)
    size[escapes] = 1
    start = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(start[-1], dtype=np.uint64)
    for s in range(1, len(COUNTS)):
        mine = np.flatnonzero(plain & (selector == s))
        mask = np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s] if len(mine) else 0):
            out[start[mine] + k] = (words[mine] >> np.uint64(k * BITS[s])) & mask
    out[start[escapes]] = words[escapes + 1]
    return out


class ShardWriter:
    """Collects documents of one part, and writes a file for each so many ids."""

    def __init__(self, uri: str, part: int, most: int):
        self.uri, self.part, self.most, self.before, self.number = uri, part, most, 0, 0
        self._empty()

    def _empty(self) -> None:
        self.doc_ids, self.ends, self.words, self.first, self.pending = [], [], [], [], []
        self.ids = self.waiting = self.n_words = 0

    def _pack(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, whole, 64 * BLOCK):
            words, first = pack(ids[i : min(whole, i + 64 * BLOCK)])
            self.words.append(words.astype("<u8").tobytes())
            self.first.append(first + np.uint64(self.n_words))
            self.n_words += len(words)
        self.pending, self.waiting = [ids[whole:]], len(ids) - whole

    def add(self, doc_id: int | None, ids: np.ndarray) -> dict | None:
        self.doc_ids.append(doc_id)
        self.ids += len(ids)
        self.ends.append(self.ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * BLOCK:
            self._pack(False)
        return self.flush() if self.ids >= self.most else None

    def flush(self) -> dict | None:
        if not self.doc_ids:
            return None
        self._pack(True)
        n, null = len(self.doc_ids), bytes(x is None for x in self.doc_ids)
        first = np.concatenate([*self.first, [np.uint64(self.n_words)]]).astype("<u8")
        header = np.array([MAGIC, n, self.ids, len(first) - 1, self.n_words, self.before, self.part, self.number, BLOCK], dtype="<u8")
        name = f"part-{self.part:06d}-{self.number:05d}.s8b"
        write_whole(self.uri, name, [header.tobytes(), np.array([x or 0 for x in self.doc_ids], dtype="<i8").tobytes(), null + bytes(-n % 8), np.array(self.ends, dtype="<u8").tobytes(), first.tobytes(), *self.words])
        row = {"part": self.part, "number": self.number, "name": name, "n_docs": n, "n_ids": self.ids, "n_words": self.n_words}
        self.before, self.number = self.before + self.ids, self.number + 1
        self._empty()
        return row


MANIFEST = "part int, number int, name string, n_docs long, n_ids long, n_words long"


def write_documents(docs: DataFrame, tokenizer: str, end_id: int, uri: str, text: str = "text", doc_id: str = "doc_id", most: int = 4_000_000) -> DataFrame:
    """Encode, append end_id to each document, and write files below uri in ascending doc_id. Returns the manifest (MANIFEST), already written.

    Documents are dealt to range partitions by doc_id and a hash of the text, so
    that many rows of one doc_id don't meet in one task, and sorted there by
    Spark, which spills; a task holds the ids of one unfinished file, most ids, at
    once. The number of partitions follows the bytes that docs reads.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("place", F.xxhash64("text"))
    placed = rows.repartitionByRange(partitions_for(docs), "doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")

    def work(batches):
        from pyspark import TaskContext

        encoder, writer = library_encoder(tokenizer), ShardWriter(uri, TaskContext.get().partitionId(), most)
        for batch in batches:
            out = []
            if not batch.num_rows:
                continue
            ids, ends = encoder.encode(batch.column("text").to_pylist())
            ids, ends = np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)
            begin = 0
            for i, end in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                out.append(writer.add(i, ids[begin:end]))
                begin = end
            if done := [x for x in out if x]:
                yield {k: [x[k] for x in done] for k in done[0]}
        if x := writer.flush():
            yield {k: [v] for k, v in x.items()}

    return stage(arrow_map(placed, work, MANIFEST, keeps="library"), "token-manifest")


def read_file(uri: str, name: str):
    """(header, doc_ids with None for null, ends, iterator over arrays of ids, block by block group)."""
    system, folder = open_fs(uri)
    with system.open_input_file(f"{folder}/{name}") as f:
        header = np.frombuffer(f.read(72), dtype="<u8").astype(np.int64)
        if int(header[0]) != MAGIC:
            raise ValueError(f"{name} is no file of this format")
        n, blocks = int(header[1]), int(header[3])
        doc_ids = np.frombuffer(f.read(8 * n), dtype="<i8").tolist()
        null = f.read(n + -n % 8)[:n]
        ends = np.frombuffer(f.read(8 * n), dtype="<u8").astype(np.int64)
        first = np.frombuffer(f.read(8 * (blocks + 1)), dtype="<u8").astype(np.int64)
        base = f.tell()
        ids = []
        for b in range(0, blocks, 64):
            lo, hi = int(first[b]), int(first[min(blocks, b + 64)])
            f.seek(base + 8 * lo)
            ids.append(unpack(np.frombuffer(f.read(8 * (hi - lo)), dtype="<u8")).astype("<u4"))
    return header, [None if x else d for d, x in zip(doc_ids, null)], ends, ids


def read_documents(manifest: DataFrame, uri: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files; with ids also token_ids."""
    per_part = {r["part"]: r["n"] for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a row a partition
    order = sorted(per_part)
    offset = dict(zip(order, accumulate([0, *(per_part[p] for p in order)])))

    def work(batches):
        for batch in batches:
            for name in batch.column("name").to_pylist():
                header, doc_ids, ends, got = read_file(uri, name)
                flat = np.concatenate(got) if got else np.zeros(0, "<u4")
                starts = np.concatenate(([0], ends[:-1]))
                each = [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                out = {"doc_id": doc_ids, "start": starts + int(header[5]) + offset[int(header[6])], "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(x.tobytes()) for x in each]}
                yield out | ({"token_ids": [x.astype(np.int64) for x in each]} if ids else {})

    spread = manifest.select("name").repartition(max(len(order), 1), "name")
    return arrow_map(spread, work, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * ids)


def token_file_documents(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents to fresh files in the shared folder, and read them back."""
    uri = fresh_path(docs.sparkSession, "tokens")
    return read_documents(write_documents(docs, tokenizer, end_id, uri), uri)
