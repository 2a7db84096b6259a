"""WARC archives of pages, read back into one globally ordered capture history.

Writing tasks make archives of gzip members, one record each. Of records with
equal payloads of at least MIN_REVISIT bytes one is the response, the others
revisit it. Each archive that is read back gives a run of captures, sorted by
URL key and timestamp, cut into ranges of keys; for each range a loser tree
merges the runs. Only captures are shuffled for that, never payloads.

Defined cases: null html is an empty payload; a null url is kept as null and
has an empty key; of rows equal in page_id and payload the first is the
response and the others revisit it; a null page_id is larger than any other;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, bounded_batches, fresh_path, join_groups, open_fs, partitions_for, stage, write_whole

MIN_REVISIT = 100
_SPACE = uuid.UUID(int=0x666F6C69616E74)
FIELDS = ("url_key", "stamp", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length")


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query in lower case, so that a site's pages stand together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    labels = ",".join(reversed(re.sub(r"^www\d*\.", "", host).split(".")))
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{labels}{f':{port}' if port and port not in (80, 443) else ''}){tail.lower()}"


def stamp(page_id: int | None) -> str:
    """The capture time of a page that has none: seconds after a fixed day by its id."""
    return datetime.fromtimestamp(1_704_067_200 + (page_id or 0) % 315_360_000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, number: int) -> bytes:
    """One WARC record in a gzip member of its own. number tells the records of equal rows apart."""
    name = lambda page, k: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page} {digest} {k}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id, number)}", f"WARC-Date: {stamp(page_id)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~%-._"))
        if "%" in url or quote(url, safe="!#$&'()*+,/:;=?@[]~-._") != url:
            head.append("X-Source-URL: " + quote(url, safe=""))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to, 0)}", f"WARC-Refers-To-Date: {stamp(refers_to)}"]
        head += [f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else []
    head.append(f"Content-Length: {len(block)}")
    squeeze = zlib.compressobj(3, wbits=31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def members(stream, piece: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a stream, without reading it whole."""
    at, used, out, unpack, rest = 0, 0, [], zlib.decompressobj(31), b""
    while rest or (rest := stream.read(piece)):
        out.append(unpack.decompress(rest))
        used += len(rest) - len(unpack.unused_data)
        rest = unpack.unused_data
        if unpack.eof:
            yield at, used, b"".join(out)
            at, used, out, unpack = at + used, 0, [], zlib.decompressobj(31)
    if used:
        raise ValueError("the archive ends within a record")


def parse(content: bytes) -> dict:
    """A record's headers in lower case, and its payload (None for a revisit)."""
    head, _, block = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http-length"] = re.search(rb"(?i)content-length: (\d+)", http)[1].decode()
    return fields | {"payload": None if fields["warc-type"] == "revisit" else payload}


def capture(content: bytes) -> dict:
    """What the history keeps of a record; length and digest of a stored payload are taken from the payload itself."""
    r = parse(content)
    whole = r["payload"]
    digest = r["warc-payload-digest"].removeprefix("sha256:")
    if whole is not None and hashlib.sha256(whole).hexdigest() != digest:
        raise ValueError("a payload differs from its digest")
    source = r.get("x-source-url")
    url = unquote(source) if source is not None else r.get("warc-target-uri")
    number = lambda k: int(r[k]) if k in r else None
    return {"url_key": url_key(url), "stamp": r["warc-date"], "page_id": number("x-page-id"), "url": url, "payload_bytes": int(r["http-length"]) if whole is None else len(whole), "payload_digest": digest, "record_type": r["warc-type"], "refers_to": number("x-refers-to-page-id")}


class LoserTree:
    """Merges k sorted iterators: each inner node holds the loser of its match, so the next item costs log2 k comparisons."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.keys = [self._key(i) for i in range(self.k)]
        self.losers = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.keys[a] <= self.keys[b] else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _key(self, i: int) -> tuple:
        head = self.heads[i]
        return (1,) if head is None else (0, self.key(head), i)

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self.keys[i] = self._key(i)
            node = (i + self.k) // 2
            while node:
                if self.keys[self.losers[node]] < self.keys[i]:
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def _order(c: dict) -> tuple:
    return c["url_key"], c["stamp"], c["page_id"] is None, c["page_id"] or 0


def write_archives(pages: DataFrame, uri: str, most: int = 32 << 20) -> DataFrame:
    """Write archives of about most bytes each below uri; returns their names, already written. A task holds one unfinished archive."""
    spark = pages.sparkSession
    bounded_batches(spark)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    row_key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "digest").alias("row_key")
    small = stage(rows.select("page_id", "digest", row_key).where(F.octet_length("html") >= MIN_REVISIT), "page-digests")
    groups = small.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    shared = join_groups(small, groups, "digest", "n", small.count()).groupBy("row_key").agg(F.first("first_id").alias("first_id")).withColumn("shared", F.lit(True))
    dealt = rows.withColumn("row_key", row_key).repartition(partitions_for(pages), "row_key")  # equal rows meet, and the join needs no other exchange of payloads
    marked = dealt.join(shared, "row_key", "left").select("page_id", "url", "html", "digest", F.coalesce("shared", F.lit(False)).alias("shared"), "first_id")
    placed = marked.sortWithinPartitions("page_id", "digest", "url")

    def work(batches):
        from pyspark import TaskContext

        part, number, held, size, before, repeat = TaskContext.get().partitionId(), 0, [], 0, None, 0

        def close():
            nonlocal number, held, size
            name = f"part-{part:06d}-{number:05d}.warc.gz"
            write_whole(uri, name, held)
            number, held, size = number + 1, [], 0
            return {"archive": [name]}

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "shared", "first_id"))):
                page_id, url, payload, digest, shared, first_id = r
                repeat = repeat + 1 if before == (page_id, digest) else 0
                before = (page_id, digest)
                revisit = shared and (page_id != first_id or repeat > 0)
                held.append(record(page_id, url, payload, digest, first_id, revisit, repeat))
                size += len(held[-1])
                if size >= most:
                    yield close()
        if held:
            yield close()

    return stage(arrow_map(placed, work, "archive string"), "archives")


def _boundaries(pages: DataFrame, ranges: int, n: int, each: int = 20) -> list[tuple]:
    """Keys that cut n captures into about equal ranges, from a sample by their ids' hash: about `each` for a range, 20,000 at least, and at most four times as many. They steer balance only."""
    sample = max(20_000, each * ranges)
    share = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(1, n))) + 1)
    got = sorted((url_key(r["url"]), stamp(r["page_id"])) for r in pages.select(F.col("page_id").cast("long").alias("page_id"), "url").where(share).limit(4 * sample).collect())
    return [got[i * len(got) // ranges] for i in range(1, ranges)] if got else []


def read_runs(archives: DataFrame, uri: str, cuts: list[tuple], chunk: int = 2000) -> DataFrame:
    """Read every record back. Each archive is a run: its captures, sorted, in chunks (range, run, number, body)."""
    bounded_batches(archives.sparkSession)

    def work(batches):
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                system, folder = open_fs(uri)
                with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    run = [capture(c) | {"archive": name, "offset": at, "length": n} for at, n, c in members(stream)]
                run.sort(key=_order)
                out: dict[int, list] = {}
                for c in run:
                    out.setdefault(bisect_right(cuts, (c["url_key"], c["stamp"])), []).append(c)
                for k, rows in out.items():
                    for i in range(0, len(rows), chunk):
                        yield {"range": [k], "run": [name], "number": [i // chunk], "body": [json.dumps([[c[f] for f in FIELDS] for c in rows[i : i + chunk]]).encode()]}

    return stage(arrow_map(archives.repartition(max(1, archives.count()), "archive"), work, "range int, run string, number int, body binary"), "capture-runs")


HISTORY = "url_key string, stamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def merge_runs(runs: DataFrame, ranges: int) -> DataFrame:
    """The captures in global order: range by range over the partitions, and within a range as the loser tree gives them."""

    def unpacked(bodies: list[bytes]) -> Iterator[dict]:
        for b in bodies:
            for row in json.loads(b):
                yield dict(zip(FIELDS, row))

    def merged(held: dict[str, list[bytes]]):
        rows: list[dict] = []
        for c in LoserTree([unpacked(b) for b in held.values()], _order):
            rows.append(c)
            if len(rows) == 2000:
                yield {f: [r[f] for r in rows] for f in FIELDS}
                rows = []
        if rows:
            yield {f: [r[f] for r in rows] for f in FIELDS}

    def work(batches):
        held, now = {}, None
        for batch in batches:
            for k, run, body in zip(*(batch.column(c).to_pylist() for c in ("range", "run", "body"))):
                if k != now:
                    yield from merged(held)
                    held, now = {}, k
                held.setdefault(run, []).append(body)
        yield from merged(held)

    return arrow_map(runs.repartitionByRange(max(1, ranges), "range").sortWithinPartitions("range", "run", "number"), work, HISTORY)


def capture_history(pages: DataFrame, captures_per_range: int = 100_000) -> DataFrame:
    """Write pages as archives, read these back, and merge: HISTORY, in order of URL key and timestamp."""
    spark = pages.sparkSession
    uri = fresh_path(spark, "warc")
    archives = write_archives(pages, uri)
    n = pages.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // captures_per_range))
    return merge_runs(read_runs(archives, uri, _boundaries(pages, ranges, n)), ranges)
