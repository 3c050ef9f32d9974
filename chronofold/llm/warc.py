"""WARC archives with an externally merged capture index.

Each task writes one gzip-per-record WARC file and, of its captures, locally
sorted index runs (URL key, timestamp, page id).  Runs are merged k ways by a
loser tree: groups of ``fan_in`` runs into longer runs until at most
``fan_in`` are left, then range by range of the key space in parallel, which
yields globally ordered capture histories.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Workspace, heavy_keys, lookup_join
from .files import attempt_name, make_dir, open_fs

#: Payloads smaller than this are always stored whole.
REVISIT_FROM = 1000
#: Index entries sorted in memory before a run is written; entries per compressed block of a run; sampled keys per run.
RUN_ENTRIES, BLOCK_ENTRIES, RUN_SAMPLE = 200_000, 256, 64
MANIFEST = "archive_no int, archive string, run string, entries long, sample string"
HISTORY = "range_no int, ordinal long, urlkey string, ts string, page_id long, archive_no int, offset long, length long"
RECORD = "archive_no int, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Sort-friendly key: reversed host, then path and query, lower case; empty for no URL."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    key = ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def loser_merge(sources: Iterable[Iterator]) -> Iterator:
    """Merge sorted iterators with a loser tree: one comparison per level for each item."""
    streams = list(sources)
    k = len(streams)
    if not k:
        return
    heads = [next(s, None) for s in streams]
    losers = [-1] * k

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def settle(leaf: int) -> int:
        """Play the leaf up to the root, leaving losers behind; an empty place keeps it waiting."""
        at = leaf
        node = (leaf + k) // 2
        while node:
            if losers[node] < 0:
                losers[node] = at
                return -1
            if beats(losers[node], at):
                losers[node], at = at, losers[node]
            node //= 2
        return at

    top = -1
    for leaf in range(k):
        top = max(top, settle(leaf))
    while heads[top] is not None:
        yield heads[top]
        heads[top] = next(streams[top], None)
        top = settle(top)


def _sort_key(entry: tuple) -> tuple:
    urlkey, ts, page, archive, offset, length = entry
    return (urlkey, ts, page is not None, page or 0, archive, offset, length)


def _entry(key: tuple) -> tuple:
    urlkey, ts, known, page, archive, offset, length = key
    return (urlkey, ts, page if known else None, archive, offset, length)


def write_run(folder: str, keys: Iterable[tuple], block: int = BLOCK_ENTRIES) -> tuple[str, int, list]:
    """Write sorted keys as compressed blocks with a footer of (first key, offset, length)."""
    fs, root = open_fs(folder)
    name = attempt_name("run")
    footer, total, at, held = [], 0, 0, []
    with fs.open_output_stream(f"{root}/{name}") as out:

        def flush() -> None:
            nonlocal at, held
            raw = zlib.compress(json.dumps(held).encode(), 1)
            footer.append((held[0], at, len(raw)))
            out.write(raw)
            at += len(raw)
            held = []

        for key in keys:
            held.append(key)
            total += 1
            if len(held) == block:
                flush()
        if held:
            flush()
        raw = zlib.compress(json.dumps(footer).encode(), 1)
        out.write(raw)
        out.write(len(raw).to_bytes(8, "little"))
    step = max(1, len(footer) // RUN_SAMPLE)
    return f"{folder}/{name}", total, [f[0] for f in footer[::step]][:RUN_SAMPLE]


def read_run(uri: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """Keys in [low, high) of a run; only the blocks that can hold them are read, one at a time."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        n = int.from_bytes(f.read_at(8, size - 8), "little")
        footer = [(tuple(first), at, length) for first, at, length in json.loads(zlib.decompress(f.read_at(n, size - 8 - n)))]
        for i, (first, at, length) in enumerate(footer):
            if high is not None and first >= high:
                return
            if low is not None and i + 1 < len(footer) and footer[i + 1][0] < low:
                continue
            for key in map(tuple, json.loads(zlib.decompress(f.read_at(length, at)))):
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield key


def _field(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(urn: str | None) -> int | None:
    return None if urn is None or urn == "<urn:page:none>" else int(urn[len("<urn:page:") : -1])


def build_record(page: int | None, url: str | None, ts: str, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers (with the payload's length) but not the payload."""
    kind = "response" if refers is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {ts}", f"WARC-Target-URI: {_field(url or '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: {_urn(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of one record; lengths are checked."""
    cut = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in raw[:cut].decode().split("\r\n")[1:])
    block = raw[cut + 4 : cut + 4 + int(head["Content-Length"])]
    if raw[cut + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("record has a wrong length")
    cut = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:cut].decode().split("\r\n")[1:])
    return head, http, block[cut + 4 :]


def read_archive(uri: str, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each gzip member, read in chunks."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as f:
        at, held = 0, b""
        while held or (held := f.read(chunk)):
            member, parts, used = zlib.decompressobj(31), [], 0
            while True:
                parts.append(member.decompress(held))
                if member.eof:
                    used += len(held) - len(member.unused_data)
                    held = member.unused_data
                    break
                used += len(held)
                held = f.read(chunk)
                if not held:
                    raise ValueError("archive ends within a record")
            yield at, b"".join(parts)
            at += used


def _writer(folder: str, run_entries: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        no = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        archive = f"{folder}/{(name := attempt_name('archive'))}.warc.gz"
        at, entries, runs = 0, [], []

        def flush() -> None:
            nonlocal entries
            if entries:
                runs.append(write_run(folder, sorted(map(_sort_key, entries))))
                entries = []

        out = None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for page, url, ts, payload, digest, refers in zip(*cols, strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}.warc.gz")
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = packer.compress(build_record(page, url, ts, payload, digest, refers)) + packer.flush()
                out.write(raw)
                entries.append((url_key(url), ts, page, no, at, len(raw)))
                at += len(raw)
                if len(entries) >= run_entries:
                    flush()
        if out is not None:
            out.close()
            flush()
            rows = [(no, archive, run, n, json.dumps(sample)) for run, n, sample in runs]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["archive_no", "archive", "run", "entries", "sample"])

    return write


def _group_merger(folder: str):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paths in batch.column("runs").to_pylist():
                run, n, sample = write_run(folder, loser_merge(read_run(p) for p in paths))
                yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([n], pa.int64()), pa.array([json.dumps(sample)])], names=["run", "entries", "sample"])

    return merge


def _range_merger(runs: list[str], cuts: list[tuple]):
    names = [f.split()[0] for f in HISTORY.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in HISTORY.split(", ")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

        for batch in batches:
            for r in batch.column(0).to_pylist():
                low, high = (cuts[r - 1] if r else None), (cuts[r] if r < len(cuts) else None)
                held: list = []
                for i, key in enumerate(loser_merge(read_run(p, low, high) for p in runs)):
                    held.append((r, i, *_entry(key)))
                    if len(held) == 10_000:
                        yield pack(held)
                        held = []
                if held:
                    yield pack(held)

    return merge


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["archive_no", "offset", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for batch in batches:
        for no, uri in zip(batch.column("archive_no").to_pylist(), batch.column("archive").to_pylist(), strict=True):
            rows: list = []
            for at, raw in read_archive(uri):
                head, http, payload = parse_record(raw)
                digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if head["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"{uri}: payload at {at} does not match its digest")
                rows.append((no, at, _page(head["WARC-Record-ID"]), int(http["Content-Length"]), digest, head["WARC-Type"], _page(head.get("WARC-Refers-To"))))
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)


class WarcArchive:
    """A written archive: its manifest, its merged capture histories, its records."""

    def __init__(self, pages: DataFrame, run_entries: int = RUN_ENTRIES, fan_in: int = 512, range_entries: int = 100_000, max_ranges: int = 4096):
        if fan_in < 2:
            raise ValueError("fan_in must be at least 2")
        self.spark, self.fan_in, self.range_entries, self.max_ranges = pages.sparkSession, fan_in, range_entries, max_ranges
        self.work = Workspace(self.spark, "warc")
        self.folder = self.work.path("files")
        make_dir(self.folder)
        raw = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
        start = F.lit(datetime(2020, 1, 1, tzinfo=timezone.utc))
        stamp = F.date_format(F.timestamp_seconds(F.unix_timestamp(start) + F.coalesce(F.pmod("page_id", F.lit(10**9)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", stamp.alias("ts"), raw.alias("payload"), F.sha1(raw).alias("digest"))
        large = base.where(F.octet_length("payload") >= REVISIT_FROM).select("digest", "page_id")
        heavy = self.work.table(heavy_keys(large, ["digest"]), "heavy")
        origin = self.work.table(large.groupBy("digest").agg(F.max("page_id").alias("origin"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "origin"), "origin")
        known = lookup_join(base, origin, ["digest"], heavy)
        refers = F.when((F.octet_length("payload") >= REVISIT_FROM) & F.col("page_id").isNotNull() & (F.col("page_id") < F.col("origin")), F.col("origin"))
        rows = known.select("page_id", "url", "ts", "payload", "digest", refers.alias("refers_to"))
        self.manifest = self.work.table(rows.mapInArrow(_writer(self.folder, run_entries), MANIFEST), "manifest")

    def histories(self) -> DataFrame:
        """Captures in global order of (range_no, ordinal): by URL key, timestamp, page id."""
        runs, level = self.manifest.select("run", "entries", "sample"), 0
        while runs.count() > self.fan_in:
            no = F.row_number().over(Window.orderBy("run")) - 1  # one short row per run, not per capture
            groups = runs.withColumn("g", F.floor(no / self.fan_in)).groupBy("g").agg(F.collect_list("run").alias("runs"))
            level += 1
            runs = self.work.table(groups.mapInArrow(_group_merger(self.folder), "run string, entries long, sample string"), f"runs{level}")
        rows = runs.collect()  # fan_in rows at most
        total = sum(r.entries for r in rows)
        keys = sorted(tuple(k) for r in rows for k in json.loads(r.sample))
        n = max(1, min(self.max_ranges, -(-total // self.range_entries), len(keys)))
        cuts = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []
        ranges = self.spark.range(0, len(cuts) + 1, 1, len(cuts) + 1)
        return self.work.table(ranges.mapInArrow(_range_merger([r.run for r in rows], cuts), HISTORY), "histories")

    def records(self) -> DataFrame:
        """Every record as read back from the archives, one archive at a time, digests checked."""
        archives = self.manifest.select("archive_no", "archive").distinct()
        return archives.repartition(max(1, archives.count())).mapInArrow(_reader, RECORD)


def warc_digest(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC, merge the index, read all back through it.

    A null html is the empty payload, a null url the empty key.  Of equal
    payloads of at least 1000 bytes the largest page_id is the response (all
    rows that repeat it are); rows without a page_id are responses.  Timestamps
    are seconds since 2020-01-01 by page_id, as the table has none.  An empty
    table gives an empty result.
    """
    archive = WarcArchive(pages, **options)
    index = archive.histories().select("archive_no", "offset")
    out = index.join(archive.records().hint("merge"), ["archive_no", "offset"])
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
