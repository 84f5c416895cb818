"""WARC archives of captured pages, and their index by external merge.

Writing: every page is one record of its own gzip member; a page whose payload equals that of a later page (and is long
enough) becomes a revisit record that refers to it. Indexing: every archive is read back, record by record, into index
entries that are sorted locally and written as runs. The runs are merged by URL key and time with a loser tree, in passes:
a team of ``FAN_IN`` runs becomes one run, cut in ranges of its own keys of about ``RANGE_ROWS`` rows; a task merges one
range of one team, one row group of each run in memory. So every pass reads and writes each row group about once, however
many runs there are, and the driver sees none of them; the cuts come from the runs' sparse index (one row for
``GROUP_ROWS`` records), which a sort of Spark orders. One URL may hold any share of the captures, as ranges are cut in the
whole key (URL key, time, page).
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from allelake.llm.common import filesystem, mapped, stage, work_dir

ARCHIVE_BYTES, RUN_ROWS, GROUP_ROWS, RANGE_ROWS, FAN_IN = 64 << 20, 200_000, 2_048, 262_144, 64
REVISIT_BYTES = 1_000
#: Digests of payloads that occur more than once are broadcast up to this many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 16 << 20
_EPOCH = datetime.datetime(2020, 1, 1)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = pa.schema(
    [("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
ENTRY_DDL = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host parts reversed, no scheme, user, port 80 or 443, or leading www; lower case host."""
    if not url:
        return ""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", url)
    if not m:
        return url.split("#")[0]
    host, port, rest = m[1].lower(), m[2], m[3] or "/"
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, "", "80", "443") else "") + ")" + (rest if rest[0] == "/" else "/" + rest)


def _record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(record_id: str | None) -> int | None:
    x = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return None if x in ("", "none") else int(x)


def record(page: int | None, url: str | None, captured: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Target-URI: {target}", f"WARC-Date: {captured}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if revisit:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _captured(page: int | None) -> str:
    return (_EPOCH + datetime.timedelta(seconds=(page or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _write(folder: str):
    def run(batches):
        fs, root = filesystem(folder)
        out, path, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for page, url, html, digest, last in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "last")), strict=True):
                page, url, payload, digest, last = page.as_py(), url.as_py(), (html.as_py() or "").encode(), digest.as_py(), last.as_py()
                if out is None:
                    fs.create_dir(root, recursive=True)
                    path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                revisit = last is not None and last != page
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = z.compress(record(page, url, _captured(page), payload, digest, last, revisit)) + z.flush()
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], ["archive", "records", "bytes"])

    return run


def read_records(stream) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive of gzip members, read piece by piece."""
    left, begin, eof = b"", 0, False
    while True:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not left:
                left = b"" if eof else stream.read(1 << 20)
                if not left:
                    if used:
                        raise ValueError("the archive ends within a record")
                    return
            parts.append(z.decompress(left))
            used += len(left) - len(z.unused_data)
            left = z.unused_data
        data = b"".join(parts)
        end = data.index(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
        n = int(headers["Content-Length"])
        yield begin, used, headers, data[end + 4 : end + 4 + n]
        begin += used


def _entry(archive: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    end = block.index(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", block[:end])[1])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if headers["WARC-Type"] == "response" and (len(block) - end - 4 != size or hashlib.sha1(memoryview(block)[end + 4 :]).hexdigest() != digest):
        raise ValueError(f"{archive} at {offset}: the payload doesn't have its digest")
    target = headers["WARC-Target-URI"]
    return url_key(None if target == "about:blank" else target), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], _page(headers.get("WARC-Refers-To")), archive, offset, length


def _key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


RUNS = "run string, group int, rows long, url_key string, captured string, page_id long"


def _write_run(fs, root: str, rows: list[tuple] | Iterator[tuple]) -> list[tuple]:
    """Write sorted rows as a run; gives its sparse index: (run, row group, rows, first key)."""
    path, index, group, writer = f"{root}/{uuid.uuid4().hex}.run", [], [], None

    def put():
        writer.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*group, strict=True), ENTRY.types, strict=True)], schema=ENTRY))
        index.append((path, len(index), len(group), *group[0][:3]))
        group.clear()

    for row in rows:
        if writer is None:
            fs.create_dir(root, recursive=True)
            writer = pq.ParquetWriter(path, ENTRY, filesystem=fs, compression="zstd")
        group.append(row)
        if len(group) == GROUP_ROWS:
            put()
    if group:
        put()
    if writer is not None:
        writer.close()
    return index


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_RUNS = pa.schema([("run", pa.string()), ("group", pa.int32()), ("rows", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64())])


def _sorted_runs(folder: str):
    def run(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows, name = [], archive.rpartition("/")[2]
                with fs.open_input_stream(archive, compression=None) as f:
                    for x in read_records(f):
                        rows.append(_entry(name, *x))
                        if len(rows) == RUN_ROWS:
                            yield _as_batch(_write_run(fs, root, sorted(rows, key=_key)), _RUNS)
                            rows = []
                if rows:
                    yield _as_batch(_write_run(fs, root, sorted(rows, key=_key)), _RUNS)

    return run


class LoserTree:
    """Merges sorted streams: each inner node keeps the loser of its match, so a step plays one path of log2(k) matches."""

    def __init__(self, streams: list[Iterator], key):
        self.streams, self.key = streams, key
        self.size = 1
        while self.size < max(1, len(streams)):
            self.size *= 2
        self.heads: list = [self._next(i) for i in range(self.size)]
        self.losers = [0] * self.size
        winners = list(range(self.size))
        node = self.size
        while node > 1:  # play the first round of all levels
            half = node // 2
            level = []
            for j in range(half):
                a, b = winners[2 * j], winners[2 * j + 1]
                if self._less(b, a):
                    a, b = b, a
                level.append(a)
                self.losers[half + j] = b
            winners, node = level, half
        self.winner = winners[0]

    def _next(self, i: int):
        if i >= len(self.streams):
            return None
        row = next(self.streams[i], None)
        return None if row is None else (self.key(row), i, row)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def __iter__(self):
        while self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][2]
            self.heads[i] = self._next(i)
            node = (self.size + i) // 2
            while node >= 1:
                if self._less(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def _run_rows(fs, path: str, groups: list[int], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Rows of a run from ``low`` (included) to ``high`` (not included), one row group at a time."""
    with fs.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        for g in groups:
            table = file.read_row_group(g)
            for row in zip(*(c.to_pylist() for c in table.columns), strict=True):
                k = _key(row)
                if high is not None and k >= high:
                    return
                if low is None or k >= low:
                    yield row


def _merge(folder: str, last: bool):
    schema = ENTRY.append(pa.field("range", pa.int32())) if last else _RUNS.append(pa.field("part", pa.int32())).append(pa.field("number", pa.int64()))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        team, part = (x.as_py() for x in key)
        low = high = None
        runs: dict[int, dict[tuple, list[int]]] = {}
        for batch in batches:
            for n, p, r, g, a, b in zip(*(batch.column(c).to_pylist() for c in ("number", "part", "run", "group", "low", "high")), strict=True):
                runs.setdefault(n, {}).setdefault((p, r), []).append(g)
                low, high = tuple(a.values()), None if b is None else tuple(b.values())
        # The files of one run follow each other, so a run is one stream.
        streams = [itertools.chain.from_iterable(_run_rows(fs, r, sorted(g), low, high) for (_, r), g in sorted(files.items())) for _, files in sorted(runs.items())]
        merged = iter(LoserTree(streams, _key))
        if last:
            rows = []
            for row in merged:
                rows.append((*row, part))
                if len(rows) == GROUP_ROWS:
                    yield _as_batch(rows, schema)
                    rows = []
            yield _as_batch(rows, schema)
        else:
            yield _as_batch([(*x, part, team) for x in _write_run(fs, root, merged)], schema)

    return run


def placed(index: DataFrame, folder: str) -> DataFrame:
    """The row groups that each range of each team of ``FAN_IN`` runs meets: one row for each, with the range's bounds.

    ``index`` has a row for each row group (number of the run, part, run: its file, group, rows, first key). A team's keys
    are cut where the rows of the groups that begin before come to another ``RANGE_ROWS``. A group is met by the ranges from
    that of its first key to that of the next group's, so a pass reads a group as often as it spans ranges.
    """
    first = F.struct("url_key", "captured", F.col("page_id").isNotNull().alias("known"), F.coalesce("page_id", F.lit(0)).alias("page"))
    rows = index.withColumn("team", F.floor(F.col("number") / FAN_IN)).withColumn("first", first)
    before = F.sum("rows").over(W.partitionBy("team").orderBy("first").rangeBetween(W.unboundedPreceding, W.currentRow))  # equal keys alike
    rows = rows.withColumn("begin", F.floor((before - 1) / RANGE_ROWS).cast("int"))
    end = F.coalesce(F.lead("begin").over(W.partitionBy("team", "number").orderBy("part", "group")), F.max("begin").over(W.partitionBy("team")))
    rows = stage(rows.select("team", "number", "part", "run", "group", "first", "begin", end.alias("end")), folder)
    cuts = rows.groupBy("team", F.col("begin").alias("range")).agg(F.min("first").alias("low"))
    cuts = cuts.withColumn("high", F.lead("low").over(W.partitionBy("team").orderBy("range")))
    met = rows.select("team", "number", "part", "run", "group", F.explode(F.sequence("begin", "end")).alias("range"))
    ranges = rows.select("team", "begin").distinct().count()
    # A number of its own, as the rows are few but the work behind each is not.
    return met.join(cuts, ["team", "range"]).repartition(max(1, ranges), "team", "range")


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in ``folder``; gives (archive, records, bytes) of each."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    rows = rows.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).withColumn("bytes", F.coalesce(F.octet_length("html"), F.lit(0)))
    equal = rows.where(f"bytes >= {least}").groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    equal = stage(equal, f"{folder}/equal")
    if equal.count() * 64 <= BROADCAST_BYTES:  # pages are then written where they are read
        equal = F.broadcast(equal)
    return stage(rows.join(equal, ["digest", "bytes"], "left").transform(mapped(_write(folder), "archive string, records long, bytes long")), f"{folder}/list")


def merged_index(archives: DataFrame, folder: str) -> DataFrame:
    """Index entries of all records of ``archives``, read from the files: ordered by (range, URL key, time, page)."""
    spread = archives.select("archive").repartition(max(1, archives.count()), "archive")
    runs = stage(spread.transform(mapped(_sorted_runs(f"{folder}/runs"), RUNS)), f"{folder}/sparse")
    numbers = runs.select("run").distinct().withColumn("number", F.row_number().over(W.orderBy("run")).cast("long") - 1)
    numbers = stage(numbers, f"{folder}/numbers")
    index, left, level = runs.withColumn("part", F.lit(0)).join(numbers, "run"), numbers.count(), 0
    while left > FAN_IN:
        level += 1
        groups = placed(index, f"{folder}/placed{level}").groupBy("team", "range")
        index = stage(groups.applyInArrow(_merge(f"{folder}/runs{level}", False), RUNS + ", part int, number long"), f"{folder}/sparse{level}")
        left = -(-left // FAN_IN)
    final = placed(index, f"{folder}/placed").groupBy("team", "range").applyInArrow(_merge(f"{folder}/final", True), ENTRY_DDL + ", range int")
    return stage(final, f"{folder}/index")


def capture_histories(pages: DataFrame, name: str = "warc") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC archives, read them back, and merge their index.

    One row per page: url_key, captured, page_id, payload_bytes, payload_digest (lower-case hex SHA-1), record_type
    (response or revisit), refers_to, archive, offset, length, range; rows are in order of URL key, time and page within a
    range, and ranges are in order. Of records with equal payloads of at least 1000 bytes, those of the largest page_id are
    responses and the others revisits that refer to it; others are responses. A null html is an empty payload. A page_id
    that repeats with the same payload gives as many records of the same kind; a null page_id is written as such, and is a
    response if its payload has no record with a page_id. A null or empty url has an empty key. Other columns are ignored;
    an empty table gives no rows. The capture time is made from page_id (2020-01-01 plus as many seconds).
    """
    folder = work_dir(pages.sparkSession, name)
    return merged_index(write_archives(pages, folder), folder)
