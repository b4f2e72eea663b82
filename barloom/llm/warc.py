"""WARC archives and the external merge of their index.

Writing: one record for each page. Of the records with equal payloads of at least
``REVISIT_BYTES`` the one with the largest id is a response and the others revisit it; smaller
payloads are always responses. A record is text, so Spark's own text writer makes the files: the
separator closes a record, files appear whole or not at all, and any file system Spark knows
will do. Records are written where they are read, in files of about ``FILE_BYTES``; payloads are
not shuffled, except where the digests of equal payloads are too many to broadcast (their number
is counted first).

Reading: files are parsed by their Content-Length and payloads held against the digest in the
header. Each file gives one run of index entries, sorted by URL key and capture time.

Merging: borders of key ranges come from keys evenly spaced in every run (``PER_RANGE`` keys for
each range in all). Each run is cut at the borders, and a task merges the pieces of its range
with a loser tree: one comparison for each level and entry. Borders are whole keys (URL key,
time, id), so one URL with a third of all captures still spreads over many ranges. Ranges in
order, and entries in order inside a range, are the global capture history.

Defined cases: a null html is an empty payload, a null URL has an empty key. Repeated ids take
part as records of their own; among equal large payloads that share the largest id all are
responses. A null id never is the one that others refer to unless it stands alone. Times come
from the id unless a column is given.
"""
from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.storage import cut, scratch

SPAN = 400_000_000
REVISIT_BYTES = 1000
FILE_BYTES = 16 << 20
LISTED = 100_000
RANGE_ENTRIES = 200_000
LEAST_RANGES = 32
PER_RANGE = 20
_FIELDS = {"url_key": "string", "capture_time": "string", "page_id": "long", "url": "string",
           "file": "string", "offset": "long", "length": "long", "payload_bytes": "long",
           "payload_digest": "string", "record_type": "string", "refers_to": "long"}
_ENTRY = ", ".join(f"{n} {k}" for n, k in _FIELDS.items())
_TYPES = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in _FIELDS.items()])
_CRLF = "\r\n"
_REST = re.compile(r"(?is)^[a-z][a-z0-9+.-]*://([^/?#:]*)(.*)$")


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then port, path and query, lower-cased."""
    m = _REST.match((url or "").lower())
    if not m:
        return (url or "").lower()
    host = re.sub(r"^www\d*\.", "", m[1])
    return ",".join(reversed(host.split("."))) + ")" + m[2]


def decisions(pages: DataFrame, key: str = "page_id", url: str = "url",
              html: str = "html", time: Column | None = None) -> DataFrame:
    """What each record will be: (page_id, url, html of responses, payload facts)."""
    payload = F.coalesce(F.col(html), F.lit(""))
    # Without times of capture, ids give some within SPAN seconds. Seconds are added to a time
    # without zone, so the session's zone has no part in it.
    seconds = F.unix_seconds(time) if time is not None else F.lit(1_704_067_200) + F.pmod(
        F.coalesce(F.col(key).cast("long"), F.lit(0)), F.lit(SPAN))
    stamp = F.timestamp_add("SECOND", seconds.cast("int") if time is None else seconds,
                            F.lit("1970-01-01").cast("timestamp_ntz"))
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("html"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("capture_time"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"))
    large = F.col("payload_bytes") >= REVISIT_BYTES
    # Only digests found more than once matter; they are counted before the join.
    twins = cut(rows.where(large).groupBy("payload_digest").agg(
        F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("payload_digest", "first_id"))
    few = twins.limit(LISTED + 1).count() <= LISTED
    out = rows.join(F.broadcast(twins) if few else twins, "payload_digest", "left")
    other = large & (F.col("first_id") != F.col("page_id"))
    other = other | (large & F.col("first_id").isNotNull() & F.col("page_id").isNull())
    return out.select(
        "page_id", "url", "capture_time", "payload_bytes", "payload_digest",
        F.when(other, "revisit").otherwise("response").alias("record_type"),
        F.when(other, F.col("first_id")).alias("refers_to"),
        F.when(~F.coalesce(other, F.lit(False)), F.col("html")).otherwise("").alias("html"))


def _digest32(digest: Column) -> Column:
    """``sha1:`` and base 32, as archives write it; the alphabet is that of RFC 4648."""
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(""), lambda a, i: F.concat(
        a, F.lpad(F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 32), 4, "0")))
    return F.translate(F.upper(bits), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(rows: DataFrame) -> DataFrame:
    """The text of each record, without the line end that the writer adds."""
    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))

    http = F.lit(_CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "", ""]))
    size = F.length(http) + F.octet_length("html")
    ident = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                     F.lit(">"))
    # A line end inside a URL would end the header; it is written as URLs write it.
    target = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")),
                       F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    empty = F.lit("")
    text = F.concat(
        F.lit("WARC/1.1" + _CRLF), header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", ident), header("WARC-Date", F.col("capture_time")),
        header("WARC-Target-URI", target),
        F.when(F.col("url").isNull(), header("X-No-URI", F.lit("1"))).otherwise(empty),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _digest32(F.col("payload_digest")))),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(
            header("WARC-Profile", F.lit(
                "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast(
                "string"), F.lit(">"))))).otherwise(empty),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", size.cast("string")), F.lit(_CRLF), http, F.col("html"),
        F.lit(_CRLF))
    return rows.select(text.alias("value"))


def write(rows: DataFrame, path: str) -> None:
    """Archives of about ``FILE_BYTES`` of payload each, compressed by the writer."""
    mean = rows.agg(F.avg(F.col("payload_bytes"))).first()[0] or 0
    each = max(1, int(FILE_BYTES / (mean + 600)))
    (records(rows).write.option("lineSep", _CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", each).text(path))


_FIELD = re.compile(rb"^([A-Za-z-]+): ?(.*)$")


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, content) of every record of a file."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        fields = {}
        for line in data[at:head].split(b"\r\n")[1:]:
            if m := _FIELD.match(line):
                fields[m[1].decode().lower()] = m[2].decode()
        start = head + 4
        end = start + int(fields["content-length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has a wrong length")
        yield at, end + 4 - at, fields, data[start:end]
        at = end + 4


def _ident(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of archives; those of one file are a run, sorted by key, time and id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select(
        "path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path"), b.column("content")):
                rows: list[tuple] = []
                plain = zlib.decompress(memoryview(content.as_buffer()), 47)
                for offset, length, f, body in parse(plain):
                    payload = body[body.index(b"\r\n\r\n") + 4:]
                    kind = f["warc-type"]
                    digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: payload at byte {offset} does not match")
                    url = None if "x-no-uri" in f else f["warc-target-uri"]
                    rows.append((url_key(url), f["warc-date"], _ident(f["warc-record-id"]), url,
                                 name.as_py(), offset, length, int(f["x-payload-length"]), digest,
                                 kind, _ident(f.get("warc-refers-to"))))
                rows.sort(key=_order)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES.types)], schema=_TYPES)

    return files.mapInArrow(read, _ENTRY)


def _order(row: tuple) -> tuple:
    """URL key, time, id (null first), then place, so that the order is total."""
    return row[0], row[1], -1 if row[2] is None else row[2], row[4], row[5]


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, the overall winner leads."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        k = len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * k
        self.k = k
        for i in range(k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            held = self.tree[node]
            if held < 0:
                self.tree[node] = winner
                return
            if self._less(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        while self.k and (head := self.heads[self.tree[0]]) is not None:
            i = self.tree[0]
            yield head, i
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def borders(index: DataFrame, total: int) -> list[tuple]:
    """Keys that divide the entries evenly, from keys evenly spaced in every run."""
    ranges = max(LEAST_RANGES, -(-total // RANGE_ENTRIES))
    step = max(1, total // (ranges * PER_RANGE))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            yield b.take(pa.array(range(-at % step, b.num_rows, step), pa.int64()))
            at += b.num_rows

    kinds = {n: _FIELDS[n] for n in ("url_key", "capture_time", "page_id", "file", "offset")}
    keys = sorted((r[0], r[1], -1 if r[2] is None else r[2], r[3], r[4])
                  for r in index.select(*kinds).mapInArrow(
                      sample, ", ".join(f"{n} {k}" for n, k in kinds.items())).collect())
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


def merged(index: DataFrame) -> DataFrame:
    """The entries of a written index with (range_no, range_pos), which order them by URL key,
    time and id."""
    shared = index.sparkSession.sparkContext.broadcast(borders(index, index.count()))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs, or stretches of them, cut at the borders: one packed row for each piece."""
        for b in batches:
            rows = list(zip(*[b.column(n).to_pylist() for n in _FIELDS]))
            runs = [0, *(i for i in range(1, len(rows)) if rows[i][4] != rows[i - 1][4]), len(rows)]
            numbers, packed = [], []
            for a, z in zip(runs, runs[1:]):
                ranges = [bisect.bisect_right(shared.value, _order(r)) for r in rows[a:z]]
                while a < z:
                    r = ranges[a - z]
                    end = z - len(ranges) + bisect.bisect_right(ranges, r)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, b.schema) as out:
                        out.write_batch(b.slice(a, end - a))
                    numbers.append(r)
                    packed.append(sink.getvalue().to_pybytes())
                    a = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(packed, pa.binary())],
                names=["range_no", "piece"])

    def merge(table: pa.Table) -> pa.Table:
        runs = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in table.column("piece")]
        starts = [0]
        for run in runs:
            starts.append(starts[-1] + run.num_rows)
        heads = [((*_order(r), i) for i, r in enumerate(zip(
            *[run.column(n).to_pylist() for n in _FIELDS]))) for run in runs]
        order = [starts[run] + head[-1] for head, run in LoserTree(heads)]
        out = pa.concat_tables(runs).take(pa.array(order, pa.int64()))
        n = out.num_rows
        no = table.column("range_no")[0].as_py()
        return out.append_column("range_no", pa.array([no] * n, pa.int64())).append_column(
            "range_pos", pa.array(range(n), pa.int64()))

    return index.mapInArrow(pieces, "range_no long, piece binary").groupBy(
        "range_no").applyInArrow(merge, f"{_ENTRY}, range_no long, range_pos long")


def archive(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back and merge their index."""
    spark = pages.sparkSession
    path = scratch(spark)
    write(decisions(pages), path)
    return merged(cut(entries(spark, path)))


SQL = """
with p as (
  select page_id, encode(coalesce(html, '')) as body from pages),
d as (
  select page_id, octet_length(body) as n, sha1(body) as digest from p),
w as (
  select *, max(page_id) over (partition by digest) as first_id from d)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
  case when n >= 1000 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> first_id then first_id end as refers_to
from w
"""
