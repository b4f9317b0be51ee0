"""WARC archives and the external merge of their capture indexes.

Writing: every page becomes a WARC/1.1 record. Pages whose payload equals that of
a page with a smaller id, and has at least ``min_revisit_bytes`` bytes, become
revisit records without the payload. Spark's own text writer stores the records
(the record separator CRLF CRLF is its line separator), so archives land through
Hadoop's committers on any file system and survive a lost executor. Each task
sorts its captures by URL key, time and id first: the archives of a task, one after
another, are a sorted run. Records are written by size class, so that an archive has
about 64 MiB before compression at most, or one record.

Reading: archives are parsed by their Content-Length headers, never by searching
for separators inside payloads. An entry has its record's byte offset in the
(decompressed) archive; ``record_at`` reads one record from there.

Index merge: the entries are range-partitioned by (URL key, timestamp, id); the number
of ranges follows the number of entries, so a range has a bounded number of them. Inside
a range Spark's external sort puts the slices of the runs one after another, each in its
order, and a loser tree merges them; a run is read ahead by ``READ_AHEAD`` entries, the
rest stays in Arrow buffers. Since the time is part of the range key, a URL with a third
of all captures spreads over many ranges. The ranges one after another are the global
order.

Defined results: null html is an empty payload; null url has no target URI and an
empty URL key; null ids are kept (such a record has no id to refer to, and it
revisits the smallest non-null id with its payload); rows that repeat the smallest
id are all responses; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, written

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = 1_700_000_000
#: Size classes: payload bytes at most (None: no limit), records of an archive at most.
SIZES = ((64 << 10, 1000), (4 << 20, 16), (None, 1))
#: An archive's run and its number in it, by the last "-c": the job's random id before it may
#: hold "-c" and a digit as well.
ARCHIVE = r"^(.*)-c([0-9]+)[^/]*$"
#: Index entries of a range, and of a run that are Python rows at a time.
RANGE_ENTRIES, READ_AHEAD = 200_000, 256


def url_key(url: Column) -> Column:
    """Sort-friendly key: reversed host labels, then path and query, lower-cased."""
    rest = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"\A[^:/?#]*://", ""))
    host = F.regexp_replace(F.regexp_extract(rest, r"\A([^/?#]*)", 1), r"\Awww\.", "")
    tail = F.regexp_extract(rest, r"\A[^/?#]*([^#]*)", 1)
    reversed_host = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(rest == "", "").otherwise(F.concat(reversed_host, F.lit(")"), tail))


def capture_time(page_id: Column) -> Column:
    """A capture time of its own for every id, for tables that carry none."""
    return F.coalesce(F.pmod(page_id, F.lit(1_000_000_000)), F.lit(0)) + F.lit(EPOCH)


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """Adds ``payload, digest, n, refers_to``.

    Only ids and digests are grouped; a digest with a third of all rows is
    pre-aggregated before its shuffle and joined without aggregating above the
    join, so adaptive execution may split it. The payload itself is joined on the
    evenly spread (id, digest).
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n")
    )
    keys = rows.where(F.col("n") >= min_revisit_bytes).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    later = (
        keys.join(first, "digest")
        .where("first_id IS NOT NULL AND NOT page_id <=> first_id")
        .select(F.col("page_id").alias("later_id"), F.col("digest").alias("later_digest"), "first_id")
        .distinct()
    )
    same = rows.page_id.eqNullSafe(later.later_id) & (rows.digest == later.later_digest)
    return rows.join(later, same, "left").select("page_id", "url", "payload", "digest", "n", F.col("first_id").alias("refers_to"))


def record() -> Column:
    """The text of a row's WARC record, without the separator after it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("n").cast("string"),
        F.lit(CRLF * 2),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    # Without a time zone: a session's zone may lack the hour.
    time = F.timestamp_add("SECOND", capture_time(F.col("page_id")), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    stamp = F.concat(F.replace(time.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    def urn(value: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), value.cast("string"), F.lit(">"))

    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", stamp),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, PROFILE)),
        line("WARC-Refers-To", urn(F.col("refers_to"))),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF * 2),
        block,
    )


def write_archives(pages: DataFrame, path: str, sizes: Sequence[tuple[int | None, int]] = SIZES) -> None:
    """Write the pages as gzip-compressed WARC archives under ``path``, a folder a size class."""
    length = F.coalesce(F.octet_length("html"), F.lit(0))
    lows = [0, *(most + 1 for most, _ in sizes[:-1])]
    inside = [(F.col("n") >= low) & (F.lit(True) if most is None else F.col("n") <= most) for low, (most, _) in zip(lows, sizes)]
    occurs = pages.select(length.alias("n")).agg(*[F.coalesce(F.bool_or(x), F.lit(False)).alias(f"c{k}") for k, x in enumerate(inside)]).first()
    rows = with_revisits(pages).withColumn("url", F.regexp_replace("url", r"[\x00-\x1f\x7f]", "%0A"))
    for k, (_, records) in enumerate(sizes):
        if k and not occurs[k]:
            continue
        own = rows if sum(occurs) <= occurs[k] else rows.where(inside[k])
        runs = own.withColumn("key", url_key(F.col("url"))).sortWithinPartitions("key", capture_time(F.col("page_id")), "page_id")
        (
            runs.select(record().alias("value"))
            .write.option("lineSep", CRLF * 2)
            .option("compression", "gzip")
            .option("maxRecordsPerFile", records)
            .text(f"{path}/size-{k}")
        )


def parse_archive(data: bytes, chunk: int = 1 << 20, skip: int = 0) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers, block and byte offset of each record of one gzip-compressed archive, in
    order, from the offset ``skip`` on (which has to be a record's).

    Inflates piecewise: at most one record and one chunk are in memory besides
    the compressed bytes.
    """
    source = memoryview(data)
    inflate, held, at = zlib.decompressobj(31), bytearray(), 0

    def fill(need: int) -> bool:
        nonlocal at, inflate
        while len(held) < need and (at < len(source) or inflate.unconsumed_tail):
            held.extend(inflate.decompress(inflate.unconsumed_tail or source[at : at + chunk], 4 * chunk))
            if not inflate.unconsumed_tail:
                at += chunk
            if inflate.eof:
                rest = inflate.unused_data
                at = min(at, len(source)) - len(rest)
                inflate = zlib.decompressobj(31)
                if not rest and at >= len(source):
                    break
        return len(held) >= need

    place = 0
    while place < skip and fill(1):
        passed = min(len(held), skip - place)
        del held[:passed]
        place += passed
    while fill(1):
        end, need = held.find(b"\r\n\r\n"), 4096
        while end < 0:
            if not fill(len(held) + need):
                raise ValueError("a record's header does not end")
            end = held.find(b"\r\n\r\n")
        lines = held[:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(headers["Content-Length"])
        if not fill(end + 4 + size + 4):
            raise ValueError("a record's block ends early")
        yield headers, bytes(held[end + 4 : end + 4 + size]), place
        del held[: end + 4 + size + 4]
        place += end + 4 + size + 4


def record_at(data: bytes, offset: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at a byte offset of an archive."""
    return next(parse_archive(data, skip=offset))[:2]


def _number(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn else None


ENTRY = "page_id long, url string, stamp string, record_type string, refers_to long, payload_digest string, payload_bytes long, archive string, place long, offset long"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One index entry per record of the archives under ``path``, read back from their
    bytes; a response's digest and length are taken from its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ENTRY.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in ENTRY.split(", ")]
        for batch in batches:
            for where, data in zip(batch.column("path"), batch.column("content")):
                rows: list[tuple] = []
                archive = "/".join(where.as_py().split("/")[-2:])
                for place, (headers, block, offset) in enumerate(parse_archive(data.as_buffer())):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind = headers["WARC-Type"]
                    if kind == "response":
                        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                    else:
                        digest = headers["WARC-Payload-Digest"].partition(":")[2]
                        size = int(head.rpartition(b"Content-Length: ")[2])
                    rows.append((_number(headers.get("WARC-Record-ID")), headers.get("WARC-Target-URI"), headers["WARC-Date"], kind, _number(headers.get("WARC-Refers-To")), digest, size, archive, place, offset))
                columns = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, ENTRY)


class LoserTree:
    """K-way merge of sorted iterables: log2(k) comparisons an element.

    Inner nodes hold the loser of the match below them, ``tree[0]`` the overall
    winner; a run that is out loses every match. Equal elements come out in the
    order of their runs.
    """

    def __init__(self, runs: Iterable[Iterable], key: Callable = lambda x: x):
        self.runs, self.key = [iter(r) for r in runs], key
        self.heads = [self._next(i) for i in range(len(self.runs))]
        k = len(self.runs)
        self.tree = [-1] * max(k, 1)
        for leaf in range(k):
            self._seat(leaf)

    def _next(self, i: int) -> tuple | None:
        for item in self.runs[i]:
            return (self.key(item), i, item)
        return None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _seat(self, leaf: int) -> None:
        winner, node = leaf, (leaf + len(self.runs)) // 2
        while node > 0:
            if self.tree[node] < 0:  # still being built: wait here for the other side
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.runs and (head := self.heads[winner := self.tree[0]]) is not None:
            yield head[2]
            self.heads[winner] = self._next(winner)
            node, now = (winner + len(self.runs)) // 2, winner
            while node > 0:
                if self._beats(self.tree[node], now):
                    self.tree[node], now = now, self.tree[node]
                node //= 2
            self.tree[0] = now


def merge_runs(index: DataFrame, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """Globally ordered capture histories from locally sorted runs.

    ``index`` as from ``read_index``; adds ``key``. Output partitions are
    consecutive ranges of (key, stamp, page_id), each sorted.
    """
    keyed = index.withColumn("key", url_key(F.col("url")))
    at = {n: k for k, n in enumerate(keyed.columns)}

    def order(row: tuple) -> tuple:
        page = row[at["page_id"]]
        return (row[at["key"]], row[at["stamp"]], page is not None, page or 0)

    def entries(slices: list[pa.RecordBatch]) -> Iterator[tuple]:
        last = None
        for batch in slices:
            for start in range(0, batch.num_rows, READ_AHEAD):
                for row in zip(*(c.to_pylist() for c in batch.slice(start, READ_AHEAD).columns)):
                    if last is not None and order(row) < last:
                        raise ValueError(f"the run of {row[at['archive']]} is not sorted")
                    last = order(row)
                    yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list[pa.RecordBatch]] = []
        last = schema = None
        for batch in batches:
            names = batch.column(0).to_pylist()
            own = batch.select(list(at))
            schema = own.schema
            cuts = [k for k in range(1, len(names)) if names[k] != names[k - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(names)]):
                if b > a and names[a] != last:
                    runs.append([])
                    last = names[a]
                if b > a:
                    runs[-1].append(own.slice(a, b - a))
        for rows in _batched(LoserTree(map(entries, runs), order), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    n = index.count()
    spread = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-n // range_entries), min(spread, -(-n // (range_entries // 10 or 1))))
    ordered = (
        keyed.select(F.regexp_extract("archive", ARCHIVE, 1).alias("run"), F.regexp_extract("archive", ARCHIVE, 2).cast("long").alias("file"), *keyed.columns)
        .repartitionByRange(ranges, "key", "stamp", "page_id", "archive")
        .sortWithinPartitions("run", "file", "place")
    )
    return ordered.mapInArrow(run, keyed.schema)


def _batched(items: Iterable, size: int) -> Iterator[Sequence]:
    held: list = []
    for item in items:
        held.append(item)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def archive_and_merge(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 100) -> DataFrame:
    """Write the archives, read them back, merge their index runs."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return merge_runs(written(read_index(spark, path), "capture-index"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
