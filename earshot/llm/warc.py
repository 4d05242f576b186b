"""WARC archives of pages with an index of captures merged from sorted runs.

Each task writes its records as WARC files in order of URL key and time, so the captures of a file are a sorted run
of the index. Reading the archives back gives the runs; ranges of the key go to tasks, and each task merges the
slices of the runs that fall into its range with a loser tree. Tasks in order hold the whole index in order.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored

#: Payloads below this many bytes are never revisits.
LEAST_PAYLOAD = 100
#: Records of a file at most; a reader holds a file as it is on disk, and one record of it inflated.
RECORDS_PER_FILE = 5_000
#: Captures of a range of the index that a task merges.
RANGE = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "page_id bigint, url string, url_key string, captured string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, run string, offset bigint"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the top level down, without www, then path and query in lower case; null counts as empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"#.*$", ""), r"^www\.", "")
    host = F.regexp_extract(bare, r"^[^/?]*", 0)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(bare, r"^[^/?]*", ""))


def with_originals(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """``pages`` (page_id, url, payload) with payload_bytes, payload_digest and refers_to: the smallest page_id of the same payload where that is another page.

    Rows that share the smallest id are all originals; a null id is never one unless no other row has the payload.
    """
    sized = pages.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha2("payload", 256))
    several = sized.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    # Stored, so that the join deals rows out anew and can split a payload that very many pages share.
    return sized.join(stored(several, "originals"), "payload_digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def record(page: dict[str, Column]) -> Column:
    """The bytes of a WARC record, as a string without the last line feed, which the text writer adds."""
    revisit = page["refers_to"].isNotNull()
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), page["payload_bytes"].cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(page["payload"])
    length = (F.octet_length(head) + F.octet_length(body)).cast("string")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(page["page_id"]),
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(page["url"], F.lit("")), r"[\x00-\x20]", "%20"),
        F.lit("\r\nWARC-Date: "), page["captured"],
        F.lit("\r\nWARC-Payload-Digest: sha256:"), page["payload_digest"],
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(page["refers_to"]))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length,
        F.lit("\r\n\r\n"), head, body, F.lit("\r\n\r"),
    )


def write_archives(pages: DataFrame, path: str, least: int = LEAST_PAYLOAD) -> None:
    """Write ``pages`` (page_id, url, html, optional timestamp column captured) as compressed WARC files below ``path``.

    Null html is an empty payload. Without times, captures are dated by page_id in seconds from the epoch. Dates are in
    UTC whatever the session's time zone; other columns, whatever their names, are not looked at. Payloads of any length
    are written whole; an empty table gives an archive without records.
    """
    time = F.col("captured") if "captured" in pages.columns else F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0)) % 4_000_000_000)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"), url_key(F.col("url")).alias("url_key"))
    dealt = with_originals(rows, least).sortWithinPartitions("url_key", "captured", "page_id")
    value = record({c: F.col(c) for c in ("page_id", "url", "captured", "payload", "payload_bytes", "payload_digest", "refers_to")})
    dealt.select(value.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def records(data: bytes | BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers in lower case, block) of each record of an uncompressed WARC file; a stream is held one record at a time."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    at = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no record at byte {at}")
        size, headers = len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
            size += len(line)
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, headers, block
        at += size + len(line) + n + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures (CAPTURES) in the WARC files below ``path``. A response's digest and size are taken from its payload, which must agree with its header."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def page(name: str | None) -> int | None:
        number = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for at, headers, block in records(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{name.as_py()}: the payload at byte {at} is not what its header says")
                    rows.append((page(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-date"], kind, digest, size, page(headers.get("warc-refers-to")), name.as_py(), at))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["page_id", "url", "captured", "record_type", "payload_digest", "payload_bytes", "refers_to", "run", "offset"])

    schema = "page_id bigint, url string, captured string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, run string, offset bigint"
    rows = files.mapInArrow(parse, schema)
    return rows.withColumn("url_key", url_key(F.col("url"))).select(*(x.split()[0] for x in CAPTURES.split(", ")))


class LoserTree:
    """Merge of sorted runs: each inner node holds the loser of its match, the winner goes up; the next item of a run replays one path only."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, max(len(runs), 1)
        self.at = [0] * self.k
        self.losers = [-1] * self.k
        for run in range(self.k):
            self._replay(run)

    def _head(self, run: int):
        return self.runs[run][self.at[run]] if run < len(self.runs) and self.at[run] < len(self.runs[run]) else None

    def _replay(self, run: int) -> None:
        node, mine = (run + self.k) // 2, self._head(run)
        while node > 0:
            rival = self.losers[node]
            if rival == -1 and self._filling:
                self.losers[node] = run  # the first to come here waits for the other side
                return
            other = self._head(rival) if rival >= 0 else None
            if other is not None and (mine is None or (other, rival) < (mine, run)):
                self.losers[node], run, mine = run, rival, other
            node //= 2
        self.losers[0] = run

    @property
    def _filling(self) -> bool:
        return self.losers[0] == -1

    def __iter__(self):
        while True:
            run = self.losers[0]
            head = self._head(run)
            if head is None:
                return
            yield run, head
            self.at[run] += 1
            self._replay(run)


def merged_index(captures: DataFrame) -> DataFrame:
    """``captures`` in global order of (url_key, captured, page_id, run, offset): partition after partition, rows within it in order.

    Ranges are cut by the whole key, so a URL with very many captures spans partitions, and their number follows the
    captures, so that a task can hold its range. The captures are stored once: the archives are read once for the ranges'
    bounds and for the rows. Within a range only the runs' own order is restored; the tree merges them.
    """
    columns = captures.columns
    captures = stored(captures, "captures")
    ranges = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), captures.count() // RANGE + 1)
    ranged = captures.repartitionByRange(ranges, "url_key", "captured", "page_id", "run", "offset")
    ordered = ranged.sortWithinPartitions("run", "offset")
    schema = captures.schema

    def merge(batches):
        tables = list(batches)
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        run, key, time, page, offset = (table.column(c).to_pylist() for c in ("run", "url_key", "captured", "page_id", "offset"))
        runs: list[list[tuple]] = []
        for i in range(len(run)):
            if not i or run[i] != run[i - 1]:
                runs.append([])
            runs[-1].append((key[i], time[i], page[i] is not None, page[i] or 0, run[i], offset[i], i))
        yield from table.take(pa.array([head[-1] for _, head in LoserTree(runs)], pa.int64())).combine_chunks().to_batches()

    return ordered.select(*columns).mapInArrow(merge, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    index = merged_index(read_archives(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key")


OP7_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, url, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d),
u AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://', ''), '#.*$', ''), '^www\.', '') AS bare FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       array_to_string(list_reverse(string_split(regexp_extract(bare, '^[^/?]*'), '.')), ',') || ')' || regexp_replace(bare, '^[^/?]*', '') AS url_key
FROM u
"""
