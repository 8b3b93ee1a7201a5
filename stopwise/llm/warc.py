"""WARC archives: writing, reading back, and merging local capture runs into one ordered index.

1. Every page becomes one record. Of pages with equal payloads the one with the smallest id is a
   response and the others are revisits that refer to it.
2. Archives are written by Spark's text writer with the record end as line separator, one file per
   task and not more than ``FILE_BYTES`` of average records each, so an archive can be read whole.
3. Reading an archive yields one locally sorted capture run: (url key, time, position, ...).
4. Runs are dealt out by ranges of (url key, time); in each range a loser tree merges the k runs.
   The ranges in order, and the rows in them, are the globally ordered capture histories. A url with
   very many captures spreads over several ranges, as its captures differ in time.

Defined results: a null html is an empty payload; a null url an empty target; line breaks in a url
are percent-encoded in the header. Pages that repeat the smallest id are all responses, and a page
without an id is a response. Rows that share an id are records of their own, each with its own payload. Payloads below ``min_bytes`` are always responses. An empty table gives
no archives and an empty index. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.urls import host_of, path_of
from stopwise.session import materialize, shared_dir

FILE_BYTES = 24_000_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: Captures carry no time of their own: the id counts seconds from here.
FIRST_CAPTURE = "2020-01-01 00:00:00"
RUN = (
    "url_key string, captured_at string, run string, position long, page_id long, "
    "payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def hex_sha1(text: Column) -> Column:
    return F.sha1(F.encode(text, "UTF-8"))


def base32_of(digest: Column) -> Column:
    """Upper-case base32 of a digest of 40 hex digits: five of them make four letters."""
    letters = []
    for group in range(8):
        value = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def url_key(url: Column) -> Column:
    """Sortable key: the host's labels from the top level down, then the path and query."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host_of(url), r"\.")), ","), F.lit(")"), path_of(url), query)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One column ``record``: the full text of each record without its end mark."""
    html = F.coalesce("html", F.lit(""))
    size = F.octet_length(html).cast("long")
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), hex_sha1(html).alias("digest"), size.alias("bytes"))
    digests = materialize(cut.where(F.col("bytes") >= min_bytes), "digests")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    # written, so that its size is known before the pages are joined: few revisits need no shuffle of payloads
    revisits = materialize(
        digests.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits"
    )
    url = F.coalesce("url", F.lit(""))
    payload = F.when(F.col("refers_to").isNull(), html).otherwise("")
    safe_url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    when = F.to_timestamp(F.lit(FIRST_CAPTURE)) + F.make_interval(secs=F.coalesce("page_id", F.lit(0)))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), safe_url),
        F.concat(F.lit("X-URL-Key: "), F.replace(F.replace(url_key(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of(F.col("digest"))),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
        F.concat(F.lit("X-Payload-Length: "), size.cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")),
    )
    # an id may repeat with another payload, so a revisit is known by both
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", hex_sha1(html).alias("digest"))
    known = named.join(revisits, ["page_id", "digest"], "left")
    return known.select(F.concat(lines, F.lit(END), payload).alias("record"))


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write the archives of ``pages`` below ``path``."""
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    per_file = max(1, min(10_000, int(FILE_BYTES // (mean + 1000))))
    writer = records(pages, min_bytes).write.option("lineSep", END).option("maxRecordsPerFile", per_file)
    writer.text(path)


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Position, headers and payload of each record of one archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = bytes(view[at:end]).decode("utf-8").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in head[1:])
        first = end + 4
        last = first + int(headers["Content-Length"])
        yield at, headers, bytes(view[first:last])
        if data[last : last + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut off")
        at = last + 4


def _page(urn: str | None) -> int | None:
    digits = urn[len("<urn:page:") : -1] if urn else ""
    return int(digits) if digits else None


def runs(spark: SparkSession, path: str) -> DataFrame:
    """One locally sorted capture run per archive; digests and sizes of responses are taken from the payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for at, head, payload in parse(content.as_py()):
                    kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"][5:], int(head["X-Payload-Length"])
                    if kind == "response":
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                            raise ValueError(f"record at byte {at} of {name} is damaged")
                    page, other = _page(head["WARC-Record-ID"]), _page(head.get("WARC-Refers-To"))
                    rows.append((head["X-URL-Key"], head["WARC-Date"], name.as_py(), at, page, size, digest, kind, other))
                rows.sort(key=lambda row: row[:4])
                yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, RUN)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in RUN.split(", ")]
    kinds = [pa.int64() if part.split()[1] == "long" else pa.string() for part in RUN.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, the winner stands at the top.

    Taking the winner replays one path of log2(k) matches.
    """

    def __init__(self, sources: list[Iterator[tuple]], key):
        self.sources, self.key, self.k = sources, key, len(sources)
        self.heads = [next(source, None) for source in sources]
        self.keys = [None if head is None else (key(head), i) for i, head in enumerate(self.heads)]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._seat(i)

    def _beats(self, a: int, b: int) -> bool:
        return self.keys[b] is None or (self.keys[a] is not None and self.keys[a] < self.keys[b])

    def _seat(self, i: int) -> None:
        """First matches: wait at the first free node, or go on with the winner."""
        node = (i + self.k) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._beats(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[winner := self.losers[0]] is not None:
            yield self.heads[winner]
            head = self.heads[winner] = next(self.sources[winner], None)
            self.keys[winner] = None if head is None else (self.key(head), winner)
            i, node = winner, (winner + self.k) // 2
            while node:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.losers[0] = i


def merge(index: DataFrame) -> DataFrame:
    """The runs of ``index`` as one table ordered by url key, time, archive and position."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                by_run.setdefault(row[2], []).append(row)
        order = lambda row: row[:4]
        for rows in by_run.values():
            # a shuffle may hand over the blocks of a run in any order; a sorted list costs one pass
            rows.sort(key=order)
        out = []
        for row in LoserTree([iter(rows) for rows in by_run.values()], order):
            out.append(row)
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartitionByRange(parts, "url_key", "captured_at", "position").mapInArrow(merged, RUN)


def capture_histories(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write, read back and merge: one row per page (see RUN), in order of url key and time."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    write(pages, path, min_bytes)
    return merge(materialize(runs(spark, path), "runs"))
