"""WARC archives and their merged index.

Pages become WARC/1.1 records: the first of equal payloads is a response, later ones are revisits that refer to it. Spark's
text writer puts records behind each other into gzip archives of bounded size. Reading an archive back gives its captures,
sorted by URL key and time: a local run. Runs are dealt to ranges of the composite key and each range is merged with a
loser tree, so capture histories come out in global order, also where one URL fills many ranges.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import pieces, utf8

CRLF = "\r\n"
#: Payloads shorter than this are never replaced by a revisit.
SMALLEST_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
EPOCH = 1_704_067_200
CAPTURES = "url_key string, captured long, record_id string, archive string, position long, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One text ``value`` per page: the WARC record without its closing empty lines, which the writer's separator adds.

    Among equal payloads of at least SMALLEST_REVISIT bytes the smallest id answers; null ids come last and, if there is no
    other, all answer. A null payload is empty. Line ends within a URL are percent-encoded; a null URL gives no target line.
    """
    p = pages.select(F.col(page_id).cast("string").alias("_id"), F.col(page_id).alias("_n"), F.col(url).cast("string").alias("_url"),
                     F.coalesce(F.col(html).cast("string"), F.lit("")).alias("_html"), F.sha2(utf8(html), 256).alias("_sha"), F.length(utf8(html)).alias("_bytes"))
    firsts = (p.where(F.col("_bytes") >= SMALLEST_REVISIT).groupBy(F.col("_sha").alias("_s")).agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_c"))
              .where("_c > 1 AND _first IS NOT NULL").select("_s", "_first"))
    p = p.join(firsts, F.col("_sha") == F.col("_s"), "left").withColumn("_revisit", F.col("_first").isNotNull() & ~F.col("_n").eqNullSafe(F.col("_first")))
    clean = F.regexp_replace(F.regexp_replace(F.col("_url"), "\r", "%0D"), "\n", "%0A")
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col("_n").cast("long"), F.lit(0)), F.lit(1 << 30))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(F.col("_revisit"), http).otherwise(F.concat(http, F.col("_html")))
    size = F.length(http) + F.when(F.col("_revisit"), 0).otherwise(F.col("_bytes"))
    ident = F.coalesce(F.concat(F.lit("<urn:page:"), F.col("_id"), F.lit(">")), F.lit("<urn:page>"))
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(F.col("_revisit"), "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), ident),
            F.concat(F.lit("WARC-Date: "), when), F.concat(F.lit("WARC-Target-URI: "), clean), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("_sha")),
            F.concat(F.lit("WARC-Payload-Length: "), F.col("_bytes").cast("string")),
            F.when(F.col("_revisit"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("_first").cast("string"), F.lit(">"))),
            F.when(F.col("_revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), size.cast("string"))]
    return p.select(F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), block).alias("value"))


def write_archives(pages: DataFrame, folder: str, mean_bytes: int = 8_192, **names: str) -> None:
    """Gzip archives of about ARCHIVE_BYTES, unpacked, in a folder that all executors reach."""
    (records(pages, **names).write.option("lineSep", CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // max(1, mean_bytes))).text(folder))


def url_key(url: str | None) -> str:
    """The host's labels from the last on, then path and query in lower case; without scheme, ``www``, port and fragment."""
    if not url:
        return ""
    try:
        at = urlsplit(url.strip())
        host = (at.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}){at.path or '/'}{'?' + at.query if at.query else ''}".lower()


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, header fields, block) of each record; raises where lengths and separators disagree."""
    at, sep = 0, b"\r\n\r\n"
    while at < len(data):
        end = data.index(sep, at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        yield at, fields, data[end + 4:end + 4 + n]
        at = end + 4 + n
        if data[at:at + 4] != sep:
            raise ValueError(f"record before byte {at} is not closed")
        at += 4


def _capture(name: str, at: int, fields: dict[str, str], block: bytes) -> tuple:
    kind, sha, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["WARC-Payload-Length"])
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4:]
        if hashlib.sha256(payload).hexdigest() != sha or len(payload) != size:
            raise ValueError(f"payload at {name}:{at} does not match its digest")
    url = fields.get("WARC-Target-URI")
    captured = int(np.datetime64(fields["WARC-Date"].rstrip("Z"), "s").astype(int))
    return url_key(url), captured, fields["WARC-Record-ID"], name, at, url, kind, size, sha, fields.get("WARC-Refers-To")


def local_runs(archives: DataFrame) -> DataFrame:
    """Captures of each archive (``path``, ``content``), sorted by URL key and time: one run per archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                name = path.rsplit("/", 1)[-1]
                rows = sorted((_capture(name, *r) for r in parse(zlib.decompress(content.as_py(), 31))), key=lambda r: r[:3])
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                columns = list(zip(*rows)) or [()] * len(kinds)
                schema = schema or pa.schema([(c.split()[0], k) for c, k in zip(CAPTURES.split(", "), kinds)])
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], schema=schema)

    return archives.select("path", "content").mapInArrow(run, CAPTURES)


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so each step replays one path to the root.

    ``runs`` are sequences of keys in ascending order; iterating gives (run, place in run).
    """

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.tree = [-1] * max(1, len(runs))
        for k in range(len(runs)):
            self._climb(k)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.at[a] < len(self.runs[a]), self.at[b] < len(self.runs[b])
        if not (x and y):
            return x or not y and a < b
        p, q = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return p < q or p == q and a < b

    def _climb(self, winner: int) -> None:
        node = (winner + len(self.runs)) // 2
        while node:
            held = self.tree[node]
            if held < 0:  # first match at this node: wait for the other side
                self.tree[node] = winner
                return
            if self._less(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        for _ in range(sum(map(len, self.runs))):
            k = self.tree[0]
            yield k, self.at[k]
            self.at[k] += 1
            self._climb(k)


def merge_runs(runs: DataFrame, rows_per_range: int = 50_000) -> DataFrame:
    """All captures in global order: ``range``, ``place`` within it, and the captures' columns.

    Ranges are cut by sampled quantiles of (URL key, time, record, archive, position), so a URL with many captures spans
    several. A task holds one range, about ``rows_per_range`` narrow rows, as slices of runs.
    """
    n = pieces(runs.count(), rows_per_range, runs.sparkSession.sparkContext.defaultParallelism)
    order = ["url_key", "captured", "record_id", "archive", "position"]
    dealt = runs.repartitionByRange(n, *order).sortWithinPartitions("archive", *order).withColumn("range", F.spark_partition_id())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        names = t.column("archive").to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]])
        keys = list(zip(*(t.column(c).to_pylist() for c in order)))
        slices = [keys[a:b] for a, b in zip(edges[:-1], edges[1:])]
        took = np.fromiter((edges[k] + i for k, i in LoserTree(slices)), np.int64, len(keys))
        t = t.take(pa.array(took)).append_column("place", pa.array(np.arange(len(keys))))
        yield from t.to_batches()

    return dealt.mapInArrow(merge, f"{CAPTURES}, `range` int, place long")
