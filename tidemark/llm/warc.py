"""WARC archives of web pages with a two-level capture index.

Writing. Payloads of ``MIN_REVISIT`` bytes or more that occur again become revisit records that
refer to the page with the smallest page_id among them. A page meets the first page of its payload
in a join that is salted, so that a hot payload spreads, and the task that has it appends records to
an archive of about ``ARCHIVE_BYTES``; each archive is one row and so one file of Spark's text
writer, compressed whole. No order is left to the writer. Offsets count bytes of the uncompressed
archive, whose bounded size is what a read costs.

Index. Offsets are found by walking the archives as they were written. Captures are sorted by
reversed-host URL key (``com,example,www)/path``) and cut into blocks of ``BLOCK_LINES`` lines, each
compressed: the first level. The second is a sparse directory with the first and last key of each
block, in sorted pages. ``lookup`` and ``read_back`` find keys by binary search in a page of the
directory, then in the lines of just the blocks found, and then read the byte ranges: ``lookup`` those
of a list of URLs from just their archives, ``read_back`` those of a table of URLs.

Defined results: null html is an empty payload; null url has the empty key; a null page_id is never
referred to while another page has the payload; rows that repeat a page_id and payload are all
responses or all revisits alike; extra columns are ignored; empty tables give empty archives; a very
long page makes its archive that much longer.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shared_folder, stored

MIN_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
BLOCK_LINES = 256
#: Blocks in a page of the directory.
PAGE_BLOCKS = 64
#: Over so many tasks the pages of one payload are spread.
SALT = 16
#: Up to so many ranges (some 50 bytes each) are sent to the archives; more meet them in a shuffle.
MOST_SENT = 1_000_000
#: Up to so many archives are opened by name; for more, all are listed and joined.
MOST_OPENED = 1000
DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"

_BLOCKS = "part int, block int, first_key string, last_key string, lines int, bytes binary"
_BLOCKS_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()), ("lines", pa.int32()), ("bytes", pa.binary())])
_PAGES = "part int, page long, blocks array<int>, first_keys array<string>, last_keys array<string>"
_LED_ARROW = pa.schema([("part", pa.int32()), ("page", pa.int64()), ("key", pa.string())])
_HITS_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("wanted", pa.list_(pa.string()))])


def url_key(url: Column) -> Column:
    """The sort key of a URL: host labels reversed and joined by commas, ``)``, then the rest."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]", "")
    bare = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1))
    rest = F.regexp_extract(bare, r"^[^/?#]*(.*)$", 1)
    labels = F.array_join(F.reverse(F.split(F.regexp_replace(host, r":\d+$", ""), r"\.")), ",")
    return F.when(host == "", F.concat(F.lit(")"), rest)).otherwise(F.concat(labels, F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest)))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """head (all of a record before the payload), payload (null for a revisit) of every page."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    again = base.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = again.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    joined = salted.join(again.hint("shuffle_hash"), ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat_ws(EOL, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=UTF-8"), F.concat(F.lit("Content-Length: "), F.col("n").cast("string")), F.lit(EOL))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "")
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first")), F.lit(EOL), F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(F.lit(None))
    head = F.concat_ws(
        EOL,
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        refers,
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
        F.concat(F.lit(EOL), http),
    )
    return joined.select(head.alias("head"), F.when(~revisit, F.col("html")).alias("payload"))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write the records of all pages; the folder of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size = 0
        for batch in batches:
            for head, payload in zip(batch.column("head").to_pylist(), batch.column("payload").to_pylist()):
                held += [head, payload or "", EOL, EOL]
                size += len(head) + len(payload or "")
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"value": ["".join(held[:-1])]})  # the writer adds the last line end
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"value": ["".join(held[:-1])]})

    path = shared_folder(pages.sparkSession, "warc")
    records(pages).mapInArrow(run, "value string").write.option("lineSep", EOL).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)
    return path


def _archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """archive (the file's name) and content of the files in a folder, or of the given ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(paths)
    return files.select(F.substring_index("path", "/", -1).alias("archive"), "content")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """url, page_id, digest, archive, offset, length and key of every record, from the archives themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
                data, at, out = zlib.decompress(content.as_buffer(), 31), 0, []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at)
                    fields = dict(x.split(": ", 1) for x in data[at:end].decode().split(EOL)[1:])
                    length = end + 4 + int(fields["Content-Length"]) + 4 - at
                    page = fields["WARC-Record-ID"][len("<urn:x-page:") : -1]
                    out.append((fields["WARC-Target-URI"], None if page == "none" else int(page), fields["WARC-Payload-Digest"].removeprefix("sha256:"), archive, at, length))
                    at += length
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ENTRY_ARROW)], schema=_ENTRY_ARROW)

    found = _archives(spark, path).mapInArrow(run, _ENTRY).withColumnRenamed("key", "url")
    return found.withColumn("key", url_key(F.col("url")))


def write_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> str:
    """Write the compressed blocks in key order, and their directory beside them; the folder of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal block, held
            data = zlib.compress("\n".join("\t".join(x) for x in held).encode(), 6)
            row = [[part], [block], [held[0][0]], [held[-1][0]], [len(held)], [data]]
            block, held = block + 1, []
            return pa.RecordBatch.from_pydict(dict(zip(_BLOCKS_ARROW.names, row)), schema=_BLOCKS_ARROW)

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(line)
                if len(held) == block_lines:
                    yield flush()
        if held:
            yield flush()

    path = shared_folder(captures.sparkSession, "capture-index")
    lines = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "archive", "offset")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines.select("key", *[text(c).alias(c) for c in ("page_id", "digest", "archive", "offset", "length")]).mapInArrow(run, _BLOCKS).write.parquet(f"{path}/blocks")
    some = captures.sparkSession.read.schema(_BLOCKS).parquet(f"{path}/blocks").select("part", "block", "first_key", "last_key", F.floor(F.col("block") / PAGE_BLOCKS).alias("page"))
    column = lambda c: F.transform("rows", lambda r: r[c]).alias(f"{c}s")
    pages = some.groupBy("part", "page").agg(F.sort_array(F.collect_list(F.struct("block", "first_key", "last_key"))).alias("rows"))
    pages.select("part", "page", column("block"), column("first_key"), column("last_key")).write.parquet(f"{path}/directory")
    return path


_ENTRY = "key string, page_id long, digest string, archive string, offset long, length long"
_ENTRY_ARROW = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _parsed(lines: list[str]) -> pa.RecordBatch:
    rows = [x.split("\t") for x in lines]
    cast = lambda x: int(x) if x else None
    columns = [[r[0] for r in rows], [cast(r[1]) for r in rows], [r[2] for r in rows], [r[3] for r in rows], *[[int(r[k]) for r in rows] for k in (4, 5)]]
    return pa.RecordBatch.from_pydict(dict(zip(_ENTRY_ARROW.names, columns)), schema=_ENTRY_ARROW)


def found_entries(spark: SparkSession, index: str, urls: DataFrame) -> DataFrame:
    """The capture lines of all values of ``url``, by binary search in the directory, then in blocks.

    The bounds of the directory's pages (one for each ``PAGE_BLOCKS`` blocks) go to every task and lead each
    key to its page; the keys of a page meet it in one group, and those of a block meet that block only.
    """
    directory = spark.read.schema(_PAGES).parquet(f"{index}/directory")
    bounds = directory.select("part", "page", F.element_at("first_keys", 1).alias("first"), F.element_at("last_keys", -1).alias("last")).collect()
    bounds.sort(key=lambda r: (r["part"], r["page"]))  # parts are ranges of keys in order
    first, last, place = [r["first"] for r in bounds], [r["last"] for r in bounds], [(r["part"], r["page"]) for r in bounds]

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(*place[i], k) for k in batch.column("key").to_pylist() for i in range(bisect.bisect_left(last, k), bisect.bisect_right(first, k))]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*hits), _LED_ARROW)], schema=_LED_ARROW)

    def search(led: pa.Table, pages: pa.Table) -> pa.Table:
        hits: dict[tuple[int, int], list[str]] = {}
        for row in pages.to_pylist():
            for k in sorted(led.column("key").to_pylist()):
                for i in range(bisect.bisect_left(row["last_keys"], k), bisect.bisect_right(row["first_keys"], k)):
                    hits.setdefault((row["part"], row["blocks"][i]), []).append(k)
        return pa.Table.from_pydict({"part": [p for p, _ in hits], "block": [b for _, b in hits], "wanted": list(hits.values())}, schema=_HITS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, wanted in zip(batch.column("bytes"), batch.column("wanted").to_pylist()):
                lines = zlib.decompress(data.as_py()).decode().split("\n")
                keys = [x[: x.index("\t")] for x in lines]
                found = [x for k in wanted for x in lines[bisect.bisect_left(keys, k) : bisect.bisect_right(keys, k)]]
                if found:
                    yield _parsed(found)

    led = urls.select(url_key(F.col("url")).alias("key")).distinct().mapInArrow(lead, "part int, page long, key string")
    hits = led.groupBy("part", "page").cogroup(directory.groupBy("part", "page")).applyInArrow(search, "part int, block int, wanted array<string>")
    blocks = spark.read.schema(_BLOCKS).parquet(f"{index}/blocks").select("part", "block", "bytes")
    return blocks.join(hits, ["part", "block"]).select("bytes", "wanted").mapInArrow(run, _ENTRY)


def read_ranges(files: DataFrame, ranges: DataFrame, count: int) -> DataFrame:
    """The records at the byte ranges of ``ranges`` in ``files`` (of ``_archives``): archive, offset and the record's bytes.

    Ranges are gathered by archive; an archive holds about ``ARCHIVE_BYTES``, so both are bounded.
    ``count``: how many ranges there are.
    """
    ranges = ranges.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content, at in zip(batch.column("archive").to_pylist(), batch.column("content"), batch.column("at").to_pylist()):
                data = zlib.decompress(content.as_buffer(), 31)
                rows = [data[r["offset"] : r["offset"] + r["length"]] for r in at]
                yield pa.RecordBatch.from_pydict({"archive": [archive] * len(at), "offset": [r["offset"] for r in at], "record": rows}, schema=pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record", pa.binary())]))

    ranges = F.broadcast(ranges) if count <= MOST_SENT else ranges
    return files.join(ranges, "archive").mapInArrow(run, "archive string, offset long, record binary")


def parsed_records(ranges: DataFrame) -> DataFrame:
    """page_id, payload (null for a revisit), its size and digest, type and referred page of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: None if urn in ("", "none") else int(urn)
        for batch in batches:
            out: list[tuple] = []
            for raw in batch.column("record"):
                raw = raw.as_py()
                head, _, rest = raw.partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode().split(EOL)[1:])
                body = rest[: int(fields["Content-Length"])]
                if len(rest) != len(body) + 4 or raw[:10] != b"WARC/1.0\r\n":
                    raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
                http, _, payload = body.partition(b"\r\n\r\n")
                size = int(http.decode().rpartition("Content-Length: ")[2])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                kind = fields["WARC-Type"]
                page = number(fields["WARC-Record-ID"][len("<urn:x-page:") : -1])
                refers = number(fields.get("WARC-Refers-To", "")[len("<urn:x-page:") : -1])
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {page} does not have its digest")
                out.append((page, fields["WARC-Target-URI"], payload.decode() if kind == "response" else None, size, digest, kind, refers))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(_RECORD_ARROW.names, map(list, zip(*out)))), schema=_RECORD_ARROW)

    return ranges.select("record").mapInArrow(run, "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long")


_RECORD_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def archived(pages: DataFrame) -> tuple[str, str]:
    """Write archives and their index; both folders."""
    path = write_archives(pages)
    return path, write_index(captures(pages.sparkSession, path))


def lookup(spark: SparkSession, path: str, index: str, urls: list[str]) -> DataFrame:
    """The records captured for the given URLs; only the archives that hold them are read."""
    found = stored(found_entries(spark, index, spark.createDataFrame([(u,) for u in urls], "url string")), "capture-lookup")
    names = [r["archive"] for r in found.select("archive").distinct().limit(MOST_OPENED + 1).collect()]
    if not names:
        return parsed_records(spark.createDataFrame([], "record binary"))
    return parsed_records(read_ranges(_archives(spark, [f"{path}/{n}" for n in names] if len(names) <= MOST_OPENED else path), found, found.count()))


def read_back(spark: SparkSession, path: str, index: str, urls: DataFrame | None = None) -> DataFrame:
    """The records captured for all values of ``url``, each found through the directory and its block.

    Without ``urls``, for all URLs that the archives name.
    """
    if urls is None:
        urls = captures(spark, path).select(F.col("url"))
    most = spark.read.schema(_BLOCKS).parquet(f"{index}/blocks").agg(F.sum("lines")).first()[0] or 0
    return parsed_records(read_ranges(_archives(spark, path), found_entries(spark, index, urls), most))
