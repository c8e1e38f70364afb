"""WARC archives with a two-level capture index.

Archives are uncompressed WARC/1.1 files, written by Spark's own text writer
(its record separator is the blank line that ends a WARC record), so any store
that Spark reaches will do.  A payload seen before is written as a ``revisit``
that refers to the response with the smallest page_id and carries only the HTTP
header.  The capture index sorts reversed-host URL keys globally, packs runs of
them into compressed blocks, and keeps a sparse directory with one row per
block, in shards as the sort left them.  Looking URLs up, one or a whole table
of them, binary-searches the shards' ranges and the directory, inflates the
blocks found, binary-searches their lines, and range-reads the records: by
positioned reads where the store is one that the workers can open themselves,
else by whole files of bounded size.

Defined cases.  A null html is an empty payload; payloads of at least
``least_bytes`` bytes (0: empty ones too) share a response.  Rows that repeat
the smallest page_id of a payload are all responses; a null page_id is never
smallest, and refers to the response like others (its group's rows are all
responses where no id is set).  A null url is written without target and sorts
first.  Very long pages go to files of their own class, so that no file passes
MOST_BYTES unless one page does.  An empty table gives an archive without
records and an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textkernel

#: What a file holds on average, what it may hold at most, and the bytes from which a record is a large one.
FILE_BYTES, MOST_BYTES, LARGE_BYTES = 16_000_000, 1_500_000_000, 1_000_000
BLOCK_LINES = 512
#: Keys that one task looks up in one shard, and keys of one block that travel together.
SHARD_KEYS, BLOCK_KEYS = 200_000, 2_000
#: Records closer than this are read at once, up to so many bytes.
GAP_BYTES, SPAN_BYTES = 65_536, 8_000_000
DATE = "2024-01-01T00:00:00Z"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"


def base32(hex_digest: Column) -> Column:
    """Base32 of a hexadecimal digest of 40 digits, five at a time."""
    def four(i: Column) -> Column:
        v = F.conv(F.substring(hex_digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(_ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query``: the host's labels reversed, so that a domain's captures are neighbours."""
    host = common.ascii_lower(F.regexp_extract(url, r"(?s)^[^:/?#]*://([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"(?s)^[^:/?#]*://[^/?#]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.regexp_replace(F.coalesce(key, F.lit("")), r"[\r\n\t]", " ")


def target(url: Column) -> Column:
    """The URL as the record states it."""
    return F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, bytes and the text of one WARC record (without the blank line that ends it) per page."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("_p"))
    rows = rows.withColumns({"_n": F.octet_length("_p"), "_sha": F.sha1("_p")})
    again = rows.filter(F.col("_n") >= least_bytes).groupBy("_sha").agg(F.count("*").alias("_c"), F.min("page_id").alias("_lead"))
    again = common.materialize(again.filter("_c > 1 and _lead is not null").select(F.col("_sha").alias("_s"), "_lead"), "repeats")
    rows = rows.join(common.small(again, again.count()), (F.col("_sha") == F.col("_s")) & (F.col("_n") >= least_bytes), "left")
    revisit = F.col("_lead").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_lead"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("_n").cast("string"), F.lit(_CRLF * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("_p")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))), F.coalesce(line("WARC-Target-URI", target(F.col("url"))), F.lit("")),
        line("WARC-Date", F.lit(DATE)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("_sha")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("_lead"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(_CRLF),
    )
    return rows.select("page_id", F.col("_n").alias("bytes"), F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write the archives under ``path``, in files of about FILE_BYTES and never over MOST_BYTES, but for a larger single record."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + 1000  # no less than the record's
    mean, most = pages.agg(F.avg(size), F.max(size)).first()
    rows = records(pages, least_bytes)
    small = F.octet_length("value") < LARGE_BYTES
    out = lambda df, per_file, mode: df.select("value").write.mode(mode).option("lineSep", _CRLF * 2).option("maxRecordsPerFile", max(1, int(per_file))).text(path)
    out(rows.filter(small), min(FILE_BYTES / (mean or 1), MOST_BYTES / LARGE_BYTES), "errorifexists")
    if (most or 0) >= LARGE_BYTES:
        out(rows.filter(~small), MOST_BYTES / most, "append")


_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], int, int, int] | None:
    """Header fields, start and end of the block, and where the next record starts; None at the end."""
    m = _HEAD.match(data, at)
    if not m:
        if data[at:].strip():
            raise ValueError(f"no record at byte {at}")
        return None
    fields = dict(x.split(": ", 1) for x in m[1].decode("utf-8").split(_CRLF) if x)
    end = m.end() + int(fields["Content-Length"])
    return fields, m.end(), end, end + 4


@textkernel.releasing
def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            data, at, rows = content.as_py(), 0, []
            while found := parse(data, at):
                fields, _, end, then = found
                rows.append((fields.get("WARC-Target-URI"), fields["WARC-Date"], path.as_py(), at, end - at))
                at = then
            yield pa.RecordBatch.from_pydict(dict(zip(("url", "date", "file", "offset", "length"), map(list, zip(*rows)) if rows else [[]] * 5, strict=True)), schema=_CAPTURE)


_CAPTURE = pa.schema([("url", pa.string()), ("date", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


@textkernel.releasing
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, line) rows to compressed blocks; a block ends with its partition at the latest."""
    keys: list[str] = []
    lines: list[str] = []

    def block() -> pa.RecordBatch:
        data = zlib.compress("\n".join(lines).encode("utf-8"), 6)
        out = pa.RecordBatch.from_pydict({"first_key": [keys[0]], "last_key": [keys[-1]], "lines": [len(lines)], "block": [data]})
        keys.clear()
        lines.clear()
        return out

    for batch in batches:
        for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            lines.append(line)
            if len(lines) == BLOCK_LINES:
                yield block()
    if lines:
        yield block()


def index(spark: SparkSession, path: str, index_path: str) -> None:
    """Build the blocks and their directory for the archives under ``path``."""
    common.ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = files.mapInArrow(_captures, "url string, date string, file string, offset bigint, length bigint")
    rows = rows.withColumn("key", url_key(F.col("url")))
    line = F.concat_ws("\t", "key", "date", "file", "offset", "length")
    rows = rows.select("key", "file", "offset", line.alias("line"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset").select("key", "line")
    blocks = rows.mapInArrow(_pack, "first_key string, last_key string, lines bigint, block binary")
    blocks.select("*", F.monotonically_increasing_id().alias("id"), F.spark_partition_id().alias("shard")).write.parquet(f"{index_path}/blocks")
    spark.read.parquet(f"{index_path}/blocks").select("shard", "first_key", "last_key", "id").write.parquet(f"{index_path}/directory")


def _between(firsts: list[str], lasts: list[str], key: str) -> range:
    """Places of the sorted ranges that may hold ``key``."""
    at = to = bisect_left(lasts, key)
    while to < len(firsts) and firsts[to] <= key:
        to += 1
    return range(at, to)


def _shards(firsts: list[str], lasts: list[str], shards: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, shards[at]) for k in batch.column(0).to_pylist() for at in _between(firsts, lasts, k)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["key", "shard"])


def _search(key: tuple, keys: pa.Table, directory: pa.Table) -> pa.Table:
    """The blocks of one shard that may hold the keys."""
    ranges = sorted(zip(directory["first_key"].to_pylist(), directory["last_key"].to_pylist(), directory["id"].to_pylist(), strict=True))
    firsts, lasts = [r[0] for r in ranges], [r[1] for r in ranges]
    found: dict[int, list[str]] = {}
    for k in keys["key"].to_pylist():
        for at in _between(firsts, lasts, k):
            found.setdefault(ranges[at][2], []).append(k)
    rows = [(i, ks[at : at + BLOCK_KEYS]) for i, ks in found.items() for at in range(0, len(ks), BLOCK_KEYS)]
    return pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "keys": pa.array([r[1] for r in rows], pa.list_(pa.string()))})


def _lines(block: bytes) -> list[list[str]]:
    return [x.split("\t") for x in zlib.decompress(block).decode("utf-8").split("\n")]


def _of(lines: list[list[str]], names: list[str], key: str) -> list[tuple[str, str, int, int]]:
    """The captures of ``key`` among a block's sorted lines."""
    return [(key, x[-3], int(x[-2]), int(x[-1])) for x in lines[bisect_left(names, key) : bisect_right(names, key)]]


@textkernel.releasing
def _inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, keys in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            lines = _lines(block.as_py())
            names = [x[0] for x in lines]
            rows = [r for k in keys for r in _of(lines, names, k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])


def locate(spark: SparkSession, index_path: str, keys: DataFrame) -> DataFrame:
    """key, file, offset, length of every capture of the URL keys ``keys.key``, by binary search."""
    common.ship(spark)
    directory = spark.read.parquet(f"{index_path}/directory")
    top = sorted(tuple(r) for r in directory.groupBy("shard").agg(F.min("first_key"), F.max("last_key")).select("min(first_key)", "max(last_key)", "shard").collect())  # a row per sorted partition
    firsts, lasts, shards = map(list, zip(*top, strict=True)) if top else ([], [], [])
    rows = common.materialize(keys.select("key").distinct().mapInArrow(partial(_shards, firsts, lasts, shards), "key string, shard int"), "shard-keys")
    salts = rows.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_KEYS).cast("int").alias("_salts"))
    salts = F.broadcast(salts.withColumnRenamed("shard", "_shard"))  # a row per sorted partition
    rows = rows.join(salts, F.col("shard") == F.col("_shard")).select("key", "shard", F.pmod(F.xxhash64("key"), F.col("_salts")).cast("int").alias("salt"))
    parts = directory.join(salts, F.col("shard") == F.col("_shard")).select("first_key", "last_key", "id", "shard", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt"))
    found = rows.groupBy("shard", "salt").cogroup(parts.groupBy("shard", "salt")).applyInArrow(_search, "id bigint, keys array<string>")
    found = found.withColumnRenamed("id", "_id")
    blocks = spark.read.parquet(f"{index_path}/blocks").select("id", "block")
    return blocks.join(found, F.col("id") == F.col("_id")).select("block", "keys").mapInArrow(_inflate, "key string, file string, offset bigint, length bigint")


def _read(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    fields, start, end, _ = parse(data)
    http, _, payload = data[start:end].partition(b"\r\n\r\n")
    urn = lambda x: int(x[10:-1]) if x[10:-1] else None
    kind = fields["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    else:
        size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"][5:]
    return urn(fields["WARC-Record-ID"]), size, digest, kind, urn(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _rows(records: list[bytes]) -> pa.RecordBatch:
    rows = [_read(r) for r in records]
    return pa.RecordBatch.from_pydict(dict(zip(_ROW.names, map(list, zip(*rows, strict=True)), strict=True)), schema=_ROW)


@textkernel.releasing
def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records by positioned reads; neighbours are read at once."""
    for batch in batches:
        for file, wanted in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            store, name = pyarrow.fs.FileSystem.from_uri(file)
            places = sorted((x["offset"], x["length"]) for x in wanted.as_py())
            with store.open_input_file(name) as f:
                k = 0
                while k < len(places):
                    to, begin, end = k + 1, places[k][0], sum(places[k])
                    while to < len(places) and places[to][0] - end <= GAP_BYTES and sum(places[to]) - begin <= SPAN_BYTES:
                        end = max(end, sum(places[to]))
                        to += 1
                    data = f.read_at(end - begin, begin)
                    yield _rows([data[o - begin : o - begin + n] for o, n in places[k:to]])
                    k = to


@textkernel.releasing
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same out of whole files."""
    for batch in batches:
        for content, wanted in zip(batch.column(0), batch.column(1), strict=True):
            view = memoryview(content.as_buffer())
            yield _rows([bytes(view[x["offset"] : x["offset"] + x["length"]]) for x in wanted.as_py()])


def opens(path: str) -> bool:
    """Whether Python workers can open the store themselves."""
    try:
        pyarrow.fs.FileSystem.from_uri(path)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def read(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the captures at ``places`` (file, offset, length)."""
    wanted = places.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("wanted"))  # as many as a file holds
    wanted = common.materialize(wanted, "wanted")
    files, weight = wanted.agg(F.count("*"), F.sum(F.size("wanted") * 16)).first()
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    if opens(path):
        tasks = max(1, min(files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), files // 8)))
        return wanted.repartition(tasks, "file").mapInArrow(_fetch, schema)
    wanted = F.broadcast(wanted) if (weight or 0) <= common.BROADCAST_BYTES else wanted
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return found.select("path", "content").join(wanted, F.col("path") == F.col("file")).select("content", "wanted").mapInArrow(_cut, schema)


class Lookup:
    """Single captures by URL: a binary search of the directory, one block, and a range read, all from the driver."""

    def __init__(self, spark: SparkSession, index_path: str, most_blocks: int = common.BROADCAST_ROWS):
        self.spark, self.path = spark, index_path
        directory = spark.read.parquet(f"{index_path}/directory")
        if directory.count() > most_blocks:
            raise ValueError(f"over {most_blocks} blocks: use locate(), or raise most_blocks")
        rows = sorted((r.first_key, r.last_key, r.id) for r in directory.collect())
        self.first, self.last, self.ids = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

    def find(self, url: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of the captures of ``url``."""
        key = self.spark.range(1).select(url_key(target(F.lit(url))).alias("k")).first().k
        out = []
        for at in _between(self.first, self.last, key):
            lines = _lines(self.spark.read.parquet(f"{self.path}/blocks").filter(F.col("id") == self.ids[at]).first().block)
            out += [r[1:] for r in _of(lines, [x[0] for x in lines], key)]
        return out

    def fetch(self, file: str, offset: int, length: int) -> bytes:
        """One record, by a positioned read through Hadoop's file system."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(file)
        stream = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(where)
        try:
            stream.seek(offset)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)))
        finally:
            stream.close()


def op10_warc(spark, sf_dir: str) -> DataFrame:
    at = f"{common.run_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = common.read(spark, sf_dir, "pages", "page_id", "url", "html")
    write(pages, f"{at}/archive")
    index(spark, f"{at}/archive", f"{at}/index")
    keys = pages.select(url_key(target(F.col("url"))).alias("key"))
    return read(spark, f"{at}/archive", locate(spark, f"{at}/index", keys))
