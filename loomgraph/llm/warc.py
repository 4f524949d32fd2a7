"""WARC archives with a two-level capture index.

An archive is a file of gzip members, one for each record, in the folder that driver and executors
share. The index has two levels: lines (reversed-host key, page, archive, offset, length) in order of
key, cut into compressed blocks; and a sparse directory with each block's first key. What a lookup finds
is read from the files by offset and length.

Files are opened through pyarrow, so the shared folder may be a mounted one, HDFS or an object store. A
task that is run again writes a file of another name; only names that the finished task reported count.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pf
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import shared_dir, slices, stored

SMALL = 1000  # payloads below this many bytes are never revisits
BLOCK_LINES = 1000  # index lines in a compressed block
RANGE_LINES = 1 << 18  # index lines in a key range, which one task searches; ranges' first keys are all that a lookup broadcasts
READ_BYTES = 64 << 20  # bytes that a task reads from archives
STAMP = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """The sort key of a URL: scheme and leading www dropped, host reversed and lower-cased, then port, path and query; a fragment goes. Blanks and control characters are escaped, so that a key is one word of an index line."""
    rest = (url or "").split("#", 1)[0].split("://", 1)[-1]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].lower().rpartition("@")[2], rest[cut:]
    host, _, port = host.partition(":")
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (path or "/")
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", key)


def one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def record(page_id: int, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit holds the response's head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {STAMP}",
        f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, in lower case, and its payload (what follows the HTTP head)."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def plan_records(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to): of equal payloads of at least ``small`` bytes, the largest page_id is the response."""
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    body = body.withColumn("n", F.octet_length("payload")).withColumn("digest", F.sha1("payload")).withColumn("strong", F.sha2("payload", 256))
    last = body.where(F.col("n") >= small).groupBy("strong", "n").agg(F.max("page_id").alias("last"))
    kind = F.when(F.col("page_id") < F.col("last"), "revisit").otherwise("response")
    return body.join(last, ["strong", "n"], "left").select("page_id", "url", "payload", "digest", kind.alias("kind"), F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def opened(path: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pf.LocalFileSystem(), path)


def write_archives(planned: DataFrame, folder: str | None = None) -> DataFrame:
    """(archive, offset, length, url_key, page_id) of each record: each task of the input writes one archive file to ``folder``, by default a new one in the shared folder."""
    folder = folder or f"{shared_dir(planned.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        name, at, out = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for part in slices(batch, "payload"):
                rows = []
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    member = record(*row)
                    out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(member)
                    rows.append((name, at, len(member), url_key(row[1]), row[0]))
                    at += len(member)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["archive", "offset", "length", "url_key", "page_id"])
        if out:
            out.close()

    lines = stored(planned.mapInArrow(run, "archive string, offset long, length long, url_key string, page_id long"), "archives")
    return lines.withColumn("archive", F.concat(F.lit(f"{folder}/"), "archive"))


def write_index(archives: DataFrame, block_lines: int = BLOCK_LINES, range_lines: int = RANGE_LINES) -> DataFrame:
    """(key_range, block_no, first_key, first_page, n, archives, block): compressed blocks of index lines in order of key, in ranges of about ``range_lines``; a line names its archive by its place in the block's list."""
    spark = archives.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-archives.count() // range_lines))
    lines = archives.select("url_key", "page_id", "archive", "offset", "length")
    order = ["url_key", "page_id", "archive", "offset"]  # so that a key of very many captures spans ranges
    lines = lines.repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def run(batches):
        key_range, number, held = TaskContext.get().partitionId(), 0, []

        def block(rows):
            names = sorted({r[2] for r in rows})
            at = {n: k for k, n in enumerate(names)}
            text = "\n".join(f"{k} {p} {at[a]} {o} {n}" for k, p, a, o, n in rows)
            columns = [[key_range], [number], [rows[0][0]], [rows[0][1]], [len(rows)], [zlib.compress("\n".join(names).encode(), 6)], [zlib.compress(text.encode(), 6)]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key_range", "block_no", "first_key", "first_page", "n", "archives", "block"])

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), *(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)
            for k, *rest in rows:
                held.append((k, *rest))
                if len(held) == block_lines:
                    yield block(held)
                    number, held = number + 1, []
        if held:
            yield block(held)

    return stored(lines.mapInArrow(run, "key_range int, block_no int, first_key string, first_page long, n int, archives binary, block binary"), "index")


def block_lines_of(archives: bytes, block: bytes) -> list[tuple[str, int, str, int, int]]:
    names = zlib.decompress(archives).decode().split("\n")
    return [(k, int(p), names[int(a)], int(o), int(n)) for k, p, a, o, n in (x.rsplit(" ", 4) for x in zlib.decompress(block).decode().split("\n"))]


def search(directory: list[tuple[str, int]], block_of, key: str, page: int) -> Iterator[tuple[str, int, int]]:
    """All captures of a key and page: binary search over the directory for the first block that may hold one, then within blocks for lines."""
    for at in range(max(0, bisect.bisect_left(directory, (key, page)) - 1), len(directory)):
        if directory[at] > (key, page):
            return
        lines = block_of(at)
        for i in range(bisect.bisect_left(lines, (key, page)), len(lines)):
            if lines[i][:2] != (key, page):
                return
            yield lines[i][2:]


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, archive, offset, length) of all captures of each wanted (url, page_id); a pair that is wanted twice is looked up once, and those not in the index are left out.

    Ranges' first keys, one for each 2**18 captures, tell each wanted key its range, or ranges where its captures fill several;
    in a range, keys and blocks meet, and binary searches over directory and block find the lines. A block is opened
    only when a key falls in it.
    """
    starts = [(r.k, r.p, r.key_range) for r in index.where("block_no = 0").select("key_range", F.col("first_key").alias("k"), F.col("first_page").alias("p")).collect()]
    starts.sort()
    heads = [s[:2] for s in starts]

    def ranged(batches):
        for batch in batches:
            rows = []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = url_key(url)
                first, last = max(0, bisect.bisect_left(heads, (key, page)) - 1), bisect.bisect_right(heads, (key, page))
                rows += [(starts[i][2], key, page) for i in range(first, last)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64()))], names=["key_range", "key", "page_id"])

    def found(wanted_rows, blocks):
        blocks = blocks.sort_by("block_no")
        directory = list(zip(blocks.column("first_key").to_pylist(), blocks.column("first_page").to_pylist(), strict=True))
        opened: dict[int, list] = {}

        def block_of(i):
            if i not in opened:
                opened.clear()
                opened[i] = block_lines_of(*(blocks.column(c)[i].as_py() for c in ("archives", "block")))
            return opened[i]

        rows = []
        for key, page in sorted(set(zip(wanted_rows.column("key").to_pylist(), wanted_rows.column("page_id").to_pylist(), strict=True))):
            rows += [(page, *hit) for hit in search(directory, block_of, key, page)]
        return pa.table({n: pa.array([r[k] for r in rows], pa.string() if n == "archive" else pa.int64()) for k, n in enumerate(["page_id", "archive", "offset", "length"])})

    pairs = wanted.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id")).where("page_id is not null")
    keys = pairs.mapInArrow(ranged, "key_range int, key string, page_id long").distinct()
    return keys.groupBy("key_range").cogroup(index.groupBy("key_range")).applyInArrow(found, "page_id long, archive string, offset long, length long")


def read_ranges(ranges: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records at ranges (archive, offset, length); a revisit's size is that of the response it refers to.

    Only ranges are shuffled, into runs of one archive after the other; each task opens its files and reads there.
    """
    ranges = stored(ranges.select("archive", "offset", "length"), "ranges")
    size = ranges.agg(F.sum("length")).first()[0] or 0
    tasks = max(ranges.sparkSession.sparkContext.defaultParallelism, -(-size // read_bytes))
    dealt = ranges.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches):
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if archive != name:
                    if file:
                        file.close()
                    fs, path = opened(archive)
                    name, file = archive, fs.open_input_file(path)
                fields, payload = parse(file.read_at(length, offset))
                page = int(fields["warc-record-id"][10:-1])
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                kind = fields["warc-type"]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"record {page}: the payload does not have its digest")
                rows.append((page, len(payload) if kind == "response" else None, digest, kind, int(fields["warc-refers-to"][10:-1]) if kind == "revisit" else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in schema.split(", ")])
        if file:
            file.close()

    read = stored(dealt.mapInArrow(run, schema), "records")
    sizes = read.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full"))
    revisits = read.where("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("no response was read for the revisit of page "), F.col("page_id").cast("string"))).cast("long")
    return read.where("record_type = 'response'").unionByName(revisits.select("page_id", F.coalesce("full", lost).alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write a record for each row of (page_id, url, html), index the archives, look every capture up and read it back.

    A null html is an empty payload, a null url an empty key. Rows that repeat a page id have a record and a
    result each: those of the largest id of a payload are all responses, and a revisit refers to their id. A row with
    a null id has no capture to look up and is left out. An empty table gives an empty one.
    """
    pages = pages.where("page_id is not null")
    archives = write_archives(plan_records(pages))
    index = write_index(archives)
    return read_ranges(lookup(index, pages))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_warc": op5_warc}
ORACLES = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
        FROM d""",
}
