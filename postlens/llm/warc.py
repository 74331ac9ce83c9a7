"""Operator 2: WARC archives with revisit records, read back along a verified chain of boundaries.

Writing.  A record is header lines, a blank line, the payload and two line ends; the last two are the
line separator of Spark's text sink, which commits files atomically and writes to any Hadoop store.
Of records with equal payloads (by SHA-256, at least ``REVISIT_BYTES`` long) that with the smallest
page_id is a response, the others are revisits without a payload.

Reading.  Files are cut into byte ranges.  For every place in a range that looks like the start of a
record (the magic, also inside payloads) a task follows ``Content-Length`` from record to record and
emits one link: the candidate and the first place at or after the range's end that its chain reaches.
Pointer jumping over these links from offset 0 of each file — doubling, so the rounds grow with the
logarithm of the ranges per file — finds where the true chain enters each range.  A second task per
range walks from that verified entry and parses its records; magic inside payloads is never reached.
A header is read to its blank line, however long.  A file whose chain does not reach its end (a
truncated or damaged record) raises an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import common
from postlens.session import checkpoint_dir

REVISIT_BYTES = 100
#: Size of the bitmap that tells which payloads may occur twice: at most 262 144 rows of 64 bits.
BITMAP_BITS = 24
_BIT_SQL = f"pmod(xxhash64(payload_digest), {1 << BITMAP_BITS}L)"
#: Bytes of a range; a range without the start of a record is skipped by the chain.
RANGE_BYTES = 8_000_000
MAGIC = b"WARC/1.1\r\n"
#: How a header line begins: a name of at most NAME_BYTES, which the writer's are; values have no bound.
NAME_BYTES = 64
FIELD = re.compile(rb"[!-9;-~]{1,%d}:" % NAME_BYTES)
END = "\r\n\r\n"


def _header_value(c):
    """Line ends in a header value would end the header; they and the escape sign are percent-coded."""
    c = F.coalesce(c, F.lit(""))
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def with_revisits(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``.

    The first page of each payload comes from a partial aggregate (a payload held by a third of all
    rows gives one row per task).  Only payloads that occur twice or more are joined back, and a
    bitmap of their digests' hashes — 2^``BITMAP_BITS`` bits whatever the input, broadcast as rows of
    64 bits — keeps nearly all other pages out of that join, so unique payloads are not shuffled."""
    checkpoint_dir(pages.sparkSession)
    page = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    page = page.withColumns({"payload_bytes": F.octet_length("payload").cast("long"),
                             "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    first = (page.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
             .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n").checkpoint())
    word, mask = F.expr(f"shiftright({_BIT_SQL}, 6)"), F.expr(f"shiftleft(1L, cast({_BIT_SQL} & 63 as int))")
    bitmap = first.select(word.alias("_w"), mask.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits"))
    page = page.withColumn("_w", word).join(F.broadcast(bitmap), "_w", "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(mask), F.lit(0)) != 0
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest"]
    alone = page.where(~maybe).select(*columns, F.lit(None).cast(first.schema["_first"].dataType).alias("_first"))
    shared = page.where(maybe).select(*columns).join(first, "payload_digest", "left").select(*columns, "_first")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return alone.unionByName(shared).select(
        *columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def write_warc(pages: DataFrame, out_dir: str, min_bytes: int = REVISIT_BYTES) -> None:
    """Write ``pages(page_id, url, html)`` as WARC files below ``out_dir``.

    A null html is an empty payload; a null page_id sorts after all others and gets no id in its
    record; rows repeating the smallest page_id are responses too; an empty table gives no record;
    other columns are not read."""
    p = with_revisits(pages, min_bytes)
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    page_urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), _header_value(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: "), page_urn(F.col("refers_to")), F.lit(
            "\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)       # concat_ws skips nulls
    p.select(record.alias("value")).write.option("lineSep", END).text(out_dir)


def file_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, size, start`` of every range; only names and sizes of the files are read."""
    files = (spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
             .where("size > 0"))
    return files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))


class Source:
    """Reads a file in windows; a record's header may cross the end of a range."""

    def __init__(self, handle, size: int, start: int, end: int):
        self.handle, self.size, self.base = handle, size, start
        handle.seek(start)
        self.data = handle.read(min(size, end) - start)

    def at(self, offset: int, n: int) -> bytes:
        i = offset - self.base
        if 0 <= i and i + n <= len(self.data):
            return self.data[i:i + n]
        self.handle.seek(offset)
        return self.handle.read(max(0, min(n, self.size - offset)))

    def lines(self, offset: int) -> tuple[list[bytes], int] | None:
        """Lines of the header at offset, and where its blank line begins; None if a line is no field
        or the file ends first."""
        n = 2048
        while True:
            head = self.at(offset, n)
            if not head.startswith(MAGIC):
                return None
            cut = head.find(b"\r\n\r\n", len(MAGIC) - 2)
            found = head[len(MAGIC):cut if cut >= 0 else len(head)].split(b"\r\n") if cut != len(MAGIC) - 2 else []
            rest = found.pop() if cut < 0 else b""            # a line of which only the beginning is read
            if not all(map(FIELD.match, found)) or len(rest) > NAME_BYTES and not FIELD.match(rest):
                return None
            if cut >= 0:
                return found, offset + cut
            if offset + n >= self.size:
                return None
            n *= 4

    def shape(self, offset: int, ahead: tuple[int, tuple[int, bytes] | None] | None) -> tuple[int, bytes] | None:
        """Where the blank line of the header at offset begins, and its length field.  ``ahead``: the
        next candidate and its shape; both share the rest of a header that goes on past the next."""
        shared = self.data[offset + len(MAGIC) - self.base:ahead[0] + len(MAGIC) - self.base] if ahead else b""
        if not ahead or b"\r\n\r\n" in MAGIC[-2:] + shared:
            found = self.lines(offset)
            return found and (found[1], self.length(found[0]))
        own = shared[:-2].split(b"\r\n")
        if ahead[1] is None or not all(map(FIELD.match, own)):
            return None
        return ahead[1][0], ahead[1][1] or self.length(own)

    @staticmethod
    def length(lines: list[bytes]) -> bytes:
        return next((value for name, _, value in (x.partition(b": ") for x in reversed(lines)) if name.lower() == b"content-length"), b"")

    def after(self, shape: tuple[int, bytes] | None) -> int | None:
        """Successor of a record."""
        if shape is None or not re.fullmatch(rb"[0-9]{1,18}", shape[1]):
            return None
        after = shape[0] + 4 + int(shape[1]) + len(END)
        return after if after <= self.size else None

    def header(self, offset: int) -> tuple[dict[str, str], int, int] | None:
        """Fields, payload offset and successor of a record that starts at offset."""
        found = self.lines(offset)
        after = found and self.after((found[1], self.length(found[0])))
        if after is None:
            return None
        fields = {}
        for line in found[0]:
            name, _, value = line.partition(b": ")
            fields[name.decode("utf-8", "replace").lower()] = value.decode("utf-8", "replace")
        return fields, found[1] + 4, after


def _ranges(batches: Iterator[pa.RecordBatch], range_bytes: int, *more: str):
    """Open each range of the rows; its data reaches a magic that begins inside it."""
    for batch in batches:
        for file, size, start, *rest in common.rows_of(batch, "file", "size", "start", *more):
            fs, path = common.file_system(file)
            with fs.open_input_file(path) as handle:
                yield file, start, min(size, start + range_bytes), Source(handle, size, start, start + range_bytes + len(MAGIC) - 1), *rest


def chain_links(ranges: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, start, offset, leaves``: each candidate and where its chain leaves the range.  A chain
    that breaks (no record, or past the end of the file) gives no link."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("offset", pa.int64()), ("leaves", pa.int64())])

    def run(batches):
        out = common.Collector(schema)
        for file, start, end, source in _ranges(batches, range_bytes):
            spots = [start + m.start() for m in re.finditer(re.escape(MAGIC), source.data)]
            leaves: dict[int, int | None] = {}
            ahead = None
            for offset in reversed(spots):                    # successors lie ahead
                ahead = offset, source.shape(offset, ahead)
                after = source.after(ahead[1])
                leaves[offset] = after if after is None or after >= end else leaves.get(after)
                if leaves[offset] is not None and out.add(file, start, offset, leaves[offset]):
                    yield from out.flush()
        yield from out.flush()

    return ranges.mapInArrow(run, "file string, start long, offset long, leaves long")


def range_entries(ranges: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, size, start, entry``: where the chain from offset 0 enters each range, for the ranges
    it enters.  Pointer jumping: after round k a link spans 2^k ranges.  Each round's tables are
    written to the checkpoint folder, so a lost executor costs one round.  A chain that breaks before
    the end of its file is an error."""
    checkpoint_dir(ranges.sparkSession)
    links = chain_links(ranges, range_bytes).select("file", "offset", "leaves").checkpoint()
    # only candidates that some chain leads to, or that start a file, can be on the chain
    reached = links.where("offset = 0").select("file", "offset").checkpoint()
    jump = links.join(links.select("file", F.col("leaves").alias("offset")).distinct().unionByName(
        reached).distinct(), ["file", "offset"]).checkpoint()
    while True:
        ahead = reached.join(jump, ["file", "offset"]).select("file", F.col("leaves").alias("offset"))
        # the end of a file is reached by its chain but starts no record
        grown = reached.unionByName(ahead.join(links, ["file", "offset"], "left_semi")).distinct().checkpoint()
        done = grown.count() == reached.count()
        reached = grown
        if done:
            break
        jump = (jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.leaves") == F.col("b.offset")))
                .select("a.file", "a.offset", "b.leaves").checkpoint())
    whole = reached.join(links, ["file", "offset"]).select("file", F.col("leaves").alias("size"))
    broken = ranges.select("file", "size").distinct().join(whole, ["file", "size"], "left_anti")
    last = reached.groupBy("file").agg(F.max("offset").alias("offset"))
    if row := broken.join(last, "file", "left").first():
        raise ValueError(f"{row['file']}: the records from {row['offset'] or 0} on do not reach the file's end at {row['size']}")
    start = (F.floor(F.col("offset") / range_bytes) * range_bytes).cast("long")
    entry = reached.groupBy("file", start.alias("start")).agg(F.min("offset").alias("entry"))
    return ranges.join(entry, ["file", "start"])


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """All records on the verified chains of the files below ``path``: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to`` (and ``url, payload``).  Digest and length of a response
    are taken from the payload bytes read and must equal its header; those of a revisit are its
    header's, the payload being that of ``refers_to``."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
              ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + ([("url", pa.string()), ("payload", pa.binary())] if with_payload else []))
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def number(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
        return int(m[1]) if m else None

    def run(batches):
        out = common.Collector(schema, 512)
        for file, start, end, source, offset in _ranges(batches, range_bytes, "entry"):
            while offset < end:
                found = source.header(offset)
                if found is None:
                    raise ValueError(f"{file}: no record at {offset}")
                head, body, after = found
                payload = source.at(body, after - len(END) - body)
                digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(head["x-payload-length"])
                if head["warc-type"] == "response" and (digest, size) != (hashlib.sha256(payload).hexdigest(), len(payload)):
                    raise ValueError(f"{file}: payload at {offset} does not match its header")
                url = head["warc-target-uri"].replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                row = (number(head["warc-record-id"]), size, digest, head["warc-type"], number(head.get("warc-refers-to")))
                if out.add(*row, *([url, payload] if with_payload else [])):
                    yield from out.flush()
                offset = after
        yield from out.flush()

    entries = range_entries(file_ranges(spark, path, range_bytes), range_bytes)
    return (entries.select("file", "size", "start", "entry").repartition(common.partitions(spark), "file", "start")
            .mapInArrow(run, ddl + (", url string, payload binary" if with_payload else "")))
