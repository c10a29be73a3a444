"""WARC archives: write pages as records, read archives back, reassemble segments, decode chunked payloads.

Archives are text files of Spark's own writer whose line separator is the blank lines that end a record, so they reach any
store that Spark reaches; they are compressed per file. They are read line by line inside a task, so an archive of any length
needs the memory of one record. Records above ``segment_bytes`` are written as a first segment and continuations, which
may stand in other files; only these are shuffled on reading, by the id of their first segment.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from kindred.llm.common import materialise, via_arrow
from kindred.operators.scale_out import broadcast_if_small, scratch_path

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
# Payloads below this size are stored again rather than referred to.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
# Names of archives that are compressed as a whole, so that Spark does not split them.
WHOLE = r"\.(gz|gzip|zst|zstd|lz4|snappy|deflate)$"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = (payload[i : i + size] for i in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ``ValueError`` on broken framing."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size_text = body[at:end].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]+", size_text):
            raise ValueError("bad chunk size")
        size, at = int(size_text, 16), end + 2
        if size == 0:
            break
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("bad chunk")
        out.append(body[at : at + size])
        at += size + 2
    while (end := body.find(b"\r\n", at)) > at:  # trailers
        at = end + 2
    if end < 0:
        raise ValueError("no end of trailers")
    return b"".join(out)


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _head(kind: str, record_id: str, length: int, **fields: object) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return ("\r\n".join([*lines, f"Content-Length: {length}"]) + END).encode()


def records_of(
    page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, segment_bytes: int, copy: int | None = None
) -> Iterator[bytes]:
    """The records of a page: a revisit, a response, or a response in segments."""
    record_id = page_record_id(page_id, hashlib.sha1(payload).hexdigest(), copy)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or None
    named = {"WARC_Target_URI": target, "WARC_Payload_Digest": _digest(payload)}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        more = {"WARC_Refers_To": f"<{refers_to}>", "WARC_Profile": profile, "Content_Type": "application/http; msgtype=response"}
        yield _head("revisit", record_id, len(http), **named, **more) + http
        return
    block = http + chunked(payload)
    named |= {"WARC_Block_Digest": _digest(block), "Content_Type": "application/http; msgtype=response"}
    if len(block) <= segment_bytes:
        yield _head("response", record_id, len(block), **named) + block
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _head("response", record_id, len(parts[0]), **named, WARC_Segment_Number=1) + parts[0]
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        more = {"WARC_Segment_Origin_ID": f"<{record_id}>", "WARC_Segment_Number": n, "WARC_Segment_Total_Length": total}
        yield _head("continuation", f"{record_id}:{n}", len(part), **more) + part


def page_record_id(page_id: int | None, digest: str, copy: int | None = None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}" + ("" if copy is None else f":copy{copy}")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``: null, but a number of their own for all but the first of those that repeat an id and a payload."""
    keys = [F.col("page_id"), F.xxhash64("payload").alias("x1"), F.xxhash64(F.lit(1), "payload").alias("x2")]
    repeated = materialise(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated")
    single = F.lit(None).cast("long").alias("copy")
    if repeated.isEmpty():
        return rows.select("*", single)
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_x1") == F.xxhash64("payload")) & (F.col("_x2") == F.xxhash64(F.lit(1), "payload"))
    key = broadcast_if_small(repeated.select(F.col("page_id").alias("_page"), F.col("x1").alias("_x1"), F.col("x2").alias("_x2")))
    # The written table fixes the numbers.
    copies = materialise(rows.join(key, same).withColumn("copy", F.monotonically_increasing_id()), "copies")
    first = copies.groupBy("_page", "_x1", "_x2").agg(F.min("copy").alias("first")).select(F.col("first").alias("_first"))
    first = broadcast_if_small(first, computed=True)
    alone = rows.join(key, same, "left_anti").select("*", single)
    later = copies.join(first, F.col("copy") == F.col("_first"), "left")
    return alone.unionByName(later.select(*rows.columns, F.when(F.col("_first").isNull(), F.col("copy")).alias("copy")))


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write one record per page below ``path``; null payloads are empty.

    Of the pages with equal payloads of at least ``REVISIT_BYTES`` the one with the largest id is the response and the
    others revisit it. A null id counts as the smallest. Rows that repeat an id and a payload have a record each; a revisit refers to the first of them.
    """
    rows = pages.select(
        F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = _numbered(rows).withColumn("same", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.sha2("payload", 256)))
    groups = materialise(
        rows.filter("same is not null").groupBy("same").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .filter("n > 1").drop("n"), "payloads",
    )
    joined = rows.join(groups, "same", "left").select(
        "page_id", "url", "payload", (F.col("same").isNull() | F.col("page_id").eqNullSafe(F.col("keeper")) | F.col("keeper").isNull()).alias("own"), "keeper", "copy"
    )

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for page_id, address, data, own, keeper, copy in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            refers = None if own else page_record_id(keeper, hashlib.sha1(data).hexdigest())
            out += records_of(page_id, address, data, refers, segment_bytes, copy)
        return pa.record_batch([pa.array(out, pa.large_binary())], schema=pa.schema([("value", pa.large_binary())]))

    lines = via_arrow(joined, build, pa.schema([("value", pa.large_binary())]))
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


RECORD = pa.schema([
    ("type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("origin_id", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("payload_digest", pa.string()),
    ("block", pa.large_binary()), ("error", pa.string()),
])


class Parser:
    """Turns the lines of an archive into records; ``feed`` gets a line without its line feed."""

    def __init__(self) -> None:
        self.head: list[bytes] | None = None
        self.fields: dict[str, str] = {}
        self.parts: list[bytes] | None = None
        self.missing = 0

    def feed(self, line: bytes) -> dict | None:
        if self.parts is not None:
            return self._block(line)
        text = line.rstrip(b"\r")
        if self.head is None:
            if text.startswith(b"WARC/"):
                self.head = []
            elif text:
                return {"error": "no record starts here"}
            return None
        if text:
            if text[:1] in b" \t" and self.head:
                self.head[-1] += b" " + text.strip()
            else:
                self.head.append(text)
            return None
        pairs = (h.decode("utf-8", "replace").partition(":") for h in self.head)
        self.fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
        length = self.fields.get("content-length", "")
        if not length.isdecimal():
            self.head = None
            return {"error": "no content length"}
        self.missing, self.parts = int(length), []
        return self._finish() if not self.missing else None

    def _block(self, line: bytes) -> dict | None:
        if len(line) >= self.missing:  # the block ends in this line; what follows is the end of the record
            self.parts.append(line[: self.missing])
            return self._finish()
        self.parts += [line, b"\n"]
        self.missing -= len(line) + 1
        return self._finish() if not self.missing else None

    def _finish(self, error: str | None = None) -> dict:
        f, block = self.fields, b"".join(self.parts or [])
        bare = lambda k: f[k].strip("<>") if k in f else None
        number = lambda k: int(f[k]) if f.get(k, "").isdecimal() else None
        self.head = self.parts = None
        self.fields = {}
        return {
            "type": f.get("warc-type"), "record_id": bare("warc-record-id"), "target_uri": f.get("warc-target-uri"),
            "refers_to": bare("warc-refers-to"), "origin_id": bare("warc-segment-origin-id"),
            "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"),
            "payload_digest": f.get("warc-payload-digest"), "block": block, "error": error,
        }

    def close(self) -> dict | None:
        return None if self.head is None else self._finish("the archive ends inside the record")


def _least_split(spark: SparkSession) -> int:
    """Bytes of a file up to which Spark never splits it."""
    size = lambda key: spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"spark.sql.files.{key}"))
    return min(size("maxPartitionBytes"), size("openCostInBytes"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``; broken ones have an ``error``.

    Archives are read where they lie, line by line. Those that Spark may split, which are large and not compressed as a whole, are brought together
    first: the lines of one meet in one task, sorted by their place, and pass through it one after another.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"),
    )
    splits = (F.col("size") > _least_split(spark)) & ~F.col("file").rlike(WHOLE)
    whole = lines.filter(~splits).select("line", "file")
    split = lines.filter(splits).repartition("file").sortWithinPartitions("file", "at", "n").select("line", "file")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, file, found, size = Parser(), None, [], 0
        for batch in batches:
            for line, name in zip(batch["line"], batch["file"].to_pylist(), strict=True):
                if name != file:
                    last, parser, file = parser.close(), Parser(), name
                    found += [last] if last else []
                record = parser.feed(line.as_py())
                if record:
                    found.append(record)
                    size += len(record.get("block") or b"")
                if size > 8 << 20 or len(found) >= 5000:
                    yield pa.RecordBatch.from_pylist(found, schema=RECORD)
                    found, size = [], 0
        last = parser.close()
        found += [last] if last else []
        yield pa.RecordBatch.from_pylist(found, schema=RECORD)

    schema = from_arrow_schema(RECORD)
    return whole.mapInArrow(parse, schema).unionByName(split.mapInArrow(parse, schema))


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: continuations are appended to their first segment in the order of their numbers.

    A record whose segments are not 1..n, or do not add up to the total length of the last one, gets an ``error``. A
    segment that stands in the archives more than once is used once. The rest passes unchanged.
    """
    records = materialise(records, "records")
    whole = records.filter("segment is null")
    part = records.filter("segment is not null").withColumn("origin", F.coalesce("origin_id", "record_id"))
    fields = [c for c in records.columns if c not in ("block", "error", "origin_id", "segment", "total")]
    first = {c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in fields}
    grouped = part.dropDuplicates(["origin", "segment"]).groupBy("origin").agg(
        *first.values(), F.max("error").alias("error"), F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("segments"),
    )
    numbers = F.transform("segments", lambda s: s["segment"])
    block = F.array_join(F.transform("segments", lambda s: s["block"].cast("string")), "").cast("binary")
    joined = grouped.withColumn("block", block).select(
        *fields, F.lit(None).cast("string").alias("origin_id"), F.lit(None).cast("int").alias("segment"), "total", "block",
        F.coalesce(
            "error",
            F.when(numbers != F.sequence(F.lit(1), F.size("segments")), F.lit("segments are missing")),
            F.when(F.col("total").isNull() | (F.octet_length("block") != F.col("total")), F.lit("the total length differs")),
        ).alias("error"),
    )
    return whole.unionByName(joined.select(*records.columns))


PAYLOAD = pa.schema([
    ("type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload", pa.large_binary()), ("error", pa.string()),
])


def payload_of(block: bytes) -> bytes:
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        raise ValueError("not an HTTP message")
    coded = re.search(rb"\r\ntransfer-encoding:[ \t]*([^\r]*)", head, re.IGNORECASE)
    return dechunked(body) if coded and b"chunked" in coded[1].lower() else body


def payloads(records: DataFrame) -> DataFrame:
    """Payloads of whole records, out of their HTTP and chunked framing; checked against the digest of the record."""
    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for kind, block, digest, error in zip(*[batch[c].to_pylist() for c in ("type", "block", "payload_digest", "error")], strict=True):
            data = None
            if error is None and kind == "response":
                try:
                    data = payload_of(block)
                    if digest and digest != _digest(data):
                        error = "the payload digest differs"
                except ValueError as e:
                    error = str(e)
            out.append((data, error))
        kept = [batch[c] for c in ("type", "record_id", "target_uri", "refers_to", "payload_digest")]
        return pa.record_batch([*kept, pa.array([d for d, _ in out], pa.large_binary()), pa.array([e for _, e in out], pa.string())], schema=PAYLOAD)

    return via_arrow(records.select("type", "record_id", "target_uri", "refers_to", "payload_digest", "block", "error"), decode, PAYLOAD)


def digests(read: DataFrame) -> DataFrame:
    """Per page ``page_id, payload_bytes, payload_digest, record_type, refers_to``, from payloads of its own or of the response it revisits.

    One row per record, so one per page written, also where pages repeat an id and a payload. Records with an ``error`` end the job:
    an archive that was just written must be whole.
    """
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("broken record: "), F.coalesce("record_id", F.lit("?")), F.lit(" "), "error")))
    rows = read.withColumn("error", F.coalesce(sound, F.lit(""))).select(
        "type", "record_id", "refers_to", "error", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest")
    ).dropDuplicates(["record_id"])
    rows = materialise(rows, "payloads")
    page = lambda c: F.when(F.col(c).isNotNull(), F.expr(f"try_cast(split({c}, ':')[2] AS bigint)"))
    own = rows.filter("type = 'response'").select(page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    target = rows.filter("type = 'response'").select(F.col("record_id").alias("target"), F.col("payload_bytes").alias("n"), F.col("digest").alias("d"))
    revisits = rows.filter("type = 'revisit'").join(target, F.col("refers_to") == F.col("target"), "left").select(
        page("record_id").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"),
        F.col("type").alias("record_type"), page("refers_to").alias("refers_to"),
    )
    return own.unionByName(revisits)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and return ``digests``: a row per page.

    Null payloads are empty, null ids stay null and count as the smallest, repeated rows come back as often as they stand there. Other columns are not
    read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    return digests(payloads(reassemble(read_records(spark, path))))
