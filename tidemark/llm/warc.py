"""WARC archives: writing with segments, revisits and chunked framing; reading with segment reassembly.

A record is one row of a Spark text table whose line separator is the two line breaks that end a WARC record, so
the files are ordinary archives, written and committed by Spark on any file system. They are read back as whole
files of bounded size and parsed by their lengths.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.registry import query, table
from tidemark.session import materialize, new_path

END = b"\r\n\r\n"
MIN_REVISIT = 100
#: Bytes of a record's block in one segment, bytes of an HTTP chunk, and records in one archive: together they bound
#: an archive, which is read by one task, to about 32 MB.
SEGMENT_BYTES = 65_536
CHUNK_BYTES = 8_192
RECORDS = 500
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at:at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunk(body: bytes) -> bytes:
    """Payload of a body in chunked transfer framing; trailers and chunk extensions are passed over."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        at = line + 2
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        parts.append(body[at:at + size])
        at += size + 2


def clean(value: str | None) -> str:
    """A header value: line breaks would end the header."""
    return "" if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def head(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block


def record_id(key, mark: str) -> str:
    return f"<urn:page:{'null' if key is None else clean(str(key))}:{mark}>"


def records(key, url, payload: bytes, digest: str, first, named: bool, segment_bytes: int) -> Iterator[bytes]:
    """Records of one row without their ends: a revisit, or a response in one or more segments.

    The response that others revisit is ``named``: its id follows from key and digest, so a revisit can state it.
    """
    own = record_id(key, digest if named else uuid.uuid4().hex)
    fields = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", clean(url) or None), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if first is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield head([("WARC-Type", "revisit"), *fields, ("WARC-Profile", profile), ("WARC-Refers-To", record_id(first, digest))], HTTP)
        return
    block = HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        yield head([("WARC-Type", "response"), *fields], block)
        return
    yield head([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], block[:segment_bytes])
    starts = range(segment_bytes, len(block), segment_bytes)
    for number, at in enumerate(starts, 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number)]
        if at == starts[-1]:
            more.append(("WARC-Segment-Total-Length", len(block)))
        yield head(more, block[at:at + segment_bytes])


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write one record for each row (long records in segments) as gzipped archives under ``path``.

    Of rows with equal payloads of at least ``MIN_REVISIT`` bytes those with the smallest key are responses, the
    others revisits of it, whose ``WARC-Refers-To`` is the response's record id. A null payload counts as empty, a null url is left out; a row with a null key revisits
    if another row of its payload has a key, else it is a response. Rows that repeat a key and payload are all
    responses (or all revisits), each with a record of its own; one of the responses is the one revisited. An empty table gives archives without records.
    """
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.length("payload") >= MIN_REVISIT).groupBy("digest", "key").agg(F.count("*").alias("n"))
    groups = groups.groupBy("digest").agg(F.min("key").alias("first"), F.min_by("n", "key").alias("copies"), F.sum("n").alias("n"))
    groups = materialize(groups.where("n > 1 and first is not null").select("digest", "first", "copies"), "groups")
    rows = rows.join(groups, "digest", "left").withColumn("lead", F.coalesce(F.col("key") == F.col("first"), F.lit(False)))
    shape = ["key", "url", "payload", "digest", F.when(~F.col("lead"), F.col("first")).alias("first")]
    if groups.where("copies > 1").isEmpty():
        rows = rows.select(*shape, F.col("lead").alias("named"))
    else:  # of responses that repeat key and payload one has the name
        repeated = F.col("lead") & (F.col("copies") > 1)
        drawn = materialize(rows.where(repeated).withColumn("mark", F.expr("uuid()")), "repeated")
        chosen = drawn.groupBy("digest").agg(F.min("mark").alias("chosen"))
        one = drawn.join(chosen, "digest").select(*shape, (F.col("mark") == F.col("chosen")).alias("named"))
        rows = rows.where(~F.coalesce(repeated, F.lit(False))).select(*shape, F.col("lead").alias("named")).unionByName(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held = [], 0
            for row in zip(*batch.columns, strict=True):
                for record in records(*(x.as_py() for x in row), segment_bytes):
                    made.append(record)
                    held += len(record)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])
                        made, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    out = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def gunzip(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """Bytes of a gzip file of one or more members, some at a time."""
    member, at = zlib.decompressobj(31), 0
    while at < len(data):
        held, at = data[at:at + step], at + step
        while held:
            yield member.decompress(held)
            held = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a gzipped archive."""
    held, at = bytearray(), 0
    needed: int | None = None
    fields: dict[str, str] = {}
    for more in gunzip(data):
        del held[:at]
        held += more
        at = 0
        while True:
            if needed is None:
                stop = held.find(END, at)
                if stop < 0:
                    break
                lines = held[at:stop].decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record: {lines[0][:40]!r}")
                fields = dict(line.split(": ", 1) for line in lines[1:])
                needed, at = int(fields["Content-Length"]), stop + len(END)
            if len(held) < at + needed + len(END):
                break
            if held[at + needed:at + needed + len(END)] != END:
                raise ValueError("a record does not end where its length says")
            yield fields, bytes(held[at:at + needed])
            at, needed = at + needed + len(END), None
    if needed is not None or held[at:].strip():
        raise ValueError("the archive ends inside a record")


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response block."""
    top, _, body = block.partition(END)
    return unchunk(body) if b"transfer-encoding: chunked" in top.lower() else body


RECORD = "record_id string, type string, url string, digest string, refers_to string, payload binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Whole records of the archives under ``path``: record_id, type, url, digest, refers_to, payload (null for revisits).

    Continuation records are grouped by origin identifier and put in order of their segment numbers; a gap, a
    repeat or a wrong total length raises. Records in one piece are never shuffled.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for f, block in parse(content.as_py()):
                    if "WARC-Segment-Number" not in f:
                        payload = None if f["WARC-Type"] == "revisit" else payload_of(block)
                        rows.append((f["WARC-Record-ID"], f["WARC-Type"], f.get("WARC-Target-URI"), f.get("WARC-Payload-Digest"), f.get("WARC-Refers-To"), payload))
                yield table_of(rows, RECORD)

    segment = "origin string, number int, total bigint, type string, url string, digest string, block binary"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for f, block in parse(content.as_py()):
                    if "WARC-Segment-Number" in f:
                        total = f.get("WARC-Segment-Total-Length")
                        rows.append((f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), int(f["WARC-Segment-Number"]), total and int(total), f["WARC-Type"], f.get("WARC-Target-URI"), f.get("WARC-Payload-Digest"), block))
                yield table_of(rows, segment)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = row["parts"]
                block = b"".join(p["block"] for p in parts)
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                    raise ValueError(f"segments of {row['origin']} are missing, repeated or of the wrong length")
                yield table_of([(row["origin"], parts[0]["type"], parts[0]["url"], parts[0]["digest"], None, payload_of(block))], RECORD)

    found = files.mapInArrow(pieces, segment).groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", "type", "url", "digest", "block"))).alias("parts"))
    return files.mapInArrow(whole, RECORD).unionByName(found.mapInArrow(join, RECORD))


KINDS = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64()}


def table_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


SQL9 = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha256(b) as payload_digest from p),
g as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from g
"""


@query("op9_warc", SQL9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    page = F.regexp_extract("record_id", r"^<urn:page:(-?\d+)", 1)
    found = materialize(read_warc(spark, path).select(
        "record_id", "refers_to", F.col("type").alias("record_type"), F.when(page != "", page.cast("bigint")).alias("page_id"), F.length("payload").cast("bigint").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.substring_index("digest", ":", -1)).alias("payload_digest"),
    ), "pages")
    # A revisit has no payload: its page and length are those of the record that it names.
    named = found.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= MIN_REVISIT))
    named = named.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of"), F.col("payload_bytes").alias("n"))
    joined = found.join(named, "refers_to", "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "n").alias("payload_bytes"), "payload_digest", "record_type", F.col("of").alias("refers_to"))
