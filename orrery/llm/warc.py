"""Web archives: write captures as WARC/1.1, read archives back, and assemble each capture's records into one row.

A capture is three records: the response (or a revisit of an earlier equal payload), the request and the metadata record,
which both name the response in WARC-Concurrent-To. Every record is a gzip member of its own. A file holds captures of about
`file_bytes` (one capture at least); it is one row of Spark's text sink, whose line separator is a member with two line breaks, so
that the executors' own file systems are never used. Reading unpacks piece by piece, is driven by Content-Length, and takes any bytes.

Defined cases: a null payload is empty, a null url is written as an empty one; rows with a null id are captures of their
own, and only ever revisit; rows equal in id and payload are captures of their own too, but where the smallest id of a group of equal
payloads stands in several rows, all of these are responses of one name, and paired with their requests in the order in which
they stand in the archives; a record without an id is named by its place; a record may name several others in WARC-Concurrent-To,
and belongs to each; columns that are not named are left out; an empty table gives an archive without records. A single file that is
read must have less than 2 GB.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, tokens

CRLF = "\r\n"
END = CRLF + CRLF
LEAST_REVISIT = 100
FILE_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "source string, at long, record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, payload_digest string, fields map<string,string>, payload binary"
_PIECE = 1 << 18


def _member(record: bytes) -> bytes:
    packed = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packed.compress(record) + packed.flush()


def _uuid(*parts: Column | str) -> Column:
    """A name-based record id."""
    h = F.md5(F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(fields: dict[str, Column | str | None], block: Column) -> Column:
    head = [F.lit("WARC/1.1" + CRLF)]
    for name, value in fields.items():
        value = F.lit(value) if isinstance(value, str) else value
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_revisit: int = LEAST_REVISIT, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write each row as a capture. Of equal payloads of at least `least_revisit` bytes the smallest id's is the response."""
    scratch.bound_batches(pages.sparkSession)
    body = F.coalesce(F.col(payload), F.lit(""))
    base = pages.select(F.col(key).alias("id"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", " ").alias("url"), body.alias("body"))
    base = base.withColumns({"digest": F.sha2("body", 256), "size": F.octet_length("body"), "place": F.monotonically_increasing_id().cast("string")})
    firsts = base.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    # only a response that others may refer to is named by its payload alone, so that no name is that of very many rows
    rows = base.join(firsts, "digest", "left").withColumn("nonce", F.when(~F.coalesce(F.col("first") == F.col("id"), F.lit(False)), F.col("place")))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    own = _uuid("response", F.col("id"), F.col("digest"), F.col("nonce"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(END))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    common = {"WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": F.col("url"), "WARC-Payload-Digest": digest, "Content-Type": "application/http; msgtype=response"}
    response = _record({"WARC-Type": "response", **common}, F.concat(http, F.col("body")))
    revisit = _record({"WARC-Type": "revisit", **common, "WARC-Profile": PROFILE, "WARC-Refers-To": _uuid("response", F.col("first"), F.col("digest"), F.lit(None))}, http)
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    side = lambda kind, mime: {"WARC-Type": kind, "WARC-Record-ID": _uuid(kind, F.col("id"), F.col("digest"), F.col("nonce")), "WARC-Date": date, "WARC-Target-URI": F.col("url"), "WARC-Concurrent-To": own, "Content-Type": mime}
    request = _record(side("request", "application/http; msgtype=request"), F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(END)))
    metadata = _record(side("metadata", "application/warc-fields"), F.concat(F.lit("source-key: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(CRLF)))
    kinds = {"request": request, "main": F.when(again, revisit).otherwise(response), "metadata": metadata}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for i in range(batch.num_rows):
                records = [c[i].as_py() + END.encode() for c in columns]
                if held and size + sum(map(len, records)) > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
                held += map(_member, records)
                size += sum(map(len, records))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
        tokens.release()

    files = rows.select(*[c.cast("binary").alias(n) for n, c in kinds.items()]).mapInArrow(run, "value binary")
    between = _member(END.encode()).decode("latin-1")
    files.select(F.col("value").cast("string")).write.option("lineSep", between).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def unpacked(data: bytes) -> Iterator[bytes]:
    """What a file holds, a piece at a time: the members of a gzip file one after another, or the bytes of any other."""
    at, whole = 0, memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(whole[i : i + _PIECE]) for i in range(0, len(whole), _PIECE))
        return
    member = zlib.decompressobj(31)
    while at < len(whole) or member.unconsumed_tail:
        piece = member.unconsumed_tail
        if not piece:
            piece = whole[at : at + _PIECE]
            at += len(piece)
        out = member.decompress(piece, 4 * _PIECE)
        if out:
            yield out
        if member.eof:
            at -= len(member.unused_data)
            member = zlib.decompressobj(31)
    if rest := member.flush():
        yield rest


def parse(pieces: bytes | Iterable[bytes]) -> Iterator[tuple[int, dict[str, list[str]], bytes]]:
    """Each record's place, its fields by lower-case name, each with its values in turn, and its block."""
    source = iter([pieces] if isinstance(pieces, bytes) else pieces)
    held, passed = bytearray(), 0

    def more() -> bool:
        piece = next(source, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (begin := held.find(b"WARC/")) < 0:
            gone = max(0, len(held) - 4)
            del held[:gone]
            passed += gone
            if not more():
                return
        seek = begin
        while (end := held.find(b"\r\n\r\n", seek)) < 0:
            seek = max(begin, len(held) - 3)
            if not more():
                raise ValueError(f"a record's head at byte {passed + begin} has no end")
        fields: dict[str, list[str]] = {}
        for line in held[begin:end].decode("utf-8", "replace").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        stop = end + 4 + int(fields["content-length"][0])
        while len(held) < stop:
            if not more():
                raise ValueError(f"the record at byte {passed + begin} is cut off")
        yield passed + begin, fields, bytes(memoryview(held)[end + 4 : stop])
        del held[:stop]
        passed += stop


def read(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of the archives (gzip or plain) below `path`; payload: the block, without HTTP's head if it has one."""
    scratch.bound_batches(spark)
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 3, pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def row(source: str, at: int, f: dict[str, list[str]], block: bytes) -> tuple:
        one = lambda name: f.get(name, [None])[0]
        kind = one("content-type") or ""
        if kind.startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        more = {}
        if kind == "application/warc-fields":
            more = {n.strip().lower(): v.strip() for n, s, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF)) if s}
        return source, at, one("warc-record-id") or f"<place:{source}#{at}>", one("warc-type"), f.get("warc-concurrent-to"), one("warc-refers-to"), one("warc-target-uri"), one("warc-payload-digest"), list(more.items()), block

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for at, f, block in parse(unpacked(batch.column(1)[k].as_py())):
                    rows.append(row(batch.column(0)[k].as_py(), at, f, block))
                    held += len(block)
                    if held > batch_bytes or len(rows) >= 5000:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)
        tokens.release()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc,txt}").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def assemble(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per capture: its response or revisit, its request and its metadata, joined through WARC-Concurrent-To.

    Columns: capture_id, main, request, metadata (structs). main holds type, target_uri, refers_to, payload_digest as written,
    payload_bytes and payload_sha256 of what was read, and the payload if asked for. A capture without a request or metadata
    record has null there; a request or metadata record without its response gives no row.
    """
    sized = records.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha256": F.sha2("payload", 256)})
    kept = ["type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload_sha256", *(["payload"] if payload else [])]
    main = F.col("type").isin("response", "revisit", "resource")
    side = F.struct("record_id", "target_uri", "fields", *(["payload"] if payload else []))
    to = F.when(main, F.array("record_id")).otherwise(F.array_distinct(F.coalesce("concurrent_to", F.array().cast("array<string>"))))
    place = F.struct("source", "at")
    # the n-th of a name's main records goes with the n-th request and metadata record, in the order of the archives
    order = lambda x, y: F.when(x["p"] < y["p"], -1).when(x["p"] > y["p"], 1).otherwise(0)
    listed = lambda on, value: F.transform(F.array_sort(F.collect_list(F.when(on, F.struct(place.alias("p"), value.alias("v")))), order), lambda x: x["v"])
    grouped = sized.withColumn("capture_id", F.explode(to)).groupBy("capture_id").agg(listed(main, F.struct(*kept)).alias("m"), listed(F.col("type") == "request", side).alias("r"), listed(F.col("type") == "metadata", side).alias("d"))
    return grouped.select("capture_id", "r", "d", F.posexplode("m").alias("n", "main")).select("capture_id", "main", F.get("r", F.col("n")).alias("request"), F.get("d", F.col("n")).alias("metadata"))


def report(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write archives to `path`, read them back, and tell of each capture what it is and of which payload."""
    spark = pages.sparkSession
    write(pages, path, key, url, payload)
    captures = assemble(read(spark, path), payload=False).select(
        "capture_id",
        F.nullif(F.element_at("metadata.fields", F.lit("source-key")), F.lit("")).cast(pages.schema[key].dataType).alias(key),
        F.col("main.type").alias("record_type"),
        F.col("main.refers_to").alias("at"),
        F.col("main.payload_bytes").alias("own_bytes"),
        F.col("main.payload_sha256").alias("own_sha256"),
    )
    captures = scratch.stored(captures, "captures")
    responses = captures.where("record_type = 'response'").groupBy(F.col("capture_id").alias("at")).agg(F.first(key).alias("refers_to"), F.first("own_bytes").alias("b"), F.first("own_sha256").alias("h"))
    responses = scratch.stored(responses, "responses")
    return captures.join(responses, "at", "left").select(
        key, F.coalesce("b", "own_bytes").alias("payload_bytes"), F.coalesce("h", "own_sha256").alias("payload_digest"), "record_type", "refers_to"
    )
