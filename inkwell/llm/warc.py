"""WARC archives through a chunked record table.

1. A digest table, (id, SHA-256, SHA-1, bytes) of every payload, decides on responses and revisits; payloads themselves are not shuffled. Of records with equal payloads
   that are not smaller than ``least`` bytes, the smallest id is a response and the others are revisits without a payload.
2. A payload goes into the archive as (record, chunk number) rows of at most ``CHUNK`` bytes: a first record and, for an oversized payload, ``continuation``
   records with WARC-Segment-Number, as the format has it. Chunks are cut from the batch's own buffer, one at a time, and digests are fed as they pass.
3. Archives are written by Spark's text sink with CRLF CRLF, which is what ends a record, as line separator, and read back by its text source with the same
   separator, so they land on whatever store the shared folder is in, and neither side ever holds an archive: what streams by is bounded by a chunk.
Every record has an id of its own, so pages of one id, or of none, are never put together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import _remove_at_exit, cut, new_path
from inkwell.llm.exact_dedup import HOT_SHARE, maybe_repeated, member_filter

#: Bytes of payload in a record; records in an archive.
CHUNK, RECORDS = 128 * 1024, 2000
END = "\r\n\r\n"
# The profile of a revisit in the format, and its version line.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
CONTENT = "Content-Type: text/html; charset=utf-8\r\n"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _cuts(payload: memoryview) -> Iterator[memoryview]:
    """The payload in chunks of at most CHUNK bytes that part no character."""
    a = 0
    while a < len(payload):
        b = min(len(payload), a + CHUNK)
        while b < len(payload) and payload[b] & 0xC0 == 0x80:
            b -= 1
        yield payload[a:b]
        a = b


def decisions(pages: DataFrame, id_col: str, body_col: str, least: int = 0, uri_col: str | None = None) -> DataFrame:
    """The digest table: (id, uri, sha, sha1, size, refers_to, refers_uri), one row per page; refers_to is the smallest id of the equal payload's group, with its
    URI (of repeated ids the smallest), null for a response."""
    uri = F.col(f"`{uri_col}`") if uri_col else F.lit(None).cast("string")
    body = F.coalesce(F.col(f"`{body_col}`"), F.lit(""))
    rows = cut(pages.select(F.col(f"`{id_col}`").alias("id"), uri.alias("uri"), F.sha2(body, 256).alias("sha"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("size")), "payloads")
    total = rows.count()
    groups = rows.where(F.col("size") >= least).groupBy("sha").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "uri"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("sha", "of")
    large, on = F.col("n") * HOT_SHARE > total, F.col("sha") == F.col("of")
    hot = F.broadcast(groups.where(large).select(F.col("of").alias("hot_of"), F.col("first").alias("hot_first")))  # under HOT_SHARE rows
    first = rows.join(hot, F.col("sha") == F.col("hot_of"), "left")
    rest = first.where("hot_of IS NULL").join(groups.where(~large), on, "left").select("id", "uri", "sha", "sha1", "size", "first")
    both = first.where("hot_of IS NOT NULL").select("id", "uri", "sha", "sha1", "size", F.col("hot_first").alias("first")).unionByName(rest)
    of = F.when(~F.col("id").eqNullSafe(F.col("first.id")), F.col("first"))
    return both.select("id", "uri", "sha", "sha1", "size", of["id"].alias("refers_to"), of["uri"].alias("refers_uri"))


def _responses(pages: DataFrame, decided: DataFrame, id_col: str, body_col: str, uri_col: str | None) -> DataFrame:
    """(id, uri, body) of the pages that are responses.

    A Bloom filter of the revisits lets nearly all other pages through as they are. Responses that it cannot tell from revisits are known from the digest
    table; only pages that may be one of those few are shuffled with their payload.
    """
    body = F.coalesce(F.col(f"`{body_col}`"), F.lit(""))
    uri = F.col(f"`{uri_col}`") if uri_col else F.lit(None).cast("string")
    key = lambda i, sha: F.xxhash64(F.coalesce(i.cast("string"), F.lit("null")), sha)
    revisits = decided.where("refers_to IS NOT NULL").select(key(F.col("id"), F.col("sha")).alias("k"))
    bloom, blocks = member_filter(revisits, F.col("k"), max(1, revisits.count()))
    unsure = cut(maybe_repeated(decided.where("refers_to IS NULL").select("id", "sha", key(F.col("id"), F.col("sha")).alias("k")), F.col("k"), bloom, blocks, "hit").where("hit").select(F.col("id").alias("uid"), F.col("sha").alias("usha")).distinct(), "unsure")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), uri.alias("uri"), body.alias("body")).withColumn("sha", F.sha2("body", 256)).withColumn("k", key(F.col("id"), F.col("sha")))
    probed = maybe_repeated(rows, F.col("k"), bloom, blocks, "hit")
    sure = probed.where("NOT hit").select("id", "uri", "body")
    if (n := unsure.count()) == 0:
        return sure
    few, few_blocks = member_filter(unsure, F.col("usha"), n)
    again = maybe_repeated(probed.where("hit").select("id", "uri", "body", "sha"), F.col("sha"), few, few_blocks, "may").where("may")
    return sure.unionByName(again.join(unsure, F.col("id").eqNullSafe(F.col("uid")) & (F.col("sha") == F.col("usha")), "left_semi").select("id", "uri", "body"))


def _uri(i, uri: str | None) -> str:
    """The target: the page's own URL, else one made of its id; nothing in it ends a header line."""
    return "".join(c for c in uri if c > " ") if uri else f"urn:page:{'null' if i is None else i}"


def _page(i) -> str:
    return "null" if i is None else str(i)


def _batch(values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.binary()).cast(pa.string())], names=["value"])


def records(responses: DataFrame) -> DataFrame:
    """The chunked record table of responses: (value) rows, each a record of the archive without its final CRLF CRLF."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, uri, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = memoryview(body.as_buffer())
                whole, n = hashlib.sha1(), 0
                for chunk in _cuts(payload):
                    whole.update(chunk)
                    n += 1
                made += 1
                name = f"urn:inkwell:{part}-{made}"
                common = f"WARC-Date: {DATE}\r\nWARC-Target-URI: {_uri(i, uri)}\r\nX-Page-ID: {_page(i)}\r\nWARC-Payload-Digest: sha1:{_base32(whole.digest())}\r\nX-Payload-Length: {len(payload)}\r\n"
                for number, chunk in enumerate(_cuts(payload) if n else [b""], 1):
                    segment = f"WARC-Segment-Number: {number}\r\n" if n > 1 else ""
                    if number > 1:
                        segment += f"WARC-Segment-Origin-ID: <{name}>\r\n" + (f"WARC-Segment-Total-Length: {len(payload)}\r\n" if number == n else "")
                    kind, own = ("continuation", f"{name}-{number}") if number > 1 else ("response", name)
                    yield f"{VERSION}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{own}>\r\n{common}{segment}{CONTENT}WARC-Block-Digest: sha1:{_base32(hashlib.sha1(chunk).digest())}\r\nContent-Length: {len(chunk)}\r\n\r\n".encode() + chunk

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for record in chunks(batches):
            held.append(record)
            size += len(record)
            if size > 8 * CHUNK:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    return responses.select("id", "uri", "body").mapInArrow(work, "value string")


def revisits(pages: DataFrame) -> DataFrame:
    """(value) records of (id, uri, sha1, size, refers_to, refers_uri): a revisit has headers alone, with its own page's URL and that of the record it refers to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for i, uri, sha1, size, refers_to, refers_uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made += 1
                out.append(f"{VERSION}\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:inkwell:r{part}-{made}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {_uri(i, uri)}\r\nX-Page-ID: {_page(i)}\r\nWARC-Payload-Digest: sha1:{_base32(bytes.fromhex(sha1))}\r\nX-Payload-Length: {size}\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To-Target-URI: {_uri(refers_to, refers_uri)}\r\nX-Refers-To-Page: {_page(refers_to)}\r\nContent-Length: 0\r\n\r\n".encode())
            yield _batch(out)

    return pages.select("id", "uri", "sha1", "size", "refers_to", "refers_uri").mapInArrow(work, "value string")


def write(pages: DataFrame, path: str, id_col: str = "page_id", body_col: str = "html", least: int = 0, uri_col: str | None = None) -> None:
    """Writes ``pages`` as gzipped WARC archives of at most RECORDS records each under ``path``."""
    decided = cut(decisions(pages, id_col, body_col, least, uri_col), "decisions")
    again = decided.where("refers_to IS NOT NULL")
    made = records(_responses(pages, decided, id_col, body_col, uri_col)).unionByName(revisits(again))
    made.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def _parsed(lines: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, from (file, what stands between two CRLF CRLF). The pieces are put together again, as a block may hold CRLF CRLF itself or
    end in a part of one; what is held is a record and the piece that ends it."""
    now: str | None = None
    buffer, end = bytearray(), END.encode()

    def taken() -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            while buffer.startswith(b"\r\n"):
                del buffer[:2]
            start = buffer.find(end)
            if start < 0:
                return
            first, *rest = bytes(buffer[:start]).decode().split("\r\n")
            if first != VERSION:
                raise ValueError("no record begins here")
            headers = dict(x.split(": ", 1) for x in rest)
            stop = start + len(end) + int(headers["Content-Length"])
            if len(buffer) < stop + len(end):
                return
            if buffer[stop : stop + len(end)] != end:
                raise ValueError("a record is longer than it states")
            yield headers, bytes(buffer[start + len(end) : stop])
            del buffer[: stop + len(end)]

    for file, line in lines:
        if file != now:
            if buffer.strip():
                raise ValueError("an archive ends within a record")
            now = file
            buffer.clear()
        buffer += line
        buffer += end
        yield from taken()
    if buffer.strip():
        raise ValueError("an archive ends within a record")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives under ``path``: (record, segment, page, kind, refers_to, digest, total, block_ok, size, block); the block of a record of one segment is
    digested where it is read and left out."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            files = batch.column(0).to_pylist()
            for k, value in enumerate(batch.column(1)):
                yield files[k], value.as_buffer().to_pybytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for headers, block in _parsed(lines(batches)):
            kind, total = headers["WARC-Type"], int(headers["X-Payload-Length"])
            own = headers.get("WARC-Block-Digest")
            sha1 = _base32(hashlib.sha1(block).digest())
            single = kind == "revisit" or len(block) == total
            ok = (own is None or own[5:] == sha1) and (kind == "revisit" or not single or headers["WARC-Payload-Digest"][5:] == sha1)
            refers = headers.get("X-Refers-To-Page")
            rows.append((headers.get("WARC-Segment-Origin-ID", headers["WARC-Record-ID"])[1:-1], int(headers.get("WARC-Segment-Number", 1)), headers["X-Page-ID"], kind, refers, headers["WARC-Payload-Digest"][5:], total, ok, len(block), None if single else block))
            held += 0 if single else len(block)
            if held > 8 * CHUNK or len(rows) >= 5000:
                yield made(rows)
                rows, held = [], 0
        if rows:
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
    schema = "record string, segment int, page string, kind string, refers_to string, digest string, total long, block_ok boolean, size long, block binary"
    names = [x.split()[0] for x in schema.split(", ")]
    # a gzipped file is one partition, so its lines come in order
    texts = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path)
    return texts.select(F.col("_metadata.file_path"), "value").mapInArrow(work, schema)


def captures(chunks: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per record of a chunk table: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Those of several segments are few: their segments are put in order by their record and digested one after another. intact: blocks and payload have
    the digests that the archive states; a revisit's payload is that of the record it refers to.
    """
    single = chunks.where("block IS NULL").select("page", "kind", "refers_to", "digest", "total", F.col("block_ok").alias("intact"))
    parts = chunks.where("block IS NOT NULL").select("record", "segment", "page", "digest", "total", "block_ok", "block")

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of a record stand together and in order."""
        now, sha, size, ok, head, following = None, hashlib.sha1(), 0, True, None, 1

        def row() -> pa.RecordBatch:
            good = ok and size == head[2] and _base32(sha.digest()) == head[1]
            return pa.RecordBatch.from_pydict({"page": [head[0]], "kind": ["response"], "refers_to": pa.array([None], pa.string()), "digest": [head[1]], "total": [head[2]], "intact": [good]})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for record, segment, page, digest, total, block_ok, block in zip(*columns, batch.column(6), strict=True):
                if record != now:
                    if now is not None:
                        yield row()
                    now, sha, size, ok, head, following = record, hashlib.sha1(), 0, True, (page, digest, total), 1
                raw = memoryview(block.as_buffer())
                sha.update(raw)
                size, ok, following = size + len(raw), ok and block_ok and segment == following, following + 1
        if now is not None:
            yield row()

    long = parts.repartition("record").sortWithinPartitions("record", "segment").mapInArrow(feed, "page string, kind string, refers_to string, digest string, total long, intact boolean")
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(id_type)
    return single.unionByName(long).select(number("page").alias("page_id"), F.col("total").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"), "intact")


def round_trip(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", uri_col: str | None = None) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads them back: captures() of them.

    A null payload counts as empty, and empty payloads are equal. A null id is read back as null and is larger than any other. Repeated ids are records of
    their own; of repeated rows (same id, same payload) each is a response. Other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, id_col, body_col, 0, uri_col)
    _remove_at_exit(spark, path)
    return captures(read(spark, path), dict(pages.dtypes)[id_col]).withColumnRenamed("page_id", id_col)
