"""WARC archives as chunked record tables.

An archive is a table of (record, chunk, last, data): the bytes of a WARC/1.1 record in chunks of bounded size. A record
of one chunk is one row; of others, chunk 0 is the header block, and the chunks behind it are the content block.
Concatenating the chunks of all records in order gives a WARC file.

Payloads are cut into chunk rows where they are read; from there on no step holds more than a chunk of one. Digests go
on from chunk row to chunk row, when records are planned, written and read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import bounded_arrow, shared_dir, stored

#: Bytes of a chunk.
CHUNK_BYTES = 1 << 20
#: Parts that the copies of one payload are dealt into when they are joined with the first.
SALTS = 16
#: Smaller payloads are always stored as responses.
REVISIT_FROM = 100

_ARCHIVE = "record long, chunk int, last boolean, data binary"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
_END = b"\r\n\r\n"


def chunk_rows(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(record, page_id, mark, url, size, chunk, data): each payload in pieces. mark tells payloads of one page_id apart; record numbers rows."""
    data = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col(key).cast("long").alias("page_id"), F.xxhash64(F.col(payload)).alias("mark"), F.col(url).cast("string").alias("url"), data.alias("payload"))
    pieces = F.greatest(F.ceil(F.octet_length("payload") / chunk_bytes), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substr(F.col("payload"), i * chunk_bytes + 1, F.lit(chunk_bytes)))
    return rows.select("record", "page_id", "mark", "url", F.octet_length("payload").cast("long").alias("size"), F.posexplode(cut).alias("chunk", "data"))


_DIGESTS = "page_id long, mark long, size long, digest string"


def payload_digests(chunks: DataFrame) -> DataFrame:
    """(page_id, mark, size, digest: SHA-256) of each record of chunk rows that lie together in order."""
    bounded_arrow(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, seen = None, hashlib.sha256(), 0
        for batch in batches:
            out: list[tuple] = []
            for record, page, mark, size, data in zip(*(batch.column(c).to_pylist() for c in ("record", "page_id", "mark", "size")), batch.column("data"), strict=True):
                if record != own:
                    own, digest, seen = record, hashlib.sha256(), 0
                view = data.as_buffer()
                digest.update(view)
                seen += len(view)
                if seen == size:
                    out.append((page, mark, size, digest.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["page_id", "mark", "size", "digest"])

    return chunks.select("record", "page_id", "mark", "size", "data").mapInArrow(run, _DIGESTS)


def plan_revisits(chunks: DataFrame) -> DataFrame:
    """(page_id, mark, digest, refers_to), stored: the records whose payload an earlier page has.

    Digests alone are grouped, and what refers to them is joined in narrow rows, which are dealt over parts: a payload
    with very many copies is nobody's whole work. Ties (repeated page ids with equal payloads) are all responses: none
    refers to itself. A page without an id is a response.
    """
    narrow = stored(payload_digests(chunks).where(F.col("page_id").isNotNull() & (F.col("size") >= REVISIT_FROM)), "digests")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("most")).where("refers_to < most").drop("most")
    salted = first.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = narrow.withColumn("s", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "s"]).where("page_id != refers_to")
    return stored(met.select("page_id", "mark", "digest", "refers_to").distinct(), "revisits")


def _header(page: int | None, url: str | None, size: int, digest: str, refers_to: int | None, stored: int) -> bytes:
    uri = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html",
        f"Content-Length: {stored}",
    ]
    if refers_to is not None:
        lines[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join(lines)).encode("utf-8", "surrogatepass") + _END


def to_records(chunks: DataFrame, revisits: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Archive rows of chunk rows. Store them before reading them twice.

    revisits is a narrow table: small ones are broadcast by Spark itself, and payloads stay where they are; with larger
    ones chunk rows are dealt by page. A record's header is written when its last chunk has passed.
    """
    bounded_arrow(chunks.sparkSession)
    met = chunks.join(revisits, ["page_id", "mark"], "left").where("refers_to is null or chunk = 0")
    names = ("record", "page_id", "url", "size", "chunk", "refers_to", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for i, (record, page, url, size, chunk, refers, known) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if refers is not None:
                    rows.append((record, 0, True, _header(page, url, size, known, refers, 0) + _END))
                    continue
                data = memoryview(batch.column("data")[i].as_buffer())
                if chunk == 0:
                    digest = hashlib.sha256()
                digest.update(data)
                last = chunk * chunk_bytes + len(data) == size
                header = _header(page, url, size, digest.hexdigest(), None, size) if last else b""
                if last and chunk == 0:
                    rows.append((record, 0, True, header + data + _END))
                else:
                    rows.append((record, chunk + 1, last, bytes(data) + _END if last else bytes(data)))
                    if last:
                        rows.append((record, 0, False, header))
                held += len(data)
                if held > 4 * chunk_bytes:
                    yield _chunks(rows)
                    rows, held = [], 0
            if rows:
                yield _chunks(rows)

    return met.sortWithinPartitions("record", "chunk").select(*names, "data").mapInArrow(run, _ARCHIVE)


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    record, chunk, last, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(record, pa.int64()), pa.array(chunk, pa.int32()), pa.array(last), pa.array(data, pa.binary())], ["record", "chunk", "last", "data"])


def write_archives(pages: DataFrame, path: str, *, chunk_bytes: int = CHUNK_BYTES, **columns) -> None:
    """Write the archive table of pages to path (Parquet, in the shared folder or any store that Spark reaches)."""
    chunks = chunk_rows(pages, chunk_bytes=chunk_bytes, **columns)
    to_records(chunks, plan_revisits(chunks), chunk_bytes=chunk_bytes).write.option("compression", "zstd").parquet(path)


class _Reader:
    """Reads one record from its pieces, with a digest that goes on from piece to piece."""

    def __init__(self) -> None:
        self.head, self.fields, self.digest, self.size, self.left = bytearray(), {}, hashlib.sha256(), 0, 0

    def feed(self, piece: memoryview) -> None:
        if not self.fields:
            self.head += piece
            if (end := self.head.find(_END)) < 0:
                return
            lines = self.head[:end].decode("utf-8", "surrogatepass").split("\r\n")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            self.left = int(self.fields["Content-Length"])
            piece, self.head = memoryview(bytes(self.head[end + len(_END) :])), bytearray()
        piece = piece[: self.left]
        self.digest.update(piece)
        self.size += len(piece)
        self.left -= len(piece)

    def row(self) -> tuple:
        fields = self.fields
        page = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
        kind, stated, refers = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), page(fields.get("WARC-Refers-To"))
        if kind == "response":
            facts = self.size, self.digest.hexdigest(), self.left == 0 and self.digest.hexdigest() == stated
        else:
            facts = int(fields["X-Payload-Length"]), stated, self.left == 0 and refers is not None
        return page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], *facts[:2], kind, refers, facts[2]


def read_archives(archive: DataFrame) -> DataFrame:
    """One row for each record: page_id, url, facts of the full payload, record type, the response it refers to, intact.

    intact: the bytes that came back have the stated length and digest (a revisit stores none; it must refer to a page).
    Records of one chunk are read where they lie; only those of several are dealt by record and sorted by chunk.
    """
    bounded_arrow(archive.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        for batch in batches:
            out: list[tuple] = []
            for last, data in zip(batch.column("last").to_pylist(), batch.column("data"), strict=True):
                reader.feed(memoryview(data.as_buffer()))
                if last:
                    out.append(reader.row())
                    reader = _Reader()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])

    single = (F.col("chunk") == 0) & F.col("last")
    several = archive.where(~single).repartition("record").sortWithinPartitions("record", "chunk")
    return archive.where(single).mapInArrow(run, _READ).unionByName(several.mapInArrow(run, _READ))


def archive_path(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
