"""WARC archives: a writer through Spark's own committer and a splittable reader.

Every record is a gzip member of its own. A member ends with its length modulo 2**32, whose last
byte is 0 below 16 MiB; the text sink writes member[:-1] as a line and the line separator "\\0" gives
that last byte back, so archives go to any store Spark can write and are committed like any table. A
longer record is followed by an empty member, which ends in 0 too.

The reader gives byte ranges to tasks by Spark's text source with the gzip magic as the separator.
A range owns the pieces that start inside it and reads on past its end for the last one. A piece
becomes a record if it inflates and begins with a WARC header; compressed data that happen to
contain the magic cut a member in two, and a member that has not ended takes the pieces that
follow. When such a cut falls on the edge of a range, the open member and the loose pieces behind it
are put together per file in a last, tiny step. A record whose member is cut short or corrupt is left
out; the records behind it are read. A file that is a single gzip member has no place to split and is one
task's work; a file without WARC members gives no record.

Defined results: null payload is an empty payload; a null url leaves the header out; control
characters and blanks in a url are percent-encoded; equal payloads of at least `least` bytes get
one response, that with the smallest page_id (each of its repeated rows is one), and the others are
revisits of it; a null page_id is never smallest unless all are null; extra columns are ignored; an
empty table writes no record. Archive names must not end in .gz, or the text source inflates them.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections import deque
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str) -> str:
    return quote(url, safe="".join(chr(c) for c in range(0x21, 0x7F)))


def record_bytes(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One uncompressed WARC record; refers_to is None for a response."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>"]
    head += [f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes) -> bytes:
    """A gzip member whose last byte is 0."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out.endswith(b"\0") else out + _EMPTY


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """One record per row of pages (page_id, url, html) into archives under path."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    firsts = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.min("page_id").alias("first"))
    records = rows.join(firsts, "sha", "left").withColumn(
        "refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    )

    def members(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                page, url, html, ref = (batch.column(i)[row].as_py() for i in range(4))
                line = gzip_member(record_bytes(page, url, html.encode(), ref, date))[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([line], pa.binary())], names=["member"])

    lines = records.select("page_id", "url", "html", "refers_to").mapInArrow(members, "member binary")
    lines.selectExpr("cast(member as string) as value").write.option("lineSep", "\0").option("compression", "none").text(path)


_PIECE = "file string, start long, seq long, open boolean, piece binary"
_RECORD = "headers map<string,string>, payload binary, payload_bytes long, payload_digest string"


class _Member:
    """Inflates one gzip member piece by piece."""

    def __init__(self):
        self.z, self.out = zlib.decompressobj(31), b""

    def feed(self, piece: bytes) -> bool:
        """False if the bytes are no gzip data or do not begin a WARC record."""
        try:
            self.out += self.z.decompress(piece)
        except zlib.error:
            return False
        return self.out[:6] == b"WARC/1"[: len(self.out[:6])] and (not self.z.eof or len(self.out) > 6)


def parse_record(raw: bytes) -> tuple[dict, bytes]:
    """Header fields and HTTP payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields.get("Content-Length", 0))]
    return fields, block.partition(b"\r\n\r\n")[2] if fields.get("Content-Type", "").startswith("application/http") else block


def _join_pieces(pieces, leftover):
    """Records of consecutive pieces; what belongs to no record here goes to leftover(open, piece).

    A member that turns out to be cut short or corrupt goes, and every piece that it had taken is tried
    as the begin of a member of its own. Pieces before the first record, and those of a member that has
    not ended, are left over.
    """
    again, held, member, seen = deque(), [], None, False
    pieces = iter(pieces)
    while (piece := again.popleft() if again else next(pieces, None)) is not None:
        if member is not None:
            held.append(piece)
            if not member.feed(piece):
                again.extendleft(reversed(held[1:]))
                member = None
        else:
            fresh = _Member()
            if fresh.feed(piece):
                member, held, seen = fresh, [piece], True
            elif not seen:
                leftover(False, piece)
        if member is not None and member.z.eof:
            yield member.out
            member = None
    if member is not None:
        for k, piece in enumerate(held):
            leftover(k == 0, piece)


def _arrow(records, left, keep_payload):
    fields, payload, size, digest = [], [], [], []
    for raw in records:
        f, body = parse_record(raw)
        fields.append(list(f.items()))
        payload.append(body if keep_payload else None)
        size.append(len(body))
        digest.append(payload_digest(body))
    n = len(fields) + len(left)
    pad = [None] * len(left)
    none = [None] * len(fields)
    cols = [
        pa.array(fields + pad, pa.map_(pa.string(), pa.string())),
        pa.array(payload + pad, pa.binary()),
        pa.array(size + pad, pa.int64()),
        pa.array(digest + pad, pa.string()),
        *(pa.array(none + [x[i] for x in left], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))),
    ]
    assert all(len(c) == n for c in cols)
    return pa.RecordBatch.from_arrays(cols, names=["headers", "payload", "payload_bytes", "payload_digest", "file", "start", "seq", "open", "piece"])


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """(headers, payload, payload_bytes, payload_digest) of every record of the archives under path.

    Length and digest are those of the payload read, not what the header says.
    """
    pieces = (
        spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
        .selectExpr("_metadata.file_path as file", "_metadata.file_block_start as start", "cast(value as binary) as piece")
    )

    def owned(batches):
        left: list = []
        state: dict = {"at": None}

        def rows():
            for batch in batches:
                for k in range(batch.num_rows):
                    yield (batch.column(0)[k].as_py(), batch.column(1)[k].as_py()), batch.column(2)[k].as_py()

        def ranges():
            """Consecutive pieces of one byte range at a time."""
            stream = rows()
            state["next"] = next(stream, None)
            while state["next"] is not None:
                at = state["at"] = state["next"][0]

                def same(at=at):
                    while state["next"] is not None and state["next"][0] == at:
                        piece = state["next"][1]
                        state["next"] = next(stream, None)
                        if piece:
                            yield MAGIC + piece

                yield at, same()

        for (file, start), own in ranges():
            held: list = []
            for raw in _join_pieces(own, lambda is_open, piece: left.append((file, start, len(left), is_open, piece))):
                held.append(raw)
                if len(held) >= 64:
                    yield _arrow(held, [], keep_payload)
                    held = []
            if held:
                yield _arrow(held, [], keep_payload)
            if left:
                yield _arrow([], left, keep_payload)
                left.clear()

    found = pieces.mapInArrow(owned, f"{_RECORD}, {_PIECE}")

    def mended(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "seq"])
        out = []
        for _, part in pdf.groupby(pdf["open"].cumsum()):
            if part["open"].iloc[0]:
                for raw in _join_pieces(part["piece"], lambda is_open, piece: None):
                    f, body = parse_record(raw)
                    out.append((f, body if keep_payload else None, len(body), payload_digest(body)))
        return pd.DataFrame(out, columns=["headers", "payload", "payload_bytes", "payload_digest"])

    whole = found.where("headers is not null").select("headers", "payload", "payload_bytes", "payload_digest")
    loose = found.where("headers is null").select("file", "start", "seq", "open", "piece")
    return whole.union(loose.groupBy("file").applyInPandas(mended, _RECORD))


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """The digest of archives that write_warc wrote: one row per page, read from its record.

    A revisit has no payload; its length and digest are those its header states for the response.
    """
    rows = read_warc(spark, path, keep_payload=False)
    h = F.col("headers")
    kind = h["WARC-Type"]
    stated = F.regexp_replace(h["WARC-Payload-Digest"], "^sha1:", "")
    return rows.select(
        h["X-Page-ID"].cast("long").alias("page_id"),
        F.when(kind == "response", F.col("payload_bytes")).otherwise(h["X-Payload-Length"].cast("long")).alias("payload_bytes"),
        F.when(kind == "response", F.col("payload_digest")).otherwise(stated).alias("payload_digest"),
        kind.alias("record_type"),
        h["X-Refers-To-Page-ID"].cast("long").alias("refers_to"),
    )
