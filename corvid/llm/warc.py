"""WARC archives, compressed record by record with an embedded Zstandard dictionary.

Each archive is one ``.warc.zst`` stream: a skippable frame that holds the dictionary,
then one Zstandard frame per record.  The dictionary is trained from the archive's own
records.  Spark's text writer puts the frames into files, so any file system Spark can
write will do: a frame is one row, and the line separator is an empty skippable frame,
which readers of Zstandard streams pass over.

Rows are dealt to archives by hash; the number of archives follows the bytes of payload.
Of equal payloads only the first is stored, the others are ``revisit`` records.
"""
from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, shared_path, text_buffer

# Frame magic numbers of the WARC/Zstandard dictionary convention.
DICT_MAGIC = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
#: Payload bytes of one archive, about.
ARCHIVE_BYTES = 24 << 20
#: Bytes of a dictionary and of the records it is trained from.
DICT_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
_LEVEL = 6
_PIECE = 8 << 10
_EPOCH = "1970-01-01T00:00:00Z"


def revisits(pages: DataFrame, *, id_col: str = "page_id", text_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """``(id, refers_to, sha)`` of the rows whose payload another row with a smaller id holds."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(id_col, F.sha2(text, 256).alias("_sha"), F.octet_length(text).alias("_n"))
    rows = rows.where(F.col("_n") >= min_bytes).select(id_col, F.unhex("_sha").alias("_sha"))
    first = rows.groupBy("_sha").agg(F.min(id_col).alias("refers_to"), F.count(F.lit(1)).alias("_many")).where("_many > 1")
    return (rows.join(first.drop("_many"), "_sha").where(F.col(id_col) > F.col("refers_to"))
            .select(id_col, "refers_to", F.col("_sha")).distinct())


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    body = payload if kind == "response" else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url or "")), ("WARC-Date", _EPOCH),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + body + b"\r\n\r\n"


def _train(records: list[bytes]) -> bytes:
    """A dictionary from ``records``; raw content where there are too few to train one."""
    sample, size = [], 0
    for r in records:
        sample.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, size // 16)), sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICT_BYTES:] or b"WARC/1.1\r\n"


def _archiver(id_col: str):
    def records_of(batch) -> list[bytes]:
        col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        offsets, raw = text_buffer(col["_text"])
        rows = zip(col[id_col].to_pylist(), col["_url"].to_pylist(), col["refers_to"].to_pylist(), strict=True)
        out = []
        for k, (page_id, url, refers_to) in enumerate(rows):
            payload = raw[offsets[k]:offsets[k + 1]].tobytes()
            out.append(_record(page_id, url, payload, hashlib.sha256(payload).hexdigest(), refers_to))
        return out

    def begin(records):
        """The dictionary frame of an archive that begins with ``records``, and its compressor."""
        data = _train(records)
        words = zstandard.ZstdCompressionDict(data)
        return struct.pack("<II", DICT_MAGIC, len(data)) + data, zstandard.ZstdCompressor(
            level=_LEVEL, dict_data=words, write_content_size=True).compress

    def rows(frames):
        return pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    def run(batches):
        first: list[bytes] = []       # records gathered for the dictionary
        size, compress = 0, None
        for batch in batches:
            records = records_of(batch)
            if compress is not None:
                yield rows([compress(r) for r in records])
                continue
            first += records
            size += sum(map(len, records))
            if size >= SAMPLE_BYTES:
                frame, compress = begin(first)
                yield rows([frame, *map(compress, first)])
                first = []
        if compress is None and first:
            frame, compress = begin(first)
            yield rows([frame, *map(compress, first)])
    return run


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url",
                   text_col: str = "html", min_bytes: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one WARC record per row of ``pages`` into archives under ``path``.

    Of records with equal payloads of at least ``min_bytes`` bytes the row with the
    smallest id is a ``response`` and the others revisit it; rows that tie for the
    smallest id, rows with a null id and smaller payloads are all responses.  A null
    payload is empty.  An empty table writes no records.  Other columns are not read."""
    spark = pages.sparkSession
    bound_batches(spark)
    total = pages.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(id_col, F.col(url_col).alias("_url"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("_sha"))
    again = revisits(pages, id_col=id_col, text_col=text_col, min_bytes=min_bytes)
    # both sides are dealt by the row's id and payload, once: the parts of the join are the archives
    key = [id_col, "_sha"]
    frames = (rows.repartition(archives, *key).join(again.repartition(archives, *key).hint("shuffle_hash"), key, "left")
              .mapInArrow(_archiver(id_col), "frame binary"))
    # bytes pass unchanged through the string type, which the text writer needs
    (frames.select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", EMPTY_FRAME.decode("latin-1")).mode("errorifexists").text(path))


def _parse(record: bytes):
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def _check(fields: dict, payload: bytes) -> None:
    """A response's stored payload must be what its header says."""
    digest = hashlib.sha256(payload).hexdigest()
    if len(payload) != int(fields["X-Payload-Length"]) or f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"damaged archive: the payload of {fields['WARC-Record-ID']} is not the one its header names")


def _urn(value: str | None):
    got = re.fullmatch(r"<urn:page:(.*)>", value or "", re.S)
    return got[1] if got and got[1] else None


def _reader(with_payload: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = memoryview(content.as_buffer())
                rows, open_frame, at = [], None, 0
                while at < len(data):
                    magic, size = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (0, 0)
                    if magic & 0xFFFFFFF0 == 0x184D2A50:
                        if at + 8 + size > len(data):
                            raise ValueError("truncated archive")
                        if magic == DICT_MAGIC:
                            words = zstandard.ZstdCompressionDict(bytes(data[at + 8:at + 8 + size]))
                            open_frame = zstandard.ZstdDecompressor(dict_data=words)
                        at += 8 + size
                        continue
                    if open_frame is None:
                        raise ValueError("an archive without its dictionary")
                    # fed in small pieces, as what lies behind the frame's end is copied
                    step, parts = open_frame.decompressobj(), []
                    while not step.eof and at < len(data):
                        parts.append(step.decompress(data[at:at + _PIECE]))
                        at = min(at + _PIECE, len(data))
                    if not step.eof:
                        raise ValueError("truncated archive")
                    at -= len(step.unused_data)
                    f, payload = _parse(b"".join(parts))
                    if f["WARC-Type"] == "response":
                        _check(f, payload)
                    rows.append((_urn(f["WARC-Record-ID"]), f["WARC-Target-URI"], int(f["X-Payload-Length"]),
                                 f["WARC-Payload-Digest"].removeprefix("sha256:"), f["WARC-Type"], _urn(f.get("WARC-Refers-To")), payload))
                    if len(rows) == 256:
                        yield _batch(rows, names)
                        rows = []
                if rows:
                    yield _batch(rows, names)
    return run


def _batch(rows, names):
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c) if any(x is not None for x in c) else pa.array(c, pa.string())
                                       for c in cols[:len(names)]], names)


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """Records of the archives under ``path``: ``page_id`` and ``refers_to`` (strings),
    ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``; with ``with_payload``
    also the stored payload (empty for revisits).  Digest and length are those of the
    full payload: a response's are measured on what is read, and a mismatch with its header
    raises; a revisit's are checked against its response by :func:`check_revisits`."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = ("page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
              + ", payload binary" * with_payload)
    return files.mapInArrow(_reader(with_payload), schema)


def check_revisits(records: DataFrame) -> None:
    """Raise unless every revisit refers to a response of ``records`` with the same digest and length."""
    what = ["payload_digest", "payload_bytes"]
    told = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), *what)
    there = records.where("record_type = 'response'").select("page_id", *what).distinct()
    lost = told.join(there, ["page_id", *what], "left_anti")
    if not lost.isEmpty():
        raise ValueError(f"damaged archives: no response {lost.first().page_id!r} with the payload that revisits name")


def archive_digest(pages: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """Write ``pages`` to fresh archives in the shared folder and read every record back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, id_col=id_col)
    kind = pages.schema[id_col].dataType
    records = cut(read_archives(spark, path))
    check_revisits(records)
    return records.select(
        F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))
