"""WARC archives as chunked record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payload bytes of a chunk. A longer payload is written as numbered segments, one row each.
CHUNK_BYTES = 1 << 16
CRLF = "\r\n"
#: Fixed values of base 32: the digits of a radix-32 number and the alphabet that stands for them.
RADIX_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32, four digits for each five hexadecimal ones."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), RADIX_DIGITS, BASE32)


def with_roles(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """Adds ``payload``, ``digest``, ``size`` and ``first_id``, the record that is the response of equal payloads.

    Payloads are equal if digest and length are. The smallest id per payload is an aggregate that combines before the
    shuffle; only ids and digests take part in it.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), *_extra(pages, id_col, payload_col), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.length("payload").cast("long"))
    first = rows.filter(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("id").alias("first_id"))
    first = first.withColumnRenamed("digest", "__digest").withColumnRenamed("size", "__size")
    return rows.join(first, (F.col("digest") == F.col("__digest")) & (F.col("size") == F.col("__size")), "left").drop(
        "__digest", "__size"
    )


def _extra(pages: DataFrame, id_col: str, payload_col: str) -> list[Column]:
    """The target address, if there is one."""
    return [(F.col("url") if "url" in pages.columns else F.lit(None).cast("string")).alias("url")]


def record_id(number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("none")), F.lit(">"))


def record_rows(rows: DataFrame) -> DataFrame:
    """The chunk table: a row per record segment, ``(id, chunk_no, record)``, the record as the archive's bytes."""
    revisit = F.col("first_id").isNotNull() & (F.col("first_id") != F.coalesce("id", F.lit(-(1 << 63))))
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    chunks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(body) / CHUNK_BYTES).cast("int") - 1))
    rows = rows.withColumn("revisit", revisit).withColumn("chunks", F.size(chunks))
    rows = rows.withColumn("chunk_no", F.explode(chunks))
    at = F.col("chunk_no") * CHUNK_BYTES + 1
    part = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.substring(F.col("payload"), at, F.lit(CHUNK_BYTES)))
    rows = rows.withColumn("part", part)
    own = record_id(F.col("id"))
    kind = F.when(F.col("chunk_no") > 0, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    segmented = F.col("chunks") > 1
    last = segmented & (F.col("chunk_no") == F.col("chunks") - 1)
    lines = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.when(F.col("chunk_no") == 0, F.concat(F.lit("WARC-Record-ID: "), own)).otherwise(
            F.concat(F.lit("WARC-Segment-Origin-ID: "), own)
        ),
        F.when(
            F.col("url").isNotNull() & (F.col("chunk_no") == 0),
            F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", " ")),
        ),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("first_id")))),
        F.when(segmented, F.concat(F.lit("WARC-Segment-Number: "), (F.col("chunk_no") + 1).cast("string"))),
        F.when(last, F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("size").cast("string"))),
        F.concat(F.lit("Content-Length: "), F.length("part").cast("string")),
        F.lit(CRLF),
    )
    return rows.select("id", "chunk_no", F.concat(F.encode(lines, "UTF-8"), F.col("part")).alias("record"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0
) -> None:
    """Writes a record per row into gzipped archives, one file per task.

    Of records with equal payloads of at least ``least_bytes`` bytes that with the smallest id is a response and the
    others revisit it; rows that share this id with it are responses too. A null payload is empty. A null id is
    written as ``none`` and never the smallest unless all are null, in which case all are responses. Segments of a
    record follow one another in one file. The text writer puts two line ends after each record, as the format wants.
    """
    records = record_rows(with_roles(pages, id_col, payload_col, least_bytes))
    # Bytes in a string column go to the file as they are.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", CRLF * 2).option(
        "compression", "gzip"
    ).text(folder)


def _parse(pieces):
    """Streams ``(header, part, is_last_part)`` of records from archives that a reader has cut at double line ends.

    The cuts are undone first, so it does not matter where a payload's own line ends were cut.
    """
    pieces, held = iter(pieces), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
            held.extend(b"\r\n\r\n")
        return piece is not None

    while True:
        while held[:1] in (b"\r", b"\n"):
            del held[:1]
        if not held:
            if not more():
                return
            continue
        while (end := held.find(b"\r\n\r\n")) < 0:
            more()
        lines = held[:end].decode().split(CRLF)
        del held[: end + 4]
        header = dict(line.split(": ", 1) for line in lines[1:])
        left = int(header["Content-Length"])
        while True:
            part = bytes(held[:left])
            del held[: len(part)]
            left -= len(part)
            yield header, part, not left
            if not left:
                break
            more()


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table of archives, ``(id, chunk_no, kind, refers_to, bytes, digest, closed)``.

    Pieces of a file stream through one task in order; a record's digest is carried from chunk to chunk and given with
    each of them, so no record is ever held whole. ``closed`` marks a record's last chunk; there ``bytes`` is the whole
    length and ``digest`` that of the whole payload as read, checked against the header.
    """

    def run(batches):
        import base64
        import hashlib

        import pandas as pd

        pieces = (p for b in batches for p in b["value"])
        record, seen, out = None, None, []
        for header, part, done in _parse(pieces):
            if header is not seen and header["WARC-Type"] != "continuation":
                name = header["WARC-Record-ID"][10:-1]
                record = {"id": None if name == "none" else int(name), "kind": header["WARC-Type"], "chunk_no": -1}
                refers = header.get("WARC-Refers-To", "<urn:page:none>")[10:-1]
                record["refers_to"] = None if refers == "none" else int(refers)
                state, size = hashlib.sha1(), 0
            seen = header
            state.update(part)
            size += len(part)
            if not done:
                continue
            closed = "WARC-Segment-Number" not in header or "WARC-Segment-Total-Length" in header
            digest = base64.b32encode(state.digest()).decode()
            told = header["WARC-Payload-Digest"][5:]
            if record["kind"] == "revisit":
                digest = told
            elif closed and (digest != told or size != int(header.get("WARC-Segment-Total-Length", size))):
                raise ValueError(f"record {record['id']} is damaged")
            record["chunk_no"] += 1
            out.append(record | {"bytes": size, "digest": digest, "closed": closed})
            if len(out) >= 5000:
                yield pd.DataFrame(out).astype({"id": "Int64", "refers_to": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out).astype({"id": "Int64", "refers_to": "Int64"})

    lines = spark.read.option("lineSep", CRLF * 2).schema("value string").text(folder)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInPandas(
        run, "id long, kind string, chunk_no int, refers_to long, bytes long, digest string, closed boolean"
    )


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record: ``(id, payload_bytes, payload_digest, record_type, refers_to)``.

    A revisit takes its length from the response that has its digest.
    """
    closed = chunks.filter("closed")
    sizes = closed.filter("kind = 'response'").groupBy(F.col("digest").alias("__digest")).agg(F.max("bytes").alias("__bytes"))
    out = closed.join(sizes, F.col("digest") == F.col("__digest"), "left")
    return out.select(
        "id",
        F.when(F.col("kind") == "revisit", F.col("__bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to",
    )
