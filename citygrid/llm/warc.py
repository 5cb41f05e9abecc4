"""WARC archives: written with revisit records for equal payloads, read back with boundary-chain verification.

Writing. Equal payloads of at least `least` bytes are found by digest and size (a maximum of page_id, combined before the shuffle);
the record with the largest page_id is the response, others revisit it. The few payloads that make up over 1 / HOT of all pages go to
every task, and so do all repeated ones while they are few; only beyond that are pages shuffled by digest. Records go out through Spark's text writer, whose line
separator is the end of a record, so files are committed by Spark and lie on any file system it knows.

Reading. Files are split at the magic line by Spark's text reader (compressed ones, of at most RECORDS records, are one block each); a task emits for each piece its length, its header and what
offset its record's successor would have. Offsets follow from the pieces' lengths, summed within a block of a file and then over
blocks. A magic inside a payload gives a false candidate. Per file, pointer jumping from offset 0 (doubling the jump each round)
finds the offsets that records really start at; only those count. This needs a file's offsets in one task, 16 bytes a record, and
files hold at most RECORDS records. A record whose payload holds the magic is in several pieces: for these alone the files are read
once more and their pieces joined.

Pieces are bytes from the reader on, so archives whose payloads or headers aren't UTF-8 are read like others.
Nulls: null html is empty, a null url too; of records without page_id only their payload is told. Repeated rows of one page are
responses alike where they are the last of their payload. An empty table gives an empty archive and no rows.
A very long payload is one record, in as many pieces as it holds magic lines. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, lean, new_path, only

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
RECORDS = 20_000
HOT = 1000


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, from its hexadecimal form, 40 bits at a time."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, path: str, least: int = 0, compression: str = "gzip") -> None:
    """Write pages(page_id, url, html) as WARC files below path."""
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\r\n]", "").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    page = page.withColumns({"size": F.octet_length("html").cast("long"), "digest": base32_sha1(F.col("html").cast("binary"))})
    on = ["digest", "size"]
    last = page.groupBy(*on).agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    last = cut(last.where("n > 1").join(F.broadcast(page.agg(F.count("*").alias("total")))), "payloads")
    often = page.join(F.broadcast(last.where(f"n * {HOT} > total").select(*on, "last")), on, "left")  # under HOT rows
    rest = only(often.where("last IS NULL").drop("last"), cut(last.where(f"n * {HOT} <= total").select(*on, "last"), "payloads"), on, "left")
    page = often.where("last IS NOT NULL").unionByName(rest)
    again = (F.col("size") >= least) & F.coalesce(F.col("page_id") != F.col("last"), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name("page_id"), F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nPayload-Length: "), F.col("size").cast("string"),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), name("last"))).otherwise(""), F.lit("\r\nContent-Length: "), F.when(again, "0").otherwise(F.col("size").cast("string")), F.lit(END),
    )
    record = page.select(F.concat(head, F.when(again, "").otherwise(F.col("html"))).alias("value"))
    record.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", RECORDS).text(path)


def _header(raw: bytes) -> tuple[dict[str, str], int]:
    """The header's fields, and its length with the blank line; a length of 0 if there is no blank line."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return {}, 0
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v for k, x, v in (line.partition(": ") for line in lines) if x}, end + 4


def _number(s: str | None) -> int | None:
    s = (s or "").removeprefix("<urn:page:").removesuffix(">")
    return int(s) if s.lstrip("-").isascii() and s.lstrip("-").isdigit() else None


def base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


_PIECE = "file string, block long, at long, size long, ahead long, kind string, page_id long, refers_to long, told_digest string, told_bytes long, whole boolean, digest string, bytes long"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of a block come in order; at: bytes of the block's pieces before; ahead: bytes from the piece's magic to its successor."""
    now, at = None, 0
    for pdf in batches:
        rows = []
        for file, block, text in zip(pdf["file"], pdf["block"], pdf["value"]):
            if (file, block) != now:
                now, at = (file, block), 0
            raw = bytes(text)
            fields, head = _header(raw)
            content = _number(fields.get("content-length")) if head else None
            if content is not None and content >= 0:
                body = raw[head : head + content]
                whole = len(raw) >= head + content
                rows.append((
                    file, block, at, len(raw) + len(MAGIC), len(MAGIC) + head + content + len(END), fields.get("warc-type"), _number(fields.get("warc-record-id")), _number(fields.get("warc-refers-to")),
                    fields.get("warc-payload-digest", "").removeprefix("sha1:"), _number(fields.get("payload-length")), whole, base32(body) if whole else None, len(body) if whole else None,
                ))
            else:
                rows.append((file, block, at, len(raw) + len(MAGIC), *[None] * 9))
            at += len(raw) + len(MAGIC)
        frame = pd.DataFrame(rows, columns=[x.split()[0] for x in _PIECE.split(", ")])
        yield frame.astype({c: "Int64" for c in ("ahead", "page_id", "refers_to", "told_bytes", "bytes")} | {"whole": "boolean"})


def reachable(start: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates (sorted by start) the chain from offset 0 meets, by pointer jumping."""
    n = start.size
    to = np.searchsorted(start, successor)
    to = np.where((to < n) & (start[np.minimum(to, n - 1)] == successor), to, n)
    to = np.append(to, n)
    met = np.zeros(n + 1, bool)
    met[:1] = n > 0 and start[0] == 0
    for _ in range(max(n, 1).bit_length()):
        met[to[met]] = True
        to = to[to]
    return met[:n]


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("start")
    return pdf.loc[reachable(pdf["start"].to_numpy(np.int64), (pdf["start"] + pdf["ahead"]).to_numpy(np.int64)), ["file", "start"]]


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _with_start(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    return pieces.join(blocks, ["file", "block"]).withColumn("start", F.col("base") + F.col("at") - len(MAGIC))


def _raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, at = None, 0
    for pdf in batches:
        out = []
        for file, block, text in zip(pdf["file"], pdf["block"], pdf["value"]):
            if (file, block) != now:
                now, at = (file, block), 0
            raw = bytes(text)
            out.append((file, block, at, raw))
            at += len(raw) + len(MAGIC)
        yield pd.DataFrame(out, columns=["file", "block", "at", "raw"])


def _join_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for file, start, ahead, parts in zip(pdf["file"], pdf["start"], pdf["ahead"], pdf["parts"]):
            raw = MAGIC.encode().join(x["raw"] for x in sorted(parts, key=lambda x: x["start"]))
            body = raw[_header(raw)[1] : ahead - len(MAGIC) - len(END)]
            out.append((file, start, base32(body), len(body)))
        yield pd.DataFrame(out, columns=["file", "start", "digest2", "bytes2"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records below path, digests of responses from their bytes."""
    pieces = cut(_text(spark, path).mapInPandas(lean(_pieces), _PIECE), "pieces")
    sums = pieces.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    placed = _with_start(pieces, blocks).where("ahead IS NOT NULL AND start >= 0")
    chain = placed.select("file", "start", "ahead").groupBy("file").applyInPandas(_chain, "file string, start long")
    records = placed.join(chain, ["file", "start"])
    records = cut(records.drop("block", "at", "size", "base"), "records")
    split = records.where("NOT whole").select("file", "start", "ahead")
    if split.limit(1).count():
        parts = _with_start(_text(spark, path).mapInPandas(lean(_raw), "file string, block long, at long, raw binary"), blocks)
        # a piece belongs to the last split record that starts at or before it, if that reaches it
        mark = split.select("file", F.col("start").alias("s"), F.struct("start", "ahead").alias("of"), F.lit(None).cast("binary").alias("raw"))
        parts = parts.select("file", F.col("start").alias("s"), F.lit(None).cast("struct<start:long,ahead:long>").alias("of"), "raw")
        so_far = Window.partitionBy("file").orderBy("s", F.col("raw").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        owned = mark.unionByName(parts).withColumn("of", F.last("of", ignorenulls=True).over(so_far)).where("raw IS NOT NULL AND s < of.start + of.ahead")
        whole = owned.groupBy("file", "of").agg(F.collect_list(F.struct(F.col("s").alias("start"), "raw")).alias("parts")).select("file", "of.start", "of.ahead", "parts")
        joined = whole.mapInPandas(lean(_join_pieces), "file string, start long, digest2 string, bytes2 long")
        records = records.join(joined, ["file", "start"], "left").withColumns({"digest": F.coalesce("digest", "digest2"), "bytes": F.coalesce("bytes", "bytes2")})
    again = F.col("kind") == "revisit"
    return records.select(
        "page_id", F.when(again, F.col("told_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), F.when(again, F.col("told_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.when(again, F.col("refers_to")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, least: int = 0, compression: str = "gzip") -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, least, compression)
    return read(pages.sparkSession, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
parts AS (SELECT page_id, octet_length(encode(html)) AS size, h, list_transform([1, 11, 21, 31], lambda i: ('0x' || substr(h, i, 10))::BIGINT) AS v FROM p),
d AS (SELECT page_id, size, list_reduce(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[(k // 8) + 1] >> (35 - 5 * (k % 8))) & 31)::INT + 1, 1)), lambda a, b: a || b) AS digest FROM parts),
l AS (SELECT *, max(page_id) OVER (PARTITION BY digest, size) AS last FROM d)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to FROM l
"""
