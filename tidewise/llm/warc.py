"""WARC archives: writing with revisit records, and reading back by boundary-chain verification.

Spark's own text sink writes the archives and its text source reads them, cut at the magic line, so any file system that
Spark knows will do and long files are split. Every piece between two magics is a candidate record; its Content-Length
gives the offset of its successor. Tasks follow the successors inside their split; pointer jumping over the splits'
entry points then finds which candidates the chain from the start of the file reaches. Magic inside a payload is not
reached, and its piece goes back to the record that holds it.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewise.llm.common import scratch, stored

MAGIC = "WARC/1.0\r\n"
_LEN = len(MAGIC)
_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*(\d+)[ \t]*\r?$")
#: Digits of base 32 as Spark's conv() writes them, and those of RFC 4648.
_CONV32, _RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SCAN = "file string, block long, seq long, at long, size long, succ long, leaves long, whole boolean, head string, payload_bytes long, sha1 string"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 160 bits are four groups of 40."""
    h = F.sha1(payload)
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0"), _CONV32, _RFC32) for i in range(4)])


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """One record text (without the closing line end) per page, in column ``value``.

    Of pages with equal payloads of at least ``min_bytes`` bytes those with the smallest id are responses, the others
    revisits that refer to that id; only responses carry the payload. Null payloads count as empty. A null id is larger
    than any id, and refers to nothing nor is referred to. Rows repeated with the smallest id are all responses.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    narrow = pages.select(
        F.col(id_col).cast("long").alias("_id"),
        F.col(url_col).cast("string").alias("_url"),
        F.sha2(payload, 256).alias("_key"),
        sha1_base32(payload).alias("_sha1"),
        F.length(payload).cast("long").alias("_n"),
    )
    known = stored(narrow)
    first = known.where(F.col("_n") >= min_bytes).groupBy("_key").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1 AND _first IS NOT NULL")
    again = stored(known.join(first.drop("_rows"), "_key").where(~F.col("_id").eqNullSafe(F.col("_first"))))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))

    def head(kind: str, length: Column, *more: Column) -> Column:
        url = F.regexp_replace(F.regexp_replace("_url", "\r", "%0D"), "\n", "%0A")
        return F.concat_ws(
            "\r\n",
            F.lit(f"WARC/1.0\r\nWARC-Type: {kind}"),
            F.concat(F.lit("WARC-Record-ID: "), urn("_id")),
            F.concat(F.lit("WARC-Target-URI: "), url),
            F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("_sha1")),
            *more,
            F.concat(F.lit("Content-Length: "), length.cast("string")),
            F.lit("\r\n"),
        )

    revisits = again.select(
        F.concat(
            head(
                "revisit",
                F.lit(0),
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
                F.concat(F.lit("WARC-Refers-To: "), urn("_first")),
                F.concat(F.lit("X-Payload-Length: "), F.col("_n").cast("string")),
            ),
            F.lit("\r\n"),
        ).alias("value")
    )
    full = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload")).withColumn("_key", F.sha2("_payload", 256))
    gone = again.select("_id", "_key").distinct()
    kept = full.join(gone, full["_id"].eqNullSafe(gone["_id"]) & (full["_key"] == gone["_key"]), "left_anti")
    kept = kept.withColumn("_sha1", sha1_base32(F.col("_payload")))
    responses = kept.select(F.concat(head("response", F.length("_payload")).cast("binary"), F.col("_payload"), F.lit(b"\r\n")).cast("string").alias("value"))
    return responses.unionByName(revisits)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Archives under ``path``, one file per task."""
    plan_records(pages, id_col, url_col, payload_col, min_bytes).write.option("lineSep", "\r\n").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("lineSep", MAGIC)
        .option("pathGlobFilter", "*")
        .text(path)
        .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    )


def _numbered(batches):
    """(split, seq, at, bytes) of each piece; rows of a split follow each other in file order."""
    split, seq, at = None, 0, 0
    for b in batches:
        for value, file, block in zip(b.column("value"), b.column("file").to_pylist(), b.column("block").to_pylist()):
            if (file, block) != split:
                split, seq, at = (file, block), 0, 0
            data = value.as_py()
            yield split, seq, at, data
            seq, at = seq + 1, at + len(data) + _LEN


def _candidate(data: bytes):
    """Length of the header and of the content, or None where the piece doesn't begin with a header block."""
    end = data.find(b"\r\n\r\n")
    found = _LENGTH.search(data, 0, end + 2) if end >= 0 else None
    return (end + 4, int(found[1])) if found else None


def _scan(batches):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("succ", pa.int64()), ("leaves", pa.int64()), ("whole", pa.bool_()), ("head", pa.string()), ("payload_bytes", pa.int64()), ("sha1", pa.string())])

    def finish(split, rows):
        end = rows[-1]["at"] + rows[-1]["size"] + _LEN
        leaves = {}
        for r in reversed(rows):  # a successor lies behind its record
            s = r["succ"]
            r["leaves"] = leaves[r["at"]] = None if s is None else s if s >= end else leaves.get(s)
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    rows, current = [], None
    for split, seq, at, data in _numbered(batches):
        if split != current and rows:
            yield finish(current, rows)
            rows = []
        current = split
        row = dict(file=split[0], block=split[1], seq=seq, at=at, size=len(data), succ=None, leaves=None, whole=None, head=None, payload_bytes=None, sha1=None)
        if (c := _candidate(data)) and (split[1] or seq):
            head, content = c
            row |= dict(succ=at + head + content + 4 + _LEN, whole=head + content + 4 == len(data), head=data[: head - 2].decode("utf-8", "replace"), payload_bytes=content)
            if head + content <= len(data):
                row["sha1"] = base64.b32encode(hashlib.sha1(memoryview(data)[head : head + content]).digest()).decode()
        rows.append(row)
    if rows:
        yield finish(current, rows)


def _follow(batch):
    """Pieces of one split, in order: which of them are records, and the record (by position) that holds each of the others."""
    b = batch.sort_values("seq")
    entry = b["entry"].to_numpy()
    ats, succ = b["at"].to_numpy(), b["succ"].astype("Float64").to_numpy(dtype=float, na_value=math.nan)
    where = {int(a): i for i, a in enumerate(ats)}
    reached = [False] * len(b)
    for i in entry.nonzero()[0]:
        j = int(i)
        while j is not None and not reached[j]:
            reached[j] = True
            j = None if math.isnan(succ[j]) else where.get(int(succ[j]))
    owner, owners = None, []
    for hit, pos in zip(reached, b["pos"].to_numpy()):
        owner = int(pos) if hit else owner
        owners.append(owner)
    out = b[["file", "block", "seq", "pos"]].copy()
    out["reached"], out["owner"] = reached, owners
    out["owner"] = out["owner"].astype("Int64")
    return out


def chain(spark: SparkSession, path: str) -> DataFrame:
    """All pieces of the archives with ``pos`` (file offset after the magic), ``reached`` and ``owner`` (``pos`` of the record)."""
    pieces = stored(_pieces(spark, path).mapInArrow(_scan, SCAN))
    blocks = pieces.groupBy("file", "block").agg(F.max(F.col("at") + F.col("size") + _LEN).alias("total"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(blocks.withColumn("base", F.coalesce(F.sum("total").over(upto), F.lit(0))))
    placed = pieces.join(blocks.select("file", "block", "base"), ["file", "block"]).withColumn("pos", F.col("base") + F.col("at"))
    starts = blocks.select("file").distinct().select("file", F.lit(_LEN).cast("long").alias("pos"))
    hops = placed.where("leaves IS NOT NULL").select("file", "pos", (F.col("base") + F.col("leaves")).alias("next"))
    most = blocks.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    reach = starts
    if most > 1:
        asked = hops.select("file", F.col("next").alias("pos")).distinct().unionByName(starts).distinct()
        jump, reach = stored(hops.join(asked, ["file", "pos"])), stored(starts)
        for _ in range(math.ceil(math.log2(most)) + 1):
            reach = stored(reach.unionByName(reach.join(jump, ["file", "pos"]).select("file", F.col("next").alias("pos"))).distinct())
            further = jump.select("file", F.col("pos").alias("next"), F.col("next").alias("then"))
            jump = stored(jump.join(further, ["file", "next"]).select("file", "pos", F.col("then").alias("next")))
    entries = placed.join(reach.withColumn("entry", F.lit(True)), ["file", "pos"], "left").select("file", "block", "seq", "at", "succ", "pos", F.coalesce("entry", F.lit(False)).alias("entry"))
    marked = entries.groupBy("file", "block").applyInPandas(_follow, "file string, block long, seq long, pos long, reached boolean, owner long")
    # What a split begins with may belong to a record of an earlier one.
    last = marked.groupBy("file", "block").agg(F.max("owner").alias("last"))
    before = last.select("file", "block", F.last("last", True).over(upto).alias("before"))
    linked = marked.join(before, ["file", "block"]).select("file", "block", "seq", "reached", F.coalesce("owner", "before").alias("owner"))
    return placed.join(linked, ["file", "block", "seq"])


def _keep_pieces(batches):
    for split, seq, _, data in _numbered(batches):
        yield pa.RecordBatch.from_pylist([dict(file=split[0], block=split[1], seq=seq, value=data)], schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("value", pa.binary())]))


def contents(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """``file, pos, payload`` of the records whose pieces are given (``file, block, seq, owner``), joined again across magic."""
    pieces = _pieces(spark, path).mapInArrow(_keep_pieces, "file string, block long, seq long, value binary")
    held = pieces.join(records.select("file", "block", "seq", "owner"), ["file", "block", "seq"])
    parts = held.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("p"))

    @F.pandas_udf("binary")
    def payload(whole):
        out = []
        for pieces in whole:
            data = MAGIC.encode().join(bytes(p["value"]) for p in pieces)
            head, n = _candidate(data)
            out.append(data[head : head + n])
        import pandas as pd

        return pd.Series(out)

    return parts.select("file", F.col("owner").alias("pos"), payload("p").alias("payload"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records that the chain reaches: ``file, offset, head, payload_bytes, sha1`` (of the payload as read).

    A record that the end of its file cuts off is left out. Empty archives give no row.
    """
    known = stored(chain(spark, path))
    records = known.where("reached AND head IS NOT NULL")
    long = records.where("NOT whole").select("file", F.col("pos").alias("owner"), "head", "payload_bytes")
    parts = stored(known.join(long.select("file", "owner"), ["file", "owner"], "left_semi").select("file", "block", "seq", "owner"))
    plain = records.where("whole").select("file", (F.col("pos") - _LEN).alias("offset"), "head", "payload_bytes", "sha1")
    if parts.isEmpty():
        return plain
    # The last record of a file has no magic behind it; whole covers it, for the piece ends with the record.
    gathered = contents(spark, path, parts).join(long.withColumnRenamed("owner", "pos"), ["file", "pos"]).where(F.length("payload") == F.col("payload_bytes"))
    return plain.unionByName(gathered.select("file", (F.col("pos") - _LEN).alias("offset"), "head", "payload_bytes", sha1_base32(F.col("payload")).alias("sha1")))


def field(name: str, pattern: str = r"([^\r\n]*)") -> Column:
    """A header field of ``head``, or null."""
    found = F.regexp_extract("head", rf"(?im)^{re.escape(name)}:[ \t]*{pattern}", 1)
    return F.when(found != "", found)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or scratch(spark)
    write(pages, path)
    revisit = field("WARC-Type") == "revisit"
    return read(spark, path).select(
        field("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page_id"),
        F.when(revisit, field("X-Payload-Length").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, field("WARC-Payload-Digest", r"sha1:(\w+)")).otherwise(F.col("sha1")).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
    )
