"""Document fingerprints by content-defined chunking.

A gear hash over the last sixteen bytes cuts the UTF-8 text where its upper bits are zero: a strict condition up to the
normal size, a loose one behind it (normalised chunking). An insertion only changes the chunks it touches. The
fingerprint is the set of chunk digests with their lengths; likeness is the share of length that two sets have in
common, measured on the smaller one (containment).
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.llm.common import parallelism

SMALLEST, NORMAL, LARGEST = 16, 64, 256
STRICT_BITS, LOOSE_BITS = 8, 4
#: The gear: a random word for each byte.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256)], np.uint32)


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= SMALLEST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):  # sums over 2, 4, 8 and 16 bytes
        h[step:] += h[:-step] << np.uint32(step)
    loose = np.flatnonzero(h < (1 << (32 - LOOSE_BITS)))
    strict = (loose[h[loose] < (1 << (32 - STRICT_BITS))] + 1).tolist()
    loose = (loose + 1).tolist()
    ends, at = [], 0
    while n - at > SMALLEST:
        i = bisect_left(strict, at + SMALLEST)
        if i < len(strict) and strict[i] <= at + NORMAL:
            at = strict[i]
        else:
            i = bisect_left(loose, at + NORMAL)
            at = min(loose[i] if i < len(loose) else n, at + LARGEST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunk_set(text: str) -> frozenset[int]:
    """Chunks as numbers: 48 bits of digest above 16 bits of length."""
    data, at, out = text.encode("utf-8", "surrogatepass"), 0, set()
    for end in boundaries(data):
        out.add((xxhash.xxh3_64_intdigest(data[at:end]) >> 16) << 16 | (end - at))
        at = end
    return frozenset(out)


def as_text(chunks: frozenset[int]) -> str:
    return base64.b64encode(np.array(sorted(chunks), ">u8").tobytes()).decode()


def from_text(fingerprint: str) -> frozenset[int]:
    return frozenset(np.frombuffer(base64.b64decode(fingerprint), ">u8").tolist())


def likeness(a: frozenset[int], b: frozenset[int]) -> float:
    """Common length as part of the smaller set's; two empty sets are alike, an empty and another one are not."""
    if not a or not b:
        return float(not a and not b)
    weigh = lambda s: sum(x & 0xFFFF for x in s)
    return weigh(a & b) / min(weigh(a), weigh(b))


def fingerprints(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``fingerprint`` of the whole text. Null texts count as empty, whose fingerprint is empty."""
    fields = [df.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["fingerprint string"])

    def run(batches):
        for b in batches:
            done = pa.array([as_text(chunk_set(t)) for t in b.column("_text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], done], names=[*keep, "fingerprint"])

    return df.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).mapInArrow(run, schema)


def _part(key: Column, bounds: list[int]) -> Column:
    """How many bounds are not above the key (null: 0), by a search in two levels."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    whole = F.array(*[F.lit(b) for b in bounds])
    coarse = F.array(*[F.lit(b) for b in bounds[::step]])
    n = F.size(F.filter(coarse, lambda b: b <= key))
    rest = F.slice(whole, (n - 1) * step + 1, step)
    return F.when(key.isNull() | (n == 0), F.lit(0)).otherwise((n - 1) * step + F.size(F.filter(rest, lambda b: b <= key)))


def in_order(df: DataFrame, parts: int) -> DataFrame:
    """Rows ``_id, _text`` in partitions that hold ranges of ids, sorted, with the first row of the next range behind each
    range (``_tail`` 1). The last range is followed by the first row of all. Null ids come first, equal ids by text."""
    fractions = [i / parts for i in range(1, parts)]
    found = df.select(F.percentile_approx("_id", F.array(*[F.lit(f) for f in fractions]), 20 * parts)).first()[0] if fractions else None
    bounds = sorted(set(found or []))
    part = _part(F.col("_id"), bounds)
    # A row for each range: its first id. There are at most ``parts`` of them, so they may be broadcast.
    heads = df.groupBy(part.alias("p")).agg(F.min("_id").alias("first"), F.max(F.col("_id").isNull()).alias("null")).orderBy("p").collect()
    starts = df.sparkSession.createDataFrame(
        [(None if h["null"] else h["first"], heads[i - 1]["p"]) for i, h in enumerate(heads)], "_first long, _before int"
    )
    own = df.withColumn("_part", part)
    copies = F.when(
        F.col("_before").isNotNull(), F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("t")), F.struct(F.col("_before").alias("p"), F.lit(1).alias("t")))
    ).otherwise(F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("t"))))
    spread = own.join(F.broadcast(starts), F.col("_id").eqNullSafe(F.col("_first")), "left").select("_id", "_text", F.explode(copies).alias("_c"))
    rows = spread.select("_id", "_text", F.col("_c.p").alias("_part"), F.col("_c.t").alias("_tail"))
    return rows.repartition(parts, "_part").sortWithinPartitions("_part", "_tail", "_id", "_text")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness.

    In the edited text the last floor(n/2) of the n code points give way to the first as many (or all) of the next
    document in ascending order of ids. Null texts are empty. Null ids come first, equal ids stand in the order of their
    texts, and a single document is its own successor. Only one document and its successor are held at a time.
    """
    docs = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def result(row, chunks, following, next_chunks):
        key, text = row
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        changed = chunk_set(edited)
        return key, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(chunks), as_text(changed), likeness(chunks, changed), likeness(chunks, next_chunks)

    names = [c.split()[0] for c in COMPARED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        held, done = None, []  # held: range, (id, text), chunks of the row whose successor is awaited
        for b in batches:
            for key, text, part, tail in zip(*[b.column(c).to_pylist() for c in ("_id", "_text", "_part", "_tail")]):
                if tail and (held is None or held[0] != part):
                    continue  # a further row with the first id of the next range
                chunks = chunk_set(text)
                if held is not None:
                    done.append(result(held[1], held[2], text, chunks))
                held = None if tail else (part, (key, text), chunks)
                if len(done) >= 1000:
                    yield batch(done)
                    done = []
        if done:
            yield batch(done)

    return in_order(docs, max(1, 2 * parallelism(df.sparkSession))).mapInArrow(run, COMPARED)
