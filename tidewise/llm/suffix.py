"""Removal of long strings that occur more than once, by a sparse suffix array in sorted runs.

Of all 48-byte grams in a 400-byte string the one with the least hash (the rightmost of equal ones) is its anchor, so
equal strings have equal anchors at equal distances. Neighbouring strings with one anchor form a stretch.

1. Stretches meet by anchor. A stretch whose bytes occur twice is repeated as a whole; one whose anchor occurs once is not.
2. For the others, the suffixes that begin at the anchors are sorted: every task makes sorted runs, front-coded (length
   of the prefix in common with the suffix before, then the rest), which are exchanged; loser trees that carry known
   common prefixes merge them. The bytes to the left of the anchors are sorted likewise. A string that begins d bytes
   before its anchor is repeated if another suffix has 400 - d bytes in common on the right and d on the left.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.llm.common import bit_map, lean, may_be_in, parallelism, stored, unused

LENGTH, GRAM = 400, 48
#: Grams in a string.
REACH = LENGTH - GRAM + 1


@dataclass(frozen=True)
class Sizes:
    """What is held at once; results don't depend on it."""

    segment: int = 1 << 22  # bytes of a text that are looked at together; under 2 ** 24
    blob: int = 100_000  # stretches that a task hands on together
    fragment: int = 1_000_000  # stretches that meet in a task
    run: int = 8_000_000  # bytes of context in a sorted run
    bits: int = 1 << 24  # of the filters for texts; whatever passes them wrongly is dropped by a join


SIZES = Sizes()
_TABLE = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), "<u8").astype(np.uint64)
_LOW = np.uint64(0xFFFFFF)
_K = np.uint64(0x9E3779B97F4A7C15)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    h, steps = _TABLE[data], {}
    for n in (1, 2, 4, 8, 16):
        h = _turn(h[:-n], n) ^ h[n:]
        steps[2 * n] = h
    a, b = steps[32], steps[16][32:]
    z = _turn(a[: len(b)], 16) ^ b
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def stretches(data: bytes, segment: int = SIZES.segment):
    """First start, last start, anchor and gram hash of each stretch of a text."""
    out = []
    for origin in range(0, max(0, len(data) - LENGTH + 1), segment):
        part = np.frombuffer(data, np.uint8, min(segment + LENGTH - 1, len(data) - origin), origin)
        h = gram_hashes(part)
        m = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        n = 1
        while 2 * n <= REACH:
            m, n = np.minimum(m[:-n], m[n:]), 2 * n
        if n < REACH:
            m = np.minimum(m[: len(m) - (REACH - n)], m[REACH - n :])
        anchor = (_LOW - (m & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        last = np.append(first[1:], len(anchor)) - 1
        p = anchor[first]
        out.append((first + origin, last + origin, p + origin, h[p]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)]


def _name(data: bytes) -> tuple[int, int]:
    """A text's name: half of its SHA-256."""
    return struct.unpack("<qq", hashlib.sha256(data).digest()[:16])


def _dealt(g, fragments: int):
    """Fragments of anchors. An anchor's hash is the least of many, so that its upper bits are nearly always zero: all bits count here."""
    return ((g * _K) >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)


# Step 1.

FOUND = "kind int, t1 long, t2 long, a long, b long, p long, g long, whole boolean"
_STRETCH = np.dtype([("g", "<u8"), ("c1", "<u8"), ("c2", "<u8"), ("t1", "<i8"), ("t2", "<i8"), ("s", "<i8"), ("e", "<u2"), ("p", "<u2"), ("k", "u1")])


def _grouped(rows: np.ndarray):
    """Rows in order of anchor and bytes; the start of each group of equal bytes, and its number of occurrences."""
    rows = rows[np.lexsort((rows["c2"], rows["c1"], rows["g"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["g"][1:] != rows["g"][:-1]) | (rows["c1"][1:] != rows["c1"][:-1]) | (rows["c2"][1:] != rows["c2"][:-1])
    first = np.flatnonzero(new)
    return rows, first, np.add.reduceat(rows["k"].astype(np.int64), first) if len(first) else np.empty(0, np.int64)


def _stretches(fragments: int, sizes: Sizes):
    names = ["fragment", "data"]

    def flush(parts):
        rows, first, times = _grouped(np.concatenate(parts))
        size = np.diff(np.append(first, len(rows)))
        again = np.repeat(times, size) > 1
        out = []
        if again.any():  # these are repeated whatever other tasks have
            mine = rows[again]
            for f in np.unique(mine["t1"] % fragments):
                out.append((int(-1 - f), mine[mine["t1"] % fragments == f].tobytes()))
        one = rows[first].copy()
        one["k"] = np.minimum(times, 2)
        f = _dealt(one["g"], fragments)
        order = np.argsort(f, kind="stable")
        f, one = f[order], one[order]
        cut = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
        for i, j in zip(cut, np.append(cut[1:], len(one))):
            out.append((int(f[i]), one[i:j].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=names)

    def run(batches):
        parts, size = [], 0
        for b in batches:
            for text in b.column("_text"):
                data = text.as_py().encode()
                if len(data) < LENGTH:
                    continue
                s, e, p, g = stretches(data, sizes.segment)
                rows = np.zeros(len(s), _STRETCH)
                rows["g"], rows["s"], rows["e"], rows["p"], rows["k"] = g, s, e - s, p - s, 1
                rows["t1"], rows["t2"] = _name(data)
                digests = b"".join([hashlib.blake2b(data[i : j + LENGTH], digest_size=16).digest() for i, j in zip(s.tolist(), e.tolist())])
                c = np.frombuffer(digests, "<u8").reshape(-1, 2)
                rows["c1"], rows["c2"] = c[:, 0], c[:, 1]
                parts.append(rows)
                size += len(rows)
                if size >= sizes.blob:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    return run


def _settle(key, blobs: pd.DataFrame) -> pd.DataFrame:
    """Kind 0: repeated bytes a..b of a text. Kind 1: a stretch (starts a..b) whose anchor others have with other bytes."""
    rows = np.frombuffer(b"".join(bytes(x) for x in blobs["data"]), _STRETCH)

    def frame(kind, r, whole=None):
        a = r["s"]
        last = a + r["e"]
        return pd.DataFrame({"kind": np.full(len(r), kind, np.int32), "t1": r["t1"], "t2": r["t2"], "a": a, "b": last + LENGTH if kind == 0 else last, "p": a + r["p"], "g": r["g"].astype(np.uint64).view(np.int64), "whole": whole if whole is not None else np.ones(len(r), bool)})

    if key[0] < 0:
        return frame(0, rows)
    rows, first, times = _grouped(rows)
    size = np.diff(np.append(first, len(rows)))
    again = (np.repeat(times, size) > 1) & (rows["k"] == 1)
    one, whole = rows[first], times > 1
    same = one["g"][1:] == one["g"][:-1]
    contested = np.append(False, same) | np.append(same, False)
    return pd.concat([frame(0, rows[again]), frame(1, one[contested], whole[contested])], ignore_index=True)


# Step 2.


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    most = min(len(a), len(b))
    while start < most:
        end = min(start + 32, most)
        x, y = a[start:end], b[start:end]
        if x != y:
            d = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return end - (d.bit_length() + 7) // 8
        start = end
    return most


def front_coded(items: list[bytes]) -> bytes:
    """Items in order: lengths in common with the item before, lengths of the rests, the rests."""
    shared, rests, before = [], [], b""
    for x in items:
        n = common(before, x, 0)
        shared.append(n)
        rests.append(x[n:])
        before = x
    return struct.pack("<I", len(items)) + np.array(shared, "<u2").tobytes() + np.array([len(r) for r in rests], "<u2").tobytes() + b"".join(rests)


def front_decoded(data: bytes, at: int = 0):
    """(items, common lengths, end)."""
    (n,) = struct.unpack_from("<I", data, at)
    at += 4
    shared, sizes = np.frombuffer(data, "<u2", n, at).tolist(), np.frombuffer(data, "<u2", n, at + 2 * n).tolist()
    at += 4 * n
    out, before = [], b""
    for k, size in zip(shared, sizes):
        before = before[:k] + data[at : at + size]
        out.append(before)
        at += size
    return out, shared, at


def merge(runs: list[tuple[list[bytes], list[int]]]):
    """Merge sorted runs with their common lengths: (run, place, length in common with the item before) in order.

    In the loser tree every run's head has its length in common with the item that left the tree last. The head with
    more in common is the smaller one; only heads with equal lengths are compared, and only behind those lengths.
    """
    runs_n = len(runs)
    size = 1
    while size < max(1, runs_n):
        size *= 2
    at = [0] * size
    shared = [0] * size
    head: list[bytes | None] = [runs[i][0][0] if i < runs_n and runs[i][0] else None for i in range(size)]

    def beats(i, j):
        """Whether head i is to leave before head j; the loser gets its length in common with the winner."""
        a, b = head[i], head[j]
        if a is None or b is None:
            return b is None
        x, y = shared[i], shared[j]
        if x != y:
            return x > y  # the loser's length stands: it is where it leaves the last item and the winner
        n = common(a, b, x)
        first = len(a) == n or (len(b) > n and a[n] < b[n])
        if n == len(a) == len(b):
            first = i < j
        shared[j if first else i] = n
        return first

    loser = [0] * size

    def build(node):
        if node >= size:
            return node - size
        i, j = build(2 * node), build(2 * node + 1)
        if beats(i, j):
            loser[node] = j
            return i
        loser[node] = i
        return j

    winner = build(1)
    while head[winner] is not None:
        yield winner, at[winner], shared[winner]
        at[winner] += 1
        items, lengths = runs[winner]
        if at[winner] < len(items):
            head[winner], shared[winner] = items[at[winner]], lengths[at[winner]]
        else:
            head[winner] = None
        node = (winner + size) // 2
        while node:
            if beats(loser[node], winner):
                loser[node], winner = winner, loser[node]
            node //= 2


_PLACE = np.dtype([("t1", "<i8"), ("t2", "<i8"), ("s", "<i8"), ("e", "<u2"), ("p", "<u2"), ("whole", "u1")])


def _runs(fragments: int, sizes: Sizes):
    """Texts with their contested stretches become sorted, front-coded runs of suffixes, one blob per fragment."""

    def flush(items):
        out = []
        items.sort(key=lambda x: (x[0], x[1], x[2]))
        i = 0
        while i < len(items):
            j = i
            while j < len(items) and items[j][0] == items[i][0]:
                j += 1
            part = items[i:j]
            places = np.array([x[3] for x in part], _PLACE)
            out.append((part[0][0], front_coded([x[1] for x in part]) + front_coded([x[2] for x in part]) + places.tobytes()))
            i = j
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["fragment", "data"])

    def run(batches):
        items, size = [], 0
        for b in batches:
            for t1, t2, data, marks in zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), b.column("data"), b.column("marks")):
                data = data.as_py()
                marks = marks.as_py()
                for m, f in zip(marks, _dealt(np.array([m["g"] for m in marks], np.int64).view(np.uint64), fragments).tolist()):
                    s, e, p = m["a"], m["b"], m["p"]
                    items.append((f, data[p : e + LENGTH], data[s:p][::-1], (t1, t2, s, e - s, p - s, m["whole"])))
                    size += e + LENGTH - s
                if size >= sizes.run:
                    yield flush(items)
                    items, size = [], 0
        if items:
            yield flush(items)

    return run


def repeated_starts(right: np.ndarray, left: np.ndarray, left_rank: np.ndarray, low: np.ndarray, high: np.ndarray):
    """For suffixes in order: the least and the largest d, between ``low`` and ``high``, at which another suffix has LENGTH - d bytes in
    common on the right and d on the left; -1 where there is none. ``right`` and ``left`` hold the lengths in common
    with the neighbour before, in order of the suffixes and in order of what stands to the left."""
    n = len(right)
    least, most = np.full(n, -1), np.full(n, -1)
    for d in range(int(low.min(initial=LENGTH)), int(high.max(initial=-1)) + 1):
        use = np.flatnonzero((low <= d) & (d <= high))
        if len(use) < 2:
            continue
        key = np.cumsum(right < LENGTH - d)[use] * np.int64(n + 1) + np.cumsum(left < d)[left_rank[use]]
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        hit = use[order[np.append(False, same) | np.append(same, False)]]
        most[hit] = d
        least[hit] = np.where(least[hit] < 0, d, least[hit])
    return least, most


def _compare(blobs: pd.DataFrame) -> pd.DataFrame:
    """Merge the runs of a fragment; give the repeated bytes of stretches that aren't repeated as a whole."""
    runs, lefts, places = [], [], []
    for x in blobs["data"]:
        data = bytes(x)
        items, shared, at = front_decoded(data)
        left, _, at = front_decoded(data, at)
        runs.append((items, shared))
        lefts.append(left)
        places.append(np.frombuffer(data, _PLACE, len(items), at))
    right, where, before = [], [], []
    for r, i, n in merge(runs):
        right.append(n)
        where.append(places[r][i])
        before.append(lefts[r][i])
    place = np.array(where, _PLACE)
    order = sorted(range(len(before)), key=before.__getitem__)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    left = [0] + [common(before[i], before[j], 0) for i, j in zip(order, order[1:])]
    p = place["p"].astype(np.int64)
    least, most = repeated_starts(np.array(right, np.int64), np.array(left[: len(order)], np.int64), rank, p - place["e"], p)
    use = (most >= 0) & (place["whole"] == 0)
    anchor = (place["s"] + p)[use]
    return pd.DataFrame({"t1": place["t1"][use], "t2": place["t2"][use], "a": anchor - most[use], "b": anchor - least[use] + LENGTH})


# Spark.


def _has(words: np.ndarray, t1: int) -> bool:
    at = t1 % (32 * len(words))
    return bool(words[at >> 5] >> (at & 31) & 1)


def _texts_of(docs: DataFrame, names: DataFrame, sizes: Sizes) -> DataFrame:
    """``t1, t2, data`` of the named texts, each once."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(names, "t1", sizes.bits))

    def run(batches):
        words, done, out, size = shared.value, set(), [], 0

        def batch():
            cols = list(zip(*out)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["t1", "t2", "data"])

        for b in batches:
            for text in b.column("_text"):
                data = text.as_py().encode()
                name = _name(data)
                if _has(words, name[0]) and name not in done:
                    if len(done) < 200_000:
                        done.add(name)
                    out.append((*name, data))
                    size += len(data)
                    if size >= 4_000_000:
                        yield batch()
                        out, size = [], 0
        yield batch()

    return docs.select("_text").mapInArrow(lean(run), "t1 long, t2 long, data binary").dropDuplicates(["t1", "t2"])


def spans(docs: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """``t1, t2, spans``: for each text (``_text``) with a repeated string the byte ranges to remove, merged, in order."""
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    fragments = max(parallelism(spark), int(volume // (REACH // 2) // sizes.fragment) + 1)
    blobs = docs.select("_text").mapInArrow(lean(_stretches(fragments, sizes)), "fragment int, data binary")
    found = stored(blobs.groupBy("fragment").applyInPandas(lambda key, x: _settle(key, x), FOUND))
    contested = found.where("kind = 1")
    marks = contested.groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "b", "p", "g", "whole")).alias("marks"))  # as long as the text at most
    held = _texts_of(docs, contested.select("t1"), sizes).join(marks, ["t1", "t2"])
    runs = held.mapInArrow(lean(_runs(fragments, sizes)), "fragment int, data binary")
    fine = runs.groupBy("fragment").applyInPandas(_compare, "t1 long, t2 long, a long, b long")
    ranges = found.where("kind = 0").select("t1", "t2", "a", "b").unionByName(fine).distinct()
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("a", "b"))),
        F.array().cast("array<struct<a:bigint,b:bigint>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["b"] >= x["a"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(done, F.array(x))),
    )
    return stored(ranges.groupBy("t1", "t2").agg(merged.alias("spans")))


def _prepared(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))


def cut(data: bytes, ranges) -> bytes:
    out, at = [], 0
    for r in ranges:
        out.append(data[at : r["a"]])
        at = r["b"]
    return b"".join([*out, data[at:]])


def cut_text(data: bytes, ranges) -> str:
    """As ``cut``, but whole characters: one that is removed in part stays."""
    rounded = []
    for r in ranges:
        a, b = r["a"], r["b"]
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            rounded.append({"a": a, "b": b})
    return cut(data, rounded).decode("utf-8")


def _named(df: DataFrame, keep: tuple[str, ...], text_col: str, words) -> DataFrame:
    """``keep`` columns, name, size, and digest of texts that the filter rules out (they lose nothing)."""
    fields = [df.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["_t1 long, _t2 long, _bytes long, _sha string"])

    def run(batches):
        for b in batches:
            out = []
            for text in b.column("_text"):
                data = text.as_py().encode()
                name = _name(data)
                out.append((*name, len(data), None if _has(words.value, name[0]) else hashlib.sha256(data).hexdigest()))
            cols = list(zip(*out)) or [[]] * 4
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *arrays], names=[*keep, "_t1", "_t2", "_bytes", "_sha"])

    return df.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).mapInArrow(lean(run), schema)


def _cuts(docs: DataFrame, ranges: DataFrame, sizes: Sizes) -> DataFrame:
    """Per named text: number of removed bytes and ranges, digest of what is kept."""

    def run(batches):
        for b in batches:
            out = []
            for t1, t2, data, rs in zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), b.column("data"), b.column("spans")):
                data, rs = data.as_py(), rs.as_py()
                rest = cut(data, rs)
                out.append((t1, t2, len(data) - len(rest), len(rs), hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["t1", "t2", "n_removed", "n_spans", "kept_sha"])

    return _texts_of(docs, ranges.select("t1"), sizes).join(ranges, ["t1", "t2"]).mapInArrow(lean(run), "t1 long, t2 long, n_removed long, n_spans long, kept_sha string")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = SIZES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per row of ``df``.

    Null texts are empty. Texts under 400 bytes lose nothing. A text that is there twice, in whatever rows, loses all of
    its bytes if it has 400. Ids play no part in what is removed; they may be null or repeat.
    """
    docs = _prepared(df, text_col)
    ranges = spans(docs, sizes)
    words = df.sparkSession.sparkContext.broadcast(bit_map(ranges, "t1", sizes.bits))
    named = stored(_named(df.select(id_col, text_col), (id_col,), text_col, words))
    cuts = stored(_cuts(docs, ranges, sizes))
    # A text that passed the filter by chance is its own result.
    alone = named.where("_sha IS NULL").select("_t1", "_t2").distinct().join(cuts, (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left_anti")
    digests = _texts_of(docs, alone.select(F.col("_t1").alias("t1")), sizes).select("t1", "t2", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("data", 256).alias("kept_sha"))
    digests = digests.join(alone, (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left_semi")
    results = cuts.unionByName(digests)
    out = named.join(results, (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left")
    return out.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col("_bytes").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha", "_sha").alias("kept_sha256"),
    )


def _without(text: Column, ranges: Column) -> Column:
    """Texts without their ranges, whole where there are none."""

    @F.arrow_udf("string")
    def rest(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([cut_text(t.as_py().encode(), rs.as_py()) if t.is_valid and rs.is_valid else t.as_py() for t, rs in zip(texts, spans)], pa.string())

    return rest(text, ranges)


def remove(df: DataFrame, text_col: str = "text", sizes: Sizes = SIZES) -> DataFrame:
    """The rows of ``df`` with repeated strings taken out of ``text_col``, in whole characters; null stays null. Rows
    travel only if their texts may lose something; their texts are cut where they meet the ranges."""
    ranges = spans(_prepared(df, text_col), sizes)
    words = df.sparkSession.sparkContext.broadcast(bit_map(ranges, "t1", sizes.bits))
    mine, name, gone = (unused(df, c) for c in ("key", "name", "gone"))
    digest = F.unhex(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256), 1, 32))
    keyed = df.withColumn(mine, digest)
    may = may_be_in(words, F.col(mine))
    found = ranges.select(F.unhex(F.concat(_little("t1"), _little("t2"))).alias(name), F.col("spans").alias(gone))
    joined = keyed.where(may).join(found, F.col(mine) == F.col(name), "left")
    short = joined.select(*[_without(F.col(f"`{c}`"), F.col(gone)).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
    return keyed.where(~may).select(*[F.col(f"`{c}`") for c in df.columns]).unionByName(short)


def _little(c: str):
    """Hex digits of the eight bytes of a long, lowest byte first."""
    h = F.lpad(F.hex(F.col(c)), 16, "0")
    return F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])
