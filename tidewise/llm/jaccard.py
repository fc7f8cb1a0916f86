"""Exact Jaccard self-join of documents on word shingles by vertical partitioning.

One order of all shingles is fixed: rare ones by hash, then the frequent ones, least frequent first. Two sets that link
share a shingle among the first quarter of both. The order is cut into fragments. A fragment finds, on its own, the
documents that share one of its shingles; candidate pairs are then counted fragment by fragment, and the partial
overlaps are summed per pair. Equal sets are one node, and of the pairs in large groups only those are counted that can
still join two components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewise.llm.bpe import _slices
from tidewise.llm.common import bit_map, lean, parallelism, stored

WORDS = 5
#: Link: 100 * intersection >= 75 * union, as a fraction.
NUM, DEN = 3, 4
#: The list of frequent shingles, whose order is by count: so many at most. It only fixes the order of shingles.
FREQUENT = 50_000
#: A task reports shingles that it saw in so many documents among this number of shingles.
SEEN, REPORT = 8, 1_000_000
#: Entries of a fragment, groups whose pairs are all candidates, and cuts of a set when pairs are counted.
FRAGMENT, SMALL, CUTS = 1_000_000, 16, 4
#: Bits of the filter for documents whose sets are needed. Whatever passes it wrongly is dropped by a join.
FILTER_BITS = 1 << 24
#: Characters of texts that are cut into shingles at once.
PIECE = 1_000_000
_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _pieces(texts: pa.Array):
    """Bounds and texts of pieces of a column; never are all of its texts Python strings at once."""
    for lo, hi in _slices([range(n) for n in pc.utf8_length(texts).to_pylist()], PIECE):
        yield lo, hi, texts.slice(lo, hi - lo).to_pylist()


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: five neighbouring words, or all words where there are fewer."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    n = np.diff(parts.offsets.to_numpy())
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    value = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    index = coded.indices.to_numpy()
    w = value[index] if len(words) else np.empty(0, np.uint64)
    if "" in words:  # before leading and behind trailing white space
        full = index != words.index("")
        n = np.bincount(np.repeat(np.arange(len(n)), n), full, len(n)).astype(np.int64)
        w = w[full]
    h = w[: max(0, len(w) - WORDS + 1)].copy()
    for j in range(1, WORDS):
        h = h * _K + w[j : j + len(h)]
    h = _mix(h)
    ends, out = np.cumsum(n), []
    for e, m in zip(ends.tolist(), n.tolist()):
        if m >= WORDS:
            s = np.sort(h[e - m : e - WORDS + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif m:
            x = w[e - m : e - m + 1].copy()
            for v in w[e - m + 1 : e]:
                x = x * _K + v
            out.append(_mix(x * _K + np.uint64(m)))
        else:
            out.append(h[:0])
    return out


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name for each set; equal sets have equal names."""
    sums = [int(_mix(s + _K).sum(dtype=np.uint64)) for s in sets]
    with np.errstate(over="ignore"):
        return _mix(np.array(sums, np.uint64) + np.array([len(s) for s in sets], np.uint64) * _K).view(np.int64)


def _least(n):
    """Of n shingles a linked set has at least so many in common."""
    return (NUM * n + DEN - 1) // DEN


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


DOCS = "kind int, a long, b long, c long"


def _survey(batches, seen: int):
    """Kind 0: id, size, node of each document. Kind 1: shingle and count, of those seen often."""
    names = ["kind", "a", "b", "c"]
    kept, size = [], 0

    def often():
        h, c = np.unique(np.concatenate([*kept, np.empty(0, np.uint64)]), return_counts=True)
        h, c = h[c >= seen], c[c >= seen]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), _signed(h), pa.array(c.astype(np.int64)), pa.nulls(len(h), pa.int64())], names=names)

    for b in batches:
        keys = b.column("_id")
        for lo, hi, texts in _pieces(b.column("_text")):
            sets = shingle_sets(texts)
            n = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(hi - lo, np.int32)), keys.slice(lo, hi - lo), pa.array(n), pa.array(_nodes(sets))], names=names)
            kept += sets
            size += int(n.sum())
            if size >= REPORT:
                yield often()
                kept, size = [], 0
    yield often()


def _entries(frequent, fragments: int):
    """Blobs of prefix entries per fragment: (48 bits of) shingle, node, size class (255: or larger), place in the
    prefix (in 256ths, rounded down). Fragments below 0 hold the entries of
    frequent shingles, dealt by node: shingle, node, number of rare entries of that node."""
    names = ["fragment", "hashes", "nodes", "more"]
    by_hash, rank = frequent

    def flush(rows):
        columns = []
        for x in rows:  # the many small arrays go as soon as they are one
            columns.append(np.concatenate(x) if x else np.empty(0, np.int64))
            x.clear()
        rare_h, rare_n, rare_q, rare_p, freq_h, freq_n, freq_m = columns
        out = []
        order = np.lexsort((rare_n, rare_h))
        h, n, q, at = rare_h[order].astype(np.uint64, copy=False), rare_n[order], rare_q[order], rare_p[order]
        del columns, rare_h, rare_n, rare_q, rare_p, order
        if len(h):
            new = np.append(True, (h[1:] != h[:-1]) | (n[1:] != n[:-1]))
            h, n, q, at = h[new], n[new], q[new], at[new]
            del new
            f = (h >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)
            for k, (i, j) in zip(*_runs(f)):
                part = h[i:j] >> np.uint64(16)
                packed = part.astype("<u4").tobytes() + (part >> np.uint64(32)).astype("<u2").tobytes()
                out.append((int(k), packed, n[i:j].astype("<i8").tobytes(), q[i:j].astype(np.uint8).tobytes() + at[i:j].astype(np.uint8).tobytes()))
        if len(freq_h):
            spread = -1 - (freq_n.view(np.uint64) % np.uint64(fragments)).astype(np.int64)
            order = np.lexsort((freq_h, freq_n, spread))
            h, n, m, f = freq_h[order].astype(np.uint64), freq_n[order], freq_m[order], spread[order]
            new = np.append(True, (h[1:] != h[:-1]) | (n[1:] != n[:-1]))
            h, n, m, f = h[new], n[new], m[new], f[new]
            for k, (i, j) in zip(*_runs(f)):
                out.append((int(k), h[i:j].astype("<u8").tobytes(), n[i:j].astype("<i8").tobytes(), m[i:j].astype("<i4").tobytes()))
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=names)

    def run(batches):
        rows, size = ([], [], [], [], [], [], []), 0
        for b in batches:
            for _, _, texts in _pieces(b.column("_text")):
                sets = shingle_sets(texts)
                for s, node in zip(sets, _nodes(sets)):
                    n = len(s)
                    if not n:
                        continue
                    p = n - _least(n) + 1
                    at = np.searchsorted(by_hash, s)
                    common = by_hash[np.minimum(at, len(by_hash) - 1)] == s if len(by_hash) else np.zeros(n, bool)
                    rare = s[~common][:p].copy()  # not a view, which would keep the whole set
                    rows[0].append(rare)
                    rows[1].append(np.full(len(rare), node, np.int64))
                    rows[2].append(np.full(len(rare), min(int(np.log(n) / np.log(1.05)), 255), np.uint8))
                    rows[3].append((np.arange(len(rare)) * 256 // p).astype(np.uint8))
                    if len(rare) < p:
                        often = s[common][np.argsort(rank[at[common]])][: p - len(rare)]
                        rows[4].append(often)
                        rows[5].append(np.full(len(often), node, np.int64))
                        rows[6].append(np.full(len(often), len(rare), np.int64))
                    size += p
                if size >= REPORT:
                    yield flush(rows)
                    rows, size = ([], [], [], [], [], [], []), 0
        yield flush(rows)

    return run


def _runs(f: np.ndarray):
    first = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
    return f[first], zip(first, np.append(first[1:], len(f)))


FOUND = "kind int, a long, b long, c int"


def _fragment(key, blobs: pd.DataFrame, small: int) -> pd.DataFrame:
    """Kind 0: pair of nodes, twice the number of shared entries in small groups, plus 1 if they are neighbours in one; 3: shingle
    (or part of it), node and, of frequent shingles, number of rare entries, of large groups, -1 less the place of the entry."""
    join = lambda c: [bytes(x) for x in blobs[c]]
    node = np.frombuffer(b"".join(join("nodes")), "<i8")
    out = []

    def add(kind, a, b, c=None):
        out.append(pd.DataFrame({"kind": np.int32(kind), "a": a.astype(np.int64), "b": b.astype(np.int64), "c": np.int32(0) if c is None else c.astype(np.int32)}, index=range(len(a))))

    if key[0] < 0:
        h, m = np.frombuffer(b"".join(join("hashes")), "<u8"), np.frombuffer(b"".join(join("more")), "<i4")
        order = np.lexsort((node, h))
        h, node, m = h[order], node[order], m[order]
        new = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))
        add(3, h[new].view(np.int64), node[new], m[new])
        return out[0]
    low, high = [], []
    for x in join("hashes"):
        k = len(x) // 6
        low.append(np.frombuffer(x, "<u4", k))
        high.append(np.frombuffer(x, "<u2", k, 4 * k))
    h = np.concatenate(low).astype(np.uint64) | np.concatenate(high).astype(np.uint64) << np.uint64(32)
    more = [np.frombuffer(x, np.uint8).reshape(2, -1) for x in join("more")]
    q, at = np.concatenate(more, axis=1).astype(np.int16)
    order = np.argsort(h, kind="stable")
    h = h[order]
    twin = np.append(h[1:] == h[:-1], False)
    shared = twin | np.append(False, twin[:-1])
    h, order = h[shared], order[shared]
    inner = np.lexsort((node[order], q[order], h))  # in a group by size, so that neighbours are alike
    h, node, q, at = h[inner], node[order][inner], q[order][inner], at[order][inner]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))
        h, node, q, at = h[new], node[new], q[new], at[new]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(first, len(h)))
        of = np.repeat(size, size)
        h, node, q, at, of = h[of > 1], node[of > 1], q[of > 1], at[of > 1], of[of > 1]
    if not len(h):
        return pd.DataFrame({"kind": pd.Series(dtype="int32"), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "c": pd.Series(dtype="int32")})
    pairs = []
    for d in range(1, small):
        if d >= len(h):
            break
        both = (h[d:] == h[:-d]) & ((of[d:] <= small) | (d == 1)) & (np.abs(q[d:] - q[:-d]) <= 6)
        x, y = node[:-d][both], node[d:][both]
        pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y), np.full(len(x), d == 1)], axis=1))
    if pairs:
        p = np.concatenate(pairs)
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        first = np.flatnonzero(np.append(True, (p[1:, 0] != p[:-1, 0]) | (p[1:, 1] != p[:-1, 1]))) if len(p) else np.empty(0, np.int64)
        times = np.diff(np.append(first, len(p)))
        beside = np.maximum.reduceat(p[:, 2], first) if len(p) else np.empty(0, np.int64)
        add(0, p[first, 0], p[first, 1], 2 * times + beside)
    large = of > small
    # A large group's name must not equal a frequent shingle's: the fragment and 48 bits stand in the lower 56.
    add(3, h[large].view(np.int64), node[large], -1 - at[large])
    return pd.concat(out, ignore_index=True)


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: smallest node of its component, for all nodes that have an edge (``a, b``). Alternating large and
    small stars; the rounds grow with the logarithm of the nodes."""
    pairs = stored(edges.where("a <> b").select("a", "b").distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        s = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(s, "a")
        pairs = stored(small.select(F.col("b").alias("x"), "m").unionByName(s.select(F.col("a").alias("x"), "m")).where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = pairs.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return stored(pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots).distinct())


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, cut, part``: the sets of the given nodes, cut along the order of hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(nodes, "node", FILTER_BITS))

    def run(batches):
        words, done = shared.value, set()
        for b in batches:
            for _, _, texts in _pieces(b.column("_text")):
                sets = shingle_sets(texts)
                names = _nodes(sets)
                at = names % FILTER_BITS
                out = []
                for s, node, hit in zip(sets, names.tolist(), (words[at >> 5] >> (at & 31)) & 1):
                    if hit and len(s) and node not in done:  # equal sets once per task
                        if len(done) < 1_000_000:
                            done.add(node)
                        ends = np.searchsorted(s, np.arange(1, CUTS, dtype=np.uint64) << np.uint64(62))
                        out += [(node, c, p.view(np.int64)) for c, p in enumerate(np.split(s, ends)) if len(p)]
                cols = list(zip(*out)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int64()))], names=["node", "cut", "part"])

    found = docs.select("_text").mapInArrow(lean(run), "node long, cut int, part array<long>")
    return stored(found.join(nodes, "node", "left_semi").dropDuplicates(["node", "cut"]))


def _linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the candidate pairs ``a, b, na, nb`` that link, by summed partial overlaps."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    degree = stored(ends.groupBy("node").agg(F.count("*").alias("k")))
    sets = _sets_of(docs, degree.select("node"))
    ka, kb = degree.select(F.col("node").alias("a"), F.col("k").alias("ka")), degree.select(F.col("node").alias("b"), F.col("k").alias("kb"))
    # The end with fewer pairs travels.
    sent = pairs.join(ka, "a").join(kb, "b").select(F.when(F.col("ka") <= F.col("kb"), F.col("a")).otherwise(F.col("b")).alias("leaf"), F.when(F.col("ka") <= F.col("kb"), F.col("b")).otherwise(F.col("a")).alias("hub"), (F.col("na") + F.col("nb")).alias("n"))
    moved = sent.join(sets.select(F.col("node").alias("leaf"), "cut", F.col("part").alias("p")), "leaf")
    met = moved.join(sets.select(F.col("node").alias("hub"), "cut", F.col("part").alias("r")), ["hub", "cut"])
    partial = met.select("leaf", "hub", "n", F.size(F.array_intersect("p", "r")).alias("o"))
    total = partial.groupBy("leaf", "hub", "n").agg(F.sum("o").alias("o"))
    return stored(total.where(F.col("o") * DEN >= (F.col("n") - F.col("o")) * NUM).select(F.col("leaf").alias("a"), F.col("hub").alias("b")))


def _sized(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidate pairs with sizes, without those whose sizes rule a link out."""
    x, y = sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), sizes.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    return pairs.join(x, "a").join(y, "b").where(small * DEN >= large * NUM)


def _room(n: str, most: str):
    """The largest partner of a set of n shingles of which at most ``most`` are shared: (n + m) * NUM / (NUM + DEN) <= most."""
    return F.floor(F.col(most) * (NUM + DEN) / NUM - F.col(n))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, seen: int = SEEN) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``df``.

    ``component_id`` is the smallest id that links reach from the document, itself included. Texts without words, and null
    texts, have empty sets and link with nothing, so their component is their own id. Rows with equal sets link. A null
    id counts as larger than any id. Rows with one id and different texts are documents of their own. Sets are told
    apart by 64-bit sums of 64-bit hashes.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    survey = stored(docs.mapInArrow(lean(lambda batches: _survey(batches, seen)), DOCS))
    known = survey.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("node"))
    often = survey.where("kind = 1").groupBy("a").agg(F.sum("b").alias("c")).orderBy(F.desc("c"), "a").limit(FREQUENT).toPandas()
    by_count = often.sort_values(["c", "a"])["a"].to_numpy(np.int64).view(np.uint64)
    place = np.argsort(by_count)
    frequent = spark.sparkContext.broadcast((by_count[place], place))
    sizes = stored(known.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("doc_id").alias("first")))
    total = known.agg(F.sum((F.col("n") / DEN) + 1)).first()[0] or 0
    fragments = max(parallelism(spark), int(total // FRAGMENT) + 1)

    def entries(batches):
        yield from _entries(frequent.value, fragments)(batches)

    blobs = docs.select("_text").mapInArrow(lean(entries), "fragment int, hashes binary, nodes binary, more binary")
    found = stored(blobs.groupBy("fragment").applyInPandas(lambda key, x: _fragment(key, x, small), FOUND))
    # Both prefixes of a linked pair hold the first shingles that the two share, and these are many.
    counted = found.where("kind = 0").groupBy("a", "b").agg(F.sum(F.floor(F.col("c") / 2)).alias("met"), F.max(F.col("c") % 2).alias("beside"))
    in_groups = stored(found.where("kind = 3").groupBy(F.col("b").alias("node")).agg(F.countDistinct("a").alias("k")))
    ga, gb = in_groups.select(F.col("node").alias("a"), F.col("k").alias("ka")), in_groups.select(F.col("node").alias("b"), F.col("k").alias("kb"))
    need = F.ceil((F.col("na") + F.col("nb")) * NUM / (NUM + DEN))
    sure = lambda n: need - F.ceil(F.col(n) * NUM / DEN) + 1
    unseen = F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0)))
    pairs = _sized(counted, sizes).join(ga, "a", "left").join(gb, "b", "left").where(F.col("met") + unseen >= F.least(sure("na"), sure("nb")))
    pairs = stored(pairs.select("a", "b", "na", "nb", (F.col("beside") == 1).alias("beside")))

    # Large groups. Pairs that share an entry of a small group are among those above. Any other pair of a large group
    # shares none of the entries that a node has before this group's shingle and outside of large groups: they would stand
    # in both prefixes. That bounds what it can have in common. Entries behind the shingle may be shared behind a prefix.
    large = found.where("kind = 3").select(F.col("a").alias("group"), F.col("b").alias("node"), "c").dropDuplicates(["group", "node"]).join(sizes.select("node", "n"), "node")
    first = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1
    ahead = Window.partitionBy("node").orderBy(F.col("c") >= 0, "group").rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(F.col("c") < 0, F.ceil((-1 - F.col("c")) * first / 256)).otherwise(F.col("c"))
    alone = F.greatest(place - F.count(F.when(F.col("c") < 0, 1)).over(ahead), F.lit(0))
    members = stored(large.select("group", "node", "n", (F.col("n") - alone).alias("most")).withColumn("room", _room("n", "most")))
    hubs = members.groupBy("group").agg(F.min(F.struct((-F.col("most") / F.col("n")).alias("s"), "n", "node", "room")).alias("h")).select("group", F.col("h.node").alias("hub"), F.col("h.n").alias("nh"), F.col("h.room").alias("room_h"))
    stars = members.join(hubs, "group").where((F.col("node") != F.col("hub")) & (F.col("room") >= F.col("nh")) & (F.col("room_h") >= F.col("n")))
    stars = _sized(stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), sizes)
    near = _linked(docs, stored(pairs.where("beside").drop("beside").unionByName(stars).distinct()))
    comp = components(near)

    # Whatever could still join two components.
    def rooted(p: DataFrame, c: str) -> DataFrame:
        r = comp.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        return p.join(r, c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))

    rest = rooted(rooted(pairs.where("NOT beside").drop("beside"), "a"), "b").where("ra <> rb").select("a", "b", "na", "nb")
    placed = stored(rooted(members.withColumnRenamed("node", "a"), "a").select("group", F.col("a").alias("node"), "n", "room", F.col("ra").alias("root")))
    # The node of the smaller component asks. A linked pair shares at least ``fewest`` groups, so that many of the groups
    # of a node, less one, need not be asked: the largest ones.
    weight = placed.select("node", "root").distinct().groupBy("root").agg(F.count("*").alias("w"))
    weighed = placed.join(weight, "root").withColumn("order", F.struct("w", "root"))
    top = weighed.groupBy("group").agg(F.max("order").alias("top"), F.min("order").alias("low"), F.count("*").alias("members")).where("top <> low")
    split = stored(weighed.join(top, "group"))
    each = Window.partitionBy("node")
    asking = split.where("order < top").withColumns({"k": F.count("*").over(each), "turn": F.row_number().over(each.orderBy("members", "group"))})
    lengths = split.select("group", F.col("n").alias("nb")).distinct()
    outside = asking.select("group", F.col("node").alias("a"), F.col("n").alias("na"), F.col("room").alias("room_a"), F.col("order").alias("order_a"), "k", "turn")
    fewest = F.greatest(F.least(sure("na"), sure("nb")), F.lit(1))
    sizes_fit = (F.col("nb") <= F.col("room_a")) & (F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM)
    asked = outside.join(lengths, "group").where(sizes_fit & (F.col("turn") <= F.col("k") - fewest + 1))
    partners = split.select("group", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("room").alias("room_b"), F.col("order").alias("order_b"))
    cross = asked.join(partners, ["group", "nb"]).where("order_b > order_a AND na <= room_b")
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = stored(rest.unionByName(_sized(cross, sizes)).distinct())
    if not rest.isEmpty():
        more = _linked(docs, rest)
        comp = components(near.unionByName(more))
    grouped = sizes.join(comp, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(grouped.join(least, "root").select("node", "component_id"))
    out = known.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out
