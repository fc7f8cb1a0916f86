"""Spelling variants: words of a vocabulary that are one edit apart, and the usual form behind a rare one.

The vocabulary is sorted, once as it is and once with every word reversed, and cut into ranges. Two words one edit apart share
the first half of the shorter word or, reversed, its last half; so a word asks only the ranges that its half reaches
into, and of these only the ones whose common prefix is within one edit of it. In a range the words are scanned in order with a
banded edit matrix: rows for the prefix that a word shares with the one before are kept, and as soon as a row has no
entry of at most one edit, all words with that prefix are skipped.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.llm.common import parallelism, stored

LETTERS = "a-zÀ-ÿ"
LEAST_CHARS, LEAST_COUNT, TIMES = 6, 5, 5
#: A run of one in so many (by hash) loses a letter.
EVERY = 199
#: Ranges of either list, as a multiple of the shuffle partitions; words sampled to cut a range.
RANGES, SAMPLES = 4, 40
#: Words counted in a task before they are passed on, and characters of a text that are cut into words at once.
HELD, PIECE = 400_000, 1 << 20
#: Askers from outside that one task takes on for a range; more are dealt to several tasks, each with the range.
ASKERS = 50_000
#: Words that a range is scanned for at once.
ASKED = 2048
_LAST = "\U0010ffff"


# ---------------------------------------------------------------- words


def _runs(text: str, least: int) -> Iterator[list[str]]:
    """Maximal runs of at least ``least`` letters of a lower-case text, piece by piece; no run is cut."""
    run, stop = re.compile(f"[{LETTERS}]{{{least},}}"), re.compile(f"[^{LETTERS}]")
    lo = 0
    while lo < len(text):
        end = stop.search(text, lo + PIECE) if lo + PIECE < len(text) else None
        hi = end.start() if end else len(text)
        yield run.findall(text, lo, hi)
        lo = hi


def dropped(doc_id: str, word: str, every: int = EVERY) -> str:
    """The word, without one letter where the hash of document and word says so."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """``word, n``: runs of letters of the whole texts, A-Z lower-cased, letters dropped by hash, counted over all rows.

    Null and empty texts have none. A null id is written as nothing in front of the colon. Tasks count before anything is
    shuffled, so a word that is everywhere costs one row per task and flush.
    """

    def run(batches):
        held: Counter = Counter()

        def out():
            words = [w for w, n in held.items() if n]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, data in zip(b.column("_id"), b.column("_text")):
                text = data.as_py()
                if not text:
                    continue
                doc = doc.as_py() or ""
                start = zlib.crc32(f"{doc}:".encode())
                for words in _runs(text.lower().decode(), least_chars):  # of bytes, lower() changes A-Z only
                    held.update(words)
                    for w in [w for w in set(words) if zlib.crc32(w.encode(), start) % every == 0]:
                        n, less = words.count(w), dropped(doc, w, every)
                        held[w] -= n
                        if len(less) >= least_chars:
                            held[less] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    rows = df.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---------------------------------------------------------------- one edit


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def _row(above, q: tuple, depth: int, n, letter):
    """The next row of the band: edits between ``depth + 1`` letters of a word and ``depth``, ``depth + 1``, ``depth + 2`` of q.

    Arrays over many (word, q). ``q``: the letters of q at depth - 1, depth and depth + 1; ``n``: its length. Two means too many.
    """
    a, b, c = above
    x = np.where(depth <= n, np.minimum(b + 1, a + (q[0] != letter)) if depth else b + 1, 2)
    y = np.where(depth < n, np.minimum(np.minimum(x, c) + 1, b + (q[1] != letter)), 2)
    z = np.where(depth + 1 < n, np.minimum(y + 1, c + (q[2] != letter)), 2)
    return tuple(np.minimum(e, 2).astype(np.int8) for e in (x, y, z))


class Letters:
    """Words as one array of code points."""

    def __init__(self, words: list[str]):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)

    def at(self, word: np.ndarray, depth: int) -> np.ndarray:
        """Letter of each word at a depth; 0 before its first and beyond its last."""
        there = (depth >= 0) & (depth < self.length[word])
        return np.where(there, self.flat[np.where(there, self.start[word] + depth, 0)], 0)


def scan(words: list[str], asks: list[str], shared: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in ``asks``, place in ``words``) of all that are exactly one edit apart and share the ask's first ``shared`` letters.

    ``words`` is sorted, each once. A run of words with a common prefix, as the LCPs of neighbours tell, has one row of the
    matrix for each ask; rows go on from prefix to longer prefix, for many asks at once, and a run whose row has no entry
    of at most one edit is left out with all words in it.
    """
    if not words or not asks:
        return
    w, q = Letters(words), Letters(asks)
    lcp = np.fromiter([0, *map(common, words, words[1:])], np.int64, len(words))
    runs: dict[int, np.ndarray] = {}
    long = [np.arange(len(words))]

    def run_starts(depth: int) -> np.ndarray:
        """First words of the runs that share ``depth`` letters."""
        if depth not in runs:
            long[0] = long[0][w.length[long[0]] >= depth]
            runs[depth] = long[0][lcp[long[0]] < depth]
        return runs[depth]

    for d in range(1, min(shared) + 1):
        run_starts(d)
    order = sorted(range(len(asks)), key=lambda i: shared[i])
    for chunk in (order[i : i + ASKED] for i in range(0, len(order), ASKED)):
        ask, lo, hi = (np.empty(0, np.int64) for _ in range(3))
        row = tuple(np.empty(0, np.int8) for _ in range(3))
        depth, taken = shared[chunk[0]], 0
        while len(ask) or taken < len(chunk):
            fresh = [i for i in chunk[taken:] if shared[i] == depth]
            if fresh:
                taken += len(fresh)
                ask = np.concatenate([ask, fresh])
                lo = np.concatenate([lo, [bisect_left(words, asks[i][:depth]) for i in fresh]])
                hi = np.concatenate([hi, [bisect_right(words, asks[i][:depth] + _LAST) for i in fresh]])
                row = tuple(np.concatenate([r, np.full(len(fresh), v, np.int8)]) for r, v in zip(row, (1 if depth else 2, 0, 1)))
                some = lo < hi
                ask, lo, hi, row = ask[some], lo[some], hi[some], tuple(r[some] for r in row)
            if len(ask):
                at = q.length[ask] - depth + 1  # the entry for all of the ask, where a word ends here
                edits = np.where(at == 0, row[0], np.where(at == 1, row[1], np.where(at == 2, row[2], 2)))
                hit = (w.length[lo] == depth) & (edits == 1)
                if hit.any():
                    yield ask[hit], lo[hit]
                begin = run_starts(depth + 1)
                first, last = np.searchsorted(begin, lo), np.searchsorted(begin, hi)
                count = last - first
                up = np.repeat(np.arange(len(ask)), count)
                child = np.arange(len(up)) - np.repeat(np.cumsum(count) - count, count) + first[up]
                clo = begin[child]
                chi = np.where(child + 1 < last[up], begin[np.minimum(child + 1, len(begin) - 1)], hi[up]) if len(begin) else clo
                ask, n = ask[up], q.length[ask[up]]
                row = _row([r[up] for r in row], [q.at(ask, depth + k) for k in (-1, 0, 1)], depth, n, w.at(clo, depth))
                alive = np.minimum(np.minimum(row[0], row[1]), row[2]) < 2
                ask, lo, hi, row = ask[alive], clo[alive], chi[alive], tuple(r[alive] for r in row)
            depth += 1


def half(word: str) -> int:
    return len(word) // 2


def possible(prefix: str, q: str) -> bool:
    """Whether some word with this prefix can be within one edit of q: whether its row has such an entry."""
    same = common(prefix, q)
    if same >= min(len(prefix), len(q)):
        return len(prefix) <= len(q) + 1
    rest = prefix[same:]  # one edit at the first letter that differs, or none is left for it
    n = len(rest) - 1
    return rest[1:] == q[same + 1 : same + 1 + n] or rest[1:] == q[same : same + n] or rest == q[same + 1 : same + 2 + n]


# ---------------------------------------------------------------- ranges


class Ranges:
    """Borders of one sorted list; range i holds the words from border i - 1 (included) up to border i."""

    def __init__(self, borders: list[str]):
        self.borders = borders

    def home(self, word: str) -> int:
        return bisect_right(self.borders, word)

    def asked(self, word: str) -> list[int]:
        """Ranges that may hold a word with the first half of this one and at most one edit."""
        start = word[: half(word)]
        first, last = self.home(start), self.home(start + _LAST)
        out = []
        for i in range(first, last + 1):
            low = max(start, self.borders[i - 1]) if i else start
            high = min(start + _LAST, self.borders[i]) if i < len(self.borders) else start + _LAST
            if possible(low[: common(low, high)], word):
                out.append(i)
        return out


def _borders(words: DataFrame, reverse: bool, count: int, total: int) -> list[str]:
    """Borders from a sample by hash: about SAMPLES words a range, whatever the size of the vocabulary."""
    part = min(1.0, SAMPLES * count / max(total, 1))
    w = F.reverse("word") if reverse else F.col("word")
    few = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).select(w.alias("w")).limit(2 * SAMPLES * count).collect()
    found = sorted(r["w"] for r in few)
    step = max(1, len(found) // count)
    return sorted(set(found[step::step]))


def near(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: all pairs of words one edit apart, each pair once in either direction.

    ``words``: ``word, n``, each word once. Equal to comparing all words with all, of any length of two letters or more.
    """
    spark = words.sparkSession
    total = words.count()
    count = RANGES * parallelism(spark)
    sides = [Ranges(_borders(words, reverse, count, total)) for reverse in (False, True)]
    shared = spark.sparkContext.broadcast(sides)  # a number of borders that is set by the session

    def route(batches):
        for b in batches:
            out = []
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                for side, ranges in enumerate(shared.value):
                    w = word[::-1] if side else word
                    home = ranges.home(w)
                    out.append((side, home, w, n, True))
                    out.extend((side, i, w, n, False) for i in ranges.asked(w) if i != home)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["side", "range", "w", "n", "member"])

    routed = stored(words.select("word", "n").mapInArrow(route, "side long, range long, w string, n long, member boolean"))
    crowded = routed.where("NOT member").groupBy("side", "range").agg(F.ceil(F.count("*") / ASKERS).alias("parts")).where("parts > 1")  # no more rows than ranges
    parts = F.coalesce("parts", F.lit(1))
    dealt = routed.join(crowded, ["side", "range"], "left")
    part = F.when(F.col("member"), F.sequence(F.lit(0), parts.cast("int") - 1)).otherwise(F.array(F.pmod(F.xxhash64("w"), parts).cast("int")))
    dealt = dealt.select("side", "range", "w", "n", "member", F.explode(part).alias("part"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        side, part = int(pdf["side"].iloc[0]), int(pdf["part"].iloc[0])
        counts = dict(zip(pdf["w"], pdf["n"]))
        words = sorted(pdf.loc[pdf["member"], "w"])
        asking = [w for w, member in zip(pdf["w"], pdf["member"]) if not member or part == 0]
        out = []
        for asks, found in scan(words, asking, [half(q) for q in asking]):
            for q, w in zip(map(asking.__getitem__, asks.tolist()), map(words.__getitem__, found.tolist())):
                # the shorter asks, of equals the smaller; a pair that the first list has found is left out of the second
                if len(w) < len(q) or len(w) == len(q) and w < q:
                    continue
                if side and common(q[::-1], w[::-1]) >= half(q):
                    continue
                out.append((q[::-1] if side else q, counts[q], w[::-1] if side else w, counts[w]))
        return pd.DataFrame(out, columns=["a", "a_n", "b", "b_n"])

    once = dealt.groupBy("side", "range", "part").applyInPandas(compare, "a string, a_n long, b string, b_n long")
    both = F.inline(F.array(F.struct("a", "a_n", "b", "b_n"), F.struct(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))))
    return once.select(both)


# ---------------------------------------------------------------- forms


def _root(forms: DataFrame) -> DataFrame:
    """``word, root`` for words that have a form. The form's count is TIMES the word's at least, so chains are short, and each
    round follows twice as many steps as the one before."""
    left = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        step = left.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        left = stored(left.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if not left.where("moved").limit(1).count():
            return left.select("word", "root")
        left = left.select("word", "root")


def group(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word of ``words`` (``word, n``) once.

    ``form`` is the near word of largest count, the smallest of equals, if that count is ``times`` the word's; else null.
    """
    words = stored(words.select("word", "n"))
    best = near(words).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left")
    usual: Column = F.col("best.m") <= -times * F.col("n")
    told = stored(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(usual, F.col("best.form")).alias("form"),
            F.when(usual, -F.col("best.m")).alias("form_n"),
        )
    )
    root = _root(told.where("form IS NOT NULL"))
    return told.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
