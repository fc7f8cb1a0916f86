"""Byte-level BPE by longest matches and backtracking.

The vocabulary's tokens, read as Latin-1, fill an Aho-Corasick automaton. A piece of text is encoded from left to right
by the longest token at each place; a token may follow another only if BPE itself would keep the two apart, which is
looked up once per pair. Where nothing fits, the last token is taken back and a shorter one tried; a place that failed
is never tried again, so the work is linear in the piece.
"""

from __future__ import annotations

import base64
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the memory of encoded words in a task, at which it starts anew. Only speed depends on it.
WORDS_KEPT = 300_000
PAIRS_KEPT = 2_000_000
#: Unicode white space, as the splitting pattern of the public vocabularies understands it.
SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words with the blank before them. Every border between two of its matches is a border of the splitting pattern too.
CHUNKS = rf"[{SPACE}]+(?![^{SPACE}])|\x20?[^{SPACE}]+|[{SPACE}]"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Tables of one rank file.

    Exact for vocabularies in which each token of several bytes is what BPE makes of its bytes by merging two earlier
    tokens. Tokens without such a pair are found only where a whole piece equals them, as in BPE itself.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.chunks = re.compile(CHUNKS)
        self.ranks = ranks
        by_rank = {r: t for t, r in ranks.items()}
        self.raw = [by_rank.get(i) for i in range(max(by_rank, default=-1) + 1)]
        self.text = [(t or b"").decode("latin-1") for t in self.raw]
        self.length = [len(t) for t in self.text]
        self.halves: list[tuple[int, int] | None] = [None] * len(self.text)
        self.merged: dict[tuple[int, int], int] = {}
        self.allowed: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        mergeable = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1 or self._split(token, rank):
                mergeable.append(rank)
        self.shorter = [-1] * len(self.text)  # the longest mergeable token that is a true prefix
        known = self.known = {self.text[r]: r for r in mergeable}
        self.reach = max(map(len, known), default=1)
        self.automaton = ahocorasick.Automaton()
        for r in mergeable:
            self.automaton.add_word(self.text[r], r)
            t = self.text[r]
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in known:
                    self.shorter[r] = known[t[:n]]
                    break
        self.automaton.make_automaton()

    def _split(self, token: bytes, rank: int) -> bool:
        """Find the two earlier tokens that BPE joins last in this token."""
        for cut in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if a is None or b is None or a >= rank or b >= rank or not (self._made(a) and self._made(b)):
                continue
            if self._stay_apart(a, b, rank):
                self.halves[rank], self.merged[(a, b)] = (a, b), rank
                return True
        return False

    def _made(self, token: int) -> bool:
        return self.length[token] == 1 or self.halves[token] is not None

    def _stay_apart(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether BPE, using merges below ``before`` only, leaves this border between the two tokens.

        Undo the merges next to the border, the latest first. If two tokens that meet there would have merged before
        the merge that was just undone, the border would not have survived.
        """
        limit = len(self.text) if before is None else before
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            a, b = self.halves[left], self.halves[right]
            if a is None and b is None:
                return True
            # Equal merges happen from left to right: the right one of two equal tokens is undone first.
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def _fits(self, left: int, right: int) -> bool:
        pair = (left, right)
        ok = self.allowed.get(pair)
        if ok is None:
            if len(self.allowed) >= PAIRS_KEPT:
                self.allowed.clear()
            ok = self.allowed[pair] = self._stay_apart(left, right)
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, n = piece.decode("latin-1"), len(piece)
        length, shorter, allowed, alive = self.length, self.shorter, self.allowed, bytearray(b"\x01" * (n + 1))
        tokens, at, last, token = [], 0, -1, self._longest(text, 0)
        while at < n:
            while token >= 0:
                if alive[at + length[token]]:
                    ok = last < 0 or allowed.get((last, token))
                    if ok is None:
                        ok = self._fits(last, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at += length[token]
                last = token
                if at < n:
                    token = self._longest(text, at)
            elif tokens:
                alive[at] = 0
                token = tokens.pop()
                at -= length[token]
                last = tokens[-1] if tokens else -1
            else:
                raise ValueError("a byte of the text is no token of this vocabulary")
        return tokens

    def _longest(self, text: str, at: int) -> int:
        """The longest mergeable token that the text has at this place, or -1. The automaton bounds how far to look."""
        end = at + self.automaton.longest_prefix(text[at : at + self.reach])
        while end > at:
            token = self.known.get(text[at:end])
            if token is not None:
                return token
            end -= 1
        return -1

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as unsigned 32-bit integers."""
        words = self.words
        found = []
        for w in self.chunks.findall(text):
            ids = words.get(w)
            if ids is None:
                parts = []
                for p in self.pattern.findall(w):
                    got = self.pieces.get(p) or self.older.get(p)
                    if got is None:
                        got = array("I", self.encode_piece(p.encode())).tobytes()
                        if len(p) < 100:
                            if len(self.pieces) >= WORDS_KEPT:
                                self.older, self.pieces = self.pieces, {}
                            self.pieces[p] = got
                    parts.append(got)
                ids = b"".join(parts)
                if len(w) < 100:
                    if len(words) >= WORDS_KEPT:
                        words.clear()
                    words[w] = ids
            found.append(ids)
        return np.frombuffer(b"".join(found), np.uint32)

    def decode(self, ids) -> bytes:
        """Bytes of the tokens. An id outside the vocabulary raises IndexError or TypeError."""
        return b"".join([self.raw[i] for i in ids])


_OPEN: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per process."""
    if (path, pattern) not in _OPEN:
        _OPEN[(path, pattern)] = Vocabulary(read_ranks(path), pattern)
    return _OPEN[(path, pattern)]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, np.uint32)]).astype(np.int32)))


#: Characters of a batch of results, so that one batch with many ids stays small.
SLICE = 4_000_000


def _slices(texts: list, most: int = SLICE):
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """Columns ``keep``, then ``ids`` (array of int) of the whole text; with ``decoded`` also the bytes decoded from these ids.

    Null and empty texts have no ids. Rows are taken as they are, repeated or not. ``keep`` may name any columns of
    ``df`` but ``ids`` and ``decoded``; other columns are dropped. Only columns that are needed reach Python.
    """
    fields = [df.schema[c] for c in keep]
    chosen = df.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["ids array<int>"] + ["decoded binary"] * decoded)

    def run(batches):
        v = vocabulary(path, pattern)
        for b in batches:
            texts = b.column("_text").to_pylist()
            for lo, hi in _slices(texts):
                ids = [v.encode(t) for t in texts[lo:hi]]
                columns = [b.column(c).slice(lo, hi - lo) for c in keep] + [_lists(ids)]
                if decoded:
                    columns.append(pa.array([v.decode(i.tolist()) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids"] + ["decoded"] * decoded)

    return chosen.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` and ``decoded`` (binary). Null ids give empty bytes."""
    fields = [df.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["decoded binary"])

    def run(batches):
        v = vocabulary(path, pattern)
        for b in batches:
            out = pa.array([v.decode(i or ()) for i in b.column("_ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], out], names=[*keep, "decoded"])

    return df.select(*keep, F.col(ids_col).alias("_ids")).mapInArrow(run, schema)
