"""Token-id files with Re-Pair grammar compression.

Documents are put in order of their ids, encoded with the tokenizers library, and packed into shards. In each shard the
frequent pairs of neighbouring ids are replaced by new symbols, again and again; no symbol crosses a document. A shard
file holds the rules, the expanded length of every symbol, and for each document its id, its number of ids and its
number of symbols, so that one document can be decoded without its neighbours.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewise.llm.bpe import WORDS_KEPT, _slices
from tidewise.llm.common import parallelism, stored

FORMAT = b"RPR1"
_HEAD = struct.Struct("<4sIQIQII")  # magic, documents, ids, rules, symbols, first new symbol, end id (+1; 0: none)
#: Ids after which a shard is closed (a longer document has a shard of its own).
SHARD_IDS = 1_000_000
ROUNDS = 12
#: A pair is frequent if it makes up this part of the shard, and occurs LEAST times.
SHARE, LEAST = 1 / 4096, 4
STOPS = ".,;:!?"
#: Parts that begin and end with a printable ASCII character, perhaps behind a line end: no white space at their borders.
PLAIN = r"(?s)^\n?[!-~](.*[!-~])?$"
#: Characters that are encoded together.
TOGETHER = 16_000_000
SHARDS = "shard long, documents long, ids long, file binary"


# One shard, in numpy.


def compress(ids: np.ndarray, lengths: np.ndarray, base: int):
    """Rules (pairs of symbols, numbered from ``base``), symbols, and symbols per document."""
    seq = ids.astype(np.int32)
    closes = np.zeros(len(seq), bool)  # the last symbol of its document
    closes[np.cumsum(lengths)[lengths > 0] - 1] = True
    rules: list[np.ndarray] = []
    n_rules = 0
    for _ in range(ROUNDS):
        n = len(seq)
        if n < 2:
            break
        need = max(LEAST, int(n * SHARE))
        often = np.flatnonzero(np.bincount(seq, minlength=base + n_rules) >= need)  # both ids of a frequent pair are frequent
        m = len(often)
        if not m:
            break
        rank = np.full(base + n_rules, -1, np.int32)
        rank[often] = np.arange(m)
        r = rank[seq]
        at = np.flatnonzero((r[:-1] >= 0) & (r[1:] >= 0) & ~closes[:-1])
        pair = r[at] * np.int32(m) + r[at + 1]  # m is at most 1 / SHARE
        count = np.bincount(pair, minlength=m * m)
        new = np.flatnonzero(count >= need)
        if not len(new):
            break
        number = np.full(m * m, -1, np.int32)
        number[new] = np.arange(len(new))
        hit = number[pair]
        chosen = hit >= 0
        at, hit = at[chosen], hit[chosen]
        # Of overlapping pairs every second one, counted from the left.
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        run = np.repeat(first, np.diff(np.append(first, len(at))))
        free = (np.arange(len(at)) - run) % 2 == 0
        at, hit = at[free], hit[free]
        seq[at] = base + n_rules + hit
        closes[at] = closes[at + 1]
        keep = np.ones(n, bool)
        keep[at + 1] = False
        seq, closes = seq[keep], closes[keep]
        rules.append(np.stack([often[new // m], often[new % m]], axis=1))
        n_rules += len(new)
    table = np.concatenate([*rules, np.empty((0, 2), np.int64)])
    per_doc = np.zeros(len(lengths), np.int64)
    per_doc[lengths > 0] = np.diff(np.flatnonzero(closes), prepend=-1)
    return table, seq, per_doc


def expansions(rules: np.ndarray, base: int) -> np.ndarray:
    """Expanded length of each rule; a rule only uses earlier ones."""
    n = [0] * len(rules)
    for i, (a, b) in enumerate(rules.tolist()):
        n[i] = (1 if a < base else n[a - base]) + (1 if b < base else n[b - base])
    return np.array(n, np.int64)


def _narrow(a: np.ndarray) -> bytes:
    wide = len(a) and a.max() > 0xFFFF
    return bytes([4 if wide else 2]) + a.astype("<u4" if wide else "<u2").tobytes()


def pack(doc_ids: list, ids: list[np.ndarray], end_id: int | None, base: int) -> bytes:
    """A shard file. ``end_id`` follows every document; it is stored once."""
    lengths = np.array([len(i) for i in ids], np.int64)
    flat = np.concatenate([*ids, np.empty(0, np.uint32)])
    base = max(base, int(flat.max(initial=0)) + 1)
    rules, symbols, per_doc = compress(flat, lengths, base)
    null = np.array([i is None for i in doc_ids], np.uint8)
    keys = np.array([i or 0 for i in doc_ids], "<i8")
    head = _HEAD.pack(FORMAT, len(ids), len(flat), len(rules), len(symbols), base, 0 if end_id is None else end_id + 1)
    body = [null.tobytes(), keys.tobytes(), lengths.astype("<u4").tobytes(), per_doc.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), expansions(rules, base).astype("<u4").tobytes(), _narrow(symbols)]
    return head + b"".join(body)


class Shard:
    """A shard file opened for reading."""

    def __init__(self, data: bytes):
        magic, docs, self.n_ids, n_rules, n_symbols, self.base, end = _HEAD.unpack_from(data)
        if magic != FORMAT:
            raise ValueError("not a token-id shard")
        self.end_id = end - 1 if end else None
        at = _HEAD.size

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        null = take("u1", docs)
        self.doc_ids = [None if x else int(i) for x, i in zip(null, take("<i8", docs))]
        self.lengths, self.per_doc = take("<u4", docs), take("<u4", docs)
        self.rules, self.expanded = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        self.symbols = take({2: "<u2", 4: "<u4"}[int(take("u1", 1)[0])], n_symbols)
        self.first = np.concatenate([[0], np.cumsum(self.per_doc, dtype=np.int64)])
        size = self.expanded.astype(np.int64)
        self.flat_at = np.concatenate([[0], np.cumsum(size)])
        self.flat = np.empty(self.flat_at[-1], np.uint32)
        for i, (a, b) in enumerate(self.rules.tolist()):
            at0 = self.flat_at[i]
            for x in (a, b):
                if x < self.base:
                    self.flat[at0] = x
                    at0 += 1
                else:
                    part = self.flat[self.flat_at[x - self.base] : self.flat_at[x - self.base + 1]]
                    self.flat[at0 : at0 + len(part)] = part
                    at0 += len(part)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        s = symbols.astype(np.int64)
        new = s >= self.base
        rule = np.where(new, s - self.base, 0)
        size = np.where(new, np.append(self.expanded, 0)[rule], 1).astype(np.int64)
        ends = np.cumsum(size)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint32)
        out[(ends - size)[~new]] = s[~new]
        if new.any():
            n, start, source = size[new], (ends - size)[new], self.flat_at[:-1][rule[new]]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(start, n) + inner] = self.flat[np.repeat(source, n) + inner]
        return out

    def document(self, i: int) -> np.ndarray:
        """Ids of one document, decoded alone, with the end id."""
        ids = self._expand(self.symbols[self.first[i] : self.first[i + 1]])
        return ids if self.end_id is None else np.append(ids, np.uint32(self.end_id))

    def documents(self):
        """(doc_id, ids with the end id) of all documents in order."""
        flat, ends = self._expand(self.symbols), np.cumsum(self.lengths, dtype=np.int64)
        end = np.array([] if self.end_id is None else [self.end_id], np.uint32)
        for i, (a, b) in enumerate(zip(ends - self.lengths, ends)):
            yield self.doc_ids[i], np.concatenate([flat[a:b], end])


# Encoding with the tokenizers library.


class Encoder:
    """A tokenizer file. Words are encoded once and remembered where the file's splitting rule allows it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.by_word = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_word = self.by_word and len(end) == 1
        self.line_end = end[0]
        self.stops = {c: i.tobytes() for c, i in zip(STOPS, self._ids(list(STOPS)))}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words without line ends. Many are encoded as one text with line ends between: there, a line end is a
        piece of its own in the splitting rule."""
        out: list[bytes] = []
        for ids in self._ids(["\n".join(words[i : i + 256]) for i in range(0, len(words), 256)]):
            cuts = np.flatnonzero(ids == self.line_end)
            data, starts, ends = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
            out += [data[i:j] for i, j in zip(starts, ends)]
        return out

    @staticmethod
    def _odd(part: str) -> bool:
        """Parts whose ids depend on what stands before or behind: none, or ones that begin or end with white space."""
        body = part[1:] if part[:1] == "\n" else part
        return not body or body[0].isspace() or body[-1].isspace()

    def _known(self, parts: list[str]) -> list[bytes]:
        """Ids of parts: words after a blank, or words after a line end with that line end."""
        words, older = self.words, self.older
        out = list(map(words.get, parts))
        missing = [p for p, ids in zip(parts, out) if ids is None]
        if not missing:
            return out
        new = []
        for p in missing:
            if (ids := older.get(p)) is None:
                new.append(p)
            else:
                words[p] = ids
        # A sign of STOPS behind a letter is a piece of its own.
        line = np.array([self.line_end], np.uint32).tobytes()
        stopped = [p for p in new if p[-1] in STOPS and len(p) > 1 and p[-2].isalpha()]
        if stopped:
            new = list({*new, *(p[:-1] for p in stopped if p[:-1] not in words)}.difference(stopped))
        found = self._word_ids([p[1:] if p[0] == "\n" else " " + p for p in new]) if new else []
        words.update((p, line + i if p[0] == "\n" else i) for p, i in zip(new, found))
        words.update((p, words[p[:-1]] + self.stops[p[-1]]) for p in stopped)
        out = list(map(words.__getitem__, parts))
        if len(words) > WORDS_KEPT:
            self.older, self.words = words, {}
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts.

        With a ByteLevel splitting rule a single blank or line end between two words begins a new piece, so each
        different word of a batch is looked up once. Texts with other white space at the borders of words, and those
        with an added token, which is found before words are split, go to the library as they are.
        """
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and self.by_word and not any(a in t for a in self.added)]
        if plain:
            parts = pc.split_pattern(pa.array(["\n" + texts[i].replace("\n", " \n") for i in plain], pa.large_string()), " ")
            per_text = np.diff(parts.offsets.to_numpy())
            coded = parts.flatten().dictionary_encode()
            index, different = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            odd = ~pc.match_substring_regex(coded.dictionary, PLAIN).to_numpy(zero_copy_only=False)
            odd[odd] = [self._odd(different[k]) for k in np.flatnonzero(odd).tolist()]
            fine = np.bincount(np.repeat(np.arange(len(plain)), per_text), odd[index], len(plain)) == 0
            ids = self._known(list(itertools.compress(different, (~odd).tolist())))
            size = np.zeros(len(different), np.int64)
            size[~odd] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat, begins = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size) - size
            n = size[index]
            ends = np.cumsum(n)
            whole = flat[np.repeat(begins[index] - (ends - n), n) + np.arange(n.sum())]
            last = np.append(0, ends)[np.cumsum(per_text)]
            for k, i in enumerate(plain):
                if fine[k]:  # without the line end that was put before the text
                    out[i] = whole[(last[k - 1] if k else 0) + 1 : last[k]]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._ids([texts[i] for i in rest]) if rest else ()):
            out[i] = x
        return out


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


# Spark.


def write(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, shard_ids: int = SHARD_IDS) -> None:
    """Shard files as rows of a Parquet table: ``shard`` (ascending with the documents), ``documents``, ``ids``, ``file``.

    Documents stand in ascending order of their ids, null first; rows with equal ids in order of their texts. Null texts
    are empty and hold the end id only.
    """
    docs = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    parts = docs.repartitionByRange(max(parallelism(df.sparkSession), 1), "_id").sortWithinPartitions("_id", "_text")

    def run(batches):
        e, part, k = encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, ids, size = [], [], 0

        def flush():
            nonlocal doc_ids, ids, size, k
            row = [(part << 32) + k, len(ids), size + (len(ids) if end_id is not None else 0), pack(doc_ids, ids, end_id, e.tokenizer.get_vocab_size())]
            doc_ids, ids, size, k = [], [], 0, k + 1
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.int64()), pa.array([row[3]], pa.binary())], names=["shard", "documents", "ids", "file"])

        for b in batches:
            keys, texts = b.column("_id").to_pylist(), b.column("_text").to_pylist()
            for lo, hi in _slices(texts, TOGETHER):
                for key, found in zip(keys[lo:hi], e.encode(texts[lo:hi])):
                    if ids and size + len(found) > shard_ids:
                        yield flush()
                    doc_ids.append(key)
                    ids.append(found)
                    size += len(found)
        if ids:
            yield flush()

    parts.mapInArrow(run, SHARDS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files: ``doc_id, start, n_tokens, ids_crc32`` (with the end id)."""
    shards = spark.read.parquet(path)
    sizes = shards.groupBy((F.shiftright("shard", 32)).alias("part")).agg(F.sum("ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that wrote
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", "ids", F.shiftright("shard", 32).alias("part")).withColumn("in_part", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    starts = stored(starts.join(bases, "part").select("shard", (F.col("part_base") + F.col("in_part")).alias("base")))

    def run(batches):
        for b in batches:
            for shard, data in zip(b.column("shard").to_pylist(), b.column("file")):
                rows, at = [], 0
                for key, ids in Shard(data.as_py()).documents():
                    rows.append((shard, key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = shards.select("shard", "file").mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
