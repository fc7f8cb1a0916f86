"""Language identification by a byte convolution network, trained here in numpy.

Texts are cut into windows of fixed length in bytes. Filters of several widths run over a window's bytes; each keeps its
largest response, and a softmax layer weighs these. Probabilities are averaged over all windows of a text. Since a byte is
one of 256 inputs, a filter is a sum of table rows; for prediction the tables of two neighbouring bytes are added up.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewise.llm.bpe import _slices

WINDOW = 128
WIDTHS, FILTERS = (2, 3, 4), 16
#: The bounded training sample: so many documents of each language, the first in order of a hash, and windows of each.
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC = 800, 3
EPOCHS, BATCH, RATE = 6, 128, 0.02
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (padded with zero bytes), the text each belongs to, and its number of bytes."""
    count = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    data = np.frombuffer(b"".join([t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, count)]), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    size = np.array([len(t) for t in texts], np.int64)[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW
    return data, owner, np.minimum(size, WINDOW)


class Network:
    """``filters[w]``: (w, 256, FILTERS); ``bias``: one per filter; ``out``: (all filters + 1, labels)."""

    def __init__(self, labels: list[str], seed: int = 0):
        r = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        self.labels = labels
        self.filters = {w: r.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(n, np.float32)
        self.out = np.concatenate([r.normal(0, 0.2, (n, len(labels))), np.zeros((1, len(labels)))]).astype(np.float32)
        self.tables = None

    def _softmax(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.out[:-1] + self.out[-1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 0) -> None:
        """Adam over shuffled batches; the same input gives the same network."""
        r = np.random.default_rng(seed)
        params = [*self.filters.values(), self.bias, self.out]
        mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                xb, yb = x[order[lo : lo + BATCH]], y[order[lo : lo + BATCH]]
                pooled, where = [], []
                for w in WIDTHS:
                    span = WINDOW - w + 1
                    a = self.filters[w][0][xb[:, :span]]
                    for j in range(1, w):
                        a = a + self.filters[w][j][xb[:, j : j + span]]
                    where.append(a.argmax(axis=1))
                    pooled.append(np.take_along_axis(a, where[-1][:, None], axis=1)[:, 0])
                raw = np.concatenate(pooled, axis=1) + self.bias
                hidden = np.maximum(raw, 0)
                p = self._softmax(hidden)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                back = (p @ self.out[:-1].T) * (raw > 0)
                grads = []
                for k, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.filters[w])
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    column = np.broadcast_to(np.arange(FILTERS), part.shape)
                    row = np.arange(len(xb))[:, None]
                    for j in range(w):
                        np.add.at(g[j], (xb[row, where[k] + j], column), part)
                    grads.append(g)
                grads += [back.sum(axis=0), np.concatenate([hidden.T @ p, p.sum(axis=0, keepdims=True)])]
                step += 1
                for q, g, m, v in zip(params, grads, mean, square):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.tables is None:
            f = self.filters
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
            self.tables = {w: [pair(f[w][j], f[w][j + 1]) for j in range(0, w - 1, 2)] for w in WIDTHS}
        out = []
        for lo in range(0, len(x), 512):
            b = x[lo : lo + 512]
            two = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            pooled = []
            for w in WIDTHS:
                span = WINDOW - w + 1
                a = self.tables[w][0][two[:, :span]]
                for k, t in enumerate(self.tables[w][1:], 1):
                    a += t[two[:, 2 * k : 2 * k + span]]
                if w % 2:
                    a += self.filters[w][w - 1][b[:, w - 1 :]]
                pooled.append(a.max(axis=1))
            out.append(self._softmax(np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)))
        return np.concatenate(out) if out else np.empty((0, len(self.labels)), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Label and score of whole texts; UNKNOWN and 0 without a letter, or if nothing was learned."""
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.labels and _LETTER.search(t)]
        if known:
            x, owner, size = windows([texts[i].encode("utf-8", "replace") for i in known])
            p = self.probabilities(x).astype(np.float64) * size[:, None]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            total = np.add.reduceat(p, first) / np.add.reduceat(size, first)[:, None]
            for i, k, s in zip(known, total.argmax(axis=1), total.max(axis=1)):
                labels[i], scores[i] = self.labels[k], min(1.0, float(s))
        return labels, scores


def sample(df: DataFrame, id_col: str, text_col: str, label_col: str, docs: int = DOCS_PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """At most ``docs`` documents of each label, in order of a hash of id and text; WINDOWS_PER_DOC windows of each."""
    text, turn = F.col("_text"), F.xxhash64("_id", "_text")
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(label_col).cast("string").alias("_label")).where("_label IS NOT NULL AND _text RLIKE '\\\\p{L}'")
    place = lambda k: F.pmod(F.xxhash64("_id", F.lit(k)), F.greatest(F.length(text) - WINDOW + 1, F.lit(1))) + 1
    cut = F.array(*[F.substr(text, place(k).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS_PER_DOC)])
    few = rows.select("_label", turn.alias("_turn"), cut.alias("_cuts")).withColumn("_k", F.row_number().over(Window.partitionBy("_label").orderBy("_turn", "_cuts"))).where(F.col("_k") <= docs)
    found = few.select("_label", "_turn", "_cuts").collect()
    return sorted((r["_label"], c.encode()[:WINDOW]) for r in found for c in sorted(set(r["_cuts"])))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", docs: int = DOCS_PER_LANGUAGE) -> Network:
    """Train on the bounded sample. Rows without label, text or letter teach nothing; without any row nothing is learned."""
    rows = sample(df, id_col, text_col, label_col, docs)
    labels = sorted({r[0] for r in rows})
    net = Network(labels)
    if rows:
        number = {s: i for i, s in enumerate(labels)}
        net.train(windows([r[1] for r in rows])[0], np.array([number[r[0]] for r in rows]))
    return net


def told(net: Network, text: Column) -> Column:
    """``lang_pred, score`` of a text as a struct. Only the texts reach Python; all other columns of a row stay with Spark."""
    shared = SparkSession.active().sparkContext.broadcast(net)  # the size of the network doesn't depend on the data

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        model, all_labels, all_scores = shared.value, [], []
        for lo, hi in _slices([range(n or 0) for n in pc.utf8_length(texts).to_pylist()]):
            labels, scores = model.predict(texts.slice(lo, hi - lo).to_pylist())
            all_labels += labels
            all_scores += scores
        return pa.StructArray.from_arrays([pa.array(all_labels, pa.string()), pa.array(all_scores, pa.float64())], names=["lang_pred", "score"])

    return predict(text.cast("string"))


def identify(df: DataFrame, net: Network, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score``, one row per row; only the whole text decides."""
    fields = [df.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double"])
    shared = df.sparkSession.sparkContext.broadcast(net)  # the size of the network doesn't depend on the data

    def run(batches):
        model = shared.value
        for b in batches:
            texts = b.column("_text").to_pylist()
            for lo, hi in _slices(texts):
                labels, scores = model.predict(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in keep], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return df.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents kept from training: crc32 of the id as text leaves 1 by 3. A null id is not held out (nor learned from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
