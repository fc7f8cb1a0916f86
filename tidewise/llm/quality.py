"""Quality scores by compression: how much better a text compresses with a dictionary of good text than with one of bad text.

Two zstandard dictionaries are built from equal amounts of text of either label. A text is cut into windows of fixed
length in bytes, so that a dictionary helps all of it alike; every window is compressed with either dictionary. The
difference of the summed sizes, divided by the length of the text, is the raw measure. A logistic curve, fitted on labelled
documents that went into no dictionary and weighted back to the share that the labels have in the table, turns it into a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Windows in bytes; the dictionaries' sizes, and the settings of their builder and of the compressor.
WINDOW, DICTIONARY, SEGMENT, GRAIN, LEVEL = 1024, 65_536, 256, 8, 3
#: The bounded sample of labelled documents: so many of each label, the first in order of a hash; half builds dictionaries.
DOCS_PER_LABEL = 4000
#: Windows of a document that go into a dictionary's sample, and the bytes of the sample.
CUTS, SAMPLE_BYTES = 6, 4_000_000
#: Bytes that are added to a text's length, so that a few bytes of it don't make a strong case.
SHORT = 64
PREDICT_FROM = 0.3


@dataclass
class Model:
    """Dictionaries of bad and good text, the curve, and the share of label 1 (the score of a text without bytes)."""

    dictionaries: tuple[bytes, bytes] | None
    slope: float
    offset: float
    share: float

    def __post_init__(self):
        self._compressors = None

    def __getstate__(self):
        return {**self.__dict__, "_compressors": None}

    def measure(self, text: str | None) -> float | None:
        """Bytes saved by the good dictionary, as a share of the text; None without bytes or dictionaries."""
        data = (text or "").encode("utf-8", "replace")
        if not data or self.dictionaries is None:
            return None
        if self._compressors is None:
            self._compressors = [_compressor(d) for d in self.dictionaries]
        bad, good = self._compressors
        saved = 0
        for lo in range(0, len(data), WINDOW):
            window = data[lo : lo + WINDOW]
            saved += len(bad.compress(window)) - len(good.compress(window))
        return saved / (len(data) + SHORT)

    def score(self, text: str | None) -> float:
        x = self.measure(text)
        return self.share if x is None else float(_sigmoid(self.slope * x + self.offset))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def dictionary(windows: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the plain text of the windows where there is too little of it to train on."""
    try:
        return zstandard.train_dictionary(size, windows, k=SEGMENT, d=GRAIN).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(windows)[-size:]


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve by Newton steps; a small penalty on the slope keeps it finite."""
    scale = float(x.std()) or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    b, penalty = np.zeros(2), np.diag([0.1, 1e-4])
    loss = lambda b: float((weight * np.logaddexp(0, -(2 * y - 1) * (a @ b))).sum() + b @ penalty @ b / 2)
    for _ in range(steps):
        p = _sigmoid(a @ b)
        grad = a.T @ (weight * (p - y)) + penalty @ b
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty, grad)
        size = 1.0
        while loss(b - size * step) > loss(b) and size > 1e-6:
            size /= 2
        b = b - size * step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def _turn(*cols: str) -> Column:
    """A place in [0, 1) by hash."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)) / F.lit(float(1 << 53))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", docs_per_label: int = DOCS_PER_LABEL) -> Model:
    """Learn from documents whose id has a label of 0 or 1. Other labels, null ids and ids without a document teach nothing.

    Ids are chosen first, by a hash and from the labels alone, so that no text moves but that of the sample. An id with several
    labels or documents counts once for each pair; a bounded number of pairs is kept. With one label only, or none,
    nothing can be told apart, and every text gets the share of label 1 (one half without labels).
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)")
    count = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    share = (count.get(1, 0) + 1) / (sum(count.values()) + 2)
    if len(count) < 2:
        return Model(None, 0.0, 0.0, share)

    def chosen(label: int) -> DataFrame:
        part = min(1.0, 2 * docs_per_label / count[label])
        return known.where(F.col("_label") == label).withColumn("_turn", _turn("_id")).where(F.col("_turn") < part).orderBy("_turn").limit(docs_per_label)

    ids = chosen(0).unionByName(chosen(1))
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(ids), "_id").where(F.length("_text") > 0)  # at most 2 x docs_per_label ids
    rows = rows.withColumn("_half", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)))

    places = F.greatest(F.ceil(F.length(text) / WINDOW), F.lit(1))
    cut = lambda k: F.substr(text, (F.pmod(F.xxhash64("_id", F.lit(k)), places) * WINDOW + 1).cast("int"), F.lit(WINDOW))
    cuts = F.array_distinct(F.array(*[cut(k) for k in range(CUTS)]))
    found = rows.where("_half = 0").select("_label", "_turn", "_id", cuts.alias("_cuts")).orderBy("_turn", "_cuts").limit(2 * docs_per_label).collect()
    windows: tuple[list[bytes], list[bytes]] = ([], [])
    for r in sorted(found, key=lambda r: (r["_turn"], str(r["_id"]), r["_cuts"])):
        windows[r["_label"]].extend(c.encode("utf-8", "replace")[:WINDOW] for c in r["_cuts"] if c)
    if not all(windows):
        return Model(None, 0.0, 0.0, share)
    most = min(SAMPLE_BYTES, *(sum(map(len, w)) for w in windows))  # equal amounts of either label, so that neither knows more
    size = max(256, min(DICTIONARY, most // 4))
    model = Model(tuple(dictionary(_upto(w, most), size) for w in windows), 0.0, 0.0, share)

    measured = rows.where("_half = 1").select("_label", "_turn", measure(F.col("_text"), model, docs.sparkSession).alias("_x"))
    pairs = measured.where("_x IS NOT NULL").orderBy("_turn", "_x").limit(2 * docs_per_label).collect()
    pairs = sorted((r["_x"], r["_label"]) for r in pairs)
    x, y = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float)
    if len(set(y)) < 2:
        model.slope, model.offset = 0.0, math.log(share / (1 - share))
        return model
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.slope, model.offset = curve(x, y, weight)
    return model


def _upto(windows: list[bytes], most: int) -> list[bytes]:
    out, size = [], 0
    for w in windows:
        if size >= most:
            break
        out.append(w)
        size += len(w)
    return out


def _each_text(kind: str, f):
    """An Arrow function of the text alone: other columns stay with Spark, so none can clash and none travels."""

    @F.arrow_udf(kind)
    def run(text: pa.Array) -> pa.Array:
        return pa.array([f(t.as_py()) for t in text], pa.float64())

    return run


def measure(text: Column, model: Model, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of bounded size
    return _each_text("double", lambda t: shared.value.measure(t))(text.cast("string"))


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``df`` and the score of each whole text: 0 to 1, higher where label 1 is likelier.

    A null or empty text gets the share of label 1. A column named like ``out`` is replaced. Equal texts have equal scores.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.withColumn(out, _each_text("double", lambda t: shared.value.score(t))(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents kept from learning: 5 divides crc32 of the id as text. A null id is not held out; it has no label either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
