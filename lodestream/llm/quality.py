"""Compression classifier of text quality.

Two zstandard dictionaries are built from labelled text, one from good and one from bad. A text is cut into
pieces and each is compressed with either dictionary; the difference of the two sizes as a share of the
larger says which kind the text is like. Text that repeats itself shrinks under either, which the share of
its size that remains tells. A logistic curve of the two, fitted on labelled texts that the dictionaries
never saw, makes a probability of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import give_back, wide_rows

#: Labelled texts of either class that the model is fitted on, at most, and their bytes together.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 16 << 20
#: Bytes of a dictionary, and of the pieces that are compressed with it.
DICTIONARY = 64 << 10
PIECE = 512
LEVEL = 3
#: Bytes that count as a text's frame, so that very short texts don't seem to grow.
_FRAME = 8
FOLDS = 5


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    offset: float

    def scorer(self):
        """A function from a text's bytes to its probability of being good."""
        with_good, with_bad = (_compressor(d) for d in (self.good, self.bad))
        scaled = [w / s for w, s in zip(self.weights, self.spread)]
        offset = self.offset - sum(w * m for w, m in zip(scaled, self.mean))

        def score(data: bytes) -> float:
            x = offset + sum(w * f for w, f in zip(scaled, _features(data, with_good, with_bad)))
            return 1 / (1 + exp(-min(30.0, max(-30.0, x))))

        return score


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**options)
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, **options)


def _features(data: bytes, with_good, with_bad) -> tuple[float, float]:
    """How much smaller the good dictionary makes a text than the bad one, as a share, and the log of what it leaves."""
    good = bad = 0
    data = memoryview(data)
    for k in range(0, max(1, len(data)), PIECE):
        piece = data[k : k + PIECE]
        good += len(with_good.compress(piece))
        bad += len(with_bad.compress(piece))
    return (bad - good) / max(good, bad), log((good + _FRAME) / (len(data) + _FRAME))


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[k : k + PIECE] for t in texts for k in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: it is the dictionary itself
        return b"".join(texts)[-DICTIONARY:]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset of P(y = 1) by Newton's method with a slight ridge."""
    rows = np.c_[x, np.ones(len(x))]
    w = np.zeros(rows.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + 0.01 * np.eye(len(w))
        w += np.clip(np.linalg.solve(curve, rows.T @ (y - p) - 0.01 * w), -5, 5)
    return w


def held_out(doc_id):
    """Column: whether a document is kept from learning (crc32 of its id as text leaves 0); null ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from the labels (0 or 1) of documents that are not held out.

    It is fitted on a sample of SAMPLE_ROWS documents and SAMPLE_BYTES of text of either class at most, those
    of the least hash of their id; the shares of the classes are counted over all labels. Null and other
    labels and ids with both labels don't count. Without labelled text of both classes every score is the
    share of good labels, with one good and one bad label added.
    """
    ids = F.col(id_col)
    known = labels.where(F.col(label_col).isin(0, 1) & ids.isNotNull() & ~held_out(ids)).groupBy(id_col).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
    known = known.where("low = high").select(F.col(id_col).alias("id"), F.col("low").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    prior = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    order = F.xxhash64(F.col("id").cast("string"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).withColumn("h", order).orderBy("h", "id").limit(SAMPLE_ROWS)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.where(ids.isNotNull() & (F.octet_length(text_col) > 0)).select(ids.alias("id"), F.col(text_col).alias("t"))
    texts = texts.where(F.octet_length("t") <= SAMPLE_BYTES).join(F.broadcast(chosen), "id")  # 2 * SAMPLE_ROWS rows at most
    upto = Window.partitionBy("y").orderBy("h", "id", "t").rowsBetween(Window.unboundedPreceding, 0)
    texts = texts.withColumn("bytes", F.sum(F.octet_length("t")).over(upto)).where(F.col("bytes") <= SAMPLE_BYTES)
    by_class: dict[int, list] = {0: [], 1: []}
    for r in texts.select("y", "h", "id", F.col("t").cast("binary").alias("t")).collect():
        by_class[r["y"]].append((r["h"], r["id"], bytes(r["t"])))
    found = {y: [t for _, _, t in sorted(rows)] for y, rows in by_class.items()}
    if not found[0] or not found[1]:
        return Model(b"", b"", (0.0, 0.0), (1.0, 1.0), (0.0, 0.0), prior)
    good, bad = _dictionary(found[1][::2]), _dictionary(found[0][::2])
    with_good, with_bad = _compressor(good), _compressor(bad)
    rest = [(t, y) for y in (0, 1) for t in found[y][1::2] or found[y]]
    x = np.array([_features(t, with_good, with_bad) for t, _ in rest])
    y = np.array([c for _, c in rest], float)
    mean, spread = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    *weights, offset = _logistic((x - mean) / spread, y).tolist()
    sampled = float(np.log(y.sum() / (len(y) - y.sum())))
    return Model(good, bad, tuple(mean.tolist()), tuple(spread.tolist()), tuple(weights), offset + prior - sampled)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns `keep` of `docs` (all by default) and `name`: the probability that the whole text is good.

    Null counts as empty, and an empty text has the score of one that is like neither dictionary. Rows stay
    as they are; a column of `docs` called `name` is replaced. Nothing but the text enters the score.
    """
    wide_rows(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

    def run(batches):
        of = model.scorer()
        for batch in batches:
            scores = [of(t.as_buffer() if t.is_valid else b"") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, name])
        give_back()

    at = keep.index(text_col) if text_col in keep else len(keep)
    columns = keep if text_col in keep else [*keep, text_col]
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
