"""Counterfactual-regularised classifier of toxic text.

A logistic model of how often words, and beginnings of words, occur. Where toxic examples mention a group of
people more often than others do, such a model learns the group's name; so every labelled sentence that names one
is written again with other groups' names and with a neutral one, and a change of its score is penalised. What is
left of the score is what doesn't depend on who is named.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import _logistic, held_out
from .shared import give_back, wide_rows

#: Names of groups of people, the neutral name first; names of a row stand for one another (fixed values).
IDENTITY = (
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "foreigners", "africans", "asians", "arabs", "mexicans", "women", "men", "gays", "lesbians"),
    ("person", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee", "foreigner", "african", "asian", "arab", "mexican", "woman", "man", "lesbian"),
    ("ordinary", "black", "white", "jewish", "islamic", "latino", "gay", "straight", "bisexual", "transgender", "disabled", "deaf", "blind", "elderly"),
    ("menschen", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "afrikaner", "araber", "türken", "frauen", "männer", "schwule", "behinderte"),
    ("gens", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés", "africains", "arabes", "gitans", "femmes", "hommes", "homosexuels", "handicapés"),
    ("personas", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados", "africanos", "moros", "gitanos", "mujeres", "hombres", "homosexuales", "discapacitados"),
)
#: Labelled texts of either class that the model is fitted on, at most, and their bytes together; sentences that are written again.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 8 << 20
PAIRS = 4000
#: Buckets that words and their beginnings of these lengths fall into, and how many of them have a weight.
BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6, 7)
FEATURES = 2048
#: Weights of the penalties: of large weights, and of scores that change with the group that is named.
RIDGE = 1.0
COUNTERFACTUAL = 4.0
#: A word in so many words counts 1; so many words are added to a text's, so that very short ones aren't judged by one.
PER_WORDS = 50
_FRAME = 8
_PIECE = 1 << 20
_MEMO = 300_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_OTHERS = {name: row for row in IDENTITY for name in row[1:]}


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    slope: float
    offset: float

    def scorer(self):
        """A function from a text to its probability of being toxic."""
        memo: dict[str, float] = {}
        weights = self.weights

        def weight(word: str) -> float:
            found = memo.get(word)
            if found is None:
                found = sum(weights.get(b, 0.0) for b in buckets(word))
                if len(word) <= 64:
                    if len(memo) >= _MEMO:
                        memo.clear()
                    memo[word] = found
            return found

        def score(text: str) -> float:
            n = total = 0
            for piece in _pieces(text):
                words = _WORD.findall(piece.lower())
                n += len(words)
                total += sum(map(weight, words))
            x = self.offset + self.slope * PER_WORDS * total / (n + _FRAME)
            return 1 / (1 + exp(-min(30.0, max(-30.0, x))))

        return score


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end where a word does."""
    start = 0
    while len(text) - start > _PIECE:
        end = start + _PIECE
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):
            end += 1
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def buckets(word: str) -> list[int]:
    """Where a word and its beginnings are counted."""
    data = [word.encode("utf-8", "surrogatepass"), *(b"^" + word[:k].encode("utf-8", "surrogatepass") for k in BEGINNINGS if len(word) >= k)]
    return [zlib.crc32(d) % BUCKETS for d in data]


def _counts(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of a text, how often each is met, and the number of words."""
    words = _WORD.findall(text.lower())
    found, times = np.unique(np.array([b for w in words for b in buckets(w)], np.int64), return_counts=True)
    return found, times, len(words)


def counterfactuals(text: str) -> Iterator[tuple[str, str]]:
    """Every sentence that names a group, with all its groups changed: to the next of their row, and to the neutral name."""
    for sentence in _SENTENCE.findall(text.lower()):
        if any(w in _OTHERS for w in _WORD.findall(sentence)):
            def neutral(m):
                row = _OTHERS.get(m[0])
                return row[0] if row else m[0]

            def other(m):
                row = _OTHERS.get(m[0])
                return (row[1:] * 2)[row.index(m[0])] if row else m[0]

            yield sentence, _WORD.sub(neutral, sentence)
            yield sentence, _WORD.sub(other, sentence)


def _rates(counted, place: np.ndarray, width: int) -> np.ndarray:
    """A row a text of how often each chosen bucket is met, in PER_WORDS words."""
    out = np.zeros((len(counted), width), np.float32)
    for row, (found, times, n) in zip(out, counted):
        at = place[found]
        row[at[at >= 0]] = PER_WORDS * times[at >= 0] / (n + _FRAME)
    return out


def _weights(x: np.ndarray, y: np.ndarray, changes: np.ndarray, counterfactual: float) -> tuple[np.ndarray, float]:
    """Logistic weights by Newton steps, each solved by conjugate gradients; the rows of `changes` should score 0."""
    share = counterfactual * len(x) / max(1, len(changes))
    w, offset = np.zeros(x.shape[1]), 0.0
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        curve = p * (1 - p) + 1e-6

        def bend(v, d):
            e = curve * (x @ v + d)
            return x.T @ e + RIDGE * v + share * (changes.T @ (changes @ v)), e.sum() + 1e-3 * d

        down, down_offset = -(x.T @ (p - y) + RIDGE * w + share * (changes.T @ (changes @ w))), -(p - y).sum()
        step, step_offset = np.zeros_like(w), 0.0
        rest, rest_offset = down.copy(), down_offset
        way, way_offset, norm = rest.copy(), rest_offset, rest @ rest + rest_offset**2
        for _ in range(60):
            if norm < 1e-8:
                break
            b, b_offset = bend(way, way_offset)
            far = norm / (way @ b + way_offset * b_offset)
            step, step_offset = step + far * way, step_offset + far * way_offset
            rest, rest_offset = rest - far * b, rest_offset - far * b_offset
            new = rest @ rest + rest_offset**2
            way, way_offset, norm = rest + new / norm * way, rest_offset + new / norm * way_offset, new
        w, offset = w + step, offset + step_offset
        if np.abs(step).max(initial=0) < 1e-3:
            break
    return w, offset


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", counterfactual: float = COUNTERFACTUAL) -> Model:
    """A model from the labels (0 or 1) of documents that are not held out.

    It is fitted on a sample of SAMPLE_ROWS documents and SAMPLE_BYTES of text of either class at most, those of
    the least hash of their id (every fourth only sets the curve from scores to probabilities), and on PAIRS of
    their sentences written again; the shares of the classes are counted over all labels. Null and other labels and
    ids with both labels don't count. Without labelled text of both classes every score is the share of toxic
    labels, with one toxic and one clean label added.
    """
    ids = F.col(id_col)
    known = labels.where(F.col(label_col).isin(0, 1) & ids.isNotNull() & ~held_out(ids)).groupBy(id_col).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
    known = known.where("low = high").select(F.col(id_col).alias("id"), F.col("low").alias("y"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    prior = float(np.log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1)))
    part = [known.where(F.col("y") == y).orderBy("h", "id").limit(SAMPLE_ROWS) for y in (0, 1)]
    texts = docs.where(ids.isNotNull() & F.octet_length(text_col).between(1, SAMPLE_BYTES)).select(ids.alias("id"), F.col(text_col).alias("t"))
    texts = texts.join(F.broadcast(part[0].union(part[1])), "id")  # 2 * SAMPLE_ROWS rows at most
    upto = Window.partitionBy("y").orderBy("h", "id", "t").rowsBetween(Window.unboundedPreceding, 0)
    texts = texts.withColumn("bytes", F.sum(F.octet_length("t")).over(upto)).where(F.col("bytes") <= SAMPLE_BYTES)
    found = sorted((r["h"], r["id"], r["t"], r["y"]) for r in texts.select("h", "id", "t", "y").collect())
    return fit_sample([t for _, _, t, _ in found], [y for *_, y in found], prior, counterfactual)


def fit_sample(texts: list[str], labels: list[int], prior: float = 0.0, counterfactual: float = COUNTERFACTUAL) -> Model:
    """A model from a bounded sample; `prior` is the log of toxic texts to others among all."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({}, 0.0, prior)
    counted = [_counts(t) for t in texts]
    met = np.zeros((2, BUCKETS), np.int32)
    for (found, _, _), label in zip(counted, labels):
        met[label, found] += 1
    n = np.array([len(y) - y.sum(), y.sum()])
    share = (met + 0.5) / (n[:, None] + 1)
    pooled = met.sum(0) / n.sum()
    apart = np.where(met.sum(0) >= 3, np.abs(share[1] - share[0]) / np.sqrt(pooled * (1 - pooled) + 1e-3), 0)
    chosen = np.sort(np.argsort(-apart, kind="stable")[:FEATURES])
    chosen = chosen[apart[chosen] > 0]
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    pairs = []
    for t in texts:
        pairs.extend(counterfactuals(t))
        if len(pairs) >= PAIRS:
            break
    pairs = [(_counts(a), _counts(b)) for a, b in pairs[:PAIRS]]
    changes = _rates([a for a, _ in pairs], place, len(chosen)) - _rates([b for _, b in pairs], place, len(chosen))
    x = _rates(counted, place, len(chosen))
    last = np.zeros(len(y), bool)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        last[own[3::4]] = True
    if len(set(y[last])) < 2:  # too few to set any apart
        last[:] = True
    learn = ~last if not last.all() else last
    w, _ = _weights(x[learn], y[learn], changes, counterfactual)
    scores = x[last] @ w
    slope, offset = _logistic(scores[:, None], y[last]).tolist()
    sampled = float(np.log(y[last].sum() / (last.sum() - y[last].sum())))
    return Model(dict(zip(chosen.tolist(), w.tolist())), slope, offset + prior - sampled)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns `keep` of `docs` (all by default) and `name`: the probability that the whole text is toxic.

    Null counts as empty, and an empty text has the score of one without any weighted word. Rows stay as they are; a
    column of `docs` called `name` is replaced. Nothing but the text enters the score.
    """
    wide_rows(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])
    columns = keep if text_col in keep else [*keep, text_col]
    at = columns.index(text_col)

    def run(batches):
        of = model.scorer()
        for batch in batches:
            scores = [of(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, name])
        give_back()

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
