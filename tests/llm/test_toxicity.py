import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import queries, toxicity

BAD = ["vile", "filthy", "scumbag", "rotten"]


def words(rng, n):
    return ["".join(rng.choices(["ta", "ri", "mon", "el", "qu", "ver"], k=rng.randrange(1, 4))) for _ in range(n)]


def sentence(rng, group=None, bad=False):
    out = words(rng, 14)
    if group:
        out.insert(rng.randrange(len(out)), group)
    if bad:
        out.insert(rng.randrange(len(out)), rng.choice(BAD))
    return " ".join(out) + "."


def corpus(n=600, seed=4):
    """Toxic texts name a group in nearly every case, clean ones seldom: a learner's trap."""
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        group = rng.choice(["muslims", "women", "immigrants"]) if rng.random() < (0.9 if toxic else 0.03) else None
        texts.append(" ".join([sentence(rng, group, toxic), *(sentence(rng) for _ in range(rng.randrange(3)))]))
        labels.append(int(toxic))
    return texts, labels


def test_group_names_stop_counting():
    texts, labels = corpus()
    rng = random.Random(5)
    neutral = [sentence(rng, g) for g in ("muslims", "women", "immigrants") for _ in range(60)]
    hateful = [sentence(rng, g, True) for g in ("muslims", "women", None) for _ in range(60)]
    flagged = {}
    for strength in (0.0, toxicity.COUNTERFACTUAL):
        of = toxicity.fit_sample(texts, labels, math.log(1 / 2), strength).scorer()
        flagged[strength] = [np.mean([of(t) >= 0.5 for t in part]) for part in (neutral, hateful)]
        swapped = [abs(of(t) - of(t.replace("muslims", "people"))) for t in neutral[:60]]
        flagged[strength].append(np.mean(swapped))
    plain, fair = flagged[0.0], flagged[toxicity.COUNTERFACTUAL]
    assert plain[0] > 0.3  # without the penalty neutral mentions are taken for toxic
    assert fair[0] < 0.05 and fair[1] > 0.95
    assert fair[2] < plain[2] / 5


def test_counterfactuals():
    got = list(toxicity.counterfactuals("Women sing. Nobody else! The WOMEN and jews,\nblack cats"))
    assert got == [
        ("women sing", "people sing"), ("women sing", "men sing"),
        (" the women and jews,", " the people and people,"), (" the women and jews,", " the men and hindus,"),
        ("black cats", "ordinary cats"), ("black cats", "white cats"),
    ]
    assert sum(map(len, toxicity.IDENTITY)) < 200 and all(len(set(row)) == len(row) for row in toxicity.IDENTITY)


def test_weights_are_the_optimum():
    rng = np.random.default_rng(1)
    x, d = rng.normal(size=(80, 5)).astype(np.float32), rng.normal(size=(7, 5)).astype(np.float32)
    y = (rng.random(80) < 0.4).astype(float)
    w, b = toxicity._weights(x, y, d, 3.0)

    def loss(w, b):
        z = x @ w + b
        return (np.logaddexp(0, z) - y * z).sum() + toxicity.RIDGE * (w @ w) / 2 + 3.0 * 80 / 7 * ((d @ w) ** 2).sum() / 2

    for k in range(6):
        for e in (1e-2, -1e-2):
            v, c = w.copy(), b
            if k < 5:
                v[k] += e
            else:
                c += e
            assert loss(v, c) > loss(w, b) - 1e-4


def write(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")


def test_held_out_accuracy_and_edge_cases(spark, tmp_path):
    texts, labels = corpus(900, 6)
    docs = [(i, t, "src") for i, t in enumerate(texts)]
    edge = [(1000, None, "s"), (1001, "", "s"), (None, "vile vile", "s"), (1002, "long text " * 200_000, "s"), docs[0], docs[0], (1003, "x" * 3_000_000, "s")]
    marks = list(enumerate(labels)) + [(1, None), (2, 7), (None, 1), (5000, 1), (9, labels[9]), (10, 1), (10, 0)]
    write(spark, tmp_path, docs + edge, marks)
    got = queries.queries()["op12_toxicity"](spark, str(tmp_path)).collect()
    assert len(got) == len(docs) + len(edge)
    right = []
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is None:
            assert r.held_out and r.predicted == 1
            continue
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id < 900:
            right.append(r.predicted == labels[r.doc_id])
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    assert {r.predicted for r in got if r.doc_id in (1000, 1001, 1002, 1003)} == {0}


def test_whole_texts_count_wherever_pieces_end(monkeypatch):
    model = toxicity.Model({toxicity.buckets("vile")[0]: 1.0}, 1.0, 0.0)
    text = "une vile chose " * 50
    whole = model.scorer()(text)
    for piece in (1, 2, 7, 16):
        monkeypatch.setattr(toxicity, "_PIECE", piece)
        assert "".join(toxicity._pieces(text)) == text
        assert model.scorer()(text) == pytest.approx(whole)


def test_labels_of_held_out_documents_do_not_matter(spark):
    texts, labels = corpus(200)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flipped = [1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y for i, y in enumerate(labels)]
    models = [toxicity.fit(d, spark.createDataFrame(list(enumerate(x)), "doc_id long, toxic int")) for x in (labels, flipped)]
    assert models[0] == models[1]


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(d, none).collect()] == [0.5, 0.5]
    one = toxicity.fit(d, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert all(r.score > 0.5 for r in toxicity.score(d, one).collect())
    assert toxicity.score(d.limit(0), none).collect() == []
    two = d.union(spark.createDataFrame([(3, "b b b")], d.schema))
    few = toxicity.fit(two, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int"))
    assert toxicity.score(two, few).where(F.col("score").isNull()).count() == 0
