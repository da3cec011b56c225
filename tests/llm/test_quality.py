import random
import zlib

from lodestream.llm import quality, queries
from pyspark.sql import functions as F


def corpus():
    rng = random.Random(9)
    syllables = ["ta", "ri", "mon", "el", "qu", "ver", "the", "of"]
    docs, labels = [], []
    for i in range(400):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.choice([3, 40, 300]))]
        good = i % 4 > 0
        docs.append((i, (" " if good else rng.choice([" | ", "%%% ", "$$$ "])).join(words), "src"))
        labels.append((i, int(good)))
    return docs, labels


def write(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")


def test_held_out_accuracy_and_edge_cases(spark, tmp_path):
    docs, labels = corpus()
    edge = [(1000, None, "s"), (1001, "", "s"), (None, "the of", "s"), (1002, "long text " * 100_000, "s"), docs[0], docs[0]]
    marks = [(1, None), (2, 7), (None, 1), (5000, 1), labels[8], (3, 0)]
    write(spark, tmp_path, docs + edge, labels + marks)
    got = queries.queries()["op8_quality"](spark, str(tmp_path)).collect()
    assert len(got) == len(docs) + len(edge)
    truth = dict(labels)
    right = []
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is None:
            assert r.held_out
            continue
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id])
    assert sum(right) / len(right) > 0.93
    assert len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1


def test_labels_of_held_out_documents_do_not_matter(spark, tmp_path):
    docs, labels = corpus()
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    d = spark.createDataFrame([r[:2] for r in docs], "doc_id long, text string")
    models = [quality.fit(d, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped)]
    assert models[0] == models[1]


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = quality.fit(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score(d, none).collect()] == [0.5, 0.5]
    one = quality.fit(d, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert all(r.score > 0.5 for r in quality.score(d, one).collect())
    assert quality.score(d.limit(0), none).collect() == []
    few = quality.fit(d.union(spark.createDataFrame([(3, "b b b")], d.schema)), spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))
    assert quality.score(d, few).where(F.col("score").isNull()).count() == 0
