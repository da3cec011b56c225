import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestream.llm import queries, sharding


def test_permute_is_a_bijection():
    for n in (1, 2, 3, 4, 5, 63, 64, 65, 1000):
        got = sharding.permute(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(got) == list(range(n))


def test_matrix_has_its_margins_and_its_law(monkeypatch):
    counts, sizes = [0, 5, 40, 1, 54], [25, 25, 25, 25]
    for limit in (10**9, 0):
        monkeypatch.setattr(sharding, "_NUMPY_LIMIT", limit)
        seen = [sharding.matrix(counts, sizes, s) for s in range(3000)]
        for m in seen:
            assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes and (m >= 0).all()
        first = np.array([m[2, 0] for m in seen])  # hypergeometric(25, 75, 40)
        assert abs(first.mean() - 10) < 0.2 and abs(first.var() - 40 * 0.25 * 0.75 * 60 / 99) < 0.5
    big = [sharding.hypergeometric(np.random.default_rng(s), 10**10, 3 * 10**10, 10**6) for s in range(200)]
    assert abs(np.mean(big) - 250_000) < 150 and 300 < np.std(big) < 560


@pytest.mark.parametrize("n, shards, partitions", [(1000, 7, 5), (3, 40, 2), (0, 4, 1)])
def test_every_row_once_and_sizes_exact(spark, n, shards, partitions):
    rng = random.Random(n)
    rows = [(rng.choice([None, 1, 2, i]), rng.choice([None, "", "é" * i, "same"]), i, "old") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int, shard string").repartition(partitions)
    out = sharding.shuffle_into_shards(df, shards, seed=4)
    assert out.columns == ["doc_id", "text", "at", "shard", "slot"]
    got = out.collect()
    assert Counter((r.doc_id, r.text, r["at"]) for r in got) == Counter(r[:3] for r in rows)
    sizes = Counter(r.shard for r in got)
    assert all(sizes[j] in (n // shards, -(-n // shards)) for j in range(shards)) and sum(sizes.values()) == n
    for j in sizes:
        assert sorted(r.slot for r in got if r.shard == j) == list(range(sizes[j]))
    assert sorted(map(str, sharding.shuffle_into_shards(df, shards, seed=4).collect())) == sorted(map(str, got))


def test_uniform(spark):
    df = spark.range(0, 8000, 1, 4)
    got = sharding.shuffle_into_shards(df, 8, seed=1).collect()
    seen = Counter((r.id // 1000, r.shard) for r in got)  # neighbours in the input spread evenly
    chi = sum((seen[(a, b)] - 125) ** 2 / 125 for a in range(8) for b in range(8))
    assert chi < 95  # 49 degrees of freedom
    assert abs(np.corrcoef([r.id for r in got], [r.slot for r in got])[0, 1]) < 0.05


def test_query_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", "x"), (None, None, "x"), (2, "a" * 100_000, "x")], "doc_id long, text string, law string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.queries()["op10_sharding"](spark, str(tmp_path)).collect()}
    assert (got[1]["size"], got[1].text_crc32, got[1].law, got[1].grown_shard) == (18, zlib.crc32("é".encode()), "rows", None)
    assert (got[None]["size"], got[None].text_crc32) == (16, 0)
    assert got[2]["size"] == 100_016
