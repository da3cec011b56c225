import random
import re

import pytest
from pyspark.sql import functions as F

from lodestream.llm import decontaminate


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items, size):
    wins = {}
    for i, t in items:
        w = split(t)
        if w and i is not None:
            wins.setdefault(str(i), set()).update(tuple(w[s : s + size]) for s in range(max(1, len(w) - size + 1)))
    out = []
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for item, ps in wins.items():
            for p in ps:
                for s in range(len(w) - len(p) + 1):
                    if tuple(w[s : s + len(p)]) == p:
                        hit |= set(range(s, s + len(p)))
                        found.add(item)
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(map(str, out))


def tables():
    rng = random.Random(2)
    common = ["the", "of", "Été", "ÀB", "x1", "and", "K", "ΑΣ"]
    items = [(i, " ".join(rng.choices(common, k=rng.choice([1, 2, 4, 9, 14])) + [f"r{i}"] * rng.randrange(2))) for i in range(30)]
    items += [(None, "null id here"), (3, "THE of and the OF the"), (40, None), (41, ""), (42, "..."), (43, "absent word x1")]
    docs = []
    for i in range(60):
        w = rng.choices(common + ["filler", "noise"], k=rng.choice([0, 3, 40, 120]))
        if rng.random() < 0.6:
            w[rng.randrange(len(w) + 1) : 0] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice([" ", "\n", ", ", "-"]).join(w)))
    docs += [(None, "r1 the of"), (5, None), (5, ""), docs[3], docs[3], (99, "the of and " * 20_000), (98, "ends with ΑΣ.x1")]
    return docs, items


@pytest.mark.parametrize("size, at_once, small", [(4, 20_000, 200_000), (3, 2, 0)])
def test_as_brute_force(spark, monkeypatch, size, at_once, small):
    monkeypatch.setattr(decontaminate, "WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", small)
    docs, items = tables()
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, row int, items string")
    t = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, n_words int")
    got = decontaminate.contamination(d, t, size)
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated)) for r in got.collect()) == brute(docs, items, size)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    t = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contamination(d, t).collect()] == [(1, 2, 0, 0, [], False)]
    assert decontaminate.contamination(d.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def test_proximity(spark):
    d = spark.createDataFrame([(1, "rare one two"), (2, "two x x one x rare"), (3, "rare x x x x x one two"), (4, "one two")], "doc_id long, text string")
    t = spark.createDataFrame([(7, "one rare two")], "item_id long, text string")
    got = decontaminate.near_matches(d, t, size=3, within=5).collect()
    assert sorted(map(tuple, got)) == [(1, "7", 0), (2, "7", 5)]


def test_rows_of_changing_partitions_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "WORDS_AT_ONCE", 3)
    rng = random.Random(9)
    items = [(i, " ".join(f"b{rng.randrange(5000)}" for _ in range(14))) for i in range(12)]
    docs = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(30)) + " " + " ".join(items[i % 12][1].split()[2:13]) * (i % 2)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").orderBy(F.rand())  # another order whenever it is read
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r["items"] for r in got} == {i: [str(i % 12)] * (i % 2) for i, _ in docs}
