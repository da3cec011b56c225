import random

import corpus_pipeline
from lodestream.llm import quality, shared
from test_decontaminate import brute as brute_contamination
from test_packing import check as check_pieces
from test_paragraphs import VERSIONS, spans_by_brute_force


def corpus():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(2000)]

    def line(n):
        return " ".join(rng.choices(words, k=n))

    shared_line, item = line(60), line(25)
    docs, labels = [], []
    for i in range(160):
        lines = [line(rng.choice([4, 30, 60])) for _ in range(rng.randrange(1, 6))]
        bad = i % 5 == 0
        if i % 7 == 0:
            lines.append(shared_line)
        if i % 11 == 0:
            lines.append(line(6) + " " + " ".join(item.upper().split()[5:17]))
        text = "\n".join(lines)
        docs.append((i, text.replace(" ", "%%% ") if bad else text, "en", "s", len(text)))
        labels.append((i, int(not bad), 0))
    docs += [(200 + i, docs[i][1], "en", "s", 1) for i in range(1, 30)]  # exact copies
    near = docs[2][1].split(" ")
    if len(near) > 100:
        near[50] = "edited"
    docs += [(300, " ".join(near), "en", "s", 1), (301, None, None, None, None), (302, "", "en", "s", 0), (None, "short", "en", "s", 5), docs[3], docs[3]]
    return docs, labels, [(0, item), (1, None)]


def test_stages_as_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.dtypes == now.dtypes
        before, now = now, shared.store(out, name)
        kept[name] = [(r.doc_id, r.text) for r in now.collect()] if name != "packing" else now.collect()
        if name == "quality":
            score = quality.fit(before, spark.read.parquet(f"{tmp_path}/labels.parquet")).scorer()
            assert sorted(map(str, kept[name])) == sorted(str((i, t)) for i, t, *_ in docs if score((t or "").encode()) >= 0.3)
            assert sum("%%%" in (t or "") for _, t in kept[name]) <= 6 and len(kept[name]) > 150
    texts = [t for _, t in kept["near_dedup"]]
    assert sorted({t or "" for t in texts} | {t for i, t in kept["quality"] if i == 300}) == sorted({t or "" for _, t in kept["quality"]})
    assert len(texts) == len({t or "" for t in texts}) and len(texts) < len(kept["quality"]) - 25
    VERSIONS.update({r.text: r.v for r in spark.createDataFrame(kept["near_dedup"], "i long, text string").selectExpr("text", "xxhash64(text) v").collect()})
    removed = {}
    for i, start, length, _, gone in spans_by_brute_force(kept["near_dedup"]):
        if gone:
            removed.setdefault(i, []).append((start, start + length))
    assert len(removed) > 10

    def rest(i, text):
        for a, b in sorted(removed.get(i, ()), reverse=True):
            text = text[:a] + text[b:]
        return text

    want = [(i, rest(i, t)) for i, t in kept["near_dedup"]]
    assert sorted(map(str, kept["substring_dedup"])) == sorted(str(r) for r in want if r[0] not in removed or r[1].strip())
    clean = [r for r in kept["substring_dedup"] if brute_contamination([r], items, 10)[0].endswith("False)")]
    assert len(kept["substring_dedup"]) > len(clean) > 80
    assert sorted(map(str, kept["decontamination"])) == sorted(map(str, clean))
    assert check_pieces(kept["packing"], kept["decontamination"], 2048) < 0.05
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in whole) == sum(r.length for r in kept["packing"])


CLASHES = ["score", "id", "t", "y", "h", "fp", "version", "component_id", "row", "start", "length", "part", "key", "x", "w", "n_words", "gone", "value", "unit", "__lodestream_id2"]


def tables(spark, path, docs, labels, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    spark.createDataFrame([(*d, *CLASHES) for d in docs], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, score string").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, doc_id string").write.parquet(f"{path}/benchmark.parquet")


def test_columns_with_clashing_names_stay(spark, tmp_path):
    docs, labels, items = corpus()
    tables(spark, tmp_path, docs[:60] + docs[160:170] + docs[-6:], labels, items)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [now.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, shared.store(stage(spark, now, str(tmp_path)), name)
        counts.append(now.count())
        if name != "packing":
            assert now.dtypes == before.dtypes
            assert all(tuple(r) == tuple(CLASHES) for r in now.select(*CLASHES).distinct().collect())
    assert counts[0] > counts[1] > counts[2] and counts[4] > 20 and counts[5] >= counts[4] - 3


def test_empty_tables(spark, tmp_path):
    docs, labels, items = corpus()
    tables(spark, f"{tmp_path}/all", [], [], [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/all").collect() == []
    tables(spark, f"{tmp_path}/docs", docs[1:5], [], [])
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/docs").collect()} == {1, 2, 3, 4}
