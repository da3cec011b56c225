import random

import pytest
import xxhash

from lodestream.llm import simhash
from pyspark.sql import functions as F


def brute_fingerprint(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low:
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[root(i)] = root(j)
    out = []
    for i in range(len(ids)):
        own = [ids[j] for j in range(len(ids)) if root(j) == root(i) and ids[j] is not None]
        out.append(min(own, default=None))
    return out


def texts(seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "éclair", "Éclair", "x y", "the", "of", "1"]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 3, 4, 5, 60, 300]))) for _ in range(40)]
    out = list(base)
    for t in base:
        for _ in range(3):
            w = t.split(" ")
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(rng.choice([" ", "\n", "\t\x0b"]).join(w))
    return out + [None, "", " \n", "A", "a", "word " * 70000]


def test_near_duplicates_as_brute_force(spark):
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts(1))]
    rows += [rows[7], (3, "a repeated id with other text"), (None, "only null ids here, in one group of their own")]
    docs = spark.createDataFrame([(a, b, "z", 9) for a, b in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs, 4, 4).select("doc_id", simhash.fingerprint_text(F.col("fp")), "component_id").collect()
    fps = [brute_fingerprint(t, 4) for _, t in rows]
    comp = brute_components([i for i, _ in rows], fps, 4)
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comp)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("radius, large", [(3, 1024), (4, 8), (8, 64)])
def test_links_keep_every_component(spark, monkeypatch, radius, large):
    monkeypatch.setattr(simhash, "LARGE_NODE", large)
    rng = random.Random(radius)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            f = centre
            for b in rng.sample(range(64), rng.randrange(radius + 3)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius).collect()
    where = {f: i for i, f in enumerate(signed)}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[root(where[a])] = root(where[b])
    got = {}
    for i in range(len(fps)):
        got.setdefault(root(i), set()).add(i)
    want = {}
    for i, c in enumerate(brute_components(list(range(len(fps))), fps, radius)):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def test_masks_cover_every_difference():
    for n in (10, 10**6, 10**10):
        for radius in (0, 2, 4):
            found = simhash.masks(n, radius)
            rng = random.Random(n + radius)
            for _ in range(200):
                x = sum(1 << b for b in rng.sample(range(64), radius))
                assert any(x & m == 0 for m in found)


def test_deduplicate_keeps_one_of_each_verified_class(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows, base = [], [" ".join(rng.choices(words, k=rng.choice([3, 60, 400]))) for _ in range(30)]
    for i in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 30])):
            w[rng.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w)))
    rows += [(None, base[0]), (200, None), (201, ""), (3, "a repeated id"), rows[5], rows[5], (None, "alone without id"), (None, "alone without id")]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, fp string, root int")
    out = simhash.deduplicate(df)
    assert out.dtypes == df.dtypes
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(set(got))

    def sh(t):
        w = (t or "").split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    unique = sorted(set(rows), key=str)
    sets = [sh(t) for _, t in unique]
    parent = list(range(len(unique)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(unique)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    classes = {}
    for i, r in enumerate(unique):
        classes.setdefault(root(i), []).append(r)
    kept = {c: [r for r in members if r in got] for c, members in classes.items()}
    assert all(kept.values())  # no class is lost, and nearly every class keeps just one
    assert len(got) <= len(classes) + 3
    exact = [c for c, m in classes.items() if len({sh_t for sh_t in map(str, (t for _, t in m))}) == 1]
    assert all(len(kept[c]) == 1 for c in exact)


def test_deduplicate_verifies_texts_of_one_fingerprint(spark):
    rng = random.Random(3)
    rows = [(i, "- " * 400 + " ".join(f"t{i}x{rng.random()}" for _ in range(300))) for i in range(6)]
    rows += [(10 + i, t.upper()) for i, t in rows[:2]]
    assert len({simhash.fingerprint(t.encode(), 2) for _, t in rows}) == 1
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == list(range(6))


def edited_pairs(each=60):
    """(kind, text, edited text) with 5-word similarity of 0.8 or more, by kind of edit and length."""
    rng = random.Random(21)
    out = []
    for n in (8, 12, 50, 400):
        for kind in ("appended", "cut", "prepended", "replaced"):
            for _ in range(each):
                w = [f"w{rng.randrange(5000)}" for _ in range(n)]
                k = max(1, (n - 4) // 5 if kind in ("appended", "prepended") else (n - 4) // 6)
                block = [f"new{rng.randrange(5000)}" for _ in range(k)]
                if kind == "replaced":
                    at = rng.randrange(n)
                    e = w[:at] + ["edited"] + w[at + 1 :]
                else:
                    e = {"appended": w + block, "cut": w[:-k], "prepended": block + w}[kind]
                a, b = ({" ".join(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (w, e))
                if len(a & b) >= 0.8 * len(a | b):
                    out.append((f"{kind}, {n} words", " ".join(w), " ".join(e)))
    return out


def test_deduplicate_recall_by_edit_and_length(spark):
    pairs = edited_pairs()
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p[1:])]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * i in kept for i in range(len(pairs)))
    found = {}
    for i, (kind, *_) in enumerate(pairs):
        found.setdefault(kind, []).append(2 * i + 1 not in kept)
    print({k: f"{sum(v)} of {len(v)}" for k, v in found.items()})
    assert len(found) >= 12 and all(sum(v) >= 0.95 * len(v) for v in found.values())
