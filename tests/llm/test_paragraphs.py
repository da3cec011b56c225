import random
import re

import numpy as np
import pytest

from lodestream.llm import paragraphs

COLUMNS = "doc_id long, text string, words string, start int"


def texts(rng, n, vocabulary=10**6):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed=4):
    """Documents that share passages, mid-line, wrapped and edited; a large group of near copies; repeated rows."""
    rng = random.Random(seed)
    shared = [texts(rng, 60) for _ in range(6)]
    docs = []
    for i in range(80):
        parts = [texts(rng, rng.choice([1, 5, 25, 70])) for _ in range(rng.randrange(4))]
        if rng.random() < 0.6:
            w = rng.choice(shared).split()
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = "Edited"
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([" ", "\n", " \té "]).join(w))
        docs.append((i, rng.choice([" ", "\n", "\r\n\r\n"]).join(parts)))
    for i in range(60):
        w = shared[0].split()
        w[i] = f"v{i}"
        docs.append((100 + i, "own short line\n" + " ".join(w)))
    long = texts(rng, 30_000)
    more = [(None, shared[1]), (900, None), (901, ""), (902, long), (903, "x\n" + long.upper()), (904, "la " * 700), (905, "so " + "la " * 900)]
    return docs + more + [docs[0], docs[0], (0, shared[2]), (None, None), (None, shared[1])]


def spans_by_brute_force(docs, similarity=0.8, size=5, min_words=20):
    """(doc_id, start, length, n_words, removed) of every span, from the rules and not from the plan."""
    units = {}  # (no_id, id, text, unit): (first, last)
    words, chars = {}, {}
    for i, text in docs:
        if text is None:
            continue
        data = text.encode()
        cut = paragraphs._Cut(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        key = (i is None, -1 if i is None else i, paragraphs_version(text), text)
        words[key] = data.lower().split()
        chars[key] = [m.span() for m in re.finditer(r"[^ \t\n\r\x0b\f]+", text)]
        assert len(words[key]) == len(chars[key]) == len(cut.hashes)
        for n, (a, b) in enumerate(zip(cut.first[:-1].tolist(), cut.first[1:].tolist())):
            units[(*key, n)] = (a, b)
    keys = sorted(units)
    sets = {}
    for k in keys:
        a, b = units[k]
        w = words[k[:4]][a:b]
        sets.setdefault(frozenset(b" ".join(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if len(w) >= size else frozenset([b" ".join(w)]), []).append(k)
    distinct = list(sets)
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(distinct):
        for j in {j for g in s for j in holders.get(g, ())}:
            if len(s & distinct[j]) >= similarity * len(s | distinct[j]):
                parent[root(i)] = root(j)
        for g in s:
            holders.setdefault(g, []).append(i)
    classes = {}
    for i, s in enumerate(distinct):
        classes.setdefault(root(i), []).extend(sets[s])
    of, removed = {}, {}
    for group in classes.values():
        group.sort()
        for k in group if len(group) > 1 else ():
            removed[k] = k != group[0]
            of[k] = group[0] if removed[k] else group[-1]
    out = set()
    for key in words:
        own = sorted(k for k in removed if k[:4] == key)
        runs = []
        for k in own:
            if runs and runs[-1][-1][4] + 1 == k[4] and removed[runs[-1][-1]] == removed[k]:
                runs[-1].append(k)
            else:
                runs.append([k])
        runs = [trimmed(run, lambda k: words[key][slice(*units[k])] == words[of[k][:4]][slice(*units[of[k]])]) for run in runs]
        grown = []
        for r, run in enumerate(runs):
            a, b = units[run[0]][0], units[run[-1]][1]
            left, right = of[run[0]], of[run[-1]]
            least = units[runs[r - 1][-1]][1] if r else 0
            most = units[runs[r + 1][0]][0] if r + 1 < len(runs) else len(words[key])
            x, y = units[left][0], units[right][1]
            # beyond the adjoining paragraph, its own and that of the text it is matched with, by REACH + 2 words at most
            least = max(least, a - min(adjoining(units, k, -1) for k in (run[0], left)))
            most = min(most, b + min(adjoining(units, k, 1) for k in (run[-1], right)))
            while a > least and x > 0 and words[key][a - 1] == words[left[:4]][x - 1]:
                a, x = a - 1, x - 1
            while b < most and y < len(words[right[:4]]) and words[key][b] == words[right[:4]][y]:
                b, y = b + 1, y + 1
            grown.append((a, b, removed[run[0]]))
        for flag in (True, False):
            joined = []
            for a, b, f in grown:
                if f == flag:
                    if joined and a - joined[-1][1] <= paragraphs.GAP:
                        joined[-1][1] = b
                    else:
                        joined.append([a, b])
            for a, b in joined:
                if b - a >= min_words:
                    lo, hi = chars[key][a][0], chars[key][b - 1][1]
                    out.add((None if key[0] else key[1], lo, hi - lo, b - a, flag))
    return out


def adjoining(units, key, step):
    a, b = units.get((*key[:4], key[4] + step), (0, 0))
    return b - a + paragraphs.REACH + 2


def trimmed(run, same):
    exact = [j for j, k in enumerate(run) if same(k)]
    return run[exact[0] : exact[-1] + 1] if exact else run


VERSIONS: dict[str, int] = {}


def paragraphs_version(text):
    return VERSIONS[text]


@pytest.mark.parametrize("large", [512, 16])
def test_spans_as_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(paragraphs, "LARGE_BUCKET", large)
    monkeypatch.setattr(paragraphs, "SAMPLE", 2)
    monkeypatch.setattr(paragraphs, "RECALL", 1 - 1e-9)
    docs = documents()
    df = spark.createDataFrame([(*r, "e", 3) for r in docs], COLUMNS).repartition(4)
    VERSIONS.update({r.text: r.v for r in df.selectExpr("text", "xxhash64(text) v").collect()})
    found = paragraphs.repeated(df).collect()
    got = {(r.doc_id, r.start, r.length, r.n_words, r.removed) for r in found}
    assert len(found) == len({(r.doc_id, r.version, r.start, r.removed) for r in found})
    want = spans_by_brute_force(docs)
    assert got == want and len(want) > 100


def test_cuts_depend_on_content_only():
    rng = random.Random(8)
    whole = 0
    for n in (51, 55, 60, 80) * 50:
        p = texts(rng, n, 5000)
        cuts = []
        for around in range(2):
            data = f"{texts(rng, 40 + around, 5000)}\n{p}\t{texts(rng, 30, 5000)}".encode()
            cut = paragraphs._Cut(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            inside = {a - 40 - around for a in cut.first.tolist() if 0 <= a - 40 - around <= n}
            cuts.append({a for a in inside if paragraphs.REACH <= a < n - paragraphs.REACH - 1})
            assert (np.diff(cut.first) >= paragraphs.REACH).all()
        assert cuts[0] == cuts[1]
        whole += len(cuts[0]) > 1
    assert whole >= 0.97 * 200


def test_equal_words_have_equal_digests():
    rows = ["The quick fox", "the  QUICK\n\tfox\r", "fox quick the", "", "İ É", "ı é", "la " * 2000]
    data = [r.encode() for r in rows]
    offsets = np.cumsum([0, *map(len, data)])
    cut = paragraphs._Cut(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert [b - a for a, b in zip(cut.of_text[:-1], cut.of_text[1:])] == [len(d.split()) for d in data]
    digests = dict(zip(cut.text.tolist()[:5], cut.digests().tolist()[:5]))
    assert digests[0] == digests[1] and len(set(digests.values())) == len(digests) - 1
    assert np.diff(cut.first).max() <= paragraphs.LONGEST


@pytest.mark.parametrize("break_", [" ", "\n"])
def test_planted_passages(spark, break_):
    rng = random.Random(5)
    rows, clean = [], []
    for i in range(300):
        n = rng.randrange(51, 90)
        p = break_.join(texts(rng, n).split())
        for j in range(2):
            rows.append((10 * i + j, f"{texts(rng, 60)}, {p} {texts(rng, 90)}", n))
        clean.append((10 * i + 5, texts(rng, 150), 0))
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string, n int")
    found = {r.doc_id: r for r in paragraphs.repeated(docs).collect()}
    removed = {i for i, r in found.items() if r.removed}
    exact = [found[i].n_words == n for i, _, n in rows if i in found]
    assert sum(exact) >= 0.98 * len(exact) and len(removed) >= 0.98 * 300
    assert not {i for i, _, _ in clean} & set(found)
    out = {r.doc_id: r.text for r in paragraphs.remove(docs, paragraphs.repeated(docs)).collect()}
    for i, text, _ in rows + clean:
        if i not in removed:
            assert out[i] == text
        else:
            assert out[i] == text[: found[i].start] + text[found[i].start + found[i].length :]


def test_edited_paragraph_goes_whole(spark):
    rng = random.Random(6)
    p = texts(rng, 120).split()
    q = p[:40] + ["Edited"] + p[41:80] + ["x", "y"] + p[80:]
    docs = spark.createDataFrame([(1, " ".join([texts(rng, 50), *p, texts(rng, 20)])), (2, "\n".join(q) + " " + texts(rng, 50))], "doc_id long, text string")
    found = [r for r in paragraphs.repeated(docs).collect() if r.removed]
    assert [(r.doc_id, r.class_id, r.start, r.n_words) for r in found] == [(2, 1, 0, 122)]


def test_remove(spark):
    p, q = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, f"head\n{p}\ntail"), (2, p), (3, f"{q}\n{p}\n{q}"), (4, None), (5, ""), (6, "short"), (None, p.upper()), (7, f"x\r\n{q}\r\ny"), (6, "short")]
    docs = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, start string")
    out = {r.doc_id: r.text for r in paragraphs.remove(docs, paragraphs.repeated(docs)).collect()}
    assert {i: None if t is None else t.split() for i, t in out.items()} == {1: f"head {p} tail".split(), 3: q.split(), 4: None, 5: [], 6: ["short"], 7: ["x", "y"]}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert paragraphs.repeated(docs).collect() == []
    nulls = spark.createDataFrame([(None, None), (1, None), (1, " \n")], "doc_id long, text string")
    found = paragraphs.repeated(nulls)
    assert found.collect() == [] and paragraphs.remove(nulls, found).count() == 3
    assert paragraphs.bands(0.8) == 11 and paragraphs.bands(0.8, 0.99, 2) == 5


@pytest.mark.parametrize("few", [0, 4])
def test_linked_as_brute_force(monkeypatch, few):
    monkeypatch.setattr(paragraphs, "FEW", few)
    rng = random.Random(3)
    for trial in range(200):
        base = list(range(rng.randrange(3, 14)))
        sets = [{rng.choice([g, g, g, g, g, g, 50 + rng.randrange(9)]) for g in base[: rng.randrange(1, len(base) + 1)]} for _ in range(rng.randrange(1, 25))]

        def classes(links):
            group = list(range(len(sets)))
            for i, j in links:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
            return {frozenset(i for i in range(len(sets)) if group[i] == g) for g in group}

        links = list(paragraphs._linked(sets, 0.8))
        assert len(links) < len(sets) or not sets
        every = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        assert classes(links) == classes(every)
