import hashlib
import random
import zlib

import pytest

from lodestream.llm import merkle, queries


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def coded(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    """All levels of a tree, from the leaves to one node."""
    out = [nodes]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([h("".join(now[k : k + 8])) for k in range(0, len(now), 8)])
    return out


def siblings(tree, at):
    """Per level the digests before and after the node of the path."""
    out = []
    for nodes in tree[:-1]:
        first = at - at % 8
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])))
        at //= 8
    return out


def brute_force(docs):
    """docs: (doc_id, source, lang, n_chars, text). Rows of the contract, found with whole trees in memory."""
    by = {}
    for d in docs:
        by.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, coded(d), d))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([leaf for _, _, leaf, _ in sorted(by[x], key=lambda e: e[:3])]) for x in names}
    over = levels([trees[x][-1][0] for x in names]) if names else []
    out = []
    for k, x in enumerate(names):
        for at, (_, _, leaf, d) in enumerate(sorted(by[x], key=lambda e: e[:3])):
            path = siblings(trees[x], at) + siblings(over, k)
            node = leaf
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 and d[4] is not None:
                node = coded((*d[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4])))
            for a, b in path:
                node = h(a + node + b)
            proof = h("".join(a + b for a, b in path))
            out.append((d[0], leaf, trees[x][-1][0], over[-1][0], proof, node, node == over[-1][0]))
    return out


@pytest.mark.parametrize("n, height, band", [(1, 0, 2), (1, 2, 2), (7, 1, 1), (64, 2, 1), (65, 3, 2), (300, 3, 1), (300, 4, 3), (600, 4, 2)])
def test_traversal_gives_every_path(n, height, band):
    leaves = [h(str(i)) for i in range(n)]
    tree = levels(leaves)
    while len(tree) <= height:  # a block has the levels of its tree, even where it has one node on a level
        tree.append([h("".join(tree[-1]))])
    paths = list(merkle.traverse(leaves.__getitem__, n, height, band))
    assert paths == [siblings(tree, at) for at in range(n)]
    assert {merkle.fold(x, p) for x, p in zip(leaves, paths)} == {tree[-1][0]} == {merkle.block_root(leaves, height)}


def test_traversal_holds_few_nodes():
    subtree, most = merkle.Subtree(2, 4), 0
    for i in range(4096):
        subtree.push(h(str(i)))
        most = max(most, sum(map(len, subtree.open)))
    assert sum(map(len, subtree.nodes)) == 64 + 8 + 1 and most <= 8 * 4


def documents():
    rng = random.Random(13)
    docs = [(i, rng.choice(["a", None]), "en", rng.choice([None, i]), rng.choice([None, "", f"Text {i}", f"É ÄB {i}"])) for i in range(700)]
    docs += [(i, "s", lang, 3, "Ab:c") for i, lang in enumerate([None, "", "de", "dE", "é", "z", "zz", "zzz", "y", "x"], 1000)]  # more than 8 parts
    docs += [(i, "s", "fr", 3, "low") for i in range(8)] + [(5, "s", "es", 3, "Tie"), (5, "t", "es", 3, "Tie"), (5, "s", "es", 3, "Tie"), (None, "s", "es", 3, "No id")]
    docs.append((9999, "s", "es", 3, "Long " * 200_000))
    return docs


@pytest.mark.parametrize("block_levels", [4, 1])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, block_levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", block_levels)
    docs = documents()
    clash = [(*d, "old", 1) for d in docs]
    schema = "doc_id long, source string, lang string, n_chars long, text string, root string, rank int"
    spark.createDataFrame(clash, schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op13_merkle_manifest"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(brute_force(docs), key=repr)
    assert {r[-1] for r in rows} == {True, False}


def test_one_row_and_none(spark, tmp_path):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    for name, docs in (("one", [(3, "s", None, None, "Abc")]), ("none", [])):
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = queries.queries()["op13_merkle_manifest"](spark, f"{tmp_path}/{name}").collect()
        assert [tuple(r) for r in got] == brute_force(docs)
