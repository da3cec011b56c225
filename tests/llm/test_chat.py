import random

from lodestream.llm import chat


def brute(rows):
    convs = {}
    for c, t, r, x in set((c, t, r or "", x or "") for c, t, r, x in rows):
        convs.setdefault(c, []).append((t is not None, t or 0, r, x))
    lists = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    out = []
    groups = {}
    for c, v in lists.items():
        groups.setdefault(tuple(v), []).append(c)
    for v, ids in groups.items():
        if not any(len(o) > len(v) and o[: len(v)] == v for o in groups):
            text = "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v)
            out.append((min((i for i in ids if i is not None), default=None), len(v), len(ids), text))
    return sorted(map(str, out))


def test_maximal_conversations_as_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for c in range(60):
        base = [("user", "hi"), ("assistant", rng.choice("ab")), ("user", rng.choice("xy")), ("assistant", "é" * 50_000), ("user", "z")]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(base[: rng.randrange(1, 6)])]
    rows += [(None, 0, "user", "hi"), (None, None, "system", "s"), (100, None, None, None), (101, 0, "", ""), (102, 5, "user", "tie"), (102, 5, "user", "tie"), (102, 5, "assistant", "tie")]
    rows += [(103, 0, "userhi", ""), (104, 0, "user", "hi"), (104, 9, "b", "a"), (105, -1, "user", "hi")] + rows[:3]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n int").repartition(3)
    got = chat.render(df)
    assert got.columns == ["conv_id", "n_turns", "n_copies", "text"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_empty(spark):
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
