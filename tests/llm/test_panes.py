import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta
from math import floor, isfinite

import numpy as np
import pytest

from lodestream.llm import panes, queries

EPOCH = datetime(1970, 1, 1)


def brute_force(rows, batches, due=12, closed=48):
    """rows: (batch, kind, hour, click_id, cents). The records of the contract, batch by batch."""
    out, seen, open_panes, sent = [], None, {}, set()
    for b in range(batches):
        own, changed = [r for r in rows if r[0] == b and r[2] is not None], defaultdict(lambda: None)
        for _, kind, hour, click, cents in own:
            pane = (kind or "none", hour)
            if seen is not None and seen >= hour + 1 + closed:
                out.append((b, hour, click, 1, cents or 0, "late", pane[0]))
                continue
            n, c = open_panes.get(pane, (0, 0))
            if changed[pane] is None:
                changed[pane] = (n, c)
            open_panes[pane] = (n + 1, c + (cents or 0))
        for pane in sorted(open_panes):
            kind, hour = pane
            if pane in sent:
                if changed[pane] is not None:
                    out.append((b, hour, -1, *changed[pane], "retract", kind))
                    out.append((b, hour, -1, *open_panes[pane], "replace", kind))
            elif seen is not None and seen >= hour + 1 + due:
                out.append((b, hour, -1, *open_panes[pane], "emit", kind))
                sent.add(pane)
        for pane in [p for p in open_panes if seen is not None and seen >= p[1] + 1 + closed]:
            del open_panes[pane]
            sent.discard(pane)
        if b == batches - 1:
            out.extend((b, hour, -1, *open_panes[kind, hour], "final", kind) for kind, hour in sorted(open_panes) if (kind, hour) not in sent)
        for r in own:
            seen = r[2] if seen is None else max(seen, r[2])
    return sorted(map(repr, out))


def test_exact_bincount():
    rng = np.random.default_rng(2)
    at, amounts = rng.integers(0, 5, 1000), rng.integers(-(1 << 61), 1 << 61, 1000) // 1000
    want = [int(sum(a for a, k in zip(amounts.tolist(), at.tolist()) if k == j)) for j in range(5)]
    assert panes.exact_bincount(at, amounts, 5).tolist() == want


def test_ring_keeps_what_a_dictionary_keeps():
    rng = random.Random(3)
    ring, kept = panes.Ring(3), {}
    base = -200
    for step in range(60):
        hours = [8 * rng.randrange((base - 40) // 8, (base + rng.choice([60, 900])) // 8) + 3 for _ in range(rng.randrange(6))]
        hours = [h for h in hours if h > base - 49]
        n, cents = [rng.randrange(1, 5) for _ in hours], [rng.randrange(-99, 99) for _ in hours]
        ring.add(np.array(hours, np.int64), np.array(n, np.int64), np.array(cents, np.int64))
        for h, a, c in zip(hours, n, cents):
            old = kept.get(h, (0, 0))
            kept[h] = (old[0] + a, old[1] + c)
        base += rng.randrange(0, 60)
        ring.forget(base - 49)
        kept = {h: v for h, v in kept.items() if h > base - 49}
        if ring.base is not None:
            ring = panes.Ring(3, ring.base, ring.packed(), ring.outside)
        hours, _, n, cents, _ = ring.table()
        assert {int(h): (int(a), int(c)) for h, a, c in zip(hours, n, cents) if a} == kept, step
        assert (np.diff(hours) > 0).all()


def test_revisions_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(panes, "_HELD", 3)
    rng = random.Random(5)
    rows = []
    for i in range(400):
        batch = rng.choice([0, 1, 3, 4])  # batch 2 is empty
        hour = rng.choice([-30, 0, 10, 24 * batch + rng.randrange(24), 24 * batch + rng.randrange(24), 3000 if i == 7 else 5, -(10**6) if batch == 0 and i % 50 == 0 else 30])
        rows.append((batch, rng.choice(["a", "b", None]), hour, i, rng.choice([None, -5, 10**12, 7])))
    rows += [rows[0], (9, "a", 1, 1, 1), (None, "a", 1, 1, 1), (1, "a", None, 1, 1)]  # a repeated row counts; these others don't
    df = spark.createDataFrame([(*r, "x") for r in rows], "batch int, kind string, hour long, click_id long, cents long, record string").repartition(5)
    got = panes.revisions(df, 5)
    assert got.schema.simpleString() == "struct<batch:bigint,hour:bigint,click_id:bigint,n_rows:bigint,cents:bigint,record:string,kind:string>"
    found = [tuple(r) for r in got.collect()]
    want = brute_force([r for r in rows if r[0] is not None and r[0] < 5 and r[2] is not None], 5)
    assert sorted(map(repr, found)) == want
    assert {r[5] for r in found} == {"late", "emit", "retract", "replace", "final"}


def clicks():
    rng = random.Random(11)
    out = []
    for i in range(300):
        arrived = datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 12), minutes=rng.randrange(60))
        ts = rng.choice([None, arrived - timedelta(hours=rng.choice([0, 0, 1, 30, 200])), arrived, arrived])
        out.append((i, ts, arrived, 1, rng.choice(["view", None]), rng.choice([None, 1.005, -2.5, 0.125, float("nan"), 1e7]), "{}"))
    return out + out[:40]


def test_query_equals_brute_force(spark, tmp_path):
    rows = clicks()
    schema = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
    spark.createDataFrame([(*r, 1, "x") for r in rows], schema + ", batch int, hour string").write.parquet(f"{tmp_path}/clicks.parquet")
    got = queries.queries()["op11_window_panes"](spark, str(tmp_path)).collect()
    cut = []
    for click, ts, arrived, _, kind, value, _ in {r[0]: r for r in rows}.values():
        if ts is not None:
            day = (arrived - EPOCH).days
            hour = (ts - EPOCH - timedelta(days=day - day % 10)) // timedelta(hours=1)
            cents = floor(100 * value + 0.5) if value is not None and isfinite(value) else 0
            cut.append((min(9, day % 10 + max(0, zlib.crc32(str(click).encode()) % 30 - 23)), kind, hour, click, cents))
    assert sorted(repr(tuple(r)) for r in got) == brute_force(cut, 10)


def test_no_clicks(spark, tmp_path):
    schema = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/clicks.parquet")
    assert queries.queries()["op11_window_panes"](spark, str(tmp_path)).collect() == []
