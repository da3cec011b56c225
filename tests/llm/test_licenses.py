import os

import pytest

from lodestream.llm import licenses
from lodestream.llm.license_texts import KNOWN


def test_scan(spark):
    mit, isc = KNOWN["MIT"][0], KNOWN["ISC"][0]
    rows = [
        (1, f"Copyright (c) 2020 Someone\nAll rights reserved.\n\n{mit}"),
        (2, mit.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ;").replace("\n\n", "\r\n")),
        (3, mit + " and more"),
        (4, f"prose\nReleased under the MIT Licence!\nmore\n  LICENSED under cc by nc 4.0\nreleased under the MIT license"),
        (5, None), (6, ""), (7, "\n \n"), (8, "license " * 50_000), (None, f"(c) 1999 X\n# © Y\n{isc}"), (4, "SPDX-License-Identifier: Zlib"),
        (9, "Copyright 2020 only"), (1, "the license of this"),
    ]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, license string, row int")
    got = [(str(r.doc_id), r.license, r.notices, r.n_notices) for r in licenses.scan(df).collect()]
    want = [("1", "MIT", [], 0), ("1", None, [], 0), ("2", "MIT", [], 0), ("3", None, [], 0), ("4", None, ["CC-BY-NC-4.0", "MIT"], 3), ("4", "Zlib", ["Zlib"], 1)]
    want += [(k, None, [], 0) for k in ("5", "6", "7", "8", "9")] + [("None", "ISC", [], 0)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert licenses.scan(df.limit(0)).collect() == []


def test_every_known_text_is_found(spark):
    pairs = licenses.known_pairs()
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(pairs)], "doc_id long, text string")
    found = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert [found[i] for i in range(len(pairs))] == [n for n, _ in pairs]


def test_own_list(spark):
    df = spark.createDataFrame([(1, "..!"), (2, "Mine, all mine"), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df, [("b", "mine all mine"), ("a", "MINE: all mine"), ("none", "?!")]).collect()}
    assert got == {1: None, 2: "a", 3: None}
    assert all(r.license is None for r in licenses.scan(df, []).collect())


FOLDER = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no licence texts here")
def test_whole_texts_by_digest(spark):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0-only": "GPL-2", "GPL-3.0-only": "GPL-3", "LGPL-2.1-only": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    rows = []
    for name, file in names.items():
        with open(f"{FOLDER}/{file}", encoding="utf-8") as f:
            text = f.read()
        rows += [(name, text), (name, text.upper().replace("\n", "\r\n")), (None, text + " more")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(found) == len(rows) and all(r.license == r.doc_id for r in found)
