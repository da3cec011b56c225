import random
import struct
import unicodedata
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestream.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def documents():
    rng = random.Random(3)
    words = ["the", "Éclair", "end.", "what?", "don't", "42nd", "áb", "x y", "<|endoftext|>", "你好", "WORLD!", "\U0001f600"]
    out = [None, "", " ", "one", "\x1codd\x1fspace. here", "́start", "a\tb\r\nc", "x" * 9000, "long " * 30000]
    for _ in range(300):
        out.append(rng.choice([" ", "\n"]).join(rng.choices(words, k=rng.choice([1, 5, 80, 900]))))
    return list(enumerate(out)) + [(None, "null id"), (3, "repeated id")]


def check(pieces, docs, window):
    tok = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    sizes = defaultdict(list)
    got = defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
        sizes[p.sequence_id].append((p.offset, p.length))
    assert set(got) == set(want)
    for i, ids in want.items():
        if len(ids) > 1:
            assert sum(p.length for p in got[i]) == sum(map(len, ids))
            continue
        at = 0
        for p in sorted(got[i], key=lambda p: p.start):
            part = ids[0][p.start : p.start + p.length]
            assert (p.start, p.length, p.doc_tokens) == (at, len(part), len(ids[0]))
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p.length
        assert at == len(ids[0])
    padding = total = 0
    for found in sizes.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / total


@pytest.mark.parametrize("window, step", [(2048, 16), (256, 256), (100, 7)])
def test_each_id_in_one_piece(spark, window, step):
    docs = documents()
    df = spark.createDataFrame([(a, b, 5) for a, b in docs], "doc_id long, text string, start int").repartition(3)
    found = packing.pack(df, PATH, window, step=step)
    assert found.columns == list(packing.PIECES)
    assert check(found.collect(), docs, window) < 0.05


def test_best_cuts_as_brute_force():
    rng = random.Random(5)
    for _ in range(30):
        packer = packing.Packer(256, 3.0, 20.0, 1000)
        cuts, p = {0: 0.0}, 0
        for _ in range(rng.randrange(2, 12)):
            sizes = [rng.choice([5, 30, 64, 100, 127, 128]) for _ in range(rng.randrange(4))]
            packer.add(0, sizes, b"abcd" * sum(sizes))
            for s in sizes:
                p += s
                cuts[p] = 3.0
            p += 1
            cuts[p] = 0.0
        packer.solve()
        best = {0: 0.0}
        for j in sorted(cuts)[1:]:
            best[j] = min(best[i] + cuts[j] + (0 if j - i == 128 else 256 - (j - i)) for i in cuts if j - 256 <= i < j)
        for position, cost in zip(packer.pos, packer.best):
            assert cost == pytest.approx(best[position])


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_every_letter_before_every_mark():
    """Ids are those of the tokenizer, whatever letter ends a word and whatever mark follows."""
    encoder, tok = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    letters = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]
    assert len(letters) > 100_000
    for mark in packing._TAIL:
        some = letters if mark == "." else [c for c in letters if ord(c) < 0x3000 or 0xF900 <= ord(c) < 0x10000]
        for k in range(0, len(some), 20_000):
            words = [f"a{c}{mark}" for c in some[k : k + 20_000]]
            want = [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)]
            assert [list(memoryview(ids).cast("I")) for _, ids in encoder.documents(pa.array(words))] == want
    for text in ("SERG\u0130.", "\u0130;", "K\u0130TABEV\u0130, yeni", "\u0130ZM\u0130R.", "\u03a3\u0391\u03a3. \u039f\u0394\u039f\u03a3,"):
        assert list(memoryview(next(encoder.documents(pa.array([text])))[1]).cast("I")) == tok.encode(text, add_special_tokens=False).ids
