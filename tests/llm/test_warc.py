import base64
import gzip
import hashlib
import io

from lodestream.llm import warc


def expected(rows):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = best.get(h or "")
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(map(str, out))


def test_round_trip(spark, tmp_path):
    tricky = "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a", "x"), (2, "http://b", "x"), (7, None, None), (5, "u\r\nX: 1", ""), (9, "", tricky), (8, "http://c", tricky)]
    rows += [(None, "n", "x"), (None, "m", "alone"), (-4, "http://d", "big " * 500_000), (3, "http://same", "twice"), (3, "http://same", "twice")]
    rows += [(10 + i, f"http://host/{i}", "many") for i in range(50)]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, type string, payload_bytes int").repartition(3)
    warc.write(pages, f"{tmp_path}/w")
    captures = warc.assemble(warc.read(spark, f"{tmp_path}/w"))
    got = sorted(map(str, map(tuple, warc.page_captures(captures).collect())))
    assert got == expected(rows)
    nested = [c for c in captures.collect() if c.request["uri"] == "http://a"][0]
    assert nested.request["block"] == b"GET http://a HTTP/1.1\r\n\r\n" and nested.metadata[0]["block"] == b"page_id: 1\r\n"
    assert nested.type == "revisit" and nested.profile.endswith("identical-payload-digest")


def test_small_payloads_stay_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "xyz"), (4, "d", "xyz")], "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/w", least_bytes=2)
    got = warc.page_captures(warc.assemble(warc.read(spark, f"{tmp_path}/w", blocks=False))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert warc.page_captures(warc.assemble(warc.read(spark, f"{tmp_path}/w"))).collect() == []


def test_records_that_belong_to_nothing_and_files_with_many_members(spark, tmp_path):
    def record(kind, rid, extra, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    parts = [
        record("warcinfo", "i", "", b"software: x\r\n"),
        record("response", "a", "Content-Type: application/http;msgtype=response\r\n", b"HTTP/1.1 200 OK\r\n\r\nbody"),
        record("metadata", "b", "WARC-Concurrent-To: <a>\r\n", b"page_id: 5\r\n"),
        record("metadata", "c", "WARC-Concurrent-To: <gone>\r\n", b"page_id: 6\r\n"),
        record("response", "d", "", b"HTTP/1.1 200 OK\r\n\r\n"),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    assert len(list(warc.parse(io.BytesIO(b"".join(parts))))) == 5
    got = {r.record_id: r for r in warc.assemble(warc.read(spark, str(tmp_path))).collect()}
    assert set(got) == {"<a>", "<d>"} and got["<a>"].payload_bytes == 4 and got["<d>"].metadata == [] and got["<d>"].request is None
