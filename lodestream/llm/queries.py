"""Queries over whole tables, one for each operator, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontaminate, licenses, merkle, packing, panes, paragraphs, quality, sharding, simhash, topk, toxicity, warc
from .shared import new_path, store


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark, sf_dir):
    """All maximal conversations, rendered."""
    return chat.render(_read(spark, sf_dir, "conversations"))


def op2_exact_top_k(spark, sf_dir):
    """The 5 best matches of every 50th vector among all others."""
    return topk.top_k(_read(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


def op3_license_scan(spark, sf_dir):
    """Licence texts and notices in all documents."""
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", F.array_join("notices", ",").alias("notices"), "n_notices")


def op4_simhash_near_dedup(spark, sf_dir):
    """Near-duplicate classes of all documents: 4-word shingles, links at 4 or fewer bits."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), size=4, radius=4)
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark, sf_dir):
    """All documents in sequences of 2048 tokens at most."""
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(), window=2048)


def op6_substring_dedup(spark, sf_dir):
    """Spans of all documents that repeat, exactly or nearly, wherever lines end."""
    return paragraphs.repeated(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    """Benchmark windows of ten words in all documents."""
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), size=10)
    listed = F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed, "contaminated")


#: Score from which a document counts as good.
GOOD_FROM = 0.3


def op8_quality(spark, sf_dir):
    """Quality score of every document."""
    docs = _read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op9_warc(spark, sf_dir):
    """All pages written to archives, read back and assembled."""
    path = new_path(spark, "warc")
    warc.write(_read(spark, sf_dir, "pages"), path)
    records = store(warc.read(spark, path, blocks=False), "records")  # read by both sides of the assembly
    return warc.page_captures(warc.assemble(records))


def op10_sharding(spark, sf_dir):
    """All documents over 40 shards whose row counts differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return sharding.shuffle_into_shards(docs, 40, seed=10).withColumn("grown_shard", F.lit(None).cast("int"))


def _hours(ts):
    """Whole hours from 1970 to a time without a zone, rounded down."""
    return F.unix_date(F.col(ts).cast("date")).cast("long") * 24 + F.hour(ts)


def click_batches(clicks, batches: int = 10):
    """Clicks as rows of panes.revisions: each click_id once (of different rows the first that arrived; null is one id),
    those without a time dropped; a click without an arrival arrives at its own time. A value that isn't finite is 0 cents."""
    first = clicks.where(F.col("ts").isNotNull()).groupBy("click_id").agg(
        F.min(F.struct(F.coalesce("arrived_at", "ts").alias("arrived"), "ts", "kind", "value")).alias("r")
    ).select("click_id", "r.*")
    day = F.unix_date(F.col("arrived").cast("date")).cast("long")
    q = F.pmod(day, F.lit(10))
    held_back = F.greatest(F.lit(0), F.crc32(F.col("click_id").cast("string")) % 30 - 23)
    cents = F.when(F.col("value") - F.col("value") == 0, F.floor(F.col("value") * 100 + 0.5))
    return first.select(
        F.least(F.lit(batches - 1), q + held_back).cast("int").alias("batch"), "kind", (_hours("ts") - (day - q) * 24).alias("hour"), "click_id", cents.alias("cents"),
    )


def op11_window_panes(spark, sf_dir):
    """All clicks in ten batches: hourly panes by kind, emitted, revised and closed."""
    return panes.revisions(click_batches(_read(spark, sf_dir, "clicks")), 10, due_after=12, closed_after=48)


#: Score from which a document counts as toxic.
TOXIC_FROM = 0.5


def op12_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    docs = _read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


#: Fields of a document that its digest covers, in order.
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle_manifest(spark, sf_dir):
    """Digest, proof and verification of every document, a third of them with the text's A-Z in lower case."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = merkle.leaf(*[lowered if c == "text" else F.col(c) for c in LEAF_FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed)
    return merkle.prove(_read(spark, sf_dir, "documents"), LEAF_FIELDS, by="lang", order="doc_id", altered=tampered)


_QUERIES = (op1_chat_format, op2_exact_top_k, op3_license_scan, op4_simhash_near_dedup, op5_packing, op6_substring_dedup, op7_decontamination, op8_quality, op9_warc, op10_sharding, op11_window_panes, op12_toxicity, op13_merkle_manifest)

def _canonical_sql(text: str) -> str:
    """DuckDB's form of licenses.canonical."""
    sql = f"lower({text})"
    for pattern, replacement in licenses.steps():
        sql = f"regexp_replace({sql}, '{pattern}', '{replacement}', 'g')"
    return f"trim({sql})"


def _license_sql() -> str:
    quoted = [(n, t.replace("'", "''")) for n, t in licenses.known_pairs()]
    values = ", ".join(f"('{n}', '{t}')" for n, t in quoted)
    full = ", ".join(f"('{n}', '{d}')" for n, d in licenses.full_pairs())
    return f"""
WITH texts AS (
  SELECT {_canonical_sql("t")} AS c, license FROM (VALUES {values}) v(license, t)
), known AS (
  SELECT h, min(license) AS license FROM (SELECT sha256(c) AS h, license FROM texts WHERE c <> '' UNION ALL SELECT h, license FROM (VALUES {full}) f(license, h)) GROUP BY h
), d AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), lines AS (
  SELECT r, sha256({_canonical_sql("line")}) AS h FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
), notices AS (
  SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n FROM lines JOIN known USING (h) GROUP BY r
)
SELECT doc_id, license, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notices
FROM (SELECT r, doc_id, sha256({_canonical_sql("text")}) AS h FROM d) LEFT JOIN known USING (h) LEFT JOIN notices USING (r)"""


#: The CRC-32 of a text of ASCII letters in DuckDB, bit by bit; {} is the text.
_CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

def _coded_sql(*fields: str) -> str:
    """DuckDB's form of merkle.leaf."""
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


_LOWERED_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ORACLES = {
    "op13_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_coded_sql(*LEAF_FIELDS)} AS leaf,
    CASE WHEN {_CRC32_SQL.format("doc_id::VARCHAR")} % 3 = 0 THEN {_coded_sql(*LEAF_FIELDS[:-1], _LOWERED_SQL)} END AS other
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d
), t AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM r
  UNION ALL
  SELECT lang, level + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, level, i // 8
), s AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS level, i, n, subroot AS h FROM s
  UNION ALL
  SELECT level + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 8
), b AS (
  SELECT a.lang, a.level, a.i, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i < a.i), '') AS before, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i > a.i), '') AS after
  FROM t a JOIN t o ON a.lang IS NOT DISTINCT FROM o.lang AND a.level = o.level AND a.i // 8 = o.i // 8 WHERE a.n > 1 GROUP BY ALL
), c AS (
  SELECT a.level, a.i, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i < a.i), '') AS before, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i > a.i), '') AS after
  FROM u a JOIN u o ON a.level = o.level AND a.i // 8 = o.i // 8 WHERE a.n > 1 GROUP BY ALL
), f AS (
  SELECT lang, i AS leaf_no, 0 AS level, i AS pos, coalesce(other, leaf) AS h, '' AS proof FROM r
  UNION ALL
  SELECT f.lang, leaf_no, f.level + 1, pos // 8, sha256(before || h || after), proof || before || after FROM f JOIN b ON f.lang IS NOT DISTINCT FROM b.lang AND f.level = b.level AND f.pos = b.i
), g AS (
  SELECT lang, leaf_no, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM f GROUP BY ALL
), k AS (
  SELECT g.lang, leaf_no, 0 AS level, s.i AS pos, h, proof FROM g JOIN s ON g.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT k.lang, leaf_no, k.level + 1, pos // 8, sha256(before || h || after), proof || before || after FROM k JOIN c ON k.level = c.level AND k.pos = c.i
), e AS (
  SELECT lang, leaf_no, arg_max(h, level) AS folded_root, arg_max(proof, level) AS proof FROM k GROUP BY ALL
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM r JOIN e ON r.lang IS NOT DISTINCT FROM e.lang AND r.i = e.leaf_no JOIN s ON r.lang IS NOT DISTINCT FROM s.lang, (SELECT h AS root FROM u WHERE n = 1)""",
    "op11_window_panes": f"""
WITH c AS (
  SELECT click_id, min({{'a': coalesce(arrived_at, ts), 'ts': ts, 'kind': kind, 'value': value}}) AS r
  FROM clicks WHERE ts IS NOT NULL GROUP BY click_id
), d AS (
  SELECT click_id, r.ts AS ts, coalesce(r.kind, 'none') AS kind, date_diff('day', DATE '1970-01-01', r.a::DATE) AS day,
    coalesce(floor(100 * r.value + 0.5), 0)::BIGINT AS cents
  FROM c
), e AS (
  SELECT least(9, day % 10 + greatest(0, {_CRC32_SQL.format("click_id::VARCHAR")} % 30 - 23)) AS batch, click_id, kind, cents,
    floor((epoch_us(ts) - (day - day % 10) * 86400000000) / 3600000000.0)::BIGINT AS hour
  FROM d
), w AS (
  SELECT b.range AS batch, (SELECT max(hour) FROM e WHERE e.batch < b.range) AS seen FROM range(10) b
), l AS (
  SELECT e.*, seen IS NOT NULL AND seen >= hour + 49 AS late FROM e JOIN w USING (batch)
), a AS (
  SELECT kind, hour, batch, count(*) AS n, sum(cents) AS cents FROM l WHERE NOT late GROUP BY ALL
), s AS (
  SELECT kind, hour, batch, sum(n) OVER p AS n, sum(cents) OVER p AS cents, lead(batch) OVER p AS upto,
    first_value(batch) OVER p AS first, (SELECT min(w.batch) FROM w WHERE seen >= a.hour + 13) AS due
  FROM a WINDOW p AS (PARTITION BY kind, hour ORDER BY batch)
), t AS (
  SELECT *, CASE WHEN due IS NOT NULL THEN greatest(due, first) END AS sent, lag(n) OVER p AS old_n, lag(cents) OVER p AS old_cents
  FROM s WINDOW p AS (PARTITION BY kind, hour ORDER BY batch)
)
SELECT batch::BIGINT AS batch, hour, click_id, 1::BIGINT AS n_rows, cents, 'late' AS record, kind FROM l WHERE late
UNION ALL SELECT sent::BIGINT, hour, -1, n::BIGINT, cents::BIGINT, 'emit', kind FROM t WHERE batch <= sent AND (upto IS NULL OR upto > sent)
UNION ALL SELECT batch::BIGINT, hour, -1, old_n::BIGINT, old_cents::BIGINT, 'retract', kind FROM t WHERE batch > sent
UNION ALL SELECT batch::BIGINT, hour, -1, n::BIGINT, cents::BIGINT, 'replace', kind FROM t WHERE batch > sent
UNION ALL SELECT 9, hour, -1, n::BIGINT, cents::BIGINT, 'final', kind FROM t WHERE sent IS NULL AND upto IS NULL""",
    "op1_chat_format": """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
), c AS (
  SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, x) AS l, count(*) AS n FROM t GROUP BY conv_id
), u AS (
  SELECT l, n, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY l, n
)
SELECT conv_id, n AS n_turns, copies AS n_copies,
  array_to_string(list_transform(l, lambda m: '<|im_start|>' || m.r || chr(10) || m.x || '<|im_end|>' || chr(10)), '') AS text
FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n > u.n AND c.l[1:u.n] = u.l)""",
    "op3_license_scan": _license_sql(),
    "op2_exact_top_k": """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.r <> q.r
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), g AS (
  SELECT DISTINCT item_id, w[s:s + 9] AS p, least(len(w), 10) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM i WHERE len(w) > 0)
), o AS (
  SELECT r, s, k, w[s:s + k - 1] AS p
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)
), m AS (
  SELECT DISTINCT o.r, o.s, o.k, g.item_id FROM o JOIN g ON o.p = g.p
), h AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS q FROM m) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
    "op9_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p
), b AS (
  SELECT page_id, payload_bytes, h,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY h) AS original
  FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM b""",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracles() -> dict:
    return dict(_ORACLES)
