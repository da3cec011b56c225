"""The corpus pipeline: documents in, packed training sequences out.

Each stage gets what the one before kept, written as Parquet and read again, and works on all of it. Rows
with null ids or texts, repeated rows and further columns are treated as the operators' docstrings say; an
empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.llm import decontaminate, packing, paragraphs, quality, shared, simhash
from lodestream.llm.queries import GOOD_FROM, tokenizer_path


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark, docs, sf_dir):
    """Documents whose quality score is GOOD_FROM or more, by a classifier fitted on the labels of these."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    score = "score"
    while score in docs.columns:
        score = "_" + score
    return quality.score(docs, model, name=score).where(F.col(score) >= GOOD_FROM).drop(score)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each class of near copies: SimHash candidates, 5-word shingles, similarity 0.8 or more."""
    return simhash.deduplicate(docs, similarity=0.8, size=5)


def drop_repeated_paragraphs(spark, docs, sf_dir):
    """Texts without the spans that another text, or an earlier place, holds; n_chars follows the text."""
    scratch = []
    out = shared.store(paragraphs.remove(docs, paragraphs.repeated(docs, similarity=0.8, size=5, scratch=scratch)), "rest")
    shared.drop(*scratch)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else out


def drop_contaminated(spark, docs, sf_dir):
    """Documents without any window of ten words of a benchmark item."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"), size=10)


def pack(spark, docs, sf_dir):
    """Pieces of the documents in sequences of 2048 tokens at most."""
    return packing.pack(docs, tokenizer_path(), window=2048)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_paragraphs),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the whole documents table."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
