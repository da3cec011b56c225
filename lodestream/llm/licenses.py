"""Licence scans by canonical digest, in DataFrame operations only.

Two texts are the same licence text if they are equal once case, punctuation, copyright lines and equivalent
spellings are gone; so known texts and scanned texts are brought to that form, and joined by its digest. A
scanned text can only match if it has one of a few words of the known texts, which is looked for first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import EQUIVALENT, FULL, FULL_WORDS, KNOWN

#: Rows of known digests up to which they are sent to every task; beyond, both sides are shuffled.
BROADCAST_ROWS = 100_000

#: A line that starts with a copyright mark, and the sentence that follows it so often.
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright\b|©|\(c\)).*$|\ball rights reserved\b"
OTHER = r"[^\p{L}\p{N}]+"


def steps() -> list[tuple[str, str]]:
    """Pattern and replacement pairs that make the canonical form of a lower-case text, in order."""
    pairs = [(COPYRIGHT, " "), (OTHER, " ")]
    pairs += [(rf"\b{a}\b", b) for a, b in EQUIVALENT]
    return pairs


def canonical(text: Column) -> Column:
    text = F.lower(text)
    for pattern, replacement in steps():
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(text)


def canonical_text(text: str) -> str:
    """The same form on the driver, for the choice of marker words."""
    text = text.lower()
    for pattern, replacement in steps():
        text = re.sub(pattern.replace(r"\p{L}\p{N}", r"\w").replace("^[^\\w\\n]", r"^[^\w\n]"), replacement, text)
    return text.strip()


def markers(texts: list[str]) -> str:
    """A pattern of few words of which every text has one, none of them made by an equivalent spelling."""
    made = {w for _, b in EQUIVALENT for w in b.split()}
    rest = [{w for w in canonical_text(t).split() if w.isascii() and w.isalnum() and w not in made} for t in texts]
    if any(not words for words in rest):
        return ""
    chosen = []
    while rest:
        counts: dict[str, int] = {}
        for words in rest:
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        best = max(counts, key=lambda w: (counts[w] * len(w) ** 3, w))
        chosen.append(best)
        rest = [words for words in rest if best not in words]
    return "|".join(chosen)


def known_digests(spark: SparkSession, known: list[tuple[str, str]], digests: list[tuple[str, str]] = ()) -> DataFrame:
    """(digest, license) of (name, text) and (name, digest) pairs: of names with one digest the least."""
    rows = spark.createDataFrame(known, "license string, text string").withColumn("canon", canonical(F.col("text")))
    rows = rows.where("canon <> ''").select("license", F.sha2(F.col("canon").cast("binary"), 256).alias("digest"))
    rows = rows.union(spark.createDataFrame(list(digests), "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(
    docs: DataFrame,
    known: list[tuple[str, str]] | None = None,
    full: list[tuple[str, str]] = (),
    full_words: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: id_col, license, notices (sorted distinct names), n_notices.

    `license` is the known text that the whole text is, else null. `notices` are the known texts that whole
    lines are; n_notices counts such lines. Null, empty and blank texts have none; rows that repeat are
    judged each. `known` are (name, text) pairs, `full` (name, digest) pairs of canonical texts, of which each has
    one of `full_words`; the built-in ones by default. Other columns are not read.
    """
    spark = docs.sparkSession
    if known is None:
        known, full, full_words = known_pairs(), full_pairs(), FULL_WORDS
    digests = known_digests(spark, known, full)
    if len(known) + len(full) <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    marker = markers([t for _, t in known]) if known else "^$a"
    if marker and full:  # without marker words every text is looked at
        marker = "|".join([marker, *full_words]) if full_words else ""
    low = F.lower(F.col(text_col))
    hit = F.coalesce(low.rlike(marker), F.lit(False)) if marker else F.col(text_col).isNotNull()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.when(hit, F.col(text_col)).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(marker) if marker else F.lit(True))
    units = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("t"))), F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("t"))))
    found = rows.select("row", "id", F.explode_outer(units).alias("u"))
    found = found.withColumn("digest", F.when(F.col("u.t").isNotNull(), F.sha2(canonical(F.col("u.t")).cast("binary"), 256)))
    found = found.join(digests, "digest", "left")
    notice = F.when(~F.col("u.whole"), F.col("license"))
    return (
        found.groupBy("row", "id")
        .agg(
            F.max(F.when(F.col("u.whole"), F.col("license"))).alias("license"),
            F.sort_array(F.collect_set(notice)).alias("notices"),
            F.count(notice).alias("n_notices"),
        )
        .select(F.col("id").alias(id_col), "license", "notices", "n_notices")
    )


def known_pairs() -> list[tuple[str, str]]:
    """The built-in (name, text) pairs, and the identifier line of every name."""
    pairs = [(name, text) for name, texts in KNOWN.items() for text in texts]
    return pairs + [(name, f"SPDX-License-Identifier: {name}") for name in KNOWN]


def full_pairs() -> list[tuple[str, str]]:
    """The built-in (name, digest) pairs of whole licence texts."""
    return [(name, digest) for name, digests in FULL.items() for digest in digests]
