"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Test texts are cut into windows of words. The words of all windows are counted over the whole corpus, and
each window is looked up by its rarest word alone. The index keeps the postings of those words: document,
position, and the words around it, which is where the lists of the window's other words would meet this one
once shifted by their offsets. So a phrase or proximity match is decided at the posting, without moving the
lists of frequent words. A window with a word that the corpus lacks is never looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, store, without

#: Words that are looked up in one pass over the documents; more words take more passes.
WORDS_AT_ONCE = 20_000
#: Rows up to which a table made from the benchmark is sent to every task; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All of ASCII but digits and lower-case letters: words are what these part.
_PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    """Column: the words of a string, A-Z in lower case; none for null."""
    low = F.translate(text, _UPPER, _UPPER.lower())
    return F.coalesce(F.array_remove(F.split(low, _PARTS), ""), F.array().cast("array<string>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, phrase array): every window of `size` consecutive words; an item of fewer words is one window.

    Items without words and items with a null id have none.
    """
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    rows = rows.where((F.size("w") > 0) & F.col("item").isNotNull())
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("phrase")).distinct()


def keys(docs: DataFrame, phrases: DataFrame, text_col: str = "text") -> DataFrame:
    """(phrase, word, shift): the rarest word of each phrase by its count over all documents, first among equals."""
    places = phrases.select("phrase", F.posexplode("phrase").alias("shift", "word"))
    terms = store(places.select("word").distinct(), "terms")
    n = terms.count()
    seen = docs.select(F.explode(words(F.col(text_col))).alias("word")).join(_small(terms, n), "word", "left_semi")
    counts = seen.groupBy("word").agg(F.count("*").alias("n"))
    counted = store(terms.join(counts, "word", "left"), "counted")
    placed = places.join(_small(counted, n), "word")
    best = placed.groupBy("phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shift", "word")).alias("k"))
    return best.where("k.n > 0").select("phrase", "k.word", "k.shift")


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (long, unique), id_col, version (hash of the text) and _words of every document."""
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("version"), words(F.col(text_col)).alias("_words"))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), "version", "_words")


def postings(rows: DataFrame, wanted: list[str], around: int, id_col: str = "doc_id") -> DataFrame:
    """The index over `rows` (see `tokens`): row, id_col, version, n_words and the postings of `wanted` words of every document.

    A posting has the word, its position, and from `first` on the `around` words to either side and itself.
    """
    w = F.col("_words")
    at = F.filter(F.transform(w, lambda x, i: F.when(x.isin(wanted) if wanted else F.lit(False), i)), lambda i: i.isNotNull())
    entry = F.transform(
        at,
        lambda i: F.struct(
            F.get(w, i).alias("word"),
            i.alias("position"),
            F.greatest(i - around, F.lit(0)).alias("first"),
            F.slice(w, F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around)) + around + 1).alias("near"),
        ),
    )
    return rows.select("row", F.col(id_col), "version", F.size(w).cast("long").alias("n_words"), entry.alias("postings"))


class Index:
    """A stored index over `docs` for the phrases of `items` (see `windows`)."""

    def __init__(self, docs: DataFrame, items: DataFrame, size: int, around: int | None = None, id_col: str = "doc_id", text_col: str = "text"):
        self.size, self.id_col = size, id_col
        self.windows = store(windows(items, size), "windows")
        self.keys = store(keys(docs, self.windows.select("phrase").distinct(), text_col), "keys")
        self.n_windows = self.windows.count()
        ordered = self.keys.select("word").distinct()
        rows = tokens(docs, id_col, text_col)
        if ordered.count() > WORDS_AT_ONCE:  # several passes: each must see the same rows under the same numbers
            rows = store(rows, "tokens")
        self.blocks = []
        last = ""
        while True:  # blocks of looked-up words, in order; one at least, which holds all documents
            block = [r[0] for r in ordered.where(F.col("word") > last).orderBy("word").limit(WORDS_AT_ONCE).collect()]
            if block or not self.blocks:
                around = size - 1 if around is None else around
                self.blocks.append(store(postings(rows, block, around, id_col), "postings"))
            if len(block) < WORDS_AT_ONCE:
                break
            last = block[-1]

    def documents(self) -> DataFrame:
        """row, id_col, version and n_words of every document."""
        return self.blocks[0].select("row", self.id_col, "version", "n_words")

    def _looked_up(self) -> DataFrame:
        known = _small(self.keys, self.n_windows)
        found = None
        for block in self.blocks:
            part = block.select("row", F.explode("postings").alias("p")).select("row", "p.*").join(known, "word")
            found = part if found is None else found.union(part)
        return found

    def phrases(self) -> DataFrame:
        """(row, start, stop, phrase): where the phrases occur exactly; stop is the position after the last word."""
        start = F.col("position") - F.col("shift")
        here = self._looked_up().where(start >= 0)
        here = here.where(F.slice("near", start - F.col("first") + 1, F.size("phrase")) == F.col("phrase"))
        return here.select("row", start.alias("start"), (start + F.size("phrase")).alias("stop"), "phrase")

    def proximity(self) -> DataFrame:
        """(row, position, phrase): rarest words that have all other words of their phrase around them, in any order."""
        here = self._looked_up().where(F.size(F.array_except("phrase", "near")) == 0)
        return here.select("row", "position", "phrase")

    def items(self, matches: DataFrame) -> DataFrame:
        """(row, item), once each, of matches with a phrase."""
        pairs = matches.select("row", "phrase").distinct().join(_small(self.windows, self.n_windows), "phrase")
        return pairs.select("row", "item").distinct()


def _covered(spans: DataFrame) -> DataFrame:
    """(row, n_hit): how many positions the spans [start, stop) of a row cover."""
    by_start = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    longest = spans.groupBy("row", "start").agg(F.max("stop").alias("stop"))
    fresh = F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(by_start), F.lit(0)))
    return longest.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, n_words, n_hit, n_items, items (sorted ids as strings), contaminated.

    A window is `size` consecutive words of an item (all its words, if fewer). n_hit counts the document's
    words that lie in any occurrence of a window, `items` are the ids whose windows occur. Texts that are
    null or have no words have no windows and no hits; items with a null id take no part, items that repeat
    an id count as one; repeated documents are judged each. Other columns are not read.
    """
    index = Index(docs, items, size, None, id_col, text_col)
    matches = store(index.phrases(), "matches")
    named = index.items(matches).groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = _covered(matches).join(named, "row")
    joined = index.documents().join(found, "row", "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(F.col(id_col), "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("items"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows in which a window of `items` occurs (see `contamination`), all columns as they are."""
    index = Index(docs, items, size, None, id_col, text_col)
    hit = store(index.phrases().select("row").distinct(), "hit")
    gone = store(index.documents().join(hit, "row").select(id_col, "version").distinct(), "gone")
    drop(hit, *index.blocks)
    return without(docs, gone, id_col, text_col)


def near_matches(docs: DataFrame, items: DataFrame, size: int = 10, within: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, item, position): windows all of whose words lie within `within` words of their rarest word, in any order."""
    index = Index(docs, items, size, within, id_col, text_col)
    matches = index.proximity()
    pairs = matches.join(_small(index.windows, index.n_windows), "phrase").select("row", "item", "position").distinct()
    return pairs.join(index.documents(), "row").select(F.col(id_col), "item", F.col("position").cast("long").alias("position"))
