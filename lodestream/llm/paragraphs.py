"""Substring dedup by paragraph MinHash banding.

Paragraphs are cut by content and not at line ends: a cut lies where the hash of two words is the least among its
neighbours, so a passage that repeats is cut alike wherever it stands, and every word lies in a paragraph. Equal
paragraphs count once. The MinHash signatures of the distinct ones are cut into bands; paragraphs that share a band
are compared by the exact Jaccard similarity of their word shingles, and the links found make components. Of every
component one occurrence stays, the others are removals: adjacent ones are joined, and the ends of what is joined
move out word by word as far as the text agrees with the occurrence that they were matched with.
"""

from __future__ import annotations

from itertools import accumulate
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import _ID, VERSION, drop, give_back, small, store, wide_rows

_GONE = "__lodestream_gone"

#: Words of a shingle, and least similarity of a link.
SHINGLE = 5
SIMILARITY = 0.8
#: Pairs of words on either side among which a cut has the least hash: paragraphs have 13 words on average, 7 at least,
#: and a passage of 51 words holds a whole one with a chance of 0.979 (55: 0.992, 60: 0.998; by simulation).
REACH = 6
#: Words beyond which a paragraph is cut again, every half of it: text without a least hash, as one word repeated.
LONGEST = 64
#: Least words of a removal.
MIN_WORDS = 20
#: Words between two removals up to which these become one.
GAP = 4
#: Minima in a band of whole documents and of paragraphs, and the least chance that a pair just similar enough shares a band.
BAND_ROWS = 4
PARAGRAPH_ROWS = 2
RECALL = 0.98
#: Members of a band's bucket beyond which it is split into cells, each task getting two parts of it.
LARGE_BUCKET = 512
#: The same for paragraphs, which are short.
LARGE_PARAGRAPH_BUCKET = 8192
#: Members up to which a cell is compared without an index.
FEW = 4
#: Rows of bands that a task holds before it looks for repeated ones; they take 24 bytes each.
ROWS_IN_CELLS = 1 << 22
#: One in so many members is looked at to find large buckets; what it misses makes a cell larger, no more.
SAMPLE = 16
#: Bits of the bitmap of paragraphs whose words are wanted: 16 MB.
BITMAP_BITS = 1 << 27
#: Bytes of text that a task hashes at once, beyond a single text.
BYTES_AT_ONCE = 1 << 19

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x9FB21C651E98DF25
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _letters() -> np.ndarray:
    """A random number for each byte, capital letters A-Z having those of the small ones."""
    values = np.random.default_rng(6).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    return values


_LETTERS = _letters()
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BYTES_AT_ONCE), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 2 * BYTES_AT_ONCE:
            _POWERS[base] = have
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def bands(similarity: float, recall: float = 0.995, rows: int = BAND_ROWS) -> int:
    """Bands of `rows` minima that a pair of this similarity shares one of with a chance of `recall`."""
    return ceil(log(1 - recall) / log(1 - similarity**rows))


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """All runs of `size` words, joined by a space; the whole sequence if it has fewer."""
    text = b" ".join(words)
    if len(words) <= size:
        return [text]
    ends = list(accumulate(len(w) + 1 for w in words))
    return [text[s : e - 1] for s, e in zip([0, *ends], ends[size - 1 :])]


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(6).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _band_keys(hashes: np.ndarray, starts: np.ndarray, n_bands: int, rows: int = BAND_ROWS) -> np.ndarray:
    """A 64-bit key for each text (its hashes begin at `starts`) and band of `rows` minima."""
    keys = np.empty((len(starts), n_bands), np.uint64)
    factors = _multipliers(n_bands * rows)
    for b in range(n_bands):
        key = np.full(len(starts), b + 1, np.uint64)
        for m in factors[b * rows : (b + 1) * rows]:
            low = np.minimum.reduceat((hashes * m) >> np.uint64(8), starts)
            key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, b] = key
    return keys


class _Cut:
    """Texts (bytes `data`, text i from offsets[i] to offsets[i + 1]) cut into words and paragraphs.

    data and offsets as given; starts, ends (bytes) and hashes of all words; of_text: the first word of each text, and the number of words;
    first: the first word of each paragraph, and the number of words; text: the text of each paragraph.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(solid & ~(np.r_[False, solid[:-1]] & ~edge[:-1]))
        self.ends = np.flatnonzero(solid & ~(np.r_[solid[1:], False] & ~edge[1:])) + 1
        sums = np.r_[np.uint64(0), np.cumsum(_LETTERS[data] * _powers(_STEP, len(data)))]
        back = _powers(pow(_STEP, -1, 1 << 64), len(data) + 1)[self.starts]
        self.hashes = _mixed((sums[self.ends] - sums[self.starts]) * back + (self.ends - self.starts).astype(np.uint64) * _MIX[2])
        self.of_text = np.searchsorted(self.starts, offsets)
        self.first = self._paragraphs()
        self.text = np.searchsorted(self.of_text, self.first[:-1], side="right") - 1

    def _paragraphs(self) -> np.ndarray:
        n = len(self.hashes)
        begins = np.unique(self.of_text[:-1][np.diff(self.of_text) > 0])
        if n > 2 * REACH + 1:
            pair = _mixed(self.hashes[:-1] * _MIX[2] + self.hashes[1:])
            low, width = pair, 1
            while 2 * width <= REACH:
                low, width = np.minimum(low[:-width], low[width:]), 2 * width
            low = np.minimum(low[: len(pair) - REACH + 1], low[REACH - width : len(pair) - width + 1])  # of REACH pairs from each place
            at = np.arange(REACH, len(pair) - REACH)
            least = (pair[at] < low[at - REACH]) & (pair[at] <= low[at + 1])
            text = np.searchsorted(self.of_text, at, side="right") - 1
            inside = (at - REACH >= self.of_text[text]) & (at + REACH + 1 < self.of_text[text + 1])
            begins = np.union1d(begins, at[least & inside])
        first = np.r_[begins, n].astype(np.int64)
        long = np.flatnonzero(np.diff(first) > LONGEST)
        more = [np.arange(first[i], first[i + 1] - LONGEST // 2, LONGEST // 2) for i in long.tolist()]
        return np.unique(np.concatenate([first, *more])) if more else first

    def digests(self) -> np.ndarray:
        """A 64-bit digest of the words of every paragraph."""
        size = np.diff(self.first)
        if not len(size):
            return np.empty(0, np.uint64)
        place = np.arange(len(self.hashes)) - np.repeat(self.first[:-1], size)
        return _mixed(np.add.reduceat(_mixed(self.hashes + (place + 1).astype(np.uint64) * _MIX[2]), self.first[:-1]) ^ size.astype(np.uint64))

    def keys(self, digests: np.ndarray, chosen: np.ndarray, size: int, n_bands: int) -> np.ndarray:
        """Band keys of the chosen paragraphs, by shingles of `size` words."""
        value = self.hashes
        for _ in range(size - 1):
            value = np.r_[value[1:], np.uint64(0)] * _MIX[1] + self.hashes
        value = _mixed(value)
        n_words = np.diff(self.first)[chosen]
        count = np.maximum(n_words - size + 1, 1)
        ends = np.cumsum(count)
        starts = ends - count
        places = np.arange(ends[-1]) - np.repeat(starts, count) + np.repeat(self.first[:-1][chosen], count)
        values = value[places]
        values[starts[n_words < size]] = digests[chosen][n_words < size]
        return _band_keys(values, starts, n_bands, PARAGRAPH_ROWS)


def _cuts(column: pa.Array):
    """(first text, _Cut) of successive texts of a binary column, some BYTES_AT_ONCE at a time."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BYTES_AT_ONCE, side="right")) - 1)
        yield lo, _Cut(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def _rows(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    wide_rows(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), *more, F.col(text_col).cast("binary").alias("text"))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every paragraph of every text: id, version (hash of the text), unit (its number), pid (digest of its words)."""
    rows = _rows(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            for lo, cut in _cuts(batch.column(2)):
                if len(cut.text):
                    at = pa.array(cut.text + lo)
                    number = np.arange(len(cut.text)) - np.searchsorted(cut.text, cut.text)
                    columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(number.astype(np.int32)), pa.array(cut.digests().view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "version", "unit", "pid"])
        give_back()

    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, version long, unit int, pid long")


def _with(known: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers with the sorted `more` among them, and which of these are new."""
    at = np.searchsorted(known, more)
    new = np.r_[known, ~more[-1:]][at] != more
    return np.insert(known, at[new], more[new]), new


def signatures(docs: DataFrame, n_bands: int, size: int, text_col: str = "text", share: int = 1) -> DataFrame:
    """(pid, bands): MinHash band keys of the paragraphs of all texts, once for each batch of texts; of one in `share` pids."""
    rows = docs.select(F.col(text_col).cast("binary").alias("text"))
    wide_rows(docs.sparkSession)

    def run(batches):
        for batch in batches:
            known = np.empty(0, np.uint64)
            for _, cut in _cuts(batch.column(0)):
                digests = cut.digests()
                pids, chosen = np.unique(digests, return_index=True)
                known, new = _with(known, pids)
                new &= pids % np.uint64(share) == 0
                pids, chosen = pids[new], chosen[new]
                if len(pids):
                    keys = cut.keys(digests, chosen, size, n_bands)
                    offsets = np.arange(len(pids) + 1, dtype=np.int32) * n_bands
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(pids.view(np.int64)), lists], names=["pid", "bands"])
        give_back()

    return rows.mapInArrow(run, "pid long, bands array<bigint>")


def _grouped(batches, key_columns: int):
    """Tables of whole groups, where rows are sorted by the first columns; a group is never cut."""
    kept = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        kept = new if kept is None else pa.concat_tables([kept, new])
        keys = [kept.column(i).to_numpy() for i in range(key_columns)]
        last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys])) if kept.num_rows else []
        if len(last):
            cut = int(last[-1]) + 1
            yield kept.slice(0, cut).combine_chunks()
            kept = kept.slice(cut)
    if kept is not None and kept.num_rows:
        yield kept.combine_chunks()


def _bounds(table: pa.Table, key_columns: int) -> np.ndarray:
    keys = [table.column(i).to_numpy() for i in range(key_columns)]
    first = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]
    return np.r_[np.flatnonzero(first), table.num_rows]


def _shared(batches, limit: int):
    """The rows (key, x, y, pid) whose cell has several different pids, each once; rows that repeat are dropped on the way."""
    parts, n = [], 0

    def cells():
        columns = [np.concatenate([p[i] for p in parts]) for i in range(4)]
        order = np.argsort(columns[0], kind="stable")
        key = columns[0][order]
        equal = key[1:] == key[:-1]
        order = order[np.r_[False, equal] | np.r_[equal, False]]  # keys of one row need no further look
        columns = [c[order] for c in columns]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])][: len(order)]
        return [c[new] for c in columns]

    for batch in batches:
        parts.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n > limit:  # copies found in many places: keep one of each
            table = [np.concatenate([p[i] for p in parts]) for i in range(4)]
            order = np.lexsort(table[::-1])
            table = [c[order] for c in table]
            new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in table])]
            parts = [[c[new] for c in table]]
            n, limit = int(new.sum()), max(limit, 2 * int(new.sum()))
    if n:
        columns = cells()
        first = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])][: len(columns[0])]
        size = np.diff(np.r_[np.flatnonzero(first), len(first)])
        keep = np.repeat(size > 1, size)
        if keep.any():
            table = pa.Table.from_arrays([pa.array(c[keep]) for c in columns], names=["key", "x", "y", "pid"])
            yield from table.to_batches(max_chunksize=1 << 16)
    give_back()


def _cells(distinct: DataFrame, sampled: DataFrame | None = None, bucket: int | None = None) -> DataFrame:
    """(key, x, y, pid): members by band, large buckets dealt out so that every two members meet in a cell; cells of
    a single member are left out. `sampled` has one in SAMPLE of the members, if they aren't to be read twice."""
    bucket = bucket or LARGE_BUCKET
    rows = distinct.select("pid", F.explode("bands").alias("key"))
    if sampled is None:
        sampled = distinct.where(F.pmod(F.xxhash64("pid"), F.lit(SAMPLE)) == 0)
    counts = sampled.distinct().select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    large = store(counts.where(F.col("n") > bucket // SAMPLE).select("key", F.ceil(F.col("n") * SAMPLE / (bucket // 2)).cast("int").alias("parts")), "large")
    some = large.count()
    if some:
        own = F.pmod(F.xxhash64("pid", F.lit(1)), "parts").cast("int")
        dealt = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y")))
        whole = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
        rows = rows.join(small(large, some), "key", "left")
        rows = rows.select("key", "pid", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(dealt)).alias("c")).select("key", "c.x", "c.y", "pid")
    else:
        rows = rows.select("key", F.lit(0).alias("x"), F.lit(0).alias("y"), "pid")
    limit = ROWS_IN_CELLS
    return rows.repartition("key", "x", "y").mapInArrow(lambda batches: _shared(batches, limit), "key long, x int, y int, pid long")


def similar_links(members: DataFrame, similarity: float, size: int) -> DataFrame:
    """Edges (a, b) between the texts of a cell, as many at most as members, that join what similarity joins.

    `members` has key, x and y (the cell), pid and the text in words; similarity is that of its shingles (in
    cells of over FEW members told apart by 64-bit hashes).
    """

    def compare(batches):
        for table in _grouped(batches, 3):
            bounds = _bounds(table, 3)
            pids, texts = table.column(3).to_numpy(), table.column(4)
            out = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if hi - lo > 1:
                    parts = [shingles(texts[i].as_py().lower().split(), size) for i in range(lo, hi)]
                    sets = [set(p) if hi - lo <= FEW else {xxhash.xxh3_64_intdigest(g) for g in p} for p in parts]
                    out += [(int(pids[lo + i]), int(pids[lo + j])) for i, j in _linked(sets, similarity)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], names=["a", "b"])
        give_back()

    return members.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(compare, "a long, b long")


def _linked(sets: list[set], similarity: float):
    """Links between sets that join what Jaccard similarity joins, as many at most as sets.

    Two sets that are similar enough share one of their rarest elements: if o of n are shared and o >= similarity * n,
    the n - o + 1 rarest of both do. So only sets that share such an element, and aren't linked yet, are compared.
    """
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if len(sets) <= FEW:
        for i, s in enumerate(sets):
            for j in range(i):
                if root(i) != root(j) and _similar(s, sets[j], similarity):
                    parent[root(i)] = root(j)
                    yield i, j
        return
    count: dict = {}
    for s in sets:
        for g in s:
            count[g] = count.get(g, 0) + 1
    holders: dict = {}  # for each element, those that have it among their rarest, by the root of their component
    held = [set() for _ in sets]  # for each root, the elements that it is found at
    for i, s in enumerate(sets):
        n = len(s) - ceil(similarity * len(s) - 1e-9) + 1
        rare = [g for g in sorted(s, key=lambda g: (count[g], g))[:n] if count[g] > 1]
        tried = set()
        for g in rare:
            for r in list(holders.get(g, ())):
                if r == root(i) or r not in holders[g]:  # linked, perhaps just now
                    continue
                for j in holders[g][r]:
                    if j not in tried:
                        tried.add(j)
                        if _similar(s, sets[j], similarity):
                            yield i, j
                            small, large = sorted((root(i), r), key=lambda x: len(held[x]))
                            parent[small] = large
                            for h in held[small]:
                                holders[h].setdefault(large, []).extend(holders[h].pop(small))
                            held[large] |= held[small]
                            break
        r = root(i)
        for g in rare:
            holders.setdefault(g, {}).setdefault(r, []).append(i)
        held[r].update(rare)


def _similar(a: set, b: set, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both)


def _joined(docs: DataFrame, asked: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """id, version, the other columns of `asked` (a row for each id and version) and text, of the rows it names; texts
    are shuffled only if `asked`, which holds `rows` paragraphs, is too large to be sent to every task."""
    named = small(asked.withColumnsRenamed({"id": _ID, "version": VERSION}), rows)
    same = F.col(id_col).eqNullSafe(F.col(_ID)) & (F.xxhash64(text_col) == F.col(VERSION))
    joined = docs.select(id_col, text_col).join(named, same)
    more = [c for c in asked.columns if c not in ("id", "version")]
    return joined.select(F.col(_ID).alias("id"), F.col(VERSION).alias("version"), *more, F.col(text_col).cast("binary").alias("text"))


def _bitmap(pids: DataFrame) -> np.ndarray:
    """BITMAP_BITS bits, of which those of `pids` are set: of one size however many there are, and 2^21 rows at most."""
    bit = F.col("pid").bitwiseAND(F.lit(BITMAP_BITS - 1))
    rows = pids.select(F.shiftright(bit, 6).alias("at"), F.expr(f"shiftleft(1L, cast(pid & 63 as int))").alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    for batch in rows.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint64)


def _words(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(pid, words) of the paragraphs `wanted` (pid). Texts aren't shuffled: paragraphs are cut once more, and those
    whose bit is set in a bitmap of what is wanted are joined (the fuller the bitmap, the more are joined in vain)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("binary").alias("text"))
    wide_rows(spark)
    bitmap = spark.sparkContext.broadcast(_bitmap(wanted))

    def run(batches):
        bits, low, six = bitmap.value, np.uint64(BITMAP_BITS - 1), np.uint64(6)
        for batch in batches:
            texts, known = batch.column(0), np.empty(0, np.uint64)
            for lo, cut in _cuts(texts):
                pids, at = np.unique(cut.digests(), return_index=True)
                hit = (bits[((pids & low) >> six).astype(np.int64)] >> (pids & np.uint64(63))) & np.uint64(1)
                pids, at = pids[hit == 1], at[hit == 1]
                known, new = _with(known, pids)
                pids, at = pids[new], at[new]
                data = cut.data.tobytes()
                a, b = cut.starts[cut.first[at]].tolist(), cut.ends[cut.first[at + 1] - 1].tolist()
                words = [b" ".join(data[x:y].lower().split()) for x, y in zip(a, b)]
                yield pa.RecordBatch.from_arrays([pa.array(pids.view(np.int64)), pa.array(words, pa.binary())], names=["pid", "words"])
        give_back()

    found = rows.mapInArrow(run, "pid long, words binary")
    out = store(found.join(small(wanted), "pid").dropDuplicates(["pid"]), "words")
    bitmap.unpersist()
    return out


_NEXT = [("before", "array<int>"), ("after", "array<int>"), ("starts", "array<int>"), ("ends", "array<int>")]


class _Groups:
    """Marked paragraphs (a list for each row: unit, removed, same, of) in runs of adjacent ones that are all removed,
    or all not, from the first to the last that is the same as the one it was matched with (all, if none is).

    For each run, by row and unit: row, removed, first and last (units), left and right (of at its ends).
    """

    def __init__(self, marks: pa.ListArray):
        values = marks.flatten()
        row = np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
        unit, removed, same = (values.field(n).to_numpy(zero_copy_only=False) for n in ("unit", "removed", "same"))
        order = np.lexsort((unit, row))
        row, unit, removed, same = row[order], unit[order], removed[order], same[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (unit[1:] != unit[:-1] + 1) | (removed[1:] != removed[:-1])][: len(row)]
        starts = np.flatnonzero(new)
        lasts = np.r_[starts[1:], len(row)][: len(starts)] - 1
        if len(starts):
            place = np.arange(len(row))
            low = np.minimum.reduceat(np.where(same, place, len(row)), starts)
            high = np.maximum.reduceat(np.where(same, place, -1), starts)
            starts, lasts = np.where(high >= 0, low, starts), np.where(high >= 0, high, lasts)
        self.row, self.removed, self.first, self.last = row[starts], removed[starts], unit[starts], unit[lasts]
        of = values.field("of")
        self.left, self.right = of.take(pa.array(order[starts])), of.take(pa.array(order[lasts]))


def _partners(marked: DataFrame) -> DataFrame:
    """(id, version, unit): the paragraphs that the ends of runs were matched with."""
    place = marked.schema["units"].dataType.elementType["of"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            groups = _Groups(batch.column(0))
            for of in (groups.left, groups.right):
                yield pa.RecordBatch.from_arrays([of], names=["of"])
        give_back()

    return marked.select("units").mapInArrow(run, f"of {place}").select("of.*").distinct()


def _listed(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, step: int = 1) -> pa.ListArray:
    """For each start, so many values from there on (in steps of 1 or -1), as lists of integers."""
    ends = np.cumsum(counts)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    items = values[np.repeat(starts, counts) + step * within].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(items))


def _runs(docs: DataFrame, marked: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Of the paragraphs `marked` (id, version, units: unit, removed, same, of; asked: units) two kinds of rows.

    Without unit: a run (see `_Groups`): its words first to last - 1, left and right (the places that the paragraphs
    at its ends were matched with), hashes of the words before and after it, outwards (before, after), and the
    characters where it starts and ends for each number of these that it takes in (starts, ends). With unit: a
    paragraph asked for, and hashes of the words before and after it.
    """
    joined = _joined(docs, marked, rows, id_col, text_col)
    place = marked.schema["units"].dataType.elementType["of"].dataType.simpleString()
    id_type = marked.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, version long, unit int, removed boolean, first int, last int, left {place}, right {place}, " + ", ".join(f"{n} {t}" for n, t in _NEXT)

    def run(batches):
        names = ["id", "version", "unit", "removed", "first", "last", "left", "right", *[n for n, _ in _NEXT]]
        lists = pa.list_(pa.int32())
        for batch in batches:
            ids, versions, marks, asked, texts = batch.columns
            groups = _Groups(marks)
            asked_row = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
            asked_unit = asked.flatten().to_numpy()
            for lo, cut in _cuts(texts):
                n = len(cut.of_text) - 1
                short = (cut.hashes >> np.uint64(33)).astype(np.int32)
                begins = np.searchsorted(cut.text, np.arange(n + 1))
                chars = np.r_[0, np.cumsum((cut.data & 0xC0) != 0x80)]

                def around(row, first, last, together):
                    """Words of the paragraphs first to last of a text, and the words before and after them that are looked at."""
                    at, end = begins[row] + first, begins[row] + last + 1
                    a, b = cut.first[at], cut.first[end]
                    low = a - np.where(first > 0, a - cut.first[np.maximum(at - 1, 0)], 0) - REACH - 2
                    high = b + np.where(end < begins[row + 1], cut.first[np.minimum(end + 1, len(cut.first) - 1)] - b, 0) + REACH + 2
                    least, most = cut.of_text[row], cut.of_text[row + 1]
                    if together and len(row):  # not beyond the runs before and after
                        same = row[1:] == row[:-1]
                        least = np.r_[least[:1], np.where(same, b[:-1], least[1:])]
                        most = np.r_[np.where(same, a[1:], most[:-1]), most[-1:]]
                    return a, b, np.maximum(low, least), np.minimum(high, most)

                lo_run, hi_run = np.searchsorted(groups.row, [lo, lo + n])
                if hi_run > lo_run:
                    row = groups.row[lo_run:hi_run] - lo
                    a, b, low, high = around(row, groups.first[lo_run:hi_run], groups.last[lo_run:hi_run], True)
                    zero, shift = cut.of_text[row], chars[cut.offsets[row]]
                    starts, ends = (_listed(chars[w], s, c, d) for w, s, c, d in ((cut.starts, a, a - low + 1, -1), (cut.ends, b - 1, high - b + 1, 1)))
                    starts, ends = (pa.ListArray.from_arrays(x.offsets, pa.array(x.values.to_numpy() - np.repeat(shift, np.diff(x.offsets.to_numpy())).astype(np.int32))) for x in (starts, ends))
                    at, size = pa.array(row + lo), hi_run - lo_run
                    yield pa.RecordBatch.from_arrays([
                        ids.take(at), versions.take(at), pa.nulls(size, pa.int32()), pa.array(groups.removed[lo_run:hi_run]), pa.array((a - zero).astype(np.int32)), pa.array((b - zero).astype(np.int32)),
                        groups.left.slice(lo_run, size), groups.right.slice(lo_run, size), _listed(short, a - 1, a - low, -1), _listed(short, b, high - b), starts, ends,
                    ], names=names)
                lo_ask, hi_ask = np.searchsorted(asked_row, [lo, lo + n])
                if hi_ask > lo_ask:
                    row, unit, size = asked_row[lo_ask:hi_ask] - lo, asked_unit[lo_ask:hi_ask], hi_ask - lo_ask
                    a, b, low, high = around(row, unit, unit, False)
                    at, none, ints = pa.array(row + lo), pa.nulls(size, groups.left.type), pa.nulls(size, pa.int32())
                    yield pa.RecordBatch.from_arrays([
                        ids.take(at), versions.take(at), pa.array(unit), pa.nulls(size, pa.bool_()), ints, ints, none, none,
                        _listed(short, a - 1, a - low, -1), _listed(short, b, high - b), pa.nulls(size, lists), pa.nulls(size, lists),
                    ], names=names)
        give_back()

    return joined.select("id", "version", "units", F.coalesce("asked", F.array().cast("array<int>")).alias("asked"), "text").mapInArrow(run, schema)


def _alike(a, b):
    """Column: how many leading elements of two arrays are equal."""
    equal = F.transform(F.arrays_zip(a.alias("p"), b.alias("q")), lambda x: F.coalesce(x["p"] == x["q"], F.lit(False)))
    return (F.array_position(F.concat(equal, F.array(F.lit(False))), False) - 1).cast("int")


def repeated(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    size: int = SHINGLE,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    scratch: list[DataFrame] | None = None,
) -> DataFrame:
    """Every span of text that repeats: id_col, version (hash of the text), start and length (characters of the
    text), n_words, class_id (the document whose text it was matched with) and removed.

    Paragraphs are pieces of the whole text's words, wherever lines end (see the module). Two are linked if the
    Jaccard similarity of their `size`-word shingles is `similarity` or more (words are what white space of ASCII
    parts, A-Z in lower case), and a class is what links reach. The first occurrence stays, by id (null last), text
    hash and place; class_id of a removal is its id, and that of what stays is the id of the last occurrence.
    Removals that adjoin, or lie GAP words apart at most, are one span, whose ends are those of exact copies, moved
    out to where the text differs from the one it was matched with (no further than the adjoining paragraph and
    REACH + 2 words, which is as far as copies can be cut differently); if it has no exact copy, those of its paragraphs. Spans of fewer than `min_words` words are not returned.

    Rows that repeat id and text count as one document. Null and empty texts have no paragraphs; an empty table
    gives an empty result. A run of over 50 words that repeats exactly is found with the chance that REACH states, a
    longer one more surely; banding finds two paragraphs that are just similar enough with a chance of RECALL, and
    more similar ones more surely. Two different paragraphs have the same digest of 64 bits with a chance of 2^-64.
    Other columns are not read. The tables that the result is read from are added to `scratch`.
    """
    docs = docs.select(id_col, text_col)
    n_bands = bands(similarity, RECALL, PARAGRAPH_ROWS)
    units = store(paragraphs(docs, id_col, text_col), "units")
    cells = store(_cells(signatures(docs, n_bands, size, text_col), signatures(docs, n_bands, size, text_col, SAMPLE), LARGE_PARAGRAPH_BUCKET), "cells")
    wanted = store(cells.select("pid").distinct(), "wanted")
    texts = _words(docs, wanted, text_col)
    found = components(similar_links(cells.join(texts, "pid").select("key", "x", "y", "pid", "words"), similarity, size))
    drop(cells, wanted, texts)
    members = found.select("node", "root").union(found.select("root", "root").distinct())
    twins = units.groupBy("pid").agg(F.count("*").alias("n")).where("n > 1").select("pid")
    known = twins.join(members, F.col("pid") == F.col("node"), "full").select(F.coalesce("pid", "node").alias("pid"), F.coalesce("root", "pid").alias("root"))
    known = store(known, "known")
    again = store(units.join(small(known), "pid").select("id", "version", "unit", "pid", "root"), "again")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "version", "unit", "pid")
    classes = store(again.groupBy("root").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most"), "classes")
    of = F.when(F.col("removed"), F.col("least")).otherwise(F.col("most"))
    marks = again.join(small(classes), "root").withColumn("removed", place != F.col("least"))
    marks = marks.withColumn("of", of)
    mark = F.struct("unit", "removed", (F.col("pid") == F.col("of.pid")).alias("same"), F.struct("of.id", "of.version", "of.unit").alias("of"))
    marked = store(marks.groupBy("id", "version").agg(F.collect_set(mark).alias("units")), "marked")
    asked = _partners(marked).groupBy(F.col("id").alias(_ID), F.col("version").alias(VERSION)).agg(F.collect_list("unit").alias("asked"))
    same = F.col("id").eqNullSafe(F.col(_ID)) & (F.col("version") == F.col(VERSION))
    every, marked = marked, store(marked.join(asked, same, "left").select("id", "version", "units", "asked"), "marked")
    twice = not units.where("unit = 0").groupBy("id", "version").count().where("count > 1").isEmpty()
    n_marks = marked.agg(F.coalesce(F.sum(F.size("units")), F.lit(0))).first()[0]
    drop(units, found, known, again, classes, every)
    pieces = store(_runs(docs, marked, n_marks, id_col, text_col), "pieces")
    runs = pieces.where("unit is null").drop("unit")
    around = pieces.where("unit is not null").select("id", "version", "unit", "before", "after")
    if twice:
        runs, around = runs.dropDuplicates(["id", "version", "first"]), around.dropDuplicates(["id", "version", "unit"])
    around = small(store(around, "around"))
    runs = runs.select(F.col("id").alias(_ID), F.col("version").alias(VERSION), "removed", "first", "last", "left", "right", *[F.col(n).alias("own_" + n) for n, _ in _NEXT])
    for side, words, reach in (("left", "before", "more"), ("right", "after", "on")):
        there = around.select("id", "version", "unit", words)
        same = F.col("id").eqNullSafe(F.col(side + ".id")) & (F.col("version") == F.col(side + ".version")) & (F.col("unit") == F.col(side + ".unit"))
        runs = runs.join(there, same).withColumn(reach, _alike(F.col("own_" + words), F.col(words))).drop("id", "version", "unit", words)
    spans = store(runs.select(
        F.col(_ID).alias("id"), F.col(VERSION).alias("version"), "removed", (F.col("first") - F.col("more")).alias("a"), (F.col("last") + F.col("on")).alias("b"),
        F.element_at("own_starts", F.col("more") + 1).alias("start"), F.element_at("own_ends", F.col("on") + 1).alias("end"), F.col("left.id").alias("class_id"),
    ), "spans")
    order = Window.partitionBy("id", "version", "removed").orderBy("a", "b")
    until = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce((F.col("a") - until > GAP).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("id", "version", "removed", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("b") - F.min("a")).alias("n_words"), F.min(F.struct("a", "class_id")).alias("of")
    )
    out = store(whole.where(F.col("n_words") >= min_words).select(
        F.col("id").alias(id_col), "version", F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start")).cast("long").alias("length"),
        F.col("n_words").cast("long").alias("n_words"), F.col("of.class_id").alias("class_id"), "removed",
    ), "repeated")
    drop(marked, pieces, around, spans)
    if scratch is not None:
        scratch.append(out)
    return out


def remove(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the characters that `found` (see `repeated`) marks as removed; documents of which no word is
    left go, unless they had none before. Other columns stay as they are, whatever they are called."""
    span = F.struct(F.col("start").cast("int").alias("a"), (F.col("start") + F.col("length")).cast("int").alias("b"))
    gone = found.where("removed").groupBy(F.col(id_col).alias(_ID), F.col("version").alias(VERSION)).agg(F.array_sort(F.collect_set(span)).alias(_GONE))
    gone = store(gone, "gone")
    many = gone.agg(F.coalesce(F.sum(F.size(_GONE) + 1), F.lit(0))).first()[0]
    same = F.col(id_col).eqNullSafe(F.col(_ID)) & (F.xxhash64(text_col) == F.col(VERSION))
    joined = docs.join(small(gone, many // 2), same, "left")

    def rest(text, spans):
        out, at = [], 0
        for s in spans:
            out.append(text[at : s["a"]])
            at = max(at, s["b"])
        return "".join(out) + text[at:]

    names = docs.columns
    place = names.index(text_col)

    def run(batches):
        for batch in batches:
            spans = batch.column(len(names))
            if spans.null_count == batch.num_rows:
                yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names)
                continue
            spans = spans.to_pylist()
            texts = [t.as_py() if s is None else rest(t.as_py(), s) for t, s in zip(batch.column(place), spans)]
            keep = pa.array([s is None or bool(t.encode().split()) for t, s in zip(texts, spans)])
            columns = [pa.array(texts, batch.schema.field(i).type) if i == place else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)
        give_back()

    return joined.select(*[F.col(f"`{c}`") for c in names], _GONE).mapInArrow(run, docs.schema)
