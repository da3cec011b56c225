"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Fingerprints of 64 bits are linked when they differ in few bits. The index is a forest over all distinct
fingerprints: an uppermost node is a masked bit pattern (`masks`) that its members share, members stand in
the order of their Gray rank, and every node above them holds the bits on which all its members agree.
Two nodes whose agreed bits already differ in more than `radius` places are pruned with all they hold.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .paragraphs import _band_keys, _bounds, _cells, _grouped, bands, shingles, similar_links
from .shared import VERSION, drop, give_back, small, store, wide_rows, without

#: Children of an index node.
FAN_OUT = 8
#: Members of an uppermost node beyond which it is split into cells, each task getting two parts of it.
LARGE_NODE = 1024
#: Texts of a class of candidates in a part of it; every two parts are compared in a task.
TEXTS_IN_PART = 256
#: Distinct fingerprints whose pairs are searched at once in a task, as the sum of squares over nodes.
PAIRS_AT_ONCE = 1 << 22
ROWS_AT_ONCE = 1 << 16
HASHES_AT_ONCE = 1 << 16


def fingerprint(data: bytes | None, size: int, seed: int = 42) -> int:
    """SimHash of one text: bit i is set if it is set in over half of the shingles' XXH64; 0 without words."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= size:
        return xxhash.xxh64_intdigest(text, seed)
    starts, lasts = [0, *ends], ends[size - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(lasts), HASHES_AT_ONCE):
        part = lasts[k : k + HASHES_AT_ONCE]
        hashes = np.array([digest(text[s : e - 1], seed) for s, e in zip(starts[k:], part)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    over = (2 * ones > len(lasts)).astype(np.uint8)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, version, fp): the SimHash of every row's whole text over word shingles of `size` words.

    Words are what white space of ASCII parts, A-Z in lower case. A text of fewer words than `size` is one
    shingle; a null, empty or blank text has fingerprint 0. Rows stay as they are, null ids and repeated
    rows too. version is a hash of the text, which tells rows that share an id apart.
    """
    wide_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("version"), F.col(text_col).cast("binary").alias("_text"))
    id_type = docs.select(id_col).schema[0].dataType

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], names=[id_col, "version", "fp"])
        give_back()

    return rows.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, version long, fp long")


def masks(n: int, radius: int) -> list[int]:
    """Masks of the uppermost nodes, such that fingerprints within `radius` bits agree on one mask at least.

    The 64 bits are cut into m segments, a mask joins m - radius of them: differences can touch `radius`
    segments at most. m is the one of least expected work over n fingerprints: a row for each mask and
    fingerprint, and the pairs within the nodes. Every choice finds all links.
    """
    if not 0 <= radius < 64:
        raise ValueError("radius must be from 0 to 63")
    best = None
    for m in range(radius + 1, min(64, radius + 4) + 1):
        count = comb(m, radius)
        bits = 64 * (m - radius) // m
        work = count * n * (1.0 + 0.004 * n / 2.0 ** (bits + 1))
        if best is None or work < best[0]:
            best = (work, m)
    m = best[1]
    edges = [64 * i // m for i in range(m + 1)]
    segments = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [sum(s) for s in combinations(segments, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp):
    """Column: the place of a 64-bit code in Gray order (as a long; the upper half sorts first)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _levels(cell: np.ndarray, fps: np.ndarray) -> list[tuple]:
    """The index over rows sorted by cell and Gray rank: per level (agreed bits, mask, first child, children)."""
    levels = [(fps, np.full(len(fps), ~np.uint64(0)), None, None)]
    while True:
        pattern, mask = levels[-1][:2]
        first = np.r_[True, cell[1:] != cell[:-1]]
        if first.all():
            return levels
        place = np.arange(len(cell)) - np.maximum.accumulate(np.where(first, np.arange(len(cell)), 0))
        starts = np.flatnonzero(place % FAN_OUT == 0)
        ones, some = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
        agreed = np.bitwise_and.reduceat(mask, starts) & ~(ones ^ some)
        levels.append((ones & agreed, agreed, starts, np.diff(np.r_[starts, len(cell)])))
        cell = cell[starts]


def _close_pairs(cell: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of rows in one cell that differ in `radius` bits at most, by descent from the roots."""
    levels = _levels(cell, fps)
    a = b = np.arange(len(levels[-1][0]))
    for k in range(len(levels) - 1, 0, -1):
        pattern, mask, starts, counts = levels[k]
        apart = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b])
        a, b = a[apart <= radius], b[apart <= radius]
        each = counts[a] * counts[b]
        pair = np.repeat(np.arange(len(a)), each)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
        a, b, wide = a[pair], b[pair], counts[b[pair]]
        left, right = starts[a] + within // wide, starts[b] + within % wide
        once = left < right if k == 1 else left <= right
        a, b = left[once], right[once]
    if len(levels) == 1:
        return a[:0], b[:0]
    near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    return a[near], b[near]


def _stars(cell: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the rows to the first row of their component within the cell; as many at most as rows."""
    a, b = _close_pairs(cell, fps, radius)
    label = np.arange(len(fps))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) whose components are those of all links between distinct fingerprints `fp` of `fps`.

    A node's members are linked by stars and not by all pairs. A node with over LARGE_NODE members is dealt
    to several tasks: each gets the members of two of its parts, so that every two members meet in one.
    """
    n = fps.count()
    tops = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks(n, radius))])
    rows = fps.select("fp", F.explode(tops).alias("top")).select("fp", "top.t", F.col("fp").bitwiseAND(F.col("top.mask")).alias("key"))
    large = store(rows.groupBy("t", "key").agg(F.count("*").alias("members")).where(F.col("members") > LARGE_NODE), "large")
    some = large.count()
    if some:
        large = F.broadcast(large) if some <= 100_000 else large
        parts = F.ceil(F.col("members") / (LARGE_NODE // 2)).cast("int")
        own = F.pmod(F.xxhash64("fp"), parts).cast("int")
        cells = F.when(F.col("members").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(
            F.transform(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1), lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y")))
        )
        rows = rows.join(large, ["t", "key"], "left").select("t", "key", "fp", F.explode(cells).alias("c")).select("t", "key", "c.x", "c.y", "fp")
    else:
        rows = rows.select("t", "key", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp")
    ordered = (
        rows.withColumn("rank", gray_rank(F.col("fp")))
        .repartition("t", "key", "x", "y")
        .sortWithinPartitions("t", "key", "x", "y", "rank")
        .select("t", "key", "x", "y", "fp")
    )

    def search(table: pa.Table):
        columns = [table.column(i).to_numpy() for i in range(4)]
        fp = table.column(4).to_numpy().view(np.uint64)
        first = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]
        cell = np.cumsum(first) - 1
        sizes = np.bincount(cell)
        group = np.cumsum(sizes.astype(np.int64) ** 2) // PAIRS_AT_ONCE
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        starts = np.flatnonzero(first)
        for lo, hi in zip(starts[cuts], [*starts[cuts[1:]], len(fp)]):
            a, b = _stars(cell[lo:hi], fp[lo:hi], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches):
        kept = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            kept = new if kept is None else pa.concat_tables([kept, new])
            if kept.num_rows < ROWS_AT_ONCE:
                continue
            kept = kept.combine_chunks()
            cols = [kept.column(i).to_numpy() for i in range(4)]
            last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from search(kept.slice(0, cut))
                kept = kept.slice(cut)
        if kept is not None and kept.num_rows:
            yield from search(kept.combine_chunks())
        give_back()

    return ordered.mapInArrow(run, "a long, b long")


def _members(found: DataFrame) -> DataFrame:
    """(fp, root) of every fingerprint in a component of several, roots too."""
    return found.select(F.col("node").alias("fp"), "root").union(found.select("root", "root").distinct())


def _by_fingerprint(groups: DataFrame, found: DataFrame, first: str) -> DataFrame:
    """(fp, first): the least `first` of each fingerprint's component, written so that a join can split hot fingerprints."""
    member = _members(found)
    least = member.join(groups, "fp").groupBy("root").agg(F.min(first).alias("least"))
    of = member.join(least, "root").select("fp", "least")
    return store(groups.join(of, "fp", "left").select("fp", F.coalesce("least", first).alias(first)), "known")


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, fp (long), component_id.

    Rows are linked if their fingerprints (see `fingerprints`) differ in `radius` bits at most; component_id
    is the least id of the rows that links reach, itself included. Null ids take part but are never a
    component_id, unless a component has no other. Repeated rows are linked as any other; an empty table
    gives an empty result. Other columns of `docs` are not read.
    """
    rows = store(fingerprints(docs, size, id_col, text_col).drop("version"), "fingerprints")
    groups = store(rows.groupBy("fp").agg(F.min(id_col).alias("component_id")), "groups")
    known = _by_fingerprint(groups, components(links(groups.select("fp"), radius)), "component_id")
    return rows.join(known, "fp").select(F.col(id_col), "fp", "component_id")


def _signatures(docs: DataFrame, fine: int, size: int, n_bands: int, id_col: str, text_col: str) -> DataFrame:
    """(id_col, version, fp, digest, bands) of every row: `fingerprints` over `fine` words, a digest of the exact
    words (A-Z in lower case), and MinHash band keys of the set of `size`-word shingles."""
    wide_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("version"), F.col(text_col).cast("binary").alias("_text"))
    id_type = docs.select(id_col).schema[0].dataType

    def run(batches):
        for batch in batches:
            done, hashes, starts, found = 0, [], [], []
            for i, t in enumerate(batch.column(2)):
                data = t.as_py()
                words = (data or b"").lower().split()
                starts.append(len(hashes))
                hashes += [xxhash.xxh3_64_intdigest(s) for s in shingles(words, size)]
                found.append((fingerprint(data, fine), xxhash.xxh3_128_digest(b" ".join(words))))
                if len(hashes) < HASHES_AT_ONCE and i + 1 < batch.num_rows:
                    continue
                keys = _band_keys(np.array(hashes, np.uint64), np.array(starts), n_bands)
                offsets = np.arange(len(found) + 1, dtype=np.int32) * n_bands
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))
                fps = pa.array(np.array([f for f, _ in found], np.uint64).view(np.int64))
                ids = [c.slice(done, len(found)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*ids, fps, pa.array([d for _, d in found], pa.binary()), lists], names=[id_col, "version", "fp", "digest", "bands"])
                done, hashes, starts, found = i + 1, [], [], []
        give_back()

    return rows.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, version long, fp long, digest binary, bands array<bigint>")


def _fingerprint_cells(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(key, x, y, pid): all texts whose fingerprints are in one component, large ones dealt so that every two texts meet."""
    member = store(groups.select("fp", "pid").join(store(_members(found), "members"), "fp", "left").select(F.coalesce("root", "fp").alias("key"), "pid"), "members")
    sizes = member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / TEXTS_IN_PART).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("pid"), "parts").cast("int")
    dealt = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y")))
    return member.join(small(store(sizes, "sizes")), "key").select("key", "pid", F.explode(dealt).alias("c")).select("key", "c.x", "c.y", "pid")


def _band_cells(groups: DataFrame) -> DataFrame:
    """(key, x, y, pid): texts that share a MinHash band; key is a hash of a cell's members, so that equal cells are one."""

    def named(batches):
        for table in _grouped(batches, 3):
            bounds, pids = _bounds(table, 3), table.column(3).to_numpy()
            keys = np.empty(len(pids), np.int64)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                keys[lo:hi] = xxhash.xxh3_64_intdigest(np.sort(pids[lo:hi]).tobytes()) - (1 << 63)
            zero = pa.array(np.zeros(len(pids), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys), zero, zero, pa.array(pids)], names=["key", "x", "y", "pid"])
        give_back()

    return _cells(groups.select("pid", "bands")).mapInArrow(named, "key long, x int, y int, pid long")


def _verified(docs: DataFrame, groups: DataFrame, cells: DataFrame, size: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Edges between texts (pid) that meet in a cell and whose shingles are similar enough."""
    asked = store(cells.select("pid").distinct(), "asked")
    wanted = small(store(groups.join(small(asked), "pid").select("pid", F.col("first.id").alias("_id"), F.col("first.version").alias("_version")), "wanted"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_version")))
    texts = store(texts.select("pid", F.coalesce("text", F.lit("")).cast("binary").alias("words")).dropDuplicates(["pid"]), "texts")
    return similar_links(cells.join(texts, "pid").select("key", "x", "y", "pid", "words"), similarity, size)


def deduplicate(
    docs: DataFrame,
    similarity: float = 0.8,
    size: int = 5,
    fine: int = 2,
    radius: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`docs` with one row of each class of near duplicates, all columns as they are.

    Candidates are texts whose fingerprints over shingles of `fine` words differ in `radius` bits at most, and
    texts that share a MinHash band of their `size`-word shingles, which finds a pair that is just similar
    enough with a chance of paragraphs.RECALL whatever the edit and the length. Texts of the same words (A-Z
    in lower case) are one; two candidates are linked if the exact Jaccard similarity of their `size`-word shingles is `similarity` or
    more, whether their fingerprints are equal or not. The first of a class stays, by id (null last) and hash of the
    text; rows that repeat both are one. Texts without words are one class, null or not.
    """
    rows = store(_signatures(docs, fine, size, bands(similarity), id_col, text_col), "fingerprints")
    place = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "version")
    groups = rows.groupBy("digest").agg(F.min(place).alias("first"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    groups = store(groups.withColumn("pid", F.monotonically_increasing_id()), "groups")
    near = components(links(groups.select("fp").distinct(), radius))
    cells = store(_fingerprint_cells(groups, near).union(_band_cells(groups)).distinct(), "cells")
    same = components(_verified(docs, groups, cells, size, similarity, id_col, text_col))
    labelled = store(groups.select("pid", "digest", "first").join(same, F.col("pid") == F.col("node"), "left").select("digest", "first", F.coalesce("root", "pid").alias("root")), "labelled")
    least = store(labelled.groupBy("root").agg(F.min("first").alias("least")), "least")
    known = store(labelled.select("digest", "root").join(least, "root").select("digest", F.col("least").alias("first")), "known")
    gone = store(rows.select(id_col, "version", "digest").join(known, "digest").where(place != F.col("first")).select(id_col, "version").distinct(), "gone")
    twice = store(rows.groupBy(id_col, "version").count().where("count > 1").select(id_col, "version"), "twice")
    drop(rows, groups, near, cells, same, labelled, least, known)
    kept = without(docs, gone, id_col, text_col)
    if not twice.count():
        return kept
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = without(kept, twice, id_col, text_col, "left_semi").withColumn(VERSION, F.xxhash64(text_col)).dropDuplicates([id_col, VERSION])
    return without(kept, twice, id_col, text_col).union(again.select(*columns))


def fingerprint_text(fp):
    """Column: a fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
