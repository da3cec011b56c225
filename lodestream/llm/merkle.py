"""Merkle manifest of a dataset: a digest of all rows, and for every row a proof that it belongs to them.

Rows are leaves; a part (say, a language) is a tree over its leaves in order, and the roots of the parts are the
leaves of one more tree. Every FANOUT consecutive nodes of a level become their digest, the last run with fewer.
Leaves are numbered by a range sort and gathered in aligned blocks of a fixed number. Within a block the paths of
successive leaves come from a fractal traversal: of each band of levels the subtree over the present leaf exists,
and the one that follows is built meanwhile, a leaf a step, so that memory is a few subtrees whatever the block. The
tree above the blocks is built level by level with grouped rows, and its proofs are appended to those of the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, give_back, settings, small, store

FANOUT = 8
#: Levels of a block, which has FANOUT ** BLOCK_LEVELS leaves, and of a band of its traversal.
BLOCK_LEVELS = 4
BAND = 2
#: Rows with paths (3 kB at most each) up to which a table is sent to every task: 12 MB.
PATH_ROWS = 4_000
_PROOFS = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """Digest of the fields: `-` for null, else byte count, `:` and the value as text."""
    texts = [f.cast("string") for f in fields]
    coded = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


class Subtree:
    """The nodes of the levels from `low` to `top` over leaves that are pushed in order; lower ones are only passed through."""

    def __init__(self, low: int, top: int):
        self.low, self.top = low, top
        self.nodes: list[list[str]] = [[] for _ in range(low, top + 1)]
        self.open: list[list[str]] = [[] for _ in range(top)]

    def _put(self, level: int, node: str) -> bool:
        """Whether this completes a run."""
        if level >= self.low:
            self.nodes[level - self.low].append(node)
        if level == self.top:
            return False
        self.open[level].append(node)
        return len(self.open[level]) == FANOUT

    def _close(self, level: int) -> str:
        node = digest("".join(self.open[level]))
        self.open[level].clear()
        return node

    def push(self, node: str) -> None:
        level = 0
        while self._put(level, node):
            node = self._close(level)
            level += 1

    def finish(self) -> None:
        """Runs with fewer nodes, at the end of the leaves, become nodes too."""
        for level in range(self.top):
            if self.open[level]:
                self._put(level + 1, self._close(level))


def block_root(leaves: list[str], height: int) -> str:
    whole = Subtree(height, height)
    for x in leaves:
        whole.push(x)
    whole.finish()
    return whole.nodes[-1][0]


def traverse(leaf_at: Callable[[int], str], n: int, height: int, band: int = BAND) -> Iterator[list[tuple[str, str]]]:
    """Authentication paths of leaves 0 .. n - 1 in order: per level, from the leaf up, the run's digests to its left and right."""
    tops = [*range(band, height, band), height] if height else []

    def new(i):
        return Subtree(tops[i - 1] if i else 0, tops[i])

    existing, desired = [new(i) for i in range(len(tops))], [new(i) for i in range(len(tops))]
    for tree in existing:
        for r in range(min(n, FANOUT**tree.top)):
            tree.push(leaf_at(r))
        tree.finish()
    for r in range(n):
        path = []
        for i, top in enumerate(tops):
            span = FANOUT**top
            if r and r % span == 0:  # the present subtree is used up: the desired one takes its place
                desired[i].finish()
                existing[i], desired[i] = desired[i], new(i)
            tree = existing[i]
            for level in range(tree.low, top):
                at = r % span // FANOUT**level
                nodes, first = tree.nodes[level - tree.low], at - at % FANOUT
                path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + FANOUT])))
        yield path
        for i, top in enumerate(tops):
            if (ahead := r + FANOUT**top) < n:
                desired[i].push(leaf_at(ahead))


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its path lead to."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def _few(df: DataFrame) -> DataFrame:
    """`df`, whose rows hold paths, to be sent to every task if it has PATH_ROWS rows at most."""
    return F.broadcast(df) if df.limit(PATH_ROWS + 1).count() <= PATH_ROWS else df


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` (with column part) stored once, with rank (from 0 within a part) and n, the part's rows.

    A range sort gives every partition consecutive rows; those before it are counted per partition and part.
    """
    kept = store(rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    p = F.shiftright("_m", 33)
    counts = kept.groupBy("part", p.alias("_p")).agg(F.min("_m").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("part")  # a row a partition
    before = F.sum("_rows").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    counts = store(counts.select("part", "_p", "_first", before.alias("_before"), F.sum("_rows").over(whole).alias("n")), "counts")
    found = kept.withColumn("_p", p).join(small(counts), ["part", "_p"])
    return found.withColumn("rank", F.col("_before") + F.col("_m") - F.col("_first")).drop("_m", "_p", "_first", "_before")


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots and proofs of trees whose leaves are rows: (part, idx from 0, node, n), n being the part's rows.

    Returns (part, root) and (part, idx, path): the path has, from the leaf up, the digests to the left and right.
    """
    runs, tops, now = [], [], nodes.select("part", "idx", "node", "n")
    while True:
        tops.append(now.where("n = 1").select("part", "idx", "node"))
        more = now.where("n > 1")
        if more.isEmpty():
            break
        members = F.array_sort(F.collect_list(F.struct("idx", "node")))
        grouped = more.groupBy("part", "n", F.expr(f"idx div {FANOUT}").alias("run")).agg(members.alias("m"))
        runs.append(store(grouped.select("part", "n", "run", F.expr("transform(m, x -> x.node)").alias("m")), "runs"))
        now = runs[-1].select("part", F.col("run").alias("idx"), F.sha2(F.array_join("m", "").cast("binary"), 256).alias("node"), F.ceil(F.col("n") / FANOUT).alias("n"))
    kind = "array<struct<l string, r string>>"
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.union(t)

    def ends(level):
        return tops[level].select("part", "idx", F.from_json(F.lit("[]"), kind).alias("path"))

    paths = ends(len(runs))
    for level in range(len(runs) - 1, -1, -1):
        members = runs[level].select("part", "run", "m", F.posexplode("m").alias("at", "node"))
        own = F.struct(F.array_join(F.expr("slice(m, 1, at)"), "").alias("l"), F.array_join(F.expr(f"slice(m, at + 2, {FANOUT})"), "").alias("r"))
        above = paths.withColumnRenamed("idx", "run")
        here = members.join(above, ["part", "run"]).select("part", (F.col("run") * FANOUT + F.col("at")).alias("idx"), F.concat(F.array(own), "path").alias("path"))
        paths = here.union(ends(level))
    return roots.select("part", F.col("node").alias("root")), paths


def prove(docs: DataFrame, fields: tuple[str, ...], by: str, order: str, altered: Column | None = None) -> DataFrame:
    """Every row's digest, its part's and the whole manifest's root, and its proof: doc_id (the column `order`), leaf,
    subroot, root, proof_sha256 (of all siblings, from the leaf up), folded_root and verified.

    A part is a value of `by` (null is one, the first); its leaves ascend by `order` (null first), ties by digest,
    so that repeated rows are leaves each. folded_root is what the original siblings make of the digest `altered` where
    that isn't null, else of the leaf; verified says whether it is the root. Other columns, whatever their names, don't
    matter; texts are hashed whole, where they lie, and digests are all that is shuffled. An empty table gives no rows.
    """
    part = F.when(F.col(by).isNull(), "").otherwise(F.concat(F.lit("="), F.col(by).cast("string")))
    other = F.lit(None).cast("string") if altered is None else altered
    hashed = store(docs.select(part.alias("part"), F.col(order).alias("id"), leaf(*[F.col(c) for c in fields]).alias("leaf"), other.alias("other")), "leaves")
    ranked = _ranked(hashed, "id", "leaf")
    size = FANOUT**BLOCK_LEVELS
    height = F.least(F.lit(BLOCK_LEVELS), F.size(F.filter(F.array(*[F.lit(FANOUT**k).cast("long") for k in range(BLOCK_LEVELS)]), lambda x: x < F.col("n"))))
    entry = F.struct("rank", "id", "leaf", "other")
    gathered = ranked.groupBy("part", F.expr(f"rank div {size}").alias("block"), "n").agg(F.array_sort(F.collect_list(entry)).alias("entries"))  # `size` at most
    gathered = gathered.select("part", "block", F.ceil(F.col("n") / size).alias("n_blocks"), height.cast("int").alias("height"), F.expr("transform(entries, x -> struct(x.id, x.leaf, x.other))").alias("entries"))
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}):
        blocks = store(gathered.mapInArrow(_rooted, f"{_ddl(gathered)}, node string"), "blocks")
        subroots, upper = tree(blocks.select("part", F.col("block").alias("idx"), "node", F.col("n_blocks").alias("n")))
        subroots = store(subroots.select(F.lit("").alias("part"), F.col("part").alias("name"), F.col("root").alias("node")), "subroots")
        numbered = store(_ranked(subroots, "name").withColumnRenamed("rank", "idx"), "parts")
        root, over = tree(numbered)
        top = root.first()  # of one tree: a digest, or none without rows
        parts = numbered.join(_few(over.drop("part")), "idx")
        parts = parts.select(F.col("name").alias("part"), F.col("node").alias("subroot"), F.lit(top and top["root"]).cast("string").alias("root"), F.col("path").alias("over"))
        paths = upper.join(_few(parts), "part").select("part", F.col("idx").alias("block"), F.concat("path", "over").alias("path"), "subroot", "root")
        kept = store(paths, "paths")
        out = blocks.select("part", "block", "height", "entries").join(_few(kept), ["part", "block"])
        out = out.select("height", "entries", "path", "subroot", "root")
        proofs = store(out.mapInArrow(_proofs, _PROOFS.format(dict(hashed.dtypes)["id"])), "proofs")
    drop(hashed, blocks, subroots, numbered, kept)
    return proofs


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def _rooted(batches):
    """Blocks with their roots."""
    for batch in batches:
        heights, entries = (batch.column(batch.schema.get_field_index(c)) for c in ("height", "entries"))
        roots = [block_root(entries[i].values.field("leaf").to_pylist(), heights[i].as_py()) for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, "node"])
    give_back()


def _proofs(batches):
    """Per leaf of a block: the path within it and above, as one digest, and where it leads."""
    for batch in batches:
        for i in range(len(batch)):
            height, entries, path, subroot, root = (c[i] for c in batch.columns)
            above, root, subroot = [(x["l"], x["r"]) for x in path.as_py()], root.as_py(), subroot.as_py()
            values = entries.values
            leaves, others = values.field("leaf").to_pylist(), values.field("other").to_pylist()
            proof, folded = [], []
            for k, own in enumerate(traverse(leaves.__getitem__, len(leaves), height.as_py())):
                whole = own + above
                proof.append(digest("".join(left + right for left, right in whole)))
                folded.append(fold(leaves[k] if others[k] is None else others[k], whole))
            n = len(leaves)
            columns = [values.field("id"), values.field("leaf"), pa.array([subroot] * n), pa.array([root] * n), pa.array(proof), pa.array(folded), pa.array([x == root for x in folded])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    give_back()
