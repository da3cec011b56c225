"""Chat formatting after collapsing cumulative snapshots of conversations.

A conversation that was logged again at every turn leaves snapshots that are prefixes of the last one. Each
turn gets a rolling hash of the turns up to it; a conversation whose last hash is the hash of an earlier turn
of another is dropped by an anti-join, and equal conversations are kept once. What stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import store

#: What stands before the role, between role and text, and after the text of a turn.
CHATML = ("<|im_start|>", "\n", "<|im_end|>\n")


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos, role, text, h1, h2, n): turns in order; h1 and h2 are hashes of the turns up to this one."""
    rows = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    here = F.struct("turn", "role", "text")
    rows = rows.withColumn("before", F.lag(here).over(order)).where(~here.eqNullSafe(F.col("before"))).drop("before")
    rows = rows.withColumn("pos", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    hashes = [F.bit_xor(F.xxhash64("pos", "role", "text")).over(upto), F.bit_xor(F.xxhash64(F.lit(1), "text", "pos", "role")).over(upto)]
    return rows.select("conv", "pos", "role", "text", hashes[0].alias("h1"), hashes[1].alias("h2"), F.count("*").over(Window.partitionBy("conv")).alias("n"))


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv, n, copies) of conversations that no longer one begins with; of equal ones the least id, and how many there are."""
    whole = hashed.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    shorter = hashed.where("pos < n").select(F.col("pos").cast("long").alias("n"), "h1", "h2").distinct()
    return whole.join(shorter, ["n", "h1", "h2"], "left_anti").select("conv", "n", "copies")


def render(rows: DataFrame, template: tuple[str, str, str] = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_col, n_turns, n_copies and text of every maximal conversation.

    Turns are ordered by turn (null first), role and text; rows that repeat all of these count once; a null
    role or text is empty. Rows without a conversation id are one conversation, whose id is null; where it
    equals others the least id that isn't null names them. An empty table gives an empty result; other
    columns are not read. A conversation is one row of the result, so its turns must fit in one.
    """
    turns = _turns(rows, conv_col, turn_col, role_col, text_col)
    hashed = store(turns.select("conv", "pos", "n", "h1", "h2"), "turns")
    kept = store(maximal(hashed), "maximal")
    before, between, after = (F.lit(t) for t in template)
    body = F.transform(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))), lambda t: F.concat(before, t["role"], between, t["text"], after))
    shown = turns.select("conv", "pos", "role", "text").join(kept.select(F.col("conv").alias("id")), F.col("conv").eqNullSafe(F.col("id")), "left_semi")
    texts = shown.groupBy("conv").agg(F.array_join(body, "").alias("text"))
    joined = texts.join(kept.withColumnRenamed("conv", "id"), F.col("conv").eqNullSafe(F.col("id")))
    return joined.select(F.col("conv").alias(conv_col), F.col("n").alias("n_turns"), F.col("copies").alias("n_copies"), "text")
