"""Chat formatting: collapse of cumulative snapshots, then rendering, in DataFrame functions only.

A conversation is often logged anew after each turn, so that one log is a prefix of the next.  Every turn
gets a hash of its place, role and text; their running sums identify each prefix of each conversation.  A
conversation whose last sum is some longer one's prefix, or that equals one of smaller id, is dropped by
anti-joins; what is left is rendered turn by turn.

Runs of turns are numbered and summed over range partitions, so that neither a conversation with very many
turns nor a prefix that very many share comes to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.common import checkpointed, ordered, prefix_sums, table

#: Turns rendered into one row; the parts of a conversation, in order, are its whole text.
PART_TURNS = 64
#: The marks of the common chat markup.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, h1, h2) of every turn: its place from 0 and the rolling hashes of the prefix that it ends.

    Turns go by turn number, then role and text (nulls first, as empty); a row repeated in all of these counts once.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = turns.filter("conv_id is not null").select("conv_id", "turn", F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b")).distinct()
    rows = ordered(hashed, "conv_id", "turn", "a", "b").withColumn("_one", F.lit(1).cast("long"))
    placed = prefix_sums(rows, ["conv_id"], {"pos": "_one"})
    # 31 bits a part: sums stay exact for up to 2^32 turns, four parts make 124 bits.
    parts = {f"s{i}": F.pmod(F.xxhash64(F.lit(10 + i), F.col("pos"), F.col("a"), F.col("b")), F.lit(1 << 31)) for i in range(4)}
    placed = prefix_sums(placed.withColumns(parts), ["conv_id"], {f"_{n}": n for n in parts}).withColumns({f"_{n}": F.col(f"_{n}") + F.col(n) for n in parts})
    return placed.select("conv_id", "turn", "a", "b", "pos", F.xxhash64("pos", *[f"_{n}" for n in parts]).alias("h1"), F.xxhash64(F.lit(3), *[f"_{n}" for n in parts], "pos").alias("h2"))


def maximal(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns, collapsed) of the conversations that stay, and the placed turns of all.

    ``collapsed`` counts the conversations equal to this one, itself included.
    """
    rows = checkpointed(prefixes(turns))
    sizes = rows.groupBy("conv_id").agg(F.max("pos").alias("pos"))
    last = rows.join(sizes, ["conv_id", "pos"], "left_semi").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("collapsed"))
    # A prefix inside some conversation: not its last turn.
    inner = rows.join(sizes.withColumnRenamed("pos", "_last"), "conv_id").filter(F.col("pos") < F.col("_last")).select("pos", "h1", "h2").distinct()
    stay = last.join(inner, ["pos", "h1", "h2"], "left_anti")
    return stay.select("conv_id", (F.col("pos") + 1).alias("n_turns"), "collapsed"), rows


def rendered(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, collapsed, first_turn, text) of the conversations that no longer or smaller one contains.

    A turn reads ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline; null role and text are empty.
    Conversations without an id are left out, as they can't be told apart; an empty table gives no rows.
    Turns of one number go by hash of role and text, since nothing orders them; other columns are ignored.
    """
    stay, rows = maximal(turns)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    keyed = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"))
    places = rows.join(stay, "conv_id").select("conv_id", F.coalesce(F.col("turn"), F.lit(0)).alias("t"), F.col("turn").isNull().alias("none"), "a", "b", "pos", "n_turns", "collapsed")
    keyed = keyed.withColumn("t", F.coalesce(F.col("turn"), F.lit(0))).withColumn("none", F.col("turn").isNull()).drop("turn")
    line = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"), F.col("text"), F.lit(CLOSE + "\n"))
    shown = keyed.join(places, ["conv_id", "none", "t", "a", "b"]).select("conv_id", F.floor(F.col("pos") / part_turns).alias("part"), "pos", "n_turns", "collapsed", line.alias("line"))
    # Rows repeated in all columns gave one place: one of their equal lines is taken.
    shown = shown.groupBy("conv_id", "part", "n_turns", "collapsed", "pos").agg(F.min("line").alias("line"))
    parts = shown.groupBy("conv_id", "part", "n_turns", "collapsed").agg(F.min("pos").alias("first_turn"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "").alias("text"))
    return parts.select("conv_id", "part", "n_turns", "collapsed", "first_turn", "text")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
  sha256(string_agg('<' || length(role) || ':' || role || length(text) || ':' || text, '' ) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS prefix FROM turns),
inside AS (SELECT DISTINCT prefix FROM placed WHERE pos + 1 < n_turns),
ends AS (SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS collapsed FROM placed WHERE pos + 1 = n_turns GROUP BY ALL),
stay AS (SELECT conv_id, collapsed FROM ends WHERE prefix NOT IN (SELECT prefix FROM inside))
SELECT conv_id, pos // 64 AS part, n_turns, collapsed, min(pos) AS first_turn,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM placed JOIN stay USING (conv_id) GROUP BY conv_id, pos // 64, n_turns, collapsed
"""
