"""Chat formatting with the collapse of cumulative snapshots, as DataFrame operations alone.

Logs hold a conversation again and again, each time a few turns longer. The hash of a turn includes its place; the
running exclusive-or of these hashes is a rolling hash of each prefix (two hashes with different salts: 128 bits).
A conversation whose whole hash is some longer conversation's prefix hash is left out by an anti-join on (turns, hash); of
equal ones the smallest identifier stays. Prefixes are made distinct before the join, so a first turn that a third of
all conversations share is one row there. What stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

TEMPLATE = "<|{role}|>\n{text}<|end|>\n"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, h1, h2, last): the rolling hash of each conversation's first n turns. Turns go by (turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumn("n", F.row_number().over(order))
    for name, salt in (("h1", 1), ("h2", 2)):
        rows = rows.withColumn(name, F.bit_xor(F.xxhash64(F.lit(salt), "n", "role", "text")).over(run))
    return rows.select("conv_id", "n", "h1", "h2", (F.lead("n").over(order).isNull()).alias("last"))


def turns_of(log: DataFrame) -> DataFrame:
    """The log's turns: rows without a conversation go, exact repeats count once, null roles are 'unknown', null texts empty."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return log.filter("conv_id IS NOT NULL").select("conv_id", "turn", role, text).distinct()


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that no longer one begins with."""
    marked = written(prefixes(turns), "prefixes")
    ends = marked.filter("last").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = marked.filter("NOT last").select("n", "h1", "h2").distinct()
    return ends.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"))


def format_chats(log: DataFrame) -> DataFrame:
    """conv_id, n_turns and the rendered text of each maximal conversation of a log (conv_id, turn, role, text).

    Turns go in the order of (turn, role, text), a null turn first. Other columns are not read; an empty log gives an empty table."""
    turns = turns_of(log)
    kept = maximal(turns)
    head, rest = TEMPLATE.split("{role}")
    middle, tail = rest.split("{text}")
    line = F.concat(F.lit(head), "role", F.lit(middle), "text", F.lit(tail))
    chats = turns.join(kept, "conv_id").groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("t"))
    return chats.select("conv_id", "n_turns", F.array_join(F.transform("t", lambda t: t["line"]), "").alias("text"))


def op6_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS l FROM t GROUP BY conv_id),
e AS (SELECT min(conv_id) AS conv_id, l FROM c GROUP BY l)
SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns,
       list_aggregate(list_transform(l, lambda x: '<|' || x.r || '|>' || chr(10) || x.t || '<|end|>' || chr(10)), 'string_agg', '') AS text
FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE len(c.l) > len(e.l) AND c.l[1:len(e.l)] = e.l)
"""
