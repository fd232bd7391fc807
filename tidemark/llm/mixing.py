"""Mixing sources to target weights by temperature, as DataFrame operations alone.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is found by
bisection over a table of sources, 32 sections a round: the weights' entropy reaches the target, unless a source would then
be repeated too often; repetition falls as the exponent rises, so the exponent goes up until the limit holds.

Weights times the budget give each source its tokens: whole passes over it, and the rest from one more pass, cut off.
A hash deals each source's rows into blocks; the blocks' order is a permutation by another hash. The cut-off
pass takes whole blocks while they fit, and of the next block rows in hash order while they fit. Only the totals of blocks, those of the slices
of that one block in each source, and the rows inside a slice are ordered, so a source with a third of all rows is no longer a task than any other.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, written

BLOCKS = 1024
#: Slices of a cut-off block, a power of two.
SLICES = 1024
#: Rows of block totals up to which they are sent to all tasks (a few MB); above, they are joined by shuffle.
BROADCAST_ROWS = 200_000
SECTIONS, ROUNDS = 32, 6
WORD = "[^\\x20\\x09-\\x0D]+"


def tokens(text: str = "text"):
    """Words between ASCII white space; none in a null text."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def exponent(sources: DataFrame, budget: float, target_entropy: float | None, repetition: float | None) -> float:
    """The exponent in [0, 1] for a table (n tokens) of sources. target_entropy is a part of the entropy of equal weights."""
    live = sources.filter("n > 0")
    total = live.agg(F.sum("n").cast("double").alias("t"), F.count("*").alias("c")).first()
    if not total["c"] or total["c"] == 1:
        return 1.0
    p = F.col("n") / F.lit(total["t"])

    def at(grid: list[float]) -> list[tuple[float, float]]:
        """(entropy, most repetitions) of the weights for each exponent."""
        columns = []
        for i, a in enumerate(grid):
            w = F.pow(p, F.lit(a))
            columns += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(w)).alias(f"l{i}"), F.max(w / p).alias(f"r{i}")]
        got = live.agg(*columns).first()
        return [(math.log(got[f"z{i}"]) - got[f"l{i}"] / got[f"z{i}"], got[f"r{i}"] / got[f"z{i}"] * budget) for i in range(len(grid))]

    def bisected(holds_below) -> float:
        """The exponent up to which holds_below is true of (entropy, repetition): it is at 0, and at most until 1."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            flags = [holds_below(*x) for x in at(grid)]
            if all(flags):
                return high
            first = flags.index(False)
            low, high = grid[max(0, first - 1)], grid[first]
        return (low + high) / 2

    alpha = 1.0
    if target_entropy is not None:
        goal = target_entropy * math.log(total["c"])
        alpha = bisected(lambda h, r: h >= goal)
    if repetition is not None:
        alpha = max(alpha, bisected(lambda h, r: r > repetition))
    return alpha


def mix(docs: DataFrame, budget: float = 1.0, target_entropy: float | None = 0.9, repetition: float | None = 4.0, seed: int = 17, source: str = "source", key: str = "doc_id", text: str = "text", count=None) -> DataFrame:
    """docs as a training mix: `epoch` (from 1), `block` (place in the source's permutation) and `n_tokens` beside their columns; a row
    appears once for each pass that takes it.

    budget: tokens of the mix as a multiple of the tokens there are. count: expression of a row's tokens, words by default.
    A null source is a source of its own. Rows without tokens cost nothing and go with their block; a source without
    any tokens stays once. Equal rows are taken or left together. An empty table gives an empty mix."""
    own = dict(zip(("src", "n", "u", "b"), fresh(docs, "of_source", "of_tokens", "of_order", "of_bucket"), strict=True))
    epoch, block, n_tokens = fresh(docs, "epoch", "block", "n_tokens")
    src, n, u, b = own.values()
    order = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    rows = docs.withColumn(src, F.struct(F.col(source).cast("string").alias("s"))).withColumn(n, tokens(text) if count is None else count).withColumn(u, order).withColumn(b, F.pmod(F.xxhash64(F.lit(seed), F.col(u)), F.lit(BLOCKS)))
    narrow = written(rows.select(src, n, u, b), "counted")  # texts are counted and hashed once for all that plans the mix
    blocks = written(narrow.groupBy(F.col(src).alias("src"), F.col(b).alias("b")).agg(F.sum(n).alias("n")), "blocks")
    sources = blocks.groupBy("src").agg(F.sum("n").alias("n"))
    total = sources.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    alpha = exponent(sources, budget, target_entropy, repetition)
    share = F.when(F.col("n") > 0, F.pow(F.col("n") / F.lit(float(max(total, 1))), F.lit(alpha))).otherwise(0.0)
    weight_sum = sources.agg(F.sum(share).alias("z")).first()["z"] or 1.0
    wanted = F.round(share / F.lit(weight_sum) * F.lit(float(total) * budget), 3)
    plan = sources.select("src", F.when(F.col("n") > 0, F.floor(wanted / F.col("n"))).otherwise(1).cast("int").alias("passes"), F.when(F.col("n") > 0, wanted - F.floor(wanted / F.col("n")) * F.col("n")).otherwise(-1.0).alias("rest"))
    permuted = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed), "src", "b"), "b")
    placed = blocks.join(plan, "src").withColumn("place", F.row_number().over(permuted)).withColumn("upto", F.sum("n").over(permuted.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("state", F.when(F.col("upto") <= F.col("rest"), 1).when(F.col("upto") - F.col("n") < F.col("rest"), 0).otherwise(-1))
    placed = written(placed.select("src", "b", "passes", "place", "state", (F.col("rest") - F.col("upto") + F.col("n")).alias("room")), "placed")

    def beside(left: DataFrame, right: DataFrame, on) -> DataFrame:
        return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on)

    cut = placed.filter("state = 0").select(F.col("src").alias("cut_src"), F.col("b").alias("cut_b"), "room")
    inside = beside(narrow, cut, (F.col(src) == F.col("cut_src")) & (F.col(b) == F.col("cut_b")))
    last = last_taken(inside.select("cut_src", "room", F.col(u).alias("u"), F.col(n).alias("n")))
    placed = placed.join(last, F.col("src") == F.col("cut_src"), "left").drop("cut_src")
    names = dict(zip(placed.columns, fresh(docs.select("*", *(F.lit(0).alias(c) for c in own.values())), *(f"mix_{c}" for c in placed.columns)), strict=True))
    full = beside(rows, placed.toDF(*names.values()), (F.col(own["src"]) == F.col(names["src"])) & (F.col(own["b"]) == F.col(names["b"])))
    taken = F.when((F.col(names["state"]) == 1) | (F.col(names["state"]) == 0) & (F.col(own["u"]) <= F.col(names["last_u"])), 1).otherwise(0)
    copies = F.col(names["passes"]) + taken
    return full.filter(copies > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), copies)).alias(epoch), F.col(names["place"]).alias(block), F.col(own["n"]).alias(n_tokens))


def last_taken(inside: DataFrame) -> DataFrame:
    """(cut_src, last_u): of rows (cut_src, room, u, n) the largest u up to which the tokens fit in the room of their source's cut block.

    The block is cut once more, into SLICES ranges of u; each slice adds up its own rows, and what lies before it comes from the slices' sums. So the
    rows in order are those of one slice, one of SLICES * BLOCKS parts of a source."""
    sliced = written(inside.withColumn("slice", F.shiftright("u", 64 - SLICES.bit_length() + 1)), "slices")
    before = Window.partitionBy("cut_src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy("cut_src", "slice", "room").agg(F.sum("n").alias("n"))
    starts = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("before <= room").select("cut_src", "slice", "before")
    running = F.sum("n").over(Window.partitionBy("cut_src", "slice").orderBy("u").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    run = sliced.join(starts, ["cut_src", "slice"]).withColumn("run", F.col("before") + running)
    return run.filter("run <= room").groupBy("cut_src").agg(F.max("u").alias("last_u"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at the size of the corpus: which document in which pass and block."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the mix reads its rows three times; words are counted and texts hashed once
    narrow = written(docs.select("doc_id", "source", tokens().alias("words"), F.xxhash64("text").alias("text_hash")), "counted")
    return mix(narrow, text="text_hash", count=F.col("words")).select("doc_id", "source", "epoch", "n_tokens")
