"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the copies it is expected to give. Among all rates
between 0 and ``cap`` that meet each source's token target, those closest in
entropy to one copy each are r = cap / (1 + (cap - 1) exp(-lambda z)), an
exponential tilt by the document's size z (in mean sizes of its source), with
one multiplier lambda per source. The multipliers solve a convex dual: Newton
steps on sum(size * r) = target, kept inside a shrinking bracket. Rates depend
on source and size only, so the steps run as distributed aggregates over the
histogram of (source, size), not over the documents.

Rates become copies so that tokens add up: sizes are taken from the largest to
the smallest, each class of equal size gets the whole number of copies that
brings the running total next to its goal, and what is left over passes on to
the next smaller size. A class deals its copies evenly to its documents, by hash
of their ids, in cells that no row count makes large.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallframe.llm.shard import number_rows
from recallframe.session import cut, stored, without

#: Most sizes that one task carries a remainder over; documents of a cell; rows of a repeated row made at once.
CHAIN, CELL, REPEAT = 2048, 1024, 4096
NEWTON_STEPS, TOLERANCE = 40, 1e-9


def targets(sources: DataFrame, share: float, weights: list[float], cap: float) -> DataFrame:
    """``sources`` (source, source_size) with weight and target.

    Weights go round in the order of ``source`` (nulls last). Targets share
    ``share`` of all sizes by weight; those above ``cap`` times their source's
    size stop there and the excess is shared again until none is above.
    """
    keyed = sources.select("source", "source_size", F.col("source").isNull().alias("__null"))
    numbered, _ = number_rows(keyed, ["__null", "source"], "__n")
    dealt = cut(numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__n") % len(weights) + 1).cast("int"))))
    total = dealt.agg(F.sum("source_size")).first()[0] or 0
    most, level = F.col("source_size") * cap, 0.0
    while True:
        # three numbers a round; each round stops at least one more source, and mostly many at once
        stopped = F.col("weight") * F.lit(level) >= most
        full, open_weight = dealt.agg(F.sum(F.when(stopped, most)), F.sum(F.when(~stopped, F.col("weight")))).first()
        if not open_weight:
            break
        new = (share * total - (full or 0.0)) / open_weight
        if new <= level * (1 + 1e-12):
            break
        level = new
    return dealt.select("source", "source_size", "weight", F.least(most.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def _rate(multiplier: Column, size: Column, mean: Column, cap: float) -> Column:
    z = size / F.greatest(mean, F.lit(1e-9))
    return F.lit(cap) / (1 + F.lit(cap - 1) * F.exp(-F.greatest(F.least(multiplier * z, F.lit(700.0)), F.lit(-700.0))))


def _bound(cap: float) -> Column:
    """Whether a source's target lies on the edge of what rates can give, so that they are all ``cap`` (or all 0)."""
    return (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)) | (F.col("target") <= 0)


def balance(classes: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """``goals`` with mean and multiplier: the Newton solution of the dual over ``classes`` (source, size, n).

    A target of ``cap`` times the size, or of nothing, has no finite multiplier;
    such sources stay out of the steps, see ``_bound``.
    """
    means = classes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = goals.join(means, goals["source"].eqNullSafe(means["source"])).select(
        goals["source"], "source_size", "target", "mean", F.lit(0.0).alias("multiplier"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high")
    )
    state = cut(state)
    for _ in range(NEWTON_STEPS):
        own = state.select(F.col("source").alias("__s"), "mean", "multiplier")
        rated = classes.join(own, F.col("source").eqNullSafe(F.col("__s"))).withColumn("r", _rate(F.col("multiplier"), F.col("size"), F.col("mean"), cap))
        tokens = F.col("size") * F.col("n")
        slope = tokens * F.col("r") * (1 - F.col("r") / cap) * F.col("size") / F.greatest("mean", F.lit(1e-9))
        sums = rated.groupBy("source").agg(F.sum(tokens * F.col("r")).alias("have"), F.sum(slope).alias("slope")).withColumnRenamed("source", "__s")
        off = F.col("target") - F.col("have")
        low = F.when(off > 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("high")).otherwise(F.col("multiplier"))
        step = F.col("multiplier") + off / F.greatest("slope", F.lit(1e-300))
        inside = (step > low) & (step < high)
        # outside of the bracket: outwards by doubling while an end is unknown, else halve
        outward = F.when(off > 0, F.greatest(F.col("multiplier") * 2, F.lit(1.0))).otherwise(F.least(F.col("multiplier") * 2, F.lit(-1.0)))
        unknown = F.when(off > 0, high >= 1e6).otherwise(low <= -1e6)
        near = _bound(cap) | (F.abs(off) <= TOLERANCE * F.greatest("target", F.lit(1.0)))
        moved = F.when(near, F.col("multiplier")).when(inside & (F.abs(step - F.col("multiplier")) < 50), step).when(unknown, outward).otherwise((low + high) / 2)
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("__s")))
        state = cut(joined.select("source", "source_size", "target", "mean", moved.alias("multiplier"), low.alias("low"), high.alias("high"), near.alias("near")))
        if not state.where(~F.col("near")).limit(1).count():
            break
    return state.select("source", "source_size", "target", "mean", "multiplier")


def _round_chain(cap: float):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False, kind="stable").reset_index(drop=True)
        owed, copies = 0.0, np.zeros(len(pdf), np.int64)
        most = (pdf.n * int(cap)).to_numpy()
        goal, size = (pdf["size"] * pdf.n * pdf.rate).to_numpy(float), pdf["size"].to_numpy()
        for i in range(len(pdf)):
            owed += goal[i]
            if size[i] > 0:
                copies[i] = min(most[i], max(0, int(np.floor(owed / size[i] + 0.5))))
                owed -= float(copies[i]) * float(size[i])
            else:
                copies[i] = pdf.n[i]
        pdf["copies"] = copies
        return pdf[["source", "size", "n", "copies"]]

    return work


def class_copies(classes: DataFrame, solved: DataFrame, cap: float) -> DataFrame:
    """``classes`` (source, size, n) with the copies that all documents of a class give together."""
    s = solved.select(F.col("source").alias("__s"), "mean", "multiplier", "target", F.col("source_size"))
    rated = classes.join(s, F.col("source").eqNullSafe(F.col("__s")))
    edge = F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(F.lit(0.0))
    rate = F.when(_bound(cap), edge).otherwise(_rate(F.col("multiplier"), F.col("size"), F.col("mean"), cap))
    sizes = classes.groupBy("source").agg(F.ceil(F.count("*") / CHAIN).alias("chains")).withColumnRenamed("source", "__c")
    placed = rated.join(sizes, F.col("source").eqNullSafe(F.col("__c"))).select(
        "source", "size", "n", rate.alias("rate"), F.pmod(F.xxhash64("size"), F.col("chains")).alias("chain")
    )
    return placed.groupBy("source", "chain").applyInPandas(_round_chain(cap), "source string, size long, n long, copies long")


def _repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as ``times`` says, never through one long array."""
    blocks = df.where(F.col(times) > 0).withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / REPEAT).cast("long"))))
    inside = F.least(F.lit(REPEAT).cast("long"), F.col(times) - F.col("__b") * REPEAT)
    return blocks.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), inside))).drop("__b", "__i", times)


def mix(rows: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), cap: int = 2) -> DataFrame:
    """(doc_id, source, size) rows with source_size, target and copies (0 .. cap).

    A null source is a source of its own. Rows of size 0 give one copy of
    nothing. Equal rows are counted first and are dealt copies one by one.
    An empty table gives an empty one. The same rows give the same copies.
    """
    units = cut(rows.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")))
    classes = cut(units.groupBy("source", "size").agg(F.sum("m").alias("n")))
    goals = targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, list(weights), cap)
    solved = balance(classes, goals, cap)
    copies = class_copies(classes, solved, cap)
    extra = copies.join(solved.select(F.col("source").alias("__s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__s"))).select(
        F.col("source").alias("__s"), F.col("size").alias("__z"), "source_size", "target",
        F.expr("copies div n").alias("base"), F.expr("copies % n").alias("over"), "n", F.ceil(F.col("n") / CELL).cast("long").alias("cells"),
    )
    extra = cut(extra)
    placed = units.join(extra, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z"))).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.col("cells")))
    placed = placed.withColumn("salt", F.xxhash64("doc_id", F.lit("deal")))
    # cells of a class in their order, then rows of a cell
    cells = placed.groupBy("source", "size", "cell").agg(F.sum("m").alias("cell_n"))
    before = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("cell_at", F.coalesce(F.sum("cell_n").over(before), F.lit(0)))
    starts = starts.select(F.col("source").alias("__cs"), F.col("size").alias("__cz"), F.col("cell").alias("__cc"), "cell_at", "cell_n")
    both = placed.join(starts, F.col("source").eqNullSafe(F.col("__cs")) & (F.col("size") == F.col("__cz")) & (F.col("cell") == F.col("__cc")))
    within = Window.partitionBy("source", "size", "cell").orderBy("salt", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("m").over(within), F.lit(0))
    # the cell's share of the class's extra copies: whole parts of a running share, which add up to it
    share_to = lambda x: F.floor(F.col("over").cast("decimal(38,0)") * x / F.col("n"))
    cell_over = (share_to(F.col("cell_at") + F.col("cell_n")) - share_to(F.col("cell_at"))).cast("long")
    more = both.withColumn("hi", F.greatest(F.lit(0).cast("long"), F.least(F.col("m"), cell_over - at)))
    two = F.array(F.struct((F.col("base") + 1).alias("copies"), F.col("hi").alias("times")), F.struct(F.col("base").alias("copies"), (F.col("m") - F.col("hi")).alias("times")))
    dealt = more.select("doc_id", "source", "size", "source_size", "target", F.explode(two).alias("x")).select("doc_id", "source", "size", "source_size", "target", "x.*")
    return _repeated(dealt, "times")


def mixed(df: DataFrame, copies: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` as often as ``copies`` (key, copies) says; keys without a row there go.

    Rows that share a key, or have none, share its copies: their ordinal among
    the key's rows says which part of the sum is theirs, so the sum is met
    whatever the number of rows.
    """
    rows = stored(without(df, "__row").withColumn("__row", F.monotonically_increasing_id()))
    own = rows.select("__row", F.col(key).alias("__key"))
    sums = copies.groupBy(F.col(key).alias("__sk")).agg(F.sum("copies").alias("__sum"))
    counts = own.groupBy("__key").agg(F.count("*").alias("__m"))
    known = stored(counts.join(sums, F.col("__key").eqNullSafe(F.col("__sk"))).select("__sk", "__sum", "__m"))
    met = F.col("__key").eqNullSafe(F.col("__sk"))
    wanted = own.join(known.where("__m = 1"), met).select("__row", F.col("__sum").alias("__copies"))
    repeated = known.where("__m > 1")
    if not repeated.isEmpty():
        numbered, _ = number_rows(own.join(repeated, met).select("__key", "__row", "__sum", "__m"), ["__key", "__row"], "__n")
        numbered = stored(numbered)
        starts = numbered.groupBy("__key").agg(F.min("__n").alias("__from")).withColumnRenamed("__key", "__sk")
        at = F.col("__n") - F.col("__from")
        upto = lambda x: F.floor(F.col("__sum").cast("decimal(38,0)") * x / F.col("__m"))
        shared = numbered.join(starts, met).select("__row", (upto(at + 1) - upto(at)).cast("long").alias("__copies"))
        wanted = wanted.unionByName(shared)
    held = wanted.where("__copies > 0").withColumnRenamed("__row", "__wanted").hint("shuffle_hash")
    return _repeated(rows.join(held, F.col("__row") == F.col("__wanted")), "__copies").select(*df.columns)
