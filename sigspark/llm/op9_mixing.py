"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact size. A source's target is its weight's share of all sizes, held at most at
`cap` times its own size, with the excess shared among the others by weight: the open sources get one level times their
weight, and a few aggregates over the sources find it, so that sources may be as many as hosts. Whole passes over a source are taken
first; the remaining budget is fitted on the source's size histogram: first the same share of every size, then a
bounded knapsack (dynamic programming over sums) for what is left. Documents are chosen inside each size by a seeded
hash; rows that only repeat a doc_id are counted, not ranked one by one.

Defined results: null text has size 0; documents of size 0 take 0 words; null is a source of its own, last in order;
repeated rows are documents of their own; ties of the hash are broken by doc_id, and rows with the same doc_id, source and size are
interchangeable; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one source and size that a task ranks at most, in the mean.
GROUP = 500
#: Repeated rows that are written out at once.
STRETCH = 10_000
#: Sums that the knapsack tells apart at least; a longer document raises it to its size.
SUMS = 1 << 17


def ranked_sources(histogram: DataFrame) -> DataFrame:
    """(source, source_size, rank): ranks by code point, null last. A sorted table's partitions are counted, so no task
    holds all sources; one number for each partition comes to the driver."""
    own = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    own = written(own.orderBy(F.asc_nulls_last("source")).withColumn("id", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("id", 33)
    counts = own.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, total = {}, 0
    for r in sorted(counts, key=lambda r: r["part"]):
        before[r["part"]], total = total, total + r["n"]
    start = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), part), F.lit(0)) if before else F.lit(0)
    return own.select("source", "source_size", (start + F.col("id").bitwiseAND((1 << 33) - 1)).alias("rank"))


def targeted(sources: DataFrame, weights: Sequence[float], cap: int) -> DataFrame:
    """Adds `target`. In each round the sources whose share exceeds the cap are held at it and what is left is shared among
    the others by weight; the sums of a round are one aggregate."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    own = sources.withColumn("weight", F.when(F.col("source_size") > 0, weight).otherwise(F.lit(0.0)))
    most = F.lit(float(cap)) * F.col("source_size")
    level, held = 0.0, -1
    while True:
        # A source that was held stays so, as the level only rises.
        over = (F.col("weight") * F.lit(level) > most) & (F.col("weight") > 0)
        sums = own.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, most)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("w"), F.count(F.when(over, 1)).alias("n")).first()
        if not sums["w"] or sums["n"] == held:
            break
        held, level = sums["n"], (sums["all"] - (sums["held"] or 0.0)) / sums["w"]
    return own.withColumn("target", F.least(F.col("weight") * F.lit(float(level if sums["w"] else float("inf"))), most) if sums["w"] else most).drop("weight", "rank")


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their sum comes as near to the budget as it can without passing it."""
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i])
    total = sum(lengths[i] * counts[i] for i in order)
    take = [0] * len(lengths)
    if budget >= total:
        for i in order:
            take[i] = counts[i]
        return take
    longest = max(lengths[order[0]] if order else 0, SUMS)
    for i in order:
        take[i] = counts[i] * max(0, budget - longest) // total
    left = budget - sum(lengths[i] * take[i] for i in order)
    # Large lengths first, until what is left is within reach of the knapsack.
    for i in order:
        if left <= longest:
            break
        more = min(counts[i] - take[i], max(0, left - longest) // lengths[i] + 1, left // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    for i, n in knapsack([(lengths[i], counts[i] - take[i], i) for i in reversed(order)], left).items():
        take[i] += n
    return take


def knapsack(items: list[tuple[int, int, int]], budget: int) -> dict[int, int]:
    """items: (length, number, id). The numbers whose sum is the largest one up to the budget: sums reached by the first
    items are bits of an integer, and every sum remembers the step (a power of two of one length) that reached it first."""
    reach, mask, steps = 1, (1 << (budget + 1)) - 1, []
    reached_by = np.full(budget + 1, -1, np.int32)
    for length, number, key in items:
        n = min(number, budget // length)
        k = 1
        while n > 0 and not reach >> budget & 1:
            k = min(k, n)
            new = (reach << k * length) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                reached_by[np.flatnonzero(bits)] = len(steps)
                steps.append((k, length, key))
                reach |= new
            n, k = n - k, 2 * k
        if reach >> budget & 1:
            break
    at, out = reach.bit_length() - 1, {}
    while at:
        k, length, key = steps[reached_by[at]]
        out[key] = out.get(key, 0) + k
        at -= k * length
    return out


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of docs (doc_id, text, source)."""
    rows = written(sizes(docs), "sizes")
    histogram = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    aim = targeted(ranked_sources(histogram), weights, cap)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(cap, int(target // size)) if size else 0
        budget = int(round(target)) - passes * size if passes < cap else 0
        take = fit(pdf["size"].tolist(), pdf["n"].tolist(), min(budget, size)) if budget > 0 else [0] * len(pdf)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "source_size": size, "target": target, "passes": np.int64(passes), "take": take})

    same = lambda a, b: a.eqNullSafe(b)
    counted = histogram.join(aim.withColumnRenamed("source", "s"), same(F.col("source"), F.col("s"))).drop("s")
    plan = written(counted.groupBy("source").applyInPandas(fitted, "source string, size long, n long, source_size long, target double, passes long, take long"), "plan")
    # Ranks inside (source, size): a hash deals documents into groups of bounded size.
    fan = F.ceil(F.col("n") / GROUP)
    p = plan.select(F.col("source").alias("ps"), F.col("size").alias("pz"), "n", "source_size", "target", "passes", "take")
    dealt = rows.join(p, same(F.col("source"), F.col("ps")) & (F.col("size") == F.col("pz"))).drop("ps", "pz")
    firm = dealt.where((F.col("take") == 0) | (F.col("take") == F.col("n"))).withColumn("more", (F.col("take") > 0).cast("long"))
    # Rows of one doc_id, source and size differ in nothing: they are one row with a number until the end.
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    every = ["source", "size", "doc_id", "n", "source_size", "target", "passes", "take"]
    loose = dealt.where((F.col("take") > 0) & (F.col("take") < F.col("n"))).groupBy(*every).agg(F.count(F.lit(1)).alias("m"))
    loose = written(loose.withColumn("key", key).withColumn("deal", F.pmod(F.col("key"), fan)), "loose")
    groups = loose.groupBy("source", "size", "deal").agg(F.sum("m").alias("g"))
    before = groups.withColumn("before", F.coalesce(F.sum("g").over(Window.partitionBy("source", "size").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = before.select(F.col("source").alias("bs"), F.col("size").alias("bz"), F.col("deal").alias("bd"), "before")
    placed = loose.join(b, same(F.col("source"), F.col("bs")) & (F.col("size") == F.col("bz")) & (F.col("deal") == F.col("bd"))).drop("bs", "bz", "bd")
    inside = F.sum("m").over(Window.partitionBy("source", "size", "deal").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    wins = F.greatest(F.lit(0), F.least(F.col("m"), F.col("take") - F.col("before") - F.coalesce(inside, F.lit(0))))
    placed = placed.withColumn("wins", wins)
    # Rows again, in stretches, so that no array holds all rows of one doc_id.
    placed = placed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(STRETCH).cast("long"))))
    placed = placed.withColumn("nth", F.explode(F.sequence("from", F.least(F.col("from") + STRETCH, F.col("m")) - 1)))
    placed = placed.withColumn("more", (F.col("nth") < F.col("wins")).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("more"))).alias("taken"), (F.col("passes") + F.col("more")).alias("copies"), "source"]
    return firm.select(*columns).union(placed.select(*columns))
