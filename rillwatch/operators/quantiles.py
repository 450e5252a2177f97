"""Exact order statistics without sorting a column, or merging what all tasks know, in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: items that a sketch holds at its widest (about 50 KB): a column of fewer values needs one narrowing, each further one
#: divides the values left by a hundred or more
ACCURACY = 2048
#: sketches of all tasks are merged in this many groups first, and then those
GROUPS = 128


def _usable(column: str):
    c = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def sketches(values: DataFrame) -> DataFrame:
    """k, n and the merged sketch of ``values`` (k, v).

    Every task sketches its own values. A merging task reads the sketches of one task in GROUPS, the last one those of
    GROUPS tasks: at 10,000 tasks both are a few MB.
    """
    size = max(8, min(ACCURACY, 65535))
    first = values.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).groupBy("k", "_group").agg(
        F.kll_sketch_agg_double("v", size).alias("s"), F.count("v").alias("n"))
    return first.groupBy("k").agg(F.kll_merge_agg_double("s", size).alias("s"), F.sum("n").alias("n"))


def _proposed(df: DataFrame, held: list[tuple], shares: dict[int, list[float]]) -> dict:
    """Values at the ``shares`` of each key's sketch, out of ``held`` (key, sketch)."""
    every = sorted({x for own in shares.values() for x in own})
    rows = df.sparkSession.createDataFrame(held, "k int, s binary").select(
        "k", F.kll_sketch_get_quantile_double("s", F.array(*map(F.lit, every))).alias("v"))
    return {r.k: {r.v[every.index(x)] for x in shares[r.k]} for r in rows.collect() if r.k in shares}


class _Bracket:
    """Values of column ``i`` from ``lo`` to ``hi``: how many lie below them and within, and the ranks sought there."""

    def __init__(self, i, lo, hi, below, n, ranks):
        self.i, self.lo, self.hi, self.below, self.n, self.ranks = i, lo, hi, below, n, ranks


def order_statistics(df: DataFrame, ranks: dict[str, list]) -> dict[str, dict]:
    """Values at 0-based ranks of each column, NULL, NaN and infinities left out.

    ``ranks[column]`` holds whole numbers, or functions of the column's count that give lists of them. The result has
    under each rank the value, under ``("below", rank)`` how many values are smaller, and the column's ``count``.

    Sketches propose values around each rank; a pass counts the values between neighbouring proposals and equal to each.
    The counts decide, so the result is exact, and ranks that are not settled go on with the values between two
    proposals. Every round drops a value at least. What the driver sees are a sketch and a few numbers for each rank.
    """
    cols = list(ranks)
    used = df.select(*[_usable(c).alias(f"c{i}") for i, c in enumerate(cols)])
    found: dict[str, dict] = {c: {"count": 0} for c in cols}
    brackets = [_Bracket(i, None, None, 0, None, None) for i in range(len(cols))]
    while brackets:
        long = _long(used, brackets, {k: F.lit(0) for k in range(len(brackets))}).select("k", "v")
        held, shares = [], {}
        for r in sketches(long).collect():
            b = brackets[r.k]
            if b.n is None:
                b.n = found[cols[b.i]]["count"] = r.n
                b.ranks = {x for want in ranks[cols[b.i]] for x in (want(r.n) if callable(want) else [want]) if 0 <= x < r.n}
            slack = max(1, 0 if b.n <= ACCURACY else 4 * b.n // ACCURACY + 1)
            if b.ranks:
                held.append((r.k, bytes(r.s)))
                # on both sides of each run of ranks, and at the ranks once the sketch is exact
                at = [x + d for x in b.ranks for d in (-slack, slack) if x + (d > 0) - (d < 0) not in b.ranks] + (list(b.ranks) if slack == 1 else [])
                shares[r.k] = [min(max((x - b.below + 0.5) / b.n, 0.0), 1.0) for x in at]
        brackets = _narrowed(used, brackets, _proposed(df, held, shares) if held else {}, cols, found)
    return found


def _long(used: DataFrame, brackets: list, cells: dict) -> DataFrame:
    """k, cell, v of every value that lies in a bracket with a cell; brackets of one column do not overlap, so a row gives one for each column."""
    columns = {}
    for k in cells:
        columns.setdefault(brackets[k].i, []).append(k)

    def pick(i, of):
        v, out = F.col(f"c{i}"), None
        for k in columns[i]:
            b = brackets[k]
            here = F.lit(True) if b.n is None or b.lo is None else v.between(b.lo, b.hi)
            out = F.when(here, of(k)) if out is None else out.when(here, of(k))
        return out

    rows = F.array(*[F.struct(pick(i, F.lit).alias("k"), pick(i, cells.__getitem__).alias("cell"), F.col(f"c{i}").alias("v")) for i in columns])
    return used.select(F.inline(rows)).filter("k IS NOT NULL AND v IS NOT NULL")


def _narrowed(used: DataFrame, brackets: list, cuts: dict, cols: list[str], found: dict) -> list:
    """What is left of ``brackets`` after counting at ``cuts``; ranks that are settled go to ``found``."""
    if not cuts:
        return []
    cuts = {k: sorted(v) for k, v in cuts.items()}

    # even cells lie between neighbouring cuts, odd ones are the cuts
    cells = {k: sum(((F.col(f"c{brackets[k].i}") >= c).cast("int") + (F.col(f"c{brackets[k].i}") > c).cast("int") for c in cuts[k]), F.lit(0)) for k in cuts}
    long = _long(used, brackets, cells)
    counted = long.groupBy("k", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    left = []
    for k in cuts:
        b, below = brackets[k], brackets[k].below
        for r in sorted((r for r in counted if r.k == k), key=lambda r: r.cell):
            here = {x for x in b.ranks if below <= x < below + r.n}
            if here and r.lo == r.hi:
                for x in here:
                    found[cols[b.i]][x], found[cols[b.i]]["below", x] = r.lo, below
            elif here:
                left.append(_Bracket(b.i, r.lo, r.hi, below, r.n, here))
            below += r.n
    return left


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list]:
    """Linearly interpolated quantiles (the usual definition), None for a column without values."""
    def around(p):
        def ranks(n):
            at = p * (n - 1)
            return [math.floor(at), math.ceil(at)] if n else []
        return ranks

    stats = order_statistics(df, {c: [around(p) for p in probs] for c in cols})
    out = {}
    for c in cols:
        n, row = stats[c]["count"], []
        for p in probs:
            if not n:
                row.append(None)
                continue
            at = p * (n - 1)
            lo, hi = stats[c][math.floor(at)], stats[c][math.ceil(at)]
            row.append(lo + (hi - lo) * (at - math.floor(at)))
        out[c] = row
    return out
