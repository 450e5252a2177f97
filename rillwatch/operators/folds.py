"""Folds whose step depends on the previous outcome (cooldowns, gates, leaky buckets).

One key may hold most of the data, so a key is cut into time blocks and every (key, block) is folded on its
own. The first pass assumes each block starts from scratch; then blocks whose predecessor ended in another
state than assumed are folded again, until nothing changes. The result equals one fold over the whole key:
each round settles at least the next block of every key. Steps that forget within a block (cooldowns far shorter than
it) need one or two rounds; a state that is carried on and on, like a summary's, needs a round for each block. A task
holds one block of one key at a time.

Where a step can say what a block does to every state it may start from (``effect``), there are no rounds: blocks give their
effects side by side, and the states between them come from one pass along each key over those effects alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwatch.operators.blocks import BLOCK, block_of
from rillwatch.session import cut_lineage

# step(state text or None, rows sorted by order, first order value of the next block) -> (state text, output rows)
# A step gives None for a state that cannot matter from the next block on; that is what ends the rounds early.
Step = Callable[[str | None, pd.DataFrame, int], tuple[str | None, pd.DataFrame]]
# effect(rows sorted by order, first order value of the block, that of the next block) -> what the block does to any state
Effect = Callable[[pd.DataFrame, int, int], bytes]
# follow(key, state text or None, effect, first order value of the block, that of the next block) -> state text or None
Follow = Callable[[tuple, "str | None", bytes, int, int], "str | None"]
USED = "_used"


def _groups(batches: Iterator[pd.DataFrame], ids: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Whole groups out of sorted batches; a group may run over several batches."""
    held: list[pd.DataFrame] = []
    name = None
    for batch in batches:
        marks = batch[ids]
        edges = (marks != marks.shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        for a, b in zip(edges, [*edges[1:], len(batch)]):
            here = tuple(marks.iloc[a])
            if here != name and held:
                yield name, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            name = here
            held.append(batch.iloc[a:b])
    if held:
        yield name, pd.concat(held) if len(held) > 1 else held[0]


def _each_group(cells: DataFrame, ids: list[str], order: list[str], work, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, size = [], 0
        for name, rows in _groups(batches, ids):
            out = work(name, rows)
            ready.append(out)
            size += len(out)
            if size > 50_000:
                yield pd.concat(ready)
                ready, size = [], 0
        if ready:
            yield pd.concat(ready)

    return cells.repartition(*ids).sortWithinPartitions(*ids, *order).mapInPandas(run, schema)


def _along(effects: DataFrame, keys: list[str], ids: list[str], follow: Follow, block: int, schema: str) -> DataFrame:
    """The state that each block starts from; one row per block is read, one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for batch in batches:
            used = []
            for *key, number, effect in batch[[*ids, "effect"]].itertuples(index=False):
                if key != name:
                    name, state = key, None
                used.append(state)
                state = follow(tuple(key), state, effect, int(number) * block, (int(number) + 1) * block)
            yield batch[ids].assign(**{USED: pd.Series(used, index=batch.index, dtype=object)})

    return effects.repartition(*(keys or [F.lit(0)])).sortWithinPartitions(*ids).mapInPandas(run, schema)


def fold(cells: DataFrame, keys: list[str], order: list[str], step: Step, out_schema: str, block: int,
         composed: tuple[Effect, Follow] | None = None) -> DataFrame:
    """Fold ``cells`` per key in ``order`` (first a whole number that is cut into blocks of ``block``).

    ``out_schema`` describes the rows ``step`` returns; the keys (never NULL) are put in front of them. With ``composed``
    the blocks' states come from their effects, in one pass, and not from rounds.
    """
    types = dict(cells.dtypes)
    ids = [*keys, BLOCK]
    cells = cut_lineage(cells.withColumn(BLOCK, block_of(order[0], block)))

    def used_of(rows):
        used = rows[USED].iloc[0]
        return None if pd.isna(used) else used

    def end_state(name, rows):
        used = used_of(rows)
        ends, _ = step(used, rows, (int(name[-1]) + 1) * block)
        return pd.DataFrame([[*name, used, ends]], columns=[*ids, USED, "ends"])

    def emit(name, rows):
        out = step(used_of(rows), rows, (int(name[-1]) + 1) * block)[1]
        for i, k in enumerate(keys):
            out.insert(i, k, name[i])
        return out

    fields = ", ".join(f"`{c}` {'bigint' if c == BLOCK else types[c]}" for c in ids)

    def states(these):
        return cut_lineage(_each_group(these, ids, order, end_state, f"{fields}, {USED} string, ends string"))

    def effects(these):
        effect = composed[0]

        def work(name, rows):
            return pd.DataFrame([[*name, effect(rows, int(name[-1]) * block, (int(name[-1]) + 1) * block)]], columns=[*ids, "effect"])

        return _each_group(these, ids, order, work, f"{fields}, effect binary")

    scratch = cells.withColumn(USED, F.lit(None).cast("string"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BLOCK)  # one row per block
    ends = cells.agg(F.min(BLOCK).alias("first"), F.max(BLOCK).alias("last")).first()
    if ends["first"] != ends["last"] and composed:
        known = _along(effects(cells.dropna(subset=keys) if keys else cells), keys, ids, composed[1], block, f"{fields}, {USED} string")
        scratch = cells.join(known, ids)
    elif ends["first"] != ends["last"]:
        known = states(scratch)
        while True:
            wanted = known.withColumn("wanted", F.lag("ends").over(before))
            same = F.col("wanted").eqNullSafe(F.col(USED))
            changed = wanted.filter(~same).select(*ids, F.col("wanted").alias(USED))
            if changed.isEmpty():
                break
            known = cut_lineage(wanted.filter(same).drop("wanted").unionByName(states(cells.join(changed, ids))))
        scratch = cells.join(known.select(*ids, USED), ids)
    fields = ", ".join([*[f"`{k}` {types[k]}" for k in keys], out_schema])
    return _each_group(scratch, ids, order, emit, fields)
