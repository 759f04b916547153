"""Greedy walks in order, as rounds over tables.

A walk that takes rows in order, each with what its forerunners left, is settled in
rounds: all rows propose at once, and what no earlier row can change is final.  Groups
in which each round settles little are walked in order after ROUNDS of them, as a
stream of sorted rows; the state is what the walk itself must remember, never the rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake.session import discard, shuffle_partitions, written

#: Rounds before what is left is walked in order.
ROUNDS = 8
#: A group of at most so many right rows is matched by the walk at once: their ids are its state.
WALKED = 1_000_000


def _streamed(df: DataFrame, group: str, order: list[str], walk, schema: str) -> DataFrame:
    """``walk(row iterator of one group)`` for each group, its rows in order, streamed."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = schema_names
        state, at = None, object()
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                key = getattr(row, group)
                if key != at:
                    state, at = walk(), key
                found = state(row)
                if found is not None:
                    out.append(found)
            yield pd.DataFrame(out, columns=names)

    schema_names = [part.strip().split(" ")[0].strip("`") for part in schema.split(",")]
    dealt = df.repartition(shuffle_partitions(df.sparkSession), group).sortWithinPartitions(group, *order)
    return dealt.mapInPandas(work, schema)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


# ---- matching ------------------------------------------------------------------------


def root_related(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """(group, lkey, rkey) of the consonant keys of a group that are related: one begins
    or ends with the other, or their first two consonants agree.  Keys meet on their
    beginnings and ends by equality, each pair of keys once."""
    a, b = left.select(group, F.col("key").alias("lkey")).distinct(), right.select(group, F.col("key").alias("rkey")).distinct()
    heads = lambda k: F.transform(F.sequence(F.lit(0), F.length(k)), lambda n: F.struct(F.lit("head").alias("kind"), F.left(k, n).alias("part")))
    tails = lambda k: F.transform(F.sequence(F.lit(0), F.length(k)), lambda n: F.struct(F.lit("tail").alias("kind"), F.right(k, n).alias("part")))
    whole = lambda k, kind: F.array(F.struct(F.lit(kind).alias("kind"), k.alias("part")))
    two = lambda k: F.when(F.length(k) >= 2, F.array(F.struct(F.lit("two").alias("kind"), F.left(k, F.lit(2)).alias("part")))).otherwise(F.array().cast("array<struct<kind:string,part:string>>"))
    found = []
    for lk, rk in ((lambda k: F.concat(heads(k), tails(k)), lambda k: F.concat(whole(k, "head"), whole(k, "tail"))),
                   (lambda k: F.concat(whole(k, "head"), whole(k, "tail")), lambda k: F.concat(heads(k), tails(k))), (two, two)):
        x = a.select(group, "lkey", F.explode(lk(F.col("lkey"))).alias("at"))
        y = b.select(group, "rkey", F.explode(rk(F.col("rkey"))).alias("at"))
        found.append(x.join(y, [group, "at"]).select(group, "lkey", "rkey"))
    return _union(found).distinct()


def greedy_match(left: DataFrame, right: DataFrame, related: DataFrame, group: str) -> DataFrame:
    """(group, left, right) of the walk in which each left row (group, key, left), by
    ``left``, takes the first right row (group, key, right) that is free and whose key
    is related (group, lkey, rkey) to its own.  Each row is in one pair at most; rows
    without a pair are not returned; null keys are related to nothing.

    Groups of up to WALKED right rows are walked, with one queue of right ids a key.
    In larger ones rounds come first, in which the n-th free left row of a key proposes
    to the n-th free right row that its key may take, and of several the least wins.
    Before a group's first loser, every pair is as the walk makes it.
    """
    sizes = right.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > WALKED).select(group)
    if large.isEmpty():
        return _walk_queues(left, right, related, group)
    small = lambda df: df.join(large, [group], "left_anti")
    big = lambda df: df.join(large, [group], "left_semi")
    return _walk_queues(small(left), small(right), small(related), group).unionByName(_rounds(big(left), big(right), big(related), group))


def _walk_queues(left: DataFrame, right: DataFrame, related: DataFrame, group: str) -> DataFrame:
    """The walk itself: related keys of a group first, then its right rows in order,
    then its left rows in order.  All who may take a key's right rows take the first
    free one of them, so a key's free rows are the rest of its queue."""
    kind = related.schema[group].dataType.simpleString(), left.schema["left"].dataType.simpleString(), right.schema["right"].dataType.simpleString()
    # no nulls in whole numbers, which pandas would make floats
    none = lambda t: F.lit(0 if t.endswith("int") else None).cast(t)
    known = related.select(group, F.lit(0).alias("turn"), "lkey", "rkey", none(kind[1]).alias("left"), none(kind[2]).alias("right")).distinct()
    rights = right.where("key is not null and right is not null").select(group, F.lit(1).alias("turn"), none("string").alias("lkey"), F.col("key").alias("rkey"), none(kind[1]).alias("left"), "right").distinct()
    lefts = left.where("key is not null").select(group, F.lit(2).alias("turn"), F.col("key").alias("lkey"), none("string").alias("rkey"), "left", none(kind[2]).alias("right"))

    def walk():
        keys, queues, used = {}, {}, set()

        def step(row):
            if row.turn == 0:
                keys.setdefault(row.lkey, []).append(row.rkey)
                return None
            if row.turn == 1:
                queues.setdefault(row.rkey, deque()).append(row.right)
                return None
            best = None
            for k in keys.get(row.lkey, ()):
                q = queues.get(k)
                while q and q[0] in used:
                    q.popleft()
                if q and (best is None or q[0] < best[0]):
                    best = q
            if best is None:
                return None
            used.add(best[0])
            return getattr(row, group), row.left, best.popleft()

        return step

    return _streamed(known.unionByName(rights).unionByName(lefts), group, ["turn", "left", "right"], walk, f"`{group}` {kind[0]}, left {kind[1]}, right {kind[2]}")


def _rounds(left: DataFrame, right: DataFrame, related: DataFrame, group: str) -> DataFrame:
    """The rounds, then the walk of what they leave."""
    free = written(left.where("key is not null").select(group, F.col("key").alias("lkey"), "left"), "free")
    takes = written(right.select(group, F.col("key").alias("rkey"), "right").join(related, [group, "rkey"]).select(group, "lkey", "right").distinct(), "open")
    pairs = []
    for round_ in range(ROUNDS + 1):
        free_, takes_ = free, takes
        if round_ == ROUNDS:
            pairs.append(written(_walk_matches(free, takes, group), "pairs"))
            discard(free_, takes_)
            break
        nth = lambda by: F.row_number().over(W.partitionBy(group, "lkey").orderBy(by)).alias("n")
        asked = written(free.select("*", nth("left")).join(takes.select("*", nth("right")), [group, "lkey", "n"], "left").select(group, "lkey", "left", "right"), "asked")
        winner = asked.where("right is not null").groupBy(group, "right").agg(F.min("left").alias("winner"))
        lost = asked.join(winner, [group, "right"]).where("left > winner").groupBy(group).agg(F.min("left").alias("stop"))
        final = written(asked.join(lost, group, "left").select(group, "lkey", "left", "right", (F.col("stop").isNull() | (F.col("left") < F.col("stop"))).alias("final")), "final")
        discard(asked)
        pairs.append(final.where("final and right is not null").select(group, "left", "right"))
        free = written(final.where("not final").select(group, "lkey", "left"), "free")
        if free.isEmpty():
            discard(free, free_, takes_)
            break
        takes = written(takes.join(pairs[-1], [group, "right"], "left_anti").select(group, "lkey", "right").join(free.select(group, "lkey").distinct(), [group, "lkey"], "left_semi"), "open")
        discard(free_, takes_)
    return _union(pairs)


def _walk_matches(free: DataFrame, takes: DataFrame, group: str) -> DataFrame:
    """The walk itself: right rows of a group's keys first, then its left rows in order."""
    kind = free.schema[group].dataType.simpleString(), free.schema["left"].dataType.simpleString(), takes.schema["right"].dataType.simpleString()
    none = lambda t: F.lit(0 if t.endswith("int") else None).cast(t)  # noqa: E731  (see _walk_queues)
    rows = takes.select(group, "lkey", F.lit(0).alias("turn"), none(kind[1]).alias("left"), "right").unionByName(free.select(group, "lkey", F.lit(1).alias("turn"), "left", none(kind[2]).alias("right")))

    def walk():
        rights, used = {}, set()

        def step(row):
            if row.turn == 0:
                rights.setdefault(row.lkey, []).append(row.right)
                return None
            mine = rights.get(row.lkey, [])
            while mine and mine[0] in used:
                mine.pop(0)
            if not mine:
                return None
            used.add(mine[0])
            return getattr(row, group), row.left, mine.pop(0)

        return step

    return _streamed(rows, group, ["turn", "left", "right"], walk, f"`{group}` {kind[0]}, left {kind[1]}, right {kind[2]}")


# ---- suppression -----------------------------------------------------------------------


def greedy_suppress(df: DataFrame, group: str, order: list[str], id_col: str, toks: str) -> DataFrame:
    """(group, id) of rows kept: in order (then by id), a row goes if its tokens meet
    those of a kept row of its group; empty token sets never meet.

    In a round, rows that are first for all of their tokens stay, and what shares a
    token with them goes; of rows with equal tokens only the first takes part.
    """
    none = df.where(F.size(toks) == 0).select(group, id_col)
    first = df.where(F.size(toks) > 0).groupBy(group, F.array_sort(F.array_distinct(toks)).alias("set")).agg(F.min(F.struct(*order, id_col)).alias("place"))
    rows, kept = written(first, "rows"), [none]
    for round_ in range(ROUNDS + 1):
        old = rows
        if round_ == ROUNDS:
            kept.append(written(_walk_sets(rows, group, id_col), "kept"))
            discard(old)
            break
        each = rows.select(group, "place", F.explode("set").alias("token"))
        least = each.groupBy(group, "token").agg(F.min("place").alias("least"))
        met = each.join(least, [group, "token"])
        stays = written(met.groupBy(group, "place").agg(F.every(F.col("place") == F.col("least")).alias("stays"), F.collect_set("token").alias("set")), "marked")  # a set holds a row's own tokens
        kept.append(written(stays.where("stays").select(group, F.col(f"place.{id_col}").alias(id_col)), "kept"))
        taken = stays.where("stays").select(group, F.explode("set").alias("token"))
        beaten = stays.where("not stays").select(group, "place", F.explode("set").alias("token")).join(taken, [group, "token"]).select(group, "place").distinct()
        rows = written(stays.where("not stays").join(beaten, [group, "place"], "left_anti").select(group, "set", "place"), "rows")
        discard(old, stays)
        if rows.isEmpty():
            discard(rows)
            break
    return _union(kept)


def _walk_sets(rows: DataFrame, group: str, id_col: str) -> DataFrame:
    """The walk itself; its state is the tokens that kept rows of a group have."""
    ids = rows.select(f"place.{id_col}").schema[id_col].dataType.simpleString()
    flat = rows.select(group, "place", F.col(f"place.{id_col}").alias("own_id"), "set")

    def walk():
        seen = set()

        def step(row):
            if any(t in seen for t in row.set):
                return None
            seen.update(row.set)
            return getattr(row, group), row.own_id

        return step

    return _streamed(flat, group, ["place"], walk, f"`{group}` {rows.schema[group].dataType.simpleString()}, `{id_col}` {ids}")
