"""Mixing sources to target weights by pivotal dependent rounding of copy counts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, rename_free


def text_size(text_col: str = "text") -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: dict, weights: dict, max_ratio: float = 3.0) -> dict:
    """Targets by source: the weighted shares of the total, none above max_ratio times its source's size.

    The excess of sources at their limit is shared again by weight among the others until none is above.
    """
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / weight > max_ratio * sizes[s]] if weight else []
        if not over:
            return fixed | {s: left * weights[s] / weight for s in free}
        fixed |= {s: max_ratio * float(sizes[s]) for s in over}


def cyclic_weights(sources: list, cycle: tuple = (1, 2, 3)) -> dict:
    """Sources by code point, null last, weigh 1, 2, 3, repeating."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


UNIT = "place bigint, source string, size bigint, part double, group bigint, done boolean"


def _pivotal(seed: int):
    """Rounds within one group: units meet in pairs, the winner of each pair goes on to meet the next.

    A pair moves words, not counts: what one unit's part gains in words the other's loses, as far as one of them
    becomes 0 or 1, in the direction and with the odds that keep both expectations. The group's words stay the same;
    one unit at most stays fractional and goes up the tree.
    """

    def run(batches: Iterator) -> Iterator:
        import random

        import pandas as pd

        for frame in batches:
            frame = frame.sort_values(["order", "place"], kind="stable")
            part, size = frame["part"].to_list(), frame["size"].to_list()
            random_ = random.Random(f"{seed}:{frame['group'].iloc[0]}:{frame['source'].iloc[0]}:{len(part)}")
            done, held = [True] * len(part), None
            for i in range(len(part)):
                if not 0 < part[i] < 1:
                    continue
                if held is None:
                    held = i
                    continue
                j, a, b = held, size[held], size[i]
                up = min((1 - part[j]) * a, part[i] * b)  # words that j can win from i
                down = min(part[j] * a, (1 - part[i]) * b)
                move = up if random_.random() * (up + down) < down else -down
                part[j], part[i] = _snap(part[j] + move / a), _snap(part[i] - move / b)
                held = next((k for k in (j, i) if 0 < part[k] < 1), None)
            if held is not None:
                done[held] = False
            yield pd.DataFrame({"place": frame["place"], "source": frame["source"], "size": frame["size"], "part": part, "group": frame["group"], "done": done})

    return run


def _snap(x: float, eps: float = 1e-9) -> float:
    return 0.0 if x < eps else 1.0 if x > 1 - eps else x


def pivotal_mix(docs: DataFrame, weights=cyclic_weights, max_ratio: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", group_rows: int = 2_000, fan_in: int = 256, seed: int = 11) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, extra_words, taken.

    A document of a source with target T and size S has T/S copies: the whole part is certain, the rest is a
    probability that pivotal rounding makes 0 or 1. Units of a source are dealt by a hash to groups of about
    group_rows; each group leaves one fractional unit at most, fan_in groups' leftovers form a group of the
    next level, until one unit a source is left. It takes that part of its words (extra_words), so a source's
    taken words are its target but for rounding to a word.

    The result depends on ids, texts, sources and seed only, not on how rows are partitioned. Rows that agree in id (null
    included), source and text are units of their own, numbered from 0: which of them has which number doesn't show in
    the result, and no group holds them all. Documents without words take nothing. Null is a source of its own. Very long
    texts are one number here. An empty table gives an empty result. Sources are held on the driver with their totals:
    their number is that of the mix's parts, not of documents. Other columns are not read, whatever their names.
    """
    plan = _plan(docs.select(id_col, text_col, source_col, F.monotonically_increasing_id().alias("place")), weights, max_ratio, id_col, text_col, source_col, group_rows, fan_in, seed)
    return plan.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", "extra_words", (F.col("copies") * F.col("size") + F.col("extra_words")).alias("taken"))


def _plan(rows: DataFrame, weights, max_ratio: float, id_col: str, text_col: str, source_col: str, group_rows: int, fan_in: int, seed: int) -> DataFrame:
    """pivotal_mix of rows that have a unique column place, which is kept."""
    spark, ws = rows.sparkSession, Workspace(rows.sparkSession, "mixing")
    sized = rows.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), text_size(text_col).alias("size"), "place", F.spark_partition_id().alias("run"), F.xxhash64(F.col(id_col), F.col(source_col).cast("string"), F.col(text_col)).alias("key"))
    sized = ws.save(sized, "sized")
    totals = {r[0]: (r[1], r[2]) for r in sized.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    sizes = {s: n for s, (n, _) in totals.items()}
    targets = capped_targets(sizes, weights(list(sizes)) if callable(weights) else weights, max_ratio)
    plan = spark.createDataFrame([(s, sizes[s], float(targets[s]), float(targets[s] / sizes[s]) if sizes[s] else 0.0, max(1, -(-totals[s][1] // group_rows))) for s in sizes], "p_source string, source_size bigint, target double, ratio double, groups bigint")
    rows = sized.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")  # a row per source
    base = F.floor("ratio")
    numbered = rows.join(_numbers(sized), "place", "left").withColumn("number", F.coalesce("number", F.lit(0)))
    units = numbered.filter("size > 0").select("place", "source", "size", (F.col("ratio") - base).alias("part"), F.pmod(F.xxhash64("key", "number", F.lit(seed + 1)), F.col("groups")).alias("group"), F.xxhash64("key", "number", F.lit(seed)).alias("order"))
    open_units = units.filter("part > 1e-9 and part < 1 - 1e-9")
    levels, k, most = [], 0, max([1, *(-(-n // group_rows) for _, n in totals.values())])
    level_in = open_units
    while True:
        solved = ws.save(level_in.groupBy("source", "group").applyInPandas(_one(seed + k), UNIT), f"level{k}")
        levels.append(solved.filter("done"))
        left = solved.filter("not done")
        if most <= 1:
            break
        most, k = -(-most // fan_in), k + 1
        level_in = left.select("place", "source", "size", "part", F.floor(F.col("group") / fan_in).alias("group"), F.xxhash64("size", "part", "group").alias("order"))
    decided = left
    for level in levels:
        decided = decided.unionByName(level)
    joined = rows.join(decided.select("place", F.col("part").alias("got"), "done"), "place", "left")
    rounded = F.when(F.col("got").isNotNull() & F.col("done"), F.col("got")).when(F.col("got").isNull() & (F.col("ratio") - base > 0.5), 1.0).otherwise(0.0)
    extra = F.when(F.col("done") == F.lit(False), F.round(F.col("got") * F.col("size"))).otherwise(F.lit(0)).cast("long")
    return joined.select("place", "id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, base + rounded).otherwise(0).cast("long").alias("copies"), extra.alias("extra_words"))


def _numbers(sized: DataFrame) -> DataFrame:
    """(place, number) of the rows whose key occurs more than once: 0, 1, 2, ... within a key. Rows are numbered within
    (key, run) and shifted by the counts of the runs before, so a key with a third of all rows is in no single task."""
    counts = sized.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row per run
    shifts = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("key"))).filter("all > 1")
    own = F.row_number().over(Window.partitionBy("key", "run").orderBy("place"))
    return sized.select("key", "run", "place").withColumn("own", own).join(shifts.select("key", "run", "shift"), ["key", "run"]).select("place", (F.col("shift") + F.col("own") - 1).alias("number"))


def _one(seed: int):
    run = _pivotal(seed)

    def one(frame):
        return next(run(iter([frame])))

    return one


def mixed_rows(docs: DataFrame, weights=cyclic_weights, max_ratio: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", group_rows: int = 2_000, fan_in: int = 256, seed: int = 11) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; the one leftover document of a source is taken whole
    when at least half of it is due. Rows without words are not taken.

    Rows are written once with a number of their own, by which the plan comes back to them: null and repeated ids, and
    rows that are alike, are each taken by their own count. All columns pass through, whatever their names.
    """
    place, times, copy = (rename_free(docs.columns, c) for c in ("place", "times", "copy"))
    rows = Workspace(docs.sparkSession, "mixed-rows").save(docs.withColumn(place, F.monotonically_increasing_id()), "rows")
    plan = _plan(rows.select(id_col, text_col, source_col, F.col(place).alias("place")), weights, max_ratio, id_col, text_col, source_col, group_rows, fan_in, seed)
    whole = F.col("copies") + (2 * F.col("extra_words") >= F.greatest(F.col("size"), F.lit(1))).cast("int")
    taken = rows.join(plan.select(F.col("place").alias(place), whole.alias(times)).filter(F.col(times) > 0), place)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
