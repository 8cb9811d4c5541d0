"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame operations only.

Each source's documents fall into at most ``BLOCKS`` hashed blocks, permuted by hash. A source's target is met by whole
passes over its blocks and, for the fraction left, by blocks drawn in permuted order as far as they fit, smaller ones
filling what remains. The quotas (blocks to take of each source) are then split down a binary tree of output shards:
at each node a uniformly random half of the node's block units goes left, so the sources' counts on the left follow
the multivariate hypergeometric distribution and the quotas add up exactly. Each shard finally draws its quota as
disjoint runs of the source's permuted block units and shuffles its documents locally by hash.
All choices hash stable values, so reruns agree.

Windows run on the tables of sources and of blocks only: at most ``BLOCKS`` rows for each source, and 3 * BLOCKS units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLOCKS, CAP, LEVELS, FILLS = 1024, 3, 3, 4
WEIGHTS = (5, 2, 1)


def _hash(seed: int, *cols):
    return F.xxhash64(F.lit(seed), *cols)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(s, null_s, source_size, target) from one row (s, null_s, source_size) for each source.

    Sources in code point order, null last, weigh ``weights`` in turn and share all sizes; a target stops at ``cap`` times
    its source's size and the excess goes to the others by weight: min(cap * size, level * weight), with the level that spends all.
    """
    order = Window.orderBy("null_s", "s")
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", (cap * F.col("source_size")).cast("double")).withColumn("fills_at", F.col("most") / F.col("weight"))
    every = Window.partitionBy()
    by_fill = Window.orderBy("fills_at", "i").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns(
        {
            "total": F.sum("source_size").over(every).cast("double"),
            "spent": F.coalesce(F.sum("most").over(by_fill), F.lit(0.0)),
            "weight_left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0)),
        }
    )
    # were this source and all that fill later to share what the earlier ones leave
    ranked = ranked.withColumn("level_here", (F.col("total") - F.col("spent")) / F.col("weight_left"))
    first = F.min(F.when(F.col("level_here") <= F.col("fills_at"), F.struct("fills_at", "i", "level_here"))).over(every)
    ranked = ranked.withColumn("level", first["level_here"])
    target = F.least("most", F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return ranked.select("s", "null_s", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def block_plan(blocks: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """(s, null_s, block, source_size, target, copies): how often the mix takes each block."""
    plan = blocks.join(targets, ["null_s", "s"])
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumns({"passes": passes, "turn": _hash(seed, "block"), "extra": F.lit(0)})
    plan = plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    source = Window.partitionBy("null_s", "s")
    for _ in range(FILLS):
        gap = F.col("rest") - F.sum(F.col("extra") * F.col("size")).over(source)
        plan = plan.withColumn("gap", gap)
        fits = (F.col("extra") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
        reach = F.sum(F.when(fits, F.col("size")).otherwise(0)).over(source.orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, 0))
        plan = plan.withColumn("reach", reach).withColumn("extra", F.when(fits & (F.col("reach") <= F.col("gap")), 1).otherwise(F.col("extra")))
    # one block over the target, if that comes closer
    plan = plan.withColumn("gap", F.col("rest") - F.sum(F.col("extra") * F.col("size")).over(source))
    over = F.struct("size", "turn", "block")
    closest = F.min(F.when((F.col("extra") == 0) & (F.col("size") > 0) & (F.col("size") - F.col("gap") < F.col("gap")), over)).over(source)
    plan = plan.withColumn("last", closest)
    extra = F.when(F.col("last").isNotNull() & (F.col("block") == F.col("last.block")) & (F.col("passes") < CAP), 1).otherwise(F.col("extra"))
    return plan.select("s", "null_s", "block", "source_size", "target", (F.col("passes") + extra).cast("int").alias("copies"))


def shard_quotas(plan: DataFrame, levels: int, seed: int) -> DataFrame:
    """(null_s, s, shard, quota): block units of each source for each of the 2**levels shards, split down the tree."""
    quota = plan.groupBy("null_s", "s").agg(F.sum("copies").cast("int").alias("quota")).where("quota > 0")
    unit = quota.select("null_s", "s", F.explode(F.sequence(F.lit(1), "quota")).alias("unit")).withColumn("shard", F.lit(0))
    for level in range(levels):
        node = Window.partitionBy("shard")
        drawn = F.row_number().over(node.orderBy(_hash(seed + level, "null_s", "s", "unit"), "null_s", "s", "unit"))
        unit = unit.withColumn("shard", F.col("shard") * 2 + (drawn > F.floor((F.count("*").over(node) + 1) / 2)).cast("int"))
    return unit.groupBy("null_s", "s", "shard").agg(F.count("*").cast("int").alias("quota"))


def block_shards(plan: DataFrame, levels: int, seed: int) -> DataFrame:
    """(null_s, s, block, shards): the shard of each of the block's units. Units follow the permuted block order, one pass after the other."""
    units = plan.where("copies > 0").select("null_s", "s", "block", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    order = Window.partitionBy("null_s", "s").orderBy("copy", _hash(seed + 101, "block", "copy"), "block")
    units = units.withColumn("at", F.row_number().over(order))
    upto = Window.partitionBy("null_s", "s").orderBy("shard")
    runs = shard_quotas(plan, levels, seed).withColumn("z", F.sum("quota").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("null_s", "s").agg(F.array_sort(F.collect_list(F.struct("z", "shard"))).alias("runs"))
    placed = units.join(runs, ["null_s", "s"]).select("null_s", "s", "block", F.expr("filter(runs, r -> r.z >= at)[0].shard").alias("shard"))
    return placed.groupBy("null_s", "s", "block").agg(F.array_sort(F.collect_list("shard")).alias("shards"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, keep: tuple[str, ...] = (), levels: int = LEVELS, seed: int = 42) -> DataFrame:
    """Per row: id_col, the ``keep`` columns, size, source_size, target, taken, shards (one entry for each time the mix takes it).

    size is the number of words (runs of characters other than space and U+0009 to U+000D; null: 0). A null source is a
    source of its own, last in order. Texts without words have size 0 and follow their block; texts of any length are counted whole. Repeated rows are
    rows like others and share a block, as do rows with a null id. Blocks that tie in the permuted order follow their number. No row is taken more
    than 3 times. ``keep`` may not hold the names of the result (ValueError). An empty table gives no rows.
    """
    if {c.lower() for c in keep} & {"size", "source_size", "target", "taken", "shards"}:
        raise ValueError("keep clashes with the columns of the result")
    kept = [c for c in keep if c != id_col]
    sized = docs.select(
        F.struct(id_col, *kept).alias("_row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"),
        F.col(source_col).isNull().cast("int").alias("null_s"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.pmod(_hash(seed, F.col(id_col)), F.lit(BLOCKS)).cast("int").alias("block"),
    )
    blocks = sized.groupBy("null_s", "s", "block").agg(F.sum("size").alias("size"))
    targets = source_targets(blocks.groupBy("null_s", "s").agg(F.sum("size").alias("source_size")), weights)
    plan = block_plan(blocks, targets, seed)
    shards = block_shards(plan, levels, seed)
    plan = plan.join(shards, ["null_s", "s", "block"], "left")
    out = sized.join(plan, ["null_s", "s", "block"])
    return out.select(*[F.col("_row")[c].alias(c) for c in (id_col, *kept)], "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def draw(mixed: DataFrame, id_col: str = "doc_id", seed: int = 42, fan: int = 64) -> DataFrame:
    """The mix itself: a row (shard, position key, ...) for each time a row of ``mix`` is taken, shuffled within its shard.

    Each shard is dealt to ``fan`` tasks by position key; an empty mix gives no rows.
    """
    each = mixed.select("*", F.posexplode("shards").alias("copy", "shard")).drop("shards")
    key = _hash(seed + 202, F.col(id_col), F.col("copy"))
    return each.withColumn("order_key", key).repartition("shard", F.pmod(key, F.lit(fan))).sortWithinPartitions("shard", "order_key")
