"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, or as given. They share all tokens by
weight; no target passes ``max_repeat`` times its source's size, and the excess goes to the others by weight.
Blocks of ``block`` tokens go to sources by highest quotient votes / (2 * seats + 1), then from each source to its
shards in the same way with the shard sizes as votes. In a shard the documents lie one behind the other in seeded
order; whole rounds take every token once, and the rest of the quota takes every n-th block from a seeded start.

Null text: size 0, taken 0. Null source: a source of its own. Repeated rows: each is a document. Equal order keys
are equal rows, so their places can be exchanged without changing the result. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import WORD, packed, small

BLOCK = 8
SHARD_TOKENS = 4_000_000
MAX_REPEAT = 3
SEED = 20_260


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(docs[id_col].cast("long").isNull(), F.coalesce(docs[text_col], F.lit("")), docs[source_col]).alias("u2"),
    )


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))


def targets(sized: DataFrame, max_repeat: int = MAX_REPEAT, weights: dict[str, float] | None = None) -> DataFrame:
    """key, source, source_size, target. One row a source: its windows hold names and totals, never documents."""
    src = sized.groupBy(_source_key().alias("key")).agg(F.first("source", ignorenulls=True).alias("source"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    cyclic = ((F.row_number().over(order) - 1) % 3 + 1).cast("double")
    if weights is not None:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        cyclic = F.coalesce(given[F.col("source")].cast("double"), F.lit(0.0))
    src = src.withColumn("weight", cyclic).withColumn("cap", F.col("source_size") * max_repeat)
    # filled in order of cap / weight: once a source is not full at its turn, no later one is
    src = src.withColumn("fills_at", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    turn = Window.orderBy("fills_at", "key")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(turn.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("level", F.when(after > 0, (F.sum("source_size").over(everything) - before) / after))
    level = F.min(F.when(F.col("fills_at") >= F.col("level"), F.struct("fills_at", "key", "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    return src.select("key", "source", "source_size", F.when(F.col("weight") > 0, target).otherwise(0.0).alias("target"))


def apportion(parties: DataFrame, group: list[str], name: str, votes: str, seats: str) -> DataFrame:
    """group, name, won: Sainte-Lague seats. ``seats`` is the number to give out, one value per group.

    The divisor that fits lies so near total / seats that each party's result is known up to a few seats; only
    those few quotients per party are listed and ranked, never one row per seat.
    """
    real = parties.filter(F.col(votes) > 0)
    g = Window.partitionBy(*group)
    exact = F.col(votes) * F.col(seats) / F.sum(votes).over(g)
    margin = F.count(F.lit(1)).over(g) / (2 * F.greatest(F.col(seats), F.lit(1)))
    low = F.greatest(F.lit(0), F.ceil(exact * (1 - margin) - 0.5) - 1).cast("long")
    high = (F.floor(exact * (1 + margin) + 0.5) + 1).cast("long")
    bounds = real.select(*group, name, F.col(votes).alias("v"), F.col(seats).alias("n"), low.alias("low"), high.alias("high"))
    bounds = bounds.withColumn("left", F.col("n") - F.sum("low").over(g))
    few = bounds.select(*group, name, "v", "left", F.explode(F.sequence("low", F.col("high") - 1)).alias("k")).withColumn("quotient", F.col("v") / (2 * F.col("k") + 1))
    ranked = few.withColumn("place", F.row_number().over(g.orderBy(F.desc("quotient"), name, "k")))
    more = ranked.filter("place <= left").groupBy(*group, name).agg(F.count(F.lit(1)).alias("more"))
    won = bounds.join(more, [*group, name], "left")
    return won.select(*group, name, (F.col("low") + F.coalesce("more", F.lit(0))).alias("won"))


def _taken_before(x: Column, blocks: Column, chosen: Column, start: Column, block: int) -> Column:
    """Tokens of chosen blocks before token x: block b is chosen where (b * chosen + start) mod blocks < chosen."""
    b = F.floor(x / block).cast("long")
    count = F.floor((b * chosen + start + blocks - chosen) / blocks) - F.floor((start + blocks - chosen) / blocks)
    inside = F.pmod(b * chosen + start, blocks) < chosen
    return count.cast("long") * block + F.when(inside, x - b * block).otherwise(0)


def mix(sized: DataFrame, goal: DataFrame, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """doc_id, u2, source, size, source_size, target, taken for each row of `sized`, given the rows of `targets`."""
    group = goal.withColumn("all", F.lit(1)).withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    quota = apportion(group, ["all"], "key", "target", "seats").select("key", F.col("won").alias("source_blocks"))
    goal = settle(goal.join(quota, "key", "left").withColumn("source_blocks", F.coalesce("source_blocks", F.lit(0))))

    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("long")
    docs = sized.withColumn("key", _source_key()).join(small(goal.drop("source")), "key")
    docs = docs.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("shard", F.pmod("place", shards))
    per_shard = docs.groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("seats"))
    won = apportion(per_shard, ["key"], "shard", "shard_size", "seats")
    take = F.least(F.col("won") * block, F.col("shard_size") * max_repeat)
    rest = F.pmod(take, F.col("shard_size"))
    plan = per_shard.join(won, ["key", "shard"]).select(
        "key",
        "shard",
        F.floor(take / F.col("shard_size")).cast("long").alias("rounds"),
        F.ceil(F.col("shard_size") / block).cast("long").alias("blocks"),
        F.round(rest / block).cast("long").alias("chosen"),
    )
    plan = settle(plan.withColumn("chosen", F.when(F.col("rounds") < max_repeat, F.least("chosen", "blocks")).otherwise(0)).withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "key", "shard"), "blocks")))

    lined = docs.withColumn("end", F.sum("size").over(Window.partitionBy("key", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    out = lined.join(plan, ["key", "shard"], "left")
    args = (F.col("blocks"), F.col("chosen"), F.col("start"), block)
    extra = F.when(F.col("chosen") > 0, _taken_before(F.col("end"), *args) - _taken_before(F.col("end") - F.col("size"), *args)).otherwise(0)
    taken = F.when(F.col("size") > 0, F.coalesce(F.col("rounds") * F.col("size") + extra, F.lit(0))).otherwise(0)
    return out.select("doc_id", "u2", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The whole operator: sizes, targets, quotas and the share of each document."""
    sized = settle(sizes(docs))
    return mix(sized, settle(targets(sized)), **options)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The rows of `docs` as often as the mix takes them. A part of a document counts as the whole with a chance of
    that part, drawn from the row's seeded hash, so the sums keep to the targets and reruns agree. Rows without
    words are not in the mix."""
    sized = settle(sizes(docs, id_col, text_col, source_col))
    taken = mix(sized, settle(targets(sized)), seed=seed, **options)
    # repeated rows share their words evenly
    share = taken.groupBy("doc_id", "u2").agg(F.avg("taken").alias("taken"), F.max("size").alias("size")).filter("size > 0")
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "u2"), F.col("size"))
    share = share.select(F.col("doc_id").alias("k"), "u2", F.floor((F.col("taken") + chance) / F.col("size")).cast("int").alias("copies")).filter("copies > 0")
    r = F.col("row")
    rows = packed(docs).withColumns({"k1": r[id_col].cast("long"), "k2": F.xxhash64(r[id_col].cast("long").isNull(), F.coalesce(r[text_col], F.lit("")), r[source_col])})
    chosen = rows.join(share, rows.k1.eqNullSafe(share.k) & (rows.k2 == share.u2))
    return chosen.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
