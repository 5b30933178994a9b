"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: the sources share the whole budget by weight; a source whose share passes
   ``max_passes`` times its own words stops there and the rest is shared again by weight.
   That fixed point is a water level over the sources, found by Newton's method: each step is
   one aggregate over the sources, and the level is exact when no further source fills up.
2. Seats: the budget is ``budget / block_words`` blocks.  Sources get blocks by the highest
   quotients target / (2 n + 1).  Between two divisors that bracket the answer at most two
   quotients a party remain to be ranked, so no list of all seats is ever made.
3. The seats of a source go to its shards in the same way, by the shards' words: an integer
   quota for every (source, shard).  A shard is a hash bucket of documents; a large source has
   more of them, so a source with a third of all rows is spread.  No shard can give more than
   ``max_passes`` times its blocks: seats beyond that are dealt again, by room, to shards that have room.
4. Within a shard the documents stand in seeded order as one stream that is cut into blocks of
   equal words (to one word; about ``block_words`` each), so no part-filled block stands for a whole one.
   A quota of q blocks is floor(q / blocks) whole passes and a seeded selection of the rest: an
   affine permutation of the block numbers, so no block is ever a row.

Only ids, sources, sizes and row keys move; texts do not.

Defined results: null text has size 0; a null source is a source of its own, ordered last; a
source without words has target 0; repeated rows are rows like others (which of two rows that are equal
in every column gets the larger share is the only freedom); rows that differ in any column keep
their own shares; an empty table gives no rows; further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, row_key, table, whole

#: Multipliers of the affine permutations: primes above any number of blocks in a shard.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_filled_targets(sources: DataFrame, max_passes: float = 3.0) -> DataFrame:
    """sources: (source, weight, words), a row per source -> the same with ``target``.

    The total of the targets is the total of the words, where the weights allow it.  Newton's steps on the
    total as a concave function of the level: a level that fills some sources is too low, and the
    open sources' shares of what is left give the next; it ends when no source fills up any more."""
    room, weight = F.col("words") * F.lit(float(max_passes)), F.col("weight")
    level, filled = 0.0, -1
    while True:
        full = room <= weight * level if filled >= 0 else F.lit(False)
        own = sources.filter("weight > 0").agg(F.count_if(full).alias("n"), F.sum(F.when(full, room)).alias("room"), F.sum(F.when(~full, weight)).alias("weight")).first()
        if own["n"] == filled or not own["weight"]:
            break
        total = sources.agg(F.sum("words")).first()[0] or 0
        filled, level = own["n"], (total - (own["room"] or 0.0)) / own["weight"]
    everything = F.lit(not own["weight"]) & (weight > 0)  # all that may be taken is full
    return sources.withColumn("target", F.when(everything, room).otherwise(F.least(room, weight * F.lit(level))).cast("double"))


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: Column) -> DataFrame:
    """Adds ``seats``: the seats of each group dealt to its parties by the highest quotients
    votes / (2 n + 1); ties go to the smaller party columns, nulls last.

    floor(v / d + 1/2) seats with divisor d give between N - m / 2 and N + m / 2 in total for m
    parties when sum(v) / d is N; so the divisors for N - m / 2 and N + m / 2 bracket it."""
    g = Window.partitionBy(*group)
    total, m = F.sum(votes).over(g), F.sum((F.col(votes) > 0).cast("long")).over(g)
    p = parties.withColumn("n__", seats.cast("double")).withColumns({"total__": total, "m__": m})
    at = lambda n: F.when((F.col(votes) > 0) & (n > 0), F.floor(F.col(votes) * n / F.col("total__") + 0.5)).otherwise(F.lit(0)).cast("long")
    p = p.withColumns({"low__": at(F.col("n__") - F.col("m__") / 2), "high__": at(F.col("n__") + F.col("m__") / 2)})
    p = p.withColumn("left__", F.col("n__") - F.sum("low__").over(g))
    tries = p.filter(F.col("high__") > F.col("low__")).select(*group, *party, "left__", F.explode(F.sequence(F.col("low__"), F.col("high__") - 1)).alias("k__"), F.col(votes).alias("v__"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy((F.col("v__") / (2 * F.col("k__") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in party], F.col("k__")))
    won = tries.withColumn("rank__", rank).filter(F.col("rank__") <= F.col("left__")).groupBy(*group, *party).agg(F.count(F.lit(1)).alias("won__"))
    won = won.withColumnsRenamed({c: f"{c}__" for c in [*group, *party]})
    on = _all([F.col(c).eqNullSafe(F.col(f"{c}__")) for c in [*group, *party]])
    out = p.join(won, on, "left").select(*parties.columns, (F.col("low__") + F.coalesce("won__", F.lit(0))).alias("seats"))
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def capped_seats(parties: DataFrame, group: str, party: str, votes: str, seats: Column, most: str, work: Workspace) -> DataFrame:
    """sainte_lague with at most ``most`` seats a party.  What a party can't take is dealt again by room:
    no party then gets more than its room, as the divisor of that deal is 1 at least."""
    dealt = sainte_lague(parties, [group], [party], votes, seats)
    g = Window.partitionBy(group)
    over, room = F.greatest(F.col("seats") - F.col(most), F.lit(0)), F.greatest(F.col(most) - F.col("seats"), F.lit(0))
    dealt = work.stash(dealt.withColumns({"over__": F.sum(over).over(g), "room__": room}), f"dealt-{party}")
    again = dealt.withColumn("again__", F.least("over__", F.sum("room__").over(g))).withColumn("first__", F.least("seats", most)).drop("seats")
    return sainte_lague(again, [group], [party], "room__", F.col("again__")).withColumn("seats", F.col("first__") + F.col("seats")).drop("over__", "room__", "again__", "first__")


def mix_quotas(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_words: int = 64, max_passes: int = 3, shard_words: int = 32768, max_shards: int = 1 << 17, seed: int = 20240229) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, k1, k2) for every row of docs.

    weights: (source, weight); without it sources in code-point order, null last, weigh 1, 2, 3, 1, ...
    A shard has shard_words words, 64 blocks at least: in much smaller ones equal blocks would be far from block_words.
    taken: words of this row in the mix, repeats counted.  copies: whole copies of the row whose
    running total follows the running total of taken / size within the shard (0 to max_passes).
    k1, k2: the key of the whole row (``row_key``)."""
    with Workspace(docs.sparkSession, "mix") as work:
        packed = docs.select(whole(), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
        sized = work.stash(packed.withColumn("key", row_key(docs)).select("doc_id", "source", "size", "key.k1", "key.k2"), "sizes")
        totals = sized.groupBy("source").agg(F.sum("size").alias("words"))
        if weights is None:
            order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # names of sources only
            sources = totals.withColumn("weight", ((order - 1) % 3 + 1).cast("long"))
        else:
            w = weights.select(F.col("source").alias("s_"), F.col("weight").alias("w_"))
            sources = totals.join(w, F.col("source").eqNullSafe(F.col("s_")), "left").select("source", "words", F.coalesce("w_", F.lit(0)).alias("weight"))
        sources = water_filled_targets(work.stash(sources, "totals"), max_passes).withColumn("group", F.lit(0))
        seats = F.floor(F.sum("target").over(Window.partitionBy()) / block_words + 0.5)
        sources = sainte_lague(sources, ["group"], ["source"], "target", seats).withColumnRenamed("seats", "source_seats")
        shards = F.least(F.greatest(F.ceil(F.col("words") / max(shard_words, 64 * block_words)), F.lit(1)), F.lit(max_shards)).cast("int")
        number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        sources = work.stash(sources.withColumns({"shards": shards, "s": number}).drop("group"), "sources")
        # A row per source: the join sends it to every task when it is small, as its size decides.
        shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "k1", "k2"), F.col("shards")).cast("int")
        placed = sized.join(sources.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).withColumn("shard", shard)
        held = placed.groupBy("s", "shard", "source_seats").agg(F.sum("size").alias("shard_words"))
        # Blocks of equal words, as near to block_words as a whole number of them comes.
        blocks = F.greatest(F.floor(F.col("shard_words") / block_words + 0.5), F.lit(1)).cast("long")
        held = work.stash(held.withColumn("blocks", blocks).withColumn("most", F.when(F.col("shard_words") > 0, max_passes * F.col("blocks")).otherwise(F.lit(0)).cast("long")), "held")
        quotas = work.stash(capped_seats(held, "s", "shard", "shard_words", F.col("source_seats"), "most", work).select(F.col("s").alias("s_"), F.col("shard").alias("k_"), "shard_words", "blocks", "seats"), "quotas")
        joined = placed.join(quotas, (F.col("s") == F.col("s_")) & (F.col("shard") == F.col("k_")))
        stream = Window.partitionBy("s", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "size", "k1", "k2")
        running = stream.rowsBetween(Window.unboundedPreceding, 0)
        joined = joined.withColumn("end", F.sum("size").over(running)).withColumn("begin", F.col("end") - F.col("size"))
        joined = joined.withColumns({"passes": F.floor(F.col("seats") / F.col("blocks")), "rest": F.col("seats") % F.col("blocks")})
        pick = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.lit(len(PRIMES))).cast("int")
        joined = joined.withColumns({"step": F.get(F.array(*[F.lit(p) for p in PRIMES]), pick), "shift": F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.col("blocks"))})
        chosen = lambda b: F.pmod(b * F.pmod(F.col("step"), F.col("blocks")) + F.col("shift"), F.col("blocks")) < F.col("rest")
        # Block b holds the words from floor(b * words / blocks) on; word w stands in block ((w + 1) * blocks - 1) div words.
        cut = lambda b: F.floor(b * F.col("shard_words") / F.col("blocks"))
        block_of = lambda w: F.floor(((w + 1) * F.col("blocks") - 1) / F.col("shard_words"))
        part = lambda b: F.least(F.col("end"), cut(b + 1)) - F.greatest(F.col("begin"), cut(b))
        spanned = F.sequence(block_of(F.col("begin")), block_of(F.col("end") - 1))
        some = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.aggregate(spanned, F.lit(0).cast("long"), lambda t, b: t + F.when(chosen(b), part(b)).otherwise(F.lit(0)))).otherwise(F.lit(0))
        joined = joined.withColumn("taken", (F.col("passes") * F.col("size") + some).cast("long"))
        share = F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0.0)))
        offset = F.pmod(F.xxhash64(F.lit(seed + 1), "source", "shard"), F.lit(1000)) / 1000.0
        joined = joined.withColumn("upto", F.floor(F.round(share.over(running), 9) + offset)).withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(stream), F.lit(0)))
        return work.result(joined.select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", "taken", F.col("copies").cast("int").alias("copies"), "k1", "k2"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """docs with each row as many times as the mix takes it whole; all columns stay.

    Rows that are equal in every column share their copies, as nothing tells them apart."""
    taken = mix_quotas(docs, None, id_col, source_col, text_col, **options).groupBy("k1", "k2").agg(F.sum("copies").cast("int").alias("n")).filter("n > 0")
    keyed = docs.select(whole()).withColumn("key", row_key(docs)).select("row", "key.k1", "key.k2").join(taken, ["k1", "k2"])
    once = keyed.dropDuplicates(["k1", "k2"])
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_quotas(docs).select("doc_id", "size", "source_size", "target", "taken")
