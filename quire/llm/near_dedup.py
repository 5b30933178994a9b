"""Near-duplicate groups by bottom-k sketches, exact on what the sketches propose.

A document's set is its distinct word shingles, each hashed once to 64 bits; its sketch is the k
least hashes.  Documents with equal sets form a class at once and one representative goes on.

Candidates come from inverted lists of retained values.  Two sets with Jaccard similarity of at
least t share at least ``need`` retained values (all but a chance of ``miss``; for small sets
exactly), so with values in one common order, rarest first, they share one among the first
m - need + 1: only those are listed, which keeps frequent values out of the lists.  A list is never
expanded into all its pairs:

1. Its most central member is its hub, and every member meets the hub only: the similarity of
   the union sketch filters, the full sets decide.
2. A member that is near the hub but not linked (similarity of 2 t - 1 at least) may link to
   another that is.  Jaccard distance is a metric, so any such partner is found among the hub's
   linked members; a semi-join on the full sets that asks for one partner settles it, and distances
   to the hub rule out most.
3. Members that aren't linked to the hub still meet each other, in the first list they share,
   if their wider sketches agree (``wide_k`` values), and are decided on full sets.  A long list is
   cut into chunks of about ``chunk`` members and its pairs of chunks are joined apart, so no list
   lands in one task.

Every pair with similarity t falls under one of the three, so connected components come out
whole.  Components are found by hooking and pointer jumping over tables in the shared folder.

Defined results: null or empty text, or text without words, is linked with nothing and kept; a
text of fewer words than a shingle has its whole word sequence as one; copies are in one group;
rows that share an id are rows of their own, in a group with their equals; a null id ranks
last; of rows with the least id of a group the one with the least row key stays; an empty table gives
no rows; further columns stay as they are where asked for, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Workspace, ascii_lower, release, remove, row_key, stash, table, whole


def with_shingles(docs: DataFrame, words: int) -> DataFrame:
    """docs (with text) and ``set``: sorted distinct 64-bit hashes of the word shingles."""
    text = F.btrim(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(BLANKS))
    w = F.col("__w")
    several = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
    one = F.array(F.xxhash64(F.lit(words), F.array_join(w, " ")))
    found = F.when(F.size(w) >= words, several).when(F.get(w, F.lit(0)) != "", one).otherwise(F.array().cast("array<bigint>"))
    split = docs.withColumn("__w", F.split(text, r"[\x20\x09-\x0D]+", -1))
    return split.withColumn("set", F.sort_array(F.array_distinct(found))).drop("__w")


def least_shared(k: int, similarity: float, miss: float) -> int:
    """Least number of shared values among the k least of a union that sets of this similarity fall below with a chance of at most miss."""
    below, a = 0.0, 0
    while a < k:
        below += math.comb(k, a) * similarity**a * (1 - similarity) ** (k - a)
        if below > miss:
            break
        a += 1
    return max(1, a)


def need_of(n: Column, k: int, t: float, miss: float) -> Column:
    """Values that the sketch of a set of n shingles shares with that of any partner, at least."""
    return F.when(n <= int(k * t), F.ceil(n * F.lit(t) - 1e-9)).otherwise(F.lit(least_shared(k, t, miss))).cast("int")


def linked(inter: Column, a: Column, b: Column, t: float) -> Column:
    """inter / union >= t in whole hundredths."""
    return inter * 100 >= (a + b - inter) * round(100 * t)


def union_sketch_shared(a: Column, b: Column, k: int) -> Column:
    """How many of the k least values of the union both sketches hold."""
    return F.size(F.array_intersect(F.slice(F.sort_array(F.array_union(a, b)), 1, k), F.array_intersect(a, b)))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """edges (u, v) with u > v -> (node, root) for every node that isn't the least of its component."""
    edges, labels, turn = stash(edges.distinct(), f"{folder}/e"), None, 0
    while edges.limit(1).count():
        parent, jump = stash(edges.groupBy("u").agg(F.min("v").alias("p")), f"{folder}/p{turn}"), 0
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = stash(parent.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), f"{folder}/p{turn}-{jump}")
            jump += 1
            parent = jumped.select("u", "p")
            if not jumped.filter("moved").limit(1).count():
                break
        fresh = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        if labels is not None:
            up = parent.select(F.col("u").alias("root"), "p")
            fresh = labels.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root")).unionByName(fresh)
        labels = stash(fresh, f"{folder}/l{turn}")
        moved = edges
        for end in ("u", "v"):
            moved = moved.join(parent.select(F.col("u").alias(end), F.col("p").alias(f"{end}p")), end, "left").withColumn(end, F.coalesce(f"{end}p", end)).drop(f"{end}p")
        moved = moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        turn += 1
        edges = stash(moved, f"{folder}/e{turn}")
    return edges.sparkSession.createDataFrame([], "node long, root long") if labels is None else labels


def _roots(rows: DataFrame, labels: DataFrame, name: str, root: str) -> DataFrame:
    """rows with the component of its column name as column root."""
    return rows.join(labels.select(F.col("node").alias(name), F.col("root").alias("__r")), name, "left").withColumn(root, F.coalesce("__r", name)).drop("__r")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, t: float = 0.8, k: int = 64, wide_k: int = 128, miss: float = 1e-7, chunk: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id, keeper, k1, k2) for every row of docs; keeper marks one row
    of each group, k1 and k2 are the key of the whole row (``row_key``)."""
    if t < 0.8:
        raise ValueError("similarities below 0.8 are not supported")
    with Workspace(docs.sparkSession, "near") as work:
        return work.result(_groups(docs, id_col, text_col, words, t, k, wide_k, miss, chunk, work.folder))


def _groups(docs: DataFrame, id_col: str, text_col: str, words: int, t: float, k: int, wide_k: int, miss: float, chunk: int, folder: str) -> DataFrame:
    spark = docs.sparkSession
    sets_of = lambda d: with_shingles(d, words).withColumns({"n": F.size("set"), "c1": F.xxhash64("set"), "c2": F.xxhash64(F.lit(7), "set")})
    plain = docs.select(whole("all"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", row_key(docs, "all")).select("doc_id", "text", "key.k1", "key.k2")
    wide_sketch = F.transform(F.slice("set", 1, wide_k), lambda h: F.shiftright(h, 32).cast("int"))  # upper halves: in the same order
    sketched = stash(sets_of(plain).select(F.monotonically_increasing_id().alias("row"), "doc_id", "k1", "k2", "n", "c1", "c2", F.slice("set", 1, k).alias("sk"), wide_sketch.alias("sk2")), f"{folder}/sketches")

    # Classes of equal sets.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "row"))
    classes = sketched.filter("n > 0").groupBy("c1", "c2", "n").agg(least.alias("first"), F.min_by(F.struct("sk", "sk2"), "row").alias("s"))
    reps = stash(classes.select("first.row", "first.doc_id", "first.k1", "first.k2", "n", "c1", "c2", "s.sk", "s.sk2"), f"{folder}/reps")
    fat, sketched = f"{folder}/sketches", stash(sketched.drop("sk", "sk2"), f"{folder}/rows")
    remove(spark, fat)

    # Inverted lists of the rarest retained values.
    held = reps.select("row", "n", F.size("sk").alias("m"), F.explode("sk").alias("v"))
    counts = stash(held.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), f"{folder}/counts")
    shared = held.join(counts, "v").groupBy("row", "n", "m").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("vs"), F.sum(F.log2("c")).alias("central"))
    first = F.col("m") - need_of(F.col("n"), k, t, miss) + 1 - (F.col("m") - F.size("vs"))
    prefixed = shared.withColumn("first", first).filter("first > 0").select("row", "n", "central", F.slice(F.col("vs.v"), 1, F.col("first")).alias("prefix"))
    prefixed = stash(prefixed, f"{folder}/prefixes")
    listed = prefixed.select("row", "n", "central", F.explode("prefix").alias("v"))
    hubs = listed.groupBy("v").agg(F.max(F.struct("central", (-F.col("row")).alias("minus"), "n")).alias("top"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    hubs = stash(hubs.select("v", (-F.col("top.minus")).alias("hub"), F.col("top.n").alias("hub_n")), f"{folder}/hubs")
    release(spark)

    # 1. Every member meets its hubs.
    wide = 2 * t - 1
    fit = lambda a, b, s: F.least(a, b) >= s * F.greatest(a, b) - 1e-9
    met = listed.join(hubs, "v").filter((F.col("row") != F.col("hub")) & fit(F.col("n"), F.col("hub_n"), wide)).select("row", "hub").distinct()
    sk = reps.select("row", "n", F.slice("sk2", 1, k).alias("sk"))
    hub_sk = sk.withColumnsRenamed({"row": "hub", "n": "hub_n", "sk": "hub_sk"})
    few = F.least(F.lit(least_shared(k, wide, miss * 10)), F.ceil(F.least("n", "hub_n") * wide - 1e-9))
    alike = stash(met.join(sk, "row").join(hub_sk, "hub").filter(union_sketch_shared(F.col("sk"), F.col("hub_sk"), k) >= few).select("row", "hub"), f"{folder}/alike")
    release(spark)

    def sets_for(rows: DataFrame, label: str) -> DataFrame:
        """(row, n, set) of these representatives, from their whole texts."""
        wanted = reps.join(rows.distinct(), "row").select("row", "k1", "k2")
        texts = plain.join(wanted, ["k1", "k2"]).groupBy("row").agg(F.first("text").alias("text"))  # equal rows have one key
        out = stash(sets_of(texts).select("row", "n", "set"), f"{folder}/sets-{label}")
        release(spark)
        return out

    sets = sets_for(alike.select("row").unionByName(alike.select(F.col("hub").alias("row"))), "hubs")
    hub_sets = sets.withColumnsRenamed({"row": "hub", "n": "hub_n", "set": "hub_set"})
    inter = F.size(F.array_intersect("set", "hub_set"))
    exact = alike.join(sets, "row").join(hub_sets, "hub").select("row", "hub", "n", "hub_n", inter.alias("inter"))
    exact = exact.withColumns({"far": 1 - F.col("inter") / (F.col("n") + F.col("hub_n") - F.col("inter")), "link": linked(F.col("inter"), F.col("n"), F.col("hub_n"), t)})
    exact = stash(exact.filter(F.col("far") <= 2 * (1 - t) + 1e-9).select("row", "hub", "far", "link"), f"{folder}/exact")
    edge = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = exact.filter("link").select(*edge("row", "hub"))
    labels = components(edges, f"{folder}/cc1")

    # 2. Near the hub, not linked to it: is any linked member a partner?
    near = _roots(_roots(exact.filter("NOT link"), labels, "row", "own"), labels, "hub", "its").filter("own <> its")
    near = near.select("row", "hub", "far").join(sets, "row")
    tied = exact.filter("link").select(F.col("row").alias("y"), F.col("hub").alias("y_hub"), F.col("far").alias("y_far")).join(sets.withColumnsRenamed({"row": "y", "n": "y_n", "set": "y_set"}), "y")
    near_in, tied_in = stash(near, f"{folder}/near"), stash(tied.join(near.select(F.col("hub").alias("y_hub")).distinct(), "y_hub", "left_semi"), f"{folder}/tied")
    with_tied = (F.col("hub") == F.col("y_hub")) & (F.abs(F.col("far") - F.col("y_far")) <= 1 - t + 1e-9) & fit(F.col("n"), F.col("y_n"), t) & linked(F.size(F.array_intersect("set", "y_set")), F.col("n"), F.col("y_n"), t)
    more = stash(near_in.join(tied_in, with_tied, "left_semi").select("row", "hub"), f"{folder}/semi")
    edges = edges.unionByName(more.select(*edge("row", "hub")))
    labels = components(edges, f"{folder}/cc2")
    remove(spark, f"{folder}/near", f"{folder}/tied")

    # 3. Members that aren't linked to their list's hub, among each other.
    remove(spark, f"{folder}/sets-hubs")
    done = exact.filter("link").select("row", "hub")
    # Sizes of a linked pair lie within a factor of 1 / t: a pair meets in the size class of the larger
    # one, where the smaller one stands too if its own class is the same or the one below.
    size = F.floor(F.log("n") / (math.log(1 / t) * (1 + 1e-9))).cast("int")
    unlinked = prefixed.select("row", size.alias("size"), F.explode("prefix").alias("v")).join(hubs.select("v", "hub"), "v").filter("row <> hub")
    unlinked = stash(unlinked.join(done, ["row", "hub"], "left_anti").select("v", "row", "size"), f"{folder}/unlinked")
    several = unlinked.groupBy("v").agg(F.count(F.lit(1)).alias("s")).filter("s > 1").select("v")
    unlinked = unlinked.join(several, "v", "left_semi").select("v", "row", "size", F.explode(F.array("size", F.col("size") + 1)).alias("class"))
    unlinked = stash(unlinked, f"{folder}/classes")
    several = unlinked.groupBy("v", "class").agg(F.count(F.lit(1)).alias("s"), F.count_if(F.col("size") == F.col("class")).alias("own")).filter("s > 1 AND own > 0").select("v", "class", F.ceil(F.col("s") / chunk).cast("int").alias("chunks"))
    unlinked = stash(unlinked.join(several, ["v", "class"]), f"{folder}/several")
    remove(spark, f"{folder}/unlinked", f"{folder}/classes")
    release(spark)
    upper = F.transform("prefix", lambda h: F.shiftright(h, 32).cast("int"))
    lists = unlinked.groupBy("row").agg(F.first("size").alias("size"), F.collect_list(F.struct("v", "class", "chunks")).alias("lists"))
    info = prefixed.select("row", "n", upper.alias("prefix")).join(lists, "row").join(reps.select("row", "sk2"), "row")
    info = stash(_roots(info, labels, "row", "root"), f"{folder}/info")
    rest = info.select("row", "n", "size", "root", "prefix", "sk2", F.explode("lists").alias("l")).select("row", "n", "size", "root", "prefix", "sk2", "l.*")
    # A member goes to every pair of chunks that its own is in; a pair within a chunk meets in (chunk, chunk) only.
    rest = rest.withColumn("own", F.pmod(F.xxhash64("row", "v"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rest = rest.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("chunks", "other")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    agree = (x("v") == y("v")) & (x("class") == y("class")) & (x("low") == y("low")) & (x("high") == y("high")) & ((x("own") != y("own")) | (x("low") == x("high")))
    agree = agree & (F.greatest(x("size"), y("size")) == x("class")) & (x("row") > y("row")) & (x("root") != y("root")) & fit(x("n"), y("n"), t)
    agree = agree & (F.get(F.array_intersect(x("prefix"), y("prefix")), F.lit(0)) == F.shiftright(x("v"), 32).cast("int"))
    agree = agree & (union_sketch_shared(x("sk2"), y("sk2"), wide_k) >= F.greatest(*[need_of(c("n"), wide_k, t, miss) for c in (x, y)]))
    pairs = stash(rest.alias("x").join(rest.alias("y"), agree).select(x("row").alias("row"), y("row").alias("row_")), f"{folder}/pairs")
    release(spark)
    sets = sets_for(pairs.select("row").unionByName(pairs.select(F.col("row_").alias("row"))), "rest")
    found = pairs.join(sets, "row").join(sets.withColumnsRenamed({"row": "row_", "n": "n_", "set": "set_"}), "row_")
    found = stash(found.filter(linked(F.size(F.array_intersect("set", "set_")), F.col("n"), F.col("n_"), t)).select(*edge("row", "row_")), f"{folder}/found")
    labels = components(edges.unionByName(found), f"{folder}/cc3")

    # Back to classes, then to all rows.
    rooted = stash(_roots(reps.select("row", "doc_id", "k1", "k2", "n", "c1", "c2"), labels, "row", "root"), f"{folder}/rooted")
    tops = stash(rooted.groupBy("root").agg(least.alias("top")), f"{folder}/tops")
    named = stash(rooted.join(tops, "root").select("c1", "c2", "n", F.col("top.doc_id").alias("component_id"), F.col("top.row").alias("top")), f"{folder}/named")
    out = sketched.select("row", "doc_id", "k1", "k2", "n", "c1", "c2").join(named, ["c1", "c2", "n"], "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("row") == F.col("top"))).alias("keeper"), "k1", "k2")


def near_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, t: float = 0.8) -> DataFrame:
    """One row of each group, with all its columns."""
    kept = near_groups(docs, id_col, text_col, words, t).filter("keeper").groupBy("k1", "k2").agg(F.count(F.lit(1)).cast("int").alias("n"))
    keyed = docs.select(whole()).withColumn("key", row_key(docs)).select("row", "key.k1", "key.k2").join(kept, ["k1", "k2"])
    # Equal rows have one key; more than one of them stays only where they have no words.
    once = keyed.dropDuplicates(["k1", "k2"])
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
