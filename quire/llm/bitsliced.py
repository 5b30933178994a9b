"""Exact top-k inner products over a bit-sliced index.

Rows are cut into blocks.  A block's index holds, for every attribute, the bits of its quantised
values as bitmaps over the rows (value minus the block's least, so all are unsigned), and the
rows' ids in ascending order.  A query's scores come from bitmap arithmetic alone: each attribute
contributes its slices shifted by the set bits of the query's value; for a negative value the
complements of the slices are added and a constant is put right at the end.  Slices of one weight
are added three at a time by full adders (sum and carry bitmaps) until one is left.  The top k are
taken from the most significant slice downward: rows that are surely in, rows still tied.
Boundary ties go to the smallest ids, which are the first set bits.

Every query meets every block.  Queries are cut into groups; a task takes a group and a run of
blocks, one after the other, so a block is copied once per group and a group once per run.  Blocks
and groups are cut by bytes of their integers (sent as one, two, four or eight bytes a component), and groups
are made smaller where there would be fewer tasks than cores.  A block whose bound (the best score
that its least and greatest values allow) stays below the k-th score that the query has from the
blocks before is skipped.  The k best of each block are merged by query row.

Defined results: vectors that are null, empty, or hold null or non-finite components take no
part, nor do rows without an id; rows that share an id are rows of their own, as queries and as
candidates, and only a query's own row is left out of its candidates; vectors are compared with
those of the same length only; a query with no candidates gives no rows; an empty table too.
So that every score fits 63 bits, a quantised component beyond isqrt(2^62 / length) either way (2^28 for
64 components) counts as that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, table


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component within the bounds; null where the vector takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    most = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.size(vector))).cast("double")
    fits = F.size(vector) > 0
    return F.when(fits & ~F.coalesce(bad, F.lit(True)), F.transform(doubles, lambda x: F.greatest(-most, F.least(most, F.floor(x * scale).cast("double"))).cast("long")))


class Slices:
    """The bit-sliced index of one block: values[row][attribute] of int64, rows in order of id."""

    def __init__(self, values: np.ndarray):
        self.rows, self.width = len(values), -(-len(values) // 64)
        values = values.astype(np.int64)
        self.least, self.most = (values.min(axis=0), values.max(axis=0)) if self.rows else (np.zeros(values.shape[1], np.int64),) * 2
        shifted = values - self.least
        self.all = self._bitmap(np.ones(self.rows, bool))
        self.slices, self.inverse, self.top = [], [], []
        for d in range(values.shape[1]):
            column, most = shifted[:, d], int(shifted[:, d].max(initial=0))
            own = [self._bitmap((column >> b) & 1 == 1) for b in range(most.bit_length())]
            self.slices.append(own)
            self.inverse.append([~x & self.all for x in own])
            self.top.append((1 << len(own)) - 1)

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        packed = np.zeros(self.width * 8, np.uint8)
        own = np.packbits(bits, bitorder="little")
        packed[: len(own)] = own
        return packed.view(np.uint64)

    def scores(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices of the unsigned score, least significant first, and what to add to it."""
        by_weight: list[list[np.ndarray]] = [[]]
        constant = 0
        for d, q in enumerate(query):
            constant += q * int(self.least[d])
            if not q:
                continue
            if q < 0:  # q * v = -q * (top - v) + q * top
                own, q = self.inverse[d], -q
                constant -= q * self.top[d]
            else:
                own = self.slices[d]
            for shift in range(q.bit_length()):
                if q >> shift & 1:
                    while len(by_weight) < shift + len(own):
                        by_weight.append([])
                    for b, bitmap in enumerate(own):
                        by_weight[shift + b].append(bitmap)
        out, weight = [], 0
        x, y = np.empty(self.width, np.uint64), np.empty(self.width, np.uint64)
        while weight < len(by_weight):
            column = by_weight[weight]
            carry: list[np.ndarray] = []
            while len(column) > 1:
                a, b = column.pop(), column.pop()
                if column:  # full adder
                    c = column.pop()
                    np.bitwise_xor(a, b, out=x)
                    np.bitwise_and(a, b, out=y)
                    total = x ^ c
                    np.bitwise_and(x, c, out=x)
                    carry.append(x | y)
                else:
                    total = a ^ b
                    carry.append(a & b)
                column.insert(0, total)
            out.append(column[0] if column else np.zeros(self.width, np.uint64))
            if carry:
                if weight + 1 == len(by_weight):
                    by_weight.append([])
                by_weight[weight + 1].extend(carry)
            weight += 1
        return out, constant

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query a score that no row exceeds."""
        return np.maximum(queries * self.least, queries * self.most).sum(axis=1)

    def best(self, query: list[int], k: int, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, scores) of the k best rows but own, ties to smaller rows."""
        slices, constant = self.scores(query)
        tied, sure = self.all.copy(), np.zeros(self.width, np.uint64)
        if own is not None:
            tied[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        for bitmap in reversed(slices):
            high = tied & bitmap
            n = int(np.bitwise_count(sure).sum() + np.bitwise_count(high).sum())
            if n > k:
                tied = high
            else:
                sure |= high
                tied &= ~bitmap
                if n == k:
                    tied[:] = 0
                    break
        chosen = self._numbers(sure)
        if len(chosen) < k:
            chosen = np.concatenate([chosen, self._numbers(tied)[: k - len(chosen)]])
        score = np.full(len(chosen), constant, np.int64)
        for b, bitmap in enumerate(slices):
            score += ((bitmap[chosen >> 6] >> (chosen & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b
        return chosen, score

    def _numbers(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _search(k: int):
    """Tiles in, sorted so that rows of one tile follow each other: its queries first, then blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, queries, reached = None, [], []
        for batch in batches:
            for dims, run_, group, kind, width, rows, ids, vectors in zip(*(batch[c].to_pylist() for c in ("dims", "run", "group", "kind", "width", "rows", "ids", "vectors")), strict=True):
                if (dims, run_, group) != tile:
                    tile, queries, reached = (dims, run_, group), [], []
                rows, ids, vectors = np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(vectors, f"<i{width}").reshape(-1, dims)
                if not kind:
                    queries.append((rows, ids, vectors.astype(np.int64)))
                    reached.append(np.full(len(rows), np.iinfo(np.int64).min))
                    continue
                index, place, found = Slices(vectors), {int(r): i for i, r in enumerate(rows)}, ([], [], [], [])
                for (asked, names, own), least in zip(queries, reached, strict=True):
                    for i in np.flatnonzero(index.bounds(own) >= least):
                        at, scores = index.best(own[i].tolist(), k, place.get(int(asked[i])))
                        if len(scores) == k:
                            least[i] = max(least[i], scores.min())
                        for out, x in zip(found, (np.full(len(at), asked[i]), np.full(len(at), names[i]), ids[at], scores), strict=True):
                            out.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in found], ["query_row", "query_id", "vec_id", "score"])

    return run


def _pack(batches):
    """Arrays of one block to one row: row numbers, ids, and vectors row by row, in order of id."""
    for batch in batches:
        out = ([], [], [], [])
        for dims, rows in zip(batch["dims"].to_pylist(), batch["members"], strict=True):
            own = rows.values
            number, name = own.field("r").to_numpy(), own.field("vec_id").to_numpy()
            order = np.lexsort((number, name))
            v = own.field("v").flatten().to_numpy().reshape(-1, dims)[order]
            width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(v) or (v.min() >= -(1 << 8 * w - 1) and v.max() < 1 << 8 * w - 1))
            for x, y in zip(out, (width, number[order].astype("<i8").tobytes(), name[order].astype("<i8").tobytes(), v.astype(f"<i{width}").tobytes()), strict=True):
                x.append(y)
        columns = [pa.array(x, pa.int32() if i == 0 else pa.binary()) for i, x in enumerate(out)]
        yield pa.RecordBatch.from_arrays([batch["dims"], batch["block"], *columns], ["dims", "block", "width", "rows", "ids", "vectors"])


def blocks_of(vectors: DataFrame, sizes: dict[int, int], least_blocks: int, block_bytes: int, most_rows: int) -> DataFrame:
    """vectors: (r, vec_id, v, dims) -> a row per block.  sizes: rows by dims; a block holds about block_bytes of
    eight-byte components and most_rows rows at most, and there are least_blocks of each dims, where rows allow it."""
    n = F.lit(1)
    for dims, rows in sizes.items():  # one entry per length of vectors
        blocks = max(least_blocks, -(-rows * 8 * dims // block_bytes), -(-rows // most_rows))
        n = F.when(F.col("dims") == dims, F.lit(min(blocks, max(1, rows)))).otherwise(n)
    placed = vectors.withColumn("block", F.pmod(F.xxhash64("r"), n).cast("int"))
    gathered = placed.groupBy("dims", "block").agg(F.collect_list(F.struct("r", "vec_id", "v")).alias("members"))
    return gathered.select("dims", "block", "members").mapInArrow(_pack, "dims int, block int, width int, rows binary, ids binary, vectors binary")


def top_k(vectors: DataFrame, k: int = 20, scale: float = 64.0, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = 1 << 25, block_rows: int = 65536, block_run: int = 8, group_bytes: int = 1 << 25, group_rows: int = 65536) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query row."""
    spark = vectors.sparkSession
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"))
    with Workspace(spark, "topk") as work:
        v = work.stash(picked.filter("v IS NOT NULL AND vec_id IS NOT NULL").withColumns({"dims": F.size("v"), "r": F.monotonically_increasing_id()}), "vectors")
        asked = F.col("vec_id") % 20 == 0 if is_query is None else is_query
        counted = v.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("asked")).collect()  # a row per length
        rows, queries = {r["dims"]: r["n"] for r in counted}, {r["dims"]: r["asked"] for r in counted}
        index = work.stash(blocks_of(v, rows, 1, block_bytes, block_rows), "index")
        runs = -(-index.count() // block_run)
        wanted = -(-3 * spark.sparkContext.defaultParallelism // max(1, runs))
        groups = work.stash(blocks_of(v.filter(asked), queries, wanted, group_bytes, group_rows), "queries")
        index, groups = index.withColumn("run", F.col("block") % max(1, runs)), groups.withColumnRenamed("block", "group")
        theirs, ours = groups.groupBy("dims").agg(F.collect_set("group").alias("group")), index.groupBy("dims").agg(F.collect_set("run").alias("run"))  # numbers of blocks only
        left = index.join(F.broadcast(theirs), "dims").withColumn("group", F.explode("group")).withColumn("kind", F.lit(1))
        right = groups.join(F.broadcast(ours), "dims").withColumn("run", F.explode("run")).withColumn("kind", F.lit(0))
        tile, columns = ["dims", "run", "group"], ["kind", "width", "rows", "ids", "vectors"]
        tiles = left.select(*tile, *columns).unionByName(right.select(*tile, *columns))
        tiles = tiles.repartition(max(1, runs * groups.count()), *tile).sortWithinPartitions(*tile, "kind")
        best = tiles.mapInArrow(_search(k), "query_row long, query_id long, vec_id long, score long")
        order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return work.result(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: greatest(-m, least(m, floor(64 * x::DOUBLE)))::BIGINT) AS v
  FROM (SELECT *, floor(sqrt(4611686018427387904.0::DOUBLE / len(embedding))) AS m FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
