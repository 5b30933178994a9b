"""Line dedup by levelled sorted runs of line hashes (native: DataFrame functions only).

Documents come in batches of ascending doc_id.  The store holds, for every line key seen so
far, the smallest doc_id with it, as runs that are bucketed and sorted by the key's hash.  A
batch reduces its lines to distinct keys (partial aggregation, so one line in a third of all
documents is one row per task), merge-joins the runs, learns which keys have an owner already,
and adds the keys that no run has as a run of its own.  When a level holds ``fanout`` runs they
are compacted into one run of the next level; so a key lies in one run only, and a batch meets
O(fanout * log(batches)) runs.  Only the batch is ever shuffled, the runs are not.

A key's 128 bits are two differently seeded xxhash64 values.

Defined results: null or empty text is one empty line; null doc_id ranks after all ids, and
such rows count as one document; rows that share a doc_id count as one document, each keeping
its own line numbers and counts, also where the rows are equal; an empty table gives no rows; other
columns stay as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, LAST_ID, Workspace, ascii_lower, fresh, release, shuffle_width, table, whole

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, version, pos, h1, h2) of every line whose key is long enough."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "version", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select("doc", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


class LineRuns:
    """The store: levels of runs, each a table bucketed and sorted by (h1, h2)."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or shuffle_width(spark)
        self.levels: list[list[str]] = [[]]
        self.name = f"quire_lines_{uuid.uuid4().hex}"
        self.made = 0

    def _write(self, df: DataFrame) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        df.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def run(self, name: str) -> DataFrame:
        """Keys that this run brought, with their owners."""
        return self.spark.table(name).filter(~F.col("known")).select(*KEY, "owner")

    def add(self, keys: DataFrame) -> DataFrame:
        """keys: (h1, h2, owner, many).  Merge-joins the runs, stores the batch as a run and
        returns it with the final owner, and ``known`` where an earlier batch had the key."""
        owners = []
        for i, name in enumerate(n for level in self.levels for n in level):
            keys = keys.join(self.run(name).withColumnRenamed("owner", f"owner{i}"), KEY, "left")
            owners.append(F.col(f"owner{i}"))
        old = F.coalesce(*owners) if owners else F.lit(None).cast("long")
        keys = keys.select(*KEY, F.coalesce(old, "owner").alias("owner"), old.isNotNull().alias("known"), "many")
        name = self._write(keys)
        batch = self.spark.table(name)
        self.levels[0].append(name)
        return batch

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, merged = self.levels[level], None
                for name in old:
                    merged = self.run(name) if merged is None else merged.unionByName(self.run(name))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(merged.withColumns({"known": F.lit(False), "many": F.lit(False)})))
                self.levels[level] = []
                self._drop(old)
            level += 1

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self._drop([n for level in self.levels for n in level])


def batch_bounds(docs: DataFrame, id_col: str, batches: int) -> list[int]:
    """Ascending upper bounds that cut the ids into about equal batches."""
    if batches < 2:
        return []
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / batches for i in range(1, batches)], 10000)).first()[0]
    return sorted(set(cuts or []))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(doc, version, pos) of every line that goes; equal rows of one document come more than once."""
    spark = docs.sparkSession
    bounds = batch_bounds(docs, id_col, batches)
    batch = F.lit(0)
    for b in bounds:
        batch = batch + (F.col("doc") > b).cast("int")
    found = line_occurrences(docs, id_col, text_col, min_chars).withColumn("batch", batch)
    runs = LineRuns(spark, fanout)
    with Workspace(spark, "lines") as work:
        gone = work.result_folder()
        try:
            found.write.partitionBy("batch").parquet(work.path("found"))
            stored = spark.read.schema(found.schema).parquet(work.path("found"))
            for b in range(len(bounds) + 1):
                mine = stored.filter(F.col("batch") == b).drop("batch")
                keys = mine.groupBy(*KEY).agg(F.min("doc").alias("owner"), (F.min("doc") < F.max("doc")).alias("many"))
                owned = work.stash(runs.add(keys).filter("known or many").select(*KEY, "owner"), f"owned-{b}")
                mine.join(owned, KEY).filter("doc <> owner").select("doc", "version", "pos").write.parquet(f"{gone}/b={b}")
                runs.compact()
        finally:
            runs.close()
    release(spark)
    return spark.read.schema("doc long, version long, pos int").parquet(*(f"{gone}/b={b}" for b in range(len(bounds) + 1)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3, into: str = "lines") -> DataFrame:
    """docs, whose text keeps the other lines, and as last column a struct of ``before`` and ``dropped``
    lines (long).  It is named ``into``, with underscores behind where docs have that name already.

    Every row stays, even one that loses all its lines (its text is then empty)."""
    gone = dropped_lines(docs, id_col, text_col, min_chars, batches, fanout).groupBy("doc", "version").agg(F.collect_set("pos").alias("gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(whole(), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), text.alias("text"), F.xxhash64(text).alias("version"))
    joined, lines = keyed.join(gone, ["doc", "version"], "left").withColumn("lines", F.split("text", "\n", -1)), F.col("lines")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    new_text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    counts = F.struct(F.size(lines).cast("long").alias("before"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("dropped"))
    done = joined.select(F.col("row").withField(text_col, new_text).alias("row"), counts.alias("counts"))
    return done.select("row.*", F.col("counts").alias(fresh(into, docs.columns)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("lines.before").alias("n_lines"), F.col("lines.dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, doc, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), o AS (
  SELECT key, min(doc) AS owner FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc) > 1
), m AS (
  SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc AS gone FROM k LEFT JOIN o USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
