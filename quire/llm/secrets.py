r"""Secret scan with corpus-wide ownership frequency (native: DataFrame functions only).

Spans of a text come from four rules.  ``assign``, ``access`` and ``hex`` are the base; ``token``
(mixed-case strings of 24 or more characters with digits) is too loose to be reported by itself.
Every candidate's secret is hashed, and over the whole corpus each hash gets its number of
distinct repositories and owners.  A secret in more than ``live_repositories`` repositories, or in several
repositories of more than ``live_owners`` owners, is a widely copied example; others look live: those of one
owner, and those of one repository that several owners hold a copy of.  Base spans always stay; a
``token`` span is added where it looks live and touches no base span.  Where the table has no column of
repositories, a whole text is one, so its copies count once.

Positions: a rule cuts a text into gaps and matches; only the lengths of both and hashes of the
secrets leave the scan.  A span starts at the running sum of the lengths before it, which a window over
the row's matches gives, so a text's cost is linear in its length and its number of matches.  Whether a loose
span touches a base span also comes from running maxima over the row's spans.

Only SHA-256 hashes of secrets are stored or shuffled, never secrets or texts: distinct (hash, owner)
and (hash, repository), then counts by hash, each with partial aggregation, so a secret that stands in a third of
all documents is a few rows a task.  Counts go back to candidates by a
join that may be split.

Defined results: null or empty text has no spans; a null owner or repository counts as one
owner or repository of its own; repeated rows are rows of one repository; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, table

#: The rules, in the order of kinds.
ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
TOKEN = "[A-Za-z0-9+/_-]{24,}"
KINDS = ["assign", "access", "hex", "token"]
SPAN = "array<struct<start:int,kind:int,end:int>>"
PIECE = "array<struct<kind:int,gap:int,length:int,counts:boolean,hash:binary>>"


def _pieces(text: Column, pattern: str, kind: int, keep, secret=lambda m: m) -> Column:
    """A struct for each match in order: characters between the match before and this one, its length,
    whether keep(match) holds, and the hash of its secret if so."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    hashed = lambda m: F.when(keep(m), F.unhex(F.sha2(secret(m), 256)))
    piece = lambda m, g: F.struct(F.lit(kind).alias("kind"), F.length(g).alias("gap"), F.length(m).alias("length"), keep(m).alias("counts"), hashed(m).alias("hash"))
    # There is a gap more than matches.  Most texts have no match that counts and are not split.
    pairs = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), piece)
    return F.when(F.exists(matches, keep), pairs).otherwise(F.array()).cast(PIECE)


def _group2(m: Column) -> Column:
    return F.regexp_extract(m, ASSIGN, 2)


def pieces(text: Column) -> Column:
    """Pieces of all rules, the rules' order kept."""
    assign = _pieces(text, ASSIGN, 0, lambda m: F.length(_group2(m)) >= 6, _group2)
    access = _pieces(text, ACCESS, 1, lambda m: F.length(m) >= 20)
    # Runs of hexadecimal digits are everywhere; only those of 24 or more count, and a longer run never hides one.
    hexes = _pieces(text, "[0-9a-f]{24,}", 2, lambda m: F.lit(True))
    token = _pieces(text, TOKEN, 3, lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]"))
    return F.concat(assign, access, hexes, token)


def spans_of(found: DataFrame) -> DataFrame:
    """found: (row, owner, repository, pieces) -> a row per span that counts: row, owner, repository, start, kind, end,
    hash; loose spans only where they touch no base span."""
    spread = found.select("row", "owner", "repository", F.posexplode("pieces").alias("i", "p")).select("row", "owner", "repository", "i", "p.*")
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    spans = spread.withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).filter("counts")
    base, by_row = F.col("kind") < 3, Window.partitionBy("row")
    # Ends of base spans that start no later, starts of those that start no earlier.
    reach = F.max(F.when(base, F.col("end"))).over(by_row.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(base, F.col("start"))).over(by_row.orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0))
    told = spans.withColumns({"reach": reach, "ahead": ahead})
    touched = (F.coalesce("reach", F.lit(0)) > F.col("start")) | (F.coalesce("ahead", F.col("end")) < F.col("end"))
    return told.filter(base | ~touched).select("row", "owner", "repository", "start", "kind", "end", "hash")


def span_text(spans: Column) -> Column:
    name = lambda s: F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """candidates: (hash, owner, repository) -> (hash, owners, repositories)."""
    both = F.array(F.struct(F.lit(True).alias("owns"), F.col("owner").alias("name")), F.struct(F.lit(False).alias("owns"), F.col("repository").alias("name")))
    distinct = candidates.select("hash", F.explode(both).alias("b")).select("hash", "b.owns", "b.name").distinct()  # a null counts as one
    return distinct.groupBy("hash").agg(F.count_if("owns").alias("owners"), F.count_if(~F.col("owns")).alias("repositories"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, live_owners: int = 1, live_repositories: int = 10) -> DataFrame:
    """A row per row of docs: doc_id, base (spans), spans (base and added), live and copied
    (how many spans have a secret that looks live / that is widely copied)."""
    with Workspace(docs.sparkSession, "secrets") as work:
        text = F.coalesce(F.col(text_col), F.lit(""))
        picked = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), text.alias("text") if repository_col is None else F.col(repository_col).cast("string").alias("repository"), pieces(text).alias("pieces"))
        if repository_col is None:  # the text's hash, where it has candidates
            picked = picked.withColumn("repository", F.when(F.size("pieces") > 0, F.sha2("text", 256))).drop("text")
        found = work.stash(picked.withColumn("row", F.monotonically_increasing_id()), "found")
        spans = work.stash(spans_of(found), "spans")
        counts = ownership(spans.select("hash", "owner", "repository"))
        judged = spans.join(counts, "hash").select("row", F.struct("start", "kind", "end").alias("span"), (((F.col("owners") <= live_owners) | (F.col("repositories") <= 1)) & (F.col("repositories") <= live_repositories)).alias("live"), "owners", "repositories")
        listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("span")))).cast(SPAN)
        base = F.col("span.kind") < 3
        by_row = judged.groupBy("row").agg(listed(base).alias("base"), listed(base | F.col("live")).alias("spans"), F.count_if("live").alias("live"), F.count_if(~F.col("live")).alias("copied"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"))
        joined, none = found.select("row", "doc_id").join(by_row, "row", "left"), F.array().cast(SPAN)
        return work.result(joined.select("doc_id", *[F.coalesce(c, none).alias(c) for c in ("base", "spans")], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("live", "copied", "most_owners", "most_repositories")]))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", kind(0).alias("n_assign"), kind(1).alias("n_access"), kind(2).alias("n_hex"), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), "live", "copied", "most_owners", "most_repositories")


def _duck(kind: int, pattern: str, keep: str, secret: str = "m") -> str:
    """Spans of one rule in DuckDB: gaps between matches and matches give the positions."""
    p = pattern.replace("'", "''").replace("\\x20", " ")
    return f"""
  SELECT doc_id, source, t, {kind} AS kind, m, {secret.replace('ASSIGN', p)} AS secret,
         (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS b
  FROM (SELECT *, ms[i] AS m FROM (SELECT doc_id, source, t, g, ms, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, source, t, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}'))))
  WHERE {keep.replace('ASSIGN', p)}"""


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({_duck(0, ASSIGN, "length(regexp_extract(m, 'ASSIGN', 2)) >= 6", "regexp_extract(m, 'ASSIGN', 2)")}
  UNION ALL {_duck(1, ACCESS, "length(m) >= 20")}
  UNION ALL {_duck(2, HEX, "length(m) >= 24")}),
loose AS ({_duck(3, TOKEN, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')")}),
apart AS (SELECT l.* FROM loose l WHERE NOT EXISTS (
  SELECT 1 FROM base s WHERE s.doc_id = l.doc_id AND s.b < l.b + length(l.m) AND l.b < s.b + length(s.m))),
found AS (SELECT * FROM base UNION ALL SELECT * FROM apart),
owned AS (SELECT secret, count(DISTINCT coalesce('s' || source, 'n')) AS owners, count(DISTINCT t) AS repositories FROM found GROUP BY secret),
told AS (SELECT f.*, owners, repositories, (owners <= 1 OR repositories <= 1) AND repositories <= 10 AS live,
  ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || b || ':' || (b + length(m)) AS s
  FROM found f JOIN owned USING (secret)),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2,
  string_agg(s, ',' ORDER BY b, kind) FILTER (WHERE kind < 3) AS base,
  string_agg(s, ',' ORDER BY b, kind) FILTER (WHERE kind < 3 OR live) AS spans,
  count(*) FILTER (WHERE live) AS live, count(*) FILTER (WHERE NOT live) AS copied,
  max(owners) AS most_owners, max(repositories) AS most_repositories FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(live, 0)::BIGINT AS live,
  coalesce(copied, 0)::BIGINT AS copied, coalesce(most_owners, 0)::BIGINT AS most_owners, coalesce(most_repositories, 0)::BIGINT AS most_repositories
FROM d LEFT JOIN g USING (doc_id)
"""
