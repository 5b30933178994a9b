"""Sources and sinks: term files, page texts, patch logs, batch results, state, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.exports import flag_table

STATE = "source_name string, source_id string, language string, script string, direction string, page_numbers array<int>, page_sections map<string,string>, pages_processed int, run_date string"
PROGRESS = "ts double, job string, event string, page int, done int, total int"


def inputs(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "tif", "tiff", "pdf", "txt")) -> DataFrame:
    """Files below a path by extension, in order of path, numbered from 1; contents stay unread until asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    wanted = files.filter(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*extensions))
    numbered = wanted.select("path").withColumn("number", F.row_number().over(Window.orderBy("path")))  # names only go through one task
    return wanted.select("path", "modificationTime", "length", "content").join(numbered, "path")


def in_range(files: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Numbers first to last, both in; none where first is beyond last."""
    return files.filter(F.col("number").between(first or 1, last or 2**31 - 1))


def term_lines(spark: SparkSession, path: str) -> DataFrame:
    """(term): stripped lines of term files without blank and ``#`` lines."""
    t = strip(F.col("value"))
    return spark.read.text(path).select(t.alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith("#"))


def source_header(c: Column) -> Column:
    """struct(source, run_date) from the first three lines; null where there is none."""
    head = F.array_join(F.slice(F.split(c, "\n", -1), 1, 3), "\n")
    pattern = r"(?im)^#\s*source:\s*(\S+)\s*\|\s*run_date:\s*(\S+)"
    return F.when(head.rlike(pattern), F.struct(F.regexp_extract(head, pattern, 1).alias("source"), F.regexp_extract(head, pattern, 2).alias("run_date")))


def with_header(c: Column, source: Column, run_date: Column) -> Column:
    return F.concat(F.lit("# source: "), source, F.lit(" | run_date: "), run_date, F.lit("\n"), c)


def impossible_strings(c: Column, slug: Column) -> Column:
    """Strings of a file whose header names the source; null (not empty) where it names another or none."""
    header = source_header(F.get(F.split(c, "\n", -1), F.lit(0)))
    lines = F.filter(F.transform(F.split(c, "\n", -1), strip), lambda x: (x != "") & ~x.startswith("#"))
    return F.when(F.lower(header["source"]) == F.lower(slug), lines)


def mixed_headers(runs: DataFrame, book: str, text: str) -> DataFrame:
    """Books whose files name more than one source; a file without a header says nothing."""
    return runs.groupBy(book).agg(F.count_distinct(source_header(F.col(text))["source"]).alias("sources")).filter("sources > 1")


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """(page, text) of files named page_0001.txt; a missing page has no row, an empty one has ""."""
    whole = spark.read.option("wholetext", "true").text(path).withColumn("path", F.input_file_name())
    return whole.select(F.regexp_extract("path", r"page_(\d+)\.txt$", 1).try_cast("int").alias("page"), F.col("value").alias("text")).filter("page is not null")


def patch_log(lines: DataFrame, order: str = "n", line: str = "line", by: list[str] | None = None) -> DataFrame:
    """(page, op, applied, reason, terms) of the op lines of a patch log; the page is the last header's."""
    page = F.regexp_extract(F.trim(line), r"^Page\s+(\d+)\s*$", 1)
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = lines.withColumn("page", F.last(F.nullif(page, F.lit("")), ignorenulls=True).over(w).cast("int"))
    op = r"(?i)^\s*op\s+(\d+):\s*(APPLIED|REJECTED)"
    terms = F.filter(F.transform(F.split(F.regexp_extract(line, r"\[([^\]]+)\]", 1), ","), lambda t: F.trim(t)), lambda t: t != "")
    rows = carried.filter(F.col(line).rlike(op))
    return rows.select(*(by or []), "page", F.regexp_extract(line, op, 1).cast("int").alias("op"), F.col(line).contains("APPLIED").alias("applied"), F.lower(F.trim(F.nullif(F.regexp_extract(line, r"(?i)REJECTED\s*\(([^)]+)\)", 1), F.lit("")))).alias("reason"), terms.alias("terms"))


def batch_results(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, text, error) of a JSONL file of batch results."""
    schema = "custom_id string, result struct<type:string, message:struct<content:array<struct<type:string,text:string>>>, error:struct<message:string>>"
    r = spark.read.schema(schema).json(path)
    text = F.array_join(F.transform(F.filter("result.message.content", lambda b: b["type"] == "text"), lambda b: b["text"]), "")
    ok = F.col("result.type") == "succeeded"
    return r.select("custom_id", F.when(ok, text).alias("text"), F.when(~ok, F.coalesce("result.error.message", "result.type")).alias("error"))


def states(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Job states; strict stops at malformed files, else they become null rows."""
    return spark.read.schema(STATE).option("multiLine", "true").option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def saved_sources(states_: DataFrame, pilot_pages: int = 10) -> DataFrame:
    return states_.select("source_id", F.coalesce("pages_processed", F.lit(0)).alias("pages_processed"), (F.coalesce("pages_processed", F.lit(0)) >= pilot_pages).alias("pilot_complete"))


def flags_csv(flags: DataFrame, path: str, runs: tuple[str, ...] = ("A", "B", "C")) -> None:
    """The flag report: eleven fixed columns, texts and confidences of the readings among them."""
    flag_table(flags, [], list(runs)).write.mode("overwrite").csv(path, header=True)


def flags_json(flags: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): a page's flags as one JSON document, non-ASCII kept."""
    fields = [c for c in flags.columns if c not in keys]
    return flags.groupBy(*keys).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("line_index", "word_index", *[c for c in fields if c not in ("line_index", "word_index")]))).alias("flags"))).alias("json"))


def term_file(terms: DataFrame, path: str) -> None:
    """Distinct terms, ordered without regard to case, one a line."""
    terms.select("term").distinct().orderBy(F.lower("term"), "term").coalesce(1).write.mode("overwrite").text(path)
