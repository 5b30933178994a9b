"""The final document of a book and small rules about jobs and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import is_skip, slug, strip, term_present
from .quality import section


def document_text(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """(book, text): bodies that aren't skip notes, in page order, parted by blank lines; a book of skip notes is empty."""
    kept = F.when(~is_skip(F.coalesce(text, F.lit(""))), F.struct(F.col(page).alias("p"), F.coalesce(text, F.lit("")).alias("t")))
    return pages.groupBy(book).agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["t"]), "\n\n").alias("text"))


def needs_spot_check(text: Column, terms: list[str]) -> Column:
    """A page that isn't a skip note and has one of the terms."""
    return ~is_skip(F.coalesce(text, F.lit(""))) & F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: term_present(t, text))


def page_results(readings: DataFrame, keys: list[str], run: str = "run", text: str = "text") -> DataFrame:
    """readings with ``section``: a page's section comes from its first reading and holds for all; skip notes have none."""
    first = readings.filter(F.col(run) == 1).select(*keys, section(F.col(text)).alias("section"))
    joined = readings.join(first, keys, "left")
    return joined.withColumn("section", F.when(~is_skip(F.coalesce(text, F.lit(""))), F.col("section")))


def draft(runs: dict[str, Column]) -> Column:
    """The text of reading A, else of the first that there is; an empty text counts."""
    return F.coalesce(*([runs["A"]] if "A" in runs else []), *[c for r, c in runs.items() if r != "A"])


def processing_mode(mode: Column, most_pages: Column) -> Column:
    """realtime or batch: auto and unknown modes go by whether the number of pages is limited."""
    asked = F.lower(strip(F.coalesce(mode, F.lit(fixed.DEFAULT_MODE))))
    auto = F.when(F.coalesce(most_pages, F.lit(0)) > 0, "realtime").otherwise("batch")
    return F.when(asked.isin("realtime", "batch"), asked).otherwise(auto)


def masked_key(key: Column) -> Column:
    """The first and last four characters; eight dots for keys of up to eight."""
    k = strip(key)
    return F.when(F.length(k) <= 8, F.lit("•" * 8)).otherwise(F.concat(F.left(k, F.lit(4)), F.lit("…"), F.right(k, F.lit(4))))


def skip_note(reason: Column) -> Column:
    return F.concat(F.lit("[Skipped: "), reason, F.lit("]"))


def cjk_sentence_spans(c: Column) -> Column:
    """array<struct<start, end>>: sentences with their terminators; white space goes with what follows, and a text
    without sentences is one span."""
    cut = F.regexp_extract_all(c, F.lit(f"[^{fixed.CJK_TERMINATORS}]*[{fixed.CJK_TERMINATORS}]|[^{fixed.CJK_TERMINATORS}]+$"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        end = s["at"] + F.length(p)
        return F.struct(end.alias("at"), F.when(strip(p) == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), end.alias("end"))))).alias("out"))

    found = F.aggregate(cut, start, step)["out"]
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(strip(c) == "", none).when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.length(c).alias("end"))))


def pilot_gate(names: DataFrame, saved: DataFrame, aliases: dict[str, str] | None = None, pilot: int = fixed.PILOT_PAGES) -> DataFrame:
    """names: (name); saved: (source_id, pages_processed).  (name, source_name, pages_processed, unlocked): the slug of the
    name or what it stands for, and whether its pilot is done; unknown sources have no pages."""
    known = F.create_map(*[F.lit(x) for pair in (aliases or {}).items() for x in pair]) if aliases else None
    own = slug(F.col("name"))
    hinted = own if known is None else F.coalesce(F.element_at(known, own), own)
    joined = names.withColumn("source_name", hinted).join(saved.select(F.col("source_id").alias("source_name"), "pages_processed"), "source_name", "left")
    done = F.coalesce("pages_processed", F.lit(0))
    return joined.select("name", "source_name", done.alias("pages_processed"), (done >= pilot).alias("unlocked"))


def languages(catalogue: DataFrame, installed: DataFrame, bundled: list[str]) -> DataFrame:
    """(code, name, installed, bundled) of every language of the catalogue; a missing name is the code."""
    there = installed.select("code").distinct().withColumn("installed", F.lit(True))
    joined = catalogue.join(there, "code", "left")
    return joined.select("code", F.coalesce("name", F.col("code").cast("string")).alias("name"), F.coalesce("installed", F.lit(False)).alias("installed"), F.col("code").isin(bundled).alias("bundled"))


def licence(licences: DataFrame, key: str) -> DataFrame:
    """The licence's row with empty texts for nulls; no row if it isn't activated."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return licences.filter(F.col("license_key") == key).select("license_key", F.col("remaining_credits").cast("int").alias("remaining_credits"), F.col("total_credits").cast("int").alias("total_credits"), text("email"), text("product_id"))


def dates_differ(hard: Column, impossible: Column) -> Column:
    """The lists of one source were made on different days; false where one isn't there."""
    return F.coalesce(F.to_date(hard) != F.to_date(impossible), F.lit(False))
