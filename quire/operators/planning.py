"""Which sentences to patch, which pages to sample, which pages to pilot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import logical_text, sentence_spans, strip, term_present, tokens_of

SENTENCE_END = "[.!?。！？;:]$"


def bracketed(sentence: Column, terms: Column) -> Column:
    """Terms in [brackets], the longest first, whatever their case; a term within another gets its own."""
    longest_first = F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    wrap = lambda s, x: F.regexp_replace(s, F.concat(F.lit("(?iu)\\Q"), x["t"], F.lit("\\E")), F.lit("[$0]"))
    return F.aggregate(longest_first, sentence, wrap)


def widened(spans: Column, logical: Column) -> Column:
    """Sentence spans where a heading among the first or last ten words takes the next sentence in:
    at most six words, or at most eight without a stop."""
    total = F.size(tokens_of(logical))
    words_to = lambda at: F.size(tokens_of(F.substring(logical, F.lit(1), at)))

    def one(s: Column, i: Column) -> Column:
        sentence = strip(F.substring(logical, s["start"] + 1, s["end"] - s["start"]))
        n = F.size(tokens_of(sentence))
        heading = (n <= 6) | (n <= 8) & ~sentence.rlike(SENTENCE_END)
        at_edge = (words_to(s["start"]) < 10) | (words_to(s["end"]) > total - 10)
        after = F.get(spans, i + 1)
        return F.struct(s["start"].alias("start"), F.when(heading & at_edge & after.isNotNull(), after["end"]).otherwise(s["end"]).alias("end"))

    return F.transform(spans, one)


def patch_operations(pages: DataFrame, keys: list[str], text: str, terms: list[str], variants: bool = False) -> DataFrame:
    """(keys, section, start, end, sentence, terms, bracketed, op_index): sentences with terms, body
    first.  Offsets are positions in the section's logical text and are carried along, so equal
    sentences stay apart and nothing is searched again."""
    parts = F.split(F.col(text), fixed.FOOTNOTES, 2)
    sections = pages.select(*keys, F.posexplode(parts).alias("s", "raw")).withColumn("logical", logical_text(F.col("raw")))
    cut = sections.withColumn("plain", sentence_spans(F.col("logical"))).withColumn("spans", widened(F.col("plain"), F.col("logical")))
    rows = cut.select(*keys, "s", "logical", F.explode(F.zip_with("plain", "spans", lambda p, w: F.struct(p["start"].alias("own"), p["end"].alias("own_end"), w["start"].alias("start"), w["end"].alias("end")))).alias("x"))
    given = F.array(*[F.lit(t) for t in terms])
    of = lambda a, b: F.substring(F.col("logical"), a + 1, b - a)
    found = lambda a, b: F.filter(given, lambda t: term_present(t, of(a, b), variants))
    rows = rows.filter(F.size(found(F.col("x.own"), F.col("x.own_end"))) > 0)
    rows = rows.select(*keys, F.when(F.col("s") == 0, "body").otherwise("footnotes").alias("section"), "s", F.col("x.start").alias("start"), F.col("x.end").alias("end"), of(F.col("x.start"), F.col("x.end")).alias("sentence"), found(F.col("x.start"), F.col("x.end")).alias("terms"))
    order = Window.partitionBy(*keys).orderBy("s", "start", "end")
    return rows.withColumns({"bracketed": bracketed(F.col("sentence"), F.col("terms")), "op_index": F.row_number().over(order) - 1}).drop("s")


def sample_pages(pages: Column, count: int = 5, most: int = 10) -> Column:
    """Pages to detect languages on: all of a short book; else two neighbours at 15 and at 45 percent of
    the first half, anchors at 8, 33, 67 and 92 percent, filled up to six from the first quarter in order."""
    n = F.size(pages)
    at = lambda i: F.get(pages, i.cast("int"))
    half = F.greatest(F.lit(2), F.floor(n / 2))
    first = [F.least(F.floor(half * f), n - 1) for f in (0.15, 0.45)]
    anchors = [F.least(F.floor(n * f), n - 1) for f in (0.08, 0.33, 0.67, 0.92)]
    chosen = F.array_distinct(F.array_compact(F.array(*[at(i) for a in first for i in (a, a + 1)], *[at(a) for a in anchors])))
    quarter = F.array_except(F.slice(pages, F.lit(1), F.greatest(F.lit(1), F.floor(n / 4)).cast("int")), chosen)
    short = F.greatest(F.lit(0), F.lit(max(count, 6)) - F.size(chosen))
    filled = F.concat(chosen, F.slice(quarter, F.lit(1), short))
    return F.when(n <= count, F.array_sort(pages)).otherwise(F.slice(F.array_sort(filled), 1, most))


def page_tags(text: Column, terms: list[str]) -> Column:
    """Edge cases of a page with terms: hyphen_break, body_and_footnote, chapter_heading, multi_term_sentence."""
    flat, given = F.regexp_replace(F.lower(text), r"\n(?!\n)", " "), F.array(*[F.lit(t.lower()) for t in terms])
    has = lambda c: F.exists(given, lambda t: F.lower(c).contains(t))
    parts = F.split(text, fixed.FOOTNOTES, 2)
    heads = F.slice(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), 1, 8)
    heading = F.exists(heads, lambda x: (F.length(x) < 120) & has(x) & x.rlike("[.:]$") & (F.size(tokens_of(x)) <= 12))
    tags = F.array_compact(
        F.array(
            F.when(text.rlike(r"-\s*\n"), "hyphen_break"),
            F.when((F.size(parts) == 2) & has(F.get(parts, F.lit(0))) & has(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), "body_and_footnote"),
            F.when(heading, "chapter_heading"),
            F.when(F.size(F.filter(given, lambda t: flat.contains(t))) >= 2, "multi_term_sentence"),
        )
    )
    return F.when(text.startswith("[Skipped:") | ~has(text), F.array().cast("array<string>")).otherwise(tags)


def pilot_pages(pages: DataFrame, book: str, page: str, text: str, terms: list[str], count: int = 20) -> DataFrame:
    """(book, page, why): for each tag in turn its first page that no tag before has taken, then pages with terms,
    then any, in page order."""
    names = ["hyphen_break", "body_and_footnote", "chapter_heading", "multi_term_sentence"]
    given = F.array(*[F.lit(t.lower()) for t in terms])
    tagged = pages.select(book, page, page_tags(F.col(text), terms).alias("tags"), F.exists(given, lambda t: F.lower(F.col(text)).contains(t)).alias("hard"))
    # The tags before can have taken at most three pages, so the first four of each tag are enough.
    least = lambda n: F.slice(F.array_sort(F.collect_list(F.when(F.array_contains("tags", n), F.col(page)))), 1, len(names)).alias(n)
    chosen = tagged.groupBy(book).agg(*[least(n) for n in names])
    for n in names:
        before = F.array_compact(F.array(F.lit(None).cast(dict(pages.dtypes)[page]), *[F.col(f"{m}_page") for m in names[: names.index(n)]]))
        chosen = chosen.withColumn(f"{n}_page", F.get(F.array_except(n, before), F.lit(0)))
    picks = chosen.select(book, F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(n).alias("tag"), F.col(f"{n}_page").alias(page)) for i, n in enumerate(names)])).alias("p")).select(book, "p.*").filter(F.col(page).isNotNull())
    ranked = tagged.join(picks, [book, page], "left").withColumn("turn", F.coalesce("turn", F.when(F.col("hard"), 10).otherwise(20)))
    rank = F.row_number().over(Window.partitionBy(book).orderBy("turn", page))
    why = F.coalesce("tag", F.when(F.col("turn") == 10, "term").otherwise("any"))
    return ranked.withColumn("r", rank).filter(F.col("r") <= count).select(book, page, why.alias("why"))
