"""What a reviewed page is written as: flag table, page document, review list, book files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def _text_of(run: str) -> Column:
    return F.coalesce(F.col(run), F.lit(""))


def _confidence_of(flags: DataFrame, run: str) -> Column:
    return F.coalesce(F.col(f"{run}_conf"), F.lit(0.0)) if f"{run}_conf" in flags.columns else F.lit(0.0)


def flag_table(flags: DataFrame, keys: list[str], runs: list[str]) -> DataFrame:
    """(keys and) the fixed columns of the flag report; a missing reading is "" with confidence 0.

    flags: as ``consensus.flags`` gives them with confidences."""
    texts, sure = [_text_of(r).alias(r) for r in runs], [_confidence_of(flags, r).alias(f"{r}_conf") for r in runs]
    return flags.select(*keys, "span_id", "line_index", "word_index", "text", "reason", *texts, *sure)


def page_json(flags: DataFrame, pages: DataFrame, keys: list[str], runs: list[str]) -> DataFrame:
    """(keys, json): one document a page with its stats, layout and flags, also where nothing is flagged.

    pages: (keys, page_id, stats, layout), the last two structs; bbox, resolved and resolution of flags where they are there."""
    given = [c for c in ("bbox", "resolved", "resolution", *[f"{r}_conf" for r in runs]) if c in flags.columns]
    one = F.struct("line_index", "word_index", "span_id", "char_start", "char_end", "text", "reason", *runs, *given)
    listed = flags.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("flags"))
    return pages.join(listed, keys, "left").select(*keys, page_document(F.col("flags"), runs, given).alias("json"))


def page_document(listed: Column, runs: list[str], given: Iterable[str] = ()) -> Column:
    """The document of a page with columns page_id, stats and layout.  listed: its flags in order, null for none;
    given: which of bbox, resolved, resolution and ``<run>_conf`` they have."""
    kind = f"array<struct<line_index:int,word_index:int,span_id:string,char_start:int,char_end:int,text:string,reason:string,engine_texts:struct<{','.join(f'`{r}`:string' for r in runs)}>,engine_confidences:struct<{','.join(f'`{r}`:double' for r in runs)}>,bbox:array<int>,resolved:boolean,resolution:string>>"
    by_run = lambda of: F.struct(*[of(r).alias(r) for r in runs])

    def one(f: Column) -> Column:
        more = lambda name, default: (f[name] if name in given else default).alias(name)
        sure = lambda r: F.coalesce(f[f"{r}_conf"], F.lit(0.0)) if f"{r}_conf" in given else F.lit(0.0)
        return F.struct(*[f[c].alias(c) for c in ("line_index", "word_index", "span_id", "char_start", "char_end", "text", "reason")], by_run(lambda r: F.coalesce(f[r], F.lit(""))).alias("engine_texts"), by_run(sure).alias("engine_confidences"), more("bbox", F.lit(None).cast("array<int>")), more("resolved", F.lit(False)), more("resolution", F.lit(None).cast("string")))

    shown = F.coalesce(F.transform(listed, one).cast(kind), F.array().cast(kind))
    return F.to_json(F.struct("page_id", "stats", "layout", shown.alias("flags")), {"ignoreNullFields": "false"})


def quoted(c: Column) -> Column:
    """In single quotes; in double ones where it holds a single one only."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def review_list(flags: DataFrame, keys: list[str], runs: list[str]) -> DataFrame:
    """(keys, text): what a person must look at, for each page with flags."""
    listed = F.array_sort(F.collect_list(F.struct("line_index", "word_index", "span_id", "text", "reason", *runs)))
    return flags.groupBy(*keys).agg(listed.alias("flags")).select(*keys, review_text(F.col("flags"), runs).alias("text"))


def review_text(listed: Column, runs: list[str]) -> Column:
    """The review list of a page with flags.  listed: its flags in order."""

    def entry(f: Column) -> Column:
        shown = F.concat_ws(", ", *[F.when(F.coalesce(f[r], F.lit("")) != "", F.concat(F.lit(f"{r}="), quoted(f[r]))) for r in runs])
        return F.concat(F.lit("- ["), f["span_id"], F.lit("] line "), (f["line_index"] + 1).cast("string"), F.lit(": `"), f["text"], F.lit("` ("), f["reason"], F.lit(")\n  engines: "), shown)

    return F.concat(F.lit(fixed.REVIEW_HEADER + "\n\n"), F.array_join(F.transform(listed, entry), "\n"))


def book_text(pages: DataFrame, book: str, page: str, text: str, between: str = fixed.PAGE_BREAK) -> DataFrame:
    """(book, text): pages that exist, in order, with a break between."""
    listed = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(page).alias("p"), F.col(text).alias("t")))))
    return pages.groupBy(book).agg(F.array_join(F.transform(listed, lambda x: x["t"]), between).alias("text"))
