"""Sentence patches: choice, packing, validation, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import any_of, emphasis_marks, is_patch_chatter, splice, squash, strip, term_present


def cap_per_page(ops: DataFrame, keys: list[str], most: int = fixed.PATCHES_PER_PAGE) -> DataFrame:
    """The most important ops of a page: longest term, most terms, longest sentence, then first."""
    longest = F.coalesce(F.array_max(F.transform("terms", F.length)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(longest.desc(), F.size("terms").desc(), F.length("sentence").desc(), "op_index"))
    return ops.withColumn("__r", rank).filter(F.col("__r") <= most).drop("__r")


def token_chunks(ops: DataFrame, keys: list[str], most: int = fixed.OUTPUT_TOKENS) -> DataFrame:
    """Chunk number of each op.  A page that fits is one chunk; else ops fill chunks in order, each
    starting anew from the margin, so the packing is a fold over the page."""
    cost = lambda s: F.greatest(F.lit(1), F.floor(F.length(s) / fixed.CHARS_PER_TOKEN)).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct("op_index", cost(F.col("sentence")).alias("cost"))))
    pages = ops.groupBy(*keys).agg(ordered.alias("ops"), F.sum(F.length("sentence")).alias("chars"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(fixed.TOKEN_MARGIN).cast("long").alias("used"), F.lit(0).alias("held"), F.array().cast("array<struct<op_index:bigint,chunk:int>>").alias("out"))

    def step(acc: Column, op: Column) -> Column:
        full = (acc["held"] > 0) & (acc["used"] + op["cost"] > most)
        chunk = F.when(full, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(
            chunk.alias("chunk"),
            (F.when(full, F.lit(fixed.TOKEN_MARGIN).cast("long")).otherwise(acc["used"]) + op["cost"]).alias("used"),
            F.when(full, F.lit(1)).otherwise(acc["held"] + 1).alias("held"),
            F.concat(acc["out"], F.array(F.struct(op["op_index"].cast("long").alias("op_index"), chunk.alias("chunk")))).alias("out"),
        )

    packed = F.aggregate("ops", start, step)["out"]
    fits = F.floor(F.col("chars") / fixed.CHARS_PER_TOKEN) + fixed.TOKEN_MARGIN <= most
    alone = F.transform("ops", lambda o: F.struct(o["op_index"].cast("long").alias("op_index"), F.lit(0).alias("chunk")))
    return pages.select(*keys, F.explode(F.when(fits, alone).otherwise(packed)).alias("x")).select(*keys, "x.op_index", "x.chunk")


def reject_reason(original: Column, returned: Column, impossible: list[str], terms: Column, emphasis: str = "asterisk", variants: bool = False) -> Column:
    """Why a patch is refused, in the order of the tests; null for an accepted one."""
    candidate = strip(F.coalesce(returned, F.lit("")))
    bad = lambda c: any_of(F.lower(c).contains(b.lower()) for b in impossible if b)
    sics = lambda c: F.regexp_count(c, F.lit(r"(?i)\[sic\]"))
    added_sic = (sics(candidate) > sics(original)) & bad(original) if impossible else F.lit(False)
    return (
        F.when(candidate == "", "empty_response")
        .when(is_patch_chatter(candidate), "chatter")
        .when(bad(candidate) | added_sic, "impossible_string")
        .when(emphasis_marks(original, emphasis) != emphasis_marks(candidate, emphasis), "emphasis_markers")
        .when(squash(candidate) == squash(original), "unchanged")
        .when(~F.forall(terms, lambda t: term_present(t, candidate, variants)), "missing_hard_term")
    )


def apply_patches(text: Column, patches: Column) -> Column:
    """patches: array<struct<start, end, new>>, put in from the last to the first; one that overlaps a
    later start is left out."""
    backwards = F.reverse(F.array_sort(patches))
    start = F.struct(text.alias("text"), F.length(text).alias("limit"))
    step = lambda acc, p: F.when(p["end"] <= acc["limit"], F.struct(splice(acc["text"], p["start"], p["end"], p["new"]).alias("text"), p["start"].alias("limit"))).otherwise(acc)
    return F.aggregate(backwards, start, step)["text"]


def numbered_answers(answer: Column, originals: Column) -> Column:
    """One text per original: the first answer with its number, else the original.  An answer
    reaches to the next number."""
    marker = r"(?m)^\s*(\d+)\s*[:.)]"
    numbers, bodies = F.regexp_extract_all(answer, F.lit(marker), F.lit(1)), F.split(answer, marker, -1)
    found = F.transform(numbers, lambda n, i: F.struct(n.try_cast("int").alias("n"), strip(F.regexp_replace(F.get(bodies, i + 1), r"\s+", " ")).alias("t")))
    mine = lambda k: F.get(F.filter(found, lambda f: (f["n"] == k + 1) & (f["t"] != "")), F.lit(0))["t"]
    return F.transform(originals, lambda o, k: F.coalesce(mine(k), o))


def rejections(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, reason, n) of refused patches."""
    return log.filter(F.col("reason").isNotNull()).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def rejection_gate(log: DataFrame, *keys: str, share: float = 0.5) -> DataFrame:
    """Whether at most ``share`` of the refusals are impossible strings; what is neither that nor
    unchanged is ``other``."""
    r = F.col("reason")
    counted = log.groupBy(*keys).agg(F.count_if(r.isNotNull()).alias("rejected"), F.count_if(r == "unchanged").alias("unchanged"), F.count_if(r == "impossible_string").alias("blocked"))
    return counted.withColumns({"other": F.col("rejected") - F.col("unchanged") - F.col("blocked"), "ok": (F.col("rejected") == 0) | (F.try_divide("blocked", "rejected") <= share)})
