"""Profiles of sources and payloads of readers, from JSON answers to typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import direction, let, script_name, strip
from .quality import language_shares

ANSWER = "languages string, language string, script string, direction string, era string, seed_hard_terms string, hard_terms string, footnotes string, headers string, avg_words_per_page string"
#: Languages whose diacritics carry meaning.
MEANINGFUL = ("nahuatl", "korean", "japanese", "arabic", "kaqchikel", "yucatec_maya", "classical_maya")
WORD = "struct<text:string,confidence:double,bbox:array<int>,line_id:int>"


def _flag(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("yes", "true", "1")


def _list(c: Column) -> Column:
    items = F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(c, ","))
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda t: t != "")


def script_direction(script: Column, wanted: Column) -> Column:
    """Arabic is written from the right, Latin and the East Asian scripts from the left, whatever was asked."""
    return F.when(script == "arabic", "rtl").when(script.isin("latin", "korean", "japanese", "chinese"), "ltr").otherwise(wanted)


def detection(blob: Column) -> Column:
    """A detection answer (one JSON object) as a struct; at most 20 seed terms."""

    def read(d: Column) -> Column:
        raw = F.coalesce(F.nullif(d["languages"], F.lit("")), d["language"], F.lit(""))
        script = script_name(F.coalesce(d["script"], F.lit("latin")))
        return F.struct(
            raw.alias("languages_raw"),
            language_shares(raw).alias("languages"),
            script.alias("script"),
            script_direction(script, direction(d["direction"])).alias("direction"),
            strip(F.coalesce(d["era"], F.lit(""))).alias("era"),
            F.slice(_list(F.coalesce(d["seed_hard_terms"], d["hard_terms"], F.lit(""))), 1, 20).alias("seed_terms"),
            _flag(d["footnotes"]).alias("footnotes"),
            _flag(d["headers"]).alias("headers"),
            F.coalesce(d["avg_words_per_page"].try_cast("int"), F.lit(0)).alias("avg_words_per_page"),
        )

    return let(F.from_json(blob, ANSWER), read)


def rule_languages(shares: Column, least: float = 0.10) -> Column:
    """Languages whose rules apply, the largest share first; Spanish if there is none."""
    ordered = F.array_sort(F.transform(F.filter(shares, lambda s: (s["share"] >= least) & s["language"].isin(*fixed.RULED_LANGUAGES)), lambda s: F.struct((-s["share"]).alias("n"), s["language"].alias("l"))))
    names = F.transform(ordered, lambda s: s["l"])
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("spanish")))


def primary_language(shares: Column) -> Column:
    """The largest share; of equal ones the first."""
    ordered = F.array_sort(F.transform(shares, lambda s, i: F.struct((-s["share"]).alias("n"), i.alias("i"), s["language"].alias("l"))))
    return F.coalesce(F.get(ordered, F.lit(0))["l"], F.lit("spanish"))


def unify_marks(shares: Column, state: Column, profile: Column, source: Column, least: float = 0.10) -> Column:
    """Whether abbreviation marks are unified: as the state, else the profile, else the source asks;
    never with a language of at least ``least`` whose diacritics carry meaning."""
    kept = F.exists(shares, lambda s: (s["share"] >= least) & s["language"].isin(*MEANINGFUL))
    return F.when(kept, False).otherwise(F.coalesce(state, profile, source, F.lit(False)))


def reader_words(payload: Column) -> Column:
    """Words of a reader's JSON payload: blank ones go, confidence within 0 to 100 (70 if none), boxes
    of four numbers or zeros, line ids or positions.  Plain text becomes tokens line by line."""
    schema = "text string, words array<struct<text:string,confidence:double,bbox:array<int>,line_id:int>>"
    zeros = F.array(*[F.lit(0)] * 4)
    parsed = F.from_json(payload, schema)
    is_json = strip(payload).rlike(r"(?s)^\{.*\}$") & parsed.isNotNull() & (parsed["text"].isNotNull() | parsed["words"].isNotNull())
    boxed = lambda w: F.when(F.size(w["bbox"]) == 4, w["bbox"]).otherwise(zeros)
    word = lambda w, i: F.struct(strip(w["text"]).alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(w["confidence"], F.lit(70.0)))).alias("confidence"), boxed(w).alias("bbox"), F.coalesce(w["line_id"], i).alias("line_id"))
    given = F.filter(F.transform(parsed["words"], word), lambda w: w["text"] != "")
    plain = F.when(is_json, F.coalesce(parsed["text"], F.lit(""))).otherwise(payload)
    token = lambda t, i: F.struct(t.alias("text"), F.lit(70.0).alias("confidence"), zeros.alias("bbox"), i.alias("line_id"))
    tokens = F.flatten(F.transform(F.split(plain, "\n", -1), lambda l, i: F.transform(F.regexp_extract_all(l, F.lit(r"(?U)\S+"), F.lit(0)), lambda t: token(t, i))))
    return F.when(is_json & (F.size(F.coalesce(parsed["words"], F.array().cast(f"array<{WORD}>"))) > 0), given).otherwise(tokens)


def effective_settings(project: Column, defaults: Column) -> Column:
    """Project settings (map of strings) over defaults: a secondary language equal to the primary goes,
    indigenous mode lowers the threshold and keeps secondary words."""
    merged = F.map_from_entries(F.concat(F.map_entries(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(project, k))), F.map_entries(project)))

    def settle(m: Column) -> Column:
        of = lambda k: F.nullif(F.trim(F.element_at(m, F.lit(k))), F.lit(""))
        primary, indigenous = F.coalesce(of("primary_language"), F.lit("spa")), _flag(of("indigenous_minority_mode"))
        threshold = F.when(indigenous, F.coalesce(of("indigenous_confidence_threshold").try_cast("double"), F.lit(65.0))).otherwise(F.coalesce(of("confidence_threshold").try_cast("double"), F.lit(fixed.CONFIDENCE_THRESHOLD)))
        return F.struct(primary.alias("primary_language"), F.nullif(of("secondary_language"), primary).alias("secondary_language"), indigenous.alias("indigenous_minority_mode"), threshold.alias("confidence_threshold"), (~indigenous).alias("extract_secondary"))

    return let(merged, settle)
