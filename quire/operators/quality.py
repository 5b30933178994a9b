"""Page checks: script, length, section of the book, shares of languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import is_skip, language_key, let, markers_present, squash, strip, words_present


def script_share(c: Column, script: str = "latin") -> Column:
    """Characters in the script's range to letters; null without letters.  Signs in the range count,
    so the share may pass 1."""
    low, high = fixed.SCRIPT_RANGES[script]
    return F.try_divide(F.regexp_count(c, F.lit(f"[\\x{{{low:X}}}-\\x{{{high:X}}}]")), F.regexp_count(c, F.lit(r"\p{L}")))


def _fault_of(t: Column, share: Column, script: str) -> Column:
    """Of a stripped text and its script's share."""
    least = fixed.LATIN_SHARE if script == "latin" else fixed.OTHER_SCRIPT_SHARE
    return F.when(F.length(t) < fixed.LEAST_CONTENT_CHARS, "too_short").when(share.isNull(), "no_letters").when(share < least, "wrong_script")


def script_and_fault(c: Column, script: str = "latin") -> Column:
    """struct(text, share, fault): the stripped text, the share of its script and what is wrong, each worked out once."""
    shared = lambda t: F.struct(t.alias("text"), script_share(t, script).alias("share"))
    told = lambda x: F.struct(x["text"].alias("text"), x["share"].alias("share"), _fault_of(x["text"], x["share"], script).alias("fault"))
    return let(let(strip(F.coalesce(c, F.lit(""))), shared), told)


def output_fault(c: Column, script: str = "latin") -> Column:
    """too_short, no_letters, wrong_script or null."""
    return script_and_fault(c, script)["fault"]


def page_faults(c: Column, script: str = "latin", blank: Column | None = None) -> Column:
    """array of reasons; empty for blank text, skip bodies and good pages.  A short page is no fault
    where the image is known to be blank."""
    blank, none = F.lit(False) if blank is None else blank, F.array().cast("array<string>")

    def reasons(x: Column) -> Column:
        short = (x["fault"] == "too_short") | x["fault"].isNull() & (F.length(squash(x["text"])) < fixed.LEAST_CONTENT_CHARS)
        found = F.array_compact(F.array(F.when(short & ~blank, "too_short").when(x["fault"].isin("no_letters", "wrong_script"), "script_mismatch")))
        return F.when((x["text"] == "") | is_skip(x["text"]), none).otherwise(found)

    return let(script_and_fault(c, script), reasons)


def manuscript_brackets(c: Column) -> Column:
    """Bracketed reconstructions: not asides as [sic], four characters or more, with a letter."""
    inner = F.transform(F.regexp_extract_all(c, F.lit(r"\[([^\]]+)\]"), F.lit(1)), strip)
    key = lambda x: F.regexp_replace(F.lower(x), r"\.+$", "")
    return F.size(F.filter(inner, lambda x: ~key(x).isin(*fixed.BRACKET_ASIDE) & ~key(x).startswith("sic") & (F.length(x) >= 4) & x.rlike("[A-Za-zÀ-ÿĀāĒēĪīŌō]")))


def section(c: Column, combining: Column | None = None) -> Column:
    """Section of a page from its text: skipped, editorial_spanish, spanish_translation,
    paleographic_nahuatl or mixed.  combining: number of combining macrons (udfs), if wanted."""

    def rules(t: Column) -> Column:
        header = F.upper(F.left(t, F.lit(1200))).rlike("|".join(fixed.EDITORIAL_HEADERS))
        brackets, macrons = manuscript_brackets(t), F.regexp_count(t, F.lit("[ĀāĒēĪīŌō]"))
        nahuatl, editorial, translation = markers_present(t, fixed.NAHUATL_SIGNS), markers_present(t, fixed.EDITORIAL_PROSE), markers_present(t, fixed.TRANSLATION_PROSE)
        spanish = words_present(t, fixed.COLONIAL_SPANISH)
        strokes = F.lit(0) if combining is None else combining
        archaic = (nahuatl == 0) & (macrons == 0) & ((spanish >= 3) | (spanish >= 2) & ((strokes >= 1) | (F.regexp_count(F.lower(t), F.lit("ç")) >= 2)))
        paleographic = (brackets >= 2) & ((macrons >= 1) | (nahuatl >= 1)) | (brackets >= 1) & (macrons >= 1) & (nahuatl >= 1) | (macrons >= 2) & (nahuatl >= 1)
        without = F.when(editorial >= 2, "editorial_spanish").when((translation >= 2) | (translation >= 1) & (editorial == 0), "spanish_translation").when(editorial >= 1, "editorial_spanish").otherwise("spanish_translation")
        return (
            F.when((t == "") | t.startswith("[Skipped:"), "skipped")
            .when(header, "editorial_spanish")
            .when(archaic, "spanish_translation")
            .when(paleographic, "paleographic_nahuatl")
            .when(brackets == 0, without)
            .when(editorial >= 2, "editorial_spanish")
            .when(translation >= 1, "spanish_translation")
            .otherwise("mixed")
        )

    return let(strip(F.coalesce(c, F.lit(""))), rules)


def language_shares(c: Column) -> Column:
    """"Spanish 60%, Nahuatl 40%" to array<struct<language, share>>: a bare name counts 1, equal
    languages add up, all is scaled to 1 only beyond 1.5."""
    pattern = r"^(.+?)\s*(\d+(?:\.\d+)?)\s*%"
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]+", -1), strip), lambda p: p != "")
    one = lambda p: F.struct(language_key(F.when(p.rlike(pattern), strip(F.regexp_extract(p, pattern, 1))).otherwise(p)).alias("language"), F.when(p.rlike(pattern), F.regexp_extract(p, pattern, 2).try_cast("double") / 100).otherwise(1.0).alias("share"))

    def summed(pairs: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(pairs, lambda x: x["language"])))
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["share"])
        scale = F.when(total(pairs) > 1.5, total(pairs)).otherwise(1.0)
        return F.transform(names, lambda n: F.struct(n.alias("language"), F.round(total(F.filter(pairs, lambda x: x["language"] == n)) / scale, 6).alias("share")))

    return let(F.filter(F.transform(parts, one), lambda x: x["language"].isNotNull()), summed)
