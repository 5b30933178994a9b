"""Column functions over page texts.  Everything here stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c evaluated once, however often use mentions it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """All white space removed."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def lines_of(c: Column) -> Column:
    """Lines without their ends; no empty line after a final line end."""
    cut = lambda parts: F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return let(F.split(c, LINE_END, -1), cut)


def tokens_of(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0))


def token_lines(c: Column) -> Column:
    """array (by line) of arrays of tokens: ``tokens_of`` of each of ``lines_of``; plain cuts where blanks and \\n are all the space."""
    plain = let(F.split(c, "\n", -1), lambda parts: F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))
    plain_tokens = F.transform(plain, lambda line: F.array_remove(F.split(line, " ", -1), ""))
    return F.when(c.rlike(r"(?U)[\x1c-\x1e[\s&&[^ \n]]]"), F.transform(lines_of(c), tokens_of)).otherwise(plain_tokens)


def contains_any(c: Column, markers: Iterable[str]) -> Column:
    """Some marker is in the lower-case text: one alternation instead of a scan each."""
    return F.lower(c).rlike("|".join(re.escape(m).replace("\\ ", " ") for m in markers))


def markers_present(c: Column, markers: Iterable[str]) -> Column:
    """How many different markers are in the lower-case text, which is made once."""
    return let(F.lower(c), lambda low: sum((low.contains(m).cast("int") for m in markers), F.lit(0)))


def words_present(c: Column, words: Iterable[str]) -> Column:
    """How many different words stand in the lower-case text, between word boundaries: the text is cut into
    words once, however long the list is.  The words must have letters, digits and underscores only."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))
    return F.coalesce(F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in words]))), F.lit(0))


# ------------------------------------------------------------- predicates


def is_skip(c: Column) -> Column:
    t = strip(c)
    return t.rlike(r"(?i)^\[Skipped:\s*.+\]\s*$") & ~t.contains("\n") | t.startswith("[Skipped:")


def is_chatter(c: Column) -> Column:
    return contains_any(c, fixed.CHATTER)


def is_patch_chatter(c: Column) -> Column:
    return contains_any(c, fixed.PATCH_CHATTER)


def is_boilerplate(c: Column) -> Column:
    return markers_present(F.left(c, F.lit(3500)), fixed.BOILERPLATE) >= 2


def skip_for_page(page: Column, skip: Column, text: Column) -> Column:
    """Front pages go: all up to skip, and boilerplate among the next five."""
    return F.when(page <= skip, True).when(page <= skip + 5, is_boilerplate(text)).otherwise(False)


_PUNCTUATION = ".,;:!?\"'()[]"


def looks_spanish(word: Column) -> Column:
    w = F.btrim(F.lower(word), F.lit(_PUNCTUATION))
    return (w == "") | w.isin(*fixed.SPANISH_HINTS) | w.rlike("^[a-záéíóúüñ]+$")


def looks_indigenous(word: Column, languages: Iterable[str] = ("nah",)) -> Column:
    return word.rlike(fixed.INDIGENOUS) if {"nah", "ncx"} & set(languages) else F.lit(False)


def switches_language(c: Column, languages: Iterable[str] = ("nah",)) -> Column:
    words = tokens_of(c)
    hits = lambda test: F.size(F.filter(words, test))
    return (hits(lambda w: looks_indigenous(w, languages)) >= 2) & (hits(looks_spanish) >= 5)


# ------------------------------------------------------------- notation


def _translated(c: Column, content: Column) -> Column:
    return F.translate(content, fixed.SUPER_FROM + fixed.SUPER_FROM[10:].upper(), fixed.SUPER_TO + fixed.SUPER_TO[10:])


def _replace_each(c: Column, pattern: str, group: int, new: Callable[[Column], Column]) -> Column:
    """Every match replaced by new(its group): gaps and matches are joined again."""

    def joined(x: Column) -> Column:
        gaps, found = F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(group))
        return F.when(x.rlike(pattern), F.array_join(F.zip_with(gaps, F.transform(found, new), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")).otherwise(x)

    return let(c, joined)


def canonical_superscripts(c: Column) -> Column:
    """Ordinal signs after a small letter become modifier letters; after a capital they stay."""
    return F.regexp_replace(F.regexp_replace(c, "([a-zà-ÿñç])º", "$1ᵒ"), "([a-zà-ÿñç])ª", "$1ᵃ")


def notation_tier1(c: Column) -> Column:
    """HTML and caret superscripts to signs, then canonical_superscripts."""
    sup = lambda x: _translated(x, x)
    c = _replace_each(c, r"(?is)<sup>(.*?)</sup>", 1, lambda m: sup(strip(m)))
    c = _replace_each(c, r"(?<=[A-Za-zÀ-ÿ])\^([0-9]+|[oaOA])(?![A-Za-zÀ-ÿ0-9])", 1, sup)
    c = _replace_each(c, r"(?<![A-Za-zÀ-ÿ])\^([0-9]+)", 1, sup)
    return canonical_superscripts(c)


def abbreviations_tier2(c: Column, strict: bool = True) -> Column:
    """Spanish abbreviation signs.  The lenient rules (strict=False) also change words that merely
    begin so, as ``no`` or ``mano``; the strict ones ask for the full stop or the end of the word.
    Macrons are another step (udfs.unify_macron)."""
    end = r"(?![\p{L}\p{N}])"
    rules = [
        (r"(?iU)\bN\.?\s*o\.?", "Nº", rf"(?U)\bN\.\s*[oO]\b\.?{end}"),
        (r"(?U)\bN\s*°", "Nº", r"(?U)\bN\s*°"),
        (r"(?U)\bN\s*ᵒ", "Nº", r"(?U)\bN\s*ᵒ"),
        (r"(?iU)\bM\.?\s*a\.?", "Mª", rf"(?U)\bM\.\s*[aA]\b\.?{end}"),
        (r"(?U)\bM\s*°", "Mª", r"(?U)\bM\s*°"),
        (r"(?iU)\bS\.?\s*ra\.?", "Sra.", rf"(?iU)\bS\.?ra\b\.?{end}"),
        (r"(?iU)\bS\.?\s*r\.?", "Sr.", rf"(?iU)\bS\.?r\b\.?{end}"),
    ]
    for lenient, new, exact in rules:
        c = F.regexp_replace(c, exact if strict else lenient, new)
    return c


def canonical(c: Column, unify: bool = False) -> Column:
    """The form that readings are compared in."""
    c = notation_tier1(c)
    return squash(abbreviations_tier2(c) if unify else c)


def normalise_output(c: Column, notation: Callable[[Column], Column] = notation_tier1) -> Column:
    """What a reader returned, as a page body: skip lines for blank, boilerplate and stamp pages."""
    skip = lambda why: F.lit(f"[Skipped: {why}]")

    def body(t: Column) -> Column:
        low = F.lower(t)
        return (
            F.when((t == "") | is_chatter(t), skip("blank page"))
            .when(is_skip(t), strip(F.get(F.split(t, LINE_END, -1), F.lit(0))))
            .when(low.contains("google") & low.contains("book"), skip("Google boilerplate"))
            .when(low.contains("library") & low.contains("stamp") & (F.length(t) < 120), skip("library stamp"))
            .otherwise(notation(t))
        )

    return let(strip(c), body)


def reconcile_output(c: Column) -> Column:
    """struct(body, uncertain, note): UNCERTAIN lines go out of the body, the first one is the note."""
    pattern = r"(?im)^UNCERTAIN:[ \t\f\x0b]*(.+)$"
    uncertain = c.rlike(pattern)
    body = F.when(uncertain, strip(F.regexp_replace(c, pattern, ""))).otherwise(c)
    return F.struct(normalise_output(body).alias("body"), uncertain.alias("uncertain"), F.when(uncertain, strip(F.regexp_extract(c, pattern, 1))).otherwise(F.lit("")).alias("note"))


# ------------------------------------------------------------- lines and spans


def fold_lines(c: Column) -> Column:
    """Lines joined to paragraphs: blank lines and list lines stay; a text line takes the next
    ones in, without a hyphen after a letter at its end, until it ends in ``. ! ? : ;``."""
    lines = lines_of(c)
    rtrim = lambda x: F.regexp_replace(x, r"(?U)\s+$", "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("open"))

    def flush(acc: Column, *more: Column) -> Column:
        done = F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"])))
        return F.concat(done, F.array(*more)) if more else done

    def step(acc: Column, raw: Column) -> Column:
        line, text = rtrim(raw), strip(raw)
        is_list = text.rlike("^[-*•]")
        joinable = acc["open"].isNotNull() & (text != "")
        hyphen = acc["open"].rlike(r"\p{L}-$")
        ended = acc["open"].rlike("[.!?:;]$")
        fresh = lambda: F.struct(flush(acc).alias("out"), line.alias("open"))
        alone = F.struct(flush(acc, line).alias("out"), F.lit(None).cast("string").alias("open"))
        return (
            F.when(text == "", F.struct(flush(acc, F.lit("")).alias("out"), F.lit(None).cast("string").alias("open")))
            .when(joinable & hyphen, F.struct(acc["out"].alias("out"), F.concat(F.substring(acc["open"], F.lit(1), F.length(acc["open"]) - 1), text).alias("open")))
            .when(joinable & ~ended, F.struct(acc["out"].alias("out"), F.concat_ws(" ", acc["open"], text).alias("open")))
            .when(is_list, alone)
            .otherwise(fresh())
        )

    done = F.aggregate(lines, start, step, lambda acc: F.array_join(flush(acc), "\n"))
    return F.when(strip(c) == "", c).otherwise(done)


def logical_text(c: Column, join_hyphens: bool = True) -> Column:
    """Paragraphs as lines of their own; hyphens at line ends are joined first unless told not to."""
    if join_hyphens:
        c = F.regexp_replace(c, r"-[^\S\n]*\n\s*(?=\S)", "")
    paragraphs = F.filter(F.transform(F.split(c, r"\n\s*\n", -1), strip), lambda p: p != "")
    return F.array_join(F.transform(paragraphs, lambda p: F.regexp_replace(p, r"\s*\n\s*", " ")), "\n\n")


def footnote_segments(c: Column, clean: Callable[[Column], Column] = strip) -> Column:
    """array<struct<kind, content>>: bodies and footnotes in order, cleaned; an unclosed note takes the rest."""
    opened = F.split(c, re.escape(fixed.FOOTNOTE_START), -1)
    body = lambda t: F.filter(F.array(F.struct(F.lit("body").alias("kind"), clean(t).alias("content"))), lambda s: s["content"] != "")

    def after(part: Column) -> Column:
        closed = F.split(part, re.escape(fixed.FOOTNOTE_END), 2)
        note = F.array(F.struct(F.lit("footnote").alias("kind"), clean(F.get(closed, F.lit(0))).alias("content")))
        return F.concat(note, body(F.coalesce(F.get(closed, F.lit(1)), F.lit(""))))

    rest = F.flatten(F.transform(F.slice(opened, 2, F.size(opened)), after))
    return F.concat(body(F.get(opened, F.lit(0))), F.when(F.size(opened) > 1, rest).otherwise(F.array().cast("array<struct<kind:string,content:string>>")))


def splice(c: Column, start: Column, end: Column, new: Column) -> Column:
    """c[:start] + new + c[end:]; unchanged where the range is none."""
    ok = (start >= 0) & (end <= F.length(c)) & (start < end)
    return F.when(ok, F.concat(F.substring(c, F.lit(1), start), new, F.substring(c, end + 1, F.length(c)))).otherwise(c)


def sentence_spans(logical: Column) -> Column:
    """array<struct<start, end>> of Latin sentences: cuts around the space after ``.`` or ``;``
    before a capital, ``*`` or a quote, after full-width stops, and around blank lines."""
    pattern = "(?<=[.;])\\s+(?=[\\p{Lu}*\"'])|(?<=[。、！？])|\\n\\n+"
    gaps = F.split(logical, pattern, -1)
    seps = F.regexp_extract_all(logical, F.lit(pattern), F.lit(0))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x["g"]) + F.length(x["s"])).alias("at"), F.when(strip(x["g"]) == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x["g"])).alias("end"))))).alias("out"))
    both = F.zip_with(gaps, seps, lambda g, s: F.struct(F.coalesce(g, F.lit("")).alias("g"), F.coalesce(s, F.lit("")).alias("s")))
    return F.aggregate(both, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")), step)["out"]


# ------------------------------------------------------------- terms and ids


def match_view(c: Column) -> Column:
    """Lower case, without note digits and brackets."""
    return F.lower(F.translate(c, fixed.NOTE_DIGITS + "[]", ""))


def spellings(term: Column) -> Column:
    """Colonial variants of a term, itself first."""
    t = F.lower(F.trim(term))
    swap = lambda a, b: F.when(t.contains(a), F.regexp_replace(t, a, b))
    head = lambda a, b: F.when(t.startswith(a), F.concat(F.lit(b), F.substring(t, F.lit(5), F.length(t))))
    return F.array_distinct(F.array_compact(F.array(t, swap("cuauh", "quauh"), swap("quauh", "cuauh"), head("cuau", "quau"), head("quau", "cuau"))))


def term_present(term: Column, text: Column, variants: bool = False) -> Column:
    view = match_view(text)
    forms = spellings(term) if variants else F.array(F.lower(term))
    return (F.trim(term) != "") & F.exists(forms, lambda f: view.contains(f))


def hard_term_candidates(c: Column, common: Iterable[str] = ()) -> Column:
    """Sorted distinct tokens of twelve or more characters with a Latin letter."""
    core = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^[*_]+|[*_]+$", ""), f"[{fixed.NOTE_DIGITS}]+$", ""), r"[\[\]]+", "")
    usual = [*common]
    keep = lambda t: (F.length(t) >= fixed.HARD_TERM_CHARS) & t.rlike("[A-Za-zÀ-ÿĀāĒēĪīŌō]") & (~F.lower(t).isin(*usual) if usual else F.lit(True))
    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens_of(c), core), keep)))


def placeholders(c: Column, label: str = "NAHUATL", languages: Iterable[str] = ("nah",), parts: str = r"(?U)\S+|\s+") -> Column:
    """Indigenous tokens replaced by [LABEL], spaces kept; parts: a pattern of tokens and of the spaces between."""
    found = F.regexp_extract_all(c, F.lit(parts), F.lit(0))
    return F.array_join(F.transform(found, lambda t: F.when((strip(t) != "") & looks_indigenous(t, languages), F.lit(f"[{label}]")).otherwise(t)), "")


def slug(c: Column) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("unknown")))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", "unknown").otherwise(s)


def emphasis_marks(c: Column, emphasis: str = "asterisk") -> Column:
    signs = {"asterisk": ["*"], "double_asterisk": ["**"], "japanese_quotes": ["《", "》", "「", "」"]}.get(emphasis, [])
    return F.array(*[F.regexp_count(c, F.lit(re.escape(s))) for s in signs]) if signs else F.array().cast("array<int>")


def batch_id(c: Column) -> Column:
    """struct(kind, idx, page) of a batch id; null for none of the five forms."""
    forms = [("transcribe", r"^r(\d+)_p(\d+)$", 1, 2), ("reconcile", r"^rec_p(\d+)$", 0, 1), ("spotpg", r"^spotpg_p(\d+)(?:_(\d+))?$", 2, 1), ("pass4", r"^p4_p(\d+)$", 0, 1), ("spot", r"^spot_p(\d+)(?:_(\d+))?$", 2, 1)]
    number = lambda p, g: F.coalesce(F.nullif(F.regexp_extract(c, p, g), F.lit("")).cast("int"), F.lit(0)) if g else F.lit(0)
    out = None
    for kind, pattern, idx, page in forms:
        value = F.struct(F.lit(kind).alias("kind"), number(pattern, idx).alias("idx"), number(pattern, page).alias("page"))
        out = F.when(c.rlike(pattern), value) if out is None else out.when(c.rlike(pattern), value)
    return out


def direction(c: Column) -> Column:
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(t.contains("right") | (t == "rtl"), "rtl").when(t.contains("mixed"), "mixed").otherwise("ltr")


def script_name(c: Column) -> Column:
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(t.contains("arabic"), "arabic").when(t.contains("korean") | t.contains("hangul"), "korean").when(t.contains("japanese") | t.contains("kana") | t.contains("kanji"), "japanese").when(t.contains("chinese"), "chinese").otherwise("latin")


def language_key(c: Column) -> Column:
    """Canonical language: a name with rules, an alias, else the first alias that contains it or is contained."""
    key = F.lower(strip(F.coalesce(c, F.lit(""))))
    out = F.when(key.isin(*fixed.RULED_LANGUAGES), key)
    for alias, name in fixed.LANGUAGE_ALIASES.items():
        out = out.when(key == alias, name)
    for alias, name in fixed.LANGUAGE_ALIASES.items():
        out = out.when(key.contains(alias) | F.lit(alias).contains(key), name)
    return out


def first_integer(c: Column, default: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).cast("int"), F.lit(default))
