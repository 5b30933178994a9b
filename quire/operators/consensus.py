"""Consensus of several readings of a page.

The readings of a page stand in one row, so tokens are aligned by position within the row and no
token is shuffled.  What depends on the tokens before (offsets, numbers) is a fold within the row
too (``flagged``); only flags of tokens that come as a table (``flags``) need windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import let, token_lines

#: Tokens of a line that are folded at once: a fold copies its flags as it grows.
BLOCK = 256


def one_row_a_page(readings: DataFrame, keys: list[str], runs: list[str], run: str = "run", text: str = "text") -> DataFrame:
    """Long readings to a column for each run; a missing run is null."""
    return readings.groupBy(*keys).pivot(run, runs).agg(F.first(text))


def _upto(n: Column, step: int = 1) -> Column:
    """0, step, ... below n."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _lets(columns: list[Column], use: Callable[[list[Column]], Column], done: tuple = ()) -> Column:
    """use(columns) with each evaluated once."""
    return let(columns[len(done)], lambda c: _lets(columns, use, (*done, c))) if len(done) < len(columns) else use([*done])


def _longest(arrays: list[Column]) -> Column:
    return F.greatest(F.lit(0), *[F.size(a) for a in arrays])


def _lines(runs: list[str], use: Callable[[Column, list[Column]], Column]) -> Column:
    """array of use(line index, every run's tokens of the line) over a page's lines; equal pages are cut once."""
    texts = [F.coalesce(F.col(r), F.lit("")) for r in runs]
    none = F.array().cast("array<string>")

    def of_lines(cuts: list[Column]) -> Column:
        return F.transform(_upto(_longest(cuts)), lambda i: _lets([F.coalesce(F.get(c, i), none) for c in cuts], lambda tokens: use(i, tokens)))

    def cut(done: tuple) -> Column:
        if len(done) == len(runs):
            return of_lines([*done])
        t = texts[len(done)]
        own = token_lines(t)
        for same, known in zip(texts, done, strict=False):
            own = F.when(t == same, known).otherwise(own)
        return let(own, lambda c: cut((*done, c)))

    return cut(())


def aligned_tokens(pages: DataFrame, runs: list[str]) -> DataFrame:
    """A row for each (line, word) position with every run's token, "" where a run has none."""

    def words(i: Column, tokens: list[Column]) -> Column:
        return F.transform(_upto(_longest(tokens)), lambda j: F.struct(i.alias("line_index"), j.alias("word_index"), *[F.coalesce(F.get(t, j), F.lit("")).alias(r) for r, t in zip(runs, tokens, strict=True)]))

    rest = [c for c in pages.columns if c not in runs]
    return pages.select(*rest, F.explode(F.flatten(_lines(runs, words))).alias("t__")).select(*rest, "t__.*")


def _judgement(text: Callable[[str], Column], runs: list[str], confidence: Callable[[Column, str], Column], threshold: float) -> dict[str, Column]:
    agree, sure = F.lit(True), F.lit(True)
    for r in runs:
        agree = agree & (text(r) == text(runs[0])) if r != runs[0] else agree
        sure = sure & ((text(r) == "") | (confidence(text(r), r) >= threshold))
    shown = F.coalesce(*[F.nullif(text(r), F.lit("")) for r in (runs[0], runs[-1])], F.lit("?"))
    return {"agree": agree, "confident": sure, "display": F.when(agree & sure, text(runs[0])).otherwise(shown)}


def judged(tokens: DataFrame, runs: list[str], confidence: Callable[[Column, str], Column], threshold: float = fixed.CONFIDENCE_THRESHOLD) -> DataFrame:
    """tokens with agree, confident and display (the first run's token, else the last one's, else any)."""
    return tokens.withColumns(_judgement(F.col, runs, confidence, threshold))


def confidence_of_words(words: Column, line: Column, token: Column) -> Column:
    """Confidence of a token by its text within a line: of equal texts the last by x; 0 if there is none."""
    own = F.filter(words, lambda w: (w["line_id"] == line) & (w["text"] == token))
    by_x = F.array_sort(F.transform(own, lambda w, i: F.struct(F.get(w["bbox"], F.lit(0)).alias("x"), i.alias("i"), w["confidence"].alias("c"))))
    return F.coalesce(F.get(F.reverse(by_x), F.lit(0))["c"], F.lit(0.0))


def looked_up(tokens: Column, texts: Column, confidences: Column) -> Column:
    """array<double>: confidences of a line's tokens by their texts; of equal texts the last, 0 without a match.

    texts, confidences: the line's words in the order of x.  They lie in buckets by hash, whose number grows with the
    root of theirs, so a long line isn't searched as a whole for each token."""
    many = F.floor(F.sqrt(F.size(texts)) / 8).cast("int") + 1
    at = lambda t, texts, c: F.coalesce(F.get(c, (F.array_position(texts, t) - 1).cast("int")), F.lit(0.0))
    slot = lambda t, m: F.pmod(F.hash(t), m)

    def in_buckets(texts: Column, c: Column, m: Column) -> Column:
        places = lambda s: F.filter(F.transform(texts, lambda _, i: i), lambda i: slot(F.get(texts, i), m) == s)
        bucket = lambda s: let(places(s), lambda p: F.struct(F.transform(p, lambda i: F.get(texts, i)).alias("texts"), F.transform(p, lambda i: F.get(c, i)).alias("c")))
        return let(F.transform(_upto(m), bucket), lambda buckets: F.transform(tokens, lambda t: let(F.get(buckets, slot(t, m)), lambda b: at(t, b["texts"], b["c"]))))

    def found(texts: Column, c: Column, m: Column) -> Column:
        return F.when(m == 1, F.transform(tokens, lambda t: at(t, texts, c))).otherwise(in_buckets(texts, c, m))

    return _lets([F.reverse(texts), F.reverse(confidences), many], lambda x: found(*x))


def flagged(runs: list[str], confidence: Callable[[Column, str], Column] | None = None, words: Callable[[Column, Column, str], tuple[Column, Column]] | None = None, threshold: float = fixed.CONFIDENCE_THRESHOLD) -> Column:
    """array<struct>: flagged positions of a page in order, with line_index, word_index, char_start, the display, agree,
    confident and every run's token.  Nothing is shuffled.

    confidence(token, run), or words(tokens, line, run): the texts and confidences of a line's words in the order of x,
    to look confidences up from; then the structs have ``<run>_conf``."""
    sure = [f"{r}_conf" for r in runs] if words else []
    kind = f"array<struct<line_index:int,word_index:int,char_start:int,display:string,agree:boolean,confident:boolean,{','.join([f'`{r}`:string' for r in runs] + [f'`{r}`:double' for r in sure])}>>"

    def block(i: Column, start: Column, width: Column, shown: Column, tokens: list[Column], confs: list[Column]) -> Column:
        """struct(at, out): the block's length and its flags, offsets from its start."""

        def judgement(j: Column) -> dict[str, Column]:
            text = lambda r: F.coalesce(F.get(tokens[runs.index(r)], j), F.lit(""))
            return _judgement(text, runs, (lambda _, r: F.coalesce(F.get(confs[runs.index(r)], j), F.lit(0.0))) if words else confidence, threshold)

        def open_(j: Column) -> Column:
            told = judgement(j)
            return ~(told["agree"] & told["confident"])

        def step(acc: Column, j: Column) -> Column:
            """The offset of place j: only what stands since the flag before is measured."""
            at = acc["at"] + F.when(j == acc["next"], 0).otherwise(F.length(F.array_join(F.slice(shown, acc["next"] + 1, j - acc["next"]), " ")) + 1)
            return let(at, lambda at: F.struct(at.alias("at"), j.alias("next"), F.concat(acc["offsets"], F.array(at)).alias("offsets")))

        def flag(j: Column, offset: Column) -> Column:
            told = judgement(j)
            return F.struct(i.alias("line_index"), j.alias("word_index"), offset.alias("char_start"), F.get(shown, j).alias("display"), told["agree"].alias("agree"), told["confident"].alias("confident"), *[F.coalesce(F.get(t, j), F.lit("")).alias(r) for r, t in zip(runs, tokens, strict=True)], *[F.coalesce(F.get(c, j), F.lit(0.0)).alias(r) for r, c in zip(sure, confs, strict=True)])

        begin = F.struct(F.lit(0).alias("at"), start.alias("next"), F.array().cast("array<int>").alias("offsets"))
        placed = lambda found: F.zip_with(found, F.aggregate(found, begin, step)["offsets"], flag)
        length = F.length(F.array_join(F.slice(shown, start + 1, F.least(F.lit(BLOCK), width - start)), " ")) + 1
        at = F.sequence(start, F.least(start + F.lit(BLOCK - 1), width - 1))
        return F.struct(F.when(width > BLOCK, length).otherwise(F.lit(0)).alias("at"), let(F.filter(at, open_), placed).cast(kind).alias("out"))

    def joined(acc: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda f: f.withField("char_start", f["char_start"] + acc["at"]))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.when(F.size(b["out"]) == 0, acc["out"]).when(acc["at"] == 0, b["out"]).otherwise(F.concat(acc["out"], moved)).alias("out"))

    def line(i: Column, tokens: list[Column]) -> Column:
        confs = [looked_up(t, *words(t, i, r)) for r, t in zip(runs, tokens, strict=True)] if words else []
        width, first, last = _longest(tokens), tokens[0], tokens[-1]
        shown = F.when(F.size(first) == width, first).otherwise(F.transform(_upto(width), lambda j: F.coalesce(F.get(first, j), F.get(last, j), F.lit("?"))))
        of_blocks = lambda x: F.aggregate(F.transform(_upto(x[0], BLOCK), lambda s: block(i, s, x[0], x[1], tokens, x[2:])), F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), joined)["out"]
        return _lets([width, shown, *confs], of_blocks)

    return F.flatten(_lines(runs, line))


def _reason(of: Callable[[str], Column]) -> Column:
    return F.concat_ws(";", F.when(~of("agree"), "engine_disagreement"), F.when(~of("confident"), "low_confidence"))


def _span_id(number: Column) -> Column:
    return F.concat(F.lit("flag_"), F.lpad(number.cast("string"), 5, "0"))


def listed_flags(found: Column, runs: list[str], extra: Column | None = None) -> Column:
    """array<struct>: a page's ``flagged`` with the columns that ``flags`` gives but keys, in order.

    extra: how many flags the page has already; numbers go on from there."""
    before = F.lit(1) if extra is None else extra + 1
    one = lambda f, n: F.struct(_span_id(n + before).alias("span_id"), f["line_index"].alias("line_index"), f["word_index"].alias("word_index"), f["char_start"].alias("char_start"), (f["char_start"] + F.length(f["display"])).alias("char_end"), f["display"].alias("text"), _reason(lambda c: f[c]).alias("reason"), *[f[r].alias(r) for r in runs])
    return F.transform(found, one)


def flags_of_pages(pages: DataFrame, keys: list[str], runs: list[str], confidence: Callable[[Column, str], Column] | None = None, words: Callable[[Column, Column, str], tuple[Column, Column]] | None = None, extra: Column | None = None, threshold: float = fixed.CONFIDENCE_THRESHOLD) -> DataFrame:
    """``flags`` of readings that stand in one row a page, without a shuffle; confidences as in ``flagged``."""
    number = F.col("n__") + 1 + (F.lit(0) if extra is None else F.col("extra__"))
    rows = pages.select(*keys, *([] if extra is None else [extra.alias("extra__")]), F.posexplode(flagged(runs, confidence, words, threshold)).alias("n__", "f__"))
    f = lambda c: F.col("f__")[c]
    sure = [f(f"{r}_conf").alias(f"{r}_conf") for r in runs] if words else []
    return rows.select(*keys, _span_id(number).alias("span_id"), f("line_index").alias("line_index"), f("word_index").alias("word_index"), f("char_start").alias("char_start"), (f("char_start") + F.length(f("display"))).alias("char_end"), f("display").alias("text"), _reason(f).alias("reason"), *[f(r).alias(r) for r in runs], *sure)


def flags(tokens: DataFrame, keys: list[str], runs: list[str], extra: Column | None = None) -> DataFrame:
    """Flagged positions of a table of tokens with reasons, character offsets within the line and span ids within the page.

    All tokens are shuffled by line; readings in one row a page go through ``flags_of_pages``.
    extra: how many flags the page has already; numbers go on from there.  Confidences stay where tokens have them."""
    line = Window.partitionBy(*keys, "line_index").orderBy("word_index").rowsBetween(Window.unboundedPreceding, -1)
    placed = tokens.withColumn("char_start", F.coalesce(F.sum(F.length("display") + 1).over(line), F.lit(0)).cast("int"))
    found = placed.filter(~(F.col("agree") & F.col("confident")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("line_index", "word_index")) + (F.lit(0) if extra is None else extra)
    sure = [f"{r}_conf" for r in runs if f"{r}_conf" in tokens.columns]
    return found.select(*keys, _span_id(number).alias("span_id"), "line_index", "word_index", "char_start", (F.col("char_start") + F.length("display")).alias("char_end"), F.col("display").alias("text"), _reason(F.col).alias("reason"), *runs, *sure)


def page_flags(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Flags of whole pages: a footnote region, a flag for each image, a switch of languages, each word of a second one.

    pages: (keys, page_id string, footnotes boolean, images array<array<int>>, switches boolean, second array<struct<line int, word string>>)."""
    kind = "array<struct<span_id:string,line_index:int,word_index:int,char_start:int,char_end:int,text:string,reason:string,bbox:array<int>>>"
    none = F.lit(None).cast("array<int>")

    def one(span, line, word, end, text, reason, bbox):
        parts = {"span_id": F.concat_ws("_", "page_id", span), "line_index": line, "word_index": word, "char_start": F.lit(0), "char_end": end, "text": text, "reason": F.lit(reason), "bbox": bbox}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    whole = lambda span, reason: F.array(one(F.lit(span), F.lit(0), F.lit(0), F.lit(0), F.lit(fixed.EXTRA_FLAGS[reason]), reason, none)).cast(kind)
    empty, image = F.array().cast(kind), F.lit(fixed.IMAGE)
    images = F.transform("images", lambda b, i: one(F.concat(F.lit("image_"), i.cast("string")), F.lit(0), i, F.lit(len(fixed.IMAGE)), image, "image_placeholder", b)).cast(kind)
    second = F.transform("second", lambda s: one(F.concat(F.lit("secondary_"), s["line"].cast("string"), F.lit("_"), F.left(s["word"], F.lit(8))), s["line"], F.lit(0), F.length(s["word"]), s["word"], "secondary_language_segment", none)).cast(kind)
    every = F.concat(F.when(F.col("footnotes"), whole("footnote", "footnote_region")).otherwise(empty), F.coalesce(images, empty), F.when(F.col("switches"), whole("lang_switch", "complex_layout_language_switch")).otherwise(empty), F.coalesce(second, empty))
    return pages.select(*keys, F.explode(every).alias("f")).select(*keys, "f.*")


def with_resolution(flags_: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """flags with ``resolved``: true where a reviewer has closed the span, else false.  resolved: (keys, span_id)."""
    closed = resolved.select(*keys, "span_id").distinct().withColumn("resolved", F.lit(True))
    return flags_.join(closed, [*keys, "span_id"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def resolution_counts(listed: Column, closed: Column) -> Column:
    """struct<total_flags, unresolved> of a page's ``listed_flags``; closed: array of the span ids that a reviewer has closed."""
    spans = F.transform(listed, lambda f: f["span_id"])
    return F.struct(F.size(listed).cast("long").alias("total_flags"), F.size(F.array_except(spans, closed)).cast("long").alias("unresolved"))


def reviewed_texts(drafts: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): a reviewer's text where there is one, even an empty one, else the draft."""
    both = drafts.select(*keys, F.col("text").alias("draft")).join(edits.select(*keys, F.col("text").alias("edit")), keys, "left")
    return both.select(*keys, F.coalesce("edit", "draft").alias("text"))


def stats(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Accepted and flagged words by keys; auto_accept where nothing is flagged."""
    ok = F.col("agree") & F.col("confident")
    return tokens.groupBy(*keys).agg(F.count_if(ok).alias("auto_accepted_words"), F.count_if(~ok).alias("flagged_words")).withColumn("auto_accept", F.col("flagged_words") == 0)


def stats_with_page_flags(tokens: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """stats with ``total_flags``, which counts the flags of whole pages too; they also stand against auto_accept."""
    counted = extra.groupBy(*keys).agg(F.count(F.lit(1)).alias("n__"))
    total = F.col("flagged_words") + F.coalesce("n__", F.lit(0))
    joined = stats(tokens, keys).join(counted, keys, "left").withColumn("total_flags", total)
    return joined.withColumn("auto_accept", F.col("total_flags") == 0).drop("n__")


def suggestion(runs: list[str]) -> Column:
    """The token that most runs have; ties go to the first run.  A hint, never accepted by itself."""
    tokens = F.array(*runs)
    votes = F.transform(F.filter(tokens, lambda t: t != ""), lambda t, i: F.struct((-F.size(F.filter(tokens, lambda u: u == t))).alias("minus"), i.alias("at"), t.alias("t")))
    return F.get(F.array_sort(votes), F.lit(0))


def guidance(runs: list[str], reason: Column) -> Column:
    different = F.size(F.array_distinct(F.transform(F.filter(F.array(*runs), lambda t: t != ""), lambda t: F.lower(F.trim(t)))))
    return F.when(different >= 3, "all_differ").when(different == 2, "two_agree").when(reason.contains("low_confidence"), "low_confidence").otherwise("default")
