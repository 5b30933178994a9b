"""Words with boxes: reading order, footnote band, image regions, composed pages.

words: array<struct<text, confidence, bbox array<int>, line_id>> of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import let


def words_to_text(words: Column) -> Column:
    """Lines by line_id, words of a line by x."""
    keyed = F.array_sort(F.transform(words, lambda w, i: F.struct(w["line_id"].alias("l"), F.get(w["bbox"], F.lit(0)).alias("x"), i.alias("i"), w["text"].alias("t"))))

    def placed(ws: Column) -> Column:
        """Each word behind what parts it from the one before: sorted once, read once."""
        part = lambda w, i: F.when(i == 0, "").when(F.get(ws, i - 1)["l"].eqNullSafe(w["l"]), " ").otherwise("\n")
        return F.array_join(F.transform(ws, lambda w, i: F.concat(part(w, i), w["t"])), "")

    return let(keyed, placed)


def _centre(w: Column, axis: int) -> Column:
    return (F.get(w["bbox"], F.lit(axis)) + F.get(w["bbox"], F.lit(axis + 2))) / 2


def footnote_words(words: Column, height: Column) -> Column:
    """Words with their centre in the lowest part of the page; none if there are fewer than two."""
    band = F.filter(words, lambda w: _centre(w, 1) >= F.floor(height * fixed.FOOTNOTE_BAND))
    return F.when(F.size(band) >= 2, band).otherwise(F.slice(band, 1, 0))


def body_words(words: Column, height: Column) -> Column:
    many = F.size(footnote_words(words, height)) > 0
    return F.when(many, F.filter(words, lambda w: _centre(w, 1) < F.floor(height * fixed.FOOTNOTE_BAND))).otherwise(words)


def region_has_text(words: Column, box: Column) -> Column:
    """Words with their centre in the box, border included, have eight or more characters."""
    at = lambda i: F.get(box, F.lit(i))
    inside = F.filter(words, lambda w: (_centre(w, 0) >= at(0)) & (_centre(w, 0) <= at(2)) & (_centre(w, 1) >= at(1)) & (_centre(w, 1) <= at(3)))
    return F.aggregate(inside, F.lit(0), lambda n, w: n + F.length(w["text"])) >= fixed.LEAST_REGION_CHARS


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""
    g = lambda c, i: F.get(c, F.lit(i))
    wide, high = F.least(g(a, 2), g(b, 2)) - F.greatest(g(a, 0), g(b, 0)), F.least(g(a, 3), g(b, 3)) - F.greatest(g(a, 1), g(b, 1))
    area = lambda c: (g(c, 2) - g(c, 0)) * (g(c, 3) - g(c, 1))
    return F.when((wide <= 0) | (high <= 0), 0.0).otherwise(wide * high / (area(a) + area(b) - wide * high + 1e-6))


def merge_boxes(boxes: Column, least: float = 0.3) -> Column:
    """Boxes joined with the first unused box that they overlap; not transitive: the seed decides."""
    start = F.struct(boxes.alias("left"), F.array().cast("array<array<int>>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        seed = F.get(acc["left"], F.lit(0))
        mine = F.filter(acc["left"], lambda b, i: (i == 0) | (overlap(seed, b) >= least))
        side = lambda i, f: f(F.transform(mine, lambda b: F.get(b, F.lit(i))))
        box = F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))
        rest = F.filter(acc["left"], lambda b, i: (i > 0) & (overlap(seed, b) < least))
        return F.when(F.size(acc["left"]) == 0, acc).otherwise(F.struct(rest.alias("left"), F.concat(acc["out"], F.array(box)).alias("out")))

    return F.aggregate(boxes, start, step)["out"]


def compose_page(words: Column, images: Column, height: Column) -> Column:
    """Body, image marks and footnotes by y (body 0), parted by blank lines."""
    body, notes = words_to_text(body_words(words, height)), footnote_words(words, height)
    part = lambda y, k, t: F.struct(y.cast("int").alias("y"), F.lit(k).alias("k"), t.alias("t"))
    none = F.array().cast("array<struct<y:int,k:int,t:string>>")
    parts = F.concat(
        F.when(body != "", F.array(part(F.lit(0), 0, body))).otherwise(none),
        F.transform(images, lambda b: part(F.get(b, F.lit(1)), 1, F.lit(fixed.IMAGE))),
        F.when(F.size(notes) > 0, F.array(part(F.floor(height * fixed.FOOTNOTE_BAND), 2, F.concat_ws("\n\n", F.lit(fixed.FOOTNOTE_START), words_to_text(notes), F.lit(fixed.FOOTNOTE_END))))).otherwise(none),
    )
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["t"]), "\n\n")
