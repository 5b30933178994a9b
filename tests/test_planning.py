import json

from pyspark.sql import functions as F

from quire.operators import planning, profiles, reports
from test_golden import value


def test_bracketed(spark):
    terms = F.array(F.lit("Tlatelolco"), F.lit("Santiago Tlatelolco"), F.lit("no.(x"))
    assert value(spark, planning.bracketed(F.col("t"), terms), t="en santiago tlatelolco no.(x") == "en [santiago [tlatelolco]] [no.(x]"


def test_patch_operations(spark):
    page = "Capítulo Tlatelolco\n\nEl señor de Tlate-\nlolco vino. Nada aquí. " + "palabra " * 30 + ". Fin de Tlatelolco. " + "Otra cosa " * 8 + "\n--- FOOTNOTES ---\nNota sobre Tlatelolco larga con bastantes palabras para no ser título."
    rows = planning.patch_operations(spark.createDataFrame([(1, page)], "page int, text string"), ["page"], "text", ["tlatelolco"]).orderBy("op_index").collect()
    assert [r.op_index for r in rows] == list(range(len(rows)))
    assert rows[0].sentence.startswith("Capítulo Tlatelolco") and "vino." in rows[0].sentence
    assert any(r.sentence == "Fin de Tlatelolco." for r in rows)
    assert [r.section for r in rows][-1] == "footnotes" and all("[Tlatelolco]" in r.bracketed for r in rows)


def test_sample_pages(spark):
    short = value(spark, planning.sample_pages(F.expr("array(3, 1, 2)")))
    assert short == [1, 2, 3]
    long = value(spark, planning.sample_pages(F.expr("sequence(1, 100)")))
    assert long == [8, 9, 23, 24, 34, 68, 93]


def test_detection(spark):
    blob = json.dumps({"language": "Spanish 70%, Nahuatl 30%", "script": "latin", "direction": "rtl", "hard_terms": ["a", " ", "b"], "headers": True, "avg_words_per_page": "x"})
    p = value(spark, profiles.detection(F.col("t")), t=blob)
    assert (p.direction, p.seed_terms, p.headers, p.avg_words_per_page) == ("ltr", ["a", "b"], True, 0)
    shares = F.expr("array(named_struct('language','nahuatl','share',0.3d), named_struct('language','spanish','share',0.7d), named_struct('language','korean','share',0.05d))")
    assert value(spark, profiles.rule_languages(shares)) == ["spanish", "nahuatl"]
    assert value(spark, profiles.primary_language(shares)) == "spanish"
    true, none = F.lit(True), F.lit(None).cast("boolean")
    assert value(spark, profiles.unify_marks(shares, true, none, none)) is False
    assert value(spark, profiles.unify_marks(F.slice(shares, 2, 1), none, none, true)) is True


def test_reader_words(spark):
    w = value(spark, profiles.reader_words(F.col("t")), t='{"words": [{"text": " a ", "confidence": 140}, {"text": ""}, {"text": "b", "bbox": [1, 2, 3, 4], "line_id": 7}]}')
    assert [(x.text, x.confidence, x.bbox, x.line_id) for x in w] == [("a", 100.0, [0, 0, 0, 0], 0), ("b", 70.0, [1, 2, 3, 4], 7)]
    assert [(x.text, x.line_id) for x in value(spark, profiles.reader_words(F.col("t")), t="a b\nc")] == [("a", 0), ("b", 0), ("c", 1)]


def test_disagreement_medians(spark):
    df = spark.createDataFrame([(1, "a", "b", 0.5), (1, "a", "c", 0.92), (1, "a", "d", 0.97), (1, "a", "e", 0.99), (1, "x", " x ", 1.0), (1, "[Skipped: a]", "[Skipped: b]", 0.1)], "k int, a string, b string, r double")
    r = reports.disagreement(df, ["k"], "a", "b", F.col("r")).first()
    assert (r.skipped, r.agree, r.disagree, r.percent, r.median_ratio, r.below_95, r.below_90) == (1, 1, 4, 80.0, 0.97, 2, 1)
