"""Cases with known answers."""

import difflib

import pytest
from pyspark.sql import functions as F

from quire.functions import text, udfs
from quire.operators import consensus, layout, ledger, pages, patches, quality, reconcile, terms


def value(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("ver nota<sup>1</sup> aquí", "ver nota¹ aquí"),
        ("capítulo N^o 5", "capítulo Nº 5"),
        ("ref^12 al pie", "ref¹² al pie"),
        ("rresçebimiº", "rresçebimiᵒ"),
        ("Nº 5", "Nº 5"),
        ("x <SUP> a\n</SUP> q<sup>qb</sup> 3 ^7", "x ª qqᵇ 3 ⁷"),
        ("plain", "plain"),
    ],
)
def test_notation(spark, given, expected):
    assert value(spark, text.notation_tier1(F.col("t")), t=given) == expected


def test_macrons_and_abbreviations(spark):
    assert value(spark, udfs.unify_macron(F.col("t")), t="vocālis ēcho") == "vocãlis ẽcho"
    assert value(spark, udfs.combining_macrons(F.col("t")), t="q̄ā x") == 2
    assert value(spark, text.abbreviations_tier2(F.col("t")), t="N.o 5, noche, mano, S.ra, Sr. M.a") == "Nº 5, noche, mano, Sra., Sr. Mª"
    assert value(spark, text.abbreviations_tier2(F.col("t"), strict=False), t="noche") == "Nºche"


def test_reconcile_only_for_content(spark):
    for a, b, expected in [("a  b", "a b", False), ("linea", "línea", True), (" x ", "x", False), ("N^o 5", "Nº 5", False), ("nota<sup>1</sup>", "nota¹", False)]:
        assert value(spark, reconcile.needs_reconcile(F.col("a"), F.col("b")), a=a, b=b) is expected


def test_fourth_reading(spark):
    for p4, winner, review in [("alpha", "run1", False), ("beta", "run2", False), ("gamma", "reconcile", False), ("delta", "run1", True)]:
        r = value(spark, reconcile.resolve_fourth(F.lit("alpha"), F.lit("beta"), F.lit("gamma"), F.col("p")), p=p4)
        assert (r["winner"], r["review"]) == (winner, review)


def test_uncertain_note(spark):
    r = value(spark, text.reconcile_output(F.col("t")), t="body line\nUNCERTAIN: faded ink on name")
    assert (r["body"], r["uncertain"], r["note"]) == ("body line", True, "faded ink on name")


def test_numbered_answers(spark):
    original = F.array(F.lit("uno"), F.lit("dos"), F.lit("tres"))
    for answer, expected in [
        ("1: A\n2: B\n3: C", ["A", "B", "C"]),
        ("3) C\n1) A\n2) B", ["A", "B", "C"]),
        ("1: A\n3: C", ["A", "dos", "C"]),
        ("garbage", ["uno", "dos", "tres"]),
        ("1: A\n  goes on\n2: B", ["A goes on", "B", "tres"]),
        ("1: A\n1: Z\n2:", ["A", "dos", "tres"]),
        ("1. A\n2. B\n99. X", ["A", "B", "tres"]),
    ]:
        assert value(spark, patches.numbered_answers(F.col("a"), original), a=answer) == expected


@pytest.mark.parametrize(
    ("original", "returned", "impossible", "terms_", "reason"),
    [
        ("El señor de Tlatelolco", "", [], [], "empty_response"),
        ("El señor de Tlatelolco", "Here is the text", [], [], "chatter"),
        ("El señor de Tlatelolco", "El señor de TIatelolco", ["tiatelolco"], [], "impossible_string"),
        ("dijo tiatelolco", "dijo Tlatelolco [sic]", ["tiatelolco"], [], "impossible_string"),
        ("a *b* c", "a b c", [], [], "emphasis_markers"),
        ("a  b", "a b", [], [], "unchanged"),
        ("El señor de Tlatelolco", "El señor de México", [], ["Tlatelolco"], "missing_hard_term"),
        ("El senor de Tlatelolco", "El señor de [Tlatelolco]", [], ["Tlatelolco"], None),
    ],
)
def test_patch_reasons(spark, original, returned, impossible, terms_, reason):
    t = F.array(*[F.lit(x) for x in terms_]) if terms_ else F.array().cast("array<string>")
    assert value(spark, patches.reject_reason(F.col("o"), F.col("r"), impossible, t), o=original, r=returned) == reason


def test_spelling_variants(spark):
    assert value(spark, text.term_present(F.lit("Cuauhtlatoatzin"), F.col("t"), variants=True), t="dijo Quauhtlatoatzin luego") is True
    assert value(spark, text.term_present(F.lit("Cuauhtlatoatzin"), F.col("t")), t="dijo Quauhtlatoatzin luego") is False


def test_overlapping_patches(spark):
    p = F.expr("array(named_struct('start', 0, 'end', 3, 'new', 'XX'), named_struct('start', 2, 'end', 5, 'new', 'YY'), named_struct('start', 6, 'end', 7, 'new', 'Z'))")
    assert value(spark, patches.apply_patches(F.col("t"), p), t="abcdefgh") == "abYYfZh"


def test_brackets_across_pages(spark):
    rows = [(1, 1, "Texto previo [de edifi-"), (1, 2, "car] continúa aquí."), (2, 1, "car] sin apertura"), (3, 1, "termina con [abierto"), (4, 1, "a [b-"), (4, 2, "mid"), (4, 3, "c] d [e-"), (4, 4, "f] g")]
    df = spark.createDataFrame(rows, "book int, page int, text string")
    joined = {(r.book, r.page): r.text for r in pages.rejoin(df, "book", "page", "text").collect()}
    assert joined[1, 1] == "Texto previo [de edificar]" and joined[1, 2].strip() == "continúa aquí."
    assert joined[4, 1] == "a [bc]" and joined[4, 3].strip() == "d [e-" and joined[4, 4] == "f] g"
    n = pages.with_neighbours(df, "book", "page", "text")
    flagged = {(r.book, r.page) for r in n.filter(pages.needs_bracket_review(F.col("text"), F.col("prev_body"), F.col("next_body"))).collect()}
    assert (2, 1) in flagged and (3, 1) in flagged and (1, 1) not in flagged and (1, 2) not in flagged
    assert {(r.book, r.page, r.partner) for r in pages.bracket_partner(df, "book", "page", "text").collect()} == {(1, 1, 2), (4, 1, 3), (4, 3, 4)}


def test_parse_keeps_the_last_of_equal_pages(spark):
    df = spark.createDataFrame([("b", "intro\n--- Page 1 ---\nold\n--- Page 2 ---\ntwo\n\n--- Page 1 ---  \nnew\n")], "book string, text string")
    assert {r.page: r.text for r in pages.parse(df, "book", "text").collect()} == {0: "intro", 1: "new", 2: "two"}


def test_page_lists(spark):
    assert value(spark, pages.page_list(F.col("t")), t="13,45,60-62, 13,9-7") == [13, 45, 60, 61, 62]
    assert value(spark, pages.page_range(F.lit(500), F.lit(12), F.lit(10))) == list(range(13, 23))
    assert value(spark, pages.page_range(F.lit(10), F.lit(12), F.lit(None).cast("int"))) == []


def flags_of(spark, readings, confidences):
    df = spark.createDataFrame([(1, *readings)], "doc int, A string, B string, C string")
    of = dict(zip("ABC", confidences, strict=True))
    judged = consensus.judged(consensus.aligned_tokens(df, ["A", "B", "C"]), ["A", "B", "C"], lambda t, r: F.lit(of[r]))
    return consensus.flags(judged, ["doc"], ["A", "B", "C"]).collect()


def test_consensus(spark):
    assert [f.reason for f in flags_of(spark, ("palabra", "paiabra", "palabra"), (99.0, 99.0, 99.0))] == ["engine_disagreement"]
    assert [f.reason for f in flags_of(spark, ("palabra",) * 3, (60.0, 62.0, 59.0))] == ["low_confidence"]
    assert flags_of(spark, ("", "", ""), (0.0, 0.0, 0.0)) == []
    f = flags_of(spark, ("a b\nc", "a x\nc d", "a b\nc"), (99.0, 99.0, 99.0))
    assert [(x.span_id, x.line_index, x.word_index, x.char_start, x.char_end, x.text) for x in f] == [("flag_00001", 0, 1, 2, 3, "b"), ("flag_00002", 1, 1, 2, 3, "?")]


def test_confidence_by_token_text(spark):
    words = F.expr("array(named_struct('text','a','confidence',10d,'bbox',array(5,0,6,1),'line_id',0), named_struct('text','a','confidence',90d,'bbox',array(9,0,10,1),'line_id',0))")
    assert value(spark, consensus.confidence_of_words(words, F.lit(0), F.lit("a"))) == 90.0
    assert value(spark, consensus.confidence_of_words(words, F.lit(1), F.lit("a"))) == 0.0


def test_credits(spark):
    a = spark.createDataFrame([("L", "k", 1, 10, 1), ("L", "k", 2, 10, 1), ("L", "j", 3, 10, 20), ("L", "j", 4, 10, 9)], "licence string, key string, n int, total int, cost int")
    r = ledger.commit_variable(a, "licence", "key", "n", "total", "cost").first()
    assert (r.committed, r.duplicates, r.insufficient, r.remaining) == (2, 1, 1, 0)
    unit = ledger.commit_unit(a.withColumn("total", F.lit(1)), "licence", "key", "n", "total").orderBy("n").collect()
    assert [x.outcome for x in unit] == ["committed", "duplicate", "insufficient", "insufficient"]


def test_sections(spark):
    cases = {
        "PRESENTACIÓN\nEste volumen": "editorial_spanish",
        "En este trabajo la biblioteca de la universidad": "editorial_spanish",
        "[Nican moteneu] [xiuhmolpilli] Ācatl": "paleographic_nahuatl",
        "[Nican moteneu] in tlahtoani Ācatl": "paleographic_nahuatl",
        "como que los señores venido": "spanish_translation",
        "traducción del texto": "spanish_translation",
        "[abcd] algo": "mixed",
        "[Skipped: blank page]": "skipped",
        "": "skipped",
    }
    for t, expected in cases.items():
        assert value(spark, quality.section(F.col("t")), t=t) == expected, t


def test_language_shares(spark):
    shares = lambda t: {r["language"]: r["share"] for r in value(spark, quality.language_shares(F.col("t")), t=t)}
    assert shares("Spanish 60%, Classical Nahuatl 40%") == {"spanish": 0.6, "nahuatl": 0.4}
    assert shares("Spanish, Nahuatl; Korean") == {"spanish": 0.333333, "nahuatl": 0.333333, "korean": 0.333333}
    assert shares("Spanish 50%") == {"spanish": 0.5}
    assert shares("Colonial Spanish 50%, Castilian 20%") == {"spanish": 0.7}
    assert value(spark, text.language_key(F.col("t")), t="") == "spanish"
    assert value(spark, text.language_key(F.col("t")), t="klingon") is None


def test_ids_and_names(spark):
    ids = lambda t: tuple(value(spark, text.batch_id(F.col("t")), t=t) or ())
    assert ids("r2_p0013") == ("transcribe", 2, 13) and ids("rec_p7") == ("reconcile", 0, 7) and ids("spotpg_p0003_2") == ("spotpg", 2, 3)
    assert ids("p4_p9") == ("pass4", 0, 9) and ids("spot_p5") == ("spot", 0, 5) and ids("bad") == ()
    assert value(spark, text.slug(F.col("t")), t="  El Códice (1)! ") == "el_c_dice_1"
    assert value(spark, text.slug(F.col("t")), t="¡!") == "unknown"
    assert value(spark, text.direction(F.col("t")), t="Right-to-left") == "rtl"
    assert value(spark, text.script_name(F.col("t")), t="Hangul") == "korean"
    assert value(spark, text.first_integer(F.col("t"), 5), t="pack of 40 credits") == 40
    assert value(spark, text.first_integer(F.col("t"), 5), t="none") == 5


def test_lines(spark):
    fold = lambda t: value(spark, text.fold_lines(F.col("t")), t=t)
    assert fold("uno dos-\ntres\ncuatro.\ncinco") == "uno dostres cuatro.\ncinco"
    assert fold("a\n- b\nc") == "a - b c"
    assert fold("- b\nc\n\nd") == "- b\nc\n\nd"
    assert fold("   ") == "   "
    assert value(spark, text.logical_text(F.col("t")), t="la Cuauh-\ntitlan dijo\nasí\n\notro") == "la Cuauhtitlan dijo así\n\notro"
    spans = value(spark, text.sentence_spans(F.col("t")), t="Uno. Dos; Tres! cuatro. cinco")
    assert [(s["start"], s["end"]) for s in spans] == [(0, 4), (5, 9), (10, 29)]


def test_json_and_ratio(spark):
    for t, expected in [('```json\n{"a": 1}\n```', '{"a":1}'), ('Sure [1] then {"b": [2]} ok', '{"b":[2]}'), ("[1, 2] tail", "[1,2]"), ("none", None), (None, None)]:
        assert spark.createDataFrame([(t,)], "t string").select(udfs.json_blob("t")).first()[0] == expected
    a, b = "el senor dixo luego", "el señor dijo luego a"
    assert value(spark, udfs.sequence_ratio(F.lit(a), F.lit(b))) == difflib.SequenceMatcher(None, a, b).ratio()


def test_boxes(spark):
    boxes = F.array(*[F.array(*[F.lit(x) for x in b]) for b in [(0, 0, 10, 10), (1, 1, 11, 11), (8, 8, 30, 30), (100, 100, 110, 110)]])
    assert value(spark, layout.merge_boxes(boxes)) == [[0, 0, 11, 11], [8, 8, 30, 30], [100, 100, 110, 110]]
    words = F.expr("array(named_struct('text','b','confidence',1d,'bbox',array(9,0,10,4),'line_id',0), named_struct('text','a','confidence',1d,'bbox',array(1,0,2,4),'line_id',0), named_struct('text','n1','confidence',1d,'bbox',array(1,90,2,96),'line_id',5), named_struct('text','n2','confidence',1d,'bbox',array(4,90,5,96),'line_id',5))")
    page = value(spark, layout.compose_page(words, F.array(F.array(*[F.lit(x) for x in (0, 40, 9, 60)])), F.lit(100)))
    assert page == "a b\n\n[IMAGE]\n\n--- FOOTNOTE ---\n\nn1 n2\n\n--- END FOOTNOTE ---"


def test_merge_terms(spark):
    df = spark.createDataFrame([("Hunyg", 1), ("Atitlan", 2), ("atitlan", 3), ("Tz'utujil", 4)], "term string, ord int")
    assert [r.term for r in terms.merge_keep_first(df).orderBy("ord").collect()] == ["Hunyg", "Atitlan", "Tz'utujil"]


def test_flag_table_and_review_list(spark, tmp_path):
    """Eleven columns, defaults for missing readings, quoting of texts as in a list for people."""
    from quire.operators import exports
    from quire.sources import files

    rows = [("flag_00001", 0, 2, 4, 9, "señor", "engine_disagreement", "señor", None, "it's", 90.5, None, 0.0), ("flag_00002", 1, 0, 0, 1, "?", "low_confidence", "a\\b", "", 'q"\'', 10.0, 0.0, 70.0)]
    flags = spark.createDataFrame(rows, "span_id string, line_index int, word_index int, char_start int, char_end int, text string, reason string, A string, B string, C string, A_conf double, B_conf double, C_conf double")
    files.flags_csv(flags.coalesce(1), str(tmp_path / "flags"))
    lines = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "flags").glob("part-*.csv")).splitlines()
    assert lines[0] == "span_id,line_index,word_index,text,reason,A,B,C,A_conf,B_conf,C_conf"
    assert lines[1].replace('""', "") == "flag_00001,0,2,señor,engine_disagreement,señor,,it's,90.5,0.0,0.0"
    listed = exports.review_list(flags.withColumn("page", F.lit(1)), ["page"], ["A", "B", "C"]).first().text
    assert listed == "# Flagged spans requiring human review\n\n- [flag_00001] line 1: `señor` (engine_disagreement)\n  engines: A='señor', C=\"it's\"\n- [flag_00002] line 2: `?` (low_confidence)\n  engines: A='a\\\\b', C='q\"\\''"


def test_pilot_pages_take_tags_in_turn(spark):
    """A page that stands for one tag doesn't stand for another: the next page with it does."""
    from quire.operators import planning

    pages_ = [(1, 1, "Of term:\nthe term is bro-\nken here"), (1, 2, "nothing at all"), (1, 3, "About a term:\nmore"), (1, 4, "a term in a line")]
    df = spark.createDataFrame(pages_, "book int, page int, text string")
    got = {r.page: r.why for r in planning.pilot_pages(df, "book", "page", "text", ["term"], 20).collect()}
    assert got == {1: "hyphen_break", 2: "any", 3: "chapter_heading", 4: "term"}
    assert {r.page for r in planning.pilot_pages(df, "book", "page", "text", ["term"], 2).collect()} == {1, 3}


def test_cjk_sentences(spark):
    from quire.operators import documents

    spans = lambda t: [tuple(x) for x in value(spark, documents.cjk_sentence_spans(F.lit(t)))]
    assert spans("今日は。明日、また！ end") == [(0, 4), (4, 7), (7, 10), (10, 14)]
    assert spans("  ") == [] and spans("no sign") == [(0, 7)]


def test_small_rules(spark):
    from quire.operators import documents, termlists

    assert value(spark, documents.draft({"B": F.lit("b"), "A": F.lit(None).cast("string")})) == "b"
    assert value(spark, documents.draft({"B": F.lit("b"), "A": F.lit("")})) == ""
    assert value(spark, documents.processing_mode(F.lit(None).cast("string"), F.lit(None).cast("int"))) == "batch"
    assert value(spark, termlists.sources_in(F.array(F.lit("c/hard_terms_auto_x.txt"), F.lit("hard_terms_auto_a.txt"), F.lit("other")), r"^hard_terms_auto_(.+)\.txt$", "d")) == ["a", "x"]
    assert value(spark, termlists.sources_in(F.array(F.lit("other")), r"^hard_terms_auto_(.+)\.txt$", "d")) == ["d"]
    before, after = (spark.createDataFrame([(t,) for t in x], "term string") for x in (["a"], ["a", "b", "b"]))
    assert [r.term for r in termlists.new_promotions(before, after).collect()] == ["b"]
    rows = spark.createDataFrame([("k", 3, 9, None, None)], "license_key string, remaining_credits long, total_credits long, email string, product_id string")
    assert tuple(documents.licence(rows, "k").first()) == ("k", 3, 9, "", "") and documents.licence(rows, "x").count() == 0
    readings = spark.createDataFrame([(1, 1, "[Nican moteneu] [xiuhmolpilli] Ācatl"), (1, 2, "como que los"), (2, 1, "[Skipped: blank page]"), (2, 2, "text")], "page int, run int, text string")
    assert {(r.page, r.run): r.section for r in documents.page_results(readings, ["page"]).collect()} == {(1, 1): "paleographic_nahuatl", (1, 2): "paleographic_nahuatl", (2, 1): None, (2, 2): "skipped"}
