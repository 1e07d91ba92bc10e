"""Transcripts, timelines and frame search."""

import pytest
from pyspark.sql import functions as F

from rubrica.functions import speech, timeline
from rubrica.functions import text as T
from rubrica.operators import frames


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_transcripts(spark):
    assert one(spark, speech.without_tags(F.lit("<|en|> Hello , you !"), F.lit("en"))) == "Hello, you!"
    assert one(spark, speech.without_tags(F.lit("你 好"), F.lit("zh"))) == "你好"
    assert one(spark, speech.basic(F.lit("Hé [noise] (laughs) said: OK-ay!"))) == "hé said ok ay"
    assert one(spark, speech.basic(F.lit("Straße é"), diacritics=False)) == "strasse e"
    assert one(spark, speech.english(F.lit("Um, I won't pay $1,000.50; it's fine."))) == "i will not pay $1000.50 it is fine"
    assert one(spark, F.size(speech.units(F.lit("你好 吗"), F.lit("zh")))) == 3


@pytest.mark.parametrize(
    ("said", "form"),
    [
        ("twenty one, the twenty first and one oh one", "21 the 21st and 101"),
        ("nineteen sixty five; the nineteen sixties; ten five", "1965 the 1960s 105"),
        ("two hundred and five people and so on", "205 people and so on"),
        ("five dollars and seven cents, twenty million euros", "$5.07 €20000000"),
        ("one point five million or two and a half", "1500000 or 2.5"),
        ("double five three and zero point five, minus ten", "553 and 0.5 -10"),
        ("fifty per cent, 10 percent, 1960s and 274th", "50% 10% 1960s and 274th"),
        ("one of the ones", "one of the ones"),
        ("He'd been there, Mr. Smith's got it; you 're [noise] late (laughs)", "he had been there mister smith has got it you are late"),
        ("The colour of the theatre, organised travelling", "the color of the theater organized traveling"),
        ("Otherwise advertise a naïve surprise", "otherwise advertise a naive surprise"),
        ("", ""),
    ],
)
def test_english_transcripts(said, form):
    assert speech.english_form(said) == form
    assert speech.english_form(form) == form or "$" in form or "-" in form


@pytest.mark.parametrize(
    ("said", "form"),
    [("2023年5月10日, 1,205.5元。", "二零二三年五月十日一千二百零五点五元"), ("50% 的 人，3/4", "百分之五十的人四分之三"), ("10086 100000 10010", "一万零八十六十万一万零一十"), ("电话13812345678", "电话一三八一二三四五六七八"), ("-3 1000001", "负三一百万零一")],
)
def test_chinese_transcripts(said, form):
    assert speech.chinese_form(said) == form


def test_normalisers_keep_nulls(spark):
    df = spark.createDataFrame([("Ten",), (None,), ("",)], "t string")
    got = df.select(speech.english(F.col("t")).alias("e"), speech.basic(F.col("t")).alias("b"), speech.chinese(F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("10", "ten", "ten"), (None, None, None), ("", "", "")]


def test_tags_and_topics(spark):
    s = " the man [t=1.5 s] runs [low confidence]  [t = 2→3 s]"
    tidy = one(spark, timeline.low_tag(F.lit(s)))
    assert tidy == "[LOW] the man runs [t = 2→3 s]"
    assert one(spark, timeline.low_tag(F.lit(tidy))) == tidy
    assert one(spark, timeline.topic_key(F.lit("A  Man [phase=2] Runs [t=1→2 s]"))) == "a man runs"
    a = one(spark, timeline.anchors(F.lit("x [t=5→2 s]"), F.lit(0.0), F.lit(9.0)))
    assert (a.t_start, a.t_end, a.p_min) == (2.0, 5.0, None)
    a = one(spark, timeline.anchors(F.lit("x [phase=3]"), F.lit(0.0), F.lit(9.0)))
    assert (a.t_start, a.t_end, a.p_min, a.p_max) == (0.0, 9.0, 3, 3)


def test_sections_and_pairs(spark):
    tagged = "```x\n<<<BEGIN_FRAMES>>> f <<<END_FRAMES>>><<<BEGIN_KNOWN_INFO_UPDATE>>>k<<<END_KNOWN_INFO_UPDATE>>><<<BEGIN_STATS>>>s<<<END_STATS>>>\n```"
    assert tuple(one(spark, timeline.sections(F.lit(tagged)))) == ("f", "k", "s")
    assert tuple(one(spark, timeline.sections(F.lit("# frames\nf\n# KNOWN_INFO_UPDATE k # stats s")))) == ("f", "k", "s")
    assert tuple(one(spark, timeline.sections(F.lit("nothing")))) == (None, None, None)
    text = "id: 1-2\nreasoning: both\nid: 2\nreason: again\nframe: 7\nalone"
    pairs = one(spark, timeline.id_reasons(F.lit(text)))
    assert [(p.id, p.reason) for p in pairs] == [(1, "both"), (2, "both"), (7, "alone")]
    shifted = one(spark, timeline.aligned(timeline.id_reasons(F.lit("id: 1\na\nid: 2\nb")), F.array(F.lit(11), F.lit(12)).cast("array<bigint>")))
    assert [(p.id, p.reason) for p in shifted] == [(11, "a"), (12, "b")]
    ordered = one(spark, timeline.aligned(timeline.id_reasons(F.lit("id: 1\na\nid: 5\nb")), F.array(F.lit(11), F.lit(12)).cast("array<bigint>")))
    assert [p.id for p in ordered] == [11, 12]


def test_brackets(spark):
    found = one(spark, timeline.brackets(F.lit("a [t = 3 → 1.5 s] b [PHASE=2] [LOW, t=4 s] [note] [t=soon s]")))
    assert [(b.kind, b.low, b.high) for b in found] == [("t", 1.5, 3.0), ("phase", 2.0, 2.0), ("low", 4.0, 4.0), ("", None, None), ("vague", None, None)]
    assert one(spark, timeline.topic_key(F.lit("A [note] man [t=soon s] Runs"))) == "a [note] man runs"
    assert one(spark, timeline.low_tag(F.lit("[LOW] a [LOW, t=4 s] b"))) == "[LOW] a b"
    bullets = one(spark, timeline.bullet_list(F.lit("Known:\n- a [t=1 s]\n * b\n2. c\n- d")))
    assert bullets == ["a [t=1 s]", "b", "c", "d"]
    assert one(spark, timeline.anchored(timeline.bullet_list(F.lit("- a [t=1 s]\n- b")), F.lit(0.0), F.lit(4.0))) == ["a [t=1 s]", "b [t=0.00→4.00 s]"]
    assert tuple(one(spark, timeline.stats(F.lit("FRAME_COUNT_EMITTED: 8\nWINDOW_SPAN_ECHO: [ 0-4 ]")))) == (8, "0-4")
    assert tuple(one(spark, timeline.stats(F.lit("none")))) == (None, None)


def test_four_levels_of_frame_reasons(spark):
    want = F.array(F.lit(11), F.lit(12))
    for text, level, pairs in (
        ("id: 11\nreasoning: a\nid: 12\nreasoning: b", 1, [(11, "a"), (12, "b")]),
        ("id: 1\nreasoning: a\nid: 2\nreasoning: b", 2, [(11, "a"), (12, "b")]),
        ("id: 1\nreasoning: a\nid: 5\nreasoning: b", 3, [(11, "a"), (12, "b")]),
        ("Well:\nframe #12 - reason: it turns\n[99] x", 4, [(12, "it turns")]),
        ("nothing at all", 0, []),
    ):
        got = one(spark, timeline.frame_reasons(F.lit(text), want))
        assert (got.level, [(p.id, p.reason) for p in got.pairs]) == (level, pairs), text


def test_frame_search(spark):
    rows = [("v", i, [1.0, float(i)], float(i % 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "video_id string, frame_index int, embedding array<double>, score double")
    best = frames.selected_frames(df, 3, F.lit(2.0)).first()
    assert (best.indices, best.frame_time) == ([2, 5, 8], "1.00s,2.50s,4.00s")
    q = spark.createDataFrame([("v", [0.0, 1.0])], "video_id string, embedding array<double>")
    near = frames.caption_similarity(df.drop("score"), q, 2).orderBy("rank").collect()
    assert [r.frame_index for r in near] == [9, 8]
    b = spark.createDataFrame([("v", 0, 0, "A man [t=1 s]", 0.0, 4.0), ("v", 1, 0, "a man [t=3→5 s]", 4.0, 8.0), ("v", 1, 1, "dog", 4.0, 8.0)], "video_id string, window int, pos int, bullet string, start double, end double")
    state = frames.known_info(b)
    man = state.where("topic = 'a man' and window = 1").first()
    assert (man.t_start, man.t_end, man.seen) == (1.0, 5.0, 2)
    assert [(r.topic, r.anchor) for r in frames.known_summary(state).orderBy("rank").collect()] == [("a man", "[t=1.00→5.00 s]"), ("dog", "[t=4.00→8.00 s]")]
    done = df.where("frame_index < 4").select("frame_index", F.lit("old").alias("c"))
    staged = frames.resumed(df.select("frame_index"), done, ["frame_index"], lambda x: x.select("frame_index", F.lit("new").alias("c")))
    assert staged.where("c = 'new'").count() == 6 and staged.count() == 10
    numbered = frames.with_new_ids(spark.range(100, 120).select(F.col("id").alias("k")).repartition(3), spark.range(5).select("id"), ["k"])
    assert [r.id for r in numbered.orderBy("k").collect()] == list(range(5, 25))


def test_more_scores(spark):
    a, b = F.split(F.lit("a b c"), " "), F.split(F.lit("a x c d"), " ")
    assert round(one(spark, T.sentence_bleu1(a, b)), 6) == round(2 / 3 * 2.718281828459045 ** (1 - 4 / 3), 6)
    assert one(spark, T.gleu(a, a)) == 1.0 and one(spark, T.positional_match(a, b)) == 0.5
    assert one(spark, T.angle_error(F.lit(350.0), F.lit(10.0))) == 20.0
    assert one(spark, T.map_match(F.create_map(F.lit("k"), F.lit(1)), F.create_map(F.lit("k"), F.lit(1), F.lit("z"), F.lit(2)))) == 0.5
    assert one(spark, T.squared_error(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(4.0)))) == 2.0
