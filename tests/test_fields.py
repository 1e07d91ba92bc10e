"""Hand-computed cases of field scores, and the best window against all windows."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from rubrica.functions import fields


def arr(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


POINT = "here: <point>0.3, 0.5</point>"


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: fields.tagged_numbers(F.lit("a <point> 0.25, 1 </point> b"), "point", 2), [0.25, 1.0]),
        (lambda: fields.tagged_numbers(F.lit("<point>0.25</point>"), "point", 2), None),
        (lambda: fields.tagged_numbers(F.lit("<point>0.2, 1.5</point>"), "point", 2), None),
        (lambda: fields.tagged_numbers(F.lit("no point"), "point", 2), None),
        (lambda: fields.point_closeness(fields.tagged_numbers(F.lit(POINT), "point", 2), arr(0.3, 0.1)), 0.6),
        (lambda: fields.point_closeness(fields.tagged_numbers(F.lit(""), "point", 2), arr(0.3, 0.1)), 0.0),
        (lambda: fields.point_in_box(fields.tagged_numbers(F.lit(POINT), "point", 2), arr(0.0, 0.0, 0.3, 0.5)), 1.0),
        (lambda: fields.point_in_box(fields.tagged_numbers(F.lit(POINT), "point", 2), arr(0.0, 0.0, 0.2, 0.5)), 0.0),
        (lambda: fields.track_iou(F.array(arr(0.0, 0.0, 2.0, 2.0), arr(0.0, 0.0, 1.0, 1.0)), F.array(arr(1.0, 1.0, 3.0, 3.0), arr(0.0, 0.0, 1.0, 1.0))), (1 / 7 + 1) / 2),
        (lambda: fields.track_iou(F.array(arr(0.0, 0.0, 1.0, 1.0)), F.array(arr(0.0, 0.0, 1.0, 1.0), arr(0.0, 0.0, 1.0, 1.0))), 0.0),
        (lambda: fields.positive_int(F.lit(" 12"), F.lit("12")), 1),
        (lambda: fields.positive_int(F.lit("12.0"), F.lit("12")), 0),
        (lambda: fields.positive_int(F.lit("0"), F.lit("-3")), -1),
        (lambda: fields.positive_int(F.lit("4"), F.lit("0")), 0),
        (lambda: fields.positive_int(F.lit(None).cast("string"), F.lit("1")), 0),
        (lambda: fields.phrase_match(F.lit(" Red Fox"), arr("dog", "red fox ")), 1.0),
        (lambda: fields.phrase_match(F.lit("fox"), arr("red fox")), 0.0),
        (lambda: fields.items(F.lit("a, b,, c "), ","), ["a", "b", "c"]),
        (lambda: fields.set_equal(arr("a", "B", "a"), arr("b", "A"), ignore_case=True), 1.0),
        (lambda: fields.set_equal(arr("a", "B"), arr("b", "a")), 0.0),
        (lambda: fields.map_precision(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("3"))), 0.5),
        (lambda: fields.map_jaccard(F.create_map(F.lit("a"), arr("x", "y")), F.create_map(F.lit("a"), arr("x"), F.lit("b"), arr("z"))), 0.25),
        (lambda: fields.rouge_n(arr("a", "b", "a", "b"), arr("a", "b"), 2), 0.5),
        (lambda: fields.rouge_n(arr("a"), arr("a", "b"), 2), 0.0),
        (lambda: fields.window_scores(arr("x", "the", "old", "mill", "y"), arr("the", "old", "mill"))["exact_match"], 1.0),
        (lambda: fields.window_scores(arr("x", "the", "cold", "mill", "y"), arr("the", "old", "mill"))["jaccard"], 0.5),
        (lambda: fields.window_scores(arr("the"), arr("the", "old"))["f1"], 0.0),
        (lambda: fields.window_scores(arr(), arr("the"))["similarity"], 0.0),
    ],
)
def test_fields(spark, column, want):
    got = value(spark, column())
    assert got == pytest.approx(want) if isinstance(want, (float, list)) else got == want


def test_best_window_is_the_best_of_all_windows(spark):
    r = random.Random(5)
    words = ["mill", "miller", "old", "older", "town", "towns", "by", "river"]
    rows = [([r.choice(words) for _ in range(r.randint(0, 12))], [r.choice(words) for _ in range(r.randint(1, 4))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "p array<string>, g array<string>")
    got = df.select("p", "g", fields.best_window("p", "g", F.lit(" ")).alias("w")).collect()
    for x in got:
        windows = [x.p[i : i + len(x.g)] for i in range(len(x.p) - len(x.g) + 1)]
        ratios = [difflib.SequenceMatcher(None, " ".join(w), " ".join(x.g)).ratio() if set(w) & set(x.g) else 0.0 for w in windows]
        best = max(ratios, default=0.0)
        assert x.w.similarity == pytest.approx(best)
        assert x.w.start == (ratios.index(best) + 1 if best else 0)
