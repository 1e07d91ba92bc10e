"""Scores of single answer fields: tagged points and boxes, box tracks, whole numbers, phrases, sets, maps of sets, best windows."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from rubrica.functions import geometry
from rubrica.functions import text as T


def tagged_numbers(c: Column, tag: str, n: int) -> Column:
    """The n numbers of the first <tag>a, b, ...</tag>; null if there aren't n, or one is not within 0 to 1."""
    inner = F.regexp_extract(c, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    values = F.transform(F.split(inner, ","), lambda x: T.number(F.regexp_replace(x, "%", "")))
    return F.when((F.size(values) == n) & F.forall(values, lambda v: F.coalesce(v.between(0, 1), F.lit(False))), values)


def point_closeness(pred: Column, gold: Column) -> Column:
    """1 - the distance of two points [x, y], not under 0; 0 where a point is missing."""
    near = T.let(lambda p, g: 1 - geometry.point_distance(p[0], p[1], g[0], g[1]), pred, gold)
    return F.greatest(F.lit(0.0), F.coalesce(near, F.lit(0.0)))


def point_in_box(pred: Column, gold: Column) -> Column:
    """1.0 if the point lies in the box, its border included; 0 where either is missing."""
    inside = T.let(lambda p, g: p[0].between(g[0], g[2]) & p[1].between(g[1], g[3]), pred, gold)
    return F.coalesce(inside, F.lit(False)).cast("double")


def track_iou(preds: Column, golds: Column) -> Column:
    """Mean overlap of boxes at the same place of two lists; 0 if their lengths differ, or without boxes."""
    pairs = F.zip_with(preds, golds, lambda p, g: F.coalesce(geometry.box_iou(p, g), F.lit(0.0)))
    mean = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(golds)
    return F.coalesce(F.when((F.size(preds) == F.size(golds)) & (F.size(golds) > 0), mean), F.lit(0.0))


def positive_int(pred: Column, gold: Column) -> Column:
    """1 if both texts are the same whole number, else 0; -1, which weighted means pass over, if neither is positive."""
    whole = lambda c: F.when(T.strip(c).rlike(r"^[+-]?\d+$"), T.strip(c).try_cast("long"))
    p, g = whole(pred), whole(gold)
    return F.when(p.isNull() | g.isNull(), 0).when((p <= 0) & (g <= 0), -1).otherwise((p == g).cast("int"))


def phrase_match(pred: Column, golds: Column) -> Column:
    """1.0 if the answer is one of the phrases, but for case and white space at the ends."""
    plain = lambda c: F.lower(T.strip(c))
    return F.coalesce(F.exists(golds, lambda g: plain(g) == plain(pred)), F.lit(False)).cast("double")


def items(c: Column, separator: str = ",") -> Column:
    """The stripped, non-empty items of a list written as text; a regular expression separates them."""
    return F.filter(F.transform(F.split(c, separator), T.strip), lambda x: x != "")


def set_equal(pred: Column, gold: Column, ignore_case: bool = False) -> Column:
    """1.0 if two arrays have the same elements, whatever their order and repeats."""
    same = lambda x: F.array_sort(F.array_distinct(F.transform(x, F.lower) if ignore_case else x))
    return (same(pred) == same(gold)).cast("double")


def map_precision(pred: Column, gold: Column) -> Column:
    """Share of a predicted map's entries that the target has; an empty prediction is right for an empty target alone."""
    entries = F.map_entries(pred)
    hits = F.size(F.filter(entries, lambda e: F.coalesce(F.element_at(gold, e["key"]) == e["value"], F.lit(False))))
    return F.when(F.size(entries) == 0, (F.size(gold) == 0).cast("double")).otherwise(hits / F.size(entries))


def map_jaccard(pred: Column, gold: Column) -> Column:
    """Mean Jaccard index of two maps of arrays over the keys of either; 1 without keys."""
    none = F.array().cast("array<string>")

    def mean(p: Column, g: Column, keys: Column) -> Column:
        one = lambda k: T.set_scores(F.coalesce(F.element_at(p, k), none), F.coalesce(F.element_at(g, k), none))["jaccard"]
        return F.when(F.size(keys) == 0, 1.0).otherwise(F.aggregate(F.transform(keys, one), F.lit(0.0), lambda s, x: s + x) / F.size(keys))

    return T.let(mean, pred, gold, F.array_union(F.map_keys(pred), F.map_keys(gold)))


def rouge_n(pred: Column, gold: Column, n: int) -> Column:
    """F of the n-grams that two token arrays share, with repeats; 0 if either has none."""
    a, b = T.ngrams(pred, n), T.ngrams(gold, n)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(T.f1(T.overlap(a, b), F.size(a), F.size(b)))


@F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("similarity", DoubleType())]))
def best_window(pred: pd.Series, gold: pd.Series, joint: pd.Series) -> pd.DataFrame:
    """Where the window of the target's length that is most like it begins in the prediction, from 1 (none: 0), and its block ratio.

    Windows that share no token with the target are passed over; of equally good ones the first is taken.
    """
    rows = []
    for p, g, by in zip(pred, gold, joint, strict=True):
        best = (0, 0.0)
        if p is not None and g is not None and len(g):
            p, g = list(p), list(g)
            wanted, matcher = set(g), difflib.SequenceMatcher(None)
            whole, n, shared = by.join(g), len(g), 0
            for i, w in enumerate(p):
                shared += (w in wanted) - (i >= n and p[i - n] in wanted)
                if i + 1 < n or not shared:
                    continue
                matcher.set_seqs(by.join(p[i + 1 - n : i + 1]), whole)
                if matcher.real_quick_ratio() > best[1] and matcher.quick_ratio() > best[1] and (r := matcher.ratio()) > best[1]:
                    best = (i + 2 - n, r)
        rows.append(best)
    return pd.DataFrame(rows, columns=["start", "similarity"])


def window_scores(pred: Column, gold: Column, joint: str = " ") -> dict[str, Column]:
    """similarity of the best window, and precision, recall, F1, Jaccard index and exact match of its tokens; all 0 without a window."""
    at = best_window(pred, gold, F.lit(joint))
    window = F.slice(pred, F.greatest(at["start"], F.lit(1)), F.size(gold))
    scores = T.set_scores(window, gold) | {"exact_match": (window == gold).cast("double")}
    return {"similarity": at["similarity"]} | {k: F.when(at["start"] > 0, v).otherwise(0.0) for k, v in scores.items()}
