"""Text comparison as Column expressions: normalisers, matches, distances, overlaps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation. Fixed values.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: First code point that stands for a token in token_distance(); the last is below the surrogates.
_FIRST, _LAST = 0x3400, 0xD7FF


def let(f: Callable[..., Column], *values: Column) -> Column:
    """f(values) with each value computed once a row.

    A column expression used inside a lambda is computed again for each
    element; bound to an outer lambda's variable, it is not.
    """
    bound = F.array(F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values))))
    return F.get(F.transform(bound, lambda s: f(*(s[f"v{i}"] for i in range(len(values))))), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends; Spark's trim() drops spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Stripped, lower case, one space for each run of white space."""
    return F.regexp_replace(F.lower(strip(c)), r"\s+", " ")


def tokens(c: Column) -> Column:
    """Words of a text; none for an empty one."""
    return F.filter(F.split(strip(c), r"\s+"), lambda x: x != "")


def normalise(c: Column, ignore: Sequence[str] = (), ignore_case: bool = False, ignore_punctuation: bool = False, ignore_numbers: bool = False) -> Column:
    """Drops the patterns first, then case, punctuation and digits."""
    for pattern in ignore:
        c = F.regexp_replace(c, pattern, "")
    if ignore_case:
        c = F.lower(c)
    if ignore_punctuation:
        c = F.translate(c, PUNCTUATION, "")
    return F.translate(c, "0123456789", "") if ignore_numbers else c


def exact_match(pred: Column, gold: Column, **how) -> Column:
    """1.0 where both sides agree after normalise()."""
    return (normalise(pred, **how) == normalise(gold, **how)).cast("double")


def any_match(score: Callable[[Column], Column], golds: Column) -> Column:
    """1.0 if any target scores above 0."""
    return F.exists(golds, lambda g: score(g) > 0).cast("double")


def best_of(score: Callable[[Column], Column], golds: Column) -> Column:
    """The best score over the targets."""
    return F.array_max(F.transform(golds, score))


def anls(pred: Column, golds: Column, threshold: float = 0.5) -> Column:
    """1 - the smallest normalised edit distance, 0 under the threshold.

    Distances are of collapsed texts, lengths of the texts as they are.
    """

    def distance(g: Column) -> Column:
        longest = F.greatest(F.length(g), F.length(pred))
        return F.when(longest == 0, 0.0).otherwise(F.levenshtein(collapse(g), collapse(pred)) / longest)

    similar = 1 - F.array_min(F.transform(golds, distance))
    return F.when(similar < threshold, 0.0).otherwise(similar)


def anls_strict(pred: Column, golds: Column) -> Column:
    """Best similarity over the targets; empty and "none" predictions score 0, and similarities of 0.5 or less."""
    p = F.lower(strip(pred))

    def similar(g: Column) -> Column:
        longest = F.greatest(F.length(g), F.length(p))
        s = F.when(longest == 0, 0.0).otherwise(1 - F.levenshtein(F.lower(strip(g)), p) / longest)
        return F.when(s > 0.5, s).otherwise(0.0)

    return F.when((p == "") | (p == "none"), 0.0).otherwise(best_of(similar, golds))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


# --- overlaps of token arrays


def numbered(a: Column) -> Column:
    """Tokens with the number of their like before them, so that repeats differ; sorted."""

    def number(s: Column) -> Column:
        return F.transform(s, lambda x, i: F.concat_ws("\x01", x, (i + 1 - F.array_position(s, x)).cast("string")))

    return let(number, F.sort_array(a))


def overlap(a: Column, b: Column) -> Column:
    """Tokens that both arrays have, with repeats. For answers; whole texts are counted relationally."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def f1(common: Column, n_pred: Column, n_gold: Column) -> Column:
    """Harmonic mean of precision and recall; 1 if both sides are empty."""
    return F.when((n_pred == 0) & (n_gold == 0), 1.0).when((n_pred == 0) | (n_gold == 0) | (common == 0), 0.0).otherwise(2.0 * common / (n_pred + n_gold))


def answer_tokens(c: Column) -> Column:
    """Lower-case words without punctuation and articles."""
    c = F.translate(F.lower(c), PUNCTUATION, "")
    return tokens(F.regexp_replace(c, r"\b(a|an|the)\b", " "))


def token_f1(pred: Column, gold: Column) -> Column:
    a, b = answer_tokens(pred), answer_tokens(gold)
    return f1(overlap(a, b), F.size(a), F.size(b))


def set_scores(pred: Column, gold: Column, epsilon: float | None = None) -> dict[str, Column]:
    """Precision, recall, F1 and Jaccard of two arrays as sets.

    Empty denominators give 1; with ``epsilon`` it is added to each denominator instead.
    """
    both = F.size(F.array_intersect(pred, gold)).cast("double")
    n_pred, n_gold, n_any = (F.size(F.array_distinct(x)).cast("double") for x in (pred, gold, F.array_union(pred, gold)))

    def over(num: Column, den: Column) -> Column:
        return num / (den + epsilon) if epsilon is not None else F.when(den == 0, 1.0).otherwise(num / den)

    p, r = over(both, n_pred), over(both, n_gold)
    both_sum = p + r + (epsilon or 0.0)
    return {"precision": p, "recall": r, "f1": F.when(both_sum == 0, 0.0).otherwise(2 * p * r / both_sum), "jaccard": over(both, n_any)}


def ngrams(words: Column, n: int) -> Column:
    """Runs of n tokens, joined by a space."""
    if n == 1:
        return words

    def runs(w: Column) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(joined)

    return let(runs, words)


def char_ngrams(c: Column, n: int) -> Column:
    def runs(t: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(F.length(t) < n, F.array().cast("array<string>")).otherwise(cut)

    return let(runs, F.regexp_replace(c, r"\s+", ""))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading elements that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(same).cast("long"))


def common_prefix_ratio(pred: Column, gold: Column) -> Column:
    longest = F.greatest(F.size(pred), F.size(gold))
    return F.when(longest == 0, 1.0).otherwise(common_prefix(pred, gold) / longest)


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance between token arrays, inside the JVM.

    Each different token of a row becomes one character, and the built-in
    levenshtein() compares the two strings. Exact for up to 41,984 different
    tokens a row; more raise an error.
    """

    def distance(x: Column, y: Column, known: Column) -> Column:
        def spell(z: Column) -> Column:
            codes = F.transform(z, lambda t: F.lpad(F.hex(F.array_position(known, t) + F.lit(_FIRST - 1)), 4, "0"))
            return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")

        small = F.size(known) <= _LAST - _FIRST + 1
        return F.when(small, F.levenshtein(spell(x), spell(y))).otherwise(F.raise_error(F.lit("token_distance: too many different tokens")).cast("int"))

    return let(distance, a, b, F.array_distinct(F.concat(a, b)))


def characters(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, r"\s+", ""), ""), lambda x: x != "")


# --- numbers


_BLANKS = " \t\n\r\f\x0b"


def number(c: Column) -> Column:
    """A double where the text is a plain number, as a percentage over 100; else null."""
    t = F.btrim(c, F.lit(_BLANKS))
    value = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?%?$"), F.rtrim(t, F.lit("%")).try_cast("double"))
    return value / F.when(t.endswith("%"), 100.0).otherwise(1.0)


def relaxed_match(pred: Column, gold: Column, tolerance: float = 0.05) -> Column:
    """Numbers within a relative tolerance; anything else, and a target of 0, equal but for case."""
    p, g = number(pred), number(gold)
    # null where a side is no number, or the target is 0
    return F.coalesce(F.try_divide(F.abs(p - g), F.abs(g)) <= tolerance, F.lower(pred) == F.lower(gold)).cast("double")


def relative_accuracy(pred: Column, gold: Column) -> Column:
    """Mean over the thresholds .5, .55, ... .95 of whether the relative error is at most 1 - threshold."""
    error = F.abs(pred - gold) / F.abs(gold)
    hits = [(error <= 1 - (0.5 + 0.45 * i / 9)).cast("double") for i in range(10)]
    return sum(hits[1:], hits[0]) / 10


def difference_ratio(pred: Column, gold: Column) -> Column:
    """1 - relative error, not under 0; a target of 0 must be met exactly."""
    return F.when(gold == 0, (pred == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(pred - gold) / F.abs(gold)))


def vqa_share(hits: Column, answers: Column) -> Column:
    """Mean over annotators of min(1, matches among the others / 3), from the number of matches and of answers."""
    # an annotator who agrees has hits - 1 others that do
    agreeing = F.least(F.lit(1.0), (hits - 1) / 3.0) * hits
    return (agreeing + F.least(F.lit(1.0), hits / 3.0) * (answers - hits)) / answers


def vqa_accuracy(pred: Column, answers: Column) -> Column:
    return vqa_share(F.size(F.filter(answers, lambda a: a == pred)), F.size(answers))


#: Number words of answers. Fixed values.
NUMBER_WORDS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}


def vqa_normalise(c: Column) -> Column:
    """Lower case without punctuation inside words, articles dropped, number words as digits."""
    c = F.regexp_replace(F.regexp_replace(strip(c), r"[\n\t]", " "), r"(?<!\d)\.(?!\d)", "")
    c = F.lower(F.regexp_replace(c, r"[;/\[\]\"{}()=+\\_\-<>@`,?!]", ""))
    numbers = F.create_map(*(F.lit(x) for kv in NUMBER_WORDS.items() for x in kv))
    words = F.filter(tokens(c), lambda w: ~w.isin("a", "an", "the"))
    return F.array_join(F.transform(words, lambda w: F.coalesce(numbers[w], w)), " ")


def sentence_bleu1(pred: Column, gold: Column, floor: float = 0.1) -> Column:
    """Clipped unigram precision with brevity penalty; no match counts as ``floor`` matches."""
    n = F.size(pred).cast("double")
    hits = overlap(pred, gold).cast("double")
    precision = F.when(hits == 0, floor / n).otherwise(hits / n)
    brevity = F.when(n > F.size(gold), 1.0).otherwise(F.exp(1 - F.size(gold) / n))
    return F.when((n == 0) | (hits == 0), 0.0).otherwise(precision * brevity)


def gleu(pred: Column, gold: Column, order: int = 4) -> Column:
    """The smaller of n-gram precision and recall, over all n-grams up to ``order``."""
    grams = [(ngrams(pred, n), ngrams(gold, n)) for n in range(1, order + 1)]
    hits = sum((overlap(a, b) for a, b in grams[1:]), overlap(*grams[0]))
    most = F.greatest(sum((F.size(a) for a, _ in grams[1:]), F.size(grams[0][0])), sum((F.size(b) for _, b in grams[1:]), F.size(grams[0][1])))
    return F.coalesce(F.try_divide(hits.cast("double"), most), F.lit(0.0))


def squared_error(pred: Column, gold: Column) -> Column:
    """Mean squared difference of two number arrays."""
    return F.aggregate(F.zip_with(pred, gold, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(gold)


def rescaled_error(pred: Column, gold: Column, worst: float = 0.1) -> Column:
    """1 - root of the mean squared difference over ``worst``, not under 0; 0 where the arrays can't be compared."""
    root = F.when((F.size(pred) == F.size(gold)) & (F.size(gold) > 0), F.sqrt(squared_error(pred, gold)))
    return F.coalesce(1 - F.least(root, F.lit(worst)) / worst, F.lit(0.0))


def angle_error(pred: Column, gold: Column) -> Column:
    """Degrees between two angles, 0 to 180."""
    d = F.pmod(pred - gold, F.lit(360.0))
    return F.least(d, 360.0 - d)


def positional_match(pred: Column, gold: Column) -> Column:
    """Share of positions at which two arrays agree, over the longer one."""
    longest = F.greatest(F.size(pred), F.size(gold))
    same = F.size(F.filter(F.zip_with(pred, gold, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    return F.when(longest == 0, 1.0).otherwise(same / longest)


def map_match(pred: Column, gold: Column) -> Column:
    """Share of a map's target entries that the predicted map has."""
    entries = F.map_entries(gold)
    hits = F.size(F.filter(entries, lambda e: F.coalesce(F.element_at(pred, e["key"]) == e["value"], F.lit(False))))
    return F.when(F.size(entries) == 0, 1.0).otherwise(hits / F.size(entries))


# --- written forms


def detokenised(c: Column) -> Column:
    """Tokens as running text: no blanks inside brackets and quotes, before n't, and before stops."""
    for old, new in ((" n't", "n't"), (" )", ")"), ("( ", "("), ('" ', '"'), (' "', '"')):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.regexp_replace(c, " (?=['.,])", "")


def sanitised(c: Column) -> Column:
    """A name that every file system takes: one pair of underscores for each run of signs it may not have."""
    return F.regexp_replace(c, r'["<>:/|\\?*\[\]]+', "__")


def caption_tokens(c: Column) -> Column:
    """Words of a caption as treebanks part them, in lower case and without punctuation: it's is it and 's, don't is do and n't."""
    parted = F.regexp_replace(F.lower(c), r"([^\p{L}\p{N}'\-.]|\.(?!\d)|(?<!\d)\.|--)", " ")
    parted = F.regexp_replace(F.regexp_replace(parted, r"(?<=\w)(n't)\b", " $1"), r"(?<=\w)('(?:s|re|ve|ll|d|m))\b", " $1")
    return F.filter(tokens(parted), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def math_value(c: Column) -> Column:
    """The number that an answer in LaTeX or plain figures is: fractions, percent signs and thousands' commas are read; else null."""

    def read(t: Column) -> Column:
        form = r"^(-?)\\?[dt]?(?:frac)?\{?(-?\d+(?:\.\d+)?)\}?(?:/|\{)(-?\d+(?:\.\d+)?)\}?$"
        top, bottom = (F.regexp_extract(t, form, g).try_cast("double") for g in (2, 3))
        sign = F.when(F.regexp_extract(t, form, 1) == "-", -1.0).otherwise(1.0)
        return F.coalesce(number(t), sign * F.try_divide(top, bottom))

    plain = F.regexp_replace(c, r"\\[,;!: ]|\\left|\\right|\$|\s+|(?<=\d),(?=\d{3}\b)", "")
    return let(read, F.replace(plain, F.lit("\\%"), F.lit("%")))


def math_equal(pred: Column, gold: Column, tolerance: float = 1e-4) -> Column:
    """1.0 if two answers are the same number within a relative tolerance, or the same text but for blanks and LaTeX spacing."""

    def same(p: Column, g: Column, x: Column, y: Column) -> Column:
        bare = lambda t: F.regexp_replace(F.lower(t), r"\\[,;!: ]|\\left|\\right|\$|\s+|\\text\{([^{}]*)\}", "$1")
        close = F.abs(p - g) <= tolerance * F.greatest(F.lit(1.0), F.abs(g))
        return F.when(p.isNotNull() & g.isNotNull(), close).otherwise(F.coalesce(bare(x) == bare(y), F.lit(False))).cast("double")

    return let(same, math_value(pred), math_value(gold), pred, gold)
