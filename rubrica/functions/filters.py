"""Response filters: array column in, array column out, chained into named pipelines."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.functions import extract
from rubrica.functions.text import NUMBER_WORDS, PUNCTUATION, let

Filter = Callable[[Column], Column]
FILTERS: dict[str, Callable[..., Filter]] = {}


def register(name: str) -> Callable:
    """Adds a filter maker under a name; names are taken once."""

    def add(f: Callable[..., Filter]) -> Callable[..., Filter]:
        if name in FILTERS:
            raise ValueError(f"there is a filter {name!r} already")
        FILTERS[name] = f
        return f

    return add


def _each(f: Callable[[Column], Column]) -> Filter:
    return lambda resps: F.transform(resps, f)


@register("take_first")
def take_first() -> Filter:
    return lambda resps: F.slice(resps, 1, 1)


@register("take_first_k")
def take_first_k(k: int) -> Filter:
    """The first k; fewer responses are an error."""
    return lambda resps: F.when(F.size(resps) >= k, F.slice(resps, 1, k)).otherwise(F.raise_error(F.lit(f"fewer than {k} responses")).cast("array<string>"))


def majority(resps: Column) -> Column:
    """The most frequent element; of equally frequent ones, the first met."""

    def first(r: Column) -> Column:
        ranked = F.transform(F.array_distinct(r), lambda x: F.struct((-F.size(F.filter(r, lambda y: y == x))).alias("n"), F.array_position(r, x).alias("at"), x.alias("x")))
        return F.array_min(ranked)["x"]

    return let(first, resps)


@register("majority_vote")
def majority_vote() -> Filter:
    return lambda resps: F.array(majority(resps))


@register("regex")
def regex(pattern: str = r"#### (\-?[0-9\.\,]+)", group_select: int = 0, fallback: str = extract.INVALID) -> Filter:
    return _each(lambda x: extract.regex_group(x, pattern, group_select, fallback))


@register("multi_choice_regex")
def multi_choice_regex(choices: Column | None = None, pattern: str = r"\(([A-Z])\)", fallback: str = extract.INVALID, letters: str = "ABCDEFGHIJ") -> Filter:
    """(X) by the pattern, else by a choice's text, else by a letter behind a colon."""

    def one(x: Column) -> Column:
        first = F.when(F.regexp_extract(x, pattern, 1) != "", F.regexp_extract(x, pattern, 1))
        text = [extract.choice_by_text(x, choices, letters)] if choices is not None else []
        after = F.regexp_extract(x, rf":\s*([{letters}])\b", 1)
        letter = F.coalesce(first, *text, F.when(after != "", after))
        return F.when(letter.isNotNull(), F.concat(F.lit("("), letter, F.lit(")"))).otherwise(F.lit(fallback))

    return _each(one)


@register("simple_multi_choice")
def simple_multi_choice(question: Column, fallback: str = extract.INVALID) -> Filter:
    """The letter of the choice ("A. text" lines of the question) that the response names, else its letter."""
    texts = F.regexp_extract_all(question, F.lit(r"(?m)^\s*[A-J][.):]\s*(.+?)\s*$"), F.lit(1))
    return _each(lambda x: F.coalesce(extract.choice_by_text(x, texts), extract.choice_letter(F.translate(x, PUNCTUATION, "")), F.lit(fallback)))


@register("remove_whitespace")
def remove_whitespace() -> Filter:
    """Drops one leading space."""
    return _each(lambda x: F.regexp_replace(x, "^ ", ""))


@register("lowercase")
def lowercase() -> Filter:
    return _each(F.lower)


@register("uppercase")
def uppercase() -> Filter:
    return _each(F.upper)


@register("map")
def map_(mapping: Mapping[str, str], default: str | None = None) -> Filter:
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return _each(lambda x: F.coalesce(table[x], F.lit(default)))


@register("number_words")
def number_words() -> Filter:
    """Number words as digits."""
    return _each(lambda x: reduce(lambda c, kv: F.regexp_replace(c, rf"(?i)\b{kv[0]}\b", kv[1]), NUMBER_WORDS.items(), x))


def pipeline(steps: Sequence[Filter | str | tuple[str, dict]]) -> Filter:
    """Steps in order: filters, registered names, or (name, arguments)."""
    made = [FILTERS[s]() if isinstance(s, str) else FILTERS[s[0]](**s[1]) if isinstance(s, tuple) else s for s in steps]
    return lambda resps: reduce(lambda c, f: f(c), made, resps)


def apply_pipelines(responses: DataFrame, pipelines: Mapping[str, Sequence], resps: str = "resps") -> DataFrame:
    """One row for each response row and pipeline: adds filter_key and resp. One scan, whatever their number."""
    made = F.array(*(F.struct(F.lit(k).alias("filter_key"), pipeline(p)(F.col(resps)).alias("resp")) for k, p in pipelines.items()))
    rest = [c for c in responses.columns if c not in ("filter_key", "resp")]
    return responses.select(*rest, F.explode(made).alias("_p")).select(*rest, "_p.filter_key", "_p.resp")
