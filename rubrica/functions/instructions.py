"""Checks of whether a response follows an instruction, as boolean Column expressions.

CHECKS maps an instruction's name to a function (response, arguments), where
arguments are plain values or columns. The names and the option strings are
fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrica.functions.text import overlap, strip, tokens

CHECKS: dict[str, Callable[..., Column]] = {}


def register(name: str) -> Callable:
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        CHECKS[name] = f
        return f

    return add


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _relation(n: Column, relation: str, bound) -> Column:
    """"less than" or "at least"."""
    return n < _c(bound) if relation == "less than" else n >= _c(bound)


def _count(resp: Column, pattern: str) -> Column:
    return F.regexp_count(resp, F.lit(pattern))


def _word(w: str) -> str:
    return r"(?i)\b\Q" + w + r"\E\b"


def _paragraphs(resp: Column) -> Column:
    return F.filter(F.split(resp, r"\s?\*\*\*\s?"), lambda x: strip(x) != "")


@register("keywords:existence")
def keywords_exist(resp: Column, keywords: list[str]) -> Column:
    return F.lit(True) if not keywords else _all([F.contains(F.lower(resp), F.lit(k.lower())) for k in keywords])


@register("keywords:forbidden_words")
def words_forbidden(resp: Column, forbidden_words: list[str]) -> Column:
    return _all([~resp.rlike(_word(w)) for w in forbidden_words])


@register("keywords:frequency")
def keyword_frequency(resp: Column, keyword: str, frequency: int, relation: str) -> Column:
    return _relation(_count(resp, r"(?i)\Q" + keyword + r"\E"), relation, frequency)


@register("keywords:letter_frequency")
def letter_frequency(resp: Column, letter: str, let_frequency: int, let_relation: str) -> Column:
    return _relation(_count(F.lower(resp), r"\Q" + letter.lower() + r"\E"), let_relation, let_frequency)


@register("length_constraints:number_words")
def number_words(resp: Column, num_words: int, relation: str) -> Column:
    return _relation(_count(resp, r"\w+"), relation, num_words)


def _sentences(resp: Column) -> Column:
    """Sentences end with . ! or ? before white space or the end."""
    return F.filter(F.split(strip(resp), r"(?<=[.!?])\s+"), lambda x: x != "")


@register("length_constraints:number_sentences")
def number_sentences(resp: Column, num_sentences: int, relation: str) -> Column:
    return _relation(F.size(_sentences(resp)), relation, num_sentences)


@register("keywords:key_sentences")
def key_sentences(resp: Column, key_sentences: list[str], num_sentences: int) -> Column:
    """Exactly so many of the key sentences are sentences of the response."""
    return F.size(F.array_intersect(F.array(*map(F.lit, key_sentences)), _sentences(resp))) == num_sentences


@register("length_constraints:number_paragraphs")
def number_paragraphs(resp: Column, num_paragraphs: int) -> Column:
    """Paragraphs parted by ***; an empty one between two others fails."""
    parts = F.split(resp, r"\s?\*\*\*\s?")
    inner_empty = F.exists(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: strip(x) == "")
    return (F.size(_paragraphs(resp)) == _c(num_paragraphs)) & ~inner_empty


@register("length_constraints:nth_paragraph_first_word")
def nth_paragraph_first_word(resp: Column, num_paragraphs: int, nth_paragraph: int, first_word: str) -> Column:
    parts = F.filter(F.split(resp, r"\n\n"), lambda x: strip(x) != "")
    start = F.lower(F.regexp_extract(strip(F.get(parts, F.lit(nth_paragraph - 1))), r"^['\"]?([^\s.,?!'\"]*)", 1))
    return (F.size(parts) == num_paragraphs) & F.coalesce(start == first_word.lower(), F.lit(False))


@register("detectable_content:number_placeholders")
def number_placeholders(resp: Column, num_placeholders: int) -> Column:
    return _count(resp, r"\[.*?\]") >= num_placeholders


@register("detectable_content:postscript")
def postscript(resp: Column, postscript_marker: str) -> Column:
    marks = {"P.P.S": r"\s*p\.\s?p\.\s?s.*$", "P.S.": r"\s*p\.\s?s\..*$"}
    return F.lower(resp).rlike("(?m)" + marks.get(postscript_marker, r"\s*\Q" + postscript_marker.lower() + r"\E.*$"))


@register("detectable_format:number_bullet_lists")
def number_bullets(resp: Column, num_bullets: int) -> Column:
    return _count(resp, r"(?m)^\s*\*[^\*].*$") + _count(resp, r"(?m)^\s*-.*$") == num_bullets


@register("detectable_format:constrained_response")
def constrained_response(resp: Column, options: tuple[str, ...] = ("My answer is yes.", "My answer is no.", "My answer is maybe.")) -> Column:
    return _any([F.contains(strip(resp), F.lit(o)) for o in options])


@register("detectable_format:number_highlighted_sections")
def number_highlights(resp: Column, num_highlights: int) -> Column:
    single = F.filter(F.regexp_extract_all(resp, F.lit(r"\*[^\n\*]*\*"), F.lit(0)), lambda x: strip(F.translate(x, "*", "")) != "")
    double = F.filter(F.regexp_extract_all(resp, F.lit(r"\*\*[^\n\*]*\*\*"), F.lit(0)), lambda x: strip(F.translate(x, "*", "")) != "")
    return F.size(single) + F.size(double) >= num_highlights


@register("detectable_format:multiple_sections")
def multiple_sections(resp: Column, section_spliter: str, num_sections: int) -> Column:
    return F.size(F.split(resp, r"\s?\Q" + section_spliter + r"\E\s?\d+\s?")) - 1 >= num_sections


@register("detectable_format:json_format")
def json_format(resp: Column) -> Column:
    """A JSON value, with or without a code fence around it."""
    body = strip(F.regexp_replace(strip(resp), r"(?i)^```(json)?|```$", ""))
    return body.rlike(r'^[\[{"\d\-tfn]') & F.try_parse_json(body).isNotNull()


@register("detectable_format:title")
def title(resp: Column) -> Column:
    return F.exists(F.regexp_extract_all(resp, F.lit(r"<<[^\n]+>>"), F.lit(0)), lambda x: strip(F.translate(x, "<>", "")) != "")


@register("detectable_format:rephrase")
def rephrased(resp: Column, original_message) -> Column:
    """Both have a *change*, and agree but for it."""
    change, original = r"\*.*\*", _c(original_message)
    return resp.rlike(change) & original.rlike(change) & (F.regexp_replace(resp, change, "") == F.regexp_replace(original, change, ""))


@register("detectable_content:rephrase_paragraph")
def rephrased_paragraph(resp: Column, original_paragraph, low: int, high: int) -> Column:
    """From low to high words in common, with repeats, in any case."""
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return overlap(words(resp), words(_c(original_paragraph))).between(low, high)


@register("multi-turn:constrained_start")
def constrained_start(resp: Column, starter: str) -> Column:
    """Some line starts with the phrase."""
    return resp.rlike(r"(?m)^\s*\Q" + starter.strip() + r"\E")


@register("combination:two_responses")
def two_responses(resp: Column) -> Column:
    """Two different texts around ******."""
    parts = F.split(resp, r"\*\*\*\*\*\*")
    full = F.filter(parts, lambda x: strip(x) != "")
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return (F.size(full) == 2) & (strip(F.get(full, F.lit(0))) != strip(F.get(full, F.lit(1)))) & ~F.exists(inner, lambda x: strip(x) == "")


@register("combination:repeat_prompt")
def repeat_prompt(resp: Column, prompt_to_repeat) -> Column:
    return F.startswith(F.lower(strip(resp)), F.lower(strip(_c(prompt_to_repeat))))


@register("startend:end_checker")
def end_checker(resp: Column, end_phrase: str) -> Column:
    return F.endswith(F.lower(F.regexp_replace(strip(resp), '^"+|"+$', "")), F.lit(end_phrase.strip().lower()))


@register("startend:quotation")
def quotation(resp: Column) -> Column:
    return (F.length(strip(resp)) > 1) & F.startswith(strip(resp), F.lit('"')) & F.endswith(strip(resp), F.lit('"'))


@register("change_case:capital_word_frequency")
def capital_words(resp: Column, capital_frequency: int, capital_relation: str) -> Column:
    return _relation(F.size(F.filter(tokens(resp), lambda w: (w == F.upper(w)) & (w != F.lower(w)))), capital_relation, capital_frequency)


@register("change_case:english_capital")
def all_upper(resp: Column) -> Column:
    return (resp == F.upper(resp)) & (resp != F.lower(resp))


@register("change_case:english_lowercase")
def all_lower(resp: Column) -> Column:
    return (resp == F.lower(resp)) & (resp != F.upper(resp))


@register("punctuation:no_comma")
def no_comma(resp: Column) -> Column:
    return ~F.contains(resp, F.lit(","))


@register("language:response_language")
def response_language(resp: Column, language: str, detected: Column | None = None) -> Column:
    """By a column of detected languages; without one, by the script of most letters."""
    if detected is not None:
        return detected == language
    scripts = {"ru": "Cyrillic", "bg": "Cyrillic", "uk": "Cyrillic", "ar": "Arabic", "fa": "Arabic", "ur": "Arabic", "hi": "Devanagari", "mr": "Devanagari", "ne": "Devanagari", "bn": "Bengali", "ko": "Hangul", "th": "Thai", "te": "Telugu", "ta": "Tamil", "kn": "Kannada", "gu": "Gujarati", "pa": "Gurmukhi", "el": "Greek", "he": "Hebrew", "zh": "Han", "ja": "Hiragana"}
    return 2 * _count(resp, r"\p{Is" + scripts.get(language, "Latin") + "}") > _count(resp, r"\p{L}")


def _all(xs: list[Column]) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & x
    return out


def _any(xs: list[Column]) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | x
    return out


def variants(resp: Column) -> list[Column]:
    """The response as it is, without asterisks, and without its first line, last line or both."""
    lines = F.split(resp, "\n")
    cut = lambda a, b: strip(F.array_join(F.slice(lines, F.lit(1 + a), F.greatest(F.size(lines) - a - b, F.lit(0))), "\n"))
    plain = [resp, cut(1, 0), cut(0, 1), cut(1, 1)]
    return plain + [F.translate(x, "*", "") for x in plain]


def follows(resp: Column, name: str, loose: bool = False, **arguments) -> Column:
    """Whether a response that isn't blank follows the instruction; loosely, if any of its variants does."""
    check = CHECKS[name]
    tries = variants(resp) if loose else [resp]
    return F.coalesce(_any([(strip(x) != "") & check(x, **arguments) for x in tries]), F.lit(False))
