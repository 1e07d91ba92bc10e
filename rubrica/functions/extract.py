"""Answers out of responses: letters, yes or no, numbers, intervals, boxes, judgements, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrica.functions.text import strip

INVALID = "[invalid]"


def _found(c: Column) -> Column:
    return F.when(c != "", c)


def regex_group(resp: Column, pattern: str, select: int = 0, fallback: str = INVALID) -> Column:
    """The select-th match (negative: from the end), of a pattern's first group that isn't empty; stripped."""
    groups = max(1, pattern.count("(") - pattern.count("(?") - pattern.count("\\("))
    has_groups = pattern.count("(") - pattern.count("(?") - pattern.count("\\(") > 0
    each = [F.get(F.regexp_extract_all(resp, F.lit(pattern), F.lit(g + 1 if has_groups else 0)), F.lit(select) if select >= 0 else F.size(F.regexp_extract_all(resp, F.lit(pattern), F.lit(1 if has_groups else 0))) + select) for g in range(groups)]
    return F.coalesce(*(_found(strip(x)) for x in each), F.lit(fallback))


def choice_letter(resp: Column, letters: str = "ABCDE") -> Column:
    """A letter by ordered attempts: the whole response, a stated answer, (X), "X." or "X)", a lone letter; else null."""
    s, group = strip(resp), f"([{letters}])"
    tries = (rf"^{group}[.):]?$", rf"(?i:answer|option|choice)(?i:\s+is)?\s*:?\s*\(?{group}\b", rf"\({group}\)", rf"(?:^|\s){group}[.):]", rf"\b{group}\b")
    return F.coalesce(*(_found(F.regexp_extract(s, t, 1)) for t in tries))


def choice_by_text(resp: Column, choices: Column, letters: str = "ABCDEFGHIJ") -> Column:
    """The letter of the choice whose text occurs first in the response, case aside; the longer one on ties; else null."""
    low = F.lower(resp)
    scored = F.transform(choices, lambda c, i: F.struct(F.instr(low, F.lower(c)).alias("at"), (-F.length(c)).alias("size"), i.alias("i")))
    first = F.array_min(F.filter(scored, lambda x: x["at"] > 0))
    return F.when(first.isNotNull(), F.substring(F.lit(letters), first["i"] + 1, F.lit(1)))


def yes_no_prefix(resp: Column) -> Column:
    """By the first four characters: yes, no, or other."""
    head = F.substring(F.lower(strip(resp)), 1, 4)
    return F.when(F.contains(head, F.lit("yes")), "yes").when(F.contains(head, F.lit("no")), "no").otherwise("other")


def yes_no_first(resp: Column) -> Column:
    """The whole word, yes or no, that occurs first; else null."""
    low = F.lower(resp)
    yes, no = F.regexp_instr(low, F.lit(r"\byes\b")), F.regexp_instr(low, F.lit(r"\bno\b"))
    return F.when((yes > 0) & ((no == 0) | (yes < no)), "yes").when(no > 0, "no")


def boxed(resp: Column) -> Column:
    """The content of the last \\boxed{...}, braces balanced to depth 3; else null."""
    inner = r"[^{}]*(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}[^{}]*)*"
    return F.element_at(F.regexp_extract_all(resp, F.lit(r"\\boxed\{(" + inner + r")\}"), F.lit(1)), -1)


def last_number(resp: Column) -> Column:
    """The last number of a text, thousands' commas dropped; else null."""
    found = F.regexp_extract_all(resp, F.lit(r"-?\d[\d,]*\.?\d*"), F.lit(0))
    last = F.get(found, F.size(found) - 1)
    return F.regexp_replace(F.regexp_replace(last, ",", ""), r"\.$", "").try_cast("double")


def interval(resp: Column) -> Column:
    """[start, end] in seconds: "12.5 to 20", then two numbers or clock times in order; null unless end > start."""
    clock = F.regexp_extract_all(resp, F.lit(r"\b(\d{1,2}:\d{2}(?::\d{2})?)\b"), F.lit(1))
    ranged = F.array(*(F.regexp_extract(resp, r"(\d+(?:\.\d+)?)\s*(?:s|sec|seconds)?\s*(?:-|–|to|and)\s*(\d+(?:\.\d+)?)", g).try_cast("double") for g in (1, 2)))
    timed = F.transform(F.slice(clock, 1, 2), seconds)
    plain = F.transform(F.slice(F.regexp_extract_all(resp, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), 1, 2), lambda x: x.try_cast("double"))
    picked = F.when(F.size(clock) >= 2, timed).when(ranged[0].isNotNull(), ranged).when(F.size(plain) == 2, plain)
    return F.when(F.get(picked, F.lit(1)) > F.get(picked, F.lit(0)), picked)


def seconds(clock: Column) -> Column:
    """H:MM:SS or M:SS as seconds."""
    return F.aggregate(F.split(clock, ":"), F.lit(0.0), lambda s, x: s * 60 + x.try_cast("double"))


def box(resp: Column) -> Column:
    """Four numbers of a bracketed list as doubles; else [0, 0, 0, 0]."""
    number = r"\s*(-?\d+(?:\.\d+)?)\s*"
    pattern = r"\[" + ",".join([number] * 4) + r"\]"
    found = F.array(*(F.regexp_extract(resp, pattern, g).try_cast("double") for g in range(1, 5)))
    return F.when(found[0].isNotNull(), found).otherwise(F.array(*[F.lit(0.0)] * 4))


def clock(secs: Column) -> Column:
    """Seconds as m:ss."""
    whole = F.floor(secs).cast("long")
    return F.format_string("%d:%02d", F.expr("0") + F.floor(whole / 60).cast("long"), F.pmod(whole, F.lit(60)))


def reasoning_answer(resp: Column) -> Column:
    """What stands in the last <answer> tag, else behind </think>, else everything; stripped."""
    tagged = F.regexp_extract_all(resp, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    behind = F.regexp_extract(resp, r"(?s)</think>(.*)$", 1)
    return strip(F.coalesce(F.get(tagged, F.size(tagged) - 1), _found(behind), resp))


def id_list(c: Column) -> Column:
    """Numbers and ranges ("3, 20-21, 97..99") as an array without repeats, in order."""
    parts = F.filter(F.split(F.regexp_replace(c, r"\s+", ""), "[,;]"), lambda x: x.rlike(r"^\d+((-|\.\.)\d+)?$"))

    def span(p: Column) -> Column:
        low = F.regexp_extract(p, r"^(\d+)", 1).cast("long")
        high = F.coalesce(F.regexp_extract(p, r"(?:-|\.\.)(\d+)$", 1).try_cast("long"), low)
        return F.when(high >= low, F.sequence(low, F.greatest(high, low))).otherwise(F.array().cast("array<long>"))

    return F.array_distinct(F.flatten(F.transform(parts, span)))


# --- judgements


def judge_binary(resp: Column, strict: bool = False) -> Column:
    """1 if a "1" occurs anywhere; strictly, if the response is 1."""
    return (strip(resp) == "1").cast("int") if strict else F.contains(resp, F.lit("1")).cast("int")


def judge_score(resp: Column, low: float, high: float) -> Column:
    """The first number, kept within bounds; without one, the lower bound."""
    first = F.get(F.regexp_extract_all(resp, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), F.lit(0)).try_cast("double")
    return F.coalesce(F.least(F.greatest(first, F.lit(low)), F.lit(high)), F.lit(low))


def judge_pair(resp: Column) -> Column:
    """The first two numbers of the first line, else [-1, -1]."""
    line = F.split(resp, "\n")[0]
    found = F.transform(F.slice(F.regexp_extract_all(line, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), 1, 2), lambda x: x.try_cast("double"))
    return F.when(F.size(found) == 2, found).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


def judge_json(resp: Column) -> Column:
    """The text from the first opening brace to the last closing one; else null."""
    return _found(F.regexp_extract(resp, r"(?s)\{.*\}", 0))
