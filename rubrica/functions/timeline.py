"""Texts about moments of a video: anchors, topics, tags, sections, id and reason pairs.

An anchor is a text in square brackets: ``key=value`` with one bound or two
around an arrow. Brackets are parsed once, into their kind and bounds; tags,
topics and anchors are read off these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrica.functions.extract import id_list
from rubrica.functions.text import let, strip

_BRACKET = r"\[[^\[\]]*\]"
#: Sentinel tags and headings of sections. Fixed values.
SECTIONS = ("FRAMES", "KNOWN_INFO_UPDATE", "STATS")


def brackets(c: Column) -> Column:
    """[{raw, kind, low, high}] of the bracketed texts in order.

    kind is t (seconds: the value ends with s), phase, low (the mark of low
    confidence), vague (t or phase without readable bounds), or empty.
    """

    def parse(raw: Column) -> Column:
        body = F.split(F.lower(F.substring(raw, F.lit(2), F.length(raw) - 2)), "=", 2)
        key, value = strip(body[0]), strip(F.get(body, F.lit(1)))
        bounds = F.transform(F.split(F.rtrim(value, F.lit("s")), "→"), lambda x: strip(x).try_cast("double"))

        def kinds(k: Column, v: Column, b: Column) -> Column:
            read = (F.size(b) <= 2) & F.forall(b, lambda x: x.isNotNull())
            kind = F.when((k == "t") & read & v.endswith("s"), "t").when((k == "phase") & read & ~v.endswith("s"), "phase")
            kind = kind.when(k.isin("t", "phase") & (v != ""), "vague").when(F.split(k, r"\W")[0] == "low", "low").otherwise("")
            return F.struct(raw.alias("raw"), kind.alias("kind"), F.when(read, F.array_min(b)).alias("low"), F.when(read, F.array_max(b)).alias("high"))

        return let(kinds, key, F.coalesce(value, F.lit("")), bounds)

    return F.transform(F.regexp_extract_all(c, F.lit(_BRACKET), F.lit(0)), parse)


def _without(c: Column, found: Column, kinds: tuple[str, ...], instead: str) -> Column:
    """The text with brackets of some kinds replaced, white space collapsed."""
    kept = F.zip_with(F.split(c, _BRACKET), found, lambda between, b: F.concat(between, F.when(b["kind"].isin(*kinds), instead).otherwise(F.coalesce(b["raw"], F.lit("")))))
    return strip(F.regexp_replace(F.array_join(kept, ""), r"\s+", " "))


def low_tag(c: Column) -> Column:
    """[LOW] in front, the last time anchor behind, single spaces; doing it again changes nothing. Blank texts stay."""

    def one(s: Column, found: Column) -> Column:
        times = F.filter(found, lambda b: b["kind"] == "t")
        marked = F.when(F.exists(found, lambda b: b["kind"] == "low"), "[LOW]")
        last = F.regexp_replace(F.get(times, F.size(times) - 1)["raw"], r"\s+", " ")
        body = _without(s, found, ("t", "low"), "")
        return F.array_join(F.filter(F.array(marked, body, last), lambda x: x.isNotNull() & (x != "")), " ")

    return F.when(strip(c) == "", c).otherwise(let(one, c, brackets(c)))


def topic_key(c: Column) -> Column:
    """The text without time and phase anchors, in lower case."""
    return F.lower(let(lambda s, found: _without(s, found, ("t", "phase", "vague"), " "), c, brackets(c)))


def anchors(c: Column, start: Column, end: Column) -> Column:
    """t_start, t_end, p_min, p_max: of the first time, else of the first phase with the fallback times."""

    def one(found: Column, a: Column, b: Column) -> Column:
        first = lambda kind: F.get(F.filter(found, lambda x: x["kind"] == kind), F.lit(0))
        t, p = first("t"), first("phase")
        untimed = t.isNull()
        return F.struct(F.coalesce(t["low"], a).alias("t_start"), F.coalesce(t["high"], b).alias("t_end"), F.when(untimed, p["low"].cast("int")).alias("p_min"), F.when(untimed, p["high"].cast("int")).alias("p_max"))

    return let(one, brackets(c), start, end)


def anchored(bullets: Column, start: Column, end: Column, limit: int = 3) -> Column:
    """The first bullets, those without an anchor with the window's interval behind."""
    interval = F.when(start == end, F.format_string("[t=%.2f s]", start)).otherwise(F.format_string("[t=%.2f→%.2f s]", start, end))
    return F.transform(F.slice(bullets, 1, limit), lambda b: F.when(F.exists(brackets(b), lambda x: x["kind"].isin("t", "phase", "vague")), b).otherwise(F.concat_ws(" ", b, interval)))


def sections(c: Column) -> Column:
    """frames, known, stats: between sentinel tags, else behind # headings; nulls where a section is missing."""

    def one(s: Column) -> Column:
        tags = [F.regexp_extract(s, rf"(?s)<<<BEGIN_{n}>>>(.*?)<<<END_{n}>>>", 1) for n in SECTIONS]
        tagged = s.rlike("(?s)" + ".*".join(f"<<<BEGIN_{n}>>>.*<<<END_{n}>>>" for n in SECTIONS))
        heading = "(?is)" + "(.*?)".join(rf"#\s*{n}" for n in SECTIONS) + "(.*)"
        named = s.rlike(heading)
        pick = lambda i: F.when(tagged, strip(tags[i])).when(named, strip(F.regexp_extract(s, heading, i + 1)))
        return F.struct(pick(0).alias("frames"), pick(1).alias("known"), pick(2).alias("stats"))

    return let(one, strip(F.regexp_replace(c, r"(?m)^```\w*$", "")))


def bullet_list(c: Column) -> Column:
    """The items of a list with dashes, stars or numbers, a line each."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^\s*(?:[-*]|\d+\.)\s+(.*?)\s*$"), F.lit(1)), strip)


def stats(c: Column) -> Column:
    """emitted and span of a statistics section; nulls where they aren't said."""
    count = F.regexp_extract(c, r"FRAME_COUNT_EMITTED:\s*(\d+)", 1).try_cast("int")
    span = strip(F.regexp_extract(c, r"WINDOW_SPAN_ECHO:\s*\[(.*?)\]", 1))
    return F.struct(count.alias("emitted"), F.when(span != "", span).alias("span"))


def id_reasons(c: Column) -> Column:
    """[(id, reason)] of "id: ..." blocks in order, ids as lists or ranges; the first reason of an id stays."""
    blocks = F.filter(F.split(c, r"(?im)^\s*(?=(?:id|ids|frame|frames|fid)\s*:)"), lambda b: b.rlike(r"(?i)^\s*(?:id|ids|frame|frames|fid)\s*:"))

    def pairs(b: Column) -> Column:
        ids = id_list(F.regexp_extract(b, r"(?i)^\s*(?:id|ids|frame|frames|fid)\s*:\s*([^\n]*)", 1))
        reason = strip(F.regexp_extract(b, r"(?is)\n\s*(?:(?:reason(?:ing)?|rationale)\s*:)?\s*(.*)$", 1))
        return F.transform(F.when(reason != "", ids).otherwise(F.array().cast("array<bigint>")), lambda i: F.struct(i.alias("id"), reason.alias("reason")))

    def first(ps: Column) -> Column:
        return F.filter(ps, lambda p, i: F.array_position(ps["id"], p["id"]) == i + 1)

    return let(first, F.flatten(F.transform(blocks, pairs)))


def aligned(pairs: Column, expected: Column) -> Column:
    """Pairs renumbered to the expected ids: as they are, shifted by a constant, or in order of appearance; else empty."""

    def one(ps: Column, want: Column) -> Column:
        ids = ps["id"]
        shift = F.array_min(want) - F.array_min(ids)
        same = F.array_sort(F.transform(ids, lambda i: i + shift)) == F.array_sort(want)
        shifted = F.transform(ps, lambda p: F.struct((p["id"] + shift).alias("id"), p["reason"].alias("reason")))
        ordered = F.zip_with(want, ps, lambda i, p: F.struct(i.alias("id"), p["reason"].alias("reason")))
        return F.when(same, shifted).when(F.size(ps) == F.size(want), ordered).otherwise(F.slice(ps, 1, 0))

    return let(one, pairs, expected)


def salvaged(c: Column, expected: Column) -> Column:
    """[(id, reason)] of the expected ids that some line names, whatever stands around: the rest of that line, else the next one."""

    def one(text: Column, want: Column) -> Column:
        named = F.lit(r"(?im)^\s*(?:(?:id|ids|frame|frames|fid)\s*[:#]?\s*)?[\[(]?\s*")
        behind = F.lit(r"\b\s*[\])]?\s*(?:[:.\-]\s*|\n\s*)(?:(?:reason(?:ing)?|rationale)\s*[:\-]\s*)?([^\n]+)")
        found = F.transform(want, lambda i: F.struct(i.alias("id"), strip(F.call_function("regexp_extract", text, F.concat(named, i.cast("string"), behind), F.lit(1))).alias("reason")))
        return F.filter(found, lambda p: p["reason"] != "")

    return let(one, c, expected)


def frame_reasons(c: Column, expected: Column) -> Column:
    """{level, pairs} of the expected ids: 1 as they are, 2 shifted by a constant, 3 in order of appearance, 4 salvaged anywhere, 0 if nothing is found."""

    def one(text: Column, ps: Column, want: Column) -> Column:
        sure, loose = aligned(ps, want), salvaged(text, want)
        as_is = F.array_sort(ps["id"]) == F.array_sort(want)
        shifted = F.array_sort(F.transform(ps["id"], lambda i: i + F.array_min(want) - F.array_min(ps["id"]))) == F.array_sort(want)
        level = F.when(as_is, 1).when(shifted, 2).when(F.size(ps) == F.size(want), 3).when(F.size(loose) > 0, 4).otherwise(0)
        return F.struct(level.alias("level"), F.when(level <= 3, sure).otherwise(loose).alias("pairs"))

    return let(one, c, id_reasons(c), expected.cast("array<bigint>"))
