"""Hand-computed cases and properties of the row-level functions."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rubrica.functions import arrow, extract, filters, geometry, instructions, template
from rubrica.functions import text as T


def one(spark, column, **values):
    """A column's value over one row of literal columns."""
    df = spark.range(1).select(*([F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for v in values.values()] or [F.lit(1)]))
    return df.toDF(*(values or ["_"])).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*map(F.lit, xs))


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: F.levenshtein(F.lit("kitten"), F.lit("sitting")), 3),
        (lambda: T.anls(F.lit("abcx"), arr("abcd")), 0.75),
        (lambda: T.anls(F.lit("xy"), arr("ab")), 0.0),
        (lambda: T.anls_strict(F.lit(" None "), arr("none")), 0.0),
        (lambda: T.anls_strict(F.lit("ABCX"), arr("zzzz", "abcd")), 0.75),
        (lambda: T.token_f1(F.lit("the cat sat"), F.lit("cat sat down")), 0.8),
        (lambda: T.token_f1(F.lit(""), F.lit("the")), 1.0),
        (lambda: T.relaxed_match(F.lit("104"), F.lit("100")), 1.0),
        (lambda: T.relaxed_match(F.lit("106"), F.lit("100")), 0.0),
        (lambda: T.relaxed_match(F.lit("50%"), F.lit("0.5")), 1.0),
        (lambda: T.relaxed_match(F.lit("0.0"), F.lit("0")), 0.0),
        (lambda: T.relaxed_match(F.lit("5d"), F.lit("5D")), 1.0),
        (lambda: T.relative_accuracy(F.lit(100.0), F.lit(100.0)), 1.0),
        (lambda: T.vqa_accuracy(F.lit("a"), arr("a", "a", "a", "b")), (3 * 2 / 3 + 1) / 4),
        (lambda: T.vqa_normalise(F.lit("The  two dogs, (3.5).")), "2 dogs 3.5"),
        (lambda: T.token_distance(arr("a", "b", "c", "d"), arr("a", "x", "c")), 2),
        (lambda: T.common_prefix_ratio(arr("a", "b", "c"), arr("a", "b", "x", "y")), 0.5),
        (lambda: T.exact_match(F.lit("It's 5!"), F.lit("ITS "), ignore_case=True, ignore_punctuation=True, ignore_numbers=True), 1.0),
        (lambda: T.any_match(lambda g: T.exact_match(F.lit("b"), g), arr("a", "b")), 1.0),
        (lambda: F.array_join(T.ngrams(arr("a", "b", "c"), 2), "|"), "a b|b c"),
        (lambda: F.size(T.ngrams(arr("a"), 2)), 0),
        (lambda: geometry.box_iou(arr(0.0, 0.0, 2.0, 2.0), arr(1.0, 1.0, 3.0, 3.0)), 1 / 7),
        (lambda: geometry.box_iou(arr(0.0, 0.0, 0.0, 0.0), arr(0.0, 0.0, 0.0, 0.0)), 0.0),
        (lambda: geometry.interval_iou(arr(0.0, 10.0), arr(5.0, 15.0)), pytest.approx(1 / 3)),
        (lambda: geometry.great_circle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), pytest.approx(math.pi * 6371)),
        (lambda: extract.regex_group(F.lit("#### 12 and #### 1,300"), r"#### (\-?[0-9\.\,]+)"), "12"),
        (lambda: extract.regex_group(F.lit("#### 12 and #### 1,300"), r"#### (\-?[0-9\.\,]+)", -1), "1,300"),
        (lambda: extract.regex_group(F.lit("nothing"), r"#### (\-?[0-9\.\,]+)"), "[invalid]"),
        (lambda: extract.choice_letter(F.lit("The answer is (B) because A is wrong")), "B"),
        (lambda: extract.choice_letter(F.lit("C. dog")), "C"),
        (lambda: extract.choice_letter(F.lit("none of it")), None),
        (lambda: extract.choice_by_text(F.lit("It is a red apple"), arr("apple", "red apple", "pear")), "B"),
        (lambda: extract.yes_no_first(F.lit("Well, no; yes")), "no"),
        (lambda: extract.yes_no_prefix(F.lit(" YES!")), "yes"),
        (lambda: extract.boxed(F.lit(r"so \boxed{1} or \boxed{\frac{a}{b}}")), r"\frac{a}{b}"),
        (lambda: extract.last_number(F.lit("first 3 then 1,204.5.")), 1204.5),
        (lambda: F.array_join(extract.interval(F.lit("from 12.5 to 20 seconds")).cast("array<string>"), ","), "12.5,20.0"),
        (lambda: F.array_join(extract.interval(F.lit("00:01:05 - 01:20")).cast("array<string>"), ","), "65.0,80.0"),
        (lambda: extract.interval(F.lit("20 to 10")), None),
        (lambda: F.array_join(extract.box(F.lit("box [1, 2.5, 3, 4]")).cast("array<string>"), ","), "1.0,2.5,3.0,4.0"),
        (lambda: F.array_join(extract.box(F.lit("none")).cast("array<string>"), ","), "0.0,0.0,0.0,0.0"),
        (lambda: extract.reasoning_answer(F.lit("<think>x</think> <answer> 42 </answer>")), "42"),
        (lambda: extract.reasoning_answer(F.lit("<think>x</think>\n7")), "7"),
        (lambda: F.array_join(extract.id_list(F.lit("20-21, 97..99, 20")).cast("array<string>"), ","), "20,21,97,98,99"),
        (lambda: extract.clock(F.lit(65.9)), "1:05"),
        (lambda: extract.judge_binary(F.lit("10")), 1),
        (lambda: extract.judge_binary(F.lit("10"), strict=True), 0),
        (lambda: extract.judge_score(F.lit("Score: 12/10"), 0.0, 10.0), 10.0),
        (lambda: extract.judge_score(F.lit("bad"), 1.0, 10.0), 1.0),
        (lambda: F.array_join(extract.judge_pair(F.lit("8 7.5\n3 4")).cast("array<string>"), ","), "8.0,7.5"),
        (lambda: F.array_join(extract.judge_pair(F.lit("8\n3 4")).cast("array<string>"), ","), "-1.0,-1.0"),
        (lambda: extract.judge_json(F.lit('x {"a": {"b": 1}} y')), '{"a": {"b": 1}}'),
        (lambda: filters.majority(arr("b", "a", "a", "b")), "b"),
        (lambda: arrow.damerau_levenshtein(F.lit("abcd"), F.lit("acbd")), 1),
        (lambda: arrow.lcs(arr("a", "b", "c", "d"), arr("b", "d", "a")), 2),
        (lambda: arrow.tree_similarity(F.lit('{"name":"a","children":[{"name":"b"},{"name":"c"}]}'), F.lit('{"name":"a","children":[{"name":"b"}]}')), pytest.approx(2 / 3)),
        (lambda: arrow.tree_similarity(F.lit("no json"), F.lit("{}")), 0.0),
    ],
)
def test_hand_computed(spark, column, want):
    assert one(spark, column()) == want


def test_filters(spark):
    df = spark.createDataFrame([(1, [" (A) yes", "B"])], "doc_id int, resps array<string>")
    pipes = {"none": ["take_first"], "low": ["take_first", "lowercase", "remove_whitespace"], "mc": ["multi_choice_regex"], "k": [("take_first_k", {"k": 2}), "uppercase"], "vote": ["majority_vote"]}
    got = {r.filter_key: r.resp for r in filters.apply_pipelines(df, pipes).collect()}
    assert got == {"none": [" (A) yes"], "low": ["(a) yes"], "mc": ["(A)", "[invalid]"], "k": [" (A) YES", "B"], "vote": [" (A) yes"]}
    with pytest.raises(Exception, match="fewer than 3"):
        filters.apply_pipelines(df, {"k": [("take_first_k", {"k": 3})]}).collect()
    with pytest.raises(ValueError):
        filters.register("map")(lambda: None)


def test_templates(spark):
    df = spark.sql("select 'Q ' as question, array('x','y') as choices, named_struct('b', 'deep') as a, 1 as answer, 'y' as gold")
    row = df.select(
        template.render("{{ question.strip() }}: {{choices[0]}} {{ a.b | upper }} {{ choices[answer] }} {{ choices.index(gold) }} {{ choices | join(', ') }}{{ question | regex_replace('Q', 'R') }}").alias("t"),
        template.resolve("gold", df.columns).alias("g"),
    ).first()
    assert row == ("Q: x DEEP y 1 x, yR ", "y")
    with pytest.raises(Exception, match="missing"):
        df.select(template.render("{{ missing }}")).collect()
    with pytest.raises(ValueError):
        template.render("{% if x %}")


@pytest.mark.parametrize(
    "name, arguments, good, bad",
    [
        ("keywords:existence", {"keywords": ["cat"]}, "A Cat.", "A dog."),
        ("keywords:forbidden_words", {"forbidden_words": ["cat"]}, "concatenate", "the CAT"),
        ("keywords:frequency", {"keyword": "cat", "frequency": 2, "relation": "at least"}, "cat cat", "cat"),
        ("keywords:letter_frequency", {"letter": "z", "let_frequency": 2, "let_relation": "less than"}, "z", "zZ"),
        ("length_constraints:number_words", {"num_words": 3, "relation": "less than"}, "one two", "one two three"),
        ("length_constraints:number_sentences", {"num_sentences": 2, "relation": "at least"}, "One. Two!", "One."),
        ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "a\n***\nb", "a\nb"),
        ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "so"}, "a\n\nSo, b", "a\n\nb"),
        ("detectable_content:number_placeholders", {"num_placeholders": 2}, "[a] [b]", "[a]"),
        ("detectable_content:postscript", {"postscript_marker": "P.S."}, "x\nP.S. y", "x"),
        ("detectable_format:number_bullet_lists", {"num_bullets": 2}, "* a\n- b", "* a"),
        ("detectable_format:constrained_response", {}, "My answer is yes.", "yes"),
        ("detectable_format:number_highlighted_sections", {"num_highlights": 1}, "*a*", "a"),
        ("detectable_format:multiple_sections", {"section_spliter": "Section", "num_sections": 2}, "Section 1 a Section 2 b", "Section 1 a"),
        ("detectable_format:json_format", {}, '```json\n{"a": 1}\n```', "a: 1"),
        ("detectable_format:title", {}, "<<A title>>", "<<>>"),
        ("combination:two_responses", {}, "a\n******\nb", "a\n******\na"),
        ("combination:repeat_prompt", {"prompt_to_repeat": "Say it"}, "say it: yes", "yes"),
        ("startend:end_checker", {"end_phrase": "The end."}, "x. THE END.", "x."),
        ("startend:quotation", {}, '"quoted"', "not"),
        ("change_case:capital_word_frequency", {"capital_frequency": 2, "capital_relation": "at least"}, "AB CD e", "AB c"),
        ("change_case:english_capital", {}, "ABC 1", "Abc"),
        ("change_case:english_lowercase", {}, "abc 1", "Abc"),
        ("punctuation:no_comma", {}, "a b", "a, b"),
        ("keywords:key_sentences", {"key_sentences": ["So it is.", "Yes."], "num_sentences": 1}, "Well. So it is.", "So it is. Yes."),
        ("detectable_format:rephrase", {"original_message": "I *see* it"}, "I *do not see* it", "You *see* it"),
        ("detectable_content:rephrase_paragraph", {"original_paragraph": "The sea, the sky", "low": 2, "high": 3}, "the THE sky", "the sand"),
        ("multi-turn:constrained_start", {"starter": "I think"}, "Hm.\n I think so", "So I think"),
        ("language:response_language", {"language": "ru"}, "привет мир", "hello"),
    ],
)
def test_instructions(spark, name, arguments, good, bad):
    assert one(spark, instructions.follows(F.lit(good), name, **arguments)) is True
    assert one(spark, instructions.follows(F.lit(bad), name, **arguments)) is False
    assert one(spark, instructions.follows(F.lit(" "), name, **arguments)) is False


def test_loose_instructions(spark):
    assert one(spark, instructions.follows(F.lit("Sure, here:\nabc"), "punctuation:no_comma")) is False
    assert one(spark, instructions.follows(F.lit("Sure, here:\nabc"), "punctuation:no_comma", loose=True)) is True


words = st.lists(st.sampled_from("abcde"), max_size=12)


@given(st.lists(st.tuples(words, words), min_size=1, max_size=40))
@settings(max_examples=4, deadline=None)
def test_sequence_distances_against_tables(spark, rows):
    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return row[-1]

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = df.select("i", T.token_distance(F.col("a"), F.col("b")).alias("d"), arrow.lcs("a", "b").alias("l"), T.set_scores(F.col("a"), F.col("b"))["f1"].alias("f"), T.f1(T.overlap(F.col("a"), F.col("b")), F.size("a"), F.size("b")).alias("g")).collect()
    for r in got:
        a, b = rows[r.i]
        assert (r.d, r.l) == (edit(a, b), common(a, b))
        assert 0 <= r.f <= 1 and 0 <= r.g <= 1


def test_tree_distance_of_random_trees():
    from functools import cache

    def parse(t):
        return (t["name"], tuple(parse(c) for c in t.get("children", [])))

    @cache
    def forest(f, g):
        if not f and not g:
            return 0
        size = lambda xs: sum(1 + size(c) for _, c in xs)
        if not f or not g:
            return size(f or g)
        (a, ca), (b, cb) = f[-1], g[-1]
        return min(forest(f[:-1] + ca, g) + 1, forest(f, g[:-1] + cb) + 1, forest(ca, cb) + forest(f[:-1], g[:-1]) + (a != b))

    import random

    rng = random.Random(3)

    def tree(n):
        t = {"name": rng.choice("ab"), "children": []}
        while n > 1:
            k = rng.randint(1, n - 1)
            t["children"].append(tree(k))
            n -= k
        return t

    for _ in range(60):
        a, b = tree(rng.randint(1, 7)), tree(rng.randint(1, 7))
        assert arrow.tree_distance(a, b) == forest((parse(a),), (parse(b),)), json.dumps([a, b])


@pytest.mark.parametrize(
    "hyp, ref, edits",
    [
        ("a b c", "a b c", 0),
        ("", "a b", 2),
        ("a b", "", 2),
        ("c d a b", "a b c d", 1),  # one move
        ("x c d a b", "a b c d", 2),  # a move and a deletion
        ("this week the saudis denied information published in the times", "saudi arabia denied this week information published in the american times", 4),
    ],
)
def test_translation_edits(spark, hyp, ref, edits):
    assert arrow.ter_edits(hyp.split(), ref.split()) == edits
    words = lambda s: F.split(F.lit(s), " ") if s else F.array().cast("array<string>")
    assert one(spark, arrow.translation_edits(words(hyp), words(ref))) == edits


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        up, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(up[j - 1] + (x != y), up[j] + 1, row[j - 1] + 1))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=8), st.lists(st.sampled_from("abcd"), max_size=8))
def test_translation_edits_lie_between_bounds(hyp, ref):
    """Never more than plain edits; never less than the least moves and edits, found by brute force on short texts."""
    edits, plain = arrow.ter_edits(hyp, ref), plain_edits(hyp, ref)
    common = sum(min(hyp.count(w), ref.count(w)) for w in set(hyp))
    assert max(len(hyp), len(ref)) - common <= edits <= plain
    assert (edits == 0) == (hyp == ref)
    found, columns = arrow._columns(hyp, arrow._bits(ref), len(ref))
    assert found == plain
    # the alignment: right words are pairs in order, and cost what the distance says
    wrong_h, wrong_r, before = arrow._anchors(hyp, ref, columns)
    right = [j for j in range(len(ref)) if not wrong_r[j]]
    assert [hyp[before[j]] for j in right] == [ref[j] for j in right] and sum(not w for w in wrong_h) == len(right)
    ends = [(-1, -1), *((before[j], j) for j in right), (len(hyp), len(ref))]
    assert sum(max(i2 - i1, j2 - j1) - 1 for (i1, j1), (i2, j2) in zip(ends, ends[1:])) == plain


def test_moves_match_brute_force():
    """One step saves as much as the best of all moves of a span to a place where it stands in the reference."""
    import random

    rng = random.Random(5)
    for _ in range(150):
        ref = [rng.choice("abcdef") for _ in range(rng.randint(1, 7))]
        hyp = [rng.choice("abcdef") for _ in range(rng.randint(1, 7))]
        saved, moved = arrow._best_shift(hyp, ref)
        distance = lambda x: plain_edits(x, ref)
        every = [rest[:k] + span + rest[k:] for rest, span in ((hyp[:i] + hyp[j:], hyp[i:j]) for i in range(len(hyp)) for j in range(i + 1, len(hyp) + 1)) for k in range(len(rest) + 1)]
        assert saved == distance(hyp) - distance(moved) and sorted(moved) == sorted(hyp)
        assert 0 <= saved <= max(distance(hyp) - distance(m) for m in every)


def test_sequence_errors(spark):
    points = lambda *ps: F.array(*(arr(*p) for p in ps))
    assert one(spark, geometry.keypoint_similarity(points((0.0, 0.0), (1.0, 1.0)), points((0.0, 0.0), (1.0, 1.0)))) == 1
    assert one(spark, geometry.keypoint_similarity(points((0.0, 0.0), (0.0, 0.0)), points((0.0, 0.0), (1.0, 1.0)))) == pytest.approx((1 + math.exp(-10)) / 2)
    assert one(spark, geometry.keypoint_similarity(points((0.0, 0.0)), points((0.0, 0.0), (1.0, 1.0)))) == 0
    assert one(spark, T.rescaled_error(arr(0.05, 0.05), arr(0.0, 0.0))) == pytest.approx(0.5)
    assert one(spark, T.rescaled_error(arr(1.0), arr(0.0))) == 0
    assert one(spark, T.rescaled_error(arr(1.0, 2.0), arr(0.0))) == 0
