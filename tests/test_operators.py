"""Queries against SQL and brute force, plans, sources, streaming."""

import importlib
import itertools
import math
import os
import random
import subprocess
import sys
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rubrica.operators import metrics, queries, selection
from rubrica.plans import evaluate as E
from rubrica.sources import io
from rubrica.streaming import metrics as live

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = con.sql(sql).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols

    def plain(d):
        d = d[cols].copy()
        for c in cols:
            if not pd.api.types.is_numeric_dtype(d[c]) or pd.api.types.is_bool_dtype(d[c]):
                d[c] = d[c].map(lambda v: "~" if pd.isna(v) else str(v))
        return d.sort_values(cols).reset_index(drop=True)

    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False, rtol=1e-6)


@pytest.mark.parametrize("hidden", ["rubrica.llm", "tokenizers", "corpus_pipeline", "xxhash"])
def test_entry_works_without_the_text_operators(hidden):
    """In a process of its own, in which a module can't be imported, the core's queries are all there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    names = set(done.stdout.split())
    assert set(queries.queries()) <= names and "pipeline" not in names
    if hidden != "corpus_pipeline":
        assert names == set(queries.queries())


def test_entry(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    for n in (1, 4, 16):
        r = rows.repartition(n)
        got = r.groupBy("event_type").agg(metrics.stderr(F.col("value")).alias("s"), metrics.median("value").alias("m")).orderBy("event_type").collect()
        want = want if n > 1 else got  # noqa: F821
        assert all(math.isclose(a.s, b.s) and a.m == b.m for a, b in zip(got, want))


def test_small_cases(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (1.0,)], "x double")
    r = df.agg(F.avg("x").alias("m"), metrics.stderr(F.col("x")).alias("s")).first()
    assert (round(r.m, 6), round(r.s, 6)) == (0.666667, 0.333333)
    assert df.limit(1).agg(metrics.stderr(F.col("x")).alias("s")).first().s is None
    results = spark.createDataFrame([("a", "m", "none", 0.5, 0.1, 10, True), ("b", "m", "none", 1.0, 0.1, 30, False)], "task string, metric string, filter_key string, value double, stderr double, n long, higher_is_better boolean")
    members = spark.createDataFrame([("g", "a"), ("g", "b")], "group string, member string")
    assert metrics.roll_up(results, members).first().value == 0.875
    assert metrics.roll_up(results, members, weighted=False).first().value == 0.75
    assert metrics.roll_up(results, members).first().higher_is_better is None
    assert spark.range(1).select(selection.uniform_indices(F.lit(10), 4).alias("x")).first().x == [0, 3, 6, 9]
    wer = spark.createDataFrame([("a b c d".split(), "a x c".split())], "g array<string>, p array<string>")
    from rubrica.functions.text import token_distance

    assert wer.agg(metrics.error_rate(token_distance(F.col("p"), F.col("g")), F.size("g")).alias("w")).first().w == 50.0
    four = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 1)], "k int, s int")
    g = metrics.group_2x2(four, F.col("s"), F.col("k"), F.lit(0)).first()
    assert (g.q_acc, g.i_acc, g.acc, g.g_acc) == (0, 0, 0.5, 0)
    s = E.multiple_choice_scores(F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0)), F.array(F.lit("aa"), F.lit("b"), F.lit("c")), F.lit(1))
    assert spark.range(1).select(s["acc"].alias("x")).first().x == 1.0


def test_k_center_is_greedy(spark):
    rng = random.Random(0)
    pts = [[rng.random() for _ in range(3)] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(pts)), "vec_id long, embedding array<double>")
    got = [r.id for r in selection.k_center(df, 12).orderBy("step").collect()]
    picked, d = [0], [math.inf] * 60
    while len(picked) < 12:
        d = [min(a, math.dist(p, pts[picked[-1]])) for a, p in zip(d, pts)]
        picked.append(max(range(60), key=lambda i: (d[i], -i)))
    assert got == picked


def test_bootstrap_is_near_the_closed_form(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 4 == 0).cast("double").alias("x"))
    r = metrics.bootstrap(df, F.col("x"), resamples=400).first()
    assert abs(r.mean - 0.25) < 1e-9 and abs(r.stderr - math.sqrt(0.25 * 0.75 / 2000)) < 0.0015 and r.low < 0.25 < r.high


def test_elo_order(spark):
    rows = [(a, b, "a" if a < b or i % 4 == 0 else "b") for a, b in itertools.permutations("xyz", 2) for i in range(20)]
    r = {x.model: x.rating for x in metrics.elo_ratings(spark.createDataFrame(rows, "a string, b string, w string"), "a", "b", "w", "z").collect()}
    assert r["x"] > r["y"] > r["z"] == 1000


def test_fewshot(spark):
    pool = spark.createDataFrame([(i, f"t{i}") for i in range(30)], "doc_id long, text string")
    rows = selection.fewshot_random(pool, pool, 4).collect()
    assert len(rows) == 30
    for r in rows:
        ids = [s.doc_id for s in r.shots]
        assert len(set(ids)) == 4 and r.doc_id not in ids
    assert len({tuple(s.doc_id for s in r.shots) for r in rows}) > 5


def test_fewshot_draws_from_the_whole_pool(spark):
    pool = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "doc_id long, text string")
    rows = selection.fewshot_random(pool, pool, 4).collect()
    assert len(rows) == 400
    drawn = Counter(s.doc_id for r in rows for s in r.shots)
    for r in rows:
        ids = {s.doc_id for s in r.shots}
        assert len(ids) == len(r.shots) == 4 and r.doc_id not in ids
    # each is drawn 4 times on average; with 400 rows of 4 draws about 7 are never drawn
    assert len(drawn) > 380 and max(drawn.values()) < 20
    small = pool.limit(3)
    assert all({s.doc_id for s in r.shots} == {0, 1, 2} - {r.doc_id} for r in selection.fewshot_random(small, small, 4).collect())
    assert [r.shots for r in selection.fewshot_random(small, pool.limit(0), 4).collect()] == [[], [], []]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t", 0, "d", ["a"], ["a"], 1.5, 10), ("t", 1, "d", ["b"], ["c"], 2.0, 20)], "task string, doc_id long, doc string, resps array<string>, filtered_resps array<string>, target double, log_time long")
    io.write_samples(df, str(tmp_path / "s"))
    back = spark.read.json(str(tmp_path / "s")).orderBy("doc_id").collect()
    assert "doc" not in back[0].asDict() and back[0].target == "1.5" and back[1].resps == ["b"]
    assert back[0].asDict().get("resps") is None
    io.write_submission(df.select("task", "doc_id"), str(tmp_path / "c"), "csv")
    assert io.read_table(spark, str(tmp_path / "c"), "csv").count() == 2
    (tmp_path / "v1.json").write_text('{"frames": {"0": {"frame_index": 0, "ts": 0.5, "caption": "c"}}}')
    assert io.captions(spark, str(tmp_path / "v1.json")).first() == ("v1", 0, 0.5, "c")
    logs = df.unionByName(df.withColumn("log_time", F.col("log_time") + 5).withColumn("target", F.lit(9.0)))
    assert {r.target for r in io.replayed(logs).collect()} == {9.0}
    assert spark.range(1).select(io.parsed_list(F.lit("['a', 'b']")).alias("x")).first().x == ["a", "b"]
    a, b = (io.task_hashes(df.repartition(n)).first().task_hash for n in (1, 3))
    assert a == b
    files = io.media_files(spark, [str(tmp_path)], "*.json")
    ids = spark.createDataFrame([("v1",), ("v2",)], "video string")
    assert [r.video for r in io.with_files(ids, files, "video").collect()] == ["v1"]
    assert io.without_media(spark.sql("select 1 as a, cast('x' as binary) as b")).columns == ["a"]


def test_plan_from_yaml(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("output_type: generate_until\ndoc_to_text: 'Q: {{ q }}'\nversion: '1'\n")
    (tmp_path / "child.yaml").write_text("include: base.yaml\ntask: child\ndoc_to_target: a\ntag: [x]\n")
    (tmp_path / "g.yaml").write_text("group: g\ntask: [child]\n")
    assert [(n, k) for n, k, _ in E.task_index(str(tmp_path))] == [("child", "task"), ("g", "group"), ("x", "tag")]
    task = E.task_from(E.load_yaml(str(tmp_path / "child.yaml")))
    task = E.Task(**{**task.__dict__, "scores": {"exact_match": lambda r, g: (r == g).cast("double")}})
    docs = spark.createDataFrame([(0, "1+1", "2"), (1, "2+2", "4")], "doc_id long, q string, a string")
    assert {r.prompt for r in E.instances(docs, task).collect()} == {"Q: 1+1", "Q: 2+2"}
    resp = spark.createDataFrame([("child", 0, 0, 0, "2"), ("child", 1, 0, 0, "5")], "task string, doc_id long, idx int, repeat int, resp string")
    out = E.evaluate(docs, resp, task)
    assert out.first().value == 0.5
    assert "| child | 1 | none | 0 | exact_match | ↑ | 0.5000 |" in io.markdown(out)
    mc = E.Task("mc", "multiple_choice", "q", "a", "{{ opts }}")
    both = E.instances(docs.withColumn("opts", F.array(F.lit("2"), F.lit("4"))), mc, mutual_info=True)
    assert both.count() == 8
    judged = E.judged(docs.select(F.col("doc_id").alias("request_id")), E.ask(E.judge_prompts(docs.select(F.col("doc_id").alias("request_id"), "q"), "Rate {{ q }}")), lambda c: c.try_cast("int"))
    assert {r.score for r in judged.collect()} == {1}


def test_streaming_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = live.run_to_table(live.windowed_means(stream, "ts", "value", "event_type"), "live", str(tmp_path / "cp"), "complete")
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("live").collect()}
    want = {(r.start, r.event_type): r.n for r in live.windowed_means(events, "ts", "value", "event_type").collect()}
    assert got == want


def test_argument_strings_and_settings_for_a_model():
    from rubrica.plans import evaluate as E

    assert E.parse_arguments(" a=1,b=True,,c=0.5,d=x=y,e=-2 ") == {"a": 1, "b": True, "c": 0.5, "d": "x=y", "e": -2}
    assert E.parse_arguments("  ") == {}
    several = {"pre": "p", "default": {"post": "d"}, "m": {"post": "m"}}
    assert E.settings_for("m", several) == {"post": "m"}
    assert E.settings_for("other", several) == {"pre": "p", "post": "d"}
    assert E.settings_for("other", None) == {}


def test_judge_batches_keep_their_order(spark):
    from rubrica.plans import evaluate as E

    E.PROVIDERS["echo"] = lambda prompts: [p + "!" for p in prompts]
    try:
        rows = E.ask(spark.range(0, 50, 1, 2).selectExpr("id", "cast(id as string) as judge_prompt"), "echo", batch=3).collect()
    finally:
        del E.PROVIDERS["echo"]
    assert len(rows) == 50 and all(r.judge_response == f"{r.id}!" for r in rows)


def test_task_files_with_metric_lists(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("""
task: letters
output_type: generate_until
doc_to_text: "Q: {{ q }}"
doc_to_target: golds
num_fewshot: 2
fewshot_config: {sampler: first_n}
process_docs: !function longer
metric_list:
  - metric: exact_match
    aggregation: mean
    higher_is_better: true
    ignore_case: true
    regexes_to_ignore: ["[.]"]
  - metric: anls
    aggregation: !function best
""")
    task = E.task_from(E.load_yaml(str(tmp_path / "t.yaml"), {"longer": lambda d: d.where("doc_id < 3"), "best": F.max}))
    assert task.fewshot == 2 and task.sampler == "first_n" and [m.name for m in task.metric_list()] == ["exact_match", "anls"]
    docs = spark.createDataFrame([(0, "a", ["x", "Y"]), (1, "b", ["z"]), (2, "c", ["abcd"]), (3, "d", ["w"])], "doc_id long, q string, golds array<string>")
    prompts = {r.doc_id: r.prompt for r in E.instances(docs, E.Task(**{**task.__dict__, "doc_to_target": "q"})).collect()}
    assert prompts[2] == "Q: a a\n\nQ: b b\n\nQ: c" and set(prompts) == {0, 1, 2}
    resp = spark.createDataFrame([("letters", i, 0, 0, r) for i, r in enumerate((" y. ", "x", "abcx", "w"))], "task string, doc_id long, idx int, repeat int, resp string")
    got = {r.metric: (r.value, r.stderr, r.n, r.n_shot) for r in E.evaluate(docs, resp, task).collect()}
    assert got["exact_match"] == (pytest.approx(1 / 3), pytest.approx(1 / 3), 3, 2)
    assert got["anls"] == (0.75, None, 3, 2)
    with pytest.raises(ValueError, match="no scorer"):
        E.evaluate(docs, resp, E.Task("letters", doc_to_target="golds", metrics=("unheard_of",)))


def test_choices_by_text_and_out_of_range(spark):
    docs = spark.createDataFrame([(0, "b"), (1, "zz"), (2, "a")], "doc_id long, answer string")
    resp = spark.createDataFrame([("t", d, i, l, g) for d, ls in ((0, (2.0, 1.0)), (1, (1.0, 2.0)), (2, (1.0, 1.0))) for i, (l, g) in enumerate(zip(ls, (True, False)))], "task string, doc_id long, idx int, loss double, greedy boolean")
    task = E.Task("t", "multiple_choice", "?", "answer", ("a", "b"), metrics=("acc", "exact_match"))
    got = {r.metric: r.value for r in E.evaluate(docs, resp, task).collect()}
    assert got == {"acc": pytest.approx(2 / 3), "exact_match": pytest.approx(1 / 3)}


def test_random_shots_stand_in_prompts(spark):
    docs = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(12)], "doc_id long, q string, a string")
    task = E.Task("t", doc_to_text="{{ q }}?", doc_to_target="a", fewshot=3, description="D: ")
    for r in E.instances(docs, task).collect():
        *shots, own = r.prompt.removeprefix("D: ").split("\n\n")
        assert len(shots) == 3 and own == f"q{r.doc_id}?" and f"q{r.doc_id}? a{r.doc_id}" not in shots
        assert all(s.split("? a")[0][1:] == s.split("? a")[1] for s in shots)


def test_bleu_of_several_references_and_mcc_of_classes(spark):
    df = spark.createDataFrame([("the the the the the the the".split(), ["the cat is on the mat".split(), "there is a cat on the mat".split()])], "p array<string>, g array<array<string>>")
    r = df.agg(metrics.bleu_of(metrics.precision_parts(F.col("p"), F.col("g"), 1), 1).alias("b")).first()
    assert r.b == pytest.approx(100 * 2 / 7)
    pairs = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 2)], "g int, p int")
    assert pairs.agg(metrics.matthews_classes(F.col("g"), F.col("p"), 3).alias("m")).first().m == pytest.approx((3 * 4 - 5) / math.sqrt((16 - 6) * (16 - 6)))


def test_parts_and_positions_without_groups(spark):
    df = spark.range(0, 103).select(F.col("id"), (F.col("id") * 37 % 103).alias("k"))
    rows = selection.divide(df, 7, ["k"]).collect()
    want = Counter(min(k // 15, 5) if k < 75 else 5 + (k - 75) // 14 for k in range(103))
    assert Counter(r.part for r in rows) == want
    assert all((r.part <= s.part) == (r.k <= s.k) or r.part == s.part for r in rows for s in rows[:5])
    assert {r.k: r.chunk for r in selection.chunks(df, 10, ["k"]).collect()} == {k: k // 10 for k in range(103)}
    assert selection.divide(df.limit(0), 3, ["k"]).count() == 0


def test_closure_of_any_depth_and_circles(spark):
    chain = [(f"g{i}", f"g{i + 1}") for i in range(20)] + [("g20", "g18")]
    got = {(r.group, r.member): r.depth for r in metrics.closure(spark.createDataFrame(chain, "group string, member string")).collect()}
    assert got["g0", "g20"] == 20 and got["g19", "g18"] == 2 and ("g20", "g20") not in got
    assert len(got) == sum(range(1, 21)) + 3


def test_archives_plugins_and_paths(spark, tmp_path, monkeypatch):
    import tarfile
    import zipfile

    from rubrica import plugins
    from rubrica.functions import filters

    (tmp_path / "a.txt").write_text("A")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(tmp_path / "a.txt", "d/a.txt")
    with tarfile.open(tmp_path / "w.tar", "w") as t:
        t.add(tmp_path / "a.txt", "b.txt")
    raw = (tmp_path / "w.tar").read_bytes()
    (tmp_path / "p.tar.part0").write_bytes(raw[:300])
    (tmp_path / "p.tar.part1").write_bytes(raw[300:])
    out = io.unpacked([str(tmp_path / n) for n in ("z.zip", "p.tar.part1", "p.tar.part0")], str(tmp_path / "out"))
    assert [os.path.relpath(p, tmp_path / "out") for p in out] == ["p/b.txt", "z/d/a.txt"]
    assert io.media_files(spark, [str(tmp_path / "out")]).count() == 2
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x", "x")
    with pytest.raises(ValueError):
        io.unpacked([str(tmp_path / "bad.zip")], str(tmp_path / "out"))
    (tmp_path / "brought.py").write_text("from rubrica.functions import filters\n\n@filters.register('brought')\ndef brought():\n    return lambda r: r\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setenv("RUBRICA_PLUGINS", "brought")
    assert plugins.load() == ["brought"] and "brought" in filters.FILTERS


def test_poisson_counts(spark):
    for mean in (0.5, 7.0, 300.0):
        r = spark.range(4000).select(metrics.poisson(F.lit(mean), F.col("id")).alias("x")).agg(F.avg("x").alias("m"), F.var_samp("x").alias("v")).first()
        assert abs(r.m - mean) < 4 * math.sqrt(mean / 4000) and abs(r.v / mean - 1) < 0.12


def test_math_answers(spark):
    from rubrica.functions import text as T

    for a, b, same in ((r"\frac{1}{2}", "0.5", 1.0), (r"-\dfrac{3}{4}", "-0.75", 1.0), ("1,200", "1200", 1.0), (r"50\%", "0.5", 1.0), ("3/4", ".75", 1.0), (r"x + 1", "x+1", 1.0), (r"\text{blue}", "Blue", 1.0), ("2", "3", 0.0), ("", "1", 0.0)):
        assert spark.range(1).select(T.math_equal(F.lit(a), F.lit(b)).alias("x")).first().x == same, (a, b)
