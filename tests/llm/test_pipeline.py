"""Every stage of the pipeline against brute force, each on its own input."""

import os
from collections import Counter, defaultdict

import corpus_pipeline
from test_llm import check_packing, classes_slow, simhash_slow, water, words


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    tables = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.Workspace(spark, "t").keep(stage(spark, docs, sf), name)
        assert docs.columns == columns
        tables[name] = docs.collect()
    every = spark.read.parquet(f"{sf}/documents.parquet").collect()

    good = {r.doc_id for r in tables["quality"]}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(d in good for d, q in quality.items() if q) >= 0.99 * sum(q for q in quality.values())
    assert sum(d in good for d, q in quality.items() if not q) <= 0.2 * sum(not q for q in quality.values())

    last = {}
    for r in tables["quality"]:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in tables["exact_dedup"]) == sorted(last.values())

    classes = classes_slow({r.doc_id: simhash_slow(r.text) for r in tables["exact_dedup"]})
    assert sorted(r.doc_id for r in tables["near_dedup"]) == sorted(set(classes.values()))

    sizes, taken, largest = Counter(), Counter(), defaultdict(int)
    for r in tables["near_dedup"]:
        n = len(words(r.text))
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    for r in tables["mix"]:
        taken[r.source] += len(words(r.text))
    assert all(abs(taken[s] - t) <= largest[s] for s, t in water(sizes).items())
    assert max(Counter(r.doc_id for r in tables["mix"]).values()) <= 2

    texts = defaultdict(list)
    for r in tables["mix"]:
        texts[r.doc_id].append(r.text)
    n, total = check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), texts)
    assert n <= 1.03 * total / 2048 + 1
    assert len(every) >= len(good)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_edge_cases_of_every_stage(spark, tmp_path):
    """Null, empty, repeated, very long and clashing rows, and an empty table, through all stages."""
    words = [" ".join(f"{a}{i}." for a in ("The", "river", "runs", "past", "mill", "and")) for i in range(40)]
    rows = [(i, " ".join(words[i % 40 :] + words[: i % 7]), "en", f"s{i % 3}" if i % 5 else None, i, "x", "y", 1, 2) for i in range(60)]
    rows += [(None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (100, "", "en", "s0", 1, "x", "y", 1, 2), (101, " \n ", "en", "s0", 1, "x", "y", 1, 2)]
    rows += [(7, rows[7][1], "en", "s1", 7, "other", "y", 1, 2), (102, "word " * 100_000, "en", "s2", 1, "x", "y", 1, 2), (103, rows[7][1], "en", "s1", 7, "x", "y", 1, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, shards string, h long, block long"
    whole = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(60)] + [(None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    for docs in (whole, whole.limit(0)):
        folder = str(tmp_path / f"t{docs.count()}")
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        kept = {}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.Workspace(spark, "t").keep(stage(spark, docs, folder), name)
            assert docs.columns == whole.columns
            kept[name] = [tuple(r) for r in docs.collect()]
            assert set(kept[name]) <= set(rows)
        texts = Counter(r[1] or "" for r in kept["exact_dedup"])
        assert set(texts) == {r[1] or "" for r in kept["quality"]} and all(n == 1 for n in texts.values())
        if kept["quality"]:
            assert all(max((r[0] for r in kept["quality"] if (r[1] or "") == t and r[0] is not None), default=None) in {r[0] for r in kept["exact_dedup"] if (r[1] or "") == t} for t in texts)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
        assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in kept["mix"])
        assert Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == Counter(r.doc_id for r in packed)


def test_run_leaves_only_what_its_result_reads(spark, sf_dir):
    root = corpus_pipeline.Workspace(spark, "t").root.rpartition("/")[0].removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    corpus_pipeline.run(spark, sf_dir).count()
    made = set(os.listdir(root)) - before
    assert sorted(m.partition("-")[0] for m in made) == ["packing", "pipeline"]
    assert [d.partition("-")[2] for m in made if m.startswith("pipeline") for d in os.listdir(f"{root}/{m}")] == ["mix"]
