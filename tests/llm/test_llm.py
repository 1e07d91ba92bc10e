"""The text operators against brute force, on small fixtures and the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rubrica.llm import common, exact, html_text, licenses, mixing, packing, quality, queries, rules, sharding, simhash, tokens

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "Lorem ipsum dolor, sit amet! " * 4000
TEXTS = [
    "", None, " \t\n ", "a", "A b", "the cat sat on the mat", "the cat sat on the mat", "The cat sat on the mat", LONG, LONG, LONG + "x",
    "naïve Straße — “quoted” 文字 ﬁ́", "<|endoftext|> in a text <|startoftext|>", "x" * 5000, "1234567890 " * 50, "é́ Σίσυφος İ", "a b\x85c\x1cd", "it's we'll 'S\n\n  end  \n",
    "Released under the MIT License.", "line\nline\nline\n\nother",
]
ROWS = [(i, t, ("en", "fr", None)[i % 3], ("s0", "s0", "s1", None, "s2")[i % 5], 7.0, "clash") for i, t in enumerate(TEXTS)]
ROWS += [(3, "a", "en", "s0", 1.0, "again"), (3, "a", "en", "s0", 1.0, "again"), (None, "no id", "en", "s1", 1.0, "x"), (None, "no id", None, "s1", 1.0, "x")]
SCHEMA = "doc_id long, text string, lang string, source string, score double, digest string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORDS.findall(t or "")


def all_texts(spark, sf_dir):
    return [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


# --- 1


def test_token_counts_are_the_library_s(spark, docs, none, sf_dir):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = Counter((r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in df.select("doc_id", "text").collect())
        got = tokens.count_tokens(df).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.count_tokens(none).count() == 0


def test_batch_bytes_are_read_as_spark_reads_them(spark, docs):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("64m", str(common.BATCH_BYTES)), ("1g", str(common.BATCH_BYTES)), ("2m", "2m"), ("4096", "4096")):
            spark.conf.set(key, given)
            common.bound_batches(docs)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_merging_random_strings():
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = tokens.counter("byte_bpe_50k.json").count
    rng = random.Random(5)
    for chars in ("ab ", "aeiounst'  \n", "".join(map(chr, range(0x20, 0x180))), "日本語のテキスト 1２", "\x1c\x1d\x85  a "):
        for _ in range(200):
            t = "".join(rng.choices(chars, k=rng.randrange(60)))
            assert count(t) == len(lib.encode(t, add_special_tokens=False).ids), repr(t)


# --- 2


def water(sizes, share=1.5, cap=2.0):
    """Shares the total by weight, caps, and shares again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > cap * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mix_meets_targets(spark, docs, none, sf_dir):
    for df in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        src = {(r.doc_id, r.text): r.source for r in df.select("doc_id", "text", "source").collect()}
        rows = mixing.mix_plan(df).collect()
        again = mixing.mix_plan(df.repartition(2)).collect()
        assert Counter((r.doc_id, r.size, r.taken) for r in rows) == Counter((r.doc_id, r.size, r.taken) for r in again)
        assert len(rows) == df.count()
        sizes, largest = Counter(), defaultdict(int)
        for r in df.select("text", "source").collect():
            sizes[r.source] += len(words(r.text))
            largest[r.source] = max(largest[r.source], len(words(r.text)))
        want = water(sizes)
        by_target = {}
        for s, t in want.items():
            by_target.setdefault((sizes[s], round(t, 3)), []).append(s)
        taken = Counter()
        for r in rows:
            assert r.taken in (0, r.size, 2 * r.size)
            assert (r.source_size, round(r.target, 3)) in by_target
            taken[r.source_size, round(r.target, 3)] += r.taken
        for k, sources in by_target.items():
            assert abs(taken[k] - k[1] * len(sources)) <= sum(largest[s] for s in sources)
        assert src
    rows = mixing.mix_plan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    taken = Counter()
    for r in rows:
        taken[r.source_size, r.target] += r.taken
    assert all(abs(t - k[1]) <= 0.01 * k[1] + 5 for k, t in taken.items()), taken
    assert mixing.mix_plan(none).count() == 0


def test_mixed_rows_are_the_plan_s(spark, docs):
    plan = Counter()
    for r in mixing.mix_plan(docs).collect():
        plan[r.doc_id] += len(r.shards)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +plan


def test_splitting_tree_is_exact_and_fair(spark):
    quotas = {0: 1000, 1: 10, 2: 0, 3: 333}
    df = spark.createDataFrame(list(quotas.items()), "sid int, quota long")
    for n in (1, 2, 7, 8):
        got = mixing.split_quotas(df, n, 4, seed=3).collect()
        by_source, by_shard = Counter(), Counter()
        for r in got:
            by_source[r.sid] += r.drawn
            by_shard[r.shard] += r.drawn
            assert r.drawn >= 0
        assert dict(by_source) == quotas and len(by_shard) == n
        assert max(by_shard.values()) - min(by_shard.values()) <= n
    draws = spark.range(4000).selectExpr(mixing.hypergeometric("100", "30", "40", "(id + 0.5) / 4000") + " as x").collect()
    mean = sum(r.x for r in draws) / 4000
    var = sum((r.x - mean) ** 2 for r in draws) / 4000
    assert abs(mean - 12) < 0.02 and abs(var - 40 * 0.3 * 0.7 * 60 / 99) < 0.05


def test_what_is_taken_comes_out_of_the_tree(spark):
    """The leaves' pools are the blocks taken, but for those that bring the words to the target; another tree takes others."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken = {}
    for n in (1, 8):
        mix = mixing.Mix(df, 1.5, 2.0, mixing.WEIGHTS, n, 1, 7, "doc_id", "text", "source")
        sources = {r.sid: r for r in mix.sources.collect()}
        spans, quotas, leaves = (spark.read.parquet(f"{mix.space.root}/{k}") for k in sorted(__import__("os").listdir(mix.space.root.removeprefix("file://"))) if k.split("-")[1] in ("spans", "quotas", "leaves"))
        pool = Counter(r.sid for r in spans.collect())
        quota = {(r.sid, r["pass"]): r.quota for r in quotas.collect()}
        for (sid, p), q in quota.items():
            s = sources[sid]
            assert q == pool[sid] if p < s.passes else abs(q - pool[sid] * s.rest / s.source_size) <= 0.5
        dealt, by_shard = Counter(), Counter()
        for r in leaves.collect():
            dealt[r.sid, r["pass"]] += r.drawn
            by_shard[r.shard] += r.drawn
        assert dealt == Counter(quota) and max(by_shard.values()) - min(by_shard.values()) <= n
        rows = mix.draws(mix.base).collect()
        got = Counter(s for r in rows for s in r.shards)
        assert set(got) <= set(range(n))
        if n > 1:
            assert max(got.values()) < 2 * min(got.values())
        taken[n] = {r.id: len(r.shards) for r in rows}
        want = water({s.source: s.source_size for s in sources.values()})
        assert all(s.target == pytest.approx(want[s.source]) for s in sources.values())
    assert sum(taken[1][d] != taken[8][d] for d in taken[1]) > 20


def test_mix_of_rows_that_repeat(spark):
    """Every row is drawn for itself, however many are alike, and the mixed rows are as many as planned."""
    rows = [(None, "a b c", "s", i) for i in range(4000)] + [(i, f"w{i} " * (1 + i % 7), "t" if i % 2 else None, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == len(rows)
    taken, target = Counter(), {}
    for r in plan:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert len(target) == 3 and all(abs(taken[k] - t) < 7 for k, t in target.items())
    again = mixing.mix_plan(df.repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in plan) == Counter((r.doc_id, r.size, r.taken) for r in again)
    mixed = Counter(r.extra if r.doc_id is None else None for r in mixing.mix_documents(df).collect())
    assert sum(n for k, n in mixed.items() if k is not None) * 3 == taken[12000] and max(n for k, n in mixed.items() if k is not None) <= 2


def test_a_tree_of_many_quotas(spark):
    """More quotas than one run draws: sums stay exact, shards even, and shares as expected."""
    quotas = {i: 5 + i % 50 for i in range(3000)}
    got = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "sid int, quota long"), 4, 3000).collect()
    by_source, by_shard = Counter(), Counter()
    for r in got:
        by_source[r.sid] += r.drawn
        by_shard[r.shard] += r.drawn
    assert by_source == Counter(quotas) and max(by_shard.values()) - min(by_shard.values()) <= 4
    large = [r.drawn for r in got if quotas[r.sid] == 54]
    assert sum(large) / len(large) == pytest.approx(13.5) and 5 < np.var(large) < 16


# --- 3


def simhash_slow(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = words(low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def classes_slow(fps, distance=2):
    """id -> smallest reachable id, by comparing all pairs of fingerprints."""
    root = {f: f for f in set(fps.values())}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(root)
    arr = np.array(distinct, np.uint64)
    for i, f in enumerate(distinct):
        near = np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= distance)
        for j in near:
            root[find(f)] = find(distinct[i + 1 + int(j)])
    least = {}
    for d, f in fps.items():
        least[find(f)] = min(least.get(find(f), d), d)
    return {d: least[find(f)] for d, f in fps.items()}


def test_simhash_against_all_pairs(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r for r in df.select("doc_id", "text").collect()]
    fps = {r.doc_id: simhash_slow(r.text) for r in rows}
    want = classes_slow(fps)
    got = queries.op3_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {d: (fps[d], want[d]) for d in fps}


@pytest.mark.parametrize(("bucket", "distance"), [(0, 2), (3, 2), (64, 2), (3, 0), (3, 1), (3, 3), (8, 5)])
def test_links_of_crowded_buckets(spark, bucket, distance):
    """Chains, clouds around one value, and far values; buckets cut once or several times must find the same pairs."""
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base[:6]:
        x = b
        for _ in range(30):
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(x)
            fps.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps |= {0, 1, (1 << 64) - 1, 1 << 63}
    fps = dict(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps.values()], "fp long")
    space = common.Workspace(spark, "t")
    edges = simhash.links(space, nodes, distance, bucket)
    every = sorted(fps.values())
    pairs = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if (a ^ b).bit_count() <= distance}
    assert Counter(tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in edges.collect()) == Counter(pairs)
    if not pairs:
        return
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(space, edges).collect()}
    want = classes_slow(fps, distance)
    groups = defaultdict(set)
    for i, f in fps.items():
        groups[found.get(f, f)].add(i)
    expected = defaultdict(set)
    for i, r in want.items():
        expected[r].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_simhash_edge_cases(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id is not None and 0 <= r.doc_id < 3:  # empty, null, white space: fingerprint zero, one class
            assert (r.fp, r.component) == (0, 0)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[6].component == by_id[7].component == 5
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert 6 not in ids and 5 in ids and ids[3] == 3


# --- 4


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    clean = [r for r in rows if r.quality == 1]
    assert right > 0.97 and sum(r.predicted for r in clean) / len(clean) > 0.99
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (5, 1), (8, 0), (13, 0), (None, 0), (9, None), (99, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert quality.score_quality(none, quality.train(none, labels)).count() == 0
    assert quality.keep_good(docs, model, 0.0).count() == len(ROWS)
    assert quality.keep_good(docs, model).columns == docs.columns


def test_what_comes_to_the_driver_is_bounded(spark, none):
    """Ids that many documents share give no more labelled rows than the sample has."""
    docs = spark.createDataFrame([(1, f"good prose number {i}, of its own.") for i in range(300)] + [(4, f"bad $$$ {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0)], "doc_id long, quality int")
    held = {i for i in (1, 4) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert not held
    seen = []
    fit, quality.fit = quality.fit, lambda x, y, **k: seen.append(len(y)) or fit(x, y, **k)
    try:
        quality.train(docs, labels, sample_rows=50)
        quality.train(docs, labels)
    finally:
        quality.fit = fit
    assert seen == [50, 900]


def test_scores_are_sums_of_table_entries(spark, sf_dir):
    """The score of each document, looked up entry by entry."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        x = quality.features((r.text or "").encode())
        total = model.bias
        for v, edges, table in zip(x, model.edges, model.tables):
            total += table[sum(e <= v for e in edges)]
        for i, j, ei, ej, table in model.pairs:
            total += table[sum(e <= x[i] for e in ei)][sum(e <= x[j] for e in ej)]
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-max(-30, min(30, total)))))


def test_interactions_learn_what_no_single_feature_shows():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, n_pairs=1)
    assert model.pairs[0][:2] == (0, 1)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


# --- 5


def article(html):
    """What the test pages call the article: its h1 and p elements."""
    import html as h

    body = re.search(r"<article>(.*)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)\b[^>]*>", body)
    blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", " " if "br" in b else "", b)).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_extraction_finds_the_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op5_html_text(spark, "/root/testdata/sf0.01").collect()}
    same = sum(got[r.page_id].text == article(r.html) for r in rows)
    assert same >= 0.99 * len(rows)
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_extraction_edge_cases(spark):
    para = "A sentence of an article that goes on for a while, with commas. " * 3
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body><header>Site name</header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies on this page and this is a long sentence about them.</div>
    <div id=main><h1>Head&amp;line</h1><p>{para}<p>Short.<ul><li>one<li>two</ul><p>{para}</div>
    <aside>More stories</aside><section class="comments"><p>{para}</section><form><label>Name</label><input></form>
    <script>var x = "<p>no</p>";</script><footer>&copy; us</footer></body></html>"""
    p = " ".join(para.split())
    assert html_text.main_text(page) == f"Head&line\n{p}\nShort.\none\ntwo\n{p}"
    # what names say of the main element, or of a box around it, isn't about its text
    for around, inner in (("", "has-sidebar"), ("layout with-sidebar", "")):
        got = html_text.main_text(f'<body><div class="{around}"><nav><p>{p}</p></nav><main class="{inner}"><h1>T</h1><p>{p}</p><div class="comments"><p>{p}</p></div></main></div></body>')
        assert got == f"T\n{p}"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>unclosed &lt;b&gt; <b>te&#120;t", "x"), (4, "u", "no markup at all", "x"), (4, "u", "<nav>only a menu</nav>", "x"), (5, "u", "<p>" + "word " * 200_000, "x"), (6, "u", "<div>" * 3000 + "deep", "x"), (7, "u", "<!-- <p>x</p> --><![CDATA[y]]><p a='>'>z</p", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [r.text for r in html_text.extract_text(df).collect()]
    assert got[:5] == ["", "", "unclosed <b> text", "no markup at all", ""]
    assert len(got[5]) == 5 * 200_000 - 1 and got[6] == "deep"
    assert html_text.extract_text(df.limit(0)).count() == 0


# --- 6


def check_packing(rows, texts, capacity=2048):
    """texts: id -> list of texts. Every id stream must come back, in gapless sequences."""
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    total = 0
    for d, ts in texts.items():
        for t in ts:
            ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
            total += len(ids)
            for k, at in enumerate(range(0, len(ids), capacity)):
                cut = ids[at : at + capacity]
                want[d, k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), total


def test_packing_round_trip(spark, docs, none, sf_dir):
    for df in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        texts = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            texts[r.doc_id].append(r.text)
        n, total = check_packing(packing.pack(df).collect(), texts)
    assert n <= 1.03 * total / 2048 + 1
    assert packing.pack(none).count() == 0


def test_packed_sequences_hold_the_ids(docs):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter(tuple(lib.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in ROWS)
    got, streams = packing.sequences(packing.pack(docs, capacity=64, with_ids=True)).collect(), defaultdict(list)
    for r in got:
        assert len(r.ids) <= 64
        for s in r.spans:
            streams[s.id].append((s.piece, tuple(r.ids[s.offset : s.offset + s.length])))
    unique = {r[0] for r in ROWS if r[0] is not None} - {3}
    for d in unique:
        assert want[tuple(x for _, ids in sorted(streams[d]) for x in ids)] > 0
    assert sum(len(r.ids) for r in got) == sum(len(k) * n for k, n in want.items())


def test_packing_of_counts():
    rng = random.Random(2)
    for capacity in (9, 100):
        for _ in range(300):
            counts = Counter(rng.randint(1, capacity) for _ in range(rng.randrange(1, 200)))
            layouts = packing.pack_lengths(counts, capacity)
            used = Counter()
            for layout, n in layouts:
                assert 0 < sum(layout) <= capacity and n > 0
                assert sum(x > capacity / 3 for x in layout) <= 2
                for x in layout:
                    used[x] += n
            assert used == counts
    # a histogram of any size takes the same layouts
    assert len(packing.pack_lengths({n: 10**9 for n in range(1, 2049)}, 2048)) < 20_000


# --- 7


def test_shards(spark, docs, none):
    for df, even in ((docs, False), (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), True)):
        texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.select("doc_id", "text").collect())
        rows = sharding.shard_by_bytes(df).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
        slots, size, homes = defaultdict(list), Counter(), defaultdict(set)
        for r in rows:
            assert 0 <= r.shard < 8
            slots[r.shard].append(r.slot)
            size[r.shard] += r.size
            homes[r.size, r.text_crc32].add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        if even:
            mean = sum(size.values()) / 8
            assert all(abs(s - mean) <= 0.04 * mean for s in size.values()), size
            assert all(len(h) == 1 for h in homes.values())
    assert sharding.shard_by_bytes(none).count() == 0


def test_written_shards(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in docs.collect())
    placed = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_by_bytes(docs).collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == placed


def test_shards_split_a_group_larger_than_a_shard(spark):
    rows = [(i, "same text") for i in range(4000)] + [(4000 + i, "" if i % 3 == 0 else f"text {i}") for i in range(6000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    mean = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(s - mean) < 0.04 * mean for s in size.values()), size


def lined(rows, n_shards=8):
    """{shard: bytes} of a placement, after checking its slots."""
    slots, size = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(size) <= set(range(n_shards))
    return size


def test_shards_of_rows_that_repeat(spark):
    """Equal (null id, text) rows, equal ids, and one text larger than several shards."""
    rows = [(None, "same text here")] * 4000 + [(i, f"text {i} of its own") for i in range(6000)]
    size = lined(sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    mean = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(s - mean) <= 0.02 * mean for s in size.values()), size
    rows = [(1, "x" * 50_000)] + [(2, None)] * 300 + [(3, "short")] * 300
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lined(got)
    assert Counter((r.doc_id, r.size) for r in got) == {(1, 50_001): 1, (2, 1): 300, (3, 6): 300}
    # one row larger than a shard lies alone but for what shares its start or fills the rest
    assert len({r.shard for r in got if r.doc_id == 3}) <= 2


def test_shards_against_a_plain_line(spark):
    """The line, computed row by row: contiguous stretches, few groups cut, and those at the targets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for n in (3, 8):
        got = sharding.shard_by_bytes(docs, n).collect()
        total, groups = sum(r.size for r in got), defaultdict(list)
        size = lined(got, n)
        for r in got:
            groups[r.size, r.text_crc32].append(r)
        assert all(abs(s - total / n) <= total / n / 64 + max(r.size for r in got) for s in size.values())
        assert all(len({r.shard for r in g}) == 1 for g in groups.values())
        # in line order each group's rows are neighbours
        order = sorted(got, key=lambda r: (r.shard, r.slot))
        runs = [k for i, k in enumerate((r.size, r.text_crc32) for r in order) if i == 0 or k != (order[i - 1].size, order[i - 1].text_crc32)]
        assert len(runs) == len(groups)


def test_written_shards_keep_every_row_and_column(spark, tmp_path):
    rows = [(None, "a", 1, 5, 6), (None, "a", 2, 5, 6), (7, None, 3, 5, 6), (7, "b" * 40, 4, 5, 6), (8, "", 5, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, shard int, row int")
    sharding.write_shards(docs, str(tmp_path / "s"), 2)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted((r._id, r.row, r.text) for r in back) == [(1, 6, "a"), (2, 6, "a"), (3, 6, None), (4, 6, "b" * 40), (5, 6, "")]
    assert sorted(r.slot for r in back if r.shard == 0) == list(range(sum(r.shard == 0 for r in back)))


# --- 8


def test_licenses(spark, none):
    mit = licenses._MIT.replace("software", "Software").upper().replace("\n\n", "\r\n   \r\n")
    rows = [
        (1, "Copyright (c) 2019 Somebody\n\n" + mit), (2, "The MIT Licence (MIT)\n\nCopyright © 2001 x\nAll rights reserved.\n" + mit), (3, mit + " and more"),
        (4, "Prose.\nreleased under the MIT licence!\nMore prose.\nLicensed under CC BY-NC 4.0."), (5, None), (6, ""), (None, "Released under the MIT License."), (6, "x" * 100_000),
    ]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.text_digest)
    by = {r.doc_id: (r.license_id, r.notices) for r in sorted(got, key=key)}
    assert by[1][0] == by[2][0] == "MIT" and by[3][0] is None
    assert by[4] == (None, "CC-BY-NC-4.0,MIT") and by[None] == ("MIT", "MIT") and by[5] == (None, "")
    assert len(got) == len(rows) and {r.text_digest for r in got if r.doc_id == 5} == {hashlib.sha256(b"").hexdigest()}
    assert licenses.scan_licenses(none).count() == 0


def test_licenses_entire_texts_and_usual_notices(spark):
    import textwrap
    from pathlib import Path

    folder = Path(licenses.__file__).parent / "license_texts"
    rows = [(p.stem, p.read_text().upper().replace("\n", " \r\n")) for p in sorted(folder.glob("*.txt"))]
    rows += [("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, Somebody\nAll rights reserved.\n\n" + textwrap.fill(licenses._BSD3, 60)), ("BSD-2-Clause", "Copyright 2001 x\n" + licenses._BSD2)]
    header = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.'
    notices = {"Apache-2.0": "import x\n# " + header.replace("\n", "\n# "), "MPL-2.0": "/* " + "\n * ".join(licenses._MPL) + " */\nx", "LGPL-2.1": "// SPDX-License-Identifier: LGPL-2.1-or-later\nx"}
    data = [(f"whole {i} {k}", t) for k, (i, t) in enumerate(rows)] + [(f"line {i}", t) for i, t in notices.items()] + [("line Apache-2.0", "Prose.\n" + header.replace("\n", " "))]
    got = licenses.scan_licenses(spark.createDataFrame(data, "doc_id string, text string")).collect()
    assert len(got) == len(data) and len(rows) == 11
    for r in got:
        kind, name = r.doc_id.split()[:2]
        assert (r.license_id if kind == "whole" else r.notices) == name, r.doc_id


def test_spellings_are_settled_in_one_go(spark):
    """Neighbouring spellings all change, and a canonical line is canonical again."""
    lines = [" ".join([a, a, a]) for a, _ in licenses.SPELLINGS] + ["licence licence centre", "wilful wilfull willful", "per cent per cent", "sub license sub licence", "x copyright holder copyright holder", "nothing else"]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", licenses.spelled(F.col("x")).alias("y"))
    for r in df.select("x", "y", licenses.spelled(F.col("y")).alias("z")).collect():
        assert r.y == r.z, r.x
        if r.x in (" ".join([a, a, a]) for a, _ in licenses.SPELLINGS):
            a = r.x[: len(r.x) // 3]
            assert r.y == " ".join([dict(licenses.SPELLINGS)[a]] * 3)
    got = {r.x: r.y for r in df.collect()}
    assert got["licence licence centre"] == "license license center" and got["wilful wilfull willful"] == "willful willful willful"
    assert got["sub license sub licence"] == "sublicense sublicense"


def test_licenses_of_tables_with_clashing_columns(spark):
    rows = [(1, "Released under the MIT Licence!", "d", "l", "n", 7), (1, "Released under the MIT Licence!", None, None, None, None), (None, None, "d", "l", "n", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, license_id string, notices string, row int")
    got = licenses.scan_licenses(df).collect()
    assert Counter((r.doc_id, r.license_id, r.notices) for r in got) == {(1, "MIT", "MIT"): 2, (None, None, ""): 1}


def test_fixed_digests_are_the_known_ones(spark):
    """The digests that the SQL has were made by another program, of the same texts."""
    from pathlib import Path

    fixed = (Path(licenses.__file__).parent / "license_texts/digests.csv").read_text().split()[1:]
    assert {(r.digest, r.license_id) for r in licenses.known_digests(spark).collect()} == {tuple(x.split(",")) for x in fixed}


# --- 9


@pytest.mark.parametrize("bits", [8, 256])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_copies(docs, none, keep, bits):
    """A digest of 8 bits puts different texts together; comparing bytes must part them."""
    groups = defaultdict(list)
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    rows = exact.find_copies(docs, keep, bits).collect()
    best = {t: (min if keep == "smallest" else max)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = Counter((i, best[t], len(ids)) for t, ids in groups.items() for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == want
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    out = exact.drop_copies(docs, keep)
    assert out.columns == docs.columns
    assert Counter((r.text or "", r.doc_id) for r in out.collect()) == Counter((t, b) for t, b in best.items())
    assert exact.find_copies(none, keep).count() == 0 and exact.drop_copies(none, keep).count() == 0


def test_index_takes_several_batches(spark, docs):
    space = common.Workspace(spark, "t")
    index = exact.DigestIndex(space)
    index.flush(docs.where("doc_id < 10"), "doc_id", "text")
    index.flush(docs.where("doc_id >= 10 or doc_id is null"), "doc_id", "text")
    # entries are unique in each run, and runs hold what was logged
    runs = index.runs[0].unionByName(index.runs[1])
    assert runs.groupBy("run", "digest").count().where("count > 1").isEmpty()
    assert runs.agg({"n": "sum"}).first()[0] == len(ROWS) == index.rows().count()
    assert runs.select("run").distinct().count() > 2
    level = {bytes(r.digest): (r.n, r.best.id) for r in index.compact().collect()}
    want = defaultdict(list)
    for r in ROWS:
        want[hashlib.sha256((r[1] or "").encode()).digest()].append(r[0])
    assert level == {d: (len(ids), min((i for i in ids if i is not None), default=None)) for d, ids in want.items()}
    maybe = index.may_hit(index.level).where("n > 1").select("maybe").distinct().collect()
    assert [r.maybe for r in maybe] == [True]


def test_filters_spare_merges_and_their_lack_changes_nothing(spark, docs, monkeypatch):
    """Entries of one run alone are copied, others merged; without filters all are, with the same result."""
    numbered = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2900 as string) as text").repartition(8)
    want = None
    for run_bits, hit_bits in ((exact.RUN_BITS, exact.HIT_BITS), ((0, 0), exact.HIT_BITS), ((0, 0), (0, 0))):
        monkeypatch.setattr(exact, "RUN_BITS", run_bits)
        monkeypatch.setattr(exact, "HIT_BITS", hit_bits)
        got = [Counter(tuple(r) for r in exact.find_copies(d).collect()) for d in (docs, numbered)] + [Counter(exact.drop_copies(numbered).collect())]
        want = want or got
        assert got == want
    assert sum(n for r, n in want[1].items() if r[2] == 2) == 200


# --- 10


def base_slow(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_rules_base_columns(spark, docs, none, sf_dir):
    for df in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = rules.apply_rules(df).collect()
        want = Counter((r.doc_id, *base_slow(r.text)) for r in df.select("doc_id", "text").collect())
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert rules.apply_rules(none).count() == 0


def test_rules_verdict_against_brute_force(spark, sf_dir):
    rows = all_texts(spark, sf_dir)
    settings = rules.Rules()
    counts, chars = defaultdict(Counter), defaultdict(lambda: np.zeros(len(rules.CLASSES)))
    for r in rows:
        counts[r.lang].update(words(r.text))
        chars[r.lang] += rules.class_counts((r.text or "").encode())
    got = {r.doc_id: r for r in rules.apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for r in rows:
        total = sum(counts[r.lang].values())
        if total < settings.min_reference_words:
            continue
        top = sorted(counts[r.lang].items(), key=lambda x: (-x[1], x[0].encode()))[: settings.common_words]
        mine = Counter(words(r.text))
        p = np.array([mine[w] for w, _ in top] + [len(words(r.text)) - sum(mine[w] for w, _ in top)], float)
        q = np.array([c for _, c in top] + [total - sum(c for _, c in top)], float)
        g = got[r.doc_id]
        if len(words(r.text)) >= settings.min_common_words:
            assert g.word_distance == pytest.approx(rules.distance(p, q), abs=1e-9)
        else:
            assert g.word_distance is None
        if g.word_chars >= settings.min_chars:
            assert g.class_distance == pytest.approx(rules.distance(rules.class_counts(r.text.encode()).astype(float), chars[r.lang]), abs=1e-9)


def test_rules_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = rules.apply_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean = [r for r in rows if r.quality == 1]
    assert sum(r.kept for r in clean) >= 0.995 * len(clean)


def test_rules_without_an_own_reference_reject_nothing(spark):
    """Clean French under a null, a small and a late language is judged by the base rules alone, or by its own language's words."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1").select("doc_id"), "doc_id")
    english = docs.where("lang = 'en'").orderBy("doc_id").limit(300).select("doc_id", "text", "lang").collect()
    french = [r for r in docs.where("lang = 'fr'").orderBy("doc_id").limit(60).collect() if len(words(r.text)) >= 100]
    rows = [tuple(r) for r in english] + [(-1 - i, r.text, None) for i, r in enumerate(french)] + [(-1000, french[0].text[:1500], "small")]
    got = {r.doc_id: r for r in rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    bare = [got[i] for i in got if i < 0]
    assert len(bare) == len(french) + 1 and all(r.word_distance is None and r.class_distance is None for r in bare)
    assert all(r.kept == (not r.base_failed) for r in bare) and any(r.kept for r in bare)
    assert all(got[r.doc_id].word_distance is not None for r in english if len(words(r.text)) >= 100)


def test_rules_every_language_has_its_reference(spark):
    """More languages than any fixed number: each is compared with itself alone."""
    rows = [(i, " ".join(f"l{i}w{j % 50}" for j in range(2000)), f"l{i:03d}") for i in range(520)]
    got = rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    assert len(got) == 520 and all(r.word_distance == pytest.approx(0, abs=1e-9) and r.class_distance == pytest.approx(0, abs=1e-9) for r in got)


# --- SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True).astype(object).where(d[cols].sort_values(cols).reset_index(drop=True).notna(), None)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


PROSE = "The river runs past the old mill and the town that grew around it over two hundred years."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # no article element: the smallest element with most of the text, its short lines included
        (f"<body><div id=top><ul><li><a>Home</a><li><a>About us</a></ul></div><div class=content><h1>Title</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><p>End.</p></div><div class=footer>Mill 2020</div></body>", f"Title\n{PROSE}\nShort.\n{PROSE}\nEnd."),
        (f"<body><div id=wrap><div><a>Home</a> <a>News</a></div><h1>Title</h1><p>{PROSE}</p><p>Fin.</p></div></body>", f"Title\n{PROSE}\nFin."),
        (f"<body><div><a>Home</a> <a>News</a></div><h1>Title</h1><p>{PROSE}</p></body>", f"Title\n{PROSE}"),
        # names that speak of an element's neighbours, an article's own header, and names in camel case
        (f"<body><div class='page has-sidebar'><article><h1>Title</h1><p>{PROSE}</p></article><div class=sidebar><p>{PROSE}</p></div></div></body>", f"Title\n{PROSE}"),
        (f"<body><header class=site-header>Mill</header><article><header class=entry-header><h1>Title</h1></header><p>{PROSE}</p><div class=adSlot>Buy</div></article></body>", f"Title\n{PROSE}"),
        (f"<body><main><p>{PROSE}</p></main><div class=cookieBanner><p>{PROSE}</p></div><section id=commentSection><p>{PROSE} {PROSE}</p></section></body>", PROSE),
    ],
)
def test_article_of_pages_of_other_shapes(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("around", ["<body><div id=content>{}</div></body>", "<body>{}</body>", "<body><div id=page><div id=top><a>Home</a> <a>News</a></div><div>{}</div></div></body>"])
@pytest.mark.parametrize(
    ("parts", "text"),
    [
        (f"<section><h2>A</h2><p>{PROSE}</p><p>{PROSE} {PROSE}</p><p>{PROSE}</p></section><section><h2>B</h2><p>The mill closed in May.</p></section>", f"A\n{PROSE}\n{PROSE} {PROSE}\n{PROSE}\nB\nThe mill closed in May."),
        (f"<section><h2>A</h2><p>It opened.</p></section><section><h2>B</h2><p>{PROSE} {PROSE}</p></section>", f"A\nIt opened.\nB\n{PROSE} {PROSE}"),
        (f"<div><p>{PROSE * 8}</p></div><div><p>{PROSE}</p></div><div><p>The end.</p></div>", f"{PROSE * 8}\n{PROSE}\nThe end."),
    ],
)
def test_sibling_sections_of_an_article_stay(around, parts, text):
    assert html_text.main_text(around.format(parts)) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # what names say of an article, a heading or nearly all of the text isn't about it
        (f"<body><article class='post comments-open'><h1>T</h1><p>{PROSE}</p></article></body>", f"T\n{PROSE}"),
        (f"<body><nav><a>Home</a></nav><div id=social-history class=notice><p>{PROSE} {PROSE}</p></div><p>tiny</p></body>", f"{PROSE} {PROSE}\ntiny"),
        (f"<body><article><h1>T</h1><p>{PROSE}</p><section id=discussion><h2 class=search>D</h2><p>{PROSE}</p></section></article></body>", f"T\n{PROSE}\nD\n{PROSE}"),
        (f"<body><form id=all><div><h1>T</h1><p>{PROSE}</p></div></form></body>", f"T\n{PROSE}"),
        # boilerplate inside a line, with and without an article around it
        (f"<body><article><p>{PROSE} <span class=ad>Buy now</span> So <label>Name</label><button>Go</button>it is.</p></article></body>", f"{PROSE} So it is."),
        (f"<body><p>{PROSE} <span class=ad>Buy now</span></p></body>", PROSE),
        # long boilerplate in and beside an article, and an article without text
        (f"<body><article><p>{PROSE}</p><div class=comments><p>{PROSE}</p></div></article><section class=comments><article><p>{PROSE * 3}</p></article></section></body>", PROSE),
        ("<body><article><h1></h1></article><div class=ad>Buy this now</div><footer>Mill 2020</footer></body>", ""),
        # without any name or telling element, ratios alone tell
        (f"<body><div>Mill 2020</div><div><a>Home</a> <a>News</a> <a>Old</a></div><div><p>{PROSE} {PROSE}</p><p>{PROSE}</p><p>So.</p></div><div>All rights reserved</div></body>", f"{PROSE} {PROSE}\n{PROSE}\nSo."),
    ],
)
def test_names_weigh_and_ratios_choose(page, text):
    assert html_text.main_text(page) == text


def test_levels_and_threshold_decide(monkeypatch):
    """With equal levels, or without a threshold, other regions come in."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    texts = [html_text.main_text(p) for p in pages]
    for name, instead in (("smooth", lambda r, sigma, runs: np.full(len(r), r.mean())), ("threshold", lambda v: 0.0)):
        with monkeypatch.context() as m:
            m.setattr(html_text, name, instead)
            assert sum(html_text.main_text(p) != t for p, t in zip(pages, texts)) > 0.3 * len(pages)


def test_levels_against_brute_force():
    """Ratios, smoothing and the threshold of real pages, computed one by one."""
    import math

    for page in pd.read_parquet("/root/testdata/sf0.001/pages.parquet").html[:25]:
        p = html_text.Page()
        p.feed(page)
        p.finish()
        _, _, weights, boxes, ratios, _ = html_text.measured(p)
        runs = [[i] for i in range(len(ratios))][:1]
        for i in range(1, len(ratios)):
            if (weights[i], boxes[i]) == (weights[i - 1], boxes[i - 1]):
                runs[-1].append(i)
            else:
                runs.append([i])
        want = []
        for run in runs:
            for i in run:
                near = [(math.exp(-(k * k) / 2), ratios[min(max(i + k, run[0]), run[-1])]) for k in range(-3, 4)]
                want.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        level = html_text.smooth(np.array(ratios), 1.0, list(map(len, runs)))
        assert level == pytest.approx(np.array(want))
        # the cut lies in the middle between the means of the two sides it makes
        cut = html_text.threshold(level)
        low, high = [v for v in want if v < cut], [v for v in want if v >= cut]
        assert cut == pytest.approx((sum(low) / len(low) + sum(high) / len(high)) / 2)
    p = html_text.Page()
    p.feed("<body><article><p>abcdefghij <a>cde</a> f</p><p class=ad><b>0123456789</b></p></article><nav>menu</nav></body>")
    p.finish()
    # tags: body, article, p, a and both ends; then p, b and both ends
    assert html_text.measured(p)[4] == [pytest.approx(13 / 6), pytest.approx(html_text.NAMED * 10 / 4), 0.0]
