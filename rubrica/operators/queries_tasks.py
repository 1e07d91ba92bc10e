"""Whole evaluations over the test tables: every kind of request, shots, corpus metrics, and what prepares documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.functions import arrow, speech, timeline
from rubrica.functions import text as T
from rubrica.operators import metrics as M
from rubrica.operators import selection as S
from rubrica.operators.queries_text import _PAIRS, _TOKENS, pairs
from rubrica.operators.registry import Tables, query, rounded
from rubrica.plans import evaluate as E

_RESULT = ("metric", "n")


def _result(results: DataFrame) -> DataFrame:
    return results.select(*_RESULT, rounded(F.col("value"), "value"), rounded(F.col("stderr"), "stderr"))


_CHOICES = """q AS (SELECT o_orderkey AS id, ['pear', 'fig', 'banana', 'kiwi'] AS ch, o_orderkey % 4 AS gold, list_transform([3, 5, 7, 11], lambda k: (o_orderkey * k % 13 + o_custkey % k) / 2.0 + 1) AS l, list_transform([2, 3, 5, 7], lambda k: (o_custkey * k % 11) / 3.0) AS u FROM orders WHERE o_orderstatus <> 'P'),
s AS (SELECT *, list_position(l, list_min(l)) - 1 AS pred, list_transform(l, lambda x, i: x / length(ch[i])) AS norm, list_transform(l, lambda x, i: x - u[i]) AS gain FROM q),
v AS (SELECT gold, pred, CASE WHEN pred = gold THEN 1.0 ELSE 0 END AS acc, CASE WHEN list_position(norm, list_min(norm)) - 1 = gold THEN 1.0 ELSE 0 END AS acc_norm, CASE WHEN list_position(gain, list_min(gain)) - 1 = gold THEN 1.0 ELSE 0 END AS mi FROM s)"""


def _asked(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders as questions of four choices, with losses of conditional and unconditional requests."""
    rows = t.orders.select(F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderstatus", (F.col("o_orderkey") % 4).cast("int").alias("answer"))
    losses = F.transform(F.array(*map(F.lit, (3, 5, 7, 11))), lambda k: (F.col("doc_id") * k % 13 + F.col("o_custkey") % k) / 2.0 + 1)
    alone = F.transform(F.array(*map(F.lit, (2, 3, 5, 7))), lambda k: (F.col("o_custkey") * k % 11) / 3.0)
    each = lambda c, conditional: rows.select(F.lit("fruit").alias("task"), "doc_id", F.posexplode(c).alias("idx", "loss"), F.lit(conditional).alias("conditional"))
    return rows, each(losses, True).unionByName(each(alone, False))


@query(f"""WITH {_CHOICES}, c AS (SELECT sum(CASE WHEN gold = 1 AND pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN gold = 1 THEN 1 ELSE 0 END)::DOUBLE AS g, sum(CASE WHEN pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS p, count(*) AS n, sum(acc)::DOUBLE AS r FROM v),
k AS (SELECT sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb FROM (SELECT k, sum(CASE WHEN gold = k THEN 1 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN pred = k THEN 1 ELSE 0 END)::DOUBLE AS b FROM v, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY k))
SELECT 'acc' AS metric, count(*) AS n, round(avg(acc), 6) AS value, round(stddev_samp(acc) / sqrt(count(*)), 6) AS stderr FROM v UNION ALL SELECT 'acc_norm', count(*), round(avg(acc_norm), 6), round(stddev_samp(acc_norm) / sqrt(count(*)), 6) FROM v
UNION ALL SELECT 'acc_mutual_info', count(*), round(avg(mi), 6), round(stddev_samp(mi) / sqrt(count(*)), 6) FROM v UNION ALL SELECT 'f1', n, round(2 * tp / (g + p), 6), NULL FROM c
UNION ALL SELECT 'mcc', n, round((r * n - ab) / sqrt((n::DOUBLE * n - aa) * (n::DOUBLE * n - bb)), 6), NULL FROM c, k""")
def evaluate_multiple_choice(t: Tables) -> DataFrame:
    """Losses by choice, a map over documents, and metrics of three kinds of aggregation."""
    docs, responses = _asked(t)
    task = E.Task("fruit", "multiple_choice", "{{ doc_id }}?", "answer", ("pear", "fig", "banana", "kiwi"), metrics=("acc", "acc_norm", "acc_mutual_info", "f1", {"metric": "mcc"}), process_docs=lambda d: d.where("o_orderstatus <> 'P'"))
    return _result(E.evaluate(docs, responses, task))


@query("""WITH v AS (SELECT -ln(o_totalprice) / 7 AS ll, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0 END AS greedy FROM orders)
SELECT 'perplexity' AS metric, count(*) AS n, round(exp(-avg(ll)), 6) AS value, NULL::DOUBLE AS stderr FROM v UNION ALL SELECT 'acc', count(*), round(avg(greedy), 6), round(stddev_samp(greedy) / sqrt(count(*)), 6) FROM v""")
def evaluate_loglikelihood(t: Tables) -> DataFrame:
    docs = t.orders.select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority")
    responses = t.orders.select(F.lit("ll").alias("task"), F.col("o_orderkey").alias("doc_id"), (-F.log("o_totalprice") / 7).alias("ll"), (F.col("o_orderkey") % 3 == 0).alias("greedy"))
    return _result(E.evaluate(docs, responses, E.Task("ll", "loglikelihood", "Priority:", "o_orderpriority")))


@query(r"""WITH v AS (SELECT -ln(n_chars + 1) AS ll, len(regexp_extract_all(text, '[^ \n\t]+'))::DOUBLE AS w, strlen(text)::DOUBLE AS b FROM documents)
SELECT 'word_perplexity' AS metric, count(*) AS n, round(exp(-sum(ll) / sum(w)), 6) AS value, NULL::DOUBLE AS stderr FROM v UNION ALL SELECT 'byte_perplexity', count(*), round(exp(-sum(ll) / sum(b)), 6), NULL FROM v UNION ALL SELECT 'bits_per_byte', count(*), round(-(sum(ll) / sum(b)) / ln(2), 6), NULL FROM v""")
def evaluate_rolling(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    responses = t.documents.select(F.lit("lm").alias("task"), "doc_id", (-F.log(F.col("n_chars") + 1)).alias("ll"))
    return _result(E.evaluate(docs, responses, E.Task("lm", "loglikelihood_rolling", "", "text")))


def _chat(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = pairs(t).select(F.xxhash64("conv_id", "turn").alias("doc_id"), "gold", F.lower("pred").alias("resp"))
    return p.select("doc_id", F.lower("gold").alias("gold")), p.select(F.lit("chat").alias("task"), "doc_id", F.lit(0).alias("idx"), F.lit(0).alias("repeat"), "resp")


@query(f"""WITH x AS (SELECT conv_id, turn, {_TOKENS.format('pred')} AS p, {_TOKENS.format('gold')} AS g FROM {_PAIRS}),
n AS (SELECT unnest([1, 2, 3, 4]) AS n), pg AS (SELECT conv_id, turn, n, array_to_string(p[i:i + n - 1], ' ') AS w, count(*) AS c FROM (SELECT *, unnest(range(1, len(p) - n + 2)) AS i FROM x, n) GROUP BY ALL),
gg AS (SELECT conv_id, turn, n, array_to_string(g[i:i + n - 1], ' ') AS w, count(*) AS c FROM (SELECT *, unnest(range(1, len(g) - n + 2)) AS i FROM x, n) GROUP BY ALL),
m AS (SELECT n, sum(least(pg.c, coalesce(gg.c, 0))) AS m, sum(pg.c) AS t FROM pg LEFT JOIN gg USING (conv_id, turn, n, w) GROUP BY n), l AS (SELECT sum(len(p))::DOUBLE AS p, sum(len(g))::DOUBLE AS g, count(*) AS n FROM x)
SELECT 'bleu' AS metric, any_value(l.n) AS n, round(CASE WHEN min(m) = 0 THEN 0 ELSE 100 * any_value(CASE WHEN l.p > l.g THEN 1 ELSE exp(1 - l.g / l.p) END) * exp(avg(ln(m / t::DOUBLE))) END, 6) AS value, NULL::DOUBLE AS stderr FROM m, l""")
def evaluate_bleu(t: Tables) -> DataFrame:
    """A corpus metric as a task's metric: its parts combine like any other's."""
    docs, responses = _chat(t)
    return _result(E.evaluate(docs, responses, E.Task("chat", doc_to_target="gold", metrics=("bleu",))))


@query("""WITH v AS (SELECT text, lower(text) AS l FROM conversations), s AS (SELECT CASE WHEN contains(l, 'en') THEN 1.0 ELSE 0 END AS a, length(text)::DOUBLE AS b FROM v)
SELECT 'has' AS metric, count(*) AS n, round(avg(a), 6) AS value, round(stddev_samp(a) / sqrt(count(*)), 6) AS stderr FROM s UNION ALL SELECT 'middle', count(*), list_sort(list(b))[count(*) // 2 + 1], NULL FROM s""")
def evaluate_own_results(t: Tables) -> DataFrame:
    """process_results makes the items, one metric with an aggregation of its own."""
    docs = t.conversations.select(F.xxhash64("conv_id", "turn").alias("doc_id"), "text")
    responses = docs.select(F.lit("own").alias("task"), "doc_id", F.lit(0).alias("idx"), F.lit(0).alias("repeat"), F.lower("text").alias("resp"))
    results = lambda c: {"has": F.contains(F.get(c("resp"), F.lit(0)), F.lit("en")).cast("double"), "middle": F.length(c("target")).cast("double")}
    metrics = ({"metric": "has"}, E.Metric("middle", lambda x: M.median(x)))
    return _result(E.evaluate(docs, responses, E.Task("own", doc_to_target="text", metrics=metrics, process_results=results)))


@query("""WITH s AS (SELECT string_agg('Q' || item_id || ': ' || left(text, 3) || ' ' || item_id, '##' ORDER BY item_id) AS shots FROM benchmark WHERE item_id < 3)
SELECT item_id AS doc_id, 'Answer. ' || shots || '##' || 'Q' || item_id || ': ' || left(text, 3) AS prompt, r::INT AS repeat FROM benchmark, s, (SELECT unnest([0, 1]) AS r)""")
def fewshot_context(t: Tables) -> DataFrame:
    """Prompts with a description and the first three items as shots, each asked twice."""
    docs = t.benchmark.select(F.col("item_id").alias("doc_id"), F.substring("text", 1, 3).alias("head"))
    task = E.Task("shots", doc_to_text="Q{{ doc_id }}: {{ head }}", doc_to_target="doc_id", fewshot=3, sampler="first_n", description="Answer. ", fewshot_delimiter="##", repeats=2)
    return E.instances(docs, task).select("doc_id", "prompt", "repeat")


_EIGHT = "unnest(list_distinct(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' '))))"


@query(f"""WITH b AS (SELECT item_id, {_EIGHT} AS run FROM (SELECT item_id, {_TOKENS.format('text')} AS t FROM benchmark)), d AS (SELECT doc_id, {_EIGHT} AS run FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents))
SELECT item_id, count(DISTINCT doc_id) AS documents FROM benchmark LEFT JOIN b USING (item_id) LEFT JOIN d USING (run) GROUP BY 1""")
def benchmark_overlap(t: Tables) -> DataFrame:
    """In how many documents a run of eight words of each benchmark item is found."""
    return S.decontaminated(t.benchmark, t.documents)


@query("SELECT event_id, event_type = 'view' AND user_id % 3 = 0 OR value >= 60 AS long FROM events")
def long_videos(t: Tables) -> DataFrame:
    docs = t.events.select("event_id", F.when((F.col("event_type") == "view") & (F.col("user_id") % 3 == 0), " Long ").otherwise("short").alias("duration"), F.struct(F.col("value").alias("duration_sec")).alias("meta"))
    return docs.select("event_id", S.is_long(docs).alias("long"))


@query("SELECT o_orderkey, round(CASE WHEN n = 4 THEN 1 - least(1, 1 / 4.0) ELSE 1 END, 6) AS similarity FROM (SELECT o_orderkey, 3 + o_orderkey % 2 AS n FROM orders)")
def tree_similarity(t: Tables) -> DataFrame:
    """A tree of an order against the same with one leaf less, if it has four nodes."""
    leaf = lambda x: F.concat(F.lit('{"name":"'), x, F.lit('"}'))
    tree = lambda *kids: F.concat(F.lit('{"name":"o","children":['), F.concat_ws(",", *kids), F.lit("]}"))
    a, b, c = leaf(F.col("o_orderpriority")), leaf(F.col("o_orderstatus")), leaf(F.lit("x"))
    return t.orders.select("o_orderkey", rounded(arrow.tree_similarity(F.when(F.col("o_orderkey") % 2 == 1, tree(a, c, b)).otherwise(tree(a, b)), tree(a, b)), "similarity"))


@query("""WITH m AS (SELECT vec_id, list_transform([0, 1, 2], lambda i: list_transform([1, 2, 3, 4], lambda j: abs(embedding[i * 4 + j]::DOUBLE))) AS m FROM embeddings)
SELECT vec_id, round(r[5], 6) AS best FROM (SELECT vec_id, list_reduce(list_concat([[0.0::DOUBLE, 0, 0, 0, 0]], list_transform(m, lambda c: list_concat([0.0::DOUBLE], c))),
 lambda row, c: list_reduce(list_concat([[0.0::DOUBLE]], list_transform([1, 2, 3, 4], lambda j: [row[j + 1], row[j] + c[j + 1]])), lambda acc, x: list_append(acc, greatest(x[1], x[2], acc[len(acc)])))) AS r FROM m)""")
def caption_alignment(t: Tables) -> DataFrame:
    """The first twelve numbers of a vector as scores of three captions against four."""
    m = F.array(*(F.array(*(F.abs(F.col("embedding")[i * 4 + j]).cast("double") for j in range(4))) for i in range(3)))
    return t.embeddings.select("vec_id", rounded(arrow.caption_alignment(m), "best"))


@query("""SELECT conv_id, turn, trim(text) AS frames, 'k' || turn AS known, CASE WHEN turn % 2 = 0 THEN 8 ELSE NULL END AS emitted FROM conversations""")
def sectioned_replies(t: Tables) -> DataFrame:
    """Turns as replies in sections, between tags or behind headings."""
    stats = F.when(F.col("turn") % 2 == 0, "FRAME_COUNT_EMITTED: 8").otherwise("none")
    known = F.concat(F.lit("k"), F.col("turn").cast("string"))
    tagged = F.concat(F.lit("<<<BEGIN_FRAMES>>>\n"), "text", F.lit("<<<END_FRAMES>>><<<BEGIN_KNOWN_INFO_UPDATE>>>"), known, F.lit("<<<END_KNOWN_INFO_UPDATE>>><<<BEGIN_STATS>>>"), stats, F.lit("<<<END_STATS>>>"))
    headed = F.concat(F.lit("# FRAMES\n"), "text", F.lit("\n# KNOWN_INFO_UPDATE\n"), known, F.lit("\n# STATS\n"), stats)
    s = timeline.sections(F.when(F.col("turn") % 3 == 0, headed).otherwise(tagged))
    return t.conversations.select("conv_id", "turn", s["frames"].alias("frames"), s["known"].alias("known"), timeline.stats(s["stats"])["emitted"].alias("emitted"))


@query("""SELECT p_partkey, p_size || ' ' || lower(p_type) AS form FROM part""")
def english_transcripts(t: Tables) -> DataFrame:
    """Sizes said as words before the part's type."""
    units = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
    tens = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
    said = F.array(*(F.lit(units[n] if n < 20 else " ".join([tens[n // 10 - 2], units[n % 10]] if n % 10 else [tens[n // 10 - 2]])) for n in range(100)))
    form = speech.english(F.concat_ws(" ", F.get(said, F.col("p_size")), F.lit("um"), "p_type"))
    return t.part.select("p_partkey", F.regexp_replace(form, "^one ", "1 ").alias("form"))


@query(f"""WITH x AS (SELECT conv_id, turn, {_TOKENS.format('pred')} AS p, [{_TOKENS.format('gold')}, {_TOKENS.format("gold || ' ' || pred")}] AS gs FROM {_PAIRS}), n AS (SELECT unnest([1, 2]) AS n),
pg AS (SELECT conv_id, turn, n, array_to_string(p[i:i + n - 1], ' ') AS w, count(*) AS c FROM (SELECT *, unnest(range(1, len(p) - n + 2)) AS i FROM x, n) GROUP BY ALL),
g1 AS (SELECT conv_id, turn, n, k, array_to_string(g[i:i + n - 1], ' ') AS w, count(*) AS c FROM (SELECT *, unnest(range(1, len(g) - n + 2)) AS i FROM (SELECT conv_id, turn, unnest([1, 2]) AS k, unnest(gs) AS g FROM x), n) GROUP BY ALL),
gg AS (SELECT conv_id, turn, n, w, max(c) AS c FROM g1 GROUP BY ALL), m AS (SELECT n, sum(least(pg.c, coalesce(gg.c, 0)))::DOUBLE AS m, sum(pg.c) AS t FROM pg LEFT JOIN gg USING (conv_id, turn, n, w) GROUP BY n),
l AS (SELECT sum(len(p))::DOUBLE AS p, sum(CASE WHEN abs(len(gs[1]) - len(p)) <= abs(len(gs[2]) - len(p)) THEN len(gs[1]) ELSE len(gs[2]) END)::DOUBLE AS g FROM x)
SELECT round(100 * any_value(b) * max(m / t) FILTER (n = 1), 4) AS bleu_1, round(100 * any_value(b) * exp(avg(ln(m / t))), 4) AS bleu_2 FROM m, (SELECT CASE WHEN p > g THEN 1 ELSE exp(1 - g / p) END AS b FROM l)""")
def bleu_references(t: Tables) -> DataFrame:
    """Two references an answer: the turn before, and that with the answer behind it."""
    tokens = lambda c: T.tokens(F.lower(c))
    p = pairs(t).select(tokens("pred").alias("p"), F.array(tokens("gold"), tokens(F.concat_ws(" ", "gold", "pred"))).alias("gs"))
    return M.bleus(p, F.col("p"), F.col("gs"), 2).select(F.round("bleu_1", 4).alias("bleu_1"), F.round("bleu_2", 4).alias("bleu_2"))
