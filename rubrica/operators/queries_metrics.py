"""Aggregations, families, groups and statistics over the test tables.

Gold is a document's quality label; the prediction is whether it has 200
characters or more. Where a family needs repeats, rotations or pairs, events
stand for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.functions import geometry
from rubrica.functions import text as T
from rubrica.functions.filters import majority
from rubrica.operators import metrics as M
from rubrica.operators.registry import Tables, query, rounded
from rubrica.operators.selection import positions, top_per_group
from rubrica.plans import evaluate as E

_SCORED = "(SELECT d.*, l.quality, l.toxic, CASE WHEN (l.quality = 1) = (d.n_chars >= 200) THEN 1.0 ELSE 0.0 END AS hit FROM documents d JOIN labels l USING (doc_id)) s"


def scored(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id")
    return d.withColumn("hit", ((F.col("quality") == 1) == (F.col("n_chars") >= 200)).cast("double"))


@query("""
SELECT round(avg(hit), 6) AS accuracy, round(stddev_samp(hit) / sqrt(count(*)), 6) AS accuracy_stderr,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round(avg(g), 6) AS yes_ratio, round(avg(p), 6) AS pred_yes_ratio, count(*) AS n
FROM (SELECT *, sum(g * p) OVER () AS tp, sum((1 - g) * p) OVER () AS fp, sum(g * (1 - p)) OVER () AS fn
  FROM (SELECT hit, quality::DOUBLE AS g, CASE WHEN n_chars >= 200 THEN 1.0::DOUBLE ELSE 0 END AS p FROM """ + _SCORED + """)) GROUP BY tp, fp, fn""")
def binary_confusion(t: Tables) -> DataFrame:
    report = M.binary_report(F.col("quality") == 1, F.col("n_chars") >= 200)
    return scored(t).agg(*(c.alias(k) if k == "n" else rounded(c, k) for k, c in report.items()))


@query(f"SELECT round(avg(m), 6) AS macro, count(*) AS groups FROM (SELECT lang, avg(hit) AS m FROM {_SCORED} GROUP BY lang)")
def macro_accuracy_by_lang(t: Tables) -> DataFrame:
    return M.macro(scored(t), F.col("hit"), ["lang"]).select(rounded(F.col("macro"), "macro"), "groups")


@query(f"""SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS dimension, coalesce(lang, source) AS key,
  round(avg(hit), 6) AS value, count(*) AS n FROM {_SCORED} GROUP BY GROUPING SETS ((), (lang), (source))""")
def micro_breakdown_grouping_sets(t: Tables) -> DataFrame:
    return M.breakdown(scored(t), F.col("hit"), ["lang", "source"]).withColumn("value", F.round("value", 6))


@query(f"""WITH subset AS (SELECT source, CAST(substr(source, 4) AS INT) % 4 AS domain, round(avg(hit), 4) AS acc, count(*) AS n FROM {_SCORED} GROUP BY 1, 2)
SELECT domain, round(sum(acc * n) / sum(n), 6) AS acc, CAST(sum(n) AS BIGINT) AS n FROM subset GROUP BY domain""")
def instance_weighted_domain(t: Tables) -> DataFrame:
    subset = scored(t).groupBy("source", (F.substring("source", 4, 9).cast("int") % 4).alias("domain")).agg(F.round(F.avg("hit"), 4).alias("acc"), F.count("*").alias("n"))
    return subset.groupBy("domain").agg(rounded(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), "acc"), F.sum("n").alias("n"))


@query("""WITH c AS (SELECT lang, sum(CASE WHEN quality=1 AND toxic=1 THEN 1 ELSE 0 END)::DOUBLE tp, sum(CASE WHEN quality=0 AND toxic=1 THEN 1 ELSE 0 END)::DOUBLE fp,
  sum(CASE WHEN quality=1 AND toxic=0 THEN 1 ELSE 0 END)::DOUBLE fn, sum(CASE WHEN quality=0 AND toxic=0 THEN 1 ELSE 0 END)::DOUBLE tn FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, round(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)=0 THEN 0 ELSE (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) END, 6) AS mcc,
  round(CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2*tp/(2*tp+fp+fn) END, 6) AS f1 FROM c""")
def mcc_and_f1(t: Tables) -> DataFrame:
    gold, pred = F.col("quality") == 1, F.col("toxic") == 1
    return scored(t).groupBy("lang").agg(rounded(M.matthews(gold, pred), "mcc"), rounded(M.f1(gold, pred), "f1"))


@query("""SELECT round(avg(pow(p - q, 2) + pow((1 - p) - (1 - q), 2)), 6) AS brier FROM (SELECT CASE WHEN n_chars >= 1000 THEN 0.9 ELSE n_chars / 1250.0 END AS p, CAST(quality AS DOUBLE) AS q FROM documents JOIN labels USING (doc_id))""")
def brier_score(t: Tables) -> DataFrame:
    p = F.when(F.col("n_chars") >= 1000, 0.9).otherwise(F.col("n_chars") / 1250.0)
    return scored(t).agg(rounded(M.brier(F.array(p, 1 - p), 1 - F.col("quality")), "brier"))


@query("""SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity) / sqrt(count(*)), 6) AS stderr, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def mean_stderr(t: Tables) -> DataFrame:
    x = F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(rounded(M.mean(x), "mean"), rounded(M.stderr(x), "stderr"), F.count("*").alias("n"))


def _nation_results(t: Tables) -> DataFrame:
    rows = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("value"), M.stderr(F.col("c_acctbal")).alias("stderr"), F.count("*").alias("n"))
    return rows.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("task"), F.lit("balance").alias("metric"), F.lit("none").alias("filter_key"), "value", "stderr", "n", F.lit(True).alias("higher_is_better"))


def _members(t: Tables) -> DataFrame:
    direct = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("group"), F.col("n_name").alias("member"))
    return direct.unionByName(t.region.select(F.lit("WORLD").alias("group"), F.col("r_name").alias("member")))


_NATIONS = "nat AS (SELECT n_name AS task, n_regionkey, avg(c_acctbal) AS value, stddev_samp(c_acctbal) / sqrt(count(*)) AS se, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"
_GROUPED = "grp AS (SELECT r_name AS g, nat.* FROM nat JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'WORLD', nat.* FROM nat)"


@query(f"""WITH {_NATIONS}, {_GROUPED} SELECT g AS "group", 'balance' AS metric, 'none' AS filter_key, round(sum(value * n) / sum(n), 6) AS value,
  round(sqrt(sum((n - 1) * se * se * n) / (sum(n) - count(*)) / sum(n)), 6) AS stderr, CAST(sum(n) AS BIGINT) AS n, true AS higher_is_better FROM grp GROUP BY g""")
def group_rollup_weighted(t: Tables) -> DataFrame:
    return M.roll_up(_nation_results(t), M.closure(_members(t))).withColumn("value", F.round("value", 6)).withColumn("stderr", F.round("stderr", 6))


@query(f"""WITH {_NATIONS}, {_GROUPED} SELECT g AS "group", round(avg(value), 6) AS value FROM grp GROUP BY g""")
def group_mean_unweighted(t: Tables) -> DataFrame:
    return M.roll_up(_nation_results(t), M.closure(_members(t)), weighted=False).select("group", F.round("value", 6).alias("value"))


@query("""SELECT 'WORLD' AS "group", r_name AS member, 1 AS depth FROM region UNION ALL SELECT r_name, n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'WORLD', n_name, 2 FROM nation""")
def group_closure(t: Tables) -> DataFrame:
    return M.closure(_members(t))


@query(r"""SELECT lang, round(exp(-avg(ll)), 6) AS perplexity, round(exp(-sum(ll) / sum(w)), 6) AS word_perplexity, round(exp(-sum(ll) / sum(b)), 6) AS byte_perplexity, round(-(sum(ll) / sum(b)) / ln(2), 6) AS bits_per_byte
FROM (SELECT lang, -ln(n_chars) AS ll, len(regexp_extract_all(text, '[^ \n]+')) AS w, strlen(text) AS b FROM documents WHERE n_chars > 0) GROUP BY lang""")
def perplexity_family(t: Tables) -> DataFrame:
    d = t.documents.where("n_chars > 0").select("lang", (-F.log("n_chars")).alias("ll"), F.regexp_count("text", F.lit("[^ \n]+")).alias("w"), F.octet_length("text").alias("b"))
    return d.groupBy("lang").agg(rounded(M.perplexity(F.col("ll")), "perplexity"), rounded(M.weighted_perplexity(F.col("ll"), F.col("w")), "word_perplexity"), rounded(M.weighted_perplexity(F.col("ll"), F.col("b")), "byte_perplexity"), rounded(M.bits_per_byte(F.col("ll"), F.col("b")), "bits_per_byte"))


@query("SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS median FROM events GROUP BY event_type")
def median_per_type(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(M.median("value").alias("median"))


@query("SELECT 999.0::DOUBLE AS bypass, count(*) AS n FROM events")
def bypass(t: Tables) -> DataFrame:
    return t.events.agg(M.bypass(F.col("value")).alias("bypass"), F.count("*").alias("n"))


@query("SELECT round(avg(CASE WHEN a THEN 1.0 ELSE 0 END), 6) AS all_correct, count(*) AS groups FROM (SELECT user_id, event_type, bool_and(event_id % 7 <> 0) AS a FROM events GROUP BY 1, 2)")
def all_correct_per_group(t: Tables) -> DataFrame:
    return M.all_correct(t.events, F.col("event_id") % 7 != 0, ["user_id", "event_type"]).select(rounded(F.col("all_correct"), "all_correct"), "groups")


@query("""WITH p AS (SELECT event_type, event_id // 2 AS pair, avg(CASE WHEN event_id % 5 <> 0 THEN 1.0 ELSE 0 END) AS acc, min(CASE WHEN event_id % 5 <> 0 THEN 1.0 ELSE 0 END) AS plus FROM events GROUP BY 1, 2)
SELECT event_type, round(100 * avg(acc) + 100 * avg(plus), 6) AS score FROM p GROUP BY event_type""")
def pairwise_acc_plus(t: Tables) -> DataFrame:
    hit = (F.col("event_id") % 5 != 0).cast("double")
    pairs = t.events.groupBy("event_type", F.floor(F.col("event_id") / 2).alias("pair")).agg(F.avg(hit).alias("acc"), F.min(hit).alias("plus"))
    return pairs.groupBy("event_type").agg(rounded(100 * F.avg("acc") + 100 * F.avg("plus"), "score"))


@query("SELECT count(*) AS questions, round(avg(CASE WHEN h THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM (SELECT event_id % 1000 AS b, bool_and(event_id % 11 <> 0 OR event_id < 1000) AS h FROM events GROUP BY 1)")
def circular_hit_rate(t: Tables) -> DataFrame:
    hits = M.circular(t.events, (F.col("event_id") % 11 != 0) | (F.col("event_id") < 1000), F.col("event_id"), 1000)
    return hits.agg(F.count("*").alias("questions"), rounded(F.avg(F.col("hit").cast("double")), "hit_rate"))


@query("""WITH a AS (SELECT event_id % 1000 AS b, bool_and(event_id % 11 <> 0) AS h FROM events GROUP BY 1), c AS (SELECT event_id % 1000 AS b, bool_and(event_id % 13 <> 0) AS h FROM events GROUP BY 1)
SELECT count(*) AS questions, round(avg(CASE WHEN a.h AND c.h THEN 1.0 ELSE 0 END), 6) AS dual FROM a JOIN c USING (b)""")
def dual_accuracy_join(t: Tables) -> DataFrame:
    a = M.circular(t.events, F.col("event_id") % 11 != 0, F.col("event_id"), 1000)
    b = M.circular(t.events, F.col("event_id") % 13 != 0, F.col("event_id"), 1000).withColumnRenamed("hit", "hit_b")
    return a.join(b, "base").agg(F.count("*").alias("questions"), rounded(F.avg((F.col("hit") & F.col("hit_b")).cast("double")), "dual"))


@query("""WITH s AS (SELECT event_id // 4 AS g, max(CASE WHEN event_id % 4 = 0 THEN h END) s0, max(CASE WHEN event_id % 4 = 1 THEN h END) s1, max(CASE WHEN event_id % 4 = 2 THEN h END) s2, max(CASE WHEN event_id % 4 = 3 THEN h END) s3
  FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS h FROM events) GROUP BY 1)
SELECT round(avg((s0 * s1 + s2 * s3) / 2.0), 6) AS q_acc, round(avg((s0 * s2 + s1 * s3) / 2.0), 6) AS i_acc, round(avg((s0 + s1 + s2 + s3) / 4.0), 6) AS acc, round(avg(s0 * s1 * s2 * s3 * 1.0), 6) AS g_acc, count(*) AS groups FROM s""")
def group_2x2(t: Tables) -> DataFrame:
    g = M.group_2x2(t.events, (F.col("event_id") % 3 != 0).cast("int"), F.col("event_id") % 4, F.floor(F.col("event_id") / 4))
    return g.select(*(F.round(c, 6).alias(c) for c in ("q_acc", "i_acc", "acc", "g_acc")), "groups")


@query("SELECT user_id, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY 1, 2")
def outcome_share(t: Tables) -> DataFrame:
    return M.outcome_share(t.events, "event_type", ["user_id"]).withColumn("share", F.round("share", 6))


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def value_share(t: Tables) -> DataFrame:
    return M.outcome_share(t.events, "event_type").withColumn("share", F.round("share", 6))


@query("""SELECT c_mktsegment, round(round(avg(c_acctbal), 3) / round(avg(c_nationkey + 1.0), 3) * 100, 1) AS ratio FROM customer WHERE c_custkey % 10 <> 0 GROUP BY 1""")
def judge_ratio(t: Tables) -> DataFrame:
    model = F.when(F.col("c_custkey") % 10 == 0, -999.0).otherwise(F.col("c_acctbal"))
    return t.customer.groupBy("c_mktsegment").agg(M.judge_ratio(model, F.col("c_nationkey") + 1.0).alias("ratio"))


_WINNER = "CASE WHEN event_id % 5 < 2 THEN 'model' WHEN event_id % 5 = 2 THEN 'tie' ELSE 'baseline' END"


@query(f"SELECT event_type, round(100 * (sum(CASE WHEN w = 'model' THEN 1 ELSE 0 END) + sum(CASE WHEN w = 'tie' THEN 1 ELSE 0 END) / 2.0) / count(*), 2) AS win_rate FROM (SELECT event_type, {_WINNER} AS w FROM events) GROUP BY 1")
def win_rate(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(M.win_rate(F.expr(_WINNER), "model").alias("win_rate"))


@query("""WITH c AS (SELECT sum(CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0 END) AS won, count(*) AS n FROM events)
SELECT 'baseline' AS model, 1000.0::DOUBLE AS rating UNION ALL SELECT 'model', round(1000 + 400 * log10(won / (n - won)), 2) FROM c""")
def elo_two_model(t: Tables) -> DataFrame:
    battles = t.events.select(F.lit("model").alias("a"), F.lit("baseline").alias("b"), F.when(F.col("event_id") % 5 < 2, "a").when(F.col("event_id") % 5 == 2, "tie").otherwise("b").alias("winner"))
    return M.elo_ratings(battles, "a", "b", "winner", "baseline").withColumn("rating", F.round("rating", 2))


@query("""WITH RECURSIVE b AS (SELECT event_id % 5 AS a, (event_id + 1 + event_id % 4) % 5 AS b, CASE WHEN value > 50 THEN 1.0 WHEN value > 25 THEN 0.5 ELSE 0 END AS s FROM events),
p AS (SELECT a, b, sum(s)::DOUBLE AS w, count(*)::DOUBLE AS n FROM b WHERE a <> b GROUP BY 1, 2), l AS (SELECT list(a ORDER BY a, b) AS a, list(b ORDER BY a, b) AS b, list(w ORDER BY a, b) AS w, list(n ORDER BY a, b) AS n FROM p),
wins AS (SELECT list_transform(range(5), lambda i: list_sum(list_transform(range(1, len(a) + 1), lambda j: CASE WHEN a[j] = i THEN w[j] WHEN b[j] = i THEN n[j] - w[j] ELSE 0 END))) AS v FROM l),
s(k, s) AS (SELECT 0, [1.0, 1, 1, 1, 1]::DOUBLE[] UNION ALL SELECT k + 1, list_transform(t, lambda x: x / exp(list_avg(list_transform(t, lambda y: ln(y))))) FROM (SELECT k,
 list_transform(range(5), lambda i: greatest(1e-12, v[i + 1] / list_sum(list_transform(range(1, len(a) + 1), lambda j: CASE WHEN a[j] = i OR b[j] = i THEN n[j] / (s[a[j] + 1] + s[b[j] + 1]) ELSE 0 END)))) AS t FROM s, l, wins WHERE k < 200))
SELECT m::VARCHAR AS model, round(1000 + 400 * log10(s[m + 1] / s[1]), 4) AS rating FROM s, (SELECT unnest(range(5)) AS m) WHERE k = 200""")
def elo_many_models(t: Tables) -> DataFrame:
    battles = t.events.select((F.col("event_id") % 5).cast("string").alias("a"), ((F.col("event_id") + 1 + F.col("event_id") % 4) % 5).cast("string").alias("b"), F.when(F.col("value") > 50, "a").when(F.col("value") > 25, "tie").otherwise("b").alias("winner"))
    return M.elo_ratings(battles.where("a <> b"), "a", "b", "winner", "0").select("model", rounded(F.col("rating"), "rating", 4))


@query("""SELECT round(avg(iou), 6) AS mean_iou, round(avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0 END), 6) AS acc_50, round(avg(inside), 6) AS centre FROM (
SELECT CASE WHEN u = 0 THEN 0 ELSE i / u END AS iou, CASE WHEN (px1 + px2) / 2 BETWEEN gx1 AND gx2 AND (py1 + py2) / 2 BETWEEN gy1 AND gy2 THEN 1.0 ELSE 0 END AS inside FROM (
SELECT *, greatest(0, least(px2, gx2) - greatest(px1, gx1)) * greatest(0, least(py2, gy2) - greatest(py1, gy1)) AS i,
 (px2 - px1) * (py2 - py1) + (gx2 - gx1) * (gy2 - gy1) - greatest(0, least(px2, gx2) - greatest(px1, gx1)) * greatest(0, least(py2, gy2) - greatest(py1, gy1)) AS u FROM (
SELECT l_quantity AS px1, l_linenumber * 1.0 AS py1, l_quantity + 20 AS px2, l_linenumber + 10.0 AS py2, 10.0 AS gx1, 2.0 AS gy1, 40.0 AS gx2, 12.0 AS gy2 FROM lineitem)))""")
def box_iou_acc(t: Tables) -> DataFrame:
    pred = F.array("l_quantity", F.col("l_linenumber") * 1.0, F.col("l_quantity") + 20, F.col("l_linenumber") + 10.0)
    gold = F.array(*map(F.lit, (10.0, 2.0, 40.0, 12.0)))
    iou = geometry.box_iou(pred, gold)
    return t.lineitem.agg(rounded(F.avg(iou), "mean_iou"), rounded(F.avg(geometry.iou_at(iou, 0.5)), "acc_50"), rounded(F.avg(geometry.centre_inside(pred, gold)), "centre"))


@query("""SELECT event_type, round(avg(greatest(0, least(b, 60) - greatest(a, 30)) / (least(greatest(b, 60) - least(a, 30), (b - a) + 30) + 1e-8)), 6) AS miou
FROM (SELECT event_type, value AS a, value + 25 AS b FROM events) GROUP BY 1""")
def temporal_iou(t: Tables) -> DataFrame:
    pred, gold = F.array("value", F.col("value") + 25), F.array(F.lit(30.0), F.lit(60.0))
    return t.events.groupBy("event_type").agg(rounded(F.avg(geometry.interval_iou(pred, gold)), "miou"))


_IOU = "greatest(0, least({0}.e, {1}.e) - greatest({0}.s, {1}.s)) / (least(greatest({0}.e, {1}.e) - least({0}.s, {1}.s), {0}.e - {0}.s + {1}.e - {1}.s) + 1e-8)"


@query(f"""WITH p AS (SELECT l_orderkey, row_number() OVER () AS i, l_quantity AS s, l_quantity + 10 AS e FROM lineitem), g AS (SELECT unnest([5.0, 20.0, 35.0]) AS s, unnest([15.0, 30.0, 50.0]) AS e),
x AS (SELECT l_orderkey, i, g.s AS gs, {_IOU.format('p', 'g')} > 0.3 AS hit FROM p, g),
a AS (SELECT l_orderkey, avg(CASE WHEN h THEN 1.0 ELSE 0 END) AS v FROM (SELECT l_orderkey, i, bool_or(hit) AS h FROM x GROUP BY 1, 2) GROUP BY 1), b AS (SELECT l_orderkey, avg(CASE WHEN h THEN 1.0 ELSE 0 END) AS v FROM (SELECT l_orderkey, gs, bool_or(hit) AS h FROM x GROUP BY 1, 2) GROUP BY 1)
SELECT l_orderkey, round(a.v, 6) AS precision, round(b.v, 6) AS recall FROM a JOIN b USING (l_orderkey)""")
def detection_precision(t: Tables) -> DataFrame:
    """Each order's lines are intervals [quantity, quantity + 10], against three targets."""
    orders = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.array("l_quantity", F.col("l_quantity") + 10)).alias("p"))
    golds = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ((5.0, 15.0), (20.0, 30.0), (35.0, 50.0))))
    precision, recall = geometry.detection_scores(F.col("p"), golds, 0.3)
    return orders.select("l_orderkey", rounded(precision, "precision"), rounded(recall, "recall"))


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
k AS (SELECT unnest([2, 4, 8]) AS k), x AS (SELECT k, user_id, event_type, rn, count(*) OVER (PARTITION BY k, user_id, event_type) AS c, min(rn) OVER (PARTITION BY k, user_id, event_type) AS f FROM r JOIN k ON rn <= k),
v AS (SELECT k, user_id, arg_max(event_type, c * 1000 - f) AS maj, max(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) AS cov, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) AS av FROM x GROUP BY 1, 2)
SELECT k::INT AS k, round(avg(cov), 6) AS cov, round(avg(CASE WHEN maj = 'click' THEN 1.0 ELSE 0 END), 6) AS maj, round(avg(av), 6) AS avg FROM v GROUP BY k""")
def cov_maj_avg_at_k(t: Tables) -> DataFrame:
    """Per user the first k events are repeats; the answer is "click"."""
    first = top_per_group(t.events, 8, ["user_id"], [F.col("event_id")])
    users = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type")))["event_type"].alias("resps"))
    rows = users.select("resps", F.explode(F.array(*map(F.lit, (2, 4, 8)))).alias("k")).select("k", F.slice("resps", F.lit(1), F.col("k")).alias("r"))
    hit = lambda x: (x == "click").cast("double")
    return rows.groupBy("k").agg(rounded(F.avg(F.array_max(F.transform("r", hit))), "cov"), rounded(F.avg(hit(majority(F.col("r")))), "maj"), rounded(F.avg(F.aggregate(F.transform("r", hit), F.lit(0.0), lambda s, x: s + x) / F.size("r")), "avg"))


@query("""WITH r AS (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events),
c AS (SELECT user_id, p // 4 AS q, list(value ORDER BY event_id) AS losses FROM r GROUP BY 1, 2)
SELECT round(avg(CASE WHEN list_position(losses, list_min(losses)) - 1 = (user_id + q) % 4 THEN 1.0 ELSE 0 END), 6) AS acc, count(*) AS questions,
 round(avg(CASE WHEN list_position(n, list_min(n)) - 1 = (user_id + q) % 4 THEN 1.0 ELSE 0 END), 6) AS acc_norm, round(avg(CASE WHEN list_position(m, list_min(m)) - 1 = (user_id + q) % 4 THEN 1.0 ELSE 0 END), 6) AS acc_mutual_info
FROM (SELECT *, list_transform(losses, lambda x, i: x / [1, 3, 2, 4][i]) AS n, list_transform(losses, lambda x, i: x - [10, 20, 30, 5][i]) AS m FROM c)""")
def mcq_argmin(t: Tables) -> DataFrame:
    """A user's events are losses, four to a question in order; the last question may have fewer choices."""
    numbered = positions(t.events.select("user_id", "event_id", "value"), ["event_id"], ["user_id"])
    q = numbered.groupBy("user_id", F.floor(F.col("_pos") / 4).alias("q")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value")))["value"].alias("v"))
    of = lambda *xs: F.slice(F.array(*map(F.lit, xs)), F.lit(1), F.size("v"))
    s = E.multiple_choice_scores(F.col("v"), of("a", "bbb", "cc", "dddd"), ((F.col("user_id") + F.col("q")) % 4).cast("int"), of(10.0, 20.0, 30.0, 5.0))
    return q.agg(*(rounded(F.avg(c), k) for k, c in s.items()), F.count("*").alias("questions"))


@query("""SELECT round(avg(m), 6) AS mean_fields, round(avg(least_), 6) AS mean_least FROM (SELECT
 CASE WHEN a < 0 AND b < 0 THEN -1 ELSE (CASE WHEN a >= 0 THEN 2 * a ELSE 0 END + CASE WHEN b >= 0 THEN b ELSE 0 END) / (CASE WHEN a >= 0 THEN 2 ELSE 0 END + CASE WHEN b >= 0 THEN 1 ELSE 0 END) END AS m,
 CASE WHEN a >= 0 AND b >= 0 THEN least(a, b) WHEN a >= 0 THEN a WHEN b >= 0 THEN b ELSE -1 END AS least_ FROM (SELECT c_acctbal AS a, c_acctbal - 3000 AS b FROM customer))""")
def weighted_valid_fields(t: Tables) -> DataFrame:
    fields = F.array("c_acctbal", F.col("c_acctbal") - 3000)
    return t.customer.agg(rounded(F.avg(M.weighted_fields(fields, F.array(F.lit(2.0), F.lit(1.0)))), "mean_fields"), rounded(F.avg(M.least_field(fields)), "mean_least"))


@query("SELECT round(avg(x), 6) AS mean, count(*) AS n FROM (SELECT unnest([value, value / 2, value * 2]) AS x FROM events)")
def flatten_mean(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select(F.explode(F.array(v, v / 2, v * 2)).alias("x")).agg(rounded(F.avg("x"), "mean"), F.count("*").alias("n"))


@query("SELECT label, round(stddev_pop(d), 4) AS spread, round(avg(d), 4) AS mean_norm FROM (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS d FROM embeddings) GROUP BY label")
def embedding_norms(t: Tables) -> DataFrame:
    d = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x))
    return t.embeddings.groupBy("label").agg(F.round(F.stddev_pop(d), 4).alias("spread"), F.round(F.avg(d), 4).alias("mean_norm"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS p, list_transform(embedding, lambda v: floor(v::DOUBLE * 10) / 10) AS g FROM embeddings)
SELECT vec_id, round(list_avg(list_transform(range(32), lambda i: exp(-10 * sqrt(power(p[2 * i + 1] - g[2 * i + 1], 2) + power(p[2 * i + 2] - g[2 * i + 2], 2)) / sqrt(2)))), 6) AS keypoints,
 round(1 - least(sqrt(list_avg(list_transform(range(64), lambda i: power(p[i + 1] - g[i + 1], 2)))), 0.1) / 0.1, 6) AS rescaled FROM x""")
def sequence_errors(t: Tables) -> DataFrame:
    """Each vector as 32 points, against itself rounded down."""
    p = F.transform("embedding", lambda v: v.cast("double"))
    e = t.embeddings.select("vec_id", p.alias("p"), F.transform(p, lambda v: F.floor(v * 10) / 10).alias("g"))
    points = lambda c: F.transform(F.filter(F.transform(c, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: x["i"] % 2 == 0), lambda x: F.slice(F.col(c), x["i"] + 1, F.lit(2)))
    return e.select("vec_id", rounded(geometry.keypoint_similarity(points("p"), points("g")), "keypoints"), rounded(T.rescaled_error(F.col("p"), F.col("g")), "rescaled"))


@query()
def bootstrap_interval(t: Tables) -> DataFrame:
    return M.bootstrap(scored(t), F.col("hit"), ["lang"], resamples=200)


@query("""SELECT l_returnflag, round(b - a, 6) AS delta FROM (SELECT l_returnflag, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY 1)""")
def model_compare_delta(t: Tables) -> DataFrame:
    from rubrica.operators.selection import compare_models

    a = t.lineitem.groupBy("l_returnflag").agg(F.avg("l_discount").alias("v"))
    b = t.lineitem.groupBy("l_returnflag").agg(F.avg("l_tax").alias("v"))
    return compare_models(a, b, ["l_returnflag"], "v").select("l_returnflag", rounded(F.col("delta"), "delta"))


@query("SELECT r_name, count(*) FILTER (WHERE h) AS hits, CASE WHEN count(DISTINCT h) = 1 THEN bool_and(h) END AS agreed FROM (SELECT r_name, n_nationkey % 2 = 0 AS h FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")
def higher_is_better(t: Tables) -> DataFrame:
    h = F.col("n_nationkey") % 2 == 0
    j = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.count_if(h).alias("hits"), F.when(F.min(h) == F.max(h), F.max(h)).alias("agreed"))


@query("""SELECT coalesce(event_type, 'Total') AS subtask, round(avg(value), 6) AS score, count(*) AS n FROM events WHERE value <> -1 GROUP BY GROUPING SETS ((event_type), ())""")
def subset_means_total(t: Tables) -> DataFrame:
    g = t.events.where("value <> -1").groupingSets([[F.col("event_type")], []], "event_type").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return g.select(F.coalesce("event_type", F.lit("Total")).alias("subtask"), rounded(F.col("v"), "score"), "n")


@query("""SELECT user_id, event_id, min(value) OVER w AS first_start, max(value) OVER w AS last_end, count(*) OVER w AS seen FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def window_running_state(t: Tables) -> DataFrame:
    from rubrica.operators.selection import running_topics

    return running_topics(t.events, ["ts", "event_id"], ["user_id", "event_type"], "value", "value").select("user_id", "event_id", "first_start", "last_end", "seen")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(value) AS n, round(sum(value), 4) AS num FROM events GROUP BY 1, 2""")
def windowed_means(t: Tables) -> DataFrame:
    from rubrica.streaming.metrics import windowed_means as batch

    return batch(t.events, "ts", "value", "event_type").select("start", "event_type", "n", rounded(F.col("num"), "num", 4))


@query("""WITH s AS (SELECT user_id, bool_and(event_id % 9 <> 0) AS a FROM events GROUP BY 1)
SELECT round(stddev_samp(CASE WHEN a THEN 1.0 ELSE 0 END) / sqrt(count(*)), 6) AS all_correct_stderr FROM s""")
def all_correct_error(t: Tables) -> DataFrame:
    return M.all_correct_stderr(t.events, F.col("event_id") % 9 != 0, ["user_id"]).select(rounded(F.col("all_correct_stderr"), "all_correct_stderr"))


@query("SELECT round(sum(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 0.5 ELSE 0 END * CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) / 1000, 6) AS total FROM events")
def weighted_kinds(t: Tables) -> DataFrame:
    return M.weighted_sum(t.events, (F.col("event_id") % 3 == 0).cast("int"), "event_type", {"click": 2, "view": 0.5}, 1000).select(rounded(F.col("total"), "total"))


@query("""WITH c AS (SELECT event_id % 4 AS g, user_id % 4 AS p FROM events), n AS (SELECT count(*)::DOUBLE AS s, sum(CASE WHEN g = p THEN 1 ELSE 0 END)::DOUBLE AS c FROM c),
k AS (SELECT sum(tk * pk) AS tp, sum(tk * tk) AS tt, sum(pk * pk) AS pp FROM (SELECT k, sum(CASE WHEN g = k THEN 1 ELSE 0 END)::DOUBLE AS tk, sum(CASE WHEN p = k THEN 1 ELSE 0 END)::DOUBLE AS pk FROM c, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY k))
SELECT round((c * s - tp) / sqrt((s * s - tt) * (s * s - pp)), 6) AS mcc FROM n, k""")
def mcc_of_classes(t: Tables) -> DataFrame:
    return t.events.agg(rounded(M.matthews_classes(F.col("event_id") % 4, F.col("user_id") % 4, 4), "mcc"))
