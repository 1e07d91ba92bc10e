"""Field scores over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.functions import fields
from rubrica.functions import text as T
from rubrica.operators.queries_text import _PAIRS, _TOKENS, pairs
from rubrica.operators.registry import Tables, query, rounded


@query("""SELECT c_custkey, round(CASE WHEN x > 1 OR x < 0 THEN 0 ELSE greatest(0, 1 - sqrt(pow(x - 0.5, 2) + pow(y - 0.5, 2))) END, 6) AS closeness,
 CASE WHEN x BETWEEN 0.25 AND 0.75 AND y BETWEEN 0.25 AND 0.75 THEN 1.0::DOUBLE ELSE 0 END AS inside FROM (SELECT c_custkey, (c_custkey % 120) / 100.0::DOUBLE AS x, (c_custkey % 7) / 10.0::DOUBLE AS y FROM customer)""")
def tagged_points(t: Tables) -> DataFrame:
    x, y = F.col("c_custkey") % 120 / 100.0, F.col("c_custkey") % 7 / 10.0
    resp = F.concat(F.lit("It is at <point>"), x.cast("string"), F.lit(", "), y.cast("string"), F.lit("</point>."))
    p, box = fields.tagged_numbers(resp, "point", 2), fields.tagged_numbers(F.lit("<box>0.25, 0.25, 0.75, 0.75</box>"), "box", 4)
    return t.customer.select("c_custkey", rounded(fields.point_closeness(p, F.array(F.lit(0.5), F.lit(0.5))), "closeness"), fields.point_in_box(p, box).alias("inside"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 3 - 1 <= 0 AND p_size % 5 - 2 <= 0 THEN -1 WHEN p_size % 3 = p_size % 5 - 1 THEN 1 ELSE 0 END AS INT) AS score FROM part")
def positive_int_match(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fields.positive_int((F.col("p_size") % 3 - 1).cast("string"), (F.col("p_size") % 5 - 2).cast("string")).alias("score"))


@query("""SELECT p_partkey, CASE WHEN lower(trim(p_brand)) IN ('brand#12', 'brand#34') THEN 1.0::DOUBLE ELSE 0 END AS phrase,
 CASE WHEN list_sort(list_distinct(string_split(p_name, ' '))) = list_sort(list_distinct(string_split(p_type, ' '))) THEN 1.0::DOUBLE ELSE 0 END AS same FROM part""")
def phrases_and_sets(t: Tables) -> DataFrame:
    phrase = fields.phrase_match(F.concat(F.lit(" "), F.upper("p_brand")), F.array(F.lit("brand#12"), F.lit("Brand#34 ")))
    return t.part.select("p_partkey", phrase.alias("phrase"), fields.set_equal(fields.items(F.col("p_name"), " "), fields.items(F.col("p_type"), " ")).alias("same"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_quantity % 4 = 0 THEN 0 ELSE (1 + (10 - d) / (10 + d)) / 2 END, 6) AS iou FROM (SELECT *, l_tax * 50 AS d FROM lineitem)""")
def track_overlap(t: Tables) -> DataFrame:
    """Two boxes a row: one right, one moved aside; a fourth of the tracks lacks one."""
    box = lambda x: F.array(x, F.lit(0.0), x + 10, F.lit(1.0))
    right, moved = box(F.lit(0.0)), box(F.col("l_tax") * 50)
    preds = F.when(F.col("l_quantity") % 4 == 0, F.array(right)).otherwise(F.array(right, moved))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", rounded(fields.track_iou(preds, F.array(right, right)), "iou"))


@query(f"""WITH x AS (SELECT conv_id, turn, {_TOKENS.format('pred')} AS p, {_TOKENS.format('gold')} AS g FROM {_PAIRS}), n AS (SELECT unnest([1, 2]) AS n),
pc AS (SELECT conv_id, turn, n, array_to_string(p[i:i + n - 1], ' ') AS w, count(*) AS c FROM (SELECT *, unnest(range(1, len(p) - n + 2)) AS i FROM x, n) GROUP BY ALL),
gc AS (SELECT conv_id, turn, n, array_to_string(g[i:i + n - 1], ' ') AS w, count(*) AS c FROM (SELECT *, unnest(range(1, len(g) - n + 2)) AS i FROM x, n) GROUP BY ALL),
o AS (SELECT conv_id, turn, n, sum(least(pc.c, gc.c)) AS c FROM pc JOIN gc USING (conv_id, turn, n, w) GROUP BY ALL),
f AS (SELECT conv_id, turn, n, CASE WHEN len(p) < n OR len(g) < n THEN 0 ELSE 2.0 * coalesce(c, 0) / (len(p) + len(g) - 2 * n + 2) END AS f FROM x CROSS JOIN n LEFT JOIN o USING (conv_id, turn, n))
SELECT conv_id, turn, round(max(f) FILTER (n = 1), 6) AS rouge_1, round(max(f) FILTER (n = 2), 6) AS rouge_2 FROM f GROUP BY 1, 2""")
def rouge_1_2(t: Tables) -> DataFrame:
    p = pairs(t).select("conv_id", "turn", T.tokens(F.lower("pred")).alias("p"), T.tokens(F.lower("gold")).alias("g"))
    return p.select("conv_id", "turn", *(rounded(fields.rouge_n(F.col("p"), F.col("g"), n), f"rouge_{n}") for n in (1, 2)))


@query("""WITH a AS (SELECT user_id, event_type AS k, list_distinct(list(event_id % 5) FILTER (event_id % 2 = 0)) AS p, list_distinct(list(event_id % 5) FILTER (event_id % 2 = 1)) AS g FROM events GROUP BY 1, 2),
b AS (SELECT user_id, len(list_intersect(coalesce(p, []), coalesce(g, []))) / len(list_distinct(list_concat(coalesce(p, []), coalesce(g, []))))::DOUBLE AS j FROM a)
SELECT user_id, round(avg(j), 6) AS jaccard FROM b GROUP BY 1""")
def map_of_sets_jaccard(t: Tables) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    digit = (F.col("event_id") % 5).cast("string")
    a = t.events.groupBy("user_id", "event_type").agg(F.collect_set(F.when(even, digit)).alias("p"), F.collect_set(F.when(~even, digit)).alias("g"))
    entry = lambda c: F.map_from_entries(F.collect_list(F.when(F.size(c) > 0, F.struct("event_type", c))))
    return a.groupBy("user_id").agg(entry("p").alias("p"), entry("g").alias("g")).select("user_id", rounded(fields.map_jaccard(F.col("p"), F.col("g")), "jaccard"))


@query()
def best_window_match(t: Tables) -> DataFrame:
    """The part's type sought in its name and type, word by word."""
    d = t.part.select("p_partkey", T.tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("p"), T.tokens(F.col("p_type")).alias("g"))
    return d.select("p_partkey", *(rounded(v, k) for k, v in fields.window_scores(F.col("p"), F.col("g")).items()))
