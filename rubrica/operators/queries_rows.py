"""Selection, joins, windows, sets and sources over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.functions.filters import apply_pipelines
from rubrica.operators import selection as S
from rubrica.operators.registry import Tables, query, rounded
from rubrica.plans import evaluate as E
from rubrica.sources import io


@query("SELECT event_id FROM events WHERE event_id % 8 = 3")
def stride_shard(t: Tables) -> DataFrame:
    return S.stride_shard(t.events, 3, 8, "event_id").select("event_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id < (SELECT ceil(count(*) * 0.25) FROM documents)")
def limit_fraction(t: Tables) -> DataFrame:
    """A limit operator: the first quarter by position."""
    return S.limit_docs(t.documents.select("doc_id", "lang"), 0.25)


@query("SELECT part, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT event_id, CAST(ntile(7) OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS INT) AS part FROM events) GROUP BY 1")
def ntile_divide(t: Tables) -> DataFrame:
    return S.divide(t.events, 7, ["event_id"], ["event_type"]).groupBy("part").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("SELECT user_id, chunk, count(*) AS n FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS chunk FROM events) GROUP BY 1, 2")
def fixed_chunks(t: Tables) -> DataFrame:
    return S.chunks(t.events, 16, ["event_id"], ["user_id"]).groupBy("user_id", "chunk").agg(F.count("*").alias("n"))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events WHERE value > 5) WHERE rn <= 50")
def topn_per_group(t: Tables) -> DataFrame:
    """A top-k report: the 50 highest of each type above a threshold."""
    return S.top_per_group(t.events.where("value > 5"), 50, ["event_type"], [F.desc("value"), F.col("event_id")]).select("event_type", "event_id", "value")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_per_key(t: Tables) -> DataFrame:
    return S.latest_per_key(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT c_custkey + 1000000000, 'NEW' FROM customer WHERE c_custkey % 3 = 0")
def leaderboard_upsert(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    fresh = base.where("c_custkey % 3 = 0").withColumn("segment", F.lit("NEW"))
    return S.upsert(base, fresh.unionByName(fresh.withColumn("c_custkey", F.col("c_custkey") + 1000000000)), ["c_custkey"])


@query("SELECT p_partkey, [0, CAST(floor(1 * (p_size + 9) / 4.0) AS INT), CAST(floor(2 * (p_size + 9) / 4.0) AS INT), CAST(floor(3 * (p_size + 9) / 4.0) AS INT), CAST(p_size + 9 AS INT)]::VARCHAR AS idx FROM part")
def uniform_indices(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.lit("["), F.array_join(S.uniform_indices(F.col("p_size") + 10, 5), ", "), F.lit("]")).alias("idx"))


@query("SELECT n_name FROM nation WHERE n_name LIKE '%1%' OR n_name LIKE 'A%'")
def wildcard_match(t: Tables) -> DataFrame:
    return S.matching(t.nation, "n_name", ["*1*", "A*"]).select("n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_seen(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_missing(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT lang, round(avg(coalesce(quality, 0)), 6) AS score, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def left_zero_fill(t: Tables) -> DataFrame:
    filled = S.zero_filled(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", F.col("quality").cast("double").alias("q")), ["doc_id"], "q")
    return filled.groupBy("lang").agg(rounded(F.avg("q"), "score"), F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_members(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT c_nationkey AS k, 'customer' AS side, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier', count(*) FROM supplier GROUP BY 1")
def union_by_name(t: Tables) -> DataFrame:
    c = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n")).withColumn("side", F.lit("customer"))
    return c.unionByName(t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")).withColumn("side", F.lit("supplier")))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events), m AS (SELECT user_id, event_id, p, unnest(range(CAST(greatest(0, floor((p - 16) / 8.0) + 1) AS BIGINT), p // 8 + 1)) AS w FROM r) SELECT user_id, w AS \"window\", count(*) AS n, CAST(sum(p - w * 8) AS BIGINT) AS places FROM m GROUP BY 1, 2")
def sliding_windows(t: Tables) -> DataFrame:
    return S.sliding_windows(t.events, 16, 8, ["ts", "event_id"], ["user_id"]).groupBy("user_id", "window").agg(F.count("*").alias("n"), F.sum("place").alias("places"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 20""")
def cosine_topk(t: Tables) -> DataFrame:
    """A top-k report: the 20 nearest to the first vector."""
    first = t.embeddings.where("vec_id = 0").first()["embedding"]
    return S.cosine_top(t.embeddings, first, 20).select("vec_id")


@query("""WITH RECURSIVE v AS (SELECT list(vec_id ORDER BY vec_id) AS ids, list(list_transform(embedding, lambda x: x::DOUBLE) ORDER BY vec_id) AS e FROM embeddings),
s(step, pick, d) AS (SELECT 0, 1::BIGINT, list_transform(e, lambda x: list_sum(list_transform(range(1, len(x) + 1), lambda i: power(x[i] - e[1][i], 2)))) FROM v
 UNION ALL SELECT step + 1, list_position(d, list_max(d))::BIGINT, list_transform(range(1, len(d) + 1), lambda k: least(d[k], list_sum(list_transform(range(1, len(e[1]) + 1), lambda i: power(e[k][i] - e[list_position(d, list_max(d))][i], 2))))) FROM s, v WHERE step < 9)
SELECT step::INT AS step, ids[pick] AS id FROM s, v""")
def kcenter_greedy(t: Tables) -> DataFrame:
    """A sampling operator: 10 centres."""
    return S.k_center(t.embeddings, 10)


@query()
def fewshot_random(t: Tables) -> DataFrame:
    """Five shots for each benchmark item, from the others."""
    items = t.benchmark.select(F.col("item_id").alias("doc_id"), "text")
    return S.fewshot_random(items, items, 5).select("doc_id", F.transform("shots", lambda x: x["doc_id"]).alias("shots"))


@query("SELECT item_id, (SELECT string_agg(item_id::VARCHAR, ',' ORDER BY item_id) FROM benchmark WHERE item_id < 3) AS shots FROM benchmark")
def fewshot_first(t: Tables) -> DataFrame:
    shots = S.fewshot_first(t.benchmark, 3, "item_id").agg(F.array_join(F.array_sort(F.collect_list("item_id")).cast("array<string>"), ",").alias("shots"))
    return t.benchmark.select("item_id").join(F.broadcast(shots))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def chat_turn_stats(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text")).alias("chars"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id")
def chat_messages(t: Tables) -> DataFrame:
    m = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("m"))
    return m.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["n"].cast("string"))), "|").alias("messages"))


@query("SELECT conv_id, turn, sha256(role || chr(31) || text) AS key FROM conversations")
def request_keys(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.sha2(F.concat_ws("\x1f", "role", "text"), 256).alias("key"))


@query("SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM (SELECT turn % 2 = 0 AS hit FROM conversations)")
def response_cache(t: Tables) -> DataFrame:
    requests = t.conversations.select("conv_id", "turn", io.request_key(F.col("conv_id"), F.col("turn")).alias("key"))
    cache = requests.where("turn % 2 = 0").select("key", F.lit("cached").alias("resp"))
    hits, misses = io.split_by_cache(requests, cache)
    both = hits.select(F.lit(1).alias("h")).unionByName(misses.select(F.lit(0).alias("h")))
    return both.agg(F.count_if(F.col("h") == 1).alias("hits"), F.count_if(F.col("h") == 0).alias("misses"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events")
def props_json_parse(t: Tables) -> DataFrame:
    props = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.element_at(F.map_values(props), 1).alias("first_value"))


_SHOWN = "regexp_replace(regexp_replace(html, '(?is)<(script|style|head|noscript|template)\\b.*?</(script|style|head|noscript|template)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query(f"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace({_SHOWN}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def page_capture(t: Tables) -> DataFrame:
    """What a captured page shows, as one line."""
    return t.pages.select("page_id", io.page_text(F.col("html")).alias("text"))


@query(r"""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text AS resp FROM conversations WHERE role = 'assistant'), j AS (SELECT * FROM u JOIN a USING (conv_id, turn)),
s AS (SELECT 'none' AS filter_key, CASE WHEN resp = text THEN 1.0 ELSE 0 END AS v FROM j UNION ALL SELECT 'lower', CASE WHEN lower(resp) = lower(text) OR lower(resp) = text THEN 1.0 ELSE 0 END FROM j)
SELECT 'chat' AS task, 'exact_match' AS metric, filter_key, round(avg(v), 6) AS value, count(*) AS n FROM s GROUP BY filter_key""")
def evaluate_end_to_end(t: Tables) -> DataFrame:
    """User turns as documents, the answers that follow as responses, two filter pipelines."""
    turns = t.conversations
    doc_id = F.xxhash64("conv_id", "turn")
    docs = turns.where("role = 'user'").select(doc_id.alias("doc_id"), "text")
    answers = turns.where("role = 'assistant'").select(F.xxhash64("conv_id", F.col("turn") - 1).alias("doc_id"), F.lit("chat").alias("task"), F.lit(0).alias("idx"), F.lit(0).alias("repeat"), F.col("text").alias("resp"))
    task = E.Task("chat", doc_to_text="Q: {{ text }}", doc_to_target="text", filters={"none": ["take_first"], "lower": ["take_first", "lowercase"]}, scores={"exact_match": lambda r, g: ((r == g) | (r == F.lower(g))).cast("double")})
    return E.evaluate(docs, answers, task).select("task", "metric", "filter_key", F.round("value", 6).alias("value"), "n")


@query("""WITH r AS (SELECT user_id, list(event_type ORDER BY event_id) AS l FROM events GROUP BY 1)
SELECT user_id, 'first' AS filter_key, l[1] AS resp FROM r UNION ALL SELECT user_id, 'upper3', array_to_string(list_transform(l[1:3], lambda x: upper(x)), ',') FROM r
UNION ALL SELECT user_id, 'mapped', CASE l[1] WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE '?' END FROM r""")
def filter_pipelines(t: Tables) -> DataFrame:
    # no pipeline looks beyond the third response
    first = S.top_per_group(t.events, 3, ["user_id"], [F.col("event_id")])
    users = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type")))["event_type"].alias("resps"))
    pipes = {"first": ["take_first"], "upper3": [lambda r: F.slice(r, 1, 3), "uppercase"], "mapped": ["take_first", ("map", {"mapping": {"click": "C", "view": "V"}, "default": "?"})]}
    return apply_pipelines(users, pipes).select("user_id", "filter_key", F.array_join("resp", ",").alias("resp"))


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events), c AS (SELECT user_id, event_type, count(*) AS n, min(p) AS f FROM e GROUP BY 1, 2)
SELECT user_id, event_type AS vote FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def majority_vote(t: Tables) -> DataFrame:
    """Relational form, for any number of repeats: counts and first places combine before the shuffle."""
    votes = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return votes.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("vote"))


@query("SELECT user_id, count(*) AS logs, max(event_id) AS newest FROM events GROUP BY 1")
def log_replay(t: Tables) -> DataFrame:
    logs = t.events.select(F.lit("t").alias("task"), F.col("user_id").alias("doc_id"), F.col("event_id").alias("log_time"), "event_id")
    counts = logs.groupBy("doc_id").agg(F.count("*").alias("logs"))
    return io.replayed(logs).join(counts, "doc_id").select(F.col("doc_id").alias("user_id"), "logs", F.col("event_id").alias("newest"))


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) - 1) // 64 AS batch FROM orders")
def keyed_batches(t: Tables) -> DataFrame:
    """Orders of one priority together, the dearest first, 64 to a batch."""
    return S.keyed_batches(t.orders, ["o_orderpriority"], F.col("o_totalprice"), "o_orderkey", 64).select("o_orderkey", "batch")


@query("SELECT part, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM (SELECT l_extendedprice, CAST(ntile(7) OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) - 1 AS INT) AS part FROM lineitem) GROUP BY 1")
def divide_all(t: Tables) -> DataFrame:
    """The whole table in seven contiguous parts, without one task that sees it all."""
    d = S.divide(t.lineitem.select("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"), 7, ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"])
    return d.groupBy("part").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NULL OR ts - before >= INTERVAL 6 HOUR GROUP BY 1")
def event_sessions(t: Tables) -> DataFrame:
    from rubrica.streaming.metrics import sessions

    return sessions(t.events, gap="6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"))
