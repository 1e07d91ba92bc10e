"""Filters, parsers, frame search, live benchmarks, judges, sinks and caches over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.functions import arrow, extract, geometry, speech, timeline
from rubrica.functions import text as T
from rubrica.functions.filters import apply_pipelines
from rubrica.operators import frames
from rubrica.operators import metrics as M
from rubrica.operators import selection as S
from rubrica.operators.queries_metrics import _GROUPED, _NATIONS, _members, _nation_results
from rubrica.operators.queries_text import _DP_COMMON, _PAIRS, _TOKENS, pairs
from rubrica.operators.registry import Tables, query, rounded
from rubrica.plans import evaluate as E
from rubrica.sources import io
from rubrica.sources.staging import shared_folder


def _place(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/rubrica/{uuid.uuid4().hex}"


@query("""WITH e AS (SELECT event_id, substr('ABCDE', event_id % 5 + 1, 1) AS x FROM events)
SELECT event_id, 'two' AS filter_key, ' (' || x || ') three|three: ' || x AS resp FROM e UNION ALL SELECT event_id, 'bare', '(' || x || ') three' FROM e UNION ALL SELECT event_id, 'figures', ' (' || x || ') 3' FROM e
UNION ALL SELECT event_id, 'letters', '(' || x || ')|(' || x || ')' FROM e UNION ALL SELECT event_id, 'named', CASE x WHEN 'A' THEN 'A' WHEN 'B' THEN 'B' ELSE x END || '|' || x FROM e""")
def response_filters(t: Tables) -> DataFrame:
    """Two responses of each event through five pipelines, in one scan."""
    x = F.substring(F.lit("ABCDE"), (F.col("event_id") % 5 + 1).cast("int"), F.lit(1))
    rows = t.events.select("event_id", F.array(F.concat(F.lit(" ("), x, F.lit(") three")), F.concat(F.lit("three: "), x)).alias("resps"))
    question = F.lit("Which?\nA. pear\nB. fig\nC. kiwi")
    pipes = {"two": [("take_first_k", {"k": 2})], "bare": ["take_first", "remove_whitespace"], "figures": ["take_first", "number_words"], "letters": ["multi_choice_regex"], "named": [("simple_multi_choice", {"question": question})]}
    return apply_pipelines(rows, pipes).select("event_id", "filter_key", F.array_join("resp", "|").alias("resp"))


@query(r"""SELECT conv_id, turn, turn::VARCHAR AS answer, '\frac{' || turn || '}{4}' AS boxed, 1.0::DOUBLE AS same, CASE WHEN turn = 2 THEN 1.0::DOUBLE ELSE 0 END AS half FROM conversations""")
def reasoning_and_math(t: Tables) -> DataFrame:
    """Each turn as thoughts before an answer in a tag, and a fraction in a box against figures."""
    n = F.col("turn").cast("string")
    resp = F.concat(F.lit("<think>"), "text", F.lit("</think> So \\boxed{1}, or \\boxed{\\frac{"), n, F.lit("}{4}} <answer> "), n, F.lit("\n</answer>"))
    box = extract.boxed(resp)
    same = T.math_equal(box, (F.col("turn") / 4).cast("string"))
    return t.conversations.select("conv_id", "turn", extract.reasoning_answer(resp).alias("answer"), box.alias("boxed"), same.alias("same"), T.math_equal(box, F.lit("50\\%")).alias("half"))


@query("""WITH d AS (SELECT p_partkey, 1 - levenshtein(lower(p_type), lower(p_name)) / greatest(length(p_type), length(p_name))::DOUBLE AS a, 1 - levenshtein(lower(p_brand), lower(p_name)) / greatest(length(p_brand), length(p_name))::DOUBLE AS b FROM part)
SELECT p_partkey, round(greatest(CASE WHEN a > 0.5 THEN a ELSE 0 END, CASE WHEN b > 0.5 THEN b ELSE 0 END), 6) AS anls, round(greatest(a, b), 6) AS best FROM d""")
def best_over_targets(t: Tables) -> DataFrame:
    golds = F.array("p_type", "p_brand")
    best = T.best_of(lambda g: T.similarity(F.lower(g), F.lower("p_name")), golds)
    return t.part.select("p_partkey", rounded(T.anls_strict(F.col("p_name"), golds), "anls"), rounded(best, "best"))


@query("SELECT event_id, floor(value) AS start, CASE WHEN event_id % 3 < 2 THEN floor(value) + 7 END AS stop FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 3 = 2")
def interval_texts(t: Tables) -> DataFrame:
    """Intervals said in seconds, or as clock times; the third of them ends before it starts."""
    a = F.floor("value")
    clock = lambda s: F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("It runs from "), a, F.lit(" to "), a + 7, F.lit(" seconds."))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("At "), clock(a), F.lit(" until "), clock(a + 7))).otherwise(F.concat(a + 7, F.lit(" - "), a))
    i = extract.interval(said)
    return t.events.select("event_id", F.get(i, F.lit(0)).alias("start"), F.get(i, F.lit(1)).alias("stop"))


@query("""SELECT p_partkey, 'It isn''t (' || p_name || '), "' || p_brand || '".' AS running, regexp_replace('a/b:' || p_type || '?*', '["<>:/|\\\\?*\\[\\]]+', '__', 'g') AS name FROM part""")
def written_forms(t: Tables) -> DataFrame:
    tokens = F.concat(F.lit("It is n't ( "), "p_name", F.lit(' ) , "'), F.lit(" "), "p_brand", F.lit(' " .'))
    running = T.detokenised(F.replace(tokens, F.lit(', "'), F.lit(', \x00"')))
    return t.part.select("p_partkey", F.replace(running, F.lit("\x00"), F.lit("")).alias("running"), T.sanitised(F.concat(F.lit("a/b:"), "p_type", F.lit("?*"))).alias("name"))


@query("""SELECT event_id AS id, subtask, score FROM (SELECT event_id, event_type AS subtask, value / 10 AS score, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events WHERE value > 50 AND event_type <> 'view') WHERE r <= 50""")
def live_quality(t: Tables) -> DataFrame:
    """A top-k report: items above a score, without one stratum, the 50 best of each."""
    items = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("subtask"), (F.col("value") / 10).alias("score"))
    return frames.quality_checked(items, 5.0, 50, ["view"]).select("id", "subtask", "score")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events)
SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS indices, string_agg(printf('%.2fs', event_id / 25.0), ',' ORDER BY event_id) AS frame_time FROM r WHERE r <= 4 GROUP BY 1""")
def frame_selection(t: Tables) -> DataFrame:
    """A top-k report: a user's four highest events as frames of a video, in time order."""
    scores = t.events.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_index"), F.col("value").alias("score"))
    best = frames.selected_frames(scores, 4, F.lit(25.0))
    return best.select(F.col("video_id").alias("user_id"), F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"), "frame_time")


@query("""WITH q AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY 1), s AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id) AS r FROM embeddings JOIN q USING (label))
SELECT label, vec_id FROM s WHERE r <= 5""")
def caption_frames(t: Tables) -> DataFrame:
    """A top-k report: the five vectors of a label nearest to its first."""
    f = t.embeddings.select(F.col("label").alias("video_id"), F.col("vec_id").alias("frame_index"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    q = f.groupBy("video_id").agg(F.min_by("embedding", "frame_index").alias("embedding"))
    return frames.caption_similarity(f, q, 5).select(F.col("video_id").alias("label"), F.col("frame_index").alias("vec_id"))


@query("""WITH b AS (SELECT conv_id, turn, turn % 2 AS k, CASE WHEN turn % 3 = 0 THEN conv_id ELSE turn END AS a, CASE WHEN turn % 3 = 0 THEN conv_id + 2 ELSE turn + 1 END AS z FROM conversations)
SELECT conv_id, turn, 'topic ' || k AS topic, min(a) OVER w::DOUBLE AS t_start, max(z) OVER w::DOUBLE AS t_end, count(*) OVER w AS seen FROM b WINDOW w AS (PARTITION BY conv_id, k ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def known_topics(t: Tables) -> DataFrame:
    """Turns as bullets on two topics; a third of them have a time anchor, the others their window's."""
    anchor = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" [t="), F.col("conv_id") + 2, F.lit("→"), "conv_id", F.lit(" s]"))).otherwise(" [note]")
    bullet = F.concat(F.lit("Topic  "), F.col("turn") % 2, F.replace(anchor, F.lit(" [note]"), F.lit("")))
    b = t.conversations.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("window"), F.lit(0).alias("pos"), bullet.alias("bullet"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"))
    return frames.known_info(b).select(F.col("video_id").alias("conv_id"), F.col("window").alias("turn"), "topic", "t_start", "t_end", "seen")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '[LOW] ' ELSE '' END || 'a man runs on [t = ' || event_id || ' s]' AS tidy FROM events")
def low_tags(t: Tables) -> DataFrame:
    mark = F.when(F.col("event_id") % 2 == 0, " [low, maybe] ").otherwise("  ")
    return t.events.select("event_id", timeline.low_tag(F.concat(F.lit(" a man [t=0.5→1 s]"), mark, F.lit("runs [t = "), "event_id", F.lit(" s]  on "))).alias("tidy"))


@query("""WITH old AS (SELECT url, 'titles' AS subtask, 'old' AS question, page_id AS id, 9.0::DOUBLE AS score FROM pages WHERE page_id % 4 = 0),
fresh AS (SELECT url, 'titles' AS subtask, regexp_extract(html, '<title>([^<]*)</title>', 1) AS question, (page_id % 10)::DOUBLE AS score FROM pages WHERE url NOT IN (SELECT url FROM old)),
numbered AS (SELECT url, subtask, question, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY url, subtask, question) AS id, score FROM fresh)
SELECT id, url, question FROM old UNION ALL SELECT id, url, question FROM (SELECT *, row_number() OVER (PARTITION BY subtask ORDER BY score DESC, id) AS r FROM numbered WHERE score > 5) WHERE r <= 50""")
def live_items(t: Tables) -> DataFrame:
    """Captured pages to new benchmark items behind the old ones; at most 50 new ones of a subtask, the best."""
    old = t.pages.where("page_id % 4 = 0").select("url", F.lit("titles").alias("subtask"), F.lit("old").alias("question"), F.col("page_id").alias("id"), F.lit(9.0).alias("score"))
    made = lambda p: p.select("url", F.lit("titles").alias("subtask"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("question"), "page_id")
    checked = lambda q: q.withColumn("score", (F.col("page_id") % 10).cast("double")).drop("page_id")
    return frames.live_benchmark(t.pages, old, made, checked).select("id", "url", "question")


@query("SELECT item_id AS request_id, 'Rate: ' || item_id AS judge_prompt, CASE WHEN item_id % 3 < 2 THEN 1 END AS score FROM benchmark")
def judge_round(t: Tables) -> DataFrame:
    """Prompts asked of the offline provider in batches; a third of the answers are lost."""
    asked = E.judge_prompts(t.benchmark.select(F.col("item_id").alias("request_id")), "Rate: {{ request_id }}")
    answers = E.ask(asked, "dummy", batch=8).where("request_id % 3 < 2")
    return E.judged(asked, answers, extract.judge_binary).select("request_id", "judge_prompt", "score")


@query("SELECT conv_id, turn, lower(text) AS target, CASE WHEN turn % 2 = 1 THEN text END AS resp FROM conversations")
def sample_log(t: Tables) -> DataFrame:
    """Samples written as JSON lines and read again: responses only where a filter changed them."""
    rows = t.conversations.select("conv_id", "turn", F.col("text").alias("doc"), F.lower("text").alias("target"), F.array("text").alias("resps"), F.array(F.when(F.col("turn") % 2 == 1, "x").otherwise(F.col("text"))).alias("filtered_resps"))
    io.write_samples(rows, place := _place(t))
    back = t.spark.read.schema("conv_id long, turn long, target string, resps array<string>").json(place)
    return back.select("conv_id", "turn", "target", F.get("resps", F.lit(0)).alias("resp"))


@query("SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS answer FROM part")
def submission_file(t: Tables) -> DataFrame:
    """Predictions written as one CSV file and read again."""
    io.write_submission(t.part.select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("answer")), place := _place(t), "csv")
    return io.read_table(t.spark, place, "csv", schema="p_partkey long, answer string")


@query("SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view, count(*) AS n FROM events GROUP BY 1")
def flat_samples(t: Tables) -> DataFrame:
    """A row for each user, with a column for each of two metrics."""
    keyed = t.events.select(F.lit("e").alias("task"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("metric"), "value")
    scores = keyed.where(F.col("metric").isin("click", "view")).groupBy("task", "doc_id", "metric").agg(F.max("value").alias("value"))
    wide = io.sample_table(keyed.groupBy("task", "doc_id").agg(F.count("*").alias("n")), scores)
    return wide.select(F.col("doc_id").alias("user_id"), "click", "view", "n")


@query("SELECT doc_id FROM documents WHERE doc_id < 17")
def limit_number(t: Tables) -> DataFrame:
    """A limit operator: the first 17 documents."""
    return S.limit_docs(t.documents.select("doc_id"), 17)


@query("""SELECT item_id AS doc_id, i::INT AS idx, ['yes', 'no'][i + 1] AS continuation, CASE WHEN u THEN '' ELSE 'Q' || item_id END AS prompt, CASE WHEN u THEN 'unconditional' ELSE 'multiple_choice' END AS request_type
FROM benchmark, (SELECT unnest([0, 1]) AS i), (SELECT unnest([false, true]) AS u)""")
def choice_requests(t: Tables) -> DataFrame:
    """Two requests for each choice, with and without the question."""
    task = E.Task("yn", "multiple_choice", "Q{{ doc_id }}", "doc_id", ("yes", "no"))
    return E.instances(t.benchmark.select(F.col("item_id").alias("doc_id")), task, mutual_info=True).select("doc_id", "idx", "continuation", "prompt", "request_type")


@query("""SELECT c_custkey, round(2 * 6371 * asin(sqrt(least(1, pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lon - 20) / 2), 2)))), 4) AS km FROM (SELECT c_custkey, c_nationkey * 3.0 AS lat, c_custkey % 180 * 1.0 AS lon FROM customer)""")
def places_apart(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", rounded(geometry.great_circle(F.lit(10.0), F.lit(20.0), F.col("c_nationkey") * 3.0, F.col("c_custkey") % 180 * 1.0), "km", 4))


@query(f"""WITH x AS (SELECT conv_id, turn, {_TOKENS.format('pred')} AS p, {_TOKENS.format('gold')} AS g FROM {_PAIRS}), d AS (SELECT conv_id, turn, p, g, {_DP_COMMON} AS r FROM x),
c AS (SELECT conv_id, turn, sum(least(a.n, b.n)) AS hits FROM (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS w FROM x) GROUP BY ALL) a JOIN (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(g) AS w FROM x) GROUP BY ALL) b USING (conv_id, turn, w) GROUP BY 1, 2)
SELECT conv_id, turn, round((CASE WHEN len(p) = 0 OR hits IS NULL THEN 0 ELSE hits / len(p)::DOUBLE * CASE WHEN len(p) > len(g) THEN 1 ELSE exp(1 - len(g) / len(p)::DOUBLE) END END + CASE WHEN len(p) = 0 OR len(g) = 0 THEN 0 ELSE 2.0 * r[len(r)] / (len(p) + len(g)) END) / 2, 6) AS score FROM d LEFT JOIN c USING (conv_id, turn)""")
def requery_score(t: Tables) -> DataFrame:
    """The mean of unigram BLEU and ROUGE-L."""
    p = pairs(t).select("conv_id", "turn", T.tokens(F.lower("pred")).alias("p"), T.tokens(F.lower("gold")).alias("g"))
    return p.select("conv_id", "turn", rounded((T.sentence_bleu1(F.col("p"), F.col("g")) + arrow.rouge_l(F.col("p"), F.col("g"))) / 2, "score"))


@query("SELECT unnest(range(0, (SELECT count(*) FROM events))) AS place")
def seeded_places(t: Tables) -> DataFrame:
    """Every place of a shuffle is taken once."""
    return S.hash_numbered(t.events.select("event_id"), "event_id", 7).select(F.col("_pos").alias("place"))


@query("SELECT p_partkey, array_to_string(list_sort([p_name, p_type, p_brand]), '|') AS options FROM part")
def shuffled_options(t: Tables) -> DataFrame:
    """Options in another order are still the same options."""
    return t.part.select("p_partkey", F.array_join(F.array_sort(S.shuffle_options(F.array("p_name", "p_type", "p_brand"), F.col("p_partkey"))), "|").alias("options"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * 2, 6) AS total FROM embeddings")
def vector_cache(t: Tables) -> DataFrame:
    """Vectors cached twice, the newer ones doubled: the newest of a key is read."""
    place = _place(t)
    v = t.embeddings.select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    io.write_vectors(v, place)
    io.write_vectors(v.withColumn("vector", F.transform("vector", lambda x: x * 2)), place)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return io.cached_vectors(t.spark, place).select(F.col("key").alias("vec_id"), rounded(total, "total"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[\p{M}\p{S}\p{P}]', ' ', 'g'), '\s+', ' ', 'g')) AS form FROM conversations")
def basic_transcripts(t: Tables) -> DataFrame:
    """Turns with an aside in brackets, which goes."""
    return t.conversations.select("conv_id", "turn", speech.basic(F.concat("text", F.lit(" [noise]"))).alias("form"))


@query(f"""WITH {_NATIONS}, {_GROUPED} SELECT g AS "group", round(max(value), 6) AS value FROM grp GROUP BY g""")
def group_best(t: Tables) -> DataFrame:
    """A group's metric by an aggregation of one's own: its best member."""
    return M.roll_up(_nation_results(t), M.closure(_members(t)), how=lambda value, n: F.max(value)).select("group", F.round("value", 6).alias("value"))


@query(r"SELECT p_partkey, lower(p_name) || '|is|n''t|' || lower(p_type) || '|2.5|''s|cat' AS tokens FROM (SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS p_name, array_to_string(string_split(p_type, ' '), '|') AS p_type FROM part)")
def caption_words(t: Tables) -> DataFrame:
    caption = F.concat("p_name", F.lit(" isn't, "), "p_type", F.lit(" (2.5's cat)."))
    return t.part.select("p_partkey", F.array_join(T.caption_tokens(caption), "|").alias("tokens"))
