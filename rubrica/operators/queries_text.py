"""Row-level text, number and extraction functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.functions import arrow, extract, instructions, template
from rubrica.functions import text as T
from rubrica.operators import metrics as M
from rubrica.operators.registry import Tables, query, rounded

_TOKENS = "list_filter(string_split_regex(lower({0}), '[ \\n\\t]+'), lambda x: x <> '')"
_PAIRS = "(SELECT a.conv_id, a.turn, a.text AS gold, b.text AS pred FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) p"


def pairs(t: Tables) -> DataFrame:
    """Neighbouring turns of a conversation: the first as target, the second as prediction.

    Few bytes but much work a row: as many tasks as a shuffle has, not as few
    as the bytes would fill.
    """
    c = t.conversations
    a = c.select("conv_id", "turn", F.col("text").alias("gold"))
    both = a.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred")), ["conv_id", "turn"])
    return both.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")))


@query(r"""SELECT p_partkey, CASE WHEN regexp_replace(lower(p_name), '[[:punct:][:digit:]]', '', 'g') = regexp_replace(lower(p_type), '[[:punct:][:digit:]]', '', 'g') THEN 1.0::DOUBLE ELSE 0 END AS em,
 CASE WHEN regexp_replace(lower(p_brand), '[[:digit:]#]', '', 'g') = 'brand' THEN 1.0::DOUBLE ELSE 0 END AS brand FROM part""")
def exact_match_normalised(t: Tables) -> DataFrame:
    how = {"ignore_case": True, "ignore_punctuation": True, "ignore_numbers": True}
    return t.part.select("p_partkey", T.exact_match(F.col("p_name"), F.col("p_type"), **how).alias("em"), T.exact_match(F.col("p_brand"), F.lit("BRAND"), **how).alias("brand"))


@query("SELECT p_partkey, CASE WHEN lower(split_part(p_name, ' ', 1)) IN (lower(split_part(p_type, ' ', 1)), lower(split_part(p_type, ' ', 2)), lower(p_brand)) THEN 1.0::DOUBLE ELSE 0 END AS em FROM part")
def exact_match_any_target(t: Tables) -> DataFrame:
    """A name's first word against the type's words and the brand."""
    word = lambda c, i: F.coalesce(F.get(F.split(c, " "), F.lit(i)), F.lit(""))
    return t.part.select("p_partkey", T.any_match(lambda g: T.exact_match(F.upper(word("p_name", 0)), g, ignore_case=True), F.array(word("p_type", 0), word("p_type", 1), F.col("p_brand"))).alias("em"))


@query(r"SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '[0-9]+') THEN regexp_extract(p_brand, '([0-9]+)', 1) ELSE '[invalid]' END AS digits, CASE WHEN regexp_matches(p_name, 'zzz') THEN 'zzz' ELSE '[invalid]' END AS none FROM part")
def regex_extract_filter(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", extract.regex_group(F.col("p_brand"), r"([0-9]+)", -1).alias("digits"), extract.regex_group(F.col("p_name"), "(zzz)").alias("none"))


@query("""SELECT p_partkey, round(CASE WHEN 1 - d >= 0.5 THEN 1 - d ELSE 0 END, 6) AS anls FROM (SELECT p_partkey, least(levenshtein(lower(p_type), lower(p_name)) / greatest(length(p_type), length(p_name))::DOUBLE, levenshtein(lower(p_brand), lower(p_name)) / greatest(length(p_brand), length(p_name))::DOUBLE) AS d FROM part)""")
def anls(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", rounded(T.anls(F.col("p_name"), F.array("p_type", "p_brand")), "anls"))


@query("SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS distance, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE, 6) AS similarity FROM part")
def levenshtein_pairs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"), rounded(T.similarity(F.col("p_name"), F.col("p_type")), "similarity"))


@query("SELECT round(100.0 * sum(levenshtein(p_name, p_type)) / sum(length(p_type)), 6) AS cer FROM part")
def cer_corpus(t: Tables) -> DataFrame:
    return t.part.agg(rounded(M.error_rate(F.levenshtein("p_name", "p_type"), F.length("p_type")), "cer"))


_DP_EDIT = """list_reduce(list_concat([range(0, len(p) + 1)], list_transform(g, lambda w: list_concat([-1::BIGINT], list_transform(p, lambda v: CASE WHEN v = w THEN 0 ELSE 1 END::BIGINT)))),
 lambda row, cost: list_reduce(list_concat([[row[1] + 1]], list_transform(range(1, len(p) + 1), lambda j: [row[j + 1] + 1, row[j] + cost[j + 1]])), lambda acc, c: list_append(acc, least(c[1], c[2], acc[len(acc)] + 1))))"""
_DP_COMMON = """list_reduce(list_concat([list_transform(range(0, len(p) + 1), lambda z: 0::BIGINT)], list_transform(g, lambda w: list_concat([-1::BIGINT], list_transform(p, lambda v: CASE WHEN v = w THEN 1 ELSE 0 END::BIGINT)))),
 lambda row, same: list_reduce(list_concat([[0::BIGINT]], list_transform(range(1, len(p) + 1), lambda j: [row[j + 1], row[j] + same[j + 1]])), lambda acc, c: list_append(acc, greatest(c[1], c[2], acc[len(acc)]))))"""


@query(f"""WITH x AS (SELECT conv_id, turn, {_TOKENS.format('pred')} AS p, {_TOKENS.format('gold')} AS g FROM {_PAIRS}), d AS (SELECT p, g, {_DP_EDIT} AS r FROM x)
SELECT round(100.0 * sum(r[len(r)]) / sum(len(g)), 6) AS wer FROM d""")
def wer_corpus(t: Tables) -> DataFrame:
    """Word error rate of neighbouring turns, inside the JVM."""
    p = pairs(t).select(T.tokens(F.lower("pred")).alias("p"), T.tokens(F.lower("gold")).alias("g"))
    return p.agg(rounded(M.error_rate(T.token_distance(F.col("p"), F.col("g")), F.size("g")), "wer"))


@query()
def ter_corpus(t: Tables) -> DataFrame:
    """Translation edit rate of neighbouring turns: no SQL finds the moves."""
    p = pairs(t).select(T.tokens(F.lower("pred")).alias("p"), T.tokens(F.lower("gold")).alias("g"))
    return p.agg(rounded(M.error_rate(arrow.translation_edits("p", "g"), F.size("g")), "ter"))




@query(f"""WITH x AS (SELECT conv_id, turn, {_TOKENS.format('pred')} AS p, {_TOKENS.format('gold')} AS g FROM {_PAIRS}),
pc AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS w FROM x) GROUP BY ALL), gc AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(g) AS w FROM x) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(pc.n, gc.n)) AS c FROM pc JOIN gc USING (conv_id, turn, w) GROUP BY 1, 2)
SELECT conv_id, turn, round(CASE WHEN len(p) + len(g) = 0 THEN 1 ELSE 2.0 * coalesce(c, 0) / (len(p) + len(g)) END, 6) AS f1 FROM x LEFT JOIN o USING (conv_id, turn)""")
def token_f1(t: Tables) -> DataFrame:
    p = pairs(t).select("conv_id", "turn", T.tokens(F.lower("pred")).alias("p"), T.tokens(F.lower("gold")).alias("g"))
    return p.select("conv_id", "turn", rounded(T.f1(T.overlap(F.col("p"), F.col("g")), F.size("p"), F.size("g")), "f1"))


@query(f"""SELECT conv_id, turn, round(CASE WHEN len(u) = 0 THEN 1 ELSE len(i) / len(u)::DOUBLE END, 6) AS jaccard, round(CASE WHEN len(dp) = 0 THEN 1 ELSE len(i) / len(dp)::DOUBLE END, 6) AS precision, round(CASE WHEN len(dg) = 0 THEN 1 ELSE len(i) / len(dg)::DOUBLE END, 6) AS recall FROM
(SELECT conv_id, turn, list_distinct(p) AS dp, list_distinct(g) AS dg, list_intersect(list_distinct(p), list_distinct(g)) AS i, list_distinct(list_concat(p, g)) AS u FROM (SELECT conv_id, turn, {_TOKENS.format('pred')} AS p, {_TOKENS.format('gold')} AS g FROM {_PAIRS})) """)
def jaccard_tokens(t: Tables) -> DataFrame:
    p = pairs(t).select("conv_id", "turn", T.tokens(F.lower("pred")).alias("p"), T.tokens(F.lower("gold")).alias("g"))
    s = T.set_scores(F.col("p"), F.col("g"))
    return p.select("conv_id", "turn", *(rounded(s[k], k) for k in ("jaccard", "precision", "recall")))


@query(f"""WITH x AS (SELECT conv_id, turn, {_TOKENS.format('pred')} AS p, {_TOKENS.format('gold')} AS g FROM {_PAIRS}),
n AS (SELECT unnest([1, 2, 3, 4]) AS n), pg AS (SELECT conv_id, turn, n, array_to_string(p[i:i + n - 1], ' ') AS w, count(*) AS c FROM (SELECT *, unnest(range(1, len(p) - n + 2)) AS i FROM x, n) GROUP BY ALL),
gg AS (SELECT conv_id, turn, n, array_to_string(g[i:i + n - 1], ' ') AS w, count(*) AS c FROM (SELECT *, unnest(range(1, len(g) - n + 2)) AS i FROM x, n) GROUP BY ALL),
m AS (SELECT n, sum(least(pg.c, coalesce(gg.c, 0))) AS m, sum(pg.c) AS t FROM pg LEFT JOIN gg USING (conv_id, turn, n, w) GROUP BY n), l AS (SELECT sum(len(p))::DOUBLE AS p, sum(len(g))::DOUBLE AS g FROM x)
SELECT round(CASE WHEN min(m) = 0 THEN 0 ELSE 100 * any_value(CASE WHEN l.p > l.g THEN 1 ELSE exp(1 - l.g / l.p) END) * exp(avg(ln(m / t::DOUBLE))) END, 4) AS bleu FROM m, l""")
def bleu_corpus(t: Tables) -> DataFrame:
    p = pairs(t).select(T.tokens(F.lower("pred")).alias("p"), T.tokens(F.lower("gold")).alias("g"))
    return M.bleu(p, F.col("p"), F.col("g")).select(F.round("bleu", 4).alias("bleu"))


_CHARS = "regexp_replace({0}, '\\s+', '', 'g')"


@query(f"""WITH x AS (SELECT p_partkey AS k, {_CHARS.format('p_name')} AS p, {_CHARS.format('p_type')} AS g FROM part), n AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS n),
pc AS (SELECT k, n, substr(p, i, n) AS w, count(*) AS c FROM (SELECT *, unnest(range(1, length(p) - n + 2)) AS i FROM x, n) GROUP BY ALL), gc AS (SELECT k, n, substr(g, i, n) AS w, count(*) AS c FROM (SELECT *, unnest(range(1, length(g) - n + 2)) AS i FROM x, n) GROUP BY ALL),
m AS (SELECT n, sum(least(pc.c, gc.c))::DOUBLE AS m FROM pc JOIN gc USING (k, n, w) GROUP BY n), a AS (SELECT n, sum(c)::DOUBLE AS a FROM pc GROUP BY n), b AS (SELECT n, sum(c)::DOUBLE AS b FROM gc GROUP BY n)
SELECT round(100 * sum(coalesce(5 * (m / a) * (m / b) / (4 * (m / a) + m / b), 0)) / 6, 6) AS chrf FROM n LEFT JOIN m USING (n) LEFT JOIN a USING (n) LEFT JOIN b USING (n)""")
def chrf_corpus(t: Tables) -> DataFrame:
    return M.chrf(t.part.select("p_name", "p_type"), F.col("p_name"), F.col("p_type")).select(rounded(F.col("chrf"), "chrf"))


@query(f"""WITH x AS (SELECT conv_id, turn, {_TOKENS.format('pred')} AS p, {_TOKENS.format('gold')} AS g FROM {_PAIRS}), d AS (SELECT conv_id, turn, p, g, {_DP_COMMON} AS r FROM x)
SELECT conv_id, turn, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN 0 ELSE 2.0 * r[len(r)] / (len(p) + len(g)) END, 6) AS rouge_l FROM d""")
def rouge_l(t: Tables) -> DataFrame:
    p = pairs(t).select("conv_id", "turn", T.tokens(F.lower("pred")).alias("p"), T.tokens(F.lower("gold")).alias("g"))
    return p.select("conv_id", "turn", rounded(arrow.rouge_l(F.col("p"), F.col("g")), "rouge_l"))


_GRAMS = "SELECT id, {0}n, array_to_string(t[i:i + n - 1], ' ') AS g, count(*)::DOUBLE AS tf FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS i FROM {1}, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL"


@query(f"""WITH c AS (SELECT p_partkey AS id, {_TOKENS.format('p_name')} AS t FROM part), r AS (SELECT p_partkey AS id, 1 AS ref, {_TOKENS.format('p_type')} AS t FROM part UNION ALL SELECT p_partkey, 2, {_TOKENS.format('p_name')} FROM part),
rc AS ({_GRAMS.format('ref, ', 'r')}), cc AS ({_GRAMS.format('', 'c')}), k AS (SELECT ln(count(DISTINCT id)::DOUBLE) AS top FROM r), df AS (SELECT n, g, count(*)::DOUBLE AS df FROM (SELECT DISTINCT id, n, g FROM rc) GROUP BY ALL),
rw AS (SELECT id, ref, rc.n, rc.g, tf * (top - ln(df)) AS w FROM rc JOIN df ON df.n = rc.n AND df.g = rc.g, k), cw AS (SELECT id, cc.n, cc.g, tf * (top - ln(coalesce(df, 1))) AS w FROM cc LEFT JOIN df ON df.n = cc.n AND df.g = cc.g, k),
rn AS (SELECT id, ref, n, sqrt(sum(w * w)) AS norm FROM rw GROUP BY ALL), cn AS (SELECT id, n, sqrt(sum(w * w)) AS norm FROM cw GROUP BY ALL),
d AS (SELECT rw.id, ref, rw.n, sum(least(rw.w, cw.w) * rw.w) AS dot FROM rw JOIN cw ON rw.id = cw.id AND rw.n = cw.n AND rw.g = cw.g GROUP BY ALL),
v AS (SELECT d.id, d.ref, CASE WHEN rn.norm * cn.norm = 0 THEN 0 ELSE dot / (rn.norm * cn.norm) END * exp(-power(len(c.t) - len(r.t), 2) / 72) AS v FROM d JOIN rn ON rn.id = d.id AND rn.ref = d.ref AND rn.n = d.n JOIN cn ON cn.id = d.id AND cn.n = d.n JOIN c ON c.id = d.id JOIN r ON r.id = d.id AND r.ref = d.ref)
SELECT c.id, round(10 * coalesce(sum(v), 0) / 8, 6) AS cider FROM c LEFT JOIN v USING (id) GROUP BY c.id""")
def cider(t: Tables) -> DataFrame:
    """Parts as images: the name is the caption, brand and type are references."""
    cand = t.part.select(F.col("p_partkey").alias("id"), T.tokens(F.lower("p_name")).alias("tokens"))
    refs = t.part.select(F.col("p_partkey").alias("id"), F.explode(F.array("p_type", "p_name")).alias("x")).select("id", T.tokens(F.lower("x")).alias("tokens"))
    return M.cider(cand, refs).select("id", rounded(F.col("cider"), "cider"))


@query("""SELECT p_partkey, damerau_levenshtein(p_name, p_type)::INT AS distance, CASE WHEN 1 - damerau_levenshtein(p_name, reverse(p_name)) / length(p_name)::DOUBLE >= 0.9 THEN 1.0::DOUBLE ELSE 0 END AS near FROM part""")
def damerau_near_match(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", arrow.damerau_levenshtein("p_name", "p_type").alias("distance"), arrow.near_match(F.col("p_name"), F.reverse("p_name")).alias("near"))


@query()
def block_ratios(t: Tables) -> DataFrame:
    """Matching blocks: no SQL finds them."""
    return t.part.select("p_partkey", rounded(arrow.block_ratio("p_name", "p_type"), "ratio"))


@query("""WITH x AS (SELECT p_partkey, replace(p_name, ' ', '') AS a, replace(p_type, ' ', '') AS b FROM part UNION ALL SELECT -1 - p_partkey, replace(p_name, ' ', ''), replace(p_name || p_type, ' ', '') FROM part)
SELECT p_partkey, CAST(len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i))) AS BIGINT) AS same FROM x""")
def common_prefix(t: Tables) -> DataFrame:
    """Names against types, and against themselves with the type behind."""
    x = t.part.select("p_partkey", "p_name", "p_type")
    x = x.unionByName(x.select((-1 - F.col("p_partkey")).alias("p_partkey"), "p_name", F.concat("p_name", "p_type").alias("p_type")))
    return x.select("p_partkey", T.common_prefix(T.characters(F.col("p_name")), T.characters(F.col("p_type"))).alias("same"))


@query("""SELECT l_returnflag, round(avg(CASE WHEN abs(l_extendedprice - q) / q <= 0.05 THEN 1.0 ELSE 0 END), 6) AS relaxed, count(*) AS n FROM (SELECT l_returnflag, l_extendedprice, p_retailprice * l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def relaxed_accuracy(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    hit = T.relaxed_match(F.col("l_extendedprice").cast("string"), (F.col("p_retailprice") * F.col("l_quantity")).cast("string"))
    return j.groupBy("l_returnflag").agg(rounded(F.avg(hit), "relaxed"), F.count("*").alias("n"))


@query("""SELECT l_returnflag, round(avg((""" + " + ".join(f"CASE WHEN e <= 1 - (0.5 + 0.45 * {i} / 9) THEN 1.0 ELSE 0 END" for i in range(10)) + """) / 10), 6) AS mra FROM (SELECT l_returnflag, abs(l_extendedprice - p_retailprice * l_quantity) / abs(p_retailprice * l_quantity) AS e FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def mean_relative_accuracy(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("l_returnflag").agg(rounded(F.avg(T.relative_accuracy(F.col("l_extendedprice"), F.col("p_retailprice") * F.col("l_quantity"))), "mra"))


@query("SELECT c_custkey, round(greatest(0, 1 - abs(c_acctbal - 5000) / 5000), 6) AS ratio FROM customer")
def difference_ratio(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", rounded(T.difference_ratio(F.col("c_acctbal"), F.lit(5000.0)), "ratio"))


@query("""WITH a AS (SELECT user_id, list(event_type) AS ans FROM events GROUP BY 1)
SELECT user_id, round(list_sum(list_transform(ans, lambda x: least(1.0, (len(list_filter(ans, lambda y: y = 'click')) - CASE WHEN x = 'click' THEN 1 ELSE 0 END) / 3.0))) / len(ans), 6) AS acc FROM a""")
def vqa_soft_accuracy(t: Tables) -> DataFrame:
    """All events of a user are annotators' answers; what they agree on is counted, not gathered."""
    a = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("hits"), F.count("*").alias("n"))
    return a.select("user_id", rounded(T.vqa_share(F.col("hits"), F.col("n")), "acc"))


@query("SELECT p_partkey, 'Brand ' || p_brand || ': ' || lower(trim(p_name)) || ' (' || p_size || ')' AS prompt FROM part")
def template_render(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", template.render("Brand {{ p_brand }}: {{ p_name.strip() | lower }} ({{ p_size }})").alias("prompt"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderpriority LIKE '%1%' THEN 1 ELSE 0 END AS INT) AS binary_, CAST(least(greatest(CAST(substr(o_orderpriority, 1, 1) AS DOUBLE), 2), 4) AS DOUBLE) AS score FROM orders")
def judge_parsers(t: Tables) -> DataFrame:
    r = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", extract.judge_binary(r).alias("binary_"), extract.judge_score(r, 2.0, 4.0).alias("score"))


@query("SELECT event_id, CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(second FROM ts) AS DOUBLE) AS secs FROM events")
def clock_seconds(t: Tables) -> DataFrame:
    return t.events.select("event_id", extract.seconds(F.date_format("ts", "HH:mm:ss")).alias("secs"))


@query("SELECT event_id, CAST(floor(value) AS BIGINT) // 60 || ':' || lpad((CAST(floor(value) AS BIGINT) % 60)::VARCHAR, 2, '0') AS clock FROM events")
def clock_format(t: Tables) -> DataFrame:
    return t.events.select("event_id", extract.clock(F.col("value")).alias("clock"))


@query("SELECT o_orderkey, array_to_string(range(o_orderkey % 50, o_orderkey % 50 + 3), ',') || ',100' AS ids FROM orders")
def id_expansion(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 50
    spec = F.concat(k.cast("string"), F.lit("-"), (k + 2).cast("string"), F.lit(", 100, "), k.cast("string"))
    return t.orders.select("o_orderkey", F.array_join(extract.id_list(spec).cast("array<string>"), ",").alias("ids"))


@query("SELECT event_id, CASE WHEN event_id % 6 < 5 THEN substr('ABCDE', event_id % 5 + 1, 1) END AS letter FROM events")
def letter_extraction(t: Tables) -> DataFrame:
    """Responses of six forms, the last without a letter, each with the event's properties around."""
    letter, around = F.substring(F.lit("abcde"), (F.col("event_id") % 5 + 1).cast("int"), F.lit(1)), F.lower("props")
    up = F.upper(letter)
    forms = [F.concat(up, F.lit(". "), around), F.concat(F.lit("Well, the answer is ("), up, F.lit(") because "), around), F.concat(around, F.lit(" so ("), up, F.lit(")")), F.concat(F.lit("Option "), up, F.lit(" fits "), around), F.concat(around, F.lit(" "), up, F.lit(")")), around]
    resp = F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    return t.events.select("event_id", extract.choice_letter(resp, "ABCDE").alias("letter"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'yes' WHEN event_id % 3 = 1 THEN 'no' END AS first, CASE WHEN event_id % 3 = 0 THEN 'yes' WHEN event_id % 3 = 1 THEN 'no' ELSE 'other' END AS prefix FROM events")
def yes_no_parse(t: Tables) -> DataFrame:
    r = F.when(F.col("event_id") % 3 == 0, " Yes, there is no doubt").when(F.col("event_id") % 3 == 1, "No. yes?").otherwise("maybe")
    return t.events.select("event_id", extract.yes_no_first(r).alias("first"), extract.yes_no_prefix(r).alias("prefix"))


@query("SELECT doc_id, NOT contains(text, ',') AS no_comma, text = lower(text) AND text <> upper(text) AS all_lower, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) >= 200 AS counted, starts_with(trim(text), '\"') AND ends_with(trim(text), '\"') AND length(trim(text)) > 1 AS quoted FROM documents")
def instruction_checks(t: Tables) -> DataFrame:
    r = F.col("text")
    c = instructions.CHECKS
    return t.documents.select("doc_id", c["punctuation:no_comma"](r).alias("no_comma"), c["change_case:english_lowercase"](r).alias("all_lower"), c["length_constraints:number_words"](r, num_words=200, relation="at least").alias("counted"), c["startend:quotation"](r).alias("quoted"))


@query(f"""WITH x AS (SELECT conv_id, turn, pred, gold, regexp_extract_all(lower(pred), '[\\p{{L}}\\p{{N}}_]+') AS p, regexp_extract_all(lower(gold), '[\\p{{L}}\\p{{N}}_]+') AS g FROM {_PAIRS}),
pc AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS w FROM x) GROUP BY ALL), gc AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(g) AS w FROM x) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(pc.n, gc.n)) AS c FROM pc JOIN gc USING (conv_id, turn, w) GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(c, 0) BETWEEN 2 AND 8 AS paragraph, regexp_matches(pred, '(?m)^\\s*The') AS started,
 regexp_matches(pred, '\\*.*\\*') AND regexp_matches(gold, '\\*.*\\*') AND regexp_replace(pred, '\\*.*\\*', '', 'g') = regexp_replace(gold, '\\*.*\\*', '', 'g') AS rephrase
FROM x LEFT JOIN o USING (conv_id, turn)""")
def rephrase_checks(t: Tables) -> DataFrame:
    c = instructions.CHECKS
    r, gold = F.col("pred"), F.col("gold")
    paragraph = c["detectable_content:rephrase_paragraph"](r, original_paragraph=gold, low=2, high=8)
    return pairs(t).select("conv_id", "turn", paragraph.alias("paragraph"), c["multi-turn:constrained_start"](r, starter="The").alias("started"), c["detectable_format:rephrase"](r, original_message=gold).alias("rephrase"))


@query("SELECT doc_id, CAST(greatest(0, ceil(n / 64.0)) AS BIGINT) AS windows, CAST(n AS BIGINT) AS tokens FROM (SELECT doc_id, len(regexp_extract_all(text, '[^ \\n\\t]+')) AS n FROM documents)")
def rolling_windows(t: Tables) -> DataFrame:
    from rubrica.operators.selection import rolling_token_windows

    w = rolling_token_windows(F.col("w"), 64)
    d = t.documents.select("doc_id", T.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", w.alias("x")).select("doc_id", F.size("x").cast("long").alias("windows"), F.aggregate("x", F.lit(0), lambda s, y: s + F.size(y["targets"])).cast("long").alias("tokens"))


@query("SELECT conv_id, turn, round(len(regexp_extract_all(text, '[^ \\n\\t]+')) * 1.5, 6) AS tokens, round(len(regexp_extract_all(text, '[^ \\n\\t]+')) * 1.5 / (turn + 1), 6) AS per_second FROM conversations")
def throughput(t: Tables) -> DataFrame:
    n = F.size(T.tokens(F.col("text"))) * 1.5
    return t.conversations.select("conv_id", "turn", rounded(n, "tokens"), rounded(F.try_divide(n, F.col("turn") + 1), "per_second"))


_ANSWER = "text || CASE doc_id % 4 WHEN 0 THEN ' *bold* [name] THE END.' WHEN 1 THEN chr(10) || 'P.S. see <<A title>>' WHEN 2 THEN chr(10) || '* one' || chr(10) || '- two' ELSE ' spam' END"


@query(rf"""WITH d AS (SELECT doc_id, {_ANSWER} AS r FROM documents)
SELECT doc_id, contains(lower(r), 'the') AND contains(lower(r), 'of') AS existence, NOT regexp_matches(r, '(?i)\bspam\b') AS forbidden, len(regexp_extract_all(r, '(?i)the')) >= 20 AS frequency, len(regexp_extract_all(lower(r), 'e')) < 300 AS letters,
 len(regexp_extract_all(r, '\[.*?\]')) >= 1 AS placeholders, regexp_matches(lower(r), '(?m)\s*p\.\s?s\..*$') AS postscript, len(regexp_extract_all(r, '(?m)^\s*\*[^\*].*$')) + len(regexp_extract_all(r, '(?m)^\s*-.*$')) = 2 AS bullets,
 len(list_filter(regexp_extract_all(r, '<<[^\n]+>>'), lambda x: trim(translate(x, '<>', '')) <> '')) > 0 AS title, len(list_filter(regexp_extract_all(r, '\*[^\n\*]*\*'), lambda x: trim(translate(x, '*', '')) <> '')) + len(list_filter(regexp_extract_all(r, '\*\*[^\n\*]*\*\*'), lambda x: trim(translate(x, '*', '')) <> '')) >= 1 AS highlights,
 ends_with(lower(regexp_replace(trim(r, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '^"+|"+$', '', 'g')), 'the end.') AS ending, regexp_matches(r, '(?m)^\s*The') AS started, r = upper(r) AND r <> lower(r) AS upper_case, contains(r, 'My answer is yes.') OR contains(r, 'My answer is no.') OR contains(r, 'My answer is maybe.') AS constrained FROM d""")
def instruction_marks(t: Tables) -> DataFrame:
    """Whole texts with one of four endings, against thirteen checks."""
    d, c, r = t.documents.select("doc_id", F.expr(_ANSWER).alias("r")), instructions.CHECKS, F.col("r")
    checks = {
        "existence": c["keywords:existence"](r, ["the", "of"]), "forbidden": c["keywords:forbidden_words"](r, ["spam"]), "frequency": c["keywords:frequency"](r, "the", 20, "at least"), "letters": c["keywords:letter_frequency"](r, "e", 300, "less than"),
        "placeholders": c["detectable_content:number_placeholders"](r, 1), "postscript": c["detectable_content:postscript"](r, "P.S."), "bullets": c["detectable_format:number_bullet_lists"](r, 2), "title": c["detectable_format:title"](r),
        "highlights": c["detectable_format:number_highlighted_sections"](r, 1), "ending": c["startend:end_checker"](r, "The end."), "started": c["multi-turn:constrained_start"](r, "The"), "upper_case": c["change_case:english_capital"](r), "constrained": c["detectable_format:constrained_response"](r),
    }
    return d.select("doc_id", *(x.alias(k) for k, x in checks.items()))
