"""One query for each operator, over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm import exact, html_text, licenses, mixing, packing, quality, rules, sharding, simhash, tokens
from rubrica.llm.common import read

PRODUCTION_RULES = rules.Rules()


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.array_join("shards", ",").alias("shards"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.find_copies(read(spark, sf_dir, "documents"), keep="largest").withColumnRenamed("digest", "text_sha256")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(read(spark, sf_dir, "documents"), PRODUCTION_RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_token_counts, op2_source_mix, op3_simhash, op4_quality, op5_html_text, op6_packing, op7_shards, op8_licenses, op9_exact_dedup, op10_quality_rules)
    return {f.__name__: f for f in named}


_OP9 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


#: Spellings as SQL reads them, written for the SQL alone.
_SPELL = """MAP {'acknowledgement': 'acknowledgment', 'analogue': 'analog', 'analyse': 'analyze', 'artefact': 'artifact', 'authorisation': 'authorization', 'authorised': 'authorized', 'calibre': 'caliber', 'cancelled': 'canceled',
 'capitalisations': 'capitalizations', 'catalogue': 'catalog', 'categorise': 'categorize', 'centre': 'center', 'emphasised': 'emphasized', 'favour': 'favor', 'favourite': 'favorite', 'fulfil': 'fulfill', 'fulfilment': 'fulfillment',
 'https': 'http', 'initialise': 'initialize', 'judgement': 'judgment', 'labelling': 'labeling', 'labour': 'labor', 'licence': 'license', 'licences': 'licenses', 'licenced': 'licensed', 'maximise': 'maximize', 'modelled': 'modeled',
 'modelling': 'modeling', 'noncommercial': 'non commercial', 'offence': 'offense', 'optimise': 'optimize', 'organisation': 'organization', 'organise': 'organize', 'practise': 'practice', 'programme': 'program', 'realise': 'realize',
 'recognise': 'recognize', 'signalling': 'signaling', 'sublicence': 'sublicense', 'utilisation': 'utilization', 'whilst': 'while', 'wilful': 'willful', 'wilfull': 'willful'}"""


def _op8() -> str:
    """The scan against fixed digests, made once by a plain program from the licences' texts."""
    fixed = files("rubrica.llm").joinpath("license_texts/digests.csv").read_text("utf-8").split()[1:]
    known = ", ".join("('{}', '{}')".format(*row.split(",")) for row in fixed)
    # spaces doubled, so that neighbouring phrases don't share one
    phrase = "replace(' ' || replace(l, ' ', '  ') || ' ', ' copyright  holder ', ' copyright  owner ')"
    phrase = f"replace(replace({phrase}, ' per  cent ', ' percent '), ' sub  license ', ' sublicense ')"
    return f"""
WITH known AS (SELECT * FROM (VALUES {known}) AS t(digest, license_id)), spelling AS (SELECT {_SPELL} AS m),
rows AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS t FROM documents),
raw AS (SELECT r, i, trim(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS x FROM (SELECT r, unnest(string_split(replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '©', 'c'), chr(10))) AS x, unnest(range(1, len(string_split(replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '©', 'c'), chr(10))) + 1)) AS i FROM rows)),
kept AS (SELECT r, i, array_to_string(list_transform(string_split(x, ' '), lambda w: coalesce(m[w], w)), ' ') AS l FROM raw, spelling WHERE x <> '' AND NOT regexp_matches(x, '^(copyright|c) (c |[0-9])') AND x <> 'all rights reserved'),
lines AS (SELECT r, i, trim(replace({phrase}, '  ', ' ')) AS l FROM kept),
whole AS (SELECT r, doc_id, sha256(coalesce(string_agg(l, ' ' ORDER BY i), '')) AS text_digest FROM rows LEFT JOIN lines USING (r) GROUP BY r, doc_id),
notices AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM lines JOIN known ON digest = sha256(l) GROUP BY r)
SELECT doc_id, text_digest, license_id, coalesce(notices, '') AS notices FROM whole LEFT JOIN known ON digest = text_digest LEFT JOIN notices USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """Queries 1 to 7 and 10 are tested against brute force, round trips or held-out rows: SQL can't express them."""
    return {"op8_licenses": _op8(), "op9_exact_dedup": _OP9}
