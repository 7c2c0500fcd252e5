"""Queries of the operators over the whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.llm.curriculum import mix
from tarnish.llm.decontaminate import decontaminate
from tarnish.llm.fertility import tokenizer_rules
from tarnish.llm.licenses import scan_licenses
from tarnish.llm.line_dedup import drop_repeated_lines
from tarnish.llm.maxent import score_texts
from tarnish.llm.negatives import hard_negatives
from tarnish.llm.packing import pack, special_tokens
from tarnish.llm.quality import score_quality
from tarnish.llm.search import search
from tarnish.llm.simhash import near_duplicates
from tarnish.llm.text import documents
from tarnish.llm.toxicity import score_toxicity
from tarnish.llm.urls import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    special = special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special)


@query("op6_decontaminate")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(documents(spark, sf_dir, "doc_id", "text"), benchmark, with_text=False)
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query("op8_simhash_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


OP10_SQL = r"""
WITH l AS (
  SELECT d.doc_id, unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos
  FROM documents d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op10_line_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(documents(spark, sf_dir, "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op9_licenses")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir, "doc_id", "text"), with_text=False).drop("blocks")


@query("op4_tokenizer_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    rows = documents(spark, sf_dir, "doc_id", "text", "lang")
    judged = tokenizer_rules(rows, public.path("piece_bpe_32k.model"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    return judged.drop("lang")


@query("op7_url_filter")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "words", "log_odds")


@query("op2_maxent_score")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir, "doc_id", "text"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
b AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(len(terms))::BIGINT AS big_l FROM d WHERE len(terms) > 0),
tf AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (
  SELECT row, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, totals),
s AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l)))))::BIGINT AS score
  FROM b JOIN w USING (term) JOIN tf USING (term), totals GROUP BY item_id, row, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


@query("op11_ranked_search", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '~') AS name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(text, '')) AS tie,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT name, sum(size)::BIGINT AS source_size FROM d GROUP BY name),
p AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS no FROM s),
q AS (SELECT *, [5.0, 2.0, 1.0][(no % 3 + 1)::INTEGER]::DOUBLE AS weight FROM p),
c AS (
  SELECT *, 1.5 * (sum(source_size) OVER ())::DOUBLE AS wanted,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS taken,
         sum(weight) OVER (ORDER BY 2 * source_size / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM q),
-- The first source, by the level at which it is full, that stays below its limit sets the level for all after it.
f AS (SELECT arg_min(wanted - taken, 2 * source_size / weight) AS over, arg_min(rest, 2 * source_size / weight) AS rest
  FROM c WHERE 2 * source_size > weight * ((wanted - taken) / rest)),
t AS (SELECT name, no, source_size, CASE WHEN f.rest IS NULL OR 2 * source_size <= weight * (over / f.rest) THEN (2 * source_size)::DOUBLE
  ELSE weight * over / f.rest END AS target FROM c LEFT JOIN f ON true),
l AS (
  SELECT d.*, no, source_size, target, floor(target)::BIGINT AS wanted,
         coalesce(sum(size) OVER (PARTITION BY name ORDER BY h, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM d JOIN t USING (name)),
u AS (
  SELECT *, least(greatest(wanted - first, 0), size) + least(greatest(wanted - first - source_size, 0), size) AS taken,
         CASE WHEN size > 0 AND first < wanted THEN first / target END AS x FROM l)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN x IS NULL THEN NULL WHEN x <= 0 THEN 0.0
       WHEN no % 3 = 0 THEN 2.0 * x / (1.5 + sqrt(2.25 - 2.0 * x))
       WHEN no % 3 = 1 THEN x
       WHEN x <= 0.3125 THEN 2.0 * x / (0.25 + sqrt(0.0625 + 3.0 * x))
       ELSE 0.5 + 2.0 * (x - 0.3125) / (1.0 + sqrt(1.0 + 3.0 * (x - 0.3125))) END::DOUBLE AS position
FROM u
"""


@query("op12_curriculum", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir, "doc_id", "text", "source"), with_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
