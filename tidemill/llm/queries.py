"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.ann import search
from tidemill.llm.common import scratch
from tidemill.llm.linededup import line_dedup
from tidemill.llm.mixing import mix
from tidemill.llm.packing import pack
from tidemill.llm.quality import MEASURES, quality
from tidemill.llm.sharding import shard_by_bytes
from tidemill.llm.simhash import simhash_components
from tidemill.llm.tokenbin import read_token_files, write_token_files
from tidemill.llm.urlfilter import judge_urls
from tidemill.llm.warc import round_trip

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), digest_only=True)


OP2_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_STRIP}), '{_UPPER}', '{_UPPER.lower()}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(f.holder <> k.doc_id, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", *MEASURES, "base_failed", "kept", "posterior")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=24)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return read_token_files(spark, folder)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources at equal weight: the rarer ones are repeated, a source with a third of all rows is thinned."""
    mixed = mix(table(spark, sf_dir, "documents"), weights=None, growth=1.0, seed=0, keep=["doc_id", "source"], most_rate=None)
    return mixed.withColumn("rate", F.round("rate", 9))


OP7_SQL = """
WITH RECURSIVE s AS (SELECT source, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents GROUP BY source),
t AS (SELECT sum(bytes)::BIGINT AS all_bytes, count(*)::DOUBLE AS all_weights FROM s),
q AS (SELECT source, 1.0::DOUBLE * all_bytes * 1.0::DOUBLE / all_weights / bytes AS rate FROM s, t),
r AS (SELECT source, rate, greatest(1, ceil(rate / 16))::BIGINT AS draws, rate / greatest(1, ceil(rate / 16)) AS mean FROM q),
c(source, rate, mean, k, term, upto) AS (
  SELECT source, rate, mean, 0, exp(-mean), exp(-mean) FROM r
  UNION ALL SELECT source, rate, mean, k + 1, term * mean / (k + 1), upto + term * mean / (k + 1) FROM c WHERE k < 63),
j AS (SELECT doc_id, d.source, draws, unnest(range(1, draws + 1)) AS draw FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
u AS (SELECT doc_id, source, (('0x' || substr(md5(CASE WHEN draws = 1 THEN '0:' || doc_id::VARCHAR ELSE 'draw-0:' || doc_id::VARCHAR || ':' || draw::VARCHAR END), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS x FROM j),
n AS (SELECT u.doc_id, u.source, c.rate, count(*) FILTER (WHERE c.upto < u.x) AS copies
  FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY u.doc_id, u.source, c.rate),
e AS (SELECT doc_id, source, rate, copies, unnest(range(0, copies)) AS copy FROM n WHERE copies > 0)
SELECT doc_id, source, round(rate, 9) AS rate, copies::BIGINT AS copies, copy::BIGINT AS copy, md5('order-0:' || doc_id::VARCHAR || ':' || copy::VARCHAR) AS shuffle_key FROM e
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2, capacity=1024)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_ann": op1_ann, "op2_line_dedup": op2_line_dedup, "op3_quality": op3_quality, "op4_sharding": op4_sharding, "op5_token_files": op5_token_files, "op6_simhash": op6_simhash, "op7_mixing": op7_mixing, "op8_warc": op8_warc, "op9_packing": op9_packing, "op10_url_filter": op10_url_filter}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op7_mixing": OP7_SQL}
