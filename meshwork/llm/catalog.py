"""The dealt operators as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwork.llm import line_dedup
from meshwork.llm.common import table
from meshwork.llm.exact_dedup import exact_dedup
from meshwork.llm.license_scan import scan
from meshwork.llm.mixing import MOST_COPIES, SHARE, mix
from meshwork.llm.near_dedup import near_groups
from meshwork.llm.packing import packed_digests
from meshwork.llm.quality_classifier import quality_scores
from meshwork.llm.quality_rules import quality
from meshwork.llm.sharding import shard
from meshwork.llm.toxicity import toxicity


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark, sf_dir):
    return line_dedup.clean_pages(table(spark, sf_dir, "pages"))


def op2_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))


def op7_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packed_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_license_scan(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"]))).withColumn("spans", F.array_join("spans", ","))


def op10_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[(turn % 3 + 1)::INT]::DOUBLE AS weight, (source_size * {MOST_COPIES})::DOUBLE AS cap FROM s),
r AS (
  SELECT *, cap / weight AS ratio,
    ({SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM w WINDOW o AS (ORDER BY cap / weight, turn)),
g AS (SELECT source, source_size, least(cap, (SELECT arg_min(rate, (ratio, turn)) FROM r WHERE rate <= ratio) * weight) AS target FROM r),
e AS (SELECT d.*, g.source_size, g.target, length(bin(size)) AS cls FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT source, cls, any_value(target) AS target, sum(size) AS words FROM e WHERE size > 0 GROUP BY source, cls),
f AS (
  SELECT source, cls, (target - {float(MOST_COPIES)}::DOUBLE * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(words * cls) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS factor
  FROM c WINDOW o AS (PARTITION BY source ORDER BY cls DESC)),
b AS (SELECT source, max(cls) AS top_class, arg_max(factor, cls) AS factor FROM f WHERE factor * cls <= {MOST_COPIES} GROUP BY source),
x AS (
  SELECT e.*, CASE WHEN size = 0 THEN 0.0 WHEN cls > coalesce(top_class, 0) THEN {float(MOST_COPIES)} ELSE least({float(MOST_COPIES)}, factor * cls) END::DOUBLE AS expected
  FROM e LEFT JOIN b ON e.source IS NOT DISTINCT FROM b.source),
p AS (SELECT *, floor(expected)::BIGINT AS certain, expected - floor(expected) AS p FROM x),
q AS (SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS place, target - sum(certain * size) OVER (PARTITION BY source) AS rest FROM p),
t AS (
  SELECT *, sum(size) OVER (PARTITION BY source, doc_id, size) AS words,
    sum(CASE WHEN place IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY place NULLS FIRST, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM q),
m AS (SELECT *, CASE WHEN place IS NOT NULL AND upto::DOUBLE - words::DOUBLE / 2 <= rest THEN 1 ELSE 0 END AS more FROM t),
h AS (SELECT *, target - sum((certain + more) * size) OVER (PARTITION BY source)::DOUBLE AS gap FROM m),
l AS (
  SELECT *, place IS NOT NULL AND more = CASE WHEN gap > 0 THEN 0 ELSE 1 END AND abs(abs(gap) - size) < abs(gap) AS able,
    dense_rank() OVER (PARTITION BY source, (place IS NOT NULL AND more = CASE WHEN gap > 0 THEN 0 ELSE 1 END AND abs(abs(gap) - size) < abs(gap))
      ORDER BY abs(abs(gap) - size), place, doc_id, size) AS nth
  FROM h),
z AS (SELECT *, certain + CASE WHEN able AND nth = 1 AND abs(abs(gap) - words) < abs(gap) THEN 1 - more ELSE more END AS copies FROM l)
SELECT doc_id, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM z
"""


def queries() -> dict:
    ops = (
        op1_line_dedup, op2_toxicity, op3_exact_dedup, op4_quality_rules, op5_mixing,
        op6_near_dedup, op7_sharding, op8_packing, op9_license_scan, op10_quality_classifier,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op3_exact_dedup": OP3_SQL, "op5_mixing": OP5_SQL}
