"""The queries of the corpus operators by name, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellers.llm import decontamination, exact_dedup, filter_audit, hard_negatives, jaccard_join, language, licenses, line_quality, mixing, personal_data, secrets, sharding, substring_dedup
from tellers.llm.text import whole_text, word_count
from tellers.session import cut

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


HELD_OUT = 2  # remainder of the hashed key, modulo 4, of documents nothing is learned from


def _digest(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_remove_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, folder, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_find_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"),
        F.col("hits.item").alias("items"), F.coalesce(F.array_max("hits.coverage"), F.lit(0.0)).alias("coverage"),
    )


def op3_similar_groups(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_groups(_table(spark, folder, "documents"))


def op4_identify_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = F.pmod(F.crc32(whole_text(F.col("doc_id"))), F.lit(4)) == HELD_OUT
    found = language.identify(docs, language.train(docs.where(~held_out)), keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_find_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.find_personal_data(_table(spark, folder, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(*personal_data.BASE_KINDS))
    return found.select(
        "doc_id", *[_count(F.col("spans"), kind) for kind in personal_data.BASE_KINDS],
        F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"))


def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), sharding.placement_key("doc_id", "text").alias("identity")
    )
    labels = mixing.quality_weights(_table(spark, folder, "labels"))
    weighed = cut(docs.join(labels, F.col("doc_id") == F.col("label_key"), "left"))
    mixed = mixing.mix_sources(weighed, weight="label_weight", key="identity")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_scan_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, folder, "documents"), keep=["doc_id"])
    spans = F.transform("licenses", lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct("licenses.license")), ",").alias("licenses"),
        F.array_join(spans, ",").alias("spans"),
    )


def op9_assign_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, folder, "documents")).select("doc_id", "slot", "shard")


def op10_find_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.KINDS))
    counts = [_count(F.col("spans"), kind) for kind, *_ in secrets.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans")
    )


def op11_mine_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, folder, "embeddings").withColumn("label", label)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_audit_filters(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(filter_audit.flag_failures(_table(spark, folder, "documents"), _table(spark, folder, "labels")))


GOOD_SCORE = 0.3


def op13_score_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = F.pmod(F.crc32(whole_text(F.col("doc_id"))), F.lit(5)) == 0
    model = line_quality.train(docs.where(~held_out), _table(spark, folder, "labels").where(~held_out))
    found = line_quality.rate(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted"))


def queries() -> dict[str, Query]:
    return {
        "op1_remove_repeats": op1_remove_repeats,
        "op2_find_leaks": op2_find_leaks,
        "op3_similar_groups": op3_similar_groups,
        "op4_identify_language": op4_identify_language,
        "op5_find_personal_data": op5_find_personal_data,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_mix_sources": op7_mix_sources,
        "op8_scan_licenses": op8_scan_licenses,
        "op9_assign_shards": op9_assign_shards,
        "op10_find_secrets": op10_find_secrets,
        "op11_mine_negatives": op11_mine_negatives,
        "op12_audit_filters": op12_audit_filters,
        "op13_score_quality": op13_score_quality,
    }


_DEDUP = """
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM normal WINDOW g AS (PARTITION BY body)"""

_MIX = """
WITH RECURSIVE words AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
label AS (SELECT doc_id AS label_id, max(quality) AS quality FROM labels GROUP BY 1),
drawn AS (
  SELECT doc_id, source, size,
         -ln((CAST('0x' || substr(md5('20/' || doc_id), 1, 15) AS BIGINT)::DOUBLE + 1) / 1152921504606846978.0::DOUBLE)
         / CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS draw
  FROM words LEFT JOIN label ON doc_id = label_id),
sources AS (
  SELECT source, sum(size) AS source_size,
         [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM drawn GROUP BY source),
-- share what is left among the sources below their limits until none is above
filled(round, source, source_size, weight, stopped, level) AS (
  SELECT 0, source, source_size, weight, false, sum(source_size) OVER () / sum(weight) OVER ()::DOUBLE FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, weight, now_stopped,
         (sum(source_size) OVER () - sum(CASE WHEN now_stopped THEN 3 * source_size ELSE 0 END) OVER ())
         / sum(CASE WHEN now_stopped THEN 0 ELSE weight END) OVER ()::DOUBLE
  FROM (SELECT *, stopped OR level * weight > 3 * source_size AS now_stopped FROM filled
        WHERE round < (SELECT count(*) FROM sources))),
targets AS (
  SELECT source, source_size,
         CASE WHEN stopped THEN (3 * source_size)::DOUBLE ELSE level * weight END AS target
  FROM filled WHERE round = (SELECT count(*) FROM sources)),
lined AS (
  SELECT doc_id, size, source_size::BIGINT AS source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM drawn d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(round(target - epochs * source_size)::BIGINT - before, 0)))::BIGINT AS taken
FROM lined"""

_SHARDS = """
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name,
         CAST('0x' || substr(md5(name || '/offset'), 1, 15) AS BIGINT) % 4099 AS first,
         CAST('0x' || substr(md5(name || '/step'), 1, 15) AS BIGINT) % 4098 + 1 AS step
  FROM range(32) r(i)),
wishes AS (SELECT i, list_transform(range(4099), lambda j: (first + j * step) % 4099) AS slots FROM shards),
turns(turn, owner) AS (
  SELECT 0, list_transform(range(4099), lambda x: -1)
  UNION ALL
  SELECT turn + 1, owner[1:slot] || [turn % 32] || owner[slot + 2:]
  FROM (SELECT turn, owner, list_filter(slots, lambda s: owner[s + 1] = -1)[1] AS slot
        FROM turns JOIN wishes ON i = turn % 32 WHERE turn < 4099)),
placed AS (SELECT owner FROM turns WHERE turn = 4099),
keyed AS (SELECT doc_id, CAST('0x' || substr(md5(doc_id::VARCHAR), 1, 15) AS BIGINT) % 4099 AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(owner[slot + 1]::VARCHAR, 2, '0') AS shard FROM keyed, placed"""


_NEGATIVES = """
WITH vectors AS (
  SELECT vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM vectors a JOIN vectors r ON a.id % 100 = 0 AND a.id <> r.id),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
  FROM positive JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10"""

_AUDIT = """
WITH bodies AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
firsts AS (SELECT body, min(doc_id) AS first FROM bodies GROUP BY body),
label AS (SELECT doc_id AS label_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
          'C': 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body),
          'D': regexp_matches(body, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS fails
  FROM bodies JOIN firsts USING (body) LEFT JOIN label ON doc_id = label_id),
failing AS (
  SELECT part, good, toxic, CASE WHEN fails.A THEN 'A' ELSE '' END || CASE WHEN fails.B THEN 'B' ELSE '' END ||
         CASE WHEN fails.C THEN 'C' ELSE '' END || CASE WHEN fails.D THEN 'D' ELSE '' END ||
         CASE WHEN fails.E THEN 'E' ELSE '' END AS letters FROM judged),
kinds AS (SELECT part, letters, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM failing GROUP BY ALL),
f(letter) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
steps AS (
  SELECT filter_order, step::INT AS step, filter_order[step] AS letter, filter_order[:step - 1] AS before
  FROM orders, range(1, 6) s(step)),
found AS (
  SELECT part, filter_order, step, letter, n, good, toxic, letters = letter AS alone,
         translate(letters, before, '') <> letters AS earlier, contains(letters, letter) AS failing
  FROM kinds, steps),
summed AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT earlier AND NOT failing), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT earlier AND failing), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (earlier AND failing), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT earlier AND failing), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT earlier AND failing), 0)::BIGINT AS toxic_lost
  FROM found GROUP BY ALL)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM summed"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": _DEDUP, "op7_mix_sources": _MIX, "op9_assign_shards": _SHARDS,
        "op11_mine_negatives": _NEGATIVES, "op12_audit_filters": _AUDIT,
    }
