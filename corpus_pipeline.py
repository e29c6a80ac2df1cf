"""From documents to a corpus for training: five stages, each an operator's decisions.

Every stage takes and gives rows with the columns of ``documents``; the last adds the
shard. A stage's result is written to the shared folder and read again, so that the
next one starts from a table and a lost executor costs part of one stage.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellers.llm import decontamination, jaccard_join, language, mixing, sharding
from tellers.llm.text import free_name, whole_text, word_count
from tellers.operators.sizing import splittable_join
from tellers.session import cut, remove_cuts, settled

LEAST_SCORE = 0.5  # of a language, for a document to stay
LEAST_LEAK = 5  # words of an item that a document must cover, to go


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter and those of which no language is likely.

    Learns from the rows that name their language. If there are none, only texts
    without a letter go. A NULL or empty text has no letter and goes. Equal texts go or
    stay together; an empty table gives no rows; other columns stay.
    """
    model = language.train(docs)
    if not model.languages:
        return docs.where(F.regexp_like(whole_text(F.col("text")), F.lit(r"\p{L}")))
    lang, score = free_name(docs, "_stage_lang"), free_name(docs, "_stage_score")
    found = language.identify(docs, model, lang_name=lang, score_name=score)
    return found.where((F.col(lang) != language.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents keep one row: of the least doc_id, then the least text hash.

    A row is known by its doc_id and a hash of its text, so another text of the same
    doc_id is judged by its own component. A NULL doc_id is greater than any other. Rows
    that repeat doc_id and text are one. An empty or NULL text is similar to nothing and
    stays, once for each doc_id. An empty table gives no rows; other columns stay.
    """
    groups = cut(jaccard_join.similar_groups(docs, details=True))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_tag")
    first = groups.where("component IS NOT NULL").groupBy("component").agg(F.min(row).alias("first"))
    judged = splittable_join(groups.where("component IS NOT NULL"), first, ["component"], "inner")
    tag, gone_id, gone_tag = (free_name(docs, f"_stage_{n}") for n in ("tag", "gone", "gone_tag"))
    gone = judged.where(~row.eqNullSafe(F.col("first"))).select(
        F.col("doc_id").alias(gone_id), F.col("text_tag").alias(gone_tag)
    ).distinct()
    tagged = docs.withColumn(tag, F.xxhash64(whole_text(F.col("text"))))
    left = tagged.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(tag) == F.col(gone_tag)), "left_anti")
    return left.dropDuplicates(["doc_id", tag]).drop(tag)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark, in whole or for the most part.

    Only hits that cover ``LEAST_LEAK`` words or more count, so an item of a word or two
    drops nothing. A NULL or empty text holds no item and stays, as do rows that repeat;
    an empty table gives no rows, an empty benchmark drops none; other columns stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = free_name(docs, "_stage_hits")
    found = decontamination.find_leaks(docs, benchmark, hits_name=hits)
    return found.where(~F.exists(hits, lambda hit: hit["covered"] >= LEAST_LEAK)).drop(hits)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it; drop those it does not take.

    The last document of a source's budget gives its first words only, joined by
    blanks, with ``n_chars`` of what is left. A NULL text, or one without words, takes
    no words and goes; NULL sources are one source; rows that repeat are rows of their
    own, and ties go by doc_id and text. An empty table gives no rows; other columns stay.
    """
    labels = mixing.quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(
        F.struct("*").alias("doc"), "source", "doc_id", word_count(F.col("text")).alias("size"),
        sharding.placement_key("doc_id", "text").alias("identity"),
    ).join(labels, F.col("doc_id") == F.col("label_key"), "left").drop("label_key", "doc_id")
    mixed = mixing.mix_sources(rows, weight="label_weight", key="identity").where("taken > 0")
    copies = mixed.select("doc", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))).alias("copy"), "taken")
    part = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("doc.text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    cut_short = F.col("part") < F.col("size")
    texts = copies.withColumn("part", part).withColumn("body", F.when(cut_short, first).otherwise(F.col("doc.text")))
    changed = {"text": F.col("body"), "n_chars": F.when(cut_short, F.length("body").cast("long")).otherwise(F.col("doc.n_chars"))}
    return texts.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document its slot and shard, by its doc_id.

    Every row stays, whatever its text; rows of one doc_id share a shard, and a row
    without one is placed by its text. Columns named slot or shard are replaced; an empty table gives no rows.
    """
    return sharding.assign_shards(docs)


STAGES = [
    ("language", keep_known_languages),
    ("similar", keep_one_of_similar),
    ("leaks", drop_leaked),
    ("mix", mix),
    ("shards", place),
]

ORACLE_SQL = None  # learning a language and tiling are not for SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row over the documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = settled(partial(stage, spark, docs, sf_dir))
        if before is not None:
            remove_cuts(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
