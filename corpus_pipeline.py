"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and gives the next stage's documents; all but the
last return the columns they got. ``run`` writes every stage's documents to the shared folder
and reads them again, so a lost executor repeats one stage at most."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.llm.common import fresh, table, word_count
from tallyrift.llm.crf import fit, score_quality
from tallyrift.llm.mixing import mix, weighted_sources
from tallyrift.llm.packing import packed
from tallyrift.llm.repeats import without_repeats
from tallyrift.llm.simhash import drop_near_copies
from tallyrift.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts. Null texts are scored as empty ones."""
    model, names = fit(docs, table(spark, sf_dir, "labels")), (fresh("score"), fresh("predicted"))
    scored = score_quality(docs, model, keep=docs.columns, names=names)
    return scored.where(F.col(names[1]) == 1).select([f"`{c}`" for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: links of a Jaccard similarity of 0.8 over
    five-word shingles, found among fingerprints of at most 20 different bits."""
    return drop_near_copies(docs, width=5, bits=20, similarity=0.8)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that also start earlier; a text may become empty."""
    known = {c: fresh("column") for c in docs.columns if c not in ("doc_id", "text", "n_chars")}
    kept = without_repeats(docs.withColumnsRenamed(known), keep=list(known.values()))
    text = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return kept.select([text[c].alias(c) if c in text else F.col(known[c]).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, from not at all to three times."""
    size, times = fresh("size"), fresh("times")
    sized = docs.withColumn(size, word_count(F.col("text")))
    sources = weighted_sources(sized.select("source", size), size)
    taken = mix(sized, F.array("source"), F.col(size), sources.select("source", F.col("target").alias("quota")), name=times)
    each = F.explode(F.sequence(F.lit(1), F.col(times)))
    return taken.where(F.col(times) > 0).withColumn(times, each).select([f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and place."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeats),
    ("mixing sources", mixture),
    ("best-fit packing", packing),
]
ORACLE_SQL = None  # a trained model decides the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
