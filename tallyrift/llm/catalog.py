"""One named query per operator, over whole tables, and the SQL where it can say the same."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from tallyrift.llm.common import table, word_count
from tallyrift.llm.brown import class_scores
from tallyrift.llm.chat import format_chats, read_chats
from tallyrift.llm.crf import quality_scores
from tallyrift.llm.mixing import mix, weighted_sources
from tallyrift.llm.packing import packed
from tallyrift.llm.perplexity import quality_rules
from tallyrift.llm.repeats import without_repeats
from tallyrift.llm.simhash import simhash_groups
from tallyrift.llm.turns import repaired_digests
from tallyrift.llm.variants import corpus_variants
from tallyrift.llm.warc import REVISITS_SQL, page_records, resolve_revisits
from tallyrift.llm.winnow import edited_fingerprints
from tallyrift.llm.wrappers import extract_main_text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


@query("op1_simhash")
def op1_simhash(spark, folder):
    return simhash_groups(table(spark, folder, "documents"))


@query("op2_wrappers")
def op2_wrappers(spark, folder):
    return extract_main_text(table(spark, folder, "pages"))


@query("op3_winnowing")
def op3_winnowing(spark, folder):
    return edited_fingerprints(table(spark, folder, "documents"))


@query("op4_mixing")
def op4_mixing(spark, folder):
    docs = table(spark, folder, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sources = weighted_sources(sized, "size")
    taken = mix(sized, F.array("source"), F.col("size"), sources.select("source", F.col("target").alias("quota")))
    known = sources.select(F.col("source").alias("_source"), "source_size", "target")
    return taken.join(known, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken")
    )


@query("op5_quality_crf")
def op5_quality_crf(spark, folder):
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_chat_tree")
def op6_chat_tree(spark, folder):
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, folder, "conversations").select(*more.columns).unionByName(more)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return read_chats(*format_chats(rows, vocabulary), vocabulary)


@query("op7_perplexity_rules")
def op7_perplexity_rules(spark, folder):
    return quality_rules(table(spark, folder, "documents"))


@query("op8_revisits", REVISITS_SQL)
def op8_revisits(spark, folder):
    resolved = resolve_revisits(page_records(table(spark, folder, "pages")))
    line = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return resolved.withColumn("headers", F.array_join(line, ";"))


@query("op9_packing")
def op9_packing(spark, folder):
    return packed(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_repeats")
def op10_repeats(spark, folder):
    return without_repeats(table(spark, folder, "documents")).drop("kept")


@query("op11_brown")
def op11_brown(spark, folder):
    return class_scores(table(spark, folder, "documents"))


@query("op12_variants")
def op12_variants(spark, folder):
    return corpus_variants(table(spark, folder, "documents"))


@query("op13_turn_repair")
def op13_turn_repair(spark, folder):
    return repaired_digests(table(spark, folder, "conversations"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
