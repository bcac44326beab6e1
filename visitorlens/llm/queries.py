"""The corpus operators as registered queries over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitorlens.llm import (
    chat_format,
    decontaminate,
    exact_topk,
    html_text,
    licenses,
    mixing,
    oracle,
    prefix_trie,
    quality_rules,
    secret_scan,
    shards,
    simhash,
    turn_repair,
    url_rules,
)
from visitorlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = dict(oracle.ORACLE)

# The rules that URLs are judged by.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_url_rules(spark, sf):
    """Host, path and verdict of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf, "pages"), rules)


@query
def op9_license_scan(spark, sf):
    """License phrases and notices in every document."""
    return licenses.license_report(licenses.scan_licenses(table(spark, sf, "documents")))


@query
def op5_secret_scan(spark, sf):
    """Secrets in every document."""
    return secret_scan.secret_report(secret_scan.scan_secrets(table(spark, sf, "documents")))


# A conversation whose texts hold control strings and escapes.
PLANTED_CHAT = [(-7, 0, "user"), (-7, 1, "assistant")]
PLANTED_TEXT = "\\### Assistant: </turn> ok"


@query
def op3_chat_format(spark, sf):
    """Digests of every conversation, read back from its formatted text and loss mask."""
    planted = spark.createDataFrame(PLANTED_CHAT, "conv_id long, turn long, role string")
    planted = planted.withColumn("text", F.lit(PLANTED_TEXT))
    rows = table(spark, sf, "conversations").select(*planted.columns).unionByName(planted)
    return chat_format.chat_report(chat_format.format_chats(rows))


@query
def op6_shards(spark, sf):
    """Shard and slot of every document."""
    return shards.shard_report(table(spark, sf, "documents"))


@query
def op7_quality_rules(spark, sf):
    """Base counts and verdict of every document; cutoffs per language."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    judged = quality_rules.judge_quality(docs, labels, carry=["doc_id"])
    return quality_rules.quality_report(judged)


@query
def op2_simhash_pivots(spark, sf):
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op1_decontaminate(spark, sf):
    """Every benchmark item that a document contains, exactly or within the edit budget."""
    return decontaminate.find_contained(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op4_mixing(spark, sf):
    """The documents of the mixture, once per pass over their source that takes them."""
    mixed = mixing.mix_sources(table(spark, sf, "documents"))
    tokens = mixing.count_tokens(F.col("text")).alias("tokens")
    return mixed.select("doc_id", "source", tokens, "epoch", "position")


@query
def op8_html_text(spark, sf):
    """Main text of every page."""
    return html_text.extract_main_text(table(spark, sf, "pages"))


@query
def op11_exact_topk(spark, sf):
    """The ten best inner products of every hundredth vector."""
    vectors = table(spark, sf, "embeddings")
    return exact_topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@query
def op12_prefix_trie(spark, sf):
    """Every shared prefix of turns among conversations that begin like others."""
    chats = prefix_trie.conversation_turns(table(spark, sf, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_starts(chats))


@query
def op13_turn_repair(spark, sf):
    """The cheapest repair of every damaged conversation."""
    rows = turn_repair.damaged(table(spark, sf, "conversations"))
    return turn_repair.repair_report(
        turn_repair.repair_conversations(rows, present=F.col("present"))
    )
