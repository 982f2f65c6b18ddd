"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.byte_bpe import encode_texts, read_ranks
from usagelens.llm.centroid_clustering import cluster_vectors
from usagelens.llm.common import QueryFn, table
from usagelens.llm.decontaminate import find_leaks
from usagelens.llm.exact_dedup import exact_duplicates
from usagelens.llm.jaccard_join import jaccard_components
from usagelens.llm.language_model import score_language_model
from usagelens.llm.quality import score_quality, train_quality
from usagelens.llm.simhash import simhash_components
from usagelens.llm.substring_dedup import remove_repeats
from usagelens.llm.token_counts import count_tokens, read_pieces
from usagelens.llm.toxicity import score_toxicity, train_toxicity
from usagelens.llm.url_filter import Rule, judge_urls, train_url_model
from usagelens.llm.vector_codes import encode_vectors
from usagelens.llm.vector_sql import cluster_sql, codes_sql

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


#: lower-case A-Z only, for SQL
FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op7_exact_dedup",
    f"""
    WITH t AS (SELECT doc_id, {FOLD} AS x FROM documents),
    g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
    SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
    FROM t JOIN g ON t.x = g.x
    """,
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return count_tokens(table(spark, sf_dir, "documents"), pieces)


def byte_bpe_digests(docs: DataFrame) -> DataFrame:
    """The ids of every text and the bytes they stand for, as digests."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = encode_texts(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(table(spark, sf_dir, "documents"))


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


#: host and path rules of the URL filter
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]

#: labelled URLs: names of advertising, betting and pill shops against plain ones
BLOCKED_URLS = [
    "http://casino-win.example.net/en/12",
    "https://www.casino-win.example.com/es/840.html",
    "http://m.best-casino.example.net/bonus/",
    "https://free-bets.example.net/en/77?ref=x",
    "http://www.free-bets.example.com/es/3",
    "http://sport-bets.example.com/win",
    "https://cheap-pills.example.net/en/5",
    "http://m.cheap-pills.example.com/es/91/",
    "http://buy-pills.example.net/order.html",
    "https://ads-track.example.net/en/8#top",
    "http://blog.ads-track.example.com/es/44",
    "https://click-ads.example.com/track?id=1",
    "http://xxx-cams.example.net/live",
    "http://fast-loans.example.com/apply",
]
ALLOWED_URLS = [
    "http://tiontion.example.net/en/12",
    "https://www.thering.example.com/es/840.html",
    "http://m.ththing.example.net/en/77/",
    "https://blog.theror.example.net/en/5?ref=x",
    "http://www.therst.example.com/es/3",
    "http://theran.example.com/en/win",
    "https://ththan.example.net/en/8",
    "http://m.theron.example.com/es/91/",
    "http://news.example.net/2024/05/order.html",
    "https://docs.example.net/en/8#top",
    "http://blog.school.example.com/es/44",
    "https://library.example.com/catalogue?id=1",
    "http://museum.example.net/visit",
    "http://weather.example.com/today",
]


@query("op8_url_filter")
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = [(url, True) for url in BLOCKED_URLS] + [(url, False) for url in ALLOWED_URLS]
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, train_url_model(labelled))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, host=F.col("source"), path=F.col("lang"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_language_model")
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language_model(table(spark, sf_dir, "documents"))


@query("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


@query("op12_centroid_clustering", cluster_sql())
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


@query("op13_vector_codes", codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_vectors(table(spark, sf_dir, "embeddings"))
