"""Queries of the operators for training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import rows_of
from ..sources.tables import table
from .bpe import encode_corpus, token_count
from .langid import identify, wrong_or_mixed
from .lookalike import consistent, learn, lookalike_groups, lookalike_pairs
from .mixing import mix, token_table
from .pii import with_placeholders
from .surrogate import pseudonymise, with_pieces


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = lookalike_pairs(table(spark, sf, "scrub_requests"), "request_id", "payload")
    return pairs.select(F.col("id_a").alias("request_id_a"), F.col("id_b").alias("request_id_b"))


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each payload that has a look-alike, with its class."""
    return lookalike_groups(table(spark, sf, "scrub_requests"), "request_id", "payload").withColumnRenamed("id", "request_id")


def p1_consistent(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "scrub_requests")
    return df.select("request_id", consistent(df, F.col("payload"), learn(df, "payload")).alias("payload"))


#: The fields of problem 4: name, table, row's id, column.
_TEXTS = (("scrub_requests.payload", "scrub_requests", "request_id", "payload"), ("scrub_responses.clean_text", "scrub_responses", "response_id", "clean_text"))
#: Keys come from the caller; this one is for tests and checks only.
_TEST_KEY = b"no secret: key of the registered queries"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    field = lambda name, t, i, c: table(spark, sf, t).select(F.lit(name).alias("text_field"), F.col(i).alias("row_id"), F.col(c).alias("text"))
    return field(*_TEXTS[0]).unionByName(field(*_TEXTS[1]))


def _pieces(spark: SparkSession, sf: str, keep_text: bool = True) -> DataFrame:
    """The pieces of all texts with their surrogates."""
    return pseudonymise(_texts(spark, sf), ["text_field", "row_id"], "text", table(spark, sf, "given_names"), _TEST_KEY, keep_text)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces that get another text in their place."""
    rows = rows_of(_pieces(spark, sf, keep_text=False), F.col("pieces"), "text_field", "row_id", item="p")
    return rows.where(F.col("p.surrogate") != F.col("p.piece")).select("text_field", "row_id", "p.pii_type", "p.nth")


def p4_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).select("text_field", "row_id", with_placeholders(F.col("text"), F.col("pieces")).alias("text"))


def p4_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).select("text_field", "row_id", with_pieces(F.col("text"), F.col("pieces")).alias("text"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")
    return mix(token_table(docs, token_count(spark, F.col("text"))), table(spark, sf, "mix_targets"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The texts in the order of the mix; they join the finished order of ids, so that only ids and counts go through the queue."""
    texts = table(spark, sf, "documents").select("doc_id", "text")
    return _mixed(spark, sf)[0].join(texts, "doc_id").orderBy("cum_tokens")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def _judged(spark: SparkSession, sf: str, texts: bool = False) -> DataFrame:
    return identify(table(spark, sf, "documents"), table(spark, sf, "lang_codes"), texts=texts)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return wrong_or_mixed(_judged(spark, sf))


def p8_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("doc_id", "label_lang", "lang", "confidence", F.size("segments").alias("n_segments"))


def p8_segments(spark: SparkSession, sf: str) -> DataFrame:
    return rows_of(_judged(spark, sf, True), F.col("segments"), "doc_id", item="s").select("doc_id", "s.*")


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p1_consistent, p4_found, p4_clean, p4_surrogates, p6_ids, p7_mix, p7_shares, p8_found, p8_documents, p8_segments)}

#: None: no SQL has the tables of look-alikes, the merges, the queue or the profiles. tests/llm compares with brute force instead.
ORACLE: dict[str, str] = {}
