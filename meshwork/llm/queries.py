"""The registered queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import sql
from meshwork.llm.chat import digests, format_chats
from meshwork.llm.common import table
from meshwork.llm.decontamination import contaminated
from meshwork.llm.exact_dedup import exact_dedup
from meshwork.llm.html_text import extract_html
from meshwork.llm.jaccard_join import jaccard_components
from meshwork.llm.license_scan import license_scan
from meshwork.llm.line_dedup import line_dedup
from meshwork.llm.mixing import mixing_rates
from meshwork.llm.toxicity import toxicity
from meshwork.llm.url_filter import url_filter


def document_paths(docs: DataFrame) -> DataFrame:
    """documents as files: source/lang/number/name. Of each directory's files every fourth by id is named as a licence file, whatever it says."""
    name = F.concat(F.when(F.floor(F.col("doc_id") / 64) % 4 == 0, "LICENSE-").otherwise("text-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.pmod(F.col("doc_id"), F.lit(64)).cast("string"), name).alias("path"), "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(document_paths(table(spark, sf_dir, "documents")), "doc_id").withColumnRenamed("file", "doc_id")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with links between 200 hosts, made of the orders: the customer's number gives a page's host, both numbers that of its link.

    Hosts 0 to 4 fit a rule that blocks, 5 to 9 one that allows, the others none.
    """
    n, m = F.col("o_custkey") % 200, (F.col("o_custkey") * 7 + F.col("o_orderkey")) % 200
    host = lambda i: F.concat(F.lit("c"), i.cast("string"), F.when(i < 5, ".com").when(i < 10, ".example.com").otherwise(".info"))
    html = F.concat(F.lit('<p data-href="https://c0.com/">see <!-- <a href="https://c1.com/"> --><a class=x href=\'https:&#47;/'), F.upper(host(m)), F.lit("/x?y'>there</a><a href=\"/here\">here</a>"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("https://"), host(n), F.lit("/en/7")).alias("url"), html.alias("html"))


def url_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL filter on pages that link to each other, since the given pages hold no absolute links."""
    return url_filter(linked_pages(spark, sf_dir))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(format_chats(rows)).drop("n_tokens", "n_loss_tokens")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Shares of the tokens that each domain, a language with a quality, is to have.
MIX_TARGETS = {"en_q1": 0.56, "en_q0": 0.04, "de_q1": 0.14, "de_q0": 0.01, "es_q1": 0.10, "es_q0": 0.01, "fr_q1": 0.13, "fr_q0": 0.01}


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled documents: language and quality, like en_q1."""
    return docs.select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id").select("doc_id", F.concat("lang", F.lit("_q"), F.col("quality").cast("string")).alias("domain"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing_rates(docs, domain_labels(docs, table(spark, sf_dir, "labels")), MIX_TARGETS).drop("sig")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_license_scan, op2_html_text, op3_url_filter, op4_chat_format, op5_line_dedup, op6_decontamination, op7_mixing, op8_jaccard_join, op9_exact_dedup, op10_toxicity, url_propagation)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": sql.URL_FILTER, "url_propagation": sql.URL_PROPAGATION, "op4_chat_format": sql.CHAT_FORMAT, "op5_line_dedup": sql.LINE_DEDUP, "op6_decontamination": sql.DECONTAMINATION, "op8_jaccard_join": sql.JACCARD_JOIN, "op9_exact_dedup": sql.EXACT_DEDUP}
