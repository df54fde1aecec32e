"""A corpus from raw documents to token ids: each stage takes what its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import bpe, decontaminate, languages, queries, secrets, similar
from pathloom.llm.common import new_folder, table

#: Documents that hold fewer of the predicted language's trigrams than this, by more than the chance of a text of so
#: many trigrams explains, go with those of no language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in; those without letters or of no language go.

    Null, empty and letterless texts go; a null id is an id like any other; rows that repeat are judged alike; ties go
    to the language first by name; no rows, or none with a language, keep no rows.
    """
    found = languages.identify(docs, queries.language_model(docs))
    least = LEAST_SCORE - 1 / F.sqrt(F.greatest("n_trigrams", F.lit(1)))  # two deviations of a share of one half
    return found.where((F.col("lang_pred") != languages.UND) & (F.col("score") >= least)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that a similarity of 0.8 over five words links (:func:`similar.keep_one`).

    Null, empty and wordless texts are one group; a row with a null id stays only if its group has no id; rows equal in
    id and text are one; equal ids with different texts are judged by themselves, ties by the text's hash.
    """
    return similar.keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item.

    Null and empty texts repeat none and stay; rows are judged by id and text, so those that share an id or have none do
    not stand for each other; rows that repeat stay or go together; an empty benchmark keeps all.
    """
    gone = decontaminate.judged(docs, table(spark, sf_dir, "benchmark")).select("id", "h").distinct().checkpoint()
    return similar.less(docs, gone, "doc_id", "text")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what looks like a secret replaced; ``n_chars`` follows the text.

    Null and empty texts stay as they are, with their ``n_chars`` where the text is null; repeated rows stay repeated.
    """
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and whether they decode to its text's bytes.

    Null and empty texts have no ids and decode to no bytes; every row stays, whatever repeats; texts of any length are
    encoded whole.
    """
    path, pattern = queries._tokenizer("byte_bpe_50k.tiktoken"), queries._pattern()
    back = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    same = F.coalesce(F.col("text").cast("binary"), F.lit(b"")) == F.col("decoded")
    return back.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("token_ids", token_ids)]

#: SQL cannot express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again for the next."""
    folder = new_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
