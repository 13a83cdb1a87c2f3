"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import docs, mixture, neighbors, provenance, quality, secrets, syntax, tokens
from quarrykit.plans import Registry
from quarrykit.session import table

registry = Registry()


@registry.query("p7_ids")
def token_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


@registry.query("p7_decoded")
def decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts back from their ids, and whether they equal the originals."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("original"))
    back = tokens.decode(tokens.encode(table(spark, d, "documents")))
    return back.join(docs, "doc_id").select("doc_id", "text", (F.col("text") == F.col("original")).alias("same"))


@registry.query("p6_found")
def similar_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = neighbors.similar(table(spark, d, "code_chunks"), "id", "embedding", "created_at", k=10, least=0.9)
    return rows.select("id_a", "id_b")


@registry.query("p6_neighbors")
def nearest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Per chunk its ten most similar others, with rank and similarity."""
    return neighbors.nearest(table(spark, d, "code_chunks"), "id", "embedding", "created_at", k=10)


@registry.query("p6_recall")
def recall_of_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of p6_neighbors against the exact search of a stated set of queries."""
    return neighbors.recall(table(spark, d, "code_chunks"), "id", "embedding", "created_at", k=10)


@registry.query("p2_found")
def documented(spark: SparkSession, d: str) -> DataFrame:
    return docs.pairs(table(spark, d, "code_functions")).where("tells").select("function_id").distinct()


@registry.query("p2_pairs")
def code_description_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = docs.pairs(table(spark, d, "code_functions")).where("tells").drop("tells")
    return rows.dropDuplicates(["function_id"])


def _credential_tables(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str, str]]:
    return [("code_functions", table(spark, d, "code_functions"), "function_id", "body"), ("code_chunks", table(spark, d, "code_chunks"), "id", "content")]


@registry.query("p5_found")
def credentials(spark: SparkSession, d: str) -> DataFrame:
    parts = [secrets.found(df, F.col(key), text, "file_path").select(F.lit(name).alias("table_name"), "row_key", "line_no") for name, df, key, text in _credential_tables(spark, d)]
    return parts[0].unionByName(parts[1])


@registry.query("p5_redacted")
def masked_texts(spark: SparkSession, d: str) -> DataFrame:
    """All texts with the values of credentials masked, and how many there were."""
    parts = [secrets.redacted(df, F.col(key), text, "file_path").select(F.lit(name).alias("table_name"), "row_key", "text", "n") for name, df, key, text in _credential_tables(spark, d)]
    return parts[0].unionByName(parts[1])


@registry.query("p9_found")
def no_prose(spark: SparkSession, d: str) -> DataFrame:
    return quality.scored(table(spark, d, "documents"), table(spark, d, "common_words")).where("no_prose").select("doc_id")


@registry.query("p9_statistics")
def text_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.scored(table(spark, d, "documents"), table(spark, d, "common_words"))


@registry.query("p3_found")
def invalid_files(spark: SparkSession, d: str) -> DataFrame:
    return syntax.faults(table(spark, d, "source_files")).select("file_id")


@registry.query("p3_rates")
def invalid_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "source_files"))


@registry.query("p4_found")
def not_handwritten(spark: SparkSession, d: str) -> DataFrame:
    return provenance.judged(table(spark, d, "source_files")).where("reason is not null").select(F.col("id").alias("file_id"))


@registry.query("p4_files")
def provenance_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Every file with the reason why it is not hand-written, if there is one, and what tells so."""
    return provenance.judged(table(spark, d, "source_files")).withColumnRenamed("id", "file_id").drop("shared_tokens")


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mixed(table(spark, d, "documents"), table(spark, d, "mix_plans"), table(spark, d, "mix_targets"))


@registry.query("p8_selection")
def mixture_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


@registry.query("p8_shares")
def mixture_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]
