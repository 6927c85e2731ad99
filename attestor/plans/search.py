"""Semantic search with its log and analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieve


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, org_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(citations, log rows) of queries (query_id, text, query vector, user_id, created_at).

    vectors: vec_id, embedding, document_id, document_name, page, paragraph, text and, where org_id is given, organization_id.
    Without org_id all vectors are searched.
    """
    if org_id is not None:
        vectors = vectors.where(F.col("organization_id") == org_id)
    best = retrieve.vector_top_k(vectors.select("vec_id", "embedding"), queries.select("query_id", "query"), k)
    cited = best.join(vectors.drop("embedding"), "vec_id").select(
        "query_id", "place", F.coalesce("document_id", F.lit("")).alias("document_id"), F.coalesce("document_name", F.lit("Unknown")).alias("document_name"), F.nullif("page", F.lit(0)).alias("page"), "paragraph", "text", "score")
    counts = cited.groupBy("query_id").agg(F.count("*").alias("result_count"))
    log = queries.join(counts, "query_id", "left").select(F.lit(org_id).alias("organization_id"), "user_id", F.col("text").alias("query"), F.coalesce("result_count", F.lit(0)).cast("int").alias("result_count"), "created_at")
    return cited, log
