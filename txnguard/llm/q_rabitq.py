"""Query of the vectors' near-duplicates."""

from txnguard.llm.rabitq import near_duplicates


def op1_embedding_near_dedup(spark, sf_dir):
    """Links and components of all vectors."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op1_embedding_near_dedup": (op1_embedding_near_dedup, None)}
