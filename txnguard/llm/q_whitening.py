"""Query of the vectors' whitening."""

from txnguard.llm.whitening import whiten


def op12_whitening(spark, sf_dir):
    """All vectors on the eight largest components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_whitening": (op12_whitening, None)}
