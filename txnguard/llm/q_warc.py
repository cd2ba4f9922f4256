"""Query of the WARC derivatives."""

from pyspark.sql import functions as F

from txnguard.llm.warc import derive, responses


def op8_warc_derivatives(spark, sf_dir):
    """Metadata and conversion records of all pages. The block is text, as both types are."""
    records = derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.drop("payload_digest").withColumn("block", F.col("block").cast("string"))


QUERIES = {"op8_warc_derivatives": (op8_warc_derivatives, None)}
