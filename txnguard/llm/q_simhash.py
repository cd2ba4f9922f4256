"""Query of the SimHash operator."""

from pyspark.sql import functions as F

from txnguard.llm.columns import documents
from txnguard.llm.simhash import near_duplicates


def op9_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_near_dedup": (op9_simhash_near_dedup, None)}
