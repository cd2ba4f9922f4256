"""Query of the document fingerprints."""

from pyspark.sql import functions as F

from txnguard.llm.columns import documents
from txnguard.llm.winnowing import edited_neighbours


def op10_fingerprints(spark, sf_dir):
    """Every document beside its edited text and the next document. A fingerprint is its kept hashes in hex; beside it
    are the kept k-grams with their positions."""
    found = edited_neighbours(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("kept")).alias("fingerprint"),
        F.lower(F.hex("edited_kept")).alias("edited_fingerprint"), "near_edited", "near_next", "hashes", "positions",
    )


QUERIES = {"op10_fingerprints": (op10_fingerprints, None)}
