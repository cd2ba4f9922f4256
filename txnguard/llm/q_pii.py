"""Query of the personal data search."""

from txnguard.llm.columns import documents
from txnguard.llm.pii import find


def op6_pii(spark, sf_dir):
    """Personal data in every document."""
    return find(documents(spark, sf_dir))


QUERIES = {"op6_pii": (op6_pii, None)}
