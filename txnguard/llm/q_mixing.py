"""Query of the mixing."""

from txnguard.llm.columns import documents
from txnguard.llm.mixing import mixture


def op7_mixing(spark, sf_dir):
    """What the mix takes of every document."""
    return mixture(documents(spark, sf_dir))


QUERIES = {"op7_mixing": (op7_mixing, None)}
