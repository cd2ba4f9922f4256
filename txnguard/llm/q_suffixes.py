"""Query of the removal of repeated passages."""

from txnguard.llm.columns import documents
from txnguard.llm.suffixes import remove_repeats


def op3_suffix_dedup(spark, sf_dir):
    """What every document loses to documents with smaller ids."""
    return remove_repeats(documents(spark, sf_dir))


QUERIES = {"op3_suffix_dedup": (op3_suffix_dedup, None)}
