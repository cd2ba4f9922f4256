"""Query of the packing."""

import public_tokenizers

from txnguard.llm.columns import documents
from txnguard.llm.packing import pack


def op5_packing(spark, sf_dir):
    """All documents in windows of 2048 tokens. The rank file holds the same vocabulary as byte_bpe_50k.json."""
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op5_packing": (op5_packing, None)}
