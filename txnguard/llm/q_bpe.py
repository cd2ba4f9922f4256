"""Query of the byte-level encoding."""

import public_tokenizers
from pyspark.sql import functions as F

from txnguard.llm.bpe import decode, encode
from txnguard.llm.columns import documents


def op13_byte_bpe(spark, sf_dir):
    """Digests of every document's ids and of the bytes that they decode to."""
    files = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = decode(encode(documents(spark, sf_dir), *files), *files)
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op13_byte_bpe": (op13_byte_bpe, None)}
