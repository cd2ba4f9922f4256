"""Query of the language identification."""

from pyspark.sql import functions as F

from txnguard.llm import langid
from txnguard.llm.columns import documents


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op4_language_id(spark, sf_dir):
    """Every document's language by a model of the three quarters that are not held out. A null doc_id isn't held out."""
    docs = documents(spark, sf_dir).withColumn("held_out", held_out(F.col("doc_id")))
    model = langid.train(docs.filter("not held_out"))
    return langid.predict(docs, model, ("doc_id", "held_out"))


QUERIES = {"op4_language_id": (op4_language_id, None)}
