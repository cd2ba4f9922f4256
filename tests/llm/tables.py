"""Tables with the cases that every operator has to bear."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows of (doc_id, text[, lang, source])."""
    full = [(r[0], r[1], *(r[2:] + (None,) * (4 - len(r))), None if r[1] is None else len(r[1])) for r in map(tuple, rows)]
    return spark.createDataFrame(full, DOCS)


def clashing(df):
    """The table with further columns whose names operators use inside."""
    names = ("fp", "label", "node", "a", "b", "part", "sig", "size", "id", "n", "_own", "key", "spans", "window", "start", "length", "own_k1", "_own_k1",
             "near", "blocks", "open", "_mix_row", "_mix_copies", "_mix_copy", "mix_row", "mix_copies", "mix_copy", "_once", "row", "k", "ids")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names) if c not in df.columns])


def ids(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=str)
