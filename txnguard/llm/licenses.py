"""License statements in documents: MinHash retrieves templates, exact shingle containment verifies. Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnguard.functions.once import with_once
from txnguard.llm.columns import only
from txnguard.llm.license_texts import TEMPLATES

SHINGLE = 5
CONTAINED = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[a-z0-9]+"
#: One row a band, and so many bands: a hash function each. A template of n shingles is retrieved by the window over its
#: own part of a text if, for one function, its least shingle is there and no other shingle of the window is less. With
#: four fifths of the shingles there and as many foreign ones, that has a chance of 0.4 a band: 0.9997 for 16 bands.
BANDS = 16
#: Windows in shingles, each half over the next: single shingles for templates of fewer than 4, then 8, and 32 from 16.
BLOCK = 4
MEDIUM, LARGE = 4, 16
#: Templates are part of the plan, as values; more are refused.
MAX_TEMPLATES = 1000


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def shingles(own: Column) -> Column:
    """Hashes of all runs of five words; none for fewer words."""
    at = F.when(F.size(own) >= SHINGLE, F.sequence(F.lit(0), F.size(own) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(SHINGLE)]))


def ranked(hashes: Column, band: int) -> Column:
    """The hashes in the order of one band: turned by some of their bits, so that other bits lead."""
    turn = band * (64 // BANDS)
    if not turn:
        return hashes
    return F.transform(hashes, lambda h: F.shiftleft(h, turn).bitwiseOR(F.shiftrightunsigned(h, 64 - turn)))


def orders(hashes: Column) -> Column:
    return F.array(*[ranked(hashes, b) for b in range(BANDS)])


def block_minima(ordered: Column) -> Column:
    """For each band the least hash of each block of shingles."""

    def of(order: Column) -> Column:
        last = F.greatest(F.ceil(F.size(order) / BLOCK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.array_min(F.slice(order, b * BLOCK + 1, F.lit(BLOCK))))

    return F.transform(ordered, of)


def windows(minima: Column, blocks: int) -> Column:
    """For each band the least hash of each window of so many blocks, which begins half a window after the last one."""
    step = blocks // 2

    def of(m: Column) -> Column:
        last = F.floor((F.size(m) - 1) / step).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda j: F.array_min(F.slice(m, j * step + 1, F.lit(blocks))))

    return F.transform(minima, of)


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """``template_id``, ``license``, ``form``, ``text`` and ``shingles`` of the statements."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    rows = [F.struct(F.lit(k).alias("template_id"), F.lit(a).alias("license"), F.lit(b).alias("form"), F.lit(c).alias("text")) for k, (a, b, c) in enumerate(templates)]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    table = with_once(table, "words", words(F.col("text"))).withColumn("shingles", F.array_distinct(shingles(F.col("words"))))
    return table.select("template_id", "license", "form", "shingles")


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``doc_id``, ``license``, ``form``, ``n_shingles`` of the statement, ``n_found`` of them in the text, and
    ``containment``, for each statement of which a document has at least four fifths of the shingles of five words.

    Words are runs of ASCII letters and digits, in lower case. Null and empty texts and those of fewer than five words
    hold nothing. Texts are scanned whole. Repeated rows give repeated results; a null doc_id stays null; other columns
    are not read. There is no shuffle: a document's windows, its templates and the check stay in its row. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    mins = F.array(*[F.array_min(ranked(F.col("shingles"), b)) for b in range(BANDS)])
    known = table.select("*", mins.alias("mins")).orderBy("template_id").collect()  # as many rows as templates
    if any(not t.shingles for t in known):
        raise ValueError(f"a template needs {SHINGLE} words")
    small = [t for t in known if len(t.shingles) < MEDIUM]
    classes = [([t for t in known if MEDIUM <= len(t.shingles) < LARGE], "medium"), ([t for t in known if len(t.shingles) >= LARGE], "large")]

    # A window's least hash can only be a template's if the text has that shingle at all: most texts end here.
    wanted = {h for t in small for h in t.shingles} | {m for own, _ in classes for t in own for m in t.mins}
    found = with_once(only(docs, "doc_id", "text"), "words", words(F.col("text"))).drop("text")
    found = with_once(found.filter(F.size("words") >= SHINGLE), "shingles", shingles(F.col("words"))).drop("words")
    found = found.filter(F.arrays_overlap(F.col("shingles"), longs(sorted(wanted))))
    found = with_once(found, "orders", orders(F.col("shingles")))
    found = with_once(found, "minima", block_minima(F.col("orders"))).drop("orders")
    found = with_once(found, "medium", windows(F.col("minima"), 2))
    found = with_once(found, "large", windows(F.col("minima"), 8)).drop("minima")

    def retrieved(t, column: str | None) -> Column:
        if column is None:
            return F.arrays_overlap(F.col("shingles"), longs(t.shingles))
        hits = [F.array_contains(F.get(F.col(column), F.lit(b)), F.lit(t.mins[b])) for b in range(BANDS)]
        return F.exists(F.array(*hits), lambda h: h)

    ids = [F.when(retrieved(t, None), F.lit(t.template_id)) for t in small]
    ids += [F.when(retrieved(t, column), F.lit(t.template_id)) for own, column in classes for t in own]
    found = with_once(found, "template_ids", F.array_compact(F.array(*ids))).drop("medium", "large")
    found = found.withColumn("template_id", F.explode("template_ids")).drop("template_ids")
    own = table.withColumnRenamed("shingles", "wanted")
    n, common = F.size("wanted"), F.size(F.array_intersect("wanted", "shingles"))
    checked = with_once(found.join(F.broadcast(own), "template_id"), "n_found", common)
    checked = checked.select("doc_id", "license", "form", n.alias("n_shingles"), "n_found", (F.col("n_found") / n).alias("containment"))
    return checked.filter(F.col("containment") >= CONTAINED)


def longs(numbers: list[int]) -> Column:
    return F.array(*[F.lit(n).cast("long") for n in numbers])
