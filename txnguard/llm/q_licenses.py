"""Query of the license scan, with its check SQL."""

from txnguard.llm.columns import documents
from txnguard.llm.license_texts import TEMPLATES
from txnguard.llm.licenses import CONTAINED, LOWER, SHINGLE, UPPER, WORD, scan


def op2_license_scan(spark, sf_dir):
    """License statements in every document."""
    return scan(documents(spark, sf_dir))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def worded(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORD}')"


def shingled(key: str, name: str, source: str) -> str:
    """Common table expressions for the distinct runs of five words of ``source(key, w)``."""
    following = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER s" for k in range(1, SHINGLE))])
    return f"""{name}_words AS (SELECT {key}, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM {source}),
  {name}_runs AS (SELECT {key}, {following} AS run FROM {name}_words WINDOW s AS (PARTITION BY {key} ORDER BY i)),
  {name} AS (SELECT DISTINCT {key}, run FROM {name}_runs WHERE run IS NOT NULL)"""


ROWS = ", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(c)})" for a, b, c in TEMPLATES)
SQL = f"""WITH v AS (SELECT license || '/' || form AS statement, {worded('body')} AS w FROM (VALUES {ROWS}) v(license, form, body)),
  dw AS (SELECT doc_id, {worded('text')} AS w FROM documents),
  {shingled('statement', 't', 'v')}, {shingled('doc_id', 'd', 'dw')},
  f AS (SELECT doc_id, statement, CAST(count(*) AS INTEGER) AS n_found FROM d JOIN t USING (run) GROUP BY ALL),
  n AS (SELECT statement, CAST(count(*) AS INTEGER) AS n_shingles FROM t GROUP BY ALL)
  SELECT doc_id, split_part(statement, '/', 1) AS license, split_part(statement, '/', 2) AS form, n_shingles, n_found, n_found / n_shingles AS containment
  FROM f JOIN n USING (statement) WHERE n_found / n_shingles >= {CONTAINED}"""
QUERIES = {"op2_license_scan": (op2_license_scan, SQL)}
