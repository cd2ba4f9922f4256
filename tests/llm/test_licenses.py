import random
import re

import duckdb
import pytest

import check
from llm.tables import clashing, docs
from txnguard.llm import licenses
from txnguard.llm.catalog import catalog
from txnguard.llm.license_texts import TEMPLATES


def brute(rows):
    def grams(t):
        w = re.findall("[a-z0-9]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    out = []
    for i, text in rows:
        own = grams(text)
        for name, form, body in TEMPLATES:
            want = grams(body)
            if len(want & own) / len(want) >= 0.8:
                out.append((i, name, form, len(want), len(want & own), len(want & own) / len(want)))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(map(tuple, licenses.scan(df, **kw).collect()), key=str)


def test_query_equals_its_sql(spark, sf_dir):
    fn, sql = catalog()["op2_license_scan"]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got, cur = fn(spark, sf_dir), con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert check.rows(got.columns, got.collect()) == check.rows(columns, cur.fetchall())


def test_no_python_in_the_plan(spark, sf_dir):
    plan = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD|Exchange hash", plan)


def test_statements_inside_other_text(spark):
    rng = random.Random(3)
    filler = [f"word{k}" for k in range(500)]
    rows = []
    for k, (_, _, body) in enumerate(TEMPLATES):
        for copy in range(4):
            before, after = (" ".join(rng.choices(filler, k=rng.randrange(40))) for _ in range(2))
            text = body.split(" ")
            if copy == 3 and len(text) > 12:  # a word changed touches five shingles
                text[rng.randrange(len(text))] = "changed"
            rows.append((100 * k + copy, f"{before}\n{' '.join(text).upper() if copy == 1 else ' '.join(text)}\n{after}"))
    got = run(docs(spark, rows))
    assert got == brute(rows)
    assert {(r[0] // 100, r[0] % 100) for r in got} >= {(k, c) for k in range(len(TEMPLATES)) for c in range(3)}


def test_odd_rows(spark):
    line = TEMPLATES[0][2]
    rows = [(1, None), (2, ""), (3, "four words are here"), (4, line), (None, line), (4, line), (5, "x y " * 100_000 + line + " é z" * 1000), (6, "five words but no license")]
    assert run(clashing(docs(spark, rows))) == brute(rows)
    assert run(docs(spark, [])) == []


def test_too_short_a_template(spark):
    with pytest.raises(ValueError, match="five|5"):
        licenses.scan(docs(spark, []), templates=[("x", "line", "too short")])
