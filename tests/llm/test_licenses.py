"""Operator 1 against DuckDB and by hand."""

import duckdb
import pytest

from teachspark.llm.licenses import TEMPLATES, bigrams_of, marking_words, oracle_sql, scan_licenses


@pytest.fixture(scope="module")
def notices():
    mit = TEMPLATES[2][1]
    return [
        (1, "Some prose.\nLicensed under the Apache License,  Version 2.0!\nMore prose of the day"),
        (2, "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70))),
        (3, "header\n\n" + mit + "\n\nprose " * 3),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "this work is licensed under the gnu general public license version 3 or so"),
        (6, "under the license of nothing at all, permission denied"),
        (7, "Released under the MIT License. " * 3),
        (None, "Released under the MIT License."),
        (8, "Released under the MIT License."),
        (8, "Released under the MIT License."),
        (9, "licensed"),
        (10, "\n\n\n"),
    ]


def same(spark, df):
    got = sorted(map(str, (tuple(r) for r in scan_licenses(df).collect())))
    with duckdb.connect() as c:
        documents = df.select("doc_id", "text").toArrow()  # noqa: F841
        c.register("documents", documents)
        want = sorted(map(str, c.execute(oracle_sql()).fetchall()))
    assert got == want
    return got


def test_notices_and_edges(spark, notices, edge_docs, no_docs):
    df = spark.createDataFrame(notices, "doc_id long, text string")
    same(spark, df)
    got = {(r.doc_id, r.unit, r.place, r.license) for r in scan_licenses(df).collect()}
    assert {(1, "line", 1, "Apache-2.0"), (2, "paragraph", 0, "MIT"), (3, "line", 2, "MIT"), (4, "line", 0, "CC-BY-NC-4.0"), (5, "line", 0, "GPL-3.0"), (8, "line", 0, "MIT"), (None, "line", 0, "MIT")} <= got
    assert not {6, 9, 10} & {d for d, *_ in got}
    same(spark, edge_docs)
    assert scan_licenses(no_docs).count() == 0


def test_own_templates_and_marking_words(spark, notices):
    df = spark.createDataFrame(notices, "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in scan_licenses(df, [("X", "denied permission denied"), ("Y", "one")], 0.4).collect()] == []
    assert scan_licenses(df, []).count() == 0
    marks = set(marking_words(TEMPLATES))
    for _, text in TEMPLATES:
        grams = bigrams_of(text)
        left = [b for b in grams if not marks & set(b.split())]
        assert len(left) < len(grams) * 0.8 / 1.2


def test_realistic_notices(spark):
    text = {}
    for name, body in TEMPLATES:
        text[name] = max(text.get(name, ""), body, key=len)
    code = "int main(void) {\n  int n = 0;\n  while (n < 10) n++;\n  return n;\n}\n" * 20
    lines = lambda body: "\n".join(" * " + body[i : i + 70] for i in range(0, len(body), 70))
    bullets = text["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    prose = "We met on a rainy day and talked for hours. Nobody took notes. "
    notices = {
        1: ("MIT", "Copyright (c) 2021 Some People. Released under the MIT License. All rights reserved by the people named above."),
        2: ("BSD-3-Clause", "Copyright (c) 2021, Some People.\n\n" + bullets),
        3: ("ISC", "Copyright (c) 2021 Some People\n\n" + text["ISC"]),
        4: ("BSD-2-Clause", prose * 30 + text["BSD-2-Clause"] + " " + prose * 30),
        5: ("MIT", "/*\n" + lines(text["MIT"]) + "\n */\n" + code),
        6: ("Unlicense", prose * 9 + text["Unlicense"].replace("  ", " ") + "\n" + code),
        7: ("Zlib", text["Zlib"].upper()),
    }
    df = spark.createDataFrame([(i, t) for i, (_, t) in notices.items()] + [(8, prose * 50 + code), (9, ". " * 50), (10, "Software is provided. " * 40)], "doc_id long, text string")
    same(spark, df)
    found = {(r.doc_id, r.license) for r in scan_licenses(df).collect()}
    assert {(i, name) for i, (name, _) in notices.items()} <= found
    assert not {8, 9, 10} & {d for d, _ in found}
