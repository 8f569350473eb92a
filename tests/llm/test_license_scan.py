import os
import re

from conftest import rows_equal

from tidemark.llm import license_scan as L


def test_query_equals_sql(spark, sf_dir, duck):
    rows_equal(L.op3_license_scan(spark, sf_dir), duck.sql(L.op3_sql()))


def test_variants_of_a_text_match(spark):
    mit = dict((n, t) for n, t in reversed(L.KNOWN))["MIT"]
    variants = [mit, mit.upper(), mit.replace("\n", "\r\n  "), "Copyright (c) 2020 Some One\n" + mit, mit.replace("Software", "software,"), mit.replace("COPYRIGHT HOLDERS", "Copyright Owners"), mit.replace("MIT License", "The MIT Licence")]
    rows = [(i, t, "k") for i, t in enumerate([*variants, "x" + mit, None, "", "Copyright (c) 1999 A", "a\nReleased under the MIT Licence\nb\nreleased under the mit license!"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, license_id string").withColumnRenamed("license_id", "form")
    got = {r.doc_id: r for r in L.license_scan(df).collect()}
    assert [got[i].license_id for i in range(8)] == ["MIT"] * 6 + [None, None]
    assert [got[i].license_digest for i in (8, 9, 10)] == [None] * 3 and got[8].form == "k"
    assert got[11].line_licenses == ["MIT"] and got[11].license_id is None
    for i, t, _ in rows:
        assert got[i].license_digest == (L.digest(t) if t and L.canonical_text(t) else None)
    assert L.license_scan(df.limit(0)).count() == 0


def test_no_known_texts(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    r = L.license_scan(df, known=[], known_by_digest=[]).first()
    assert r.license_id is None and r.line_licenses == []


def test_lines_equal_sql_for_unwrapped_texts_and_rules(spark, tmp_path):
    """Whole texts unwrapped on one line, and notices on lines of many rules and blanks, as the SQL finds them."""
    import duckdb

    whole = {n: " ".join(t.split()) for n, t in L.KNOWN if "\n" in t and n in ("MIT", "ISC", "0BSD")}
    rule = "*" * 400 + " Released under the MIT License. " + " " * 400
    texts = [*[f"Some words first.\n{t}\nMore words." for t in whole.values()], f"a\n{rule}\nb", rule, whole["ISC"], "x\nThis Source Code Form is subject to the terms of the Mozilla Public License, v 2.0\n", "x\ny", "\n", "", None]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    got = L.op3_license_scan(spark, str(tmp_path))
    rows_equal(got, con.sql(L.op3_sql()))
    assert [r.line_licenses for r in got.orderBy("doc_id").collect()] == ["MIT", "ISC", "0BSD", "MIT", "MIT", "ISC", "MPL-2.0", "", "", "", ""]


def test_every_known_text_is_found_whole_and_as_a_line(spark):
    rows = [(i, n, t) for i, (n, t) in enumerate([*L.KNOWN, *[(n, L.without_title(t)) for n, t in L.KNOWN]])]
    folder = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "BSD-3-Clause": "BSD", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    end = "END OF TERMS AND CONDITIONS"
    for name, file in files.items():
        if os.path.exists(f"{folder}/{file}"):
            with open(f"{folder}/{file}", encoding="utf-8") as f:
                text = f.read()
            rows += [(len(rows), name, text)] + ([(len(rows) + 1, name, text[: text.find(end) + len(end)])] if end in text else [])
    df = spark.createDataFrame(rows, "id int, name string, text string")
    for r in L.license_scan(df).collect():
        assert r.license_id == r.name, r.name
    lines = spark.createDataFrame([(i, n, "Head\n" + re.sub(L._COPYRIGHT, "", t, flags=re.I).replace("\n", " ") + "\nTail") for i, n, t in rows], "id int, name string, text string")
    for r in L.license_scan(lines).collect():
        assert r.line_licenses == [r.name], r.name


def test_clashing_names_repeated_rows_and_long_texts(spark):
    long = "word centre " * 200_000
    rows = [(1, "Released under the MIT License.", "a", ["x"]), (1, "Released under the MIT License.", "a", ["x"]), (None, long, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license_id string, line_licenses array<string>")
    out = L.license_scan(df)
    assert out.columns == ["doc_id", "text", "license_digest", "license_id", "line_licenses"]
    got = out.collect()
    assert sum(r.license_id == "MIT" and r.line_licenses == ["MIT"] for r in got) == 2
    assert next(r.license_digest for r in got if r.doc_id is None) == L.digest(long)
