"""Quality rules: statistics against brute force, binomial bounds, thresholds, edge cases."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_rules as Q

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen, dup = set(), 0
    for line in (x for x in text.split("\n") if re.search(WORD, x)):
        dup += line in seen
        seen.add(line)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    count = collections.Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts():
    random.seed(3)
    out = [None, "", " \t\n", "a", "a\na\na", "é é é é", "x\r\nx\n x\n", "# $ <>", " word more", "a b c " * 5000, "\n\n\n"]
    return out + ["".join(random.choice(["a", "b ", "\n", "é", " ", "#", "ab cd ef\n"]) for _ in range(random.randint(1, 80))) for _ in range(300)]


def test_statistics_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.with_text_stats(df).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_query_equals_brute_force(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in Q.op4_quality_rules(spark, sf_dir).collect()}
    assert len(got) == documents.count()
    for d in documents.collect():
        r, b = got[d.doc_id], brute(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        assert r.base_failed == failed and (not failed or not r.kept)


def test_binomial_bound():
    exact = sum(math.comb(40, i) * 0.1**i * 0.9 ** (40 - i) for i in range(3))
    assert math.isclose(math.exp(Q.log_binomial_cdf(2, 40, 0.1)), exact, rel_tol=1e-9)
    assert not Q.certified(0, 10, 0.02, 0.05) and Q.certified(0, 500, 0.02, 0.05) and not Q.certified(10, 500, 0.02, 0.05)


def test_false_rejections_stay_within_the_risk():
    rng, broken = np.random.default_rng(1), 0
    true = np.exp(-np.arange(Q.BINS + 1) / 8.0)
    true /= true.sum()
    tail = true[::-1].cumsum()[::-1]
    for _ in range(200):
        good, bad = rng.multinomial(3000, true), rng.multinomial(300, np.full(Q.BINS + 1, 1 / (Q.BINS + 1)))
        cut = Q.select_cutoffs({("s", "r"): (good, bad)}, 1, 0.1, 0.05)
        broken += bool(cut) and tail[cut["s", "r"]] > 0.1 / len(Q.RULES)
    assert broken <= 10


@pytest.mark.parametrize("rows", [0, 4000])
def test_labelled_junk_goes_and_other_strata_stay(spark, rows):
    words = [f"w{i}" for i in range(80)]
    clean = lambda i: " ".join(words[(i * 7 + j * j) % 80] + str(j) for j in range(60))
    junk = lambda i: clean(i).replace(" ", "### ")
    data = [(i, junk(i) if i % 4 == 0 else clean(i), "en" if i < rows * 0.9 else None, i, 7) for i in range(rows)] + [(-1, None, "en", 0, 7), (-2, "", None, 0, 7)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, n_words long, extra int")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(rows)] + [(None, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in Q.quality_rules(df, labels).collect()}
    assert len(out) == len(data) and out[-1].n_words == 0 and out[-1].base_failed and out[-2].extra == 7
    for i in range(rows):
        assert out[i].kept == (i % 4 != 0 or i >= rows * 0.9)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert Q.quality_rules(df, spark.createDataFrame([], "doc_id long, quality int")).agg(F.count("*")).first()[0] == 0


def test_query_equals_sql(spark, sf_dir, duck):
    from conftest import rows_equal

    rows_equal(Q.op4_quality_rules(spark, sf_dir), duck.sql(Q.op4_sql()))


def test_thresholds_equal_sql(spark):
    """Enough labels for certified cutoffs in one stratum and too few in another."""
    import duckdb
    import pandas as pd

    words = [f"w{i}" for i in range(80)]
    clean = lambda i: " ".join(words[(i * 7 + j * j) % 80] + str(j) for j in range(60))
    rows = pd.DataFrame([(i, clean(i).replace(" ", "### " if i % 8 else " # ") if i % 4 == 0 else clean(i), "en" if i % 10 else "de") for i in range(4000)], columns=["doc_id", "text", "lang"])
    labels = pd.DataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(4000)], columns=["doc_id", "quality"])
    con = duckdb.connect()
    con.register("documents", rows)
    con.register("labels", labels)
    want = sorted(con.sql(f"SELECT doc_id, kept, failed_rule FROM ({Q.op4_sql()})").fetchall())
    out = Q.quality_rules(spark.createDataFrame(rows), spark.createDataFrame(labels))
    got = sorted(tuple(r) for r in out.select("doc_id", "kept", "failed_rule").collect())
    assert got == want and {f for _, _, f in got} == {None, "symbols_per_word"}
