"""Suffix-array dedup against a count of all windows, and the sort itself."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import suffix_dedup as S
from tidemark.llm.suffix_sort import blind_trie_order, deep_shallow_sort


def brute(texts, window):
    seen, raw = collections.Counter(), [(t or "").encode() for t in texts]
    for b in raw:
        seen.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
    return out


def brute_words(texts, window, words):
    """(repeated words, text without repeats of either kind) of each text."""
    raw = [(t or "").encode() for t in texts]
    found = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in raw]
    seen, bytes_seen = collections.Counter(), collections.Counter()
    runs = [[tuple(b[x:y] for x, y in f[i : i + words]) for i in range(len(f) - words + 1)] for b, f in zip(raw, found, strict=True)]
    for b, r in zip(raw, runs, strict=True):
        seen.update(r)
        bytes_seen.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for b, f, r in zip(raw, found, runs, strict=True):
        gone, covered = bytearray(len(b)), set()
        for i, run in enumerate(r):
            if seen[run] > 1:
                covered |= set(range(i, i + words))
        for i in covered:
            # Up to the next word, if that goes too.
            a, z = f[i][0], f[i + 1][0] if i + 1 in covered else f[i][1]
            gone[a:z] = b"\x01" * (z - a)
        for i in range(len(b) - window + 1):
            if bytes_seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(covered), any(gone), rest.decode("utf-8", "ignore").strip()))
    return out


def texts(seed):
    random.seed(seed)
    out = [None, "", "a" * 300, "é" * 50, "ab" * 100, "x" * 39]
    base = ["".join(random.choice("abcdé ") for _ in range(random.randint(20, 200))) for _ in range(12)]
    for _ in range(120):
        t = "".join(random.choice(base)[: random.randint(5, 200)] if random.random() < 0.6 else "".join(random.choice("xyz") for _ in range(random.randint(1, 60))) for _ in range(random.randint(1, 8)))
        out += [t] * (2 if random.random() < 0.1 else 1)
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 20_000), (2, 20_000), (3, 3)])
def test_spans_equal_brute_force(spark, seed, hot):
    rows = texts(seed)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    out = S.suffix_array_dedup(df, window=40, gram=8, hot=hot, keep=["doc_id"], kept_text="rest").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.rest) for r in out} == dict(enumerate(brute(rows, 40)))


@pytest.mark.parametrize(("seed", "hot"), [(4, 20_000), (5, 3)])
def test_word_runs_equal_brute_force(spark, seed, hot):
    random.seed(seed)
    words = [random.choice(["a", "bé", "ccc"]) + str(random.randint(0, 9)) for _ in range(60)]
    passage = lambda: words[(a := random.randint(0, 50)) : a + random.randint(2, 9)]
    rows = [None, "", " \n", *[random.choice([" ", "\n ", "  "]).join(sum((passage() if random.random() < 0.5 else [f"u{random.random()}"] for _ in range(random.randint(1, 9))), [])) for _ in range(150)]]
    rows += rows[10:14]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    out = S.suffix_array_dedup(df, window=40, gram=8, hot=hot, keep=["doc_id"], kept_text="rest", words=5, word_gram=2).collect()
    assert {r.doc_id: (r.n_repeat_words, r.has_repeat, r.rest.strip()) for r in out} == dict(enumerate(brute_words(rows, 40, 5)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == {i: w[:4] for i, w in enumerate(brute(rows, 40))}


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r.text for r in rows], 400)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op7_suffix_array_dedup(spark, sf_dir).collect()}
    assert got == {r.doc_id: w[:4] for r, w in zip(rows, want, strict=True)}


def test_very_long_text(spark):
    """One text of several megabytes beside short ones that repeat a passage of it."""
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"w{i}" for i in range(300_000)) + " " + passage + " " + " ".join(f"v{i}" for i in range(100_000))
    df = spark.createDataFrame([(1, long), (2, "head " + passage + " tail"), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_repeat_words, r.has_repeat, r.rest) for r in S.suffix_array_dedup(df, kept_text="rest", words=50).collect()}
    assert got[2] == (0, 60, True, "head  tail") and got[3] == (0, 0, False, "clean")
    assert got[1] == (0, 60, True, long.replace(passage, ""))


def test_sorting():
    rng = np.random.default_rng(2)
    strings = list({rng.integers(97, 99, 24).astype(np.uint8).tobytes() for _ in range(300)})
    assert [strings[i] for i in blind_trie_order(strings)] == sorted(strings)
    rows, group = rng.integers(97, 99, (500, 24)).astype(np.uint8), rng.integers(0, 5, 500)
    order, lcp = deep_shallow_sort(group, rows, shallow=8)
    keyed = [(int(group[i]), rows[i].tobytes()) for i in order]
    assert keyed == sorted(keyed)
    for i in range(1, 500):
        (g, x), (h, y) = keyed[i - 1], keyed[i]
        assert lcp[i] == (-1 if g != h else next((k for k in range(24) if x[k] != y[k]), 24))


def test_nulls_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(None, None, 1, "k"), (None, "z" * 500, 2, "k"), (1, "z" * 500, 3, "k")], "doc_id long, text string, n_bytes int, t1 string")
    got = sorted((r.n_bytes, r.n_removed, r.t1) for r in S.suffix_array_dedup(df).collect())
    assert got == [(0, 0, "k"), (500, 500, "k"), (500, 500, "k")]
    assert S.suffix_array_dedup(df.limit(0)).count() == 0


def test_query_equals_sql(spark, sf_dir, duck):
    from conftest import rows_equal

    rows_equal(S.op7_suffix_array_dedup(spark, sf_dir), duck.sql(S.OP7_SQL))
