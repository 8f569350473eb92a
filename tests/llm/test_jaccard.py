"""The n-gram Jaccard join against brute force over all pairs, with and without frequent classes."""

import random
import re

import numpy as np
import pytest
from conftest import rows_equal

from tidemark.llm import jaccard_join as J

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, threshold=75):
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingles(text))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i in sorted(sets) for s in sets[i] if s]
    for a in range(len(flat)):
        for b in range(a + 1, len(flat)):
            (i, x), (j, y) = flat[a], flat[b]
            c = len(x & y)
            if c and 100 * c >= threshold * (len(x) + len(y) - c):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i in sets for s in sets[i])


def corpus(seed):
    """Groups of mutated copies, a passage that most texts share, short texts, repeated ids."""
    random.seed(seed)
    words = [f"w{i}" for i in range(60)]
    bases = [[random.choice(words) for _ in range(random.choice([6, 8, 12, 20, 40, 80, 200, 400]))] for _ in range(12)]
    passage = [random.choice(words) for _ in range(50)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, "a b c d e")]
    for i in range(5, 220):
        w = list(random.choice(bases[:4] if random.random() < 0.6 else bases))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3, 5])):
            p, r = random.randrange(len(w)), random.random()
            if r < 0.4:
                w[p] = random.choice(words)
            elif r < 0.7:
                w.insert(p, random.choice(words))
            elif len(w) > 1:
                del w[p]
        if random.random() < 0.3:
            w = passage + [random.choice(words) for _ in range(random.randint(0, 25))]
        rows.append((i if random.random() < 0.97 else random.randrange(5, i + 1), " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "frequent"), [(1, 3), (2, 3), (3, 1000), (4, 8)])
def test_classes_equal_brute_force(spark, seed, frequent):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, J.jaccard_components(df, frequent=frequent).collect())) == brute(rows)


@pytest.mark.parametrize("listed", [1, 20])
def test_classes_with_frequent_grams_by_exchange(spark, monkeypatch, listed):
    monkeypatch.setattr(J, "MAX_FREQUENT", listed)
    monkeypatch.setattr(J, "LARGE_GROUP", 3)
    rows = [*corpus(5), (None, "w1 w2 w3 w4 w5 w6 w7")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in J.jaccard_components(df, frequent=4).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute([r for r in rows if r[0] is not None])
    assert [r for r in got if r[0] is None] == [(None, 3, None)]


def test_a_shared_passage_makes_few_pairs(spark, monkeypatch):
    """Texts that share 30 words but do not link: pairs held against each other do not grow with their square."""
    monkeypatch.setattr(J, "MAX_FREQUENT", 1)
    held = []
    monkeypatch.setattr(J, "plausible", lambda pairs, *rest, plausible=J.plausible: (held.append(pairs.count()), plausible(pairs, *rest))[1])
    for m in (100, 200):
        rng = random.Random(m)
        rows = [(i, " ".join([f"p{j}" for j in range(30)] + [f"x{rng.randrange(10**9)}" for _ in range(120)])) for i in range(m)]
        got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert all(r.component_id == r.doc_id for r in got)
    assert sum(held) <= 200


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = set(rng.integers(0, 1 << 60, rng.integers(1, 300)).tolist())
        b = set(list(a)[: rng.integers(0, len(a) + 1)]) | set(rng.integers(0, 1 << 60, rng.integers(1, 600)).tolist())
        x, y = np.array(sorted(a), np.uint64), np.array(sorted(b), np.uint64)
        bits = J.parity_bits(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        assert J.bits_apart(*bits) <= len(a ^ b) and J.bits_apart(bits[0], bits[0]) == 0


def test_blocks_come_back():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (J.unpack(J.pack(x)) == x).all() and len(J.unpack(J.pack(x[:0]))) == 0


def test_nulls_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c", 1), (5, "a b c", 2), (3, "A b c", 3)], "doc_id long, text string, component_id int")
    got = sorted(map(tuple, J.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 1, None), (5, 1, 3), (3, 1, 3)], key=str)
    assert J.jaccard_components(df.limit(0)).count() == 0


def test_query_equals_sql(spark, sf_dir, duck):
    rows_equal(J.op2_ngram_jaccard_join(spark, sf_dir), duck.sql(J.OP2_SQL))
