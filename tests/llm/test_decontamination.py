import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontamination as D


def words(text):
    import re

    return re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())


def test_masks_hit_every_two_substitutions():
    from itertools import combinations

    hit = lambda gone: any(all(a + o not in gone for o in m) for m in D.MASKS for a in range(13 - m[-1]))
    assert all(hit(set(c)) for c in combinations(range(13), 2))
    assert sum(hit(set(c)) for c in combinations(range(13), 3)) == 276


@pytest.mark.parametrize("substituted", [0, 1, 2])
def test_planted_passages_are_found_and_clean_texts_are_not(spark, substituted):
    random.seed(substituted)
    vocabulary = [f"t{i}" for i in range(500)]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(random.randint(13, 40)))) for i in range(40)]
    rows, planted = [], {}
    for d in range(300):
        text = [random.choice(vocabulary) for _ in range(random.randint(0, 80))]
        if d % 3 == 0:
            i, item = random.choice(items)
            passage = item.split()
            at = random.randrange(len(passage) - 12)
            passage = passage[at : at + 13]
            for p in random.sample(range(13), substituted):
                passage[p] = "other"
            text[len(text) // 2 : len(text) // 2] = [w.upper() + "," for w in passage]
            planted[d] = i
        rows.append((d, " ".join(text)))
    rows += [(900, None), (901, ""), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([*items, (None, "x"), (77, None), items[0]], "item_id long, text string")
    got = D.decontaminate(df, benchmark).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.contaminated == (r.doc_id in planted)
        if r.contaminated:
            assert planted[r.doc_id] in [o.item_id for o in r.overlaps]
            assert max(o.equal for o in r.overlaps) >= 13 - substituted


def test_blocks_give_the_same(spark, sf_dir, monkeypatch):
    documents, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = {r.doc_id: r.overlaps for r in D.decontaminate(documents, benchmark).collect()}
    monkeypatch.setattr(D, "BLOCK_TOKENS", 300)
    assert len(list(D.blocks_of(benchmark, "text", "item_id"))) > 1
    assert {r.doc_id: r.overlaps for r in D.decontaminate(documents, benchmark).collect()} == whole


def test_whole_items_of_the_test_tables(spark, sf_dir):
    items = {r.item_id: f" {' '.join(words(r.text))} " for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    texts = {r.doc_id: f" {' '.join(words(r.text))} " for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: {int(x) for x in r.benchmark_items.split(",") if x} for r in D.op6_benchmark_decontamination(spark, sf_dir).collect()}
    for d, text in texts.items():
        assert {i for i, item in items.items() if item in text} <= got[d]


def test_segments():
    assert D.longest_segment(np.array([True] * 3)) == (0, 3)
    assert D.longest_segment(np.array([False, True, True, True, True, False, True, True, True, True, False])) == (1, 10)
    assert D.longest_segment(np.array([False])) == (0, 0)
    rng = np.random.default_rng(2)
    for _ in range(300):
        same = rng.random(rng.integers(1, 30)) < 0.6
        every = [(j - i, -i) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i] and same[j - 1] and 4 * same[i:j].sum() >= 3 * (j - i)]
        start, end = D.longest_segment(same)
        assert (end - start, -start) == max(every, default=(0, 0))


def test_empty_benchmark_and_names(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, overlaps string")
    none = spark.createDataFrame([], "item_id long, text string")
    r = D.decontaminate(df, none).first()
    assert r.overlaps == [] and not r.contaminated
    hashes, bounds = D.tokens(pa.array(["a b", None]))
    assert len(hashes) == 2 and bounds.tolist() == [0, 2, 2]


def found(item, text):
    hashes = lambda x: D.tokens(pa.array([x]))
    block = D.Block(np.array([5]), *hashes(item))
    return block.overlaps(*hashes(text))[0]


@pytest.mark.parametrize("n", range(8, 13))
def test_short_items_are_found_with_all_substitutions_that_the_rule_allows(n):
    from itertools import combinations

    item, tried = [f"w{i}" for i in range(n)], 0
    for k in range(4):
        for gone in combinations(range(n), k):
            same = np.array([i not in gone for i in range(n)])
            start, end = D.longest_segment(same)
            if end - start >= min(11, n - 2):
                tried += 1
                text = "a b c " + " ".join("other" if i in gone else w for i, w in enumerate(item)) + " d e"
                assert found(" ".join(item), text) == [(5, 3 + start, end - start, int(same[start:end].sum()))]
    assert tried > n


def test_items_below_the_seeds_are_found_whole():
    for n in range(1, 8):
        item = [f"w{i}" for i in range(n)]
        text = ["a", "b", *item, "c", *item]
        assert found(" ".join(item), " ".join(text).upper()) == [(5, 2, n, n)]
        assert found(" ".join(item), " ".join(["a", *item[:-1], "x"])) == []


def brute(texts, items):
    """Per text, the items that any diagonal overlaps by the rule: every placement is tried."""
    out = []
    for text in texts:
        own, hit = words(text or ""), set()
        where = {}
        for i, w in enumerate(own):
            where.setdefault(w, []).append(i)
        for item_id, item in items:
            diagonals = {i - j for j, w in enumerate(item) for i in where.get(w, ())}
            for d in diagonals:
                low, high = max(0, d), min(len(own), d + len(item))
                same = np.array([own[i] == item[i - d] for i in range(low, high)])
                start, end = D.longest_segment(same)
                if end - start >= D.least_tokens(len(item)):
                    hit.add(item_id)
                    break
        out.append(hit)
    return out


def test_overlaps_of_the_test_tables_equal_brute_force(spark, sf_dir):
    """Nothing is found that the rule does not allow, and at most one in fifty overlaps is missed."""
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r.text]
    rows = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 20_000]
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], items), strict=True))
    got = {r.doc_id: {int(x) for x in r.benchmark_items.split(",") if x} for r in D.op6_benchmark_decontamination(spark, sf_dir).collect()}
    assert all(got[d] <= w for d, w in want.items())
    pairs = sum(len(w) for w in want.values())
    assert pairs == 0 or sum(len(got[d]) for d in want) >= 0.98 * pairs


@pytest.mark.parametrize(("n", "k", "least"), [(11, 1, 1.0), (11, 2, 0.97), (12, 1, 1.0), (12, 2, 1.0)])
def test_recall_of_short_overlaps_with_a_long_item(n, k, least):
    """Overlaps of 11 and 12 tokens with an item of 40: which substitutions the masks still hit."""
    from itertools import combinations

    item = [f"w{i}" for i in range(40)]
    found_, tried = 0, 0
    for gone in combinations(range(1, n - 1), k):
        passage = ["other" if i in gone else item[14 + i] for i in range(n)]
        tried += 1
        found_ += bool(found(" ".join(item), " ".join(["a", "b", *passage, "c"])))
    assert found_ >= least * tried
