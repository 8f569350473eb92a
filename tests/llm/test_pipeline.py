"""The pipeline's stages, each against what its operator says of its own input, on the test tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidemark.llm.decontamination import decontaminate
from tidemark.llm.quality_rules import quality_rules

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(str(folder / str(i)))
        out.append(spark.read.parquet(str(folder / str(i))))
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages(spark, sf_dir, tables):
    docs, good, unique, cut, clean, coded = tables
    for t in tables[:-1]:
        assert t.columns == docs.columns
    labels, benchmark = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert ids(good) == ids(quality_rules(docs, labels).where("kept"))
    from test_jaccard import brute

    classes = brute([(r.doc_id, r.text) for r in good.collect()])
    assert ids(unique) == sorted({c for _, _, c in classes})
    assert ids(cut) == ids(unique)
    from test_suffix_dedup import brute_words

    before = unique.select("doc_id", "text").collect()
    kept = {r.doc_id: rest for r, (_, _, rest) in zip(before, brute_words([r.text for r in before], 400, 50), strict=True)}
    own = cut.select("doc_id", "text", "n_chars", F.char_length("text").alias("n")).collect()
    assert all(r.text.strip() == kept[r.doc_id] and r.n == r.n_chars for r in own)
    assert ids(clean) == ids(decontaminate(cut, benchmark).where("NOT contaminated"))
    assert ids(coded) == ids(clean) and coded.where(F.size("token_ids") != F.col("n_tokens")).count() == 0


def test_run_gives_the_last_stage(spark, sf_dir, tables):
    a, b = P.run(spark, sf_dir), tables[-1]
    assert sorted(map(str, a.select("doc_id", "ids_sha256").collect())) == sorted(map(str, b.select("doc_id", "ids_sha256").collect()))


def test_odd_rows(spark, sf_dir):
    """Nulls, repeated rows, clashing names and empty tables pass every stage."""
    text = " ".join(f"w{i * i % 97}x{i}" for i in range(80))
    rows = [(None, text, "en", None, None, "c"), (None, None, None, "s", 0, "c"), (7, text, "en", "s", 1, "c"), (7, text, "en", "s", 1, "c"), (8, "", "en", "s", 0, "c"), (9, text + " end", "en", "s", 9, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for table in (docs, docs.limit(0)):
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, table, sf_dir).columns == docs.columns
        counts = [stage(spark, table, sf_dir).count() for _, stage in P.STAGES]
        assert counts == ([4, 4, 6, 6, 6] if table is docs else [0] * 5)
