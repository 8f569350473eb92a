"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from tidemark.llm import sentencepiece_bpe as B  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return B.Coder(B.read_model(PATH))


def cases(library):
    random.seed(4)
    out = ["", "Hello  world", " lead", "a\nb\tc", "▁x ▁", "é日本𐍈́", "  ", "x ", "\x00a", "aaaaaaa", "　 \xa0z", "<s>hi</s><unk><0x0A>", "a" * 3000, "ab" * 400, "  " * 100 + "x", "\n\n  \n", "日本語" * 200, "=" * 900, "----" * 7 + " " * 33 + "****" * 9]
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    out += ["".join(random.choice(pieces) for _ in range(random.randint(1, 40))) for _ in range(800)]
    return out + ["".join(random.choice("abcdeéñ ▁=-*\n\t01 aAet") for _ in range(random.randint(1, 300))) for _ in range(400)]


def test_ids_and_text_equal_the_library(library, own):
    texts = cases(library)
    for i in range(0, len(texts), 200):
        part = texts[i : i + 200]
        packed = own.encode_batch(part)
        for text, p, want in zip(part, packed, library.encode(part, add_bos=True, add_eos=True), strict=True):
            ids = np.frombuffer(p, "<u4").tolist()
            assert ids == want, text[:60]
            assert own.decode(ids) == library.decode(want)


def test_decoding_of_any_ids(library, own):
    random.seed(5)
    for _ in range(1500):
        ids = [random.randrange(1, 32000) if random.random() < 0.5 else random.randrange(3, 259) for _ in range(8)]
        assert own.decode(ids) == library.decode(ids)


def test_query(spark, sf_dir, library):
    documents = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in B.op9_sentencepiece(spark, sf_dir).collect():
        ids = library.encode(documents[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_nulls_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "a b", 7)], "doc_id long, text string, n_tokens int")
    out = B.sentencepiece_roundtrip(df, PATH).collect()
    assert sorted((r.n_tokens, r.decoded, len(r.token_ids)) for r in out) == [(2, "", 2), (2, "", 2), (4, "a b", 4)]
    assert B.sentencepiece_roundtrip(df.limit(0), PATH).count() == 0
