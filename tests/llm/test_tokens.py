import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weftline.llm import pieces, token_counts

MODEL, VOCABULARY = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(4)
    odd = ["", " ", "   ", " a", "a ", "\n\n", "a\x00b", "😀😀x", "<s></s><unk>", "▁a ▁▁", "<0x41>", "é́", "\tA" * 50, "a" * 700, "日本語テキスト", "m². x²y", "a<|endoftext|>b <|endoftext|><|endoftext|> x\x1c\x85y", "ab" * 500 + " " * 100 + "z", "x" * 40_000 + "\n" * 300]
    alphabet = "²m.aeabtthe  ▁\n.,éßñ😀<0x'"
    return odd + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]


def given(spark):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def test_pieces_equal_the_library(spark):
    model, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.codec(MODEL)
    for t in texts() + given(spark):
        ids = model.encode(t)
        assert own.encode(t) == ids
        assert own.decode(ids) == model.decode(ids)


def test_decoding_any_ids_equals_the_library():
    model, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.codec(MODEL)
    rng = random.Random(8)
    for k in range(2000):
        ids = [rng.randrange(32_000 if k % 2 else 300) for _ in range(6)]
        assert own.decode(ids) == model.decode(ids), ids


def test_digests_encode_decode(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "x"), (5, None), (5, None)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, n_tokens string")
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def line(i, t):
        ids = model.encode(t or "")
        return (str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())

    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.digests(df, MODEL).collect())
    assert got == sorted(line(*r) for r in rows)
    assert pieces.digests(df.limit(0), MODEL).count() == 0
    back = pieces.decode(pieces.encode(df, MODEL), MODEL, to="back").collect()
    assert all(r["back"] == model.decode(model.encode(r["text"] or "")) for r in back)


def test_long_text_goes_through_in_parts(spark):
    t = "the cat, " * 70_000
    r = pieces.digests(spark.createDataFrame([(1, t)], "doc_id long, text string"), MODEL).first()
    ids = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(t)
    assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("table", [0, 500])
def test_counts_equal_the_library(spark, table, monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE", table)
    library = Tokenizer.from_file(VOCABULARY)
    rows = [(k, t) for k, t in enumerate(texts() + given(spark)[:60])] + [(None, "x y"), (5, None), (5, None)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, n_bytes string")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(df, VOCABULARY).collect())
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((str(i), len((t or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert token_counts.token_counts(df.limit(0), VOCABULARY).count() == 0


def test_frequent_table_is_bounded_and_right(spark):
    df = spark.createDataFrame([("the the the cat",), ("the dog " * 50,)], "text string")
    top = token_counts.frequent(df, VOCABULARY, 2)
    assert set(top) == {" the", " dog"} and all(n == 1 for n in top.values())
