import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gatewarden.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(texts):
    own = Tokenizer.from_file(PATH)
    return [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]


def expected(docs, limit):
    rows = docs.select("doc_id", "text").collect()
    return sorted(
        (repr(r.doc_id), len((r.text or "").encode()), n, n > limit) for r, n in zip(rows, plain(r.text for r in rows), strict=True)
    )


def got(found):
    return sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect())


@pytest.mark.parametrize("long", [64, 1000, 1 << 20])
def test_matches_the_library_on_whole_texts(spark, odd_docs, long):
    more = [
        (20, "<|startoftext|>a <|endoftext|> b<|endoftext|>" * 40),
        (21, "it's we'll\r\n\r\nthey'd " * 60),
        (22, "é ́  x y\u000b\u0085z " * 50),
        (23, "漢字かな。カタカナ，中文、なし" * 80),
        (23, "漢字かな。カタカナ，中文、なし" * 80),
        (24, "ΣΑΣ ΑΣ. İI ẞ 1234567 ١٢٣ " * 40),
    ]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    clashing = docs.withColumns({"tokens": F.lit("x"), "n_bytes": F.lit(-1), "piece": F.lit(0), "a": F.lit(None)})
    assert got(token_counts.counts(clashing, PATH, limit=100, long=long)) == expected(docs, 100)


def test_cuts_are_safe_and_lose_nothing():
    own = Tokenizer.from_file(PATH)
    draw = random.Random(5)
    letters = "ab'sé́ \t\n.!<|endoftext|>12漢。字，ΣİＡ‍"
    for size in (3, 10, 40):
        for _ in range(150):
            text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 200)))
            pieces = list(token_counts.cut(text, size))
            assert "".join(pieces) == text
            whole = len(own.encode(text, add_special_tokens=False).ids)
            assert sum(len(own.encode(p, add_special_tokens=False).ids) for p in pieces) == whole, (text, pieces)


def test_pieces_are_remembered_within_bounds(monkeypatch):
    own = Tokenizer.from_file(PATH)
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    with open(PATH, "rb") as file:
        count = token_counts.Pieces(token_counts.counter(file.read(), "json"))
    texts = ["a b\x0bc\x0cd\u00a0e f\u2028g", "a a h i j k", "", "  l m\x1cn \u0301o a\u0301 é", "b k zz"]
    for text in texts * 2:
        assert count([text.encode()]) == [len(own.encode(text, add_special_tokens=False).ids)], text
    assert len(count.known) <= 5 + 7


def test_other_libraries_and_empty_table(spark, odd_docs, no_docs):
    import sentencepiece

    assert token_counts.counts(no_docs, PATH).collect() == []
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    found = token_counts.counts(odd_docs, path, boundaries=token_counts.KEPT, long=100)
    wanted = sorted((repr(r.doc_id), len(own.encode(r.text or ""))) for r in odd_docs.collect())
    assert sorted((repr(r.doc_id), r.n_tokens) for r in found.collect()) == wanted
    with pytest.raises(ValueError):
        token_counts.counter(b"", "txt")
