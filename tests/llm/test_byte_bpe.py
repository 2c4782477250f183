import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from gatewarden.llm import byte_bpe as b

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.read_ranks(RANKS), special_tokens={})


def test_ids_and_round_trip_match_the_library(odd_docs, library):
    docs = odd_docs.withColumn("ids", F.lit("clash"))
    rows = b.encoded(docs, RANKS, P.PATTERN).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    for r in b.digest(b.encoded(odd_docs.where("doc_id = 8"), RANKS, P.PATTERN)).collect():
        text = odd_docs.where("doc_id = 8").first().text
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(no_docs):
    assert b.encoded(no_docs, RANKS, P.PATTERN).count() == 0


def test_recursive_query_and_heap_agree_with_the_library(library):
    codec = b.Codec(b.read_ranks(RANKS), P.PATTERN)
    draw = random.Random(3)
    pieces = {
        "".join(draw.choice(["th", "e", "a", "xq", "é", "zz", "9", "aaaa", "the", "漢"]) for _ in range(draw.randint(1, 24)))
        for _ in range(400)
    }
    pieces |= {"a" * n for n in range(1, 90)} | {"ab" * n for n in range(1, 60)}
    codec._merge([(p, p.encode()) for p in pieces])
    for piece in pieces:
        ids = codec.ids[piece]
        assert codec.decode([ids]) == [piece.encode()]
        want = library._core_bpe.encode_single_piece(piece.encode())
        assert codec.contracted(piece.encode()) == want
        if piece.encode() not in codec.ranks:
            assert list(np.frombuffer(ids, "<i4")) == want


def test_a_full_memory_starts_anew(monkeypatch, library):
    monkeypatch.setattr(b, "REMEMBERED", 5)
    codec = b.Codec(b.read_ranks(RANKS), P.PATTERN)
    for text in ("one two three four five six", "seven eight nine", None, "", "one zzqqy"):
        (ids,), (decoded,) = codec.run([text])
        assert list(np.frombuffer(ids, "<i4")) == library.encode_ordinary(text or "")
        assert decoded == (text or "").encode()
