"""The cached encoder against the library, with caches so small that they start anew all the time; bounds on what it holds."""

import random

import numpy as np
import pytest

from sigspark.llm import encode


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    letters = "abcdefgh'0123456789.,;-ÄÖüßéñ日本😀İ"
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(3000)] + ["it's", "WE'LL", "<|startoftext|>", "</w>", "x" * 500]
    return [" ".join(rng.choices(words, k=40)) for _ in range(200)] + ["", " \n", "\x00\x01", "a b", "1" * 300]


def test_ids_are_the_librarys(texts, monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(encode.default_vocabulary())
    plain.encode_special_tokens = True
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for pieces, parts in ((encode.PIECES, encode.PARTS), (7, 5)):
        monkeypatch.setattr(encode, "PIECES", pieces)
        monkeypatch.setattr(encode, "PARTS", parts)
        own = encode.PieceEncoder(encode.default_vocabulary())
        for _ in range(2):  # the second time from the cache
            got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(t.encode() for t in texts)]
            assert got == want
        assert len(own.pieces) <= pieces and len(own.parts) <= parts


def test_what_a_worker_holds_is_bounded():
    """Entries are few and short: some 200 bytes each at most, so both caches stay under 150 MB whatever the corpus."""
    own = encode.PieceEncoder(encode.default_vocabulary())
    for _ in range(2):
        list(own.encode(b"w%dx" % i + b" " + b"y" * 400 for i in range(2000)))
    assert max(map(len, own.pieces)) <= encode.LONGEST and max(map(len, own.parts)) <= encode.LONGEST
    assert (encode.PIECES + encode.PARTS) * (33 + encode.LONGEST + 33 + 4 * encode.LONGEST // 2 + 40) < 200e6


def test_words_that_occur_once_take_no_room():
    own = encode.PieceEncoder(encode.default_vocabulary())
    list(own.encode([b"one two three", b"two three four"]))
    assert set(own.pieces) == {b"two", b"three"}


def test_a_text_of_half_a_million_words_is_scored_whole(spark):
    from sigspark.llm import op4_lm

    text = " ".join(f"w{i * i % 1009}" for i in range(500_000))
    docs = spark.createDataFrame([(1, text), (2, "w1 w2 unknown")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in op4_lm.model_scores(docs, part_tokens=100_000).collect()}
    assert got[1]["n_tokens"] == 500_001 and got[1]["train_tokens"] == 500_001 + 4 * (not got[2]["held_out"])
    assert got[1]["score"] > got[1]["base_score"]
