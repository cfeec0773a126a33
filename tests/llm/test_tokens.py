import random

import pytest

from loomspan.llm import tokens as T

PIECES = ["x" * 5000, "ab1" * 3000, "don't " * 50, " " * 4000, "ñandú 你好 " * 20, "\n\n\t  <|endoftext|> ok", "=" * 3000, "a"]


@pytest.fixture(scope="module")
def e():
    return T.encoder(T.VOCABULARY)


def test_trees_are_the_whole(e):
    rnd = random.Random(1)
    for _ in range(150):
        letters = rnd.choice(["a", "ab", "abcdefghijklmnopqrstuvwxyz", "etaoin", "ñüéa", "0123456789", "=-_*", "的一是"])
        piece = "".join(rnd.choice(letters) for _ in range(rnd.choice([1500, 3000, 9000]))).encode()
        assert e.piece(piece) == list(e.single(piece))


def test_texts_against_both_libraries(e):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for text in [*PIECES, "".join(PIECES), "I'll we're it's they'd"]:
        ids = [int(i) for i in e.text(text)]
        assert ids == e.base.encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids
        assert e.base.decode(ids) == text


def test_frame(spark, e, monkeypatch):
    texts = [None, "", " ", "hello world", "hello world", "".join(PIECES), "z" * 3000 + " end"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, k string")
    for giant, part in ((4_000_000, 250_000), (100, 700)):  # whole texts; and cut into parts that tasks encode
        monkeypatch.setattr(T, "GIANT", giant)
        monkeypatch.setattr(T, "PART", part)
        assert all(b"".join(p for p, _ in T.parts_of(t, e)).decode() == t for t in texts if t)
        got = {r.doc_id: (r.ids, r.k) for r in T.encode_texts(df, "text").collect()}
        assert got == {i: (e.base.encode_ordinary(t) if t else [], "k") for i, t in enumerate(texts)}
        n = {r.doc_id: r.n_tokens for r in T.count_tokens(df, "text").collect()}
        assert n == {i: len(ids) for i, (ids, _) in got.items()}
    assert T.encode_texts(df.limit(0), "text").count() == 0
