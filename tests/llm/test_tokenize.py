"""Encoding against the tokenizers library and a round trip."""

import random

import pyarrow as pa
import pytest

from foliolith.llm import tokenize as K
from foliolith.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return K.Encoder.from_file(tokenizer_path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_random_texts(encoder, reference):
    r = random.Random(7)
    pool = list(" \n\t'slltredmv!.1²½é中\u00a0\u3000\u200b\x85\x1cćａ😀_ab") + ["<|endoftext|>", "'re", "  "]
    texts = ["".join(r.choices(pool, k=r.randint(0, 40))) for _ in range(4000)]
    assert K.encode_column(pa.array(texts), encoder).to_pylist() == reference(texts)


def test_every_code_point(encoder, reference):
    texts = [f"a{chr(c)} {chr(c)}{chr(c)}1{chr(c)}  {chr(c)}" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    assert K.encode_column(pa.array(texts), encoder).to_pylist() == reference(texts)


def test_long_texts_are_cut_at_borders(encoder, reference, monkeypatch):
    monkeypatch.setattr(K, "CHUNK_BYTES", 64)
    r = random.Random(1)
    text = "".join(r.choices(["word", " ", "  ", "\n", "!", "12", "'s", "é", "\r\n"], k=3000))
    assert K.encode_column(pa.array([text, None, "", text]), encoder).to_pylist() == [reference([text])[0], [], [], reference([text])[0]]


def test_unbroken_text(encoder, reference):
    text = "x" * 20000
    assert encoder.encode(text) == reference([text])[0]


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys = [str(i).encode() for i in range(3000)]
    table = K.PerfectHash(keys, list(range(3000)))
    import numpy as np

    for some, want in ((keys, list(range(3000))), ([b"x" + k for k in keys], [-1] * 3000)):
        blob = np.frombuffer(b"".join(some), np.uint8)
        ends = np.cumsum([len(k) for k in some])
        starts = ends - np.array([len(k) for k in some])
        one, two = K.span_hashes(blob, starts, ends)
        assert table.lookup(one, two, blob, starts, (ends - starts).astype(np.int32)).tolist() == want
    assert sorted(table.value.tolist()) == list(range(3000))


def test_heap_merges_like_the_naive_way(encoder):
    def naive(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            ranked = [(encoder.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            if not ranked or min(ranked)[0] == 1 << 30:
                return [encoder.ranks[p] for p in parts]
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    r = random.Random(3)
    for _ in range(300):
        piece = bytes(r.choices(b"abcdeinrst\xc3\xa9\xe4", k=r.randint(1, 25)))
        assert K.merge_bytes(piece, encoder.ranks) == naive(piece)


def test_frame(spark, encoder):
    df = spark.createDataFrame([(1, "a b", "clash"), (1, "a b", None), (2, None, ""), (None, "", "x")], "doc_id bigint, text string, ids string")
    found = sorted(((r[0], list(r[1])) for r in K.token_ids(df, encoder).collect()), key=str)
    assert found == sorted([(1, encoder.encode("a b"))] * 2 + [(2, []), (None, [])], key=str)
    assert K.token_ids(df.limit(0), encoder).count() == 0


@pytest.mark.parametrize("size", [512, 1024, 2048, 4096])
def test_words_of_equal_hashes_stay_apart(encoder, reference, size):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"{other} {word}", word]
    assert K.encode_column(pa.array(texts), encoder).to_pylist() == reference(texts)


def test_hashes_decide_nothing_alone(encoder, reference, monkeypatch):
    real = K.span_hashes
    monkeypatch.setattr(K, "span_hashes", lambda *a: tuple(x % 7 for x in real(*a)))
    texts = ["the cat sat on the mat and ran", "a b c d e f g h the 1 2 3 of of"]
    assert K.encode_column(pa.array(texts), encoder).to_pylist() == reference(texts)
