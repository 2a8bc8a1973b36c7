import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from tapeline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


TEXTS = ["", " ", "  ", "\n", " \n x", "a  b", "it's 12's", "é漢字🙂\u200d🙂", "x" * 3000, "ab" * 2000, " " * 500 + "a", "a\u00a0b\x1c\x1d c", "don't\r\n\r\nstop ", "\u2028\u3000 .", "1234567890" * 30, "!?" * 200]


def random_texts():
    rng = random.Random(5)
    for i in range(400):
        alphabet = rng.choice(["ab ", "the erni\n", "aé漢🙂 ", " \t\n!", "0123 .'st"])
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200)))


def test_matches_the_library(codec, library):
    for t in [*TEXTS, *random_texts()]:
        ids = codec.encode(t).tolist()
        assert ids == library.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t.encode()


def test_reduction_is_the_direct_merge(codec):
    for t in [*TEXTS[:-1], *random_texts()]:
        data = t.encode()[:2500]
        assert list(codec.reduce(data)) == codec.merge(data) == codec._merge_long(data)


def test_join_is_associative(codec):
    rng = random.Random(6)
    for _ in range(200):
        data = bytes(rng.choice(b"aberthion ") for _ in range(rng.randint(3, 60)))
        i, j = sorted(rng.sample(range(len(data) + 1), 2))
        a, b, c = (tuple(codec.merge(x)) for x in (data[:i], data[i:j], data[j:]))
        assert codec.join(codec.join(a, b), c) == codec.join(a, codec.join(b, c)) == tuple(codec.merge(data))


def test_documents(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, None), (3, "", "y"), (None, "é" * 20_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode_documents(df, PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = out.collect()
    assert len(got) == 5 and all(r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() and r["n_tokens"] == len(r["token_ids"]) for r in got)
    assert {r["n_tokens"] for r in got if not r["text"]} == {0}
    back = bpe.decode_documents(out, PATH).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    assert bpe.encode_documents(df.limit(0), PATH, public_tokenizers.PATTERN, digests_only=True).count() == 0
