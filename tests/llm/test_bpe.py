import base64
import random

import pytest
import tiktoken
from tokenizers import Tokenizer

from larkspur.llm.bpe import Encoder, Vocabulary, encode_corpus, tokenizer_file

RAW, PATTERN = tokenizer_file("byte_bpe_50k")
V = Vocabulary(RAW)


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_str(RAW.decode())
    t.encode_special_tokens = True
    return t


def texts():
    rnd = random.Random(3)
    parts = ["a", "b", "aa", "ab", "th", "e", "in", "ing", "é", "ü", "記", "👍🏽", "0", "1", "!", "--", "==", "  ", "\n", "\r\n", "\t", "<|endoftext|>", "'s", "_", "xyz", "е", "‍"]
    out = ["".join(rnd.choice(parts) * rnd.choice([1, 1, 1, 2, 5, 30]) for _ in range(rnd.randint(1, 20))) for _ in range(3000)]
    return out + [chr(rnd.randrange(32, 0x2FFF)) * rnd.randint(1, 400) for _ in range(500)] + ["a" * 30_000, " " * 5000, "ab" * 9000]


def test_equals_the_public_libraries(public):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb"))}
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    t = texts()
    got = Encoder(V, PATTERN).encode(t)
    assert got == [x.ids for x in public.encode_batch(t, add_special_tokens=False)]
    assert got == [other.encode_ordinary(x) for x in t]


def test_round_trip_and_exact_merge():
    token = {i: b for b, i in V.ids.items()}
    for t in texts()[:500]:
        assert b"".join(token[i] for i in Encoder(V, PATTERN).encode([t])[0]) == t.encode()
    assert all(V.merged(b) == [i] for b, i in list(V.ids.items())[:5000])


def test_corpus(spark):
    rows = [(1, "Hello wörld <|endoftext|>", 7), (2, None, 7), (3, "", 7), (None, "Hello", 7), (3, "", 7)]
    df = encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids int"), "doc_id", "text", RAW, PATTERN)
    got = sorted(((r.doc_id or 0, r.ids) for r in df.collect()))
    assert got[0] == (0, [15496]) and got[2:] == [(2, []), (3, []), (3, [])]
    assert got[1][1] and 50256 not in got[1][1]
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text", RAW, PATTERN).collect() == []
