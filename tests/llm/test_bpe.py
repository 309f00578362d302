import base64
import hashlib
import random
import weakref

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import bpe, kernel

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RAW = open(PATH, "rb").read()
CODEC = bpe.codec_for(RAW, P.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def same(text):
    ids = LIBRARY.encode_ordinary(text)
    assert CODEC.encoded(text) == ids
    assert CODEC.digests(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    same(text)


@given(st.text(alphabet=" \n\t\r\x0b\x1c\x1f\x85\xa0 ​　aé1.'s", max_size=30))
@settings(max_examples=500, deadline=None)
def test_white_space(text):
    same(text)


@given(st.lists(st.sampled_from(["a", "e", "th", "ing", "ung", "é", "ñ", "aa", "zz", "xq", "tion"]), max_size=60))
@settings(max_examples=500, deadline=None)
def test_long_words(parts):
    same("".join(parts))


def test_blocks_and_long_texts(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 40)
    monkeypatch.setattr(CODEC.words, "size", 50)
    rng = random.Random(1)
    for _ in range(200):
        same(" ".join("".join(rng.choice("abcdeéß.,!\n1") for _ in range(rng.randint(0, 9))) for _ in range(60)))
    same("x" * 5000)
    same("ab  " * 900)


def test_rows(spark):
    rows = [(1, "Hallo  Welt", 0), (1, "Hallo  Welt", 0), (2, None, 0), (3, "", 0), (None, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = sorted(map(tuple, bpe.digests(df, PATH, P.PATTERN).collect()), key=str)
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(found) == 5 and (2, 0, nothing, nothing) in found and (3, 0, nothing, nothing) in found
    back = bpe.decode(bpe.encode(df.drop("n_tokens"), PATH, P.PATTERN), PATH, P.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect())
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0


@pytest.mark.parametrize("kind", ["halves", "pairs"])
def test_joined_is_an_encoding(kind):
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("aabcdeth") for _ in range(rng.randint(1, 12))).encode() for _ in "ab")
        assert CODEC.joined(CODEC.merged(a), CODEC.merged(b)) == CODEC.merged(a + b)


def test_caches_go_with_the_stage():
    """A worker keeps its codec for its next task, and not beside the work of operators on words."""
    codec = weakref.ref(bpe.codec_for(RAW, "x"))
    assert bpe.codec_for(RAW, "x") is codec()
    assert [len(h) for _, _, h, _, _ in kernel.words(pa.array(["a b"]))] == [2]
    assert codec() is None
    assert bpe.codec_for(RAW, P.PATTERN).encoded("some words") == LIBRARY.encode_ordinary("some words")
