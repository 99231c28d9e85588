"""Token counts and byte-level BPE against the libraries themselves."""

import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindrift.llm import bpe, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "a", "  a  b ", "x\n\n y", "it's we'll 12 345!", "né à b", "a <|endoftext|> b", "<|endoftext|>", "日本 語。", "a​ b", "tab\tx", "a" * 5000, " " * 3000 + "x", "\x1c \x1d a", "😀 😀😀"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", ODD)
def test_codec_equals_library(library, text):
    own = bpe.codec(RANKS, P.PATTERN)
    ids = own.encode(text)
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1.'s\n\té!"), max_size=300), st.integers(1, 20), st.integers(1, 12))
def test_chunks_stitch_to_the_whole(text, chunk, overlap):
    pattern = bpe.codec(RANKS, P.PATTERN).pattern
    assert bpe.pre_tokens(pattern, text, chunk, overlap) == pattern.findall(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_tokenizers(name):
    library = Tokenizer.from_file(P.path(name))
    assert token_counts.Counter(P.path(name)).count(ODD) == [len(x) for x in library.encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1.'s\n\té! ​"), max_size=120))
def test_pieces_add_up(text):
    assert "".join(token_counts.safe_pieces(text)) == text
    own = token_counts.counter(P.path("byte_bpe_50k.json"))
    assert own.count([text]) == own.lengths([text])


def test_counts_equal_sentencepiece():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert token_counts.Counter(P.path("piece_bpe_32k.model")).count(ODD) == [len(x) for x in library.encode(ODD, num_threads=1)]


def test_frames(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None, "twice", "twice"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string")
    got = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    counts = {r.doc_id: (r.n_bytes, r.over_limit) for r in token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), limit=100).collect()}
    assert counts[0] == (0, False) and counts[len(ODD)] == (0, False) and counts[12] == (5000, True)
    clash = docs.withColumn("n_tokens", docs.text).withColumn("over_limit", docs.doc_id)
    assert [r.n_tokens for r in bpe.round_trip(clash, RANKS, P.PATTERN).orderBy("doc_id").collect()] == [got[i].n_tokens for i in range(len(rows))]
    assert token_counts.token_counts(clash, P.path("byte_bpe_50k.json")).columns == ["doc_id", "text", "n_chars", "n_bytes", "n_tokens", "over_limit"]
    empty = docs.limit(0)
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0
    assert token_counts.token_counts(empty, P.path("byte_bpe_50k.json")).count() == 0
