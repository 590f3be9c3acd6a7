"""Token counts and BPE against the libraries."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from canvass.llm import bpe, tokencount
from canvass.llm.vocab import read_json, read_ranks

WORDS = public_tokenizers.path(tokencount.TOKENIZER)
RANKS = public_tokenizers.path(bpe.RANKS)
ODD = st.text(alphabet=st.sampled_from(list(" \n\t\r\x0b\x1c\x85\xa0 ab12.!'sé漢Σςİß́<|>")), max_size=40)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(tokencount.MergeTable(read_json(WORDS)))


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def brute(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(docs, tokenizer, texts):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(docs, WORDS).collect())
    want = [(str(i), len((t or "").encode()), brute(tokenizer, t)) for i, t in texts]
    assert got == sorted((i, b, n, n > 2048) for i, b, n in want)


def test_no_documents(nothing):
    assert tokencount.count_tokens(nothing, WORDS).count() == 0
    assert bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(text=ODD)
def test_odd_texts_count_alike(text, tokenizer, counter):
    assert counter.count([text.encode()]) == [brute(tokenizer, text)]


def test_runs_of_one_symbol_merge_from_the_left(tokenizer, counter):
    found = [("a" * n + "b" * (n % 3)) for n in range(1, 60)]
    assert counter.count([x.encode() for x in found]) == [brute(tokenizer, x) for x in found]


@settings(max_examples=500, deadline=None)
@given(text=ODD)
def test_words_cut_where_the_pattern_cuts(text, encoding):
    assert [i for w in bpe.cut_words(text) for i in encoding.encode_ordinary(w)] == encoding.encode_ordinary(text)
    assert "".join(bpe.cut_words(text)) == text


@pytest.mark.parametrize("block_chars", [1, 700, bpe.BLOCK_CHARS])
def test_bpe_round_trip(docs, texts, encoding, block_chars):
    coded = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, block_chars, slots=7), RANKS)
    got = sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in coded.collect())
    assert got == sorted((str(i), encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts)


def test_packing():
    words = [b"", b"a", "é漢".encode(), b"x" * 300]
    assert bpe._unpack_words(bpe._pack_words(words)) == words
    numbers = np.array([0, 1, 255, 256, 70000, 2**32 - 1], np.uint32)
    assert (bpe._unpack_numbers(bpe._pack_numbers(numbers)) == numbers).all()
    for ids in ([[1, 2], [], [50000]], [[70000], [3]], []):
        counts, flat = bpe._unpack_ids(bpe._pack_ids(ids))
        assert counts.tolist() == [len(x) for x in ids] and flat.tolist() == [i for x in ids for i in x]


def test_rows_of_a_block_hold_its_documents():
    block = bpe.Block("b")
    rng = random.Random(3)
    for i in range(50):
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))]
        block.ids.append(i)
        block.coded.append(np.array([block.index.setdefault(w, len(block.index)) for w in words], np.uint32))
    named = {}
    for row in block.word_rows(5):
        named |= dict(zip(bpe._unpack_numbers(row["numbers"]).tolist(), bpe._unpack_words(row["words"])))
    assert named == {i: w.encode() for w, i in block.index.items()}
    for row in block.document_rows(5):
        body = bpe._unpack_numbers(row["numbers"])
        n = len(row["doc_ids"])
        assert body[n:].tolist() == [c for i in row["doc_ids"] for c in block.coded[i].tolist()]


def test_lists_are_decoded_at_once():
    import pyarrow as pa

    from canvass.llm.bpe import decoded

    tokens = pa.array([b"a", b"", b"bc", None, "é".encode()], pa.large_binary())
    ids = pa.array([[4], [0, 2, 4, 1], None, [], [2]], pa.list_(pa.int32()))
    assert decoded(tokens, ids[1:]).to_pylist() == ["abcé".encode(), None, b"", b"bc"]
    assert decoded(tokens, ids[:0]).to_pylist() == [] and decoded(tokens, ids[2:4]).to_pylist() == [None, b""]
    for wrong in (3, 5, -1, None):
        with pytest.raises(Exception):
            decoded(tokens, pa.array([[0, wrong]], pa.list_(pa.int32())))
