"""Array splitting, word ids, counts and packing against the libraries, without Spark."""

import base64
import json

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mdweave.llm import bpe_codec, packing, token_counts, token_files
from mdweave.llm.pretokens import split_spaced, split_words
from mdweave.llm.wordtokens import WordTokens

WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PARTS = st.sampled_from([*"ab stredvlm'  \n\t12.,!éßΣ漢²", "\x1c", "\x85", "　", "😀", "'re", "'ll ", " 's", "word", "<|endoftext|>"])
TEXTS = st.lists(st.lists(PARTS, max_size=25).map("".join), max_size=6)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_splits_equal_the_patterns(texts):
    for split, pattern in ((split_spaced, P.PATTERN), (split_words, WORDS)):
        pieces, counts = split(texts)
        expected = [regex.findall(pattern, t) for t in texts]
        assert pieces == [w for ws in expected for w in ws]
        assert counts.tolist() == [len(ws) for ws in expected]


@pytest.fixture(scope="module")
def byte_level():
    return WordTokens(P.path("byte_bpe_50k.json"), most=40), Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_word_ids_equal_the_library(byte_level, texts):
    own, library = byte_level
    assert [x.tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="module")
def word_level():
    return token_counts.WordCounts(P.path("word_bpe_49k.json"), most=40), Tokenizer.from_file(P.path("word_bpe_49k.json"))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_counts_equal_the_library(word_level, texts):
    own, library = word_level
    assert own.of(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_count_of_a_very_long_word(word_level):
    own, library = word_level
    t = "thequickbrownfox" * 5000 + " ΑΣ İ"
    assert own.of([t]).tolist() == [len(library.encode(t, add_special_tokens=False).ids)]


def test_vocabulary_files_agree_on_ranks():
    ranks = bpe_codec.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    own = WordTokens(P.path("byte_bpe_50k.json"))
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    t = "Der schnelle Fuchs, l'été; the end 1234!!"
    assert own.encode([t])[0].tolist() == enc.encode_ordinary(t)
    assert ranks[base64.b64decode("IQ==")] == json.load(open(P.path("byte_bpe_50k.json")))["model"]["vocab"]["!"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=600), st.data())
def test_boundaries(sizes, data):
    ends = np.cumsum(np.array(sizes, np.int64))
    index = token_files.BoundaryIndex(token_files.index_bytes([None, *range(len(sizes) - 1)][:len(sizes)], ends, 2))
    full = [0, *ends.tolist()]
    assert [index.offset(i) for i in range(len(full))] == full
    a = data.draw(st.integers(0, len(sizes)))
    b = data.draw(st.integers(a, len(sizes)))
    assert index.offsets(a, b).tolist() == full[a:b + 1]
    assert index.ids_of(0, len(sizes)) == [None, *range(len(sizes) - 1)][:len(sizes)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 8))
def test_best_fit(sizes, most):
    bins, free, placed = packing.BestFit(50, most, 0), {}, {}
    for n in sizes:
        sequence, offset = bins.place(n)
        fits = [f for f in free.values() if f >= n]
        if fits:  # the fullest open sequence that holds it
            assert free[sequence] == min(fits)
        else:
            assert sequence not in placed
        assert offset == placed.get(sequence, 0)
        placed[sequence] = offset + n
        free[sequence] = 50 - placed[sequence]
        if not free[sequence]:
            del free[sequence]
        if len(free) > most:  # the fullest closes; of equal ones the last
            least = min(free.values())
            for s in [s for s, f in free.items() if f == least]:
                if s not in {x for q in bins.free for x in q}:
                    del free[s]
        assert sorted(free) == sorted(s for q in bins.free for s in q)


@pytest.mark.parametrize("total", [1, 2047, 2048, 2049, 5000, 4096])
def test_cut(total):
    parts = packing.cut(total, 2048)
    assert sum(n for _, n in parts) == total and all(n == 2048 for _, n in parts[1:])
    assert [s for s, _ in parts] == np.r_[0, np.cumsum([n for _, n in parts])[:-1]].tolist()


def test_numbers_pack_and_unpack():
    x = np.array([0, 5, 70000, 2**32 - 1, 3])
    assert bpe_codec.unpack_numbers(bpe_codec.pack_numbers(x), 5).tolist() == x.tolist()
    assert bpe_codec.unpack_numbers(bpe_codec.pack_numbers(x[:0]), 0).tolist() == []
