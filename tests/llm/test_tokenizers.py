import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st

from shelfwise.llm import bpe, tokens
from shelfwise.llm.vocab import Merges, read_vocabulary, vocabulary_path

Tokenizer = pytest.importorskip("tokenizers").Tokenizer
SIGNS = list("abthein'sS  \n\té漢1²½!?-_. \x1c\x85\xa0ćΣİ") + [" the", "<|endoftext|>", "<|startoftext|>", "ing ", "é"]
TEXTS = st.lists(st.sampled_from(SIGNS), max_size=60).map("".join)
FIXED = ["", "a  b", "a   b", "a\n b", "a \n b  ", "  x", "x ", "x\n ", "x\n\n y", " 's it's I'll'd 'S", "ΑΣ ΣΑΣ", "a" * 3000, "ab" * 900 + "!" * 900, "漢字かな", "\n" * 99, " " * 70 + "x"]


@pytest.fixture(scope="module")
def byte():
    path = vocabulary_path(bpe.VOCABULARY)
    return bpe.Encoder(read_vocabulary(path)), Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def word():
    path = vocabulary_path(tokens.VOCABULARY)
    spec = read_vocabulary(path)
    return tokens.Counter(spec, tokens.whole_tokens(Merges(spec))), Tokenizer.from_file(path)


def test_encoding_fixed_texts(byte):
    own, library = byte
    for text in FIXED:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_encoding_equals_the_library(byte, text):
    own, library = byte
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text).tolist() == ids
    assert own.decode(ids) == text


def test_pairs_are_compatible_if_they_encode_to_themselves(byte):
    own, _ = byte
    merges, names = Merges(read_vocabulary(vocabulary_path(bpe.VOCABULARY))), own.names
    random.seed(2)
    some = random.sample(sorted(own.made), 400)
    for left in some[:200]:
        for right in some[200:230]:
            assert own.compatible(left, right) == (merges.merge(list(names[left] + names[right])) == [names[left], names[right]])


def test_short_and_long_merging_agree(byte):
    merges = Merges(read_vocabulary(vocabulary_path(bpe.VOCABULARY)))
    random.seed(4)
    for _ in range(200):
        symbols = random.choices("theinga ", k=random.randint(0, 80))
        assert merges._short(symbols) == merges._long(symbols)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_counts_equal_the_library(word, text):
    own, library = word
    assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_counts_of_fixed_texts(word):
    own, library = word
    for text in FIXED:
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_whole_tokens_are_proven(word):
    own, library = word
    some = sorted(own.proven)[::500]
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in some if t == t.lower() and own.pattern.findall(t) == [t])


def test_digests_of_odd_rows(odd_docs, no_docs, byte):
    library = byte[1]
    rows = bpe.digests(odd_docs).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(rows) == 10
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.digests(no_docs).count() == 0


def test_token_counts_of_odd_rows(odd_docs, no_docs, word):
    library = word[1]
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    rows = tokens.token_counts(odd_docs).collect()
    assert len(rows) == 10
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)
    assert tokens.token_counts(no_docs).count() == 0
