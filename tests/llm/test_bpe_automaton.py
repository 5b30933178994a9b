import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import cases
from quire.llm import bpe_automaton

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe_automaton.word_codec(VOCABULARY), Tokenizer.from_file(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aAbehilnorst' SİΣσς²3\t\n\xa0́é.,<|>endoftext日🙂", max_size=80))
def test_equals_the_library(both, text):
    codec, model = both
    ids, decoded = codec.encode_decode(text)
    expected = model.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == expected
    assert decoded == model.decode(expected, skip_special_tokens=False)


def test_added_tokens_and_long_words(both):
    codec, model = both
    for text in ("<|endoftext|> a<|startoftext|>b", "x" * 30000, "ha" * 5000, ""):
        assert np.frombuffer(codec.encode_decode(text)[0], "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=12), st.text(alphabet="abc", min_size=1, max_size=14))
def test_gadgets_give_merges_in_order(pairs, word):
    """Any merge list: the only accepted path is what merging by rank gives."""
    vocab, merges = {"a": 0, "b": 1, "c": 2}, []
    for i, j in pairs:
        names = list(vocab)
        a, b = names[i % len(names)], names[j % len(names)]
        if a + b not in vocab:
            vocab[a + b] = len(vocab)
            merges.append((a, b))
    parts = list(word)
    while True:
        ranked = [(merges.index((x, y)), k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if (x, y) in merges]
        if not ranked:
            break
        k = min(ranked)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    assert bpe_automaton.Automaton(vocab, merges).encode(word) == [vocab[p] for p in parts]


def test_cases(spark, both):
    _, model = both
    rows = bpe_automaton.digest_texts(cases.documents(spark).select("doc_id", "text", "n_chars"), VOCABULARY).collect()
    expected = []
    for i, t, *_, n in cases.ROWS:
        ids = model.encode(t or "", add_special_tokens=False).ids
        expected.append((i, n, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    full = bpe_automaton.encode_texts(cases.documents(spark).withColumnRenamed("size", "n_tokens"), VOCABULARY)
    assert {"token_ids", "decoded", "n_tokens"} <= set(full.columns) and full.count() == len(cases.ROWS)
    assert bpe_automaton.digest_texts(cases.empty(spark), VOCABULARY).count() == 0
