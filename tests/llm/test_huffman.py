import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import cases
from quire.llm import huffman
from quire.llm.common import new_folder
from quire.llm.pieces import PieceEncoder, text_slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    model, start, out = Tokenizer.from_file(VOCABULARY), 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_cases(spark):
    folder = new_folder(spark, "t")
    files = huffman.write_token_files(cases.documents(spark), VOCABULARY, folder, block_tokens=512, every=16, file_tokens=20000)
    got = [tuple(r) for r in huffman.read_token_files(files, folder).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected(cases.ROWS)))
    folder = new_folder(spark, "t")
    files = huffman.write_token_files(cases.empty(spark), VOCABULARY, folder)
    assert huffman.read_token_files(files, folder).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300), st.integers(9, 16))
def test_lengths_are_a_full_code_within_the_limit(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit)
    used = lengths[np.array(counts) > 0].astype(int)
    assert (lengths[np.array(counts) == 0] == 0).all() and (used <= limit).all()
    if len(used) > 1:
        assert sum(2.0**-n for n in used) == 1.0


def test_lengths_are_optimal_without_a_tight_limit():
    import heapq

    counts = np.random.default_rng(3).integers(1, 10**5, 500)
    heap, total = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    assert int((huffman.code_lengths(counts, 30).astype(int) * counts).sum()) == total


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=900), st.integers(1, 64))
def test_block_round_trip(ids, every):
    ids = np.array(ids)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=41), 12)
    words, checks = huffman.encode_block(ids, huffman.canonical_codes(lengths), lengths, every)
    counts = np.full(len(checks), every)
    counts[-1] = len(ids) - every * (len(checks) - 1)
    assert (huffman.decode_lanes(words, checks, counts, huffman.decoding_table(lengths)) == ids).all()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAeos' tTée’ß²½\t\n\r\x1c\x85\xa0.,<|>12日🙂Σ-_ ", max_size=60))
def test_pieces_equal_the_library(text):
    encoder = test_pieces_equal_the_library.__dict__.setdefault("e", PieceEncoder(VOCABULARY))
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.model.encode(text, add_special_tokens=False).ids


TEXTS = st.one_of(st.none(), st.text(alphabet="aAeos' tTée’ß²½\t\n\r\x0b\x1c\x85\xa0\u2003\u3000.,<|>12日🙂Σ-_« ", max_size=40), st.text(alphabet=" \n'a1.é", max_size=30), st.lists(st.sampled_from(["it's", " ", "  ", "\n", "\n\n", "'re", "d'été", "<|endoftext|>", "x" * 70, "12ab", "(a", "e\u0301", "\u3000"]), max_size=12).map("".join))


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=8), st.integers(0, 3))
def test_columns_of_texts_equal_the_library(texts, skipped):
    encoder = test_columns_of_texts_equal_the_library.__dict__.setdefault("e", PieceEncoder(VOCABULARY, "<u2", remembered=40))
    for kind in (pa.string(), pa.large_string()):
        got = encoder.encode_column(pa.array(texts, kind)[skipped:], b"\2\0").to_pylist()
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [[*encoder.model.encode(t or "", add_special_tokens=False).ids, 2] for t in texts[skipped:]]
    assert len(encoder.known) <= 40


def test_a_piece_is_looked_up_once_however_often_it_stands():
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    encoder = PieceEncoder(VOCABULARY)
    encoder.known = Counted()
    text = "One word, one word and 12 words.\n" * 50
    assert all(np.frombuffer(x, "<u4").tolist() == encoder.model.encode(text, add_special_tokens=False).ids for x in encoder.encode([text] * 20))
    assert encoder.known.asked == len(encoder.known) == 9  # of 9,000 pieces


def test_the_library_gets_few_texts_at_a_time():
    class Watched:
        most = 0

        def __init__(self, model):
            self.model = model

        def encode_batch_fast(self, texts, **options):
            self.most = max(self.most, sum(map(len, texts)))
            return self.model.encode_batch_fast(texts, **options)

    encoder = PieceEncoder(VOCABULARY)
    encoder.model = Watched(encoder.model)
    texts = [f"слово {i} и дело " * 40 for i in range(400)] + [" ".join(f"w{i}x{k}" for k in range(100)) for i in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [encoder.model.model.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.model.most < 10_000 < sum(map(len, texts))


def test_slices_of_texts_hold_all_rows():
    texts = pa.array(["ab", None, "", "c" * 50, "d", "e", None])
    runs = list(text_slices(texts, 4))
    assert [k for i, j in runs for k in range(i, j)] == list(range(len(texts)))
    assert max(sum(len(t or "") for t in texts[i:j].to_pylist()) for i, j in runs if j > i + 1) <= 4
    assert list(text_slices(pa.array([], pa.string()))) == []
