"""BPE encoding and decoding by a tokenization automaton.

The automaton's arcs are labelled with tokens; a word's only accepted path spells its BPE
tokens.  It starts as one state with a loop for each base symbol and grows by one gadget for
each merge (u, v) -> w, in merge order:

* the state behind u is copied, the copy loses its arc v, and u leads to the copy from now on;
* w leads to the state that v led to (before the copying, which matters for u = v);
* every state that has the arc u gets the arc w.

Which state an arc leads to depends on its token only, so states are kept as chains of
copies: (state copied, arc lost, merge that made it).  An arc w is missing from a state when one
of the arcs lost on its chain is w, or is a left constituent of w and was lost by the time the
next larger constituent got its arcs.  Rows of the transition table are filled in from this rule
when a (state, token) pair is first met and kept.

Encoding runs a word's symbols from left to right.  Each prefix has exactly one accepted path,
so position i needs only (state, token) of the one token ending there whose arc exists in the
state at its start.  Tokens that can end at a position come from the table of spellings, by
length.  Decoding emits the labels of the arcs, joined as the library does without a decoder:
by one space, word-end marks kept.

Words are found as the vocabulary's file says: NFC, white space runs to one space, lower case
letter by letter, then the split pattern; strings of added tokens are cut out first.  For texts of
Latin letters and usual signs that is one short pattern; others are normalised and split by the
library, whose Unicode tables are its own.  Tokens always come from the automaton.

Defined results: null text is empty; empty text has no tokens and decodes to the empty string;
rows are independent, so ties, repeated rows, null ids and further columns change nothing; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pieces import _LETTERS, _SIGNS, PLAIN_ONLY, slices


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(shifted)) for b in range(256)]


class Automaton:
    """The automaton of a merge list.  Tokens are ids; spelling[t] is a tuple of base symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str = ""):
        self.labels = {i: t for t, i in vocab.items()}
        self.word_end = word_end
        #: State behind each token; for each state the one it copies, the arc it lost, and when.
        self.behind: dict[int, int] = {}
        self.copied, self.lost, self.when = [-1], [-1], [0]
        #: For each token its left constituent and the merge that made it.
        self.left: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for k, (a, b) in enumerate(merges, 1):
            self._gadget(k, vocab[a], vocab[b], vocab[a + b])
        self.table: dict[tuple[int, int], bool] = {}
        spelled = [(t, i) for t, i in vocab.items()]
        self.ending: dict[str, int] = {t: i for t, i in spelled if word_end and t.endswith(word_end)}
        self.inner: dict[str, int] = {t: i for t, i in spelled if not (word_end and t.endswith(word_end))}
        self.longest = max((len(t) for t in self.inner), default=1)
        self.longest_ending = max((len(t) - len(word_end) for t in self.ending), default=1)

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        after_v = self.behind.get(v, 0)
        self.copied.append(self.behind.get(u, 0))
        self.lost.append(v)
        self.when.append(k)
        self.behind[u] = len(self.copied) - 1
        self.behind[w] = after_v
        self.left[w], self.made[w] = u, k

    def has_arc(self, state: int, token: int) -> bool:
        known = self.table.get((state, token))
        if known is None:
            known = self.table[state, token] = self._has_arc(state, token)
        return known

    def _has_arc(self, state: int, token: int) -> bool:
        limits, by = {token: len(self.copied)}, token
        while by in self.left:  # a constituent counts until the next larger one got its arcs
            limits[self.left[by]] = self.made[by]
            by = self.left[by]
        while state > 0:
            if self.when[state] <= limits.get(self.lost[state], -1):
                return False
            state = self.copied[state]
        return True

    def encode(self, symbols: str) -> list[int]:
        """Tokens of one word, given as its symbols."""
        n = len(symbols)
        if not n:
            return []
        states, tokens, starts = [0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        inner, behind, has_arc = self.inner, self.behind, self.has_arc
        last = n - 1 if self.word_end else n
        for i in range(1, last + 1):
            for j in range(i - 1, max(-1, i - 1 - self.longest), -1):
                t = inner.get(symbols[j:i])
                if t is not None and (j == 0 or tokens[j] >= 0) and has_arc(states[j], t):
                    states[i], tokens[i], starts[i] = behind.get(t, 0), t, j
                    break
        if self.word_end:
            for j in range(n - 1, max(-1, n - 1 - self.longest_ending), -1):
                t = self.ending.get(symbols[j:] + self.word_end)
                if t is not None and (j == 0 or tokens[j] >= 0) and has_arc(states[j], t):
                    tokens[n], starts[n] = t, j
                    break
        out, i = [], n
        while i > 0:
            if tokens[i] < 0:
                raise ValueError("a symbol is not in the vocabulary")
            out.append(tokens[i])
            i = starts[i]
        return out[::-1]


#: Goes before words that are in base symbols already.
_SPELLED = "\0"
_SHORT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
class WordCodec:
    """Whole texts to ids and decoded text, with a bounded table of words met."""

    def __init__(self, vocabulary: str, remembered: int = 250_000):
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.symbols = byte_symbols()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.library = Tokenizer.from_file(vocabulary)
        self.remembered = remembered
        self.words = _Known(self)

    def spelled(self, word: str) -> str:
        return "".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")])

    def split(self, text: str) -> list[str]:
        """Words in base symbols."""
        if PLAIN_ONLY.search(text) is None:
            return _SHORT.findall(text.lower())
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [_SPELLED + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_decode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded text)."""
        if len(self.words) > self.remembered:  # words met first are mostly the frequent ones; they stay
            kept = list(islice(self.words.items(), self.remembered // 2))
            self.words.clear()
            self.words.update(kept)
        if len(self.automaton.table) > 4 * self.remembered:
            self.automaton.table.clear()
        found: list[tuple[bytes, str]] = []
        for part in self.cut.split(text) if self.cut and any(a in text for a in self.added) else (text,):
            if part in self.added:
                found.append((self.added[part].to_bytes(4, "little"), part))
            elif part:
                found.extend(map(self.words.__getitem__, self.split(part)))
        return b"".join([x for x, _ in found]), " ".join([y for _, y in found])


class _Known(dict):
    def __init__(self, codec: WordCodec):
        self.codec = codec

    def __missing__(self, word: str) -> tuple[bytes, str]:
        ids = self.codec.automaton.encode(word[1:] if word[0] == _SPELLED else self.codec.spelled(word))
        out = self[word] = np.array(ids, "<u4").tobytes(), " ".join([self.codec.automaton.labels[i] for i in ids])
        return out


@lru_cache(maxsize=2)
def word_codec(vocabulary: str) -> WordCodec:
    """One codec for all tasks of a worker process."""
    return WordCodec(vocabulary)


def _codec_over(vocabulary: str, text_at: int, digest: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_codec(vocabulary)
        for batch in batches:
            for i, j in slices(len(batch)):
                part = batch.slice(i, j - i)
                done = [codec.encode_decode(t or "") for t in part.column(text_at).to_pylist()]
                counts = pa.array([len(x) // 4 for x, _ in done], pa.int64())
                if digest:
                    more = [counts, pa.array([hashlib.sha256(x).hexdigest() for x, _ in done]), pa.array([hashlib.sha256(y.encode("utf-8", "surrogatepass")).hexdigest() for _, y in done])]
                else:
                    more = [counts, pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x, _ in done], pa.list_(pa.int64())), pa.array([y for _, y in done])]
                kept = [part.column(k) for k in range(part.num_columns) if not digest or k != text_at]
                yield pa.RecordBatch.from_arrays([*kept, *more], names)

    return run


def _map(docs: DataFrame, vocabulary: str, text_col: str, digest: bool) -> DataFrame:
    kept = [f for f in docs.schema.fields if not digest or f.name != text_col]
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "token_ids", "decoded"]
    types = ["bigint", "string", "string"] if digest else ["bigint", "array<bigint>", "string"]
    clash = [f.name for f in kept if f.name in new]
    if clash:
        docs = docs.drop(*clash)
        return _map(docs, vocabulary, text_col, digest)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {t}" for n, t in zip(new, types, strict=True)])
    return docs.mapInArrow(_codec_over(vocabulary, docs.columns.index(text_col), digest, [f.name for f in kept] + new), schema)


def encode_texts(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, token_ids and decoded (columns of these names are replaced)."""
    return _map(docs, vocabulary, text_col, digest=False)


def digest_texts(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """As encode_texts, but the ids and the decoded text leave the worker as digests only, and the text not at all."""
    return _map(docs, vocabulary, text_col, digest=True)


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"))
    return digest_texts(docs, public_tokenizers.path("word_bpe_49k.json"))
