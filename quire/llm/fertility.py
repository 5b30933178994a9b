"""Quality rules with tokeniser fertility.

Base figures of a text come from its words (runs without blanks): characters in words, symbols,
lines equal to an earlier line, and words in three-word windows that are found twice or more.

Fertility: a public vocabulary with byte fallback splits each word, and the text gets

* characters per token: few for text that the vocabulary can't read (noise, codes, mixed-up
  case), many for repeated long tokens;
* byte share: tokens that are single bytes because no piece fits;
* token entropy in bits, with Miller and Madow's correction for the number of tokens: loops and
  texts strewn with the same few signs stay below prose;

Bands per language, or per script where the language is unknown, say between which values a text
is kept.  They are parameters (``BANDS``), set near the range of good rows of the language;
figures of few tokens are noisy, so the bands apply from ``least_tokens`` tokens on.

Each worker keeps a bounded table of words and their tokens, and tokenizes new ones in batches.

Defined results: null or empty text has no words, and fails the base rule; an unknown or null
language goes by the script of most letters, a text without letters by the default band; rows
are independent, so ties, repeated rows and null ids change nothing; an empty table gives no rows;
further columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, WORD, fresh, table
from .pieces import slices

_WORD = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
#: (least, most characters per token; most byte share; least entropy; slacks of the least characters per
#: token and of the least entropy).  A text of n tokens may have slack / sqrt(n) less than the least.
#: The four languages are set from the good labelled rows of check_l that pass the base rule and whose text's
#: crc32 is even. Characters per token: the least figure, slack included, less 0.03. Entropy: the figure, slack
#: included, that one in 2,000 lies below, less 0.02 bits, but 0.05 bits or more below three runs of 20,000 words
#: of sf0.1's joined good texts, as the slack is nearly used up there; of the slacks 10, 12 and 14 the one by which most
#: junk goes. Byte share at most the largest seen (0) plus 0.02.
#: No junk lies above the good rows' characters per token, and prose of real words does: 7.0 stays.
BANDS = {
    "en": (1.913, 7.0, 0.02, 6.962, 2.0, 12.0),
    "fr": (1.705, 7.0, 0.02, 6.674, 2.0, 10.0),
    "de": (2.008, 7.0, 0.02, 6.736, 2.0, 10.0),
    "es": (1.794, 7.0, 0.02, 6.870, 2.0, 14.0),
    "Latin": (1.10, 8.0, 0.15, 6.20, 0.0, 9.0),
    "Cyrillic": (0.80, 8.0, 0.25, 5.50, 0.0, 9.0),
    "Greek": (0.50, 8.0, 0.60, 4.50, 0.0, 9.0),
    "Han": (0.20, 4.0, 0.90, 5.50, 0.0, 9.0),
    "default": (0.20, 12.0, 0.95, 4.00, 0.0, 9.0),
}
#: First and last code points of the scripts that have bands.
SCRIPTS = {"Latin": ((0x41, 0x24F),), "Greek": ((0x370, 0x3FF),), "Cyrillic": ((0x400, 0x52F),), "Han": ((0x3040, 0x30FF), (0x3400, 0x9FFF))}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens")


class WordTokens:
    """Token ids of words under a sentencepiece vocabulary."""

    def __init__(self, vocabulary: str, remembered: int = 250_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.size, self.remembered = self.model.vocab_size(), remembered
        self.is_byte = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(self.size)])
        self.known: dict[str, bytes] = {}

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Ids of all words of each text."""
        if len(self.known) > self.remembered:
            self.known = dict(islice(self.known.items(), self.remembered // 2))
        known = self.known
        new = list(set(chain.from_iterable(texts)).difference(known))
        known.update(zip(new, [np.array(x, "<u4").tobytes() for x in self.model.encode(new, num_threads=1)] if new else (), strict=True))
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<u4") for words in texts]


@lru_cache(maxsize=2)
def word_tokens(vocabulary: str) -> WordTokens:
    """One table for all tasks of a worker process."""
    return WordTokens(vocabulary)


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return n


def repeated_words(words: list[str]) -> int:
    """Words that stand in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    base = len(number)
    if base < 2_000_000:
        keys = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        _, pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)
        keys = pairs[:-1] * base + ids[2:]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(np.count_nonzero(covered))


def token_entropy(ids: np.ndarray, size: int) -> float:
    """In bits, corrected for the bias of small counts."""
    if not len(ids):
        return 0.0
    counts = np.bincount(ids, minlength=size)
    counts = counts[counts > 0]
    p = counts / len(ids)
    return float(-(p * np.log2(p)).sum() + (len(counts) - 1) / (2 * len(ids) * math.log(2)))


def script_of(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    best, most = "default", 0
    for name, ranges in SCRIPTS.items():
        n = sum(int(np.count_nonzero((points >= a) & (points <= b))) for a, b in ranges)
        if n > most:
            best, most = name, n
    return best


def in_band(band: tuple, chars: int, tokens: int, byte_tokens: int, entropy: float, least_tokens: int) -> bool:
    if tokens < least_tokens:
        return True
    least, most, byte_share, least_entropy, chars_slack, entropy_slack = band
    root = math.sqrt(tokens)
    return least - chars_slack / root <= chars / tokens <= most and byte_tokens <= byte_share * tokens and entropy >= least_entropy - entropy_slack / root


def _measure(vocabulary: str, bands: dict, least_words: int, most_repeated: int, least_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary)
        for batch in batches:
            for i, j in slices(len(batch)):
                part = batch.slice(i, j - i)
                texts, langs = [t or "" for t in part["text"].to_pylist()], part["lang"].to_pylist()
                words = [_WORD.findall(t) for t in texts]
                rows = []
                for text, own, ids, lang in zip(texts, words, tokens.of(words), langs, strict=True):
                    chars, n = sum(map(len, own)), len(own)
                    repeated, byte_tokens, entropy = repeated_words(own), int(np.count_nonzero(tokens.is_byte[ids])), token_entropy(ids, tokens.size)
                    failed = n < least_words or 100 * repeated > most_repeated * n
                    band = bands.get(lang) or bands.get(script_of(text)) or bands["default"]
                    kept = not failed and in_band(band, chars, len(ids), byte_tokens, entropy, least_tokens)
                    rows.append((n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, len(ids), byte_tokens, entropy, failed, kept))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 7 + [pa.float64(), pa.bool_(), pa.bool_()], strict=True)]
                figures = pa.StructArray.from_arrays(columns, [*MEASURES, "token_entropy", "base_failed", "kept"])
                yield pa.RecordBatch.from_arrays([part["row"], figures], ["row", "figures"])

    return run


def measure_quality(docs: DataFrame, vocabulary: str, keep: list[str] | None = None, text_col: str = "text", lang_col: str | None = "lang", bands: dict | None = None, least_words: int = 50, most_repeated: int = 50, least_tokens: int = 50, into: str = "quality") -> DataFrame:
    """The columns ``keep`` of docs (all by default) and as last column a struct of the measures, base_failed and
    kept (false if base_failed, else by the bands).  It is named ``into``, with underscores behind where
    that name is among those kept."""
    keep = docs.columns if keep is None else keep
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in keep]
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    picked = docs.select(F.struct(*quoted).alias("row"), F.col(text_col).alias("text"), lang.alias("lang"))
    figures = ", ".join([f"{m}: bigint" for m in MEASURES] + ["token_entropy: double", "base_failed: boolean", "kept: boolean"])
    done = picked.mapInArrow(_measure(vocabulary, bands or BANDS, least_words, most_repeated, least_tokens), f"row {picked.schema['row'].dataType.simpleString()}, figures struct<{figures}>")
    return done.select("row.*", F.col("figures").alias(fresh(into, keep)))


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    measured = measure_quality(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"]).select("doc_id", "quality.*")
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "n_byte_tokens", F.round("token_entropy", 6).alias("token_entropy"))
