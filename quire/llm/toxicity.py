"""Toxicity by compression distance: two zstandard dictionaries, one per kind of text.

Learning takes a bounded sample of labelled rows outside the test fold: at most ``max_toxic`` toxic and
``max_ordinary`` other documents, those with the least hash, and at most ``max_bytes`` of either.

* Samples for the dictionaries are short pieces of real text.  zstandard's trainer keeps what is frequent, and
  most of a toxic text is ordinary; so the toxic samples are the words around byte strings (5 to 9 bytes,
  within a word and its blanks) that stand in more toxic documents, or twice in more of them, than chance
  allows: log-likelihood ratio of at least ``surprise`` against the common share.  Strings and matches of six
  bytes catch inflected forms that no list of words would.  The ordinary samples are all words.
* zstandard trains a dictionary of each.  One compressor has the ordinary dictionary, the other the ordinary and the
  toxic one: what both know cancels out.  A window's gain is the bytes that the second saves.
* Windows are runs of one and of three words in lower case, over the whole text.  A run of three words none of which
  gains by itself has no gain; only the others are compressed.  zstandard neither looks for
  matches in the last bytes of its input nor keeps a block that it can't shorten by some bytes, so a
  window stands between two paddings that both dictionaries end with.
* A document's evidence, for either length of windows: the greatest gain, and for each threshold the logarithm of
  the number of windows with such a gain, and their share.  A logistic function of it is the score.  It is fitted
  across folds: a third of the learning rows gets its evidence from dictionaries of the other two; the final
  dictionaries come from all.  Its constant is corrected for the rates at which toxic and other rows were sampled,
  so that a score means the same with and without the bounds.

Whole texts are scored; labels, lang, source and ids are never inputs of a score.

Defined results: null text is empty; empty text has one empty window and gets the score of no
evidence; a null id is not held out and not learnt from; several labels of a document count as
toxic if one is; repeated rows are learnt from once; labels without a document and null labels are not used; with fewer
than four toxic or four ordinary rows to learn from the score is the known share of toxic rows (0 with no
labels); rows are independent; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, Workspace, table
from .pieces import slices

_WORD, _LOWER = re.compile(WORD.encode()), bytes.maketrans(UPPER.encode(), LOWER.encode())
#: (words of a window, words from one to the next).
WINDOWS = ((1, 1), (3, 2))
#: Thresholds of a window's gain, in bytes.
GAINS = (3, 4, 5, 6, 8)
#: What stands before and behind a window, and at the end of both dictionaries.
HEAD, TAIL = b"\n" * 16, bytes(range(1, 17))
FOLDS = 3
GRAMS = (5, 6, 7, 8, 9)


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))  # no blank or capital is a part of a longer character


def window(words: list[bytes]) -> bytes:
    return HEAD + b" " + b" ".join(words) + b" " + TAIL


def train_dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """By zstandard's trainer, in segments of the given length; where samples are too few for it, their bytes."""
    import zstandard

    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=segment, d=6, level=3).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b"".join(dict.fromkeys(samples))[-(1 << 16) :]


class Gains:
    """Bytes that a window's compression saves with the toxic dictionary beside the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes, remembered: int = 500_000):
        import zstandard

        # Lazy search in binary trees for matches of six bytes or more; the other lazy strategies miss matches in large dictionaries.
        parameters = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=6, min_match=6, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_checksum=False, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.by = []
        for content in (ordinary + HEAD + TAIL, ordinary + toxic + HEAD + TAIL):
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=parameters)
            self.by.append(zstandard.ZstdCompressor(dict_data=own, compression_params=parameters))
        self.known: dict[bytes, int] = {}
        self.remembered = remembered

    def of(self, windows: list[bytes]) -> np.ndarray:
        lengths = []
        for c in self.by:
            if hasattr(c, "multi_compress_to_buffer"):
                done = c.multi_compress_to_buffer(windows, threads=1)
                lengths.append(np.fromiter(map(len, done), np.int64, len(windows)))
            else:
                lengths.append(np.array([len(c.compress(w)) for w in windows], np.int64))
        return lengths[0] - lengths[1]

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """Gains of single words, which repeat much: a bounded table holds those that came before."""
        if len(self.known) > self.remembered:  # words met first are mostly the frequent ones; they stay
            self.known = dict(islice(self.known.items(), self.remembered // 2))
        new = list(set(words).difference(self.known))
        if new:
            self.known.update(zip(new, self.of([window([w]) for w in new]).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def evidence(self, text: str) -> list[float]:
        words, out = words_of(text) or [b""], []
        single = self.of_words(words)
        for n, step in WINDOWS:
            if n == 1:
                gains = single
            else:
                starts = np.arange(0, max(1, len(words) - n + step), step)
                before = np.concatenate([[0], np.cumsum(single > 0)])
                near = starts[before[np.minimum(starts + n, len(words))] > before[starts]]
                gains = np.zeros(len(starts), np.int64)
                if len(near):
                    gains[near // step] = self.of([window(words[i : i + n]) for i in near.tolist()])
            out.append(float(max(0, gains.max())))
            for least in GAINS:
                hits = int(np.count_nonzero(gains >= least))
                out += [float(np.log1p(hits)), hits / len(gains)]
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method; the constant is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def apart(texts: list[str]) -> list[str]:
    """texts without near copies of earlier ones, which would make all their strings look frequent.  A text is a
    near copy if half of its 8 words with the least hashes are among those of one earlier text."""
    held: dict[int, int] = {}
    out = []
    for i, t in enumerate(texts):
        least = sorted({zlib.crc32(w) for w in set(words_of(t))})[:8]
        earlier = Counter(held[h] for h in least if h in held)
        if earlier and 2 * max(earlier.values()) >= len(least):
            continue
        held.update((h, i) for h in least if h not in held)
        out.append(t)
    return out


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its word) of every string of the lengths GRAMS in the text, blanks around words included."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    blank = np.cumsum(data == 32)
    hashes, places = [], []
    for k in GRAMS:
        n = len(data) - k + 1
        if n < 1:
            continue
        own = np.full(n, k, np.uint64)
        for i in range(k):
            own = own * np.uint64(0x100000001B3) + data[i : i + n]
        own ^= own >> np.uint64(29)
        inner = blank[k - 2 : k - 2 + n] == blank[:n]  # no blank but at the first or last place
        hashes.append(own[inner])
        places.append(blank[np.flatnonzero(inner) + 1] - 1)
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def candidates(texts: list[str], least: int = 3, together: int = 200) -> np.ndarray:
    """Hashes of the strings in at least that many of the texts, ascending."""
    known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in range(0, len(texts), together):
        part, n = np.unique(np.concatenate([np.unique(grams_of(words_of(t))[0]) for t in texts[i : i + together]]), return_counts=True)
        every, place = np.unique(np.concatenate([known, part]), return_inverse=True)
        known, counts = every, np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
    return known[counts >= least]


def document_counts(texts: list[str], strings: np.ndarray) -> np.ndarray:
    """[fold, once or twice, string]: how many texts of each fold have each string, and have it twice or more."""
    out = np.zeros((FOLDS, 2, len(strings)), np.int64)
    for i, t in enumerate(texts):
        own, n = np.unique(grams_of(words_of(t))[0], return_counts=True)
        at = np.searchsorted(strings, own)
        mine = (at < len(strings)) & (strings[np.minimum(at, len(strings) - 1)] == own) if len(strings) else np.zeros(len(own), bool)
        out[i % FOLDS, 0, at[mine]] += 1
        out[i % FOLDS, 1, at[mine & (n > 1)]] += 1
    return out


def over_represented(a: np.ndarray, p: int, b: np.ndarray, q: int, surprise: float = 20.0, ratio: float = 8.0) -> np.ndarray:
    """Where a of p toxic and b of q ordinary documents are more than chance allows."""
    share = (a + b) / (p + q)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(a > 0, a * np.log(a / (share * p)), 0.0) + np.where(b > 0, b * np.log(b / (share * q)), 0.0))
    return (g >= surprise) & (a * q >= ratio * b * p)


def dictionaries(toxic: list[str], ordinary: list[str], marked: np.ndarray, size: int, toxic_size: int, samples: int = 300_000) -> tuple[bytes, bytes]:
    """(ordinary, toxic) from words of these texts, in an order that depends on them only."""
    plain = [b" " + w + b" " for t in ordinary for w in words_of(t)]
    random.Random(len(plain)).shuffle(plain)
    own = []
    for t in toxic:
        words = words_of(t)
        hashes, places = grams_of(words)
        own += [b" " + words[i] + b" " for i in np.unique(places[np.isin(hashes, marked)])]
    return train_dictionary(plain[:samples], size, 64), train_dictionary(own, toxic_size, 256)


def learn(toxic: list[str], ordinary: list[str], shares: tuple[float, float] = (1.0, 1.0), size: int = 200_000, toxic_size: int = 32_768) -> dict:
    """The model from texts of both kinds (in an order that doesn't depend on them); shares: which part of the
    toxic and of the ordinary rows they are."""
    known = len(toxic) / shares[0] + len(ordinary) / shares[1]
    if len(toxic) < 4 or len(ordinary) < 4:
        return {"share": len(toxic) / shares[0] / known if known else 0.0}
    distinct = [apart(texts) for texts in (toxic, ordinary)]
    strings = candidates(distinct[0])
    a, b = (document_counts(texts, strings) for texts in distinct)
    p, q = (np.array([len(texts[f::FOLDS]) for f in range(FOLDS)]) for texts in distinct)
    x, y = [], []
    for f in range(FOLDS + 1):  # the last: from all
        use = [g for g in range(FOLDS) if g != f]
        marked = np.zeros(len(strings), bool)
        for times in (0, 1):
            marked |= over_represented(a[use, times].sum(axis=0), int(p[use].sum()), b[use, times].sum(axis=0), int(q[use].sum()))
        pair = dictionaries(*([t for i, t in enumerate(texts) if i % FOLDS != f] for texts in distinct), strings[marked], size, toxic_size)
        if f < FOLDS:
            gains = Gains(*pair)
            held = [set(texts) - {t for i, t in enumerate(texts) if i % FOLDS != f} for texts in distinct]
            for label, texts, own in ((1.0, toxic, held[0]), (0.0, ordinary, held[1])):
                for t in texts:
                    if t in own:
                        x.append(gains.evidence(t))
                        y.append(label)
    x, y = np.array(x), np.array(y)
    scale = np.maximum(x.std(axis=0), 1e-6)
    weights = fit_logistic(x / scale, y)
    weights[-1] += np.log(shares[1] / shares[0])
    return {"dictionaries": pair, "scale": scale.tolist(), "weights": weights.tolist()}


@lru_cache(maxsize=2)
def _gains(ordinary: bytes, toxic: bytes) -> Gains:
    """One for all tasks of a worker process."""
    return Gains(ordinary, toxic)


def scores_of(model: dict, texts: list[str]) -> np.ndarray:
    if "share" in model:
        return np.full(len(texts), model["share"])
    gains, w = _gains(*model["dictionaries"]), np.array(model["weights"])
    x = np.array([gains.evidence(t) for t in texts]) / np.array(model["scale"])
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(len(batch)):
                part = batch.slice(i, j - i)
                scores = scores_of(model, [t or "" for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def held_out(id_col):
    """Rows of the test fold: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: tuple[int, int], most_bytes: int) -> list[tuple[list[str], float]]:
    """For ordinary and for toxic documents outside the test fold: (texts, which part of all such documents they are).
    At most ``most`` of each, by the least hash of id and text, and at most most_bytes of text.

    Numbers come first: hashes and lengths of labelled rows, of which the least are chosen; then texts of the chosen alone."""
    known = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    ranked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("rank"), "text")
    with Workspace(docs.sparkSession, "toxicity") as work:
        numbers = ranked.select("doc_id", "rank", F.octet_length("text").alias("bytes")).join(known, "doc_id").distinct()  # repeated rows once
        numbers = work.stash(numbers, "numbers")
        totals = {r["toxic"]: r["n"] for r in numbers.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        chosen = {}
        for kind in (0, 1):
            used = 0
            for r in numbers.filter(F.col("toxic") == kind).orderBy("rank", "doc_id").limit(most[kind]).collect():
                if used + r["bytes"] <= most_bytes:
                    chosen[r["doc_id"], r["rank"]] = kind
                    used += r["bytes"]
        texts = {}
        if chosen:
            wanted = docs.sparkSession.createDataFrame(list(chosen), numbers.select("doc_id", "rank").schema)
            found = ranked.join(F.broadcast(wanted), ["doc_id", "rank"]).groupBy("doc_id", "rank").agg(F.first("text").alias("text"))  # two numbers of sum(most) rows are broadcast
            texts = {(r["rank"], r["doc_id"]): r["text"] for r in found.collect()}
    out = []
    for kind in (0, 1):
        own = [texts[k] for k in sorted(texts) if chosen[k[1], k[0]] == kind]
        out.append((own, len(own) / totals[kind] if own else 1.0))
    return out


def fitted(docs: DataFrame, labels: DataFrame, max_toxic: int = 3000, max_ordinary: int = 6000, max_bytes: int = 1 << 25) -> dict:
    """The model; docs: (doc_id, text)."""
    (ordinary, b), (toxic, a) = sample(docs, labels, (max_ordinary, max_toxic), max_bytes)
    return learn(toxic, ordinary, (a, b))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """(doc_id, held_out, score) for every row of docs.  bounds: max_toxic, max_ordinary and max_bytes of the rows to learn from."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fitted(picked, labels, **bounds)
    kind = dict(picked.dtypes)["doc_id"]
    return picked.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "text").mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
