"""Token ids as canonical length-limited Huffman files.

Format of one file (little-endian):

* ``QHUF1\\n`` and two bytes of zero;
* blocks of at most ``block_tokens`` ids, each a bit stream (most significant bit first within
  32-bit words) padded to whole words; a block needs nothing of another block;
* footer: a NumPy ``npz`` with ``block_at`` (byte offset), ``block_words``, ``block_tokens``,
  ``check_bits`` (for every ``every`` ids of a block the bit offset within it), ``every``,
  ``doc_ids``, ``doc_null``, ``doc_tokens``;
* eight bytes: length of the footer; ``QHUF1\\n`` and two bytes of zero again.

The codebook (``codebook.npz`` beside the files) holds the code length of each id; canonical
codes follow from the lengths.  Lengths come from counts over the whole corpus by package-merge,
so no code passes ``limit`` bits and one table of 2**limit entries decodes.  All checkpoints of
some blocks are decoded abreast: one gather a step instead of one a bit.

Steps: (1) documents are range-partitioned and sorted by id and encoded once, the ids kept in
the shared folder; (2) partial histograms are summed, a row per id of the vocabulary reaches the
driver; (3) a task writes one file for each run of documents it has; (4) files are read back.
A file has its final name only when complete, and a repeated task writes the same bytes.

Defined results: null or empty text is the end id alone; null doc_id sorts last; rows that share
a doc_id follow each other by text; an empty table gives no files and no rows.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, release, shuffle_width, stash, table
from .pieces import piece_encoder, text_slices

MAGIC = b"QHUF1\n\0\0"


# ---------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge); 0 where the count is 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, row, is_leaf = [], leaves, np.ones(len(leaves), bool)
    for _ in range(limit):
        levels.append(is_leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by_weight = np.argsort(both, kind="stable")
        row, is_leaf = both[by_weight], by_weight < len(leaves)
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(np.count_nonzero(is_leaf[:take]))
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes that ascend by length, then id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    sorted_lengths = lengths[order].astype(np.uint64)
    top = int(sorted_lengths[-1]) if len(order) else 0
    step = np.uint64(1) << (np.uint64(top) - sorted_lengths)
    starts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(step)[:-1].astype(np.uint64)]) if len(order) else step
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = starts >> (np.uint64(top) - sorted_lengths)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, length) for each value of the next ``bits`` bits."""
    bits = int(lengths.max(initial=1))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (bits - lengths[order].astype(np.int64))
    symbol, length = np.zeros(1 << bits, np.int32), np.ones(1 << bits, np.int64)
    filled = int(spans.sum())
    symbol[:filled], length[:filled] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbol, length, bits


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's 32-bit words, and the bit offset of each checkpoint."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    words = np.zeros(int(ends[-1] + 31) // 32 + 2, np.uint64)
    first = at >> 5
    wide = codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    sums = np.bitwise_or.reduceat(wide, starts)
    place = first[starts]
    words[place] |= sums >> np.uint64(32)
    words[place + 1] |= sums & np.uint64(0xFFFFFFFF)
    return words[: int(ends[-1] + 31) // 32].astype("<u4"), at[::every].astype("<u4")


def decode_lanes(words: np.ndarray, bits_at: np.ndarray, counts: np.ndarray, decoder: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """counts[i] ids from each bit offset, all lanes abreast; lanes are in order of position."""
    symbol, length, bits = decoder
    padded = np.concatenate([words, np.zeros(3, np.uint32)]).astype(np.uint64)
    pairs = (padded[:-1] << np.uint64(32)) | padded[1:]
    at, out = bits_at.astype(np.int64), np.zeros((int(counts.max(initial=0)), len(counts)), np.int32)
    shift, mask = 64 - bits, np.uint64((1 << bits) - 1)
    last = len(pairs) - 1
    for step in range(len(out)):
        window = (pairs[np.minimum(at >> 5, last)] >> (shift - (at & 31)).astype(np.uint64)) & mask
        out[step] = symbol[window]
        at += length[window]
    return out.T[np.arange(len(out)) < counts[:, None]]


# ---------------------------------------------------------------- files


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """One file; ids come in any portions."""

    def __init__(self, uri: str, codes: np.ndarray, lengths: np.ndarray, block_tokens: int, every: int):
        self.fs, self.path = _open(uri)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.at, self.codes, self.lengths, self.size, self.every = len(MAGIC), codes, lengths, block_tokens, every
        self.pending, self.waiting, self.tokens = [], 0, 0
        self.blocks, self.checks, self.docs = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.pending.append(ids)
        self.waiting += len(ids)
        self.tokens += len(ids)
        if self.waiting >= 4 * self.size:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.int64)
        end = len(ids) if last else len(ids) // self.size * self.size
        for i in range(0, end, self.size):
            part = ids[i : min(end, i + self.size)]
            words, checks = encode_block(part, self.codes, self.lengths, self.every)
            self.blocks.append((self.at, len(words), len(part)))
            self.checks.append(checks)
            self.out.write(words.tobytes())
            self.at += 4 * len(words)
        self.pending, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> tuple[int, int]:
        """(documents, ids) in the file, which now has its name."""
        self._flush(True)
        at, words, tokens = np.array(self.blocks, np.int64).reshape(-1, 3).T
        ids = np.array([d or 0 for d, _ in self.docs], np.int64)
        buffer = io.BytesIO()
        np.savez(buffer, block_at=at, block_words=words, block_tokens=tokens, check_bits=np.concatenate([np.zeros(0, "<u4"), *self.checks]), every=np.int64(self.every), doc_ids=ids, doc_null=np.array([d is None for d, _ in self.docs], bool), doc_tokens=np.array([n for _, n in self.docs], np.int64))
        footer = buffer.getvalue()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return len(self.docs), self.tokens


class FileReader:
    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"not a finished file: {uri}")
        n = int.from_bytes(tail[:8], "little")
        footer = np.load(io.BytesIO(self.file.read_at(n, size - 16 - n)))
        self.__dict__.update({k: footer[k] for k in footer.files})
        lanes = -(-self.block_tokens // self.every)
        self.first_lane = np.concatenate([[0], np.cumsum(lanes)]).astype(np.int64)

    def ids(self, decoder, abreast: int = 8) -> Iterator[np.ndarray]:
        """Ids in order, some blocks at a time; any block can be decoded alone."""
        every = int(self.every)
        for b in range(0, len(self.block_at), abreast):
            e = min(len(self.block_at), b + abreast)
            words = np.frombuffer(self.file.read_at(int(4 * self.block_words[b:e].sum()), int(self.block_at[b])), "<u4")
            lanes = np.diff(self.first_lane[b : e + 1])
            word_at = np.concatenate([[0], np.cumsum(self.block_words[b:e])[:-1]])
            bits_at = self.check_bits[self.first_lane[b] : self.first_lane[e]].astype(np.int64) + np.repeat(word_at * 32, lanes)
            counts = np.full(len(bits_at), every, np.int64)
            counts[np.cumsum(lanes) - 1] = self.block_tokens[b:e] - (lanes - 1) * every
            yield decode_lanes(words, bits_at, counts, decoder)


# ---------------------------------------------------------------- the operator


def _tokenize(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seq, end = piece_encoder(vocabulary, "<u2"), TaskContext.get().partitionId(), 0, np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for i, j in text_slices(batch["text"]):
                ids = encoder.encode_column(batch["text"][i:j], end).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, part, np.int32)), pa.array(np.arange(seq, seq + j - i)), batch["doc_id"][i:j], ids], ["part", "seq", "doc_id", "ids"])
                seq += j - i

    return run


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        total += np.bincount(np.frombuffer(b"".join(batch["ids"].to_pylist()), "<u2"), minlength=1 << 16)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])


def _write_files(folder: str, lengths: np.ndarray, block_tokens: int, every: int, file_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, made, writer, now = canonical_codes(lengths), [], None, (-1, -1)

        def close() -> None:
            made.append((*now, name, *writer.close()))

        for batch in batches:
            for part, seq, doc_id, ids in zip(*(batch[c].to_pylist() for c in ("part", "seq", "doc_id", "ids")), strict=True):
                if writer is None or part != now[0] or writer.tokens >= file_tokens:
                    if writer is not None:
                        close()
                    now, name = (part, seq), f"{part:06d}-{seq:012d}.qhuf"
                    writer = FileWriter(f"{folder}/{name}", codes, lengths, block_tokens, every)
                writer.add(doc_id, np.frombuffer(ids, "<u2").astype(np.int64))
        if writer is not None:
            close()
        columns = list(zip(*made, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[i], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["part", "seq", "file", "docs", "tokens"])

    return run


def _read_files(folder: str, codebook: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                decoder = decoder or decoding_table(read_codebook(codebook))
                reader = FileReader(f"{folder}/{name}")
                tokens, sums, doc, left, crc = reader.doc_tokens, np.zeros(len(reader.doc_ids), np.int64), 0, int(reader.doc_tokens[0]), 0
                for ids in reader.ids(decoder):
                    data, at, n = memoryview(ids.astype("<u4").tobytes()), 0, len(ids)
                    while at < n:
                        take = min(left, n - at)
                        crc = zlib.crc32(data[4 * at : 4 * (at + take)], crc)
                        at, left = at + take, left - take
                        if not left:
                            sums[doc], doc, crc = crc, doc + 1, 0
                            left = int(tokens[doc]) if doc < len(tokens) else -1
                starts = start + np.cumsum(tokens) - tokens
                yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, pa.int64(), mask=reader.doc_null), pa.array(starts, pa.int64()), pa.array(tokens, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_codebook(uri: str, lengths: np.ndarray) -> None:
    fs, path = _open(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    buffer = io.BytesIO()
    np.savez_compressed(buffer, lengths=lengths)
    with fs.open_output_stream(path) as out:
        out.write(buffer.getvalue())


def read_codebook(uri: str) -> np.ndarray:
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        return np.load(io.BytesIO(f.read()))["lengths"]


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", limit: int = 20, block_tokens: int = 1 << 16, every: int = 128, file_tokens: int = 1 << 25) -> DataFrame:
    """Encode docs into files below folder (a URI that all executors reach).

    Returns a row per file: part, seq (their order), file, docs, tokens."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = keyed.repartitionByRange(shuffle_width(spark), F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    encoded = ordered.mapInArrow(_tokenize(vocabulary, end_id), "part int, seq long, doc_id long, ids binary")
    with Workspace(spark, "ids") as work:
        encoded.write.option("compression", "zstd").parquet(work.path("ids"))
        release(spark)
        ids = spark.read.schema(encoded.schema).parquet(work.path("ids"))
        counts = np.zeros(1 << 16, np.int64)
        for r in ids.select("ids").mapInArrow(_histogram, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row per id of the vocabulary at most
            counts[r["id"]] = r["n"]
        lengths = code_lengths(counts, limit)
        write_codebook(f"{folder}/codebook.npz", lengths)
        return stash(ids.mapInArrow(_write_files(folder, lengths, block_tokens, every, file_tokens), "part int, seq long, file string, docs long, tokens long"), f"{folder}/files.parquet")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from the files.  start counts the ids of all documents before."""
    before = F.sum("tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    placed = files.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))
    spread = placed.select("file", "start").repartition(max(1, files.count()))
    return spread.mapInArrow(_read_files(folder, f"{folder}/codebook.npz"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = Workspace(spark, "huffman").result_folder()  # the files stay until the program ends
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(files, folder)
