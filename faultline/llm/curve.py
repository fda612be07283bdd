"""Packing along a space-filling curve: similar documents share a sequence and nothing but the last few places is cut off.

Each document's ids are hashed into a signed vector, the vector is projected to ``DIMS`` coordinates by a fixed sign matrix,
and the cell of a fixed grid it falls into gives its key on the Hilbert curve. Documents are range-sorted by that key and
laid end to end; sequences are the stretches of ``capacity`` ids of that line. What is left at its end is cut into
stretches whose lengths are powers of two, the largest first. Ids travel once, with the range sort; the line's positions
come from running sums inside range partitions and one number for each partition.
"""
from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from faultline.llm import common
from faultline.llm.tokens import VISIBLE, ALPHABET
from faultline.session import cut_lineage

CAPACITY, END_ID = 2048, 1
BUCKETS, DIMS, BITS = 256, 4, 12       # hashed vector, projected coordinates, bits of the grid in each
SPREAD = 6.0                           # coordinates of unit vectors are squeezed by tanh(SPREAD * x) before they meet the grid
#: Fixed value: the pre-tokens of the byte-level tokenizer's file, with possessive repeats.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class ByteEncoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library; special tokens' strings are ordinary text.

    Where every merge of the file makes the token of the next id, merging by rank of the result is the same as merging by
    rank of the pair, and the faster rank encoder is used; other files are encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, steps = file["model"], file.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        plain = (file.get("normalizer") is None and steps.get("type") == "ByteLevel" and steps.get("use_regex", True)
                 and not steps.get("add_prefix_space") and not model.get("ignore_merges"))
        if plain and len(vocab) == 256 + len(merges) and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            import tiktoken

            byte = {chr(b): b for b in VISIBLE} | {chr(c): b for b, c in ALPHABET.items()}
            ranks = {bytes(map(byte.__getitem__, k)): i for k, i in vocab.items()}
            self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        size = max(vocab.values(), default=0) + 1
        self.stored = "<u2" if max(size, END_ID + 1) <= 1 << 16 else "<u4"
        mixed = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        self.bucket = (mixed >> np.uint64(56)).astype(np.int64) % BUCKETS
        self.sign = 1.0 - 2.0 * ((mixed >> np.uint64(40)) & np.uint64(1)).astype(np.float64)


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def projection() -> np.ndarray:
    """The fixed (BUCKETS, DIMS) sign matrix: Hadamard rows, so that coordinates are uncorrelated."""
    rows, cols = np.arange(BUCKETS)[:, None], np.array([0x5B, 0xA7, 0x3D, 0xE6, 0x99, 0xC3, 0x75, 0x2E])[None, :DIMS]
    ones = np.zeros((BUCKETS, DIMS), np.int64)
    for j in range(8):
        ones += (rows >> j) & (cols >> j) & 1
    return 1.0 - 2.0 * (ones & 1)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys on the Hilbert curve of integer cells ``(rows, dims)`` of ``bits`` bits each; ``bits * dims`` is at most 63.

    From the highest bit down, each coordinate's bit says whether the sub-cube is mirrored or has two axes swapped; the
    bits that remain are a Gray code of the key.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        top, below = np.int64(1) << level, (np.int64(1) << level) - 1
        for d in range(dims):
            mirrored = (x[d] & top) != 0
            swap = np.where(mirrored, 0, (x[0] ^ x[d]) & below)
            x[0] = np.where(mirrored, x[0] ^ below, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (np.int64(1) << level), (np.int64(1) << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def keys(vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of hashed vectors ``(rows, BUCKETS)``; counts are damped and lengths evened out first."""
    damped = np.sign(vectors) * np.log1p(np.abs(vectors))
    norm = np.sqrt((damped * damped).sum(1, keepdims=True))
    at = (damped / np.where(norm > 0, norm, 1)) @ projection()
    cells = np.minimum((np.tanh(SPREAD / BUCKETS ** 0.5 * at) + 1) / 2 * (1 << BITS), (1 << BITS) - 1)
    return hilbert(cells.astype(np.int64), BITS)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, row, key, length, ids)`` of each row: ids with the end id (as stored), and the key of its hashed vector."""
    path = path or default_path()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        e, made = encoder(path), TaskContext.get().partitionId() << 33
        for b in batches:
            ids = [np.array([*e.encode(t), END_ID], np.int64) for t in b["text"]]
            vectors = np.stack([np.bincount(e.bucket[x], e.sign[x], BUCKETS) for x in ids]) if ids else np.zeros((0, BUCKETS))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "row": np.arange(made, made + len(b)), "key": keys(vectors),
                                "length": [len(x) for x in ids], "ids": [x.astype(e.stored).tobytes() for x in ids]})
            made += len(b)

    common.small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return read.mapInPandas(encode, "doc_id long, row long, key long, length long, ids binary")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``, a row for each piece of each document.

    Each sequence has ``capacity`` ids, but for fewer than log2(capacity) + 1 last ones, whose lengths are different powers
    of two. A document is cut only where a sequence ends. Null texts count as empty and have the end id alone; a null
    doc_id is one like any other; repeated rows are packed each for itself. Documents with one key are ordered by doc_id, so
    a key that many rows share is dealt over range partitions like any others. Other columns are not read; an empty table
    gives an empty result. ``ids`` holds little-endian unsigned 32-bit ids.
    """
    n = common.parallelism(docs.sparkSession)
    path = path or default_path()
    order = ["key", "doc_id", "row"]
    ranged = cut_lineage(encoded(docs, path)).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)

    def line(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for b in batches:
            upto = at + b["length"].to_numpy().cumsum()
            b["at"] = upto - b["length"].to_numpy()
            at = int(upto[-1]) if len(upto) else at
            yield b[["part", "at", "doc_id", "length", "ids"]].astype({"doc_id": "Int64"})

    laid = cut_lineage(ranged.select("part", "doc_id", "length", "ids").mapInPandas(line, "part int, at long, doc_id long, length long, ids binary"))
    sums = dict(laid.groupBy("part").agg(F.sum("length")).collect())            # a number for each range partition
    before, total = {}, 0
    for part in sorted(sums):
        before[part], total = total, total + sums[part]
    tail = total // capacity * capacity
    starts = [tail]                                                  # where the shorter sequences start
    for j in range(capacity.bit_length(), -1, -1):
        if (total - tail) >> j & 1:
            starts.append(starts[-1] + (1 << j))

    def bounds(lo: int, hi: int) -> list[int]:
        inner = range((lo // capacity + 1) * capacity, min(hi, tail + 1), capacity)
        return [lo, *sorted({*inner, *(s for s in starts[1:-1] if lo < s < hi)}), hi]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stored = encoder(path).stored
        for b in batches:
            rows = []
            for part, at, doc_id, length, ids in zip(b["part"], b["at"], b["doc_id"], b["length"], b["ids"], strict=True):
                ids, lo = np.frombuffer(ids, stored).astype("<u4"), before[part] + at
                marks = bounds(lo, lo + length)
                for a, z in zip(marks, marks[1:]):
                    if a < tail:
                        seq, first = a // capacity, a // capacity * capacity
                    else:
                        k = int(np.searchsorted(starts, a, side="right")) - 1
                        seq, first = tail // capacity + k, starts[k]
                    piece = ids[a - lo:z - lo].tobytes()
                    rows.append((doc_id, a - lo, z - a, zlib.crc32(piece), length, seq, a - first, piece)[:8 if with_ids else 7])
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][:8 if with_ids else 7]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return laid.mapInPandas(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
                            + (", ids binary" if with_ids else ""))
