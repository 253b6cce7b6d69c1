"""Packing along a space-filling curve.

Every document becomes token ids plus an end id.  Its hashed bag of ids is projected to three dimensions, the
point gets a Hilbert key, the corpus is range-sorted by (key, doc_id), and each range partition lays its
documents end to end and cuts the stream every ``length`` ids.  The rest of a partition's stream is cut into
powers of two, so no sequence holds padding at all.

Defined results: a null or empty text is the end id alone; rows with a null doc_id are packed and keep the null;
repeated rows are packed each; ties of the key follow doc_id; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import in_slices, partitions, settle, table

DIMS, BITS, BUCKETS = 3, 16, 256
#: Ids of a range on the average, two bytes each: the number of ranges grows with the corpus, a task's share doesn't.
RANGE_IDS = 1 << 24
#: Fixed value: the marker that the vocabulary's tokenizer reads as one id wherever a text holds it.
MARKERS = {"<|endoftext|>": 50256}
_ENCODERS: dict[str, object] = {}


def byte_bpe(ranks_file: str):
    """The byte-level BPE by its rank file: the ids are those of the tokenizers file of the same vocabulary (tested), at a third of the time."""
    if ranks_file not in _ENCODERS:
        import tiktoken

        with open(public_tokenizers.path(ranks_file), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[ranks_file] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=MARKERS)
    return _ENCODERS[ranks_file]


def ids_of(encoder, text: str) -> list[int]:
    """The ids that the tokenizers library gives without added tokens: literal markers are one id each."""
    return encoder.encode(text, allowed_special="all") if any(m in text for m in MARKERS) else encoder.encode_ordinary(text)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n, dims) by Gray-code unfolding of the transposed index."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    top = np.int64(1) << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection(seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))


def points_of(vectors: np.ndarray, project: np.ndarray) -> np.ndarray:
    """Grid points of hashed count vectors: damped, scaled to unit length, projected, squashed to the grid."""
    damped = np.log1p(vectors)
    norm = np.linalg.norm(damped, axis=1, keepdims=True)
    flat = (damped / np.where(norm == 0, 1, norm)) @ project
    return ((1 / (1 + np.exp(-1.7 * flat))) * ((1 << BITS) - 1)).astype(np.int64)


def tokenised(docs: DataFrame, ranks_file: str = "byte_bpe_50k.tiktoken", end_id: int = 0) -> DataFrame:
    """doc_id, key (Hilbert), n_tokens, ids (little-endian unsigned 16-bit, the end id included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, project = byte_bpe(ranks_file), projection()
        for batch in in_slices(batches, "text"):
            ids = [np.array([*ids_of(encoder, t or ""), end_id], np.uint16) for t in batch.column("text").to_pylist()]
            hashed = np.stack([np.bincount((x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS) for x in ids])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(hilbert_keys(points_of(hashed, project))), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["doc_id", "key", "n_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, key long, n_tokens long, ids binary")


def _cut(total: int, length: int) -> list[int]:
    """A tail of ``total`` ids as powers of two, largest first."""
    return [1 << b for b in range(length.bit_length(), -1, -1) if total >> b & 1]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, hilbert_key long"


def pack(tokens: DataFrame, length: int = 1024) -> DataFrame:
    """Pieces of the rows of ``tokenised``; each range partition packs its own stretch of the curve."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        held: list[list] = []  # pieces of the sequence that isn't full: doc, start, ids, doc's tokens, key
        room = length

        def rows(pieces: list[list], sequence: int) -> list[tuple]:
            out, offset = [], 0
            for doc, start, ids, total, key in pieces:
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, key))
                offset += len(ids)
            return out

        def table_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], names=names)

        for batch in batches:
            done: list[tuple] = []
            for doc, key, total, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "n_tokens", "ids"))):
                ids, start = np.frombuffer(raw, np.uint16), 0
                while start < total:
                    part = ids[start : start + room]
                    held.append([doc, start, part, total, key])
                    start, room = start + len(part), room - len(part)
                    if not room:
                        done += rows(held, sequence)
                        held, room, sequence = [], length, sequence + 1
            if done:
                yield table_of(done)
        done = []
        for size in _cut(length - room, length):
            own: list[list] = []
            while size:
                doc, start, ids, total, key = held[0]
                take = min(size, len(ids))
                own.append([doc, start, ids[:take], total, key])
                size -= take
                if take == len(ids):
                    held.pop(0)
                else:
                    held[0] = [doc, start + take, ids[take:], total, key]
            done += rows(own, sequence)
            sequence += 1
        if done:
            yield table_of(done)

    ids = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    along = tokens.repartitionByRange(max(partitions(tokens.sparkSession), -(-ids // RANGE_IDS)), "key", "doc_id").sortWithinPartitions("key", "doc_id", "n_tokens", "ids")
    return along.mapInArrow(run, PIECES)


def packed(docs: DataFrame, length: int = 1024) -> DataFrame:
    """The operator.  Token ids are written once, as range bounds are sampled from the keys before the rows move."""
    return pack(settle(tokenised(docs), "packing-ids"), length)


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
