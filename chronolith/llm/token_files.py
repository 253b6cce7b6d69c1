"""Token ids in Simple-8b blocks.

A file is a run of blocks in ascending doc_id order, rows of one doc_id by their texts' digests; a block holds whole documents, about ``BLOCK_IDS`` ids of
them.  Ids are packed into 64-bit words: a 4-bit selector says how many ids share the other 60 bits.  Ids of 20
bits or more, which are rare in any vocabulary, are written as an escape value and listed after the words.
Every ``STRIDE`` words the block stores how many ids come before, so a reader can start anywhere and decode all
words of one selector at once.

Files travel as rows of a Parquet table in the shared folder (part, block_no, payload), so any store that Spark
writes to can hold them, and its commit protocol keeps whole files when an executor is lost.

Block, little-endian: magic ``S8B1``; u32 documents, ids, words, escapes, offsets; i64 doc_ids (with a u8 null
flag each); u32 counts; u64 words; u32 escapes; u32 offsets.

Defined results: a null or empty text is the end id alone; a null doc_id comes first and keeps the null;
repeated rows are written each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import in_slices, partitions, settle, table
from chronolith.llm.words import TokenCache

#: Selector -> (ids in a word, bits of each).  Fixed by the published code.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = (1 << 20) - 1
BLOCK_IDS, STRIDE, MAGIC = 1 << 16, 128, b"S8B1"
#: Rows of one range of doc_ids.
RANGE_ROWS = 50_000
_CACHES: dict[str, TokenCache] = {}


def word_cache(file: str) -> TokenCache:
    if file not in _CACHES:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        tokenizer.encode_special_tokens = True  # the cache takes markers out of the texts, so words that become one only by folding case stay words
        _CACHES[file] = TokenCache(tokenizer)
    return _CACHES[file]


_WIDTHS = np.zeros(ESCAPE + 1, np.uint8)
for _b in range(20):
    _WIDTHS[1 << _b :] = _b + 1


def simple8b(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, ids before every STRIDE-th word) of values below 2**32."""
    values = values.astype(np.uint64)
    escapes = values[values >= ESCAPE].astype(np.uint32)
    small = np.minimum(values, ESCAPE)
    n = len(small)
    widths = _WIDTHS[small]
    # selector that a word starting at i would take: the first whose ids all fit; a short tail takes the next smaller count
    choice = np.full(n, 15, np.uint8)
    span, top = 1, widths  # top[i]: widest of the span ids from i
    for selector in range(14, -1, -1):  # counts grow, widths shrink
        count, bits = SELECTORS[selector]
        if count > n:
            break
        while 2 * span <= count:
            top = np.maximum(top[: len(top) - span], top[span:])
            span *= 2
        reach = n - count + 1
        fits = np.maximum(top[:reach], top[count - span : count - span + reach]) <= bits
        if not fits.any() and count >= 8:
            if (top > bits).all():
                break  # no longer run can be narrower
            continue
        choice[:reach][fits] = selector
    counts = np.array([c for c, _ in SELECTORS], np.int64)
    step = counts[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts, np.int64)
    picked = choice[at] if n else np.zeros(0, np.uint8)
    words = picked.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(picked):
        count, bits = SELECTORS[selector]
        here = np.flatnonzero(picked == selector)
        if bits:
            for j in range(count):
                words[here] |= small[at[here] + j] << np.uint64(j * bits)
    return words, escapes, at[::STRIDE].astype(np.uint32)


def from_simple8b(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The values: words are decoded a selector at a time."""
    picked = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS], np.int64)[picked]
    at = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint32)
    for selector in np.unique(picked):
        count, bits = SELECTORS[selector]
        here = np.flatnonzero(picked == selector)
        if bits:
            mask = np.uint64((1 << bits) - 1)
            for j in range(count):
                out[at[here] + j] = (words[here] >> np.uint64(j * bits)) & mask
    if len(escapes):
        out[out == ESCAPE] = escapes
    return out


def block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    words, escapes, offsets = simple8b(flat)
    return b"".join(
        [
            MAGIC,
            np.array([len(ids), len(flat), len(words), len(escapes), len(offsets)], "<u4").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([len(x) for x in ids], "<u4").tobytes(),
            words.astype("<u8").tobytes(),
            escapes.astype("<u4").tobytes(),
            offsets.astype("<u4").tobytes(),
        ]
    )


def from_block(payload: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    if payload[:4] != MAGIC:
        raise ValueError("not a token block")
    n_docs, n_ids, n_words, n_escapes, n_offsets = np.frombuffer(payload, "<u4", 5, 4).tolist()
    at, parts = 24, []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u8", n_words), ("<u4", n_escapes), ("<u4", n_offsets)):
        parts.append(np.frombuffer(payload, kind, n, at))
        at += parts[-1].nbytes
    docs, nulls, counts, words, escapes, _ = parts
    flat = from_simple8b(words, escapes, n_ids)
    return [None if z else d for d, z in zip(docs.tolist(), nulls.tolist())], np.split(flat, np.cumsum(counts, dtype=np.int64)[:-1]) if n_docs else []


def block_slice(payload: bytes, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a block, decoding only the strides that hold them."""
    n_docs, n_ids, n_words, n_escapes, n_offsets = np.frombuffer(payload, "<u4", 5, 4).tolist()
    at = 24 + 13 * n_docs
    words, escapes = np.frombuffer(payload, "<u8", n_words, at), np.frombuffer(payload, "<u4", n_escapes, at + 8 * n_words)
    offsets = np.frombuffer(payload, "<u4", n_offsets, at + 8 * n_words + 4 * n_escapes)
    stop = min(stop, n_ids)
    if start >= stop:
        return np.zeros(0, np.uint32)
    a, b = int(np.searchsorted(offsets, start, "right")) - 1, int(np.searchsorted(offsets, stop - 1, "right"))
    upto = int(offsets[b]) if b < n_offsets else n_ids
    got = from_simple8b(words[a * STRIDE : b * STRIDE], np.zeros(0, np.uint32), upto - int(offsets[a]))
    if n_escapes and (got == ESCAPE).any():  # which escapes these are depends on what comes before
        before = int((from_simple8b(words[: a * STRIDE], np.zeros(0, np.uint32), int(offsets[a])) == ESCAPE).sum())
        marks = np.flatnonzero(got == ESCAPE)
        got[marks] = escapes[before : before + len(marks)]
    return got[start - int(offsets[a]) : stop - int(offsets[a])]


def token_blocks(docs: DataFrame, file: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """part, block_no, n_ids, payload: blocks in ascending doc_id order by (part, block_no)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, cache = TaskContext.get().partitionId(), 0, word_cache(file)
        held_docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([block(held_docs, held)], pa.binary())], names=["part", "block_no", "n_ids", "payload"])

        for batch in in_slices(batches, "text", 2 << 20):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), cache.ids([t or "" for t in batch.column("text").to_pylist()])):
                held_docs.append(doc)
                held.append(np.append(ids, np.uint32(end_id)))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield out()
                    held_docs, held, size, number = [], [], 0, number + 1
        if held:
            yield out()

    # ranges grow with the rows, whose number files know without being read; rows of one doc_id are parted by their digests
    n = max(partitions(docs.sparkSession), -(-docs.count() // RANGE_ROWS))
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tie", F.xxhash64("text"))
    ordered = own.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return ordered.mapInArrow(run, "part int, block_no int, n_ids long, payload binary")


def read_blocks(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in ``files``, in any order."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("__ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    parts = parts.select(F.col("part").alias("__part"), F.coalesce(F.sum("__ids").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("part").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "block_no", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("__inner"))
    starts = starts.join(parts, F.col("part") == F.col("__part")).select(F.col("part").alias("__p"), F.col("block_no").alias("__b"), (F.col("__inner") + F.col("__before")).alias("__base"))
    names = ["part", "block_no", "doc_id", "inside", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, payload in zip(batch.column("part").to_pylist(), batch.column("block_no").to_pylist(), batch.column("payload")):
                docs, ids = from_block(payload.as_py())
                sizes = np.array([len(x) for x in ids], np.int64)
                columns = [pa.array([part] * len(ids), pa.int32()), pa.array([number] * len(ids), pa.int32()), pa.array(docs, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    # blocks are decoded where they are read; only the small rows of documents meet the starts of their blocks
    rows = files.select("part", "block_no", "payload").mapInArrow(run, "part int, block_no int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    placed = rows.join(starts, (F.col("part") == F.col("__p")) & (F.col("block_no") == F.col("__b")))
    return placed.select("doc_id", (F.col("__base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op5_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_blocks(settle(token_blocks(table(spark, sf_dir, "documents")), "token-files"))
