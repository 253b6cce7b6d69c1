"""Removal of long repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the corpus.

1. Every window of LENGTH bytes has an anchor: the leftmost position inside it whose 64-byte hash is least.  Equal
   windows have equal anchors at equal places, so only windows of one anchor hash can be equal, and a hash that
   occurs once settles its windows.
2. For hashes that occur again, fragments (an anchor's run of windows with all their bytes, under 400) are compared
   by a hash of their own.  Windows of a fragment that occurs twice are repeated; only one copy of each different
   fragment goes on, and only where a hash has several.
3. These go, in batches of whole hash groups, into shards.  Each shard's transform is built over words of
   four bytes at every byte phase; all shards are merged by iterative interleave refinement: from "shard after
   shard", each pass deals the shard numbers out by the word before each suffix, which sorts suffixes by four more
   bytes without touching the texts or sorting suffixes again.  Boundaries that a pass adds give the common
   prefix lengths; after LENGTH bytes, the intervals without a boundary are the repeated windows.  A hash with very many different
   fragments is cut into cells, and each pair of cells is merged by itself, so no task holds more than two.

Defined results: a null text counts as empty and loses nothing; texts under LENGTH bytes lose nothing; of rows
with one text of LENGTH bytes or more, all lose all, repeated rows included; rows with a null doc_id are treated
alike and keep the null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import in_slices, partitions, release, settle, table

LENGTH, GRAM, WORD, SHARDS = 200, 64, 4, 4
#: Different fragments of one hash that a cell holds; a task merges two cells of a large hash at once.
CELL = 2000
#: Bytes of fragments that are merged at once.
BATCH = 1 << 17
_END = 255  # no byte of UTF-8
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 20
_UP = np.full(_SEGMENT + 1, _BASE, np.uint64)
_UP[0] = 1
_UP = np.multiply.accumulate(_UP)
_DOWN = np.full(_SEGMENT + 1, pow(_BASE, -1, 1 << 64), np.uint64)
_DOWN[0] = 1
_DOWN = np.multiply.accumulate(_DOWN)
_PLACES = np.uint64((1 << 21) - 1)


def anchors(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of every anchor of a text, in order."""
    parts = [_anchors(raw[at : at + _SEGMENT], at, length) for at in range(0, max(1, len(raw) - length + 1), _SEGMENT - length + 1)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(raw: bytes, shift: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    gram = min(GRAM, length)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * _DOWN[: n - gram + 1]
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    least = (hashes & ~_PLACES) | np.arange(len(hashes), dtype=np.uint64)
    span, width = 1, length - gram + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & _PLACES).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], len(place)) - 1
    return hashes[place[first]].view(np.int64), (first + shift).astype(np.int32), (last + shift).astype(np.int32)


def _order(symbols: np.ndarray) -> np.ndarray:
    """Stable order of unsigned symbols by radix passes of 16 bits."""
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    if symbols.dtype != np.uint16 and len(symbols) and symbols.max() > 0xFFFF:
        order = order[np.argsort((symbols[order] >> 16).astype(np.uint16), kind="stable")]
    return order


class Strings:
    """Texts laid end to end, each closed by an end mark and read as a circle."""

    def __init__(self, texts: list[bytes]) -> None:
        self.sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(self.raw)) - self.begins[self.owner]

    def moved(self, at: np.ndarray, by: int) -> np.ndarray:
        """Positions ``by`` further on their circles."""
        own = self.owner[at]
        return self.begins[own] + (self.place[at] + by) % self.sizes[own]

    def words(self) -> np.ndarray:
        """Rank of the four bytes at every position."""
        every = np.arange(len(self.raw))
        value = np.zeros(len(self.raw), np.uint32)
        for i in range(WORD):
            value = value << np.uint32(8) | self.raw[self.moved(every, i)]
        _, rank = np.unique(value, return_inverse=True)
        return rank.astype(np.uint16 if len(rank) == 0 or rank.max() <= 0xFFFF else np.uint32)


def shard_transform(strings: Strings, words: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted positions, word before each) of a shard's rotations; ``members``: positions of the shard's texts.

    Ranks double their reach until all differ, which they do, as no two texts of a shard are equal."""
    rank = words.astype(np.int64)
    reach, open_ = WORD, members
    _, own = np.unique(rank[members], return_inverse=True)
    full = np.zeros(len(words), np.int64)
    full[members] = own
    # ranks leave room for what splits them: rank of a class = number of rotations before it
    order = np.argsort(full[members], kind="stable")
    sorted_ = full[members][order]
    starts = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1])
    full[members[order]] = np.repeat(starts, np.diff(np.append(starts, len(members))))
    longest = int(strings.sizes[strings.owner[members]].max(initial=1))
    while True:
        counts = np.bincount(full[members], minlength=len(members))
        open_ = members[counts[full[members]] > 1]
        if not len(open_) or reach >= 2 * longest:
            break
        key = full[open_] * np.int64(len(members) + 1) + full[strings.moved(open_, reach)]
        order = np.argsort(key, kind="stable")
        key = key[order]
        base = key // (len(members) + 1)
        at = np.arange(len(key))
        new_class = np.concatenate([[True], base[1:] != base[:-1]])
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        class_start = np.maximum.accumulate(np.where(new_class, at, 0))
        key_start = np.maximum.accumulate(np.where(new_key, at, 0))
        full[open_[order]] = base + key_start - class_start
        reach *= 2
    positions = np.empty(len(members), np.int64)
    positions[full[members]] = members
    return positions, words[strings.moved(positions, -WORD)]


def merged(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each suffix in merged order, common prefix with the one before) by interleave refinement to ``depth`` bytes.

    Prefix lengths are multiples of a word; those of ``depth`` or more read ``depth``."""
    interleave = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    joined = np.concatenate(transforms)
    n = len(joined)
    common = np.full(n, depth, np.int16)
    common[:1] = 0
    block = np.zeros(n, np.int32)
    before = np.empty(n, joined.dtype)
    for step in range(depth // WORD):
        # the suffixes of one shard lie in its own order, so each takes its shard's next word
        before[np.argsort(interleave, kind="stable")] = joined
        order = _order(before)
        interleave = interleave[order]
        before_sorted, block = before[order], block[order]
        new = np.empty(n, bool)
        new[:1] = False
        new[1:] = (before_sorted[1:] != before_sorted[:-1]) | (block[1:] != block[:-1])
        common[new & (common == depth)] = step * WORD
        block = np.cumsum(new, dtype=np.int32)
    return interleave, common


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of several different texts: which of its windows occur in more than one place."""
    strings = Strings(texts)
    words = strings.words()
    shards = min(SHARDS, len(texts))
    of = np.arange(len(texts)) % shards
    parts = [shard_transform(strings, words, np.flatnonzero(of[strings.owner] == s)) for s in range(shards)]
    reach = length // WORD * WORD
    interleave, common = merged([t for _, t in parts], reach)
    positions = np.empty(len(interleave), np.int64)
    positions[np.argsort(interleave, kind="stable")] = np.concatenate([p for p, _ in parts])
    alike = common >= reach
    alike[:1] = False
    again = alike.copy()
    again[:-1] |= alike[1:]
    if reach < length:  # the bytes beyond whole words part the intervals further
        own = np.flatnonzero(again)
        key = np.cumsum(~alike)[own]
        for k in range(reach, length):
            key = key << 8 | strings.raw[strings.moved(positions[own], k)]
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        again[own] = counts[which] > 1
    hit = np.zeros(len(strings.raw), bool)
    hit[positions[again]] = True
    return [hit[b : b + max(0, s - length)] for b, s in zip(strings.begins.tolist(), strings.sizes.tolist())]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def group_repeats(keys: list[int], contents: list[bytes], alone: list[bool], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Runs of repeated windows of each of several fragments, which differ within a key; only those of one key are compared.

    alone: keys whose fragments also stand under other keys (pairs of cells), which must not meet in one batch."""
    found: list[list[tuple[int, int]]] = []
    a = 0
    while a < len(keys):  # different keys share no window, so a batch may hold any; one key's fragments must not be parted
        b, held = a, 0
        while b < len(keys) and (b == a or keys[b] == keys[b - 1] or held < BATCH and not alone[b] and not alone[a]):
            held += len(contents[b])
            b += 1
        found += [_runs(x) for x in repeated_windows(contents[a:b], length)]
        a = b
    return found


def text_key() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _rows(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, text_key, digest, n_bytes and the anchors of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            found = [anchors(x, length) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([len(x) for x in raw], pa.int64())]
                + [pa.array([x[i] for x in found], pa.list_(kind)) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))],
                names=["doc_id", "text_key", "digest", "n_bytes", "hashes", "firsts", "lasts"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_key().alias("text_key")).mapInArrow(run, "doc_id long, text_key long, digest string, n_bytes long, hashes array<long>, firsts array<int>, lasts array<int>")


def _batches(names: list[str], types: list[pa.DataType], rows: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
    for some in rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate(types)], names=names)


def _fragments(length: int, with_content: bool):
    """Over texts with their places: rid, hash, first, last of every fragment and a hash of its bytes, or the bytes."""
    names = ["rid", "hash", "first", "last", "copies", "content" if with_content else "same", *["cells"] * with_content]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary() if with_content else pa.int64(), *[pa.int32()] * with_content]
    of = bytes if with_content else lambda x: xxhash.xxh3_64_intdigest(x) - (1 << 63)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in in_slices(batches, "text", 2 << 20):
            out = []
            for rid, text, copies, found in zip(*(batch.column(c).to_pylist() for c in ("rid", "text", "copies", "found"))):
                raw = text.encode()
                out += [(rid, x["hash"], x["first"], x["last"], copies, of(raw[x["first"] : x["last"] + length]), *[x.get("cells")] * with_content) for x in found]
            yield out

    return lambda batches: _batches(names, types, rows(batches))


def _repeats(length: int):
    """Over different fragments sorted by hash: rid, start, stop of repeated bytes of those that occur once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        size = 0

        def out() -> list[tuple]:
            found = group_repeats([r[0] for r in held], [r[4] for r in held], [r[5] > 1 for r in held], length)
            return [(r[1], r[2] + a, r[2] + b - 1 + length) for r, runs in zip(held, found) if r[3] == 1 for a, b in runs]

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("hash", "rid", "first", "copies", "content", "cells"))):
                if size >= 4 * BATCH and row[0] != held[-1][0]:
                    yield out()
                    held, size = [], 0
                if held and held[-1][:3] == row[:3]:
                    continue  # a row of the input that repeats its whole key
                held.append(row)
                size += len(row[4])
        if held:
            yield out()

    return lambda batches: _batches(["rid", "start", "stop"], [pa.int64(), pa.int32(), pa.int32()], rows(batches))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[list[tuple]]:
        for batch in in_slices(batches, "text"):
            out = []
            for rid, text, spans in zip(*(batch.column(c).to_pylist() for c in ("rid", "text", "spans"))):
                raw = text.encode()
                gone = np.zeros(len(raw) + 1, np.int32)
                for x in spans:
                    gone[x["start"]] += 1
                    gone[x["stop"]] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                out.append((rid, int(gone.sum()), len(_runs(gone)), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
            yield out

    return _batches(["rid", "n_removed", "n_spans", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.string()], rows())


def _held(docs: DataFrame, rows: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """rid, text, copies and the places whose anchors occur again, of one row of each text that has such."""
    often = rows.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h")
    places = rows.select("rid", F.explode(F.arrays_zip(F.col("hashes").alias("hash"), F.col("firsts").alias("first"), F.col("lasts").alias("last"))).alias("p")).select("rid", "p.hash", "p.first", "p.last")
    places = places.join(often.hint("merge"), F.col("hash") == F.col("h"))
    wanted = places.groupBy("rid").agg(F.collect_list(F.struct("hash", "first", "last")).alias("found"))  # as many as a text has anchors
    keys = texts.join(rows.select(F.col("rid").alias("r"), F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")), F.col("rep") == F.col("r"))
    wanted = wanted.join(keys.select(F.col("rep"), "copies", "__id", "__key"), F.col("rid") == F.col("rep")).drop("rep")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_key().alias("text_key")).where(F.octet_length("text") >= length)
    # rows that repeat the whole key meet here more than once; their text occurs twice and goes as a whole
    return own.join(wanted.hint("merge"), (F.col("text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("rid", "text", "copies", "found")


def _spans(held: DataFrame, length: int, n: int) -> DataFrame:
    """rid, start, stop of the repeated bytes of texts that occur once."""
    spark = held.sparkSession
    seen = settle(held.mapInArrow(_fragments(length, False), "rid long, hash long, first int, last int, copies long, same long"), "repeat-fragments")
    kinds = seen.groupBy("hash", "same").agg(F.sum("copies").alias("times"), F.min(F.struct("rid", "first", "last")).alias("one"))
    kinds = settle(kinds, "repeat-kinds")
    release(spark)
    twice = kinds.where("times > 1").select(F.col("hash").alias("h"), F.col("same").alias("s"))
    whole = seen.where("copies = 1").join(twice.hint("merge"), (F.col("hash") == F.col("h")) & (F.col("same") == F.col("s"))).select("rid", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    several = kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1").select(F.col("hash").alias("h"), F.ceil(F.col("kinds") / CELL).cast("int").alias("cells"))
    needed = kinds.join(several.hint("merge"), F.col("hash") == F.col("h")).select(F.col("one.rid").alias("r"), F.struct("hash", F.col("one.first").alias("first"), F.col("one.last").alias("last"), "times", "cells").alias("x"))
    needed = needed.groupBy("r").agg(F.collect_list("x").alias("all"))
    once = F.filter("all", lambda x: x["times"] == 1)
    more = F.filter("all", lambda x: x["times"] > 1)
    texts = held.select("rid", "text").join(needed.hint("merge"), F.col("rid") == F.col("r")).select("rid", "text", once.alias("once"), more.alias("more"))
    texts = texts.select("rid", "text", F.lit(1).cast("long").alias("copies"), F.col("once").alias("found")).unionByName(texts.select("rid", "text", F.lit(2).cast("long").alias("copies"), F.col("more").alias("found"))).where(F.size("found") > 0)
    pieces = texts.mapInArrow(_fragments(length, True), "rid long, hash long, first int, last int, copies long, content binary, cells int")
    # of a hash with several cells, each pair of cells meets under a key of its own; others keep the hash
    cell = F.pmod(F.xxhash64("rid", "first"), F.col("cells")).cast("int")
    keys = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda o: F.when(F.col("cells") == 1, F.col("hash")).otherwise(F.xxhash64(F.col("hash"), F.least(cell, o), F.greatest(cell, o))))
    pieces = pieces.select("rid", "first", "copies", "content", "cells", F.explode(keys).alias("hash"))
    merged_ = pieces.repartition(n, "hash").sortWithinPartitions("hash", "rid", "first").mapInArrow(_repeats(length), "rid long, start int, stop int").distinct()
    return whole.unionByName(merged_)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = settle(_rows(docs, length).withColumn("rid", F.monotonically_increasing_id()), "repeat-anchors")  # numbered once, in the written table
    texts = settle(rows.groupBy("digest").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies")), "repeat-texts")
    held = settle(_held(docs, rows, texts, length), "repeat-held")
    release(spark)
    spans = settle(_spans(held, length, n).groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumnRenamed("rid", "r"), "repeat-spans")
    release(spark)
    cut = held.where("copies = 1").select("rid", "text").join(spans.hint("merge"), F.col("rid") == F.col("r")).select("rid", "text", "spans").mapInArrow(_cut, "rid long, n_removed long, n_spans long, kept string").withColumnRenamed("rid", "c")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = rows.select("rid", "doc_id", "digest", "n_bytes").join(texts.select(F.col("digest").alias("d"), "copies").hint("merge"), F.col("digest") == F.col("d")).join(cut.hint("merge"), F.col("rid") == F.col("c"), "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
    )


def op9_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
