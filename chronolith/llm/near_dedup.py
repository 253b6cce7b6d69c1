"""Near-duplicate classes by b-bit MinHash.

1. Every text becomes its set of distinct word shingles (64-bit hashes) and 80 minima: 20 band keys of four minima
   each, and the low four bits of every minimum packed into 40 bytes.  Rows with equal sets collapse to the
   smallest doc_id, whatever the size of such a group.
2. Sets that share a band key meet in cells of bounded size.  Packed signatures are compared by bit counts; the
   share of equal nibbles, corrected for chance collisions, estimates the similarity, and pairs whose estimate
   lies within ``MARGIN`` of the threshold are joined (a spanning forest leaves the cell, never all pairs).
   Buckets larger than a cell are joined as a whole: more candidates, none lost.
3. Connected candidates form clusters (star contraction, logarithmic rounds).
4. Full sets are gathered for clusters only, and exact similarities decide the links inside each.  A cluster with
   more shingles than a block holds is cut into cells, and every pair of cells is one block: all its pairs are
   still judged, no task holds more than two cells, and what the blocks find is joined as in step 3.

At the threshold of 0.85 a pair misses all 20 bands with probability 4e-7, and the estimate falls below the
margin (five standard deviations) with about the same.

Defined results: null texts and texts without words have the empty set, size 0, and stand alone; texts with fewer
words than a shingle have one element, the whole; rows with a null doc_id stand alone with a null component;
repeated rows share a component and, having one doc_id, are all kept; different texts under one doc_id are rows of
their own, each with its own links, and a component's id is the smallest doc_id among its rows; an empty table gives
no rows; other columns are not read by ``classes`` and carried by ``representatives``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import in_slices, partitions, settle, table

BANDS, ROWS, LOW_BITS = 20, 4, 4
HASHES = BANDS * ROWS
#: Largest number of sets that are compared pair by pair in one bucket.
CELL = 1000
#: Shingles of one cell of a large cluster; a task holds two cells, of eight bytes a shingle.
BLOCK_SHINGLES = 1_000_000
#: How far below the threshold an estimate may lie; five standard deviations of an estimate from 80 minima at 0.85.
MARGIN = 0.2
_RANDOM = np.random.default_rng(20240607)
_MULTIPLY = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MIX = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NIBBLES = np.uint64(0x1111111111111111)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, words: int = 3) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased, words parted by ASCII white space."""
    split = (text or "").encode().lower().split()
    hashes = np.fromiter(map(_WORDS.__getitem__, split), np.uint64, len(split))
    n = len(hashes)
    if not n:
        return hashes
    width = min(words, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = _mixed(total * _MIX[i] + hashes[i : n - width + 1 + i])
    return np.unique(total)


def minima(shingles: np.ndarray) -> np.ndarray:
    """80 minima (32 bits each) of a non-empty set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * _MULTIPLY + _ADD).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * np.uint64(0xD6E8FEB86659FD93) + column)
    return keys.view(np.int64)


def packed_bits(least: np.ndarray) -> bytes:
    """The low four bits of each minimum, two to a byte."""
    low = (_mixed(least) & np.uint64(15)).astype(np.uint8).reshape(-1, 2)
    return (low[:, 0] | low[:, 1] << 4).tobytes()


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of one packed signature (uint64 words) to many: equal nibbles by bit counts, less chance hits."""
    x = one ^ many
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    equal = 1 - np.bitwise_count(x & _NIBBLES).sum(axis=-1) / HASHES
    chance = 1 / (1 << LOW_BITS)
    return (equal - chance) / (1 - chance)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes; null for empty sets), bands, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            sizes, keys, bands, bits = [], [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, words)
                sizes.append(len(shingles))
                least = minima(shingles) if len(shingles) else None
                keys.append(None if least is None else hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                bands.append(None if least is None else band_keys(least))
                bits.append(None if least is None else packed_bits(least))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "set_key", "bands", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, bits binary")


def _grouped(run: Callable[[tuple, dict[str, list]], list[tuple]], by: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function over rows sorted by ``by``: ``run(key, columns)`` gives the rows of each group."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        out: list[tuple] = []
        for batch in batches:
            columns = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)}
            keys = list(zip(*(columns[c] for c in by)))
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(starts, starts[1:]):
                if keys[a] != key:
                    if held is not None:
                        out += run(key, held)
                    key, held = keys[a], {n: [] for n in columns}
                for n, c in columns.items():
                    held[n] += c[a:b]
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        if held is not None:
            out += run(key, held)
        if out:
            yield batch_of(out)

    return over


def _words_of(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)


def _forest(ids: list[int], bits: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose estimate reaches ``least``: each step joins what is near one node."""
    left, edges = np.arange(len(ids)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        root = ids[queue[0]]
        while queue and len(left):
            near = estimates(bits[queue.pop()], bits[left]) >= least
            edges += [(root, ids[i]) for i in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return edges


def candidate_edges(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: a spanning forest of the candidates of each bucket."""
    n = partitions(sets.sparkSession)
    members = sets.select("rep", "bits", F.explode("bands").alias("band"))
    counts = members.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1").withColumnRenamed("band", "__band")
    met = members.join(counts, F.col("band") == F.col("__band")).withColumn("cells", F.ceil(F.col("members") / CELL)).withColumn("cell", F.pmod(F.xxhash64("rep"), F.col("cells")))
    least = threshold - MARGIN
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key: tuple, c: dict[str, list]) -> list[tuple]:
        ids = c["rep"]
        return _forest(ids, _words_of(c["bits"]), least) if c["cells"][0] == 1 else [(ids[0], i) for i in ids[1:]]

    inside = met.select("band", "cell", "cells", "rep", "bits").repartition(n, "band", "cell").sortWithinPartitions("band", "cell", "rep").mapInArrow(_grouped(run, ["band", "cell"], schema), "a long, b long")
    # cells of one large bucket hang together by their smallest members
    heads = met.where("cells > 1").groupBy("band", "cell").agg(F.min("rep").alias("head"))
    firsts = heads.groupBy("band").agg(F.min("head").alias("a")).withColumnRenamed("band", "__band")
    across = heads.join(firsts, F.col("band") == F.col("__band")).where("a <> head").select("a", F.col("head").alias("b"))
    return inside.unionByName(across).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component with an edge, by alternating star contraction."""
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, F.col("a") == F.col("n"))
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        edges = settle(small, "component-edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _linked(ids: list[int], sets: list[np.ndarray], bits: np.ndarray, percent: int) -> dict[int, int]:
    """id -> smallest id that exact links reach."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(flat.max() + 1, bool)
    left, root_of = np.arange(len(ids)), {}
    while len(left):
        group, queue, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            low, high = np.minimum(sizes[one], sizes[left]), np.maximum(sizes[one], sizes[left])
            may = np.flatnonzero((100 * low >= percent * high) & (estimates(bits[one], bits[left]) >= percent / 100 - 1.5 * MARGIN))
            if not len(may):
                continue
            own = flat[starts[one] : starts[one] + sizes[one]]
            marked[own] = True
            tried = left[may]
            spans = sizes[tried]
            at = np.arange(int(spans.sum())) + np.repeat(starts[tried] - (np.cumsum(spans) - spans), spans)
            shared = np.add.reduceat(marked[flat[at]].astype(np.int64), np.cumsum(spans) - spans)
            marked[own] = False
            linked = 100 * shared >= percent * (sizes[one] + spans - shared)
            group += tried[linked].tolist()
            queue += tried[linked].tolist()
            left = np.delete(left, may[linked])
        root = min(ids[i] for i in group)
        root_of |= {ids[i]: root for i in group}
    return root_of


def exact_links(docs: DataFrame, clustered: DataFrame, sizes: DataFrame, words: int, percent: int) -> DataFrame:
    """rep, component: exact links inside candidate clusters (node, root); sizes: rep, n_shingles."""
    spark = docs.sparkSession
    n = partitions(spark)
    own = clustered.join(sizes.select(F.col("rep").alias("__rep"), "n_shingles"), F.col("node") == F.col("__rep"))
    cells = own.groupBy("root").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("cells")).withColumnRenamed("root", "__root")
    most = cells.agg(F.max("cells")).first()[0] or 1
    placed = clustered.join(cells, F.col("root") == F.col("__root")).select("node", "root", "cells")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(placed.hint("merge"), F.col("doc_id") == F.col("node")).select("root", "cells", "doc_id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            rows = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("cells"), batch.column("doc_id"), pa.array([x.tobytes() for x in rows], pa.binary()), pa.array([packed_bits(minima(x)) if len(x) else None for x in rows], pa.binary())], names=["root", "cells", "rep", "shingles", "bits"])

    schema = pa.schema([("rep", pa.int64()), ("component", pa.int64())])

    def run(key: tuple, c: dict[str, list]) -> list[tuple]:
        seen: dict[int, int] = {}
        for i, rep in enumerate(c["rep"]):
            if c["shingles"][i]:
                seen.setdefault(rep, i)
        if not seen:
            return []
        kept = list(seen.values())
        return list(_linked(list(seen), [np.frombuffer(c["shingles"][i], np.uint64) for i in kept], _words_of([c["bits"][i] for i in kept]), percent).items())

    gathered = texts.mapInArrow(sets, "root long, cells int, rep long, shingles binary, bits binary")
    if most == 1:
        return gathered.drop("cells").repartition(n, "root").sortWithinPartitions("root", "rep").mapInArrow(_grouped(run, ["root"], schema), "rep long, component long")
    cell = F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int")
    others = F.sequence(F.lit(0), F.col("cells") - 1)
    blocks = gathered.withColumn("cell", cell).select("root", "rep", "shingles", "bits", F.explode(F.transform(others, lambda o: F.struct(F.least("cell", o).alias("lo"), F.greatest("cell", o).alias("hi")))).alias("block")).select("root", "block.lo", "block.hi", "rep", "shingles", "bits")
    found = blocks.repartition(n, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "rep").mapInArrow(_grouped(run, ["root", "lo", "hi"], schema), "rep long, component long")
    found = settle(found.distinct(), "near-blocks")
    return components(found.select(F.col("component").alias("a"), F.col("rep").alias("b"))).select(F.col("node").alias("rep"), F.col("root").alias("component"))


def _numbered(docs: DataFrame) -> DataFrame | None:
    """``docs`` with ``__row``, numbers in the order of doc_ids (null where that is), or None if doc_ids are a key."""
    own = F.col("doc_id").cast("long")
    if docs.where(own.isNotNull()).groupBy(own.alias("__own")).count().where("count > 1").isEmpty():
        return None
    order = [own, F.xxhash64(F.col("text").cast("string"))]
    rows = docs.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return settle(rows.withColumn("__row", F.when(own.isNotNull(), F.monotonically_increasing_id())), "near-rows")


def classes(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links are ``100 * shared >= percent * union``.

    Where a doc_id repeats, numbers in their order stand for doc_ids until classes are found."""
    numbered = _numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    if numbered is None:
        return _classes(docs, words, percent)
    names = numbered.select(F.col("__row").alias("__n"), F.col("doc_id").alias("__doc"))
    found = settle(_classes(numbered.select(F.col("__row").alias("doc_id"), "text"), words, percent), "near-numbered")
    out = found.join(names.hint("merge"), F.col("doc_id") == F.col("__n"), "left").select("__doc", "n_shingles", "component_id")
    firsts = names.select(F.col("__n").alias("__m"), F.col("__doc").alias("__first"))
    out = out.join(firsts.hint("merge"), F.col("component_id") == F.col("__m"), "left")
    return out.select(F.col("__doc").alias("doc_id"), "n_shingles", F.col("__first").alias("component_id"), F.coalesce(F.col("__doc") == F.col("__first"), F.lit(True)).alias("kept"))


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``classes`` where doc_ids are a key."""
    rows = settle(sketches(docs, words), "near-sketches")
    sets = rows.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits"), F.any_value("n_shingles").alias("n_shingles"))
    sets = settle(sets, "near-sets")
    clustered = components(candidate_edges(sets, percent / 100))
    links = settle(exact_links(docs, clustered, sets, words, percent), "near-links").withColumnRenamed("rep", "__rep")
    owners = sets.join(links, F.col("rep") == F.col("__rep"), "left").select(F.col("set_key").alias("__key"), F.coalesce("component", "rep").alias("__component"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(owners.hint("merge"), F.col("set_key") == F.col("__key"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("__component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, words: int = 5, percent: int = 80, single: bool = False) -> DataFrame:
    """The rows of ``docs`` that their class keeps (the smallest doc_id), all columns as they came.

    With ``single``, a doc_id need not be a key: where one repeats, rows are numbered in its order (range partitions,
    sorted), numbers stand for doc_ids, and a class keeps one row."""
    numbered = _numbered(docs) if single else None
    if numbered is not None:
        dropped = _classes(numbered.select(F.col("__row").alias("doc_id"), "text"), words, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__dropped"))
        return numbered.join(dropped.hint("merge"), F.col("__row") == F.col("__dropped"), "left_anti").drop("__row")
    dropped = (_classes if single else classes)(docs, words, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(dropped.hint("merge"), F.col("doc_id").cast("long") == F.col("__dropped"), "left_anti")


def op7_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
c AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT c.d, u.y FROM c JOIN u ON c.r = u.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT d AS doc_id, min(r) AS component_id FROM c GROUP BY d) LEFT JOIN n USING (doc_id)
"""
