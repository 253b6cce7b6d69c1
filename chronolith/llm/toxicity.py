"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is lower-cased and split into words (letters, digits and all beyond ASCII).  Each word is the sum of a
hashed word embedding and of hashed embeddings of the character strings at its ends and inside.  Windows of
``LENGTH`` words, ``STRIDE`` apart, cover the whole text; each runs through a forward and a backward gated unit,
attention pools the states, and a logit comes out.  A text's logit is that of its most toxic window, turned into
a probability by a logistic fit on validation texts.

Training reads at most ``POSITIVES`` toxic and ``NEGATIVES`` other labelled rows (those with the smallest hash of
doc_id), only from rows whose crc32(doc_id) mod 5 is not 0, and of each label at most ``SAMPLE_BYTES`` of text: in
that order, a row that doesn't fit any more is passed over and later ones that do are taken; scoring reads every row
and every word.

Defined results: null or empty texts and texts without words get the score of an empty window; a null doc_id has
null held_out; repeated rows are scored each; an empty table gives no rows; without labels of both kinds every
score is the share of toxic labels (0.0 if there are none); other columns are carried by ``clean`` and not read by
``scored``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import in_slices, settle, table

LENGTH, STRIDE = 48, 24
POSITIVES, NEGATIVES = 1000, 2500
#: Most bytes of text of each label that the driver trains on.
SAMPLE_BYTES = 64 << 20
HIDDEN, WIDTH, SLOTS = 8, 8, 1 << 14
#: Windows of one text that an epoch sees (drawn anew each epoch).
PER_TEXT, EPOCHS, BATCH = 6, 5, 256
#: Training takes as many steps at least, however few the labels.
LEAST_STEPS = 240
#: Learning rates: embeddings are touched seldom and move faster.
RATES = {"word": 0.02, "char": 0.02, "": 0.005}
#: Byte ranges of a word whose strings are character inputs; negative numbers count from its end.
PARTS = ((0, 3), (0, 5), (0, 7), (-4, None), (1, 5), (3, 7))
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[128:] = True
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


def word_slots(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Slots (words, 1 + parts) of all words of the texts, and where each text's words begin (texts + 1)."""
    encoded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" " + b" ".join(encoded) + b" ", np.uint8)
    sizes = np.array([len(x) + 1 for x in encoded], np.int64)
    inside = _WORD_BYTE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(7)) * up[: len(raw)], out=sums[1:])

    def slot(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        h = (sums[b] - sums[a]) * down[a] + np.uint64(salt * 0x1234567)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(32))) & np.uint64(SLOTS - 1)).astype(np.int32)

    slots = np.empty((len(start), 1 + len(PARTS)), np.int32)
    slots[:, 0] = slot(start, end, 1)
    for k, (a, b) in enumerate(PARTS):
        first = np.maximum(end + a, start) if a < 0 else np.minimum(start + a, end)
        slots[:, k + 1] = slot(first, end if b is None else np.minimum(start + b, end), k + 2)
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    return slots, bounds


def window_starts(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of every window: STRIDE apart, the last flush with the text's end; one at least."""
    first, count, text = [], [], []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        at = [*range(a, b - LENGTH, STRIDE), b - LENGTH] if b - a > LENGTH else [a]
        first += at
        count += [min(LENGTH, b - a)] * len(at)
        text += [i] * len(at)
    return np.array(first, np.int64), np.array(count, np.int64), np.array(text, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Weights are float32 arrays in ``w``; both directions run at once on the leading axis."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.w = {
            "word": f(SLOTS, WIDTH, scale=0.1),
            "char": f(SLOTS, WIDTH, scale=0.1),
            "in": f(2, 2 * WIDTH, 3 * HIDDEN, scale=0.3),
            "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "re": f(2, HIDDEN, 3 * HIDDEN, scale=0.3),
            "att": f(2 * HIDDEN, HIDDEN, scale=0.3),
            "pick": f(HIDDEN, scale=0.5),
            "out": f(2 * HIDDEN, scale=0.5),
            "shift": np.zeros(1, np.float32),
        }
        self.scale = (1.0, 0.0)
        self.constant: float | None = None

    def words(self, slots: np.ndarray) -> np.ndarray:
        own = self.w["word"][slots[:, 0]]
        chars = self.w["char"][slots[:, 1]]
        for k in range(2, slots.shape[1]):
            chars = chars + self.w["char"][slots[:, k]]
        return np.concatenate([own, chars], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w["in"] + self.w["bias"]

    def forward(self, gates: np.ndarray, index: np.ndarray, counts: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; gates (2, words, 3H); index (windows, LENGTH) into words, -1 beyond a window's count."""
        n, steps = index.shape
        masked = bool((counts < steps).any())
        back = index[:, ::-1]
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((steps, 2, n, HIDDEN), np.float32)
        trail = []
        for t in range(steps):
            one, two = index[:, t], back[:, t]
            g = np.stack([gates[0][one], gates[1][two]])
            u = h @ self.w["re"]
            zr = _sigmoid(g[..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            q = u[..., 2 * HIDDEN :]
            c = np.tanh(g[..., 2 * HIDDEN :] + r * q)
            new = c + z * (h - c)
            m = None
            if masked:
                m = np.stack([one >= 0, two >= 0])[..., None]
                new = np.where(m, new, h)
            if keep is not None:
                trail.append((h, z, r, q, c, m))
            h = states[t] = new
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)  # steps, windows, 2H
        a = np.tanh(both @ self.w["att"])
        e = a @ self.w["pick"]
        if masked:
            e = np.where((index >= 0).T, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        p = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", p, both) * (counts > 0)[:, None]
        if keep is not None:
            keep.update(trail=trail, both=both, a=a, p=p, pooled=pooled)
        return pooled @ self.w["out"] + self.w["shift"][0]

    def gradients(self, slots: np.ndarray, index: np.ndarray, counts: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss and its gradients."""
        x = self.words(slots)
        k: dict = {}
        logit = self.forward(self.gates(x), index, counts, k)
        n, steps = index.shape
        loss = float(np.mean(np.logaddexp(0, logit) - target * logit))
        d = ((1 / (1 + np.exp(-logit)) - target) / n).astype(np.float32)
        g = {"out": k["pooled"].T @ d, "shift": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * self.w["out"] * (counts > 0)[:, None]
        both, a, p = k["both"], k["a"], k["p"]
        dboth = p[..., None] * dpool
        dp = np.einsum("tnh,nh->tn", both, dpool)
        de = p * (dp - (p * dp).sum(axis=0))
        g["pick"] = np.einsum("tnh,tn->h", a, de)
        da = de[..., None] * self.w["pick"] * (1 - a * a)
        g["att"] = np.einsum("tnk,tnh->kh", both, da)
        dboth = dboth + da @ self.w["att"].T
        dstate = np.stack([dboth[..., :HIDDEN], dboth[::-1, :, HIDDEN:]], axis=1)
        dre = np.zeros_like(self.w["re"])
        dgates = np.zeros((2, len(slots) + 1, 3 * HIDDEN), np.float32)  # the last row takes what is masked
        dh = np.zeros((2, n, HIDDEN), np.float32)
        back = index[:, ::-1]
        own = np.empty((steps, 2, n, 3 * HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, q, c, m = k["trail"][t]
            dn = dh + dstate[t]
            passed = 0
            if m is not None:
                passed = np.where(m, 0, dn)
                dn = np.where(m, dn, 0)
            dc = dn * (1 - z) * (1 - c * c)
            dz = dn * (h - c) * z * (1 - z)
            dr = dc * q * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r], axis=-1)
            own[t] = np.concatenate([dz, dr, dc], axis=-1)
            dre += h.transpose(0, 2, 1) @ du
            dh = dn * z + du @ self.w["re"].transpose(0, 2, 1) + passed
        g["re"] = dre
        for s, rows in ((0, index.T), (1, back.T)):
            flat, values = rows.ravel(), own[:, s].reshape(-1, 3 * HIDDEN)
            for j in range(3 * HIDDEN):
                dgates[s, :, j] = np.bincount(np.where(flat < 0, len(slots), flat), values[:, j], len(slots) + 1)
        dgates = dgates[:, :-1]
        g["bias"] = dgates.sum(axis=1, keepdims=True)
        g["in"] = x.T @ dgates
        dx = (dgates @ self.w["in"].transpose(0, 2, 1)).sum(axis=0)
        g["word"] = np.stack([np.bincount(slots[:, 0], dx[:, j], SLOTS) for j in range(WIDTH)], axis=1).astype(np.float32)
        parts = slots[:, 1:].ravel()
        g["char"] = np.stack([np.bincount(parts, np.repeat(dx[:, WIDTH + j], slots.shape[1] - 1), SLOTS) for j in range(WIDTH)], axis=1).astype(np.float32)
        return loss, g

    def logits(self, texts: list[str | None], at_once: int = 4096) -> np.ndarray:
        """The logit of each text's most toxic window."""
        slots, bounds = word_slots(texts)
        first, count, text = window_starts(bounds)
        gates = self.gates(self.words(slots)) if len(slots) else np.zeros((2, 1, 3 * HIDDEN), np.float32)
        out = np.empty(len(first), np.float32)
        for whole in (True, False):
            picked = np.flatnonzero((count == LENGTH) == whole)
            for a in range(0, len(picked), at_once):
                at = picked[a : a + at_once]
                out[at] = self.forward(gates, _index(first[at], count[at]), count[at])
        return np.maximum.reduceat(out, np.searchsorted(text, np.arange(len(texts)))) if len(texts) else out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(texts).astype(np.float64) + b, -60, 60)))


def _index(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    step = np.arange(LENGTH)
    return np.where(step < count[:, None], first[:, None] + step, -1)


def train(texts: list[str | None], labels: list[int], share: float | None = None, seed: int = 3) -> Network:
    """A network from labelled texts; ``share``: toxic labels among all, for the probabilities (else as in ``labels``)."""
    net, target = Network(), np.array(labels, np.float32)
    share = float(target.mean()) if share is None and len(target) else share or 0.0
    if not 0 < target.sum() < len(target):
        net.constant = share
        return net
    r = np.random.default_rng(seed)
    parts = [word_slots(texts[a : a + 64]) for a in range(0, len(texts), 64)]
    slots = np.concatenate([x for x, _ in parts])
    before = np.cumsum([0, *[len(x) for x, _ in parts]])
    bounds = np.concatenate([[0], *[b[1:] + n for (_, b), n in zip(parts, before)]])
    held = r.random(len(texts)) < 0.2
    first, count, text = window_starts(bounds)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    begin = np.searchsorted(text, np.arange(len(texts) + 1))
    each = max(1, int(np.minimum(np.bincount(text, minlength=len(texts)), PER_TEXT)[~held].sum()) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // each))
    step, total = 0, epochs * each
    judge = {e for e in range(2, epochs) if (e - 2) % max(1, epochs // EPOCHS) == 0}
    best: np.ndarray | None = None
    for epoch in range(epochs):
        picked = []
        if epoch in judge:  # from here on, a toxic text is taught by the windows that the network finds toxic
            best = np.empty(len(first), np.float32)
            for a in range(0, len(first), 2048):
                at = slice(a, a + 2048)
                low, high = int(first[at].min()), int((first[at] + count[at]).max())
                gates = net.gates(net.words(slots[low : high + 1])) if high > low else np.zeros((2, 1, 3 * HIDDEN), np.float32)
                best[at] = net.forward(gates, _index(first[at] - low, count[at]), count[at])
        for i in np.flatnonzero(~held):
            own = np.arange(begin[i], begin[i + 1])
            if best is not None and len(own) > 2:
                order = own[np.argsort(-best[own], kind="stable")]
                top = order[: 1 + len(order) // 4][:PER_TEXT]
                picked.append(top if target[i] else np.concatenate([order[:2], r.choice(order[2:], min(PER_TEXT - 2, len(order) - 2), replace=False)]))
            else:
                picked.append(r.choice(own, min(PER_TEXT, len(own)), replace=False))
        picked = r.permutation(np.concatenate(picked))
        for a in range(0, len(picked), BATCH):
            at = picked[a : a + BATCH]
            rows = _index(first[at], count[at])
            used, local = np.unique(rows, return_inverse=True)
            local = local.reshape(rows.shape)
            if used[0] < 0:
                used, local = used[1:], local - 1
            if not len(used):
                continue
            _, grads = net.gradients(slots[used], local, count[at], target[text[at]])
            step += 1
            rate = 1 - 0.9 * min(1.0, step / total)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g / max(1.0, norm)
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                net.w[k] -= (RATES.get(k, RATES[""]) * rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    check = [i for i in np.flatnonzero(held)]
    if not 0 < target[check].sum() < len(check):
        check = list(range(len(texts)))
    logits = np.concatenate([net.logits([texts[i] for i in check[a : a + 64]]) for a in range(0, len(check), 64)])
    net.scale = _logistic(logits.astype(np.float64), target[check].astype(np.float64), share)
    return net


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope 1 (logits are trained as such) and the shift that fits the classes, weighed as in the corpus."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    low, high = -60.0, 60.0
    for _ in range(60):
        b = (low + high) / 2
        slope = (weight * (1 / (1 + np.exp(-np.clip(x + b, -60, 60))) - y)).sum() + 1e-3 * b
        low, high = (low, b) if slope > 0 else (b, high)
    return 1.0, float(b)


def held_out_fold() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def fitted(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """A network from the bounded sample of labelled rows outside the held-out fold: bounded in rows and in bytes of
    text; of repeated labels or rows of one doc_id, one counts."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").where(~held_out_fold()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = own.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    share = (n[1] or 0) / n[0] if n[0] else 0.0
    some = own.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).unionByName(own.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(negatives))
    found = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), F.col("__id") == F.col("doc_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = settle(found, "toxicity-sample")
    # sizes of as many rows as the sample has: in the order of the hash each row that still fits is taken, one that doesn't is left out whole
    sizes = found.select("doc_id", "toxic", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    taken, held = [], {}
    for r in sizes:
        if held.get(r.toxic, 0) + r["size"] <= sample_bytes:
            held[r.toxic] = held.get(r.toxic, 0) + r["size"]
            taken.append((r.doc_id,))
    chosen = docs.sparkSession.createDataFrame(taken, "__taken long")
    rows = found.join(F.broadcast(chosen), F.col("doc_id") == F.col("__taken")).select("doc_id", "text", "toxic").collect()  # at most the bytes of the bound
    rows = sorted(rows, key=lambda x: (x.doc_id, x.text or ""))
    return train([x.text for x in rows], [x.toxic for x in rows], share)


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(net.scores(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs`` that the network doesn't call toxic, all columns as they came."""
    names = docs.columns

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        rows, out, a = text.tolist(), [], 0
        while a < len(rows):  # about a megabyte of text at once
            b, held = a, 0
            while b < len(rows) and held < 1 << 20:
                held += len(rows[b] or "")
                b += 1
            out.append(net.scores(rows[a:b]))
            a = b
        return pd.Series(np.concatenate(out) if out else [])

    return docs.where(score(F.col("text").cast("string")) < 0.5).select(*[F.col(f"`{n}`") for n in names])


def op6_window_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
