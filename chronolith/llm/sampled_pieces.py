"""Distinct sampled SentencePiece segmentations: Gumbel top-k without replacement over the lattice.

A text is normalised by the model and cut into stretches that pieces never cross (each begins at a run of the
space mark).  Backward log-sums over the lattice of every different stretch give, at each place, the chance of
each piece; characters without a piece fall back to bytes.  The space of segmentations is searched by A* over
perturbed values: the root gets a Gumbel value for all, a descent samples one whole segmentation which inherits
it, and every stretch along the way leaves behind the set of its other segmentations (with what comes before as
chosen, and what comes after free), with a Gumbel value for its mass, truncated at its parent's.  The best set in
the frontier is popped and descended in turn, piece by piece in its own stretch, k times, so each segmentation is
new, as all sets are disjoint.  The value of the next set is the threshold from which inclusion scores follow.

Most stretches have one segmentation far likelier than all others (their favourite), which is followed once for
each different stretch; one number then tells how far along it a sample goes before it leaves it.

Random numbers are a hash of (seed, doc_id, sample, place): neither order nor partitioning matters.  Weights of
pieces are the model's own log-probabilities for unigram models; merge ranks of BPE models become Zipf weights.

Defined results: null and empty texts have one segmentation, the empty one; a text with fewer than k
segmentations gives them all, with inclusion score 1; a null doc_id seeds as 0 and keeps the null; repeated rows
give equal samples; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import in_slices, table

SAMPLES = 3
_MODELS: dict = {}
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def uniform(row_key: np.ndarray, sample: int, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) by row key, sample and place."""
    x = _mix(row_key + np.uint64((sample + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    x = _mix(x ^ (place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(max(n, 1 << 21), base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


class Model:
    """Piece table of a SentencePiece model: an open hash of piece texts, their ids and log weights."""

    def __init__(self, file: str) -> None:
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(file))
        ids = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i))]
        pieces, scores = [p.id_to_piece(i) for i in ids], np.array([p.get_score(i) for i in ids])
        ranked = (scores == np.round(scores)).all()  # BPE: minus the merge's rank
        weights = -np.log(np.minimum(-scores, len(ids)) + 10) if ranked else scores
        self.longest = max(map(len, pieces))
        self.bytes = np.array([p.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.unknown = p.unk_id()
        self.byte_weight = float(weights.min()) - 1.0
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(x) for x in pieces])
        keys = self.hashes(codes, ends - [len(x) for x in pieces], ends)
        self.mask = (1 << 18) - 1
        self.slot_key = np.zeros(self.mask + 1, np.uint64)
        self.slot_piece = np.full(self.mask + 1, -1, np.int32)
        for key, piece in zip(keys.tolist(), ids):
            at = key & self.mask
            while self.slot_piece[at] >= 0:
                at = (at + 1) & self.mask
            self.slot_key[at], self.slot_piece[at] = key, piece
        self.weight = np.full(p.get_piece_size(), -np.inf)
        self.weight[ids] = weights
        self.weight[self.bytes] = self.byte_weight
        self.lattice = Lattice(self)

    @staticmethod
    def sums(codes: np.ndarray) -> np.ndarray:
        up, _ = _powers(len(codes) + 1)
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=out[1:])
        return out

    @classmethod
    def hashes(cls, codes: np.ndarray, a: np.ndarray, b: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        sums = cls.sums(codes) if sums is None else sums
        return _mix((sums[b] - sums[a]) * _powers(len(codes) + 1)[1][a] + (b - a).astype(np.uint64))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each key, or -1."""
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        out = self.slot_piece[at]
        todo = np.flatnonzero(out >= 0)  # few: most strings are no pieces and meet an empty slot
        at = at[todo]
        while len(todo):
            off = (self.slot_key[at] != keys[todo]) & (out[todo] >= 0)
            todo, at = todo[off], (at[off] + 1) & self.mask
            out[todo] = self.slot_piece[at]
        return out


def model(file: str) -> Model:
    if file not in _MODELS:
        _MODELS[file] = Model(file)
    return _MODELS[file]


class Lattice:
    """Arcs of all different stretches seen so far, emptied when it holds ``most`` places, so memory stays bounded.

    Node n has arcs lo[n] .. lo[n] + count[n], the longest piece first."""

    def __init__(self, m: Model, most: int = 3_000_000) -> None:
        self.model, self.most = m, most
        self.reset(0)

    def reset(self, room: int) -> None:
        size = max(self.most, room)
        self.stretch_of: dict[int, int] = {}
        self.nodes = self.arcs = 0
        self.plain = True
        # of each stretch: its first node, its favourite's arcs (fav_lo, fav_n into fav_arc), their chances in a row, its log chance
        self.base, self.fav_lo, self.fav_n = (np.zeros(0, np.int64) for _ in range(3))
        self.fav_arc, self.fav_stay, self.fav_log = np.zeros(0, np.int32), np.zeros(0), np.zeros(0)
        self.lo, self.count = np.empty(size, np.int32), np.empty(size, np.int8)
        self._arc_room(4 * size if room else size)

    def _arc_room(self, size: int) -> None:
        for name, kind in (("piece", np.int32), ("length", np.int8), ("log_p", np.float32), ("upto", np.float32)):
            new = np.empty(size, kind)
            if self.arcs:
                new[: self.arcs] = getattr(self, name)[: self.arcs]
            setattr(self, name, new)

    def place(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The stretch of each of the texts' stretches; new ones are added."""
        m = self.model
        sums = m.sums(codes)
        keys, first, which = np.unique(m.hashes(codes, begins, ends, sums), return_index=True, return_inverse=True)
        keys, all_sizes = keys.tolist(), ends - begins
        new = np.array([i for i, k in enumerate(keys) if k not in self.stretch_of], np.int64)
        if self.nodes + int(all_sizes[first[new]].sum()) > len(self.lo):
            self.reset(int(all_sizes[first].sum()))
            new = np.arange(len(keys))
        if len(new):
            n = len(self.base)
            self.stretch_of.update(zip([keys[i] for i in new.tolist()], range(n, n + len(new))))
            self._add(codes, sums, begins[first[new]], all_sizes[first[new]])
        return np.fromiter(map(self.stretch_of.__getitem__, keys), np.int64, len(keys))[which]

    def _add(self, codes: np.ndarray, sums: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        m = self.model
        base = np.cumsum(size) - size
        nodes = int(size.sum())
        owner = np.repeat(np.arange(len(size)), size)
        left = (base + size)[owner] - np.arange(nodes)  # characters to the stretch's end
        at = (begin - base)[owner] + np.arange(nodes)
        # places by their distance to the end, so that those with room for n characters lie in front
        far = int(left.max())
        by_left = np.argsort(left.astype(np.uint16) if far < 1 << 16 else left, kind="stable")
        order = by_left[::-1]
        from_ = at[order]
        before, down = sums[from_], _powers(len(codes) + 1)[1][from_]
        room = np.bincount(left, minlength=far + 1)[::-1].cumsum()[::-1]
        node, piece, size_of, count = [], [], [], np.zeros(nodes, np.int64)
        for n in range(1, min(m.longest, far) + 1):
            own = order[: room[n]]
            found = m.lookup(_mix((sums[from_[: room[n]] + n] - before[: room[n]]) * down[: room[n]] + np.uint64(n)))
            if n == 1:
                code = codes[from_].astype(np.int32)  # by bytes: one byte's own piece, or a mark that keeps the code point
                found = np.where(found >= 0, found, np.where(code < 0x80, m.bytes[np.minimum(code, 0x7F)], -2 - code)).astype(np.int32)
            hit = np.flatnonzero(found != -1)
            node.append(own[hit])
            piece.append(found[hit])
            size_of.append(n)
            count[node[-1]] += 1
        hi = np.cumsum(count)
        lo = hi - count
        filled, total_arcs = lo.copy(), int(hi[-1])
        pieces, length, of = np.empty(total_arcs, np.int32), np.empty(total_arcs, np.int32), np.empty(total_arcs, np.int64)
        for own, found, n in zip(node[::-1], piece[::-1], size_of[::-1]):  # longest first
            slot = filled[own]
            pieces[slot], length[slot], of[slot] = found, n, own
            filled[own] += 1
        weight = m.weight[pieces]
        if (pieces < 0).any():
            self.plain = False
            odd = np.flatnonzero(pieces < 0)
            code = -2 - pieces[odd]
            weight[odd] = m.byte_weight * np.select([code < 0x800, code < 0x10000], [2, 3], 4)
        beta = np.zeros(nodes + 1)
        to_end = left[of] == length
        total = np.empty(total_arcs)
        bounds = np.searchsorted(left[by_left], np.arange(1, far + 2))
        for d in range(len(bounds) - 1):  # nodes by their distance to the end
            own = by_left[bounds[d] : bounds[d + 1]]
            counts = count[own]
            starts = np.cumsum(counts) - counts
            arcs = np.arange(int(counts.sum())) + np.repeat(lo[own] - starts, counts)
            value = weight[arcs] + np.where(to_end[arcs], 0.0, beta[of[arcs] + length[arcs]])
            top = np.maximum.reduceat(value, starts)
            beta[own] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts)), starts))
            total[arcs] = value
        log_p = total - beta[of]
        p = np.exp(log_p)
        run = np.cumsum(p)
        upto = run - np.repeat((run - p)[lo], count)  # chance of an arc and those before it
        upto[hi - 1] = 2.0
        if self.arcs + total_arcs > len(self.piece):
            self._arc_room(2 * (self.arcs + total_arcs))
        a, b = self.arcs, self.arcs + total_arcs
        self.piece[a:b], self.length[a:b], self.log_p[a:b], self.upto[a:b] = pieces, length, log_p, upto
        self.lo[self.nodes : self.nodes + nodes], self.count[self.nodes : self.nodes + nodes] = lo + a, count
        # favourites: the likeliest arc of each node, followed from each stretch's begin
        top = np.maximum.reduceat(log_p, lo)
        best = np.minimum.reduceat(np.where(log_p == np.repeat(top, count), np.arange(total_arcs), total_arcs), lo)
        at_node, live, steps = base.copy(), np.arange(len(size)), []
        while len(live):
            arc = best[at_node[live]]
            steps.append((live, arc))
            at_node[live] += length[arc]
            live = live[at_node[live] < (base + size)[live]]
        owners, arcs = np.concatenate([x for x, _ in steps]), np.concatenate([x for _, x in steps])
        order = np.argsort(owners, kind="stable")
        owners, arcs = owners[order], arcs[order]
        n = np.bincount(owners, minlength=len(size))
        starts = np.cumsum(n) - n
        run = np.cumsum(log_p[arcs])
        run -= np.repeat((run - log_p[arcs])[starts], n)
        self.fav_lo = np.concatenate([self.fav_lo, starts + len(self.fav_arc)])
        self.fav_n = np.concatenate([self.fav_n, n])
        self.fav_arc = np.concatenate([self.fav_arc, (arcs + a).astype(np.int32)])
        self.fav_stay = np.concatenate([self.fav_stay, np.exp(run)])
        self.fav_log = np.concatenate([self.fav_log, run[starts + n - 1]])
        self.base = np.concatenate([self.base, base + self.nodes])
        self.nodes, self.arcs = self.nodes + nodes, b


def _truncated(mass: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values of location ``mass`` (log), none above ``top``."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(np.isneginf(mass), -np.inf, -np.logaddexp(-top, np.log(-np.log(u)) - mass))


class _Numbers:
    """Numbers in (0, 1) in a row, by row key and sample, for what a pop needs."""

    def __init__(self, key: int, sample: int) -> None:
        self.state = (key + (sample + 1) * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF

    def __call__(self) -> float:
        self.state = x = (self.state + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        return (((x ^ (x >> 31)) >> 11) + 0.5) * 2.0**-53

    def gumbel(self, mass: float, top: float) -> float:
        """Of location ``mass``, not above ``top``."""
        x, y = -top, math.log(-math.log(self())) - mass
        high = max(x, y)
        return -(high + math.log(math.exp(x - high) + math.exp(y - high)))


class _Paths:
    """Arc lists in one growing array."""

    def __init__(self) -> None:
        self.n = self.used = 0
        self.arc, self.lo, self.size, self.log = np.empty(1 << 12, np.int32), np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int64), np.empty(1 << 10)

    def add(self, arcs: np.ndarray, sizes: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Numbers of the lists that lie end to end in ``arcs``."""
        while self.used + len(arcs) > len(self.arc):
            self.arc = np.concatenate([self.arc, np.empty_like(self.arc)])
        while self.n + len(sizes) > len(self.lo):
            self.lo, self.size, self.log = (np.concatenate([x, np.empty_like(x)]) for x in (self.lo, self.size, self.log))
        self.arc[self.used : self.used + len(arcs)] = arcs
        own = slice(self.n, self.n + len(sizes))
        self.lo[own], self.size[own], self.log[own] = np.cumsum(sizes) - sizes + self.used, sizes, logs
        self.used, self.n = self.used + len(arcs), self.n + len(sizes)
        return np.arange(own.start, own.stop)

    def __getitem__(self, i: int) -> list[int]:
        return self.arc[self.lo[i] : self.lo[i] + self.size[i]].tolist()


class _Batch:
    """The search over a batch of texts.  A sample of a text is a state for each of its stretches: -1 for the
    favourite, else the number of a path of its own in ``paths``."""

    def __init__(self, m: Model, texts: list[str | None], row_keys: np.ndarray, k: int, seed: int) -> None:
        self.m, self.k, self.n = m, k, len(texts)
        normal = [m.processor.normalize(t) if t else "" for t in texts]
        codes = np.frombuffer("".join(normal).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(x) for x in normal], np.int64)
        ends_of_text = np.cumsum(sizes)
        self.keys = _mix(row_keys.astype(np.uint64) ^ _mix(np.array([seed], np.uint64)))
        mark = codes == ord("▁")
        begin = mark.copy()
        begin[1:] &= ~mark[:-1]
        begin[(ends_of_text - sizes)[sizes > 0]] = True
        begins = np.flatnonzero(begin)
        ends = np.append(begins[1:], len(codes)) if len(codes) else begins
        self.lattice = m.lattice
        self.stretch = self.lattice.place(codes, begins, ends) if len(codes) else begins
        self.a = np.searchsorted(begins, ends_of_text - sizes)  # stretches of each text: a..b
        self.b = np.searchsorted(begins, ends_of_text)
        self.text = np.repeat(np.arange(self.n), self.b - self.a)
        self.place_in_text = np.arange(len(begins)) - self.a[self.text]
        self.size = ends - begins
        self.states: list[np.ndarray] = []
        self.paths = _Paths()
        self.found: list[list[tuple[int, float, float]]] = [[] for _ in texts]  # sample, log p, value
        self.frontier: list[list[tuple]] = [[] for _ in texts]
        self.thresholds = np.full(self.n, -np.inf)

    def sample(self, number: int, at: np.ndarray) -> None:
        """States of a sample for the stretches ``at``."""
        l, state = self.lattice, self.states[number]
        own = self.stretch[at]
        u = uniform(self.keys[self.text[at]], number, self.place_in_text[at])
        state[at] = -1
        odd = np.flatnonzero(u >= l.fav_stay[l.fav_lo[own] + l.fav_n[own] - 1])
        if len(odd):
            state[at[odd]] = self._leaving(number, at[odd], u[odd])

    def _leaving(self, number: int, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Paths that leave the favourite where the chance to stay falls below ``u``."""
        l, own = self.lattice, self.stretch[at]
        lo, node = l.fav_lo[own], l.base[own].copy()
        end, stays = node + self.size[at], np.zeros(len(at), np.int64)
        on = np.arange(len(at))
        while True:
            here = lo[on] + stays[on]
            on, here = on[u[on] < l.fav_stay[here]], here[u[on] < l.fav_stay[here]]
            if not len(on):
                break
            node[on] += l.length[l.fav_arc[here]]
            stays[on] += 1
        key = self.keys[self.text[at]] ^ (self.place_in_text[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        # another piece than the favourite's, by its chance among the others
        avoided = l.fav_arc[lo + stays]
        left = uniform(key, number, np.zeros(len(at))) * -np.expm1(np.minimum(l.log_p[avoided].astype(np.float64), 0.0))
        arc, last = l.lo[node].astype(np.int64), l.lo[node].astype(np.int64) + l.count[node] - 1
        last -= last == avoided
        arc += arc == avoided
        on = np.arange(len(at))
        while len(on):
            left[on] -= np.exp(l.log_p[arc[on]].astype(np.float64))
            on = on[(left[on] >= 0) & (arc[on] < last[on])]
            arc[on] += 1
            arc[on] += arc[on] == avoided[on]
        node += l.length[arc]
        total = l.log_p[arc].astype(np.float64)
        steps, on = [], np.flatnonzero(node < end)
        while len(on):
            next_ = l.lo[node[on]].astype(np.int64)
            v = uniform(key[on], number, np.full(len(on), len(steps) + 1))
            more = np.flatnonzero(v > l.upto[next_])
            while len(more):
                next_[more] += 1
                more = more[v[more] > l.upto[next_[more]]]
            steps.append((on, next_))
            total[on] += l.log_p[next_]
            node[on] += l.length[next_]
            on = on[node[on] < end[on]]
        sizes = stays + 1
        for on, _ in steps:
            sizes[on] += 1
        starts = np.cumsum(sizes) - sizes
        arcs = np.empty(int(sizes.sum()), np.int32)
        before = np.arange(int(stays.sum())) - np.repeat(np.cumsum(stays) - stays, stays)
        kept = l.fav_arc[before + np.repeat(lo, stays)]
        arcs[before + np.repeat(starts, stays)] = kept
        arcs[starts + stays] = arc
        for i, (on, next_) in enumerate(steps):
            arcs[starts[on] + stays[on] + 1 + i] = next_
        total += np.bincount(np.repeat(np.arange(len(at)), stays), l.log_p[kept], len(at))
        return self.paths.add(arcs, sizes, total)

    def _choose(self, node: int, gone: set[int], numbers: _Numbers) -> int:
        l = self.lattice
        own = [x for x in range(int(l.lo[node]), int(l.lo[node]) + int(l.count[node])) if x not in gone]
        p = [math.exp(l.log_p[x]) for x in own]
        u = numbers() * sum(p)
        for x, q in zip(own, p):
            u -= q
            if u < 0:
                return x
        return own[max(range(len(p)), key=p.__getitem__)]

    def _finish(self, arcs: list[int], node: int, end: int, numbers: _Numbers) -> int:
        """Numbers a path that begins with ``arcs`` and is sampled from ``node`` on."""
        l = self.lattice
        while node < end:
            arc, u = int(l.lo[node]), numbers()
            while u > l.upto[arc]:
                arc += 1
            arcs.append(arc)
            node += int(l.length[arc])
        return int(self.paths.add(np.array(arcs, np.int32), np.array([len(arcs)]), np.array([sum(float(l.log_p[x]) for x in arcs)]))[0])

    def arcs_of(self, number: int, at: int) -> list[int]:
        """The arcs of a sample in one stretch."""
        state, l = int(self.states[number][at]), self.lattice
        if state >= 0:
            return self.paths[state]
        lo = int(l.fav_lo[self.stretch[at]])
        return l.fav_arc[lo : lo + int(l.fav_n[self.stretch[at]])].tolist()

    def log_of(self, number: int, at: np.ndarray) -> np.ndarray:
        state = self.states[number][at]
        out = self.lattice.fav_log[self.stretch[at]]
        own = np.flatnonzero(state >= 0)
        out[own] = self.paths.log[state[own]]
        return out

    def leave(self, number: int, rows: list[tuple[int, int, float, float]]) -> None:
        """Logs new samples and leaves the sets beside them: rows of text, first stretch that is new, log p before it, value."""
        of, first = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        before, top = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        n = self.b[of] - first
        ends = np.cumsum(n)
        starts = ends - n
        row = np.repeat(np.arange(len(rows)), n)
        at = np.arange(int(n.sum())) + (first - starts)[row]
        log_p = self.log_of(number, at)
        run = np.concatenate([[0.0], np.cumsum(log_p)])
        prior = run[:-1] + (before - run[starts])[row]
        u = uniform(self.keys[self.text[at]], (1 << 21) + number, self.place_in_text[at])
        value = np.full(len(at), -np.inf)

        def fill(own: np.ndarray) -> None:
            with np.errstate(divide="ignore"):
                value[own] = _truncated(prior[own] + np.log(-np.expm1(np.minimum(log_p[own], 0.0))), top[row[own]], u[own])

        # the first stretches of each text in full; they bound what the others must exceed
        near = np.arange(len(at)) - starts[row] < 24
        fill(np.flatnonzero(near))
        least = np.full(len(rows), -np.inf)
        for j, (a, b) in enumerate(zip(starts.tolist(), np.minimum(ends, starts + 24).tolist())):
            if b - a > self.k:
                least[j] = np.partition(value[a:b], b - a - self.k - 1)[b - a - self.k - 1]
        with np.errstate(over="ignore"):  # value > least needs -log(u) < exp(prior - least), and 1 - u is below that
            fill(np.flatnonzero(~near & (1 - u < np.exp(prior - least[row]))))
        hopeful = np.flatnonzero((value >= least[row]) & ~np.isneginf(value))
        bounds = np.searchsorted(hopeful, np.append(starts, len(at)))
        for j, (i, _, start, own_value) in enumerate(rows):
            self.found[i].append((number, start + float(run[ends[j]] - run[starts[j]]), own_value))
            for x in hopeful[bounds[j] : bounds[j + 1]].tolist():
                self.frontier[i].append((float(value[x]), number, int(at[x]), None, None, float(prior[x])))

    def pop(self, i: int, number: int) -> tuple[int, int, float, float] | None:
        """Takes the best set of text ``i`` and settles its stretch: text, next stretch, log p up to it, value; the rest of its states are copied or to be sampled."""
        own = self.frontier[i]
        if not own:
            return None
        value, parent, at, prefix, gone, prior = own.pop(max(range(len(own)), key=lambda j: own[j][0]))
        if number == self.k:
            self.thresholds[i] = value  # what would come next
            return None
        l, numbers = self.lattice, _Numbers(int(self.keys[i]), (1 << 22) + number)
        base = int(l.base[self.stretch[at]])
        end = base + int(self.size[at])

        def node_after(arcs: list[int]) -> int:
            return base + sum(int(l.length[x]) for x in arcs)

        if prefix is None:  # all but the parent's path in this stretch: tell apart by where they leave it
            arcs, sets, stay = self.arcs_of(parent, at), [], 0.0
            for j, arc in enumerate(arcs):
                p = float(l.log_p[arc])
                if l.count[node_after(arcs[:j])] > 1:
                    sets.append((prior + stay + math.log(max(-math.expm1(min(p, 0.0)), 1e-300)), arcs[:j], (arc,), prior + stay))
                stay += p
            high = max(x[0] for x in sets)
            u = numbers() * sum(math.exp(x[0] - high) for x in sets)
            taken = len(sets) - 1
            for j, x in enumerate(sets):
                u -= math.exp(x[0] - high)
                if u < 0:
                    taken = j
                    break
            for j, (mass, arcs_before, out, prior_j) in enumerate(sets):
                if j != taken:
                    own.append((numbers.gumbel(mass, value), parent, at, arcs_before, out, prior_j))
            _, prefix, gone, prior = sets[taken]
        node = node_after(prefix)
        arc = self._choose(node, set(gone), numbers)
        path = self._finish([*prefix, arc], node + int(l.length[arc]), end, numbers)
        others = [float(l.log_p[x]) for x in range(int(l.lo[node]), int(l.lo[node]) + int(l.count[node])) if x != arc and x not in gone]
        if others:
            own.append((numbers.gumbel(prior + math.log(sum(map(math.exp, others)) or 1e-300), value), parent, at, prefix, (*gone, arc), prior))
        run, whole = prior, self.paths[path]
        for j in range(len(prefix), len(whole)):
            p = float(l.log_p[whole[j]])
            if j > len(prefix) and l.count[node_after(whole[:j])] > 1:
                own.append((numbers.gumbel(run + math.log(max(-math.expm1(min(p, 0.0)), 1e-300)), value), number, at, whole[:j], (whole[j],), run))
            run += p
        state = self.states[number]
        state[self.a[i] : at] = self.states[parent][self.a[i] : at]
        state[at] = path
        return i, at + 1, run, value

    def search(self) -> None:
        roots = -np.log(-np.log(uniform(self.keys, 1 << 20, np.zeros(self.n))))
        self.states.append(np.empty(len(self.stretch), np.int32))
        self.sample(0, np.arange(len(self.stretch)))
        self.leave(0, [(i, int(self.a[i]), 0.0, float(roots[i])) for i in range(self.n)])
        for number in range(1, self.k + 1):
            self.states.append(np.full(len(self.stretch) * (number < self.k), -1, np.int32))
            rows = [x for x in (self.pop(i, number) for i in range(self.n)) if x]
            if rows:
                self.sample(number, np.concatenate([np.arange(t, self.b[i]) for i, t, *_ in rows]))
                self.leave(number, rows)

    def ids(self, number: int) -> list[np.ndarray]:
        """Piece ids of a sample, for every text."""
        l, state, paths = self.lattice, self.states[number], self.paths
        if not len(state):
            return [np.zeros(0, np.int32)] * self.n
        odd = state >= 0
        n = np.where(odd, paths.size[np.maximum(state, 0)], l.fav_n[self.stretch])
        lo = np.where(odd, paths.lo[np.maximum(state, 0)], l.fav_lo[self.stretch])
        starts = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(lo - starts, n)
        own = np.repeat(odd, n)
        arcs = np.empty(len(at), np.int32)
        arcs[~own], arcs[own] = l.fav_arc[at[~own]], paths.arc[at[own]]
        pieces = l.piece[arcs]
        bounds = np.append(starts, len(at))
        out = [pieces[x:y] for x, y in zip(bounds[self.a].tolist(), bounds[self.b].tolist())]
        if l.plain or (pieces >= 0).all():
            return out
        return [x if (x >= 0).all() else np.array([i for p in x.tolist() for i in ((p,) if p >= 0 else self.m.bytes[list(chr(-2 - p).encode("utf-8", "surrogatepass"))].tolist())], np.int32) for x in out]


def samples_of(m: Model, texts: list[str | None], row_keys: np.ndarray, k: int = SAMPLES, seed: int = 1) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k of (piece ids, log probability, perturbed value, inclusion score)."""
    search = _Batch(m, texts, row_keys, k, seed)
    search.search()
    out, ids = [], [search.ids(number) for number in range(k)]
    for i in range(len(texts)):
        kappa = search.thresholds[i]
        out.append([(ids[number][i], log_p, value, 1.0 if np.isneginf(kappa) else -math.expm1(-math.exp(min(log_p - kappa, 50.0)))) for number, log_p, value in search.found[i]])
    return out


def decoded(m: Model, ids: np.ndarray) -> str:
    """The normalised text that ids stand for, without the leading space mark."""
    return m.processor.decode(ids.tolist())


def sampled(docs: DataFrame, k: int = SAMPLES, file: str = "piece_bpe_32k.model", seed: int = 1, with_ids: bool = True) -> DataFrame:
    """doc_id, sample, n_pieces, ids_crc32, log_prob, perturbed, inclusion (and ids) of every sample."""
    names = ["doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "inclusion", *["ids"] * with_ids]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), *[pa.list_(pa.int32())] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(file)
        for batch in in_slices(batches, "text", 1 << 19):
            docs_, rows = batch.column("doc_id").to_pylist(), []
            got = samples_of(m, batch.column("text").to_pylist(), np.array([d or 0 for d in docs_], np.int64), k, seed)
            for doc, found in zip(docs_, got):
                for n, (ids, log_p, value, score) in enumerate(found):
                    rows.append((doc, n, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), log_p, value, score, *[ids.astype(np.int32)] * with_ids))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    shape = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, shape)


def decoded_samples(samples: DataFrame, file: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, sample, text of every sample with its ids: the normalised text, whichever way it was segmented."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(file)
        for batch in batches:
            texts = m.processor.decode(batch.column("ids").to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sample"), pa.array(texts, pa.string())], names=["doc_id", "sample", "text"])

    return samples.select("doc_id", "sample", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, sample int, text string")


def op10_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(table(spark, sf_dir, "documents"), with_ids=False)
