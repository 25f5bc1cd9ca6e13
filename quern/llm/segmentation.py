"""SentencePiece segmentations sampled without replacement, and their decoding."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SPACE = "▁"
SUB, ROWS = 200_000, 500  # characters and rows of the documents walked together
KEPT = 1_000_000  # characters of units whose lattices a worker keeps; with more, it begins anew
SMOOTHING = 0.5  # 1: nearly always the likeliest path; 0: all pieces alike
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((x >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def gumbel(x: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(uniform(x)))


class Pieces:
    """The vocabulary as a trie, with piece weights that fall with the rank: (rank + 10) ** -SMOOTHING."""

    loaded: dict[str, Pieces] = {}

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        own: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        pieces: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                own.append(bytes([int(piece[1:-1], 16)]))
                continue
            own.append(piece.replace(SPACE, " ").encode())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[piece] = i
        self.blob = np.frombuffer(b"".join(own), np.uint8)
        self.size = np.fromiter(map(len, own), np.int64, len(own))
        self.first = np.cumsum(self.size) - self.size
        # Characters in pieces of two or more have a class each, all others the last one.
        chars = sorted({c for p in pieces if len(p) > 1 for c in p})
        self.classes = len(chars) + 1
        self.klass = np.full(0x110000, len(chars), np.int32)
        self.klass[list(map(ord, chars))] = np.arange(len(chars))
        self.klass[ord(" ")], self.klass[ord(SPACE)] = self.klass[ord(SPACE)], len(chars)
        at = {c: k for k, c in enumerate(chars)}
        #: Pairs of classes that are neighbours in a piece; between any others no piece reaches.
        self.pair = np.zeros((self.classes, self.classes), bool)
        self.single = np.full(0x110000, -1, np.int32)
        nodes: dict[str, int] = {"": 0}
        for p, i in pieces.items():
            if len(p) == 1:
                self.single[ord(p)] = i
                continue
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes))
            for a, b in zip(p, p[1:]):  # noqa: B905
                self.pair[at[a], at[b]] = True
        self.single[ord(" ")], self.single[ord(SPACE)] = self.single[ord(SPACE)], -1
        for c in range(128):  # an ASCII character without a piece is one byte's piece
            if self.single[c] < 0:
                self.single[c] = self.byte_id[c]
        self.root = np.full(self.classes, -1, np.int64)
        self.piece = np.full(len(nodes), -1, np.int32)
        steps = {}
        for p, k in nodes.items():
            if len(p) == 1:
                self.root[at[p]] = k
            elif p:
                steps[nodes[p[:-1]] * self.classes + at[p[-1]]] = k
                self.piece[k] = pieces.get(p, -1)
        # The steps as a hash table of places that follow each other, a quarter of them taken at most.
        bits = (4 * len(steps)).bit_length()
        self.shift, self.keys, self.next = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        keys = np.fromiter(steps, np.int64, len(steps))
        for key, at in zip(keys.tolist(), self._at(keys).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.next[at] = key, steps[key]
        self.longest = max(map(len, nodes))
        rank = np.arange(len(own) + 1)  # the last: a character's bytes
        self.log_weight = -SMOOTHING * np.log(rank + 10.0)

    @classmethod
    def of(cls, model: str) -> Pieces:
        if model not in cls.loaded:
            cls.loaded = {model: cls(model)}
        return cls.loaded[model]

    def follow(self, node: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """The node that each node's class leads to, -1 for none."""
        key = node * self.classes + klass
        at = self._at(key)
        found = self.keys[at]
        on = np.flatnonzero((found != key) & (found >= 0))
        while len(on):
            at[on] = (at[on] + 1) % len(self.keys)
            found[on] = self.keys[at[on]]
            on = on[(found[on] != key[on]) & (found[on] >= 0)]
        return np.where(found == key, self.next[at], -1)

    def _at(self, key: np.ndarray) -> np.ndarray:
        """Where the search for each key begins."""
        return ((key.astype(np.uint64) * STEP) >> self.shift).astype(np.int64)

    def plain(self, ids: np.ndarray) -> np.ndarray:
        """ids, with the bytes' pieces for characters without a piece, which are given as -1 - code point."""
        if not len(ids) or ids.min() >= 0:
            return ids
        bytes_of = {i: [self.byte_id[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")] for i in np.unique(ids[ids < 0]).tolist()}
        return np.array([x for i in ids.tolist() for x in (bytes_of[i] if i < 0 else (i,))], np.int32)

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The texts of segmentations in UTF-8; encode's inverse."""
        each = np.concatenate([np.zeros(0, np.int32), *ids])
        n = self.size[each]
        to = np.concatenate([[0], np.cumsum(n)])
        whole = self.blob[np.repeat(self.first[each] - to[:-1], n) + np.arange(to[-1])].tobytes()
        ends = to[np.cumsum([0, *map(len, ids)])].tolist()
        return [whole[a + 1 : b] for a, b in zip(ends, ends[1:])]  # noqa: B905


class Lattices:
    """The lattices of distinct units, in one table of edges, and walks through them.

    A unit is what no piece reaches across: texts are cut wherever two neighbours stand together in no piece. Edges stand by their
    start, likeliest first; `logp` is an edge's share of the paths from its start, `within` the share of it and those before it; `to` is
    -1 where the unit ends. A character without a piece, U+2581 itself among them, is one edge for all its bytes.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.unit_count, self.places, self.edges = 0, 0, 0
        self.start = np.zeros(1 << 12, np.int64)  # by unit: its first place
        self.first_edge = np.zeros(1 << 15, np.int64)  # by place
        self.to, self.ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.within, self.logp = np.zeros(1 << 16), np.zeros(1 << 16)

    def _append(self, name: str, at: int, values: np.ndarray) -> None:
        """Puts `values` at `at` of a table that grows by a quarter when it is full."""
        old = getattr(self, name)
        if at + len(values) > len(old):
            new = np.zeros((at + len(values)) * 5 // 4, old.dtype)
            new[:at] = old[:at]
            setattr(self, name, new)
        getattr(self, name)[at : at + len(values)] = values

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all units of the texts, each after one space, and how many each text has; new ones' lattices are built."""
        whole = "".join([" " + t for t in texts])
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        klass = self.pieces.klass[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        new = np.concatenate([[True], ~self.pieces.pair[klass[:-1], klass[1:]]])
        begin = np.cumsum(size) - size
        new[begin] = True
        cuts = np.append(np.flatnonzero(new), len(whole))
        ends = cuts.tolist()
        before = len(self.known)
        unit = np.fromiter(map(self.known.__getitem__, [whole[a:b] for a, b in zip(ends, ends[1:])]), np.int64, len(ends) - 1)  # noqa: B905
        if len(self.known) > before:
            self._build(list(islice(self.known, before, None)))
        return unit, np.diff(np.append(np.searchsorted(cuts, begin), len(ends) - 1))

    def _build(self, units: list[str]) -> None:
        pieces = self.pieces
        size = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        total = len(chars)
        begin = np.cumsum(size) - size
        stop = np.repeat(begin + size, size)  # by place: where its unit ends
        klass, single = pieces.klass[chars], pieces.single[chars]
        starts, ends, ids = [np.arange(total)], [np.arange(1, total + 1)], [np.where(single >= 0, single, -1 - chars)]
        at = np.arange(total)
        node = pieces.root[klass]
        for n in range(2, pieces.longest + 1):
            on = (node >= 0) & (at + n <= stop[at])
            at = at[on]
            node = pieces.follow(node[on], klass[at + n - 1])
            hit = node >= 0
            at, node = at[hit], node[hit]
            hit = pieces.piece[node] >= 0
            starts.append(at[hit])
            ends.append(at[hit] + n)
            ids.append(pieces.piece[node[hit]])
        # Edges by start and length; `starts` go by length, and none has a place twice.
        n_edges = np.bincount(np.concatenate(starts), minlength=total)
        first = np.cumsum(n_edges) - n_edges
        start, free = np.repeat(np.arange(total), n_edges), first.copy()
        end, own = np.empty(len(start), np.int64), np.empty(len(start), np.int32)
        for s, e, i in zip(starts, ends, ids, strict=True):
            end[free[s]], own[free[s]] = e, i
            free[s] += 1
        ids, inner = own, end < stop[start]
        # What an edge leads to comes before it: places by how far they are from the unit's end.
        far = stop - np.arange(total)
        most = int(size.max(initial=0))
        by_far = np.argsort(far.astype(np.uint16) if most < 1 << 16 else far, kind="stable")
        n = n_edges[by_far]
        to = np.append(0, np.cumsum(n))
        order = np.repeat(first[by_far] - to[:-1], n) + np.arange(len(start))
        inside, ends, head = inner[order], end[order], to[:-1]
        weight = pieces.log_weight[np.where(ids >= 0, ids, -1)][order]
        done = np.zeros(total + 1)  # by place: log of the weight of all paths from there
        cuts = np.searchsorted(far[by_far], np.arange(1, most + 2))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if i < j:
                a, b = to[i], to[j]
                weight[a:b] += np.where(inside[a:b], done[ends[a:b]], 0.0)
                done[by_far[i:j]] = np.logaddexp.reduceat(weight[a:b], head[i:j] - a)
        logp = np.empty(len(start))
        logp[order] = weight
        logp -= done[start]
        some, order = np.flatnonzero(n_edges[start] > 1), np.arange(len(start))
        order[some] = some[np.argsort((start[some] * 65_536 + np.minimum(-64 * logp[some], 65_535).astype(np.int64)) * (pieces.longest + 1) + (end[some] - start[some]))]
        end, ids, inner, logp = end[order], ids[order], inner[order], logp[order]
        within = np.exp(logp)
        rank = np.arange(len(start)) - first[start]
        by_rank = np.argsort(rank.astype(np.uint16), kind="stable")  # a place has an edge for each length of a piece at most
        cuts = np.searchsorted(rank[by_rank], np.arange(1, int(rank.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            within[by_rank[a:b]] += within[by_rank[a:b] - 1]
        within[np.append(first[1:], len(start)) - 1] = 1.0
        base, edges = self.places, self.edges
        self._append("start", self.unit_count, begin + base)
        self._append("first_edge", base, np.append(first, len(start)) + edges)
        for name, values in (("to", np.where(inner, end + base, -1)), ("ids", ids), ("within", within), ("logp", logp)):
            self._append(name, edges, values)
        self.unit_count, self.places, self.edges = self.unit_count + len(units), base + total, edges + len(start)

    def walk(self, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From each place (-1: none) a path to its unit's end, drawn by its key: how many edges, all edges, log probabilities."""
        who, total, count = np.flatnonzero(at >= 0), np.zeros(len(at)), np.zeros(len(at), np.int64)
        at, steps = at[who], []
        while len(who):
            u = uniform(mix(key[who] + np.uint64(len(steps) + 1)))
            e = self.first_edge[at]
            more = np.flatnonzero(self.within[e] < u)
            while len(more):
                e[more] += 1
                more = more[self.within[e[more]] < u[more]]
            total[who] += self.logp[e]
            count[who] += 1
            steps.append((who, e))
            at = self.to[e]
            on = at >= 0
            at, who = at[on], who[on]
        offset = np.cumsum(count) - count
        edges = np.empty(int(count.sum()), np.int64)
        for k, (who, e) in enumerate(steps):
            edges[offset[who] + k] = e
        return count, edges, total

    def free(self, paths: list[list[int]]) -> list[tuple[list[int], int, float]]:
        """All ways to leave every one of `paths` through a unit: edges shared with some, the first own edge, log probability."""
        out, open_ = [], [(0, 0.0, paths)]
        while open_:
            n, before, own = open_.pop()
            place = int(np.searchsorted(self.first_edge[: self.places], own[0][n], "right")) - 1
            by: dict[int, list[list[int]]] = {}
            for p in own:
                by.setdefault(p[n], []).append(p)
            a, b = self.first_edge[place], self.first_edge[place + 1]
            for e, lp in zip(range(a, b), self.logp[a:b].tolist(), strict=True):
                if e not in by:
                    out.append((own[0][:n], e, before + lp))
                elif self.to[e] >= 0:
                    open_.append((n + 1, before + lp, by[e]))
        return out


class Sample(NamedTuple):
    """A segmentation: its edges, how many of them and what log probability stand before each unit and at the end, its perturbed value."""

    edges: np.ndarray
    cuts: np.ndarray
    along: np.ndarray
    value: float


def _rest(p: np.ndarray) -> np.ndarray:
    """log(1 - exp(p)), -inf where nothing is left."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(np.minimum(p, 0.0)))


def _under(bound: np.ndarray, mass: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The greatest perturbed values of sets of these log masses, given that `bound` is the greatest of their union."""
    return -np.logaddexp(-bound, -(mass + gumbel(key)))


def segment(lattices: Lattices, texts: list[str], seeds: np.ndarray, k: int) -> list[tuple[list[Sample], float]]:
    """For each text k distinct segmentations (all, if it has fewer), and the best perturbed value among the others.

    A-star over sets of segmentations, by the greatest perturbed log probability in each: each text's queue begins with the set of
    all. k times its best set is taken out; a segmentation drawn from it is the next sample, and the set's others are split by the
    unit at which they leave that sample and queued. All texts' sets of a round are walked together.
    """
    unit, size = lattices.units(texts)
    ends = np.cumsum(size)
    base = np.repeat(mix(seeds), size) + (np.arange(len(unit)) - np.repeat(ends - size, size)).astype(np.uint64) * STEP
    salted = lambda keys, r, what: mix(keys + np.uint64(8 * r + what))
    start = lattices.start[unit]
    tops = gumbel(salted(base[ends - size], 0, 0)) if len(texts) else np.zeros(0)
    #: Sets by text: their greatest value, negative; a number; the sample they share all before a unit with; the unit; the paths left out there.
    queues: list[list[tuple]] = [[(-float(v), 0, None, 0, [])] for v in tops]
    out: list[list[Sample]] = [[] for _ in texts]
    for r in range(k):
        taken, parts, firsts = [], [], []
        for d, queue in enumerate(queues):
            if not queue:
                continue
            value, _, parent, j, without = heapq.heappop(queue)
            a = int(ends[d] - size[d])
            head, lp, at = [], 0.0, start[a + j]
            if without:
                ways = lattices.free(without)
                share = np.cumsum(np.exp([w[2] for w in ways]))
                u = float(uniform(salted(base[a + j : a + j + 1], r, 1))[0])
                shared, e, lp = ways[min(int(np.searchsorted(share, u * share[-1])), len(ways) - 1)]
                head, at = [*shared, e], lattices.to[e]
            taken.append((d, -value, parent, j, without, head, lp))
            firsts.append(at)
            parts.append((a + j, a + int(size[d])))
        if not taken:
            break
        n = np.array([b - a for a, b in parts])
        begin = np.cumsum(n) - n
        tail = np.repeat(np.array([a for a, _ in parts]) - begin, n) + np.arange(int(n.sum()))
        at = start[tail]
        at[begin] = firsts
        count, edges, p = lattices.walk(at, salted(base[tail], r, 2))
        p[begin] += [x[-1] for x in taken]
        offset = np.concatenate([[0], np.cumsum(count)])
        before, bound = np.empty(len(tail)), np.repeat(np.array([x[1] for x in taken]), n)
        rest = _rest(p)
        for t, (d, value, parent, j, without, head, _) in enumerate(taken):
            s = slice(int(begin[t]), int(begin[t] + n[t]))
            own = edges[offset[s.start] : offset[s.stop]]
            cuts = offset[s.start : s.stop + 1] - offset[s.start]
            along = np.concatenate([[0.0], np.cumsum(p[s])])
            if parent:
                cut = int(parent.cuts[j])
                own = np.concatenate([parent.edges[:cut], np.array(head, np.int64), own])
                cuts = np.concatenate([parent.cuts[:j], cuts + (cut + len(head))])
                cuts[j] = cut
                along = np.concatenate([parent.along[:j], along + parent.along[j]])
                ways = lattices.free([*without, own[cut : cuts[j + 1]].tolist()])
                rest[s.start] = np.log(np.sum(np.exp([w[2] for w in ways]))) if ways else -np.inf
            before[s] = along[j:-1]
            out[d].append(Sample(own, cuts, along, value))
        values = _under(bound, before + rest, salted(base[tail], r, 3))
        for t, (d, _, _, j, without, _, _) in enumerate(taken):
            v = values[begin[t] : begin[t] + n[t]]
            # k - r sets of it are needed at most: for the samples to come and for the best value left.
            best = np.argpartition(-v, k - r - 1)[: k - r] if len(v) > k - r else np.arange(len(v))
            new = out[d][-1]
            for i in best.tolist():
                if v[i] > -np.inf:
                    path = new.edges[new.cuts[j + i] : new.cuts[j + i + 1]].tolist()
                    heapq.heappush(queues[d], (-float(v[i]), len(out[d]) * len(new.cuts) + j + i, new, j + i, [*without, path] if i == 0 else [path]))
    return [(own, -queue[0][0] if queue else -np.inf) for own, queue in zip(out, queues, strict=True)]


def inclusion(log_prob: float, left: float) -> float:
    """The chance that a segmentation's perturbed value is above `left`, the best value among those not drawn."""
    return float(-np.expm1(-np.exp(min(log_prob - left, 700.0)))) if left > -np.inf else 1.0


def _blocks(texts: list[str]) -> Iterator[slice]:
    a, n = 0, 0
    for k, t in enumerate(texts):
        if n and n + len(t) > SUB:
            yield slice(a, k)
            a, n = k, 0
        n += len(t)
    if len(texts) > a:
        yield slice(a, len(texts))


def _column(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def _encode(model: str, samples: int):
    def run(batches):
        pieces = Pieces.of(model)
        lattices = Lattices(pieces)
        for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, len(whole), ROWS)):
            texts = b.column("text").to_pylist()
            seeds = b.column("seed").to_numpy().view(np.uint64)
            for s in _blocks(texts):
                if lattices.places > KEPT:
                    lattices = Lattices(pieces)
                row, rank, ids, facts = [], [], [], []
                for i, (own, left) in zip(range(s.start, s.stop), segment(lattices, texts[s], seeds[s], samples), strict=True):
                    for k, x in enumerate(own):
                        ids.append(pieces.plain(lattices.ids[x.edges]))
                        row.append(i)
                        rank.append(k)
                        facts.append((len(ids[-1]), x.along[-1], x.value, inclusion(x.along[-1], left)))
                decoded = pieces.decode(ids)
                raw = [t.encode("utf-8", "surrogatepass") for t in texts[s]]
                same = [d == raw[i - s.start] for i, d in zip(row, decoded, strict=True)]
                n, lp, value, score = zip(*facts, strict=True)
                out = [
                    b.column("doc_id").take(pa.array(row)), pa.array(rank, pa.int32()), pa.array(n, pa.int32()), pa.array(np.round(lp, 6)), pa.array(np.round(value, 6)),
                    pa.array(np.round(score, 9)), _column(ids, pa.int32()), pa.array(decoded, pa.binary()).cast(pa.string()), pa.array(same),
                ]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "ids", "decoded", "round_trip"])

    return run


def encode(documents: DataFrame, model: str = MODEL, samples: int = SAMPLES) -> DataFrame:
    """`samples` distinct segmentations of each whole text, sampled without replacement, seeded by doc_id.

    Returns doc_id, sample (0 first), n_pieces, log_prob, perturbed (falls with sample), inclusion (0 to 1), ids, decoded (the text
    of the ids) and round_trip (whether that is the text). A text with fewer segmentations gets all it has. A null or empty text is one space,
    which has one segmentation, and decodes to the empty text. Rows with the same doc_id and text get the same samples; a null
    doc_id is seeded as such; other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.xxhash64("doc_id").alias("seed"), F.coalesce("text", F.lit("")).alias("text"))
    facts = "sample int, n_pieces int, log_prob double, perturbed double, inclusion double, ids array<int>, decoded string, round_trip boolean"
    return rows.mapInArrow(_encode(model, samples), f"doc_id {kind}, {facts}")
