"""SentencePiece encoding and decoding, with sampled segmentations by Gumbel top-k without replacement.

A text's lattice has an edge for each vocabulary piece that matches (bytes where a character has no piece). The pieces'
model holds merge ranks, not probabilities, so an edge weighs by a Zipf law over its rank. The lattice falls into units
(a word with the space in front of it) that no piece crosses; each worker keeps the units' lattices with their backward
sums, so every edge has its exact conditional probability.

The search is A* over perturbed log-probabilities: a node of the search is a prefix of choices together with all its
completions, and its key is the largest perturbed value among them. A child on the best way has its parent's key; the
rest of the children, as one bundle, has a Gumbel truncated at that key. Popping the largest key again and again gives
distinct segmentations in order of their perturbed values: a sample without replacement. The next key that would be
popped is the threshold from which each sample's inclusion score follows, 1 - exp(-exp(log p - threshold)).
Randomness is a hash of seed, row key and position, so rows give the same samples wherever they run.

Defined cases: a null or empty text has one segmentation, without pieces; a text with fewer than k segmentations gives
all of them; repeated rows give the same samples; a null row key is a key of its own; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
import zlib
from collections.abc import Generator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import CACHES, begun, ended, mapped, table, text_of
from .vectext import chunks, mix

K = 3
SEED = 20
ZIPF_SHIFT = 3.0
#: Units whose lattices a worker keeps (the earliest stay).
UNITS = 300_000

SPACE = "▁"  # the library's mark of a space
_UNIT = re.compile(r"▁*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,]?(?:[▁\n]|\Z))|▁*[^▁\n]+|▁+|\n")
#: A piece with this would go across units: a newline, a space behind something else, a full stop or comma behind a letter.
_CROSSING = re.compile(r"\n|[^▁]▁|[A-Za-zÀ-ÖØ-öø-ÿ][.,]")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _add(code: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The hash of a string with one more code point."""
    return mix((code ^ point.astype(np.uint64)) * _GOLD + np.uint64(1))


def _code(text: str) -> int:
    code = np.zeros(1, np.uint64)
    for c in text:
        code = _add(code, np.array([ord(c)]))
    return int(code[0])


class Vocabulary:
    """Pieces with their log-weights."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = [(p.piece, i) for i, p in enumerate(model.pieces) if p.type == 1]
        rank = {i: r for r, (_, i) in enumerate(sorted(normal, key=lambda x: (-model.pieces[x[1]].score, x[1])))}
        self.ids = {piece: i for piece, i in normal}
        self.weight = {i: -math.log(r + ZIPF_SHIFT) for i, r in rank.items()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.text = [p.piece for p in model.pieces]
        self.byte_weight = -math.log(len(rank) + ZIPF_SHIFT)
        self.heads = {piece[:k] for piece, _ in normal for k in range(1, len(piece) + 1)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else x.replace(SPACE, " ").encode() for i, x in enumerate(self.text)]
        self.path, self.newline = path, self.bytes.get(10)
        spec = model.normalizer_spec
        # whether the library encodes each unit as if it stood alone: plain texts, and no piece goes across units
        self.by_unit = spec.name == "identity" and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and self.newline is not None and not any(_CROSSING.search(x) for x in self.ids)
        self.library = None
        heads = sorted({piece[:k] for piece, _ in normal for k in range(1, len(piece) + 1)})
        code = np.array([_code(x) for x in heads], np.uint64)
        order = np.argsort(code)
        self.head = code[order]
        self.head_id = np.array([self.ids.get(heads[i], -1) for i in order.tolist()], np.int64)
        self.maybe = np.zeros(1 << 20, np.bool_)
        self.maybe[(self.head >> np.uint64(44)).astype(np.int64)] = True
        self.weights = np.full(len(model.pieces), -np.inf)
        for i, w in self.weight.items():
            self.weights[i] = w

    def find(self, code: np.ndarray) -> np.ndarray:
        """For hashes of strings: the piece's id, -1 for a mere beginning of pieces, -2 for neither."""
        out = np.full(len(code), -2, np.int64)
        i = np.flatnonzero(self.maybe[(code >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.head, code[i]), len(self.head) - 1)
        hit = self.head[at] == code[i]
        out[i[hit]] = self.head_id[at[hit]]
        return out

    def edges(self, s: str, at: int):
        """(piece ids, end, log-weight) of the edges that begin at a position."""
        single = False
        for end in range(at + 1, len(s) + 1):
            cut = s[at:end]
            if cut not in self.heads:
                break
            if (i := self.ids.get(cut)) is not None:
                single |= end == at + 1
                yield (i,), end, self.weight[i]
        if not single:
            raw = s[at].encode()
            ids = tuple(self.bytes[b] for b in raw) if self.bytes else (self.unknown,)
            yield ids, at + 1, self.byte_weight * len(ids)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of each text."""
        if self.library is None:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return [self.library.encode(t, num_threads=1) if t else [] for t in texts]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of each unit where it stands in a text, one after the other, and how many each has; together they are the text's."""
        joined = "\n" + "\n".join(units) + "\n"
        ids = np.array(self.encode([joined])[0][1:], np.int32)  # without the space in front
        line = np.flatnonzero(ids == self.newline)
        breaks = np.fromiter((u == "\n" for u in units), np.bool_, len(units))
        first = np.concatenate(([0], np.cumsum(1 + breaks)[:-1]))  # the newline in front of each unit; one that is a newline is followed by itself and the next
        begin = line[first] + 1
        many = np.where(breaks, 1, line[first + 1] - begin)
        take = np.arange(int(many.sum())) + np.repeat(begin - (np.cumsum(many) - many), many)
        return ids[take], many

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The UTF-8 of the text of piece ids, without a decoder's marks for broken characters."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw[1:] if raw[:1] == b" " else raw

    def decode(self, ids) -> str:
        """The text of piece ids."""
        out, raw = [], bytearray()
        for i in chain(ids, (None,)):
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            if i is not None:
                out.append(self.text[i])
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


class Lattices(dict):
    """Unit -> its first node. Flat arrays hold all edges, grouped by node; `top` is the cumulative probability within the node."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.first = np.zeros(1 << 18, np.int64)  # first edge of each node, one more than nodes
        self.top = np.zeros(1 << 20)
        self.logp = np.zeros(1 << 20, np.float32)
        self.next = np.zeros(1 << 20, np.int32)  # node, or -1 at the unit's end
        self.label = np.zeros(1 << 20, np.int32)  # piece, or -1 - number of a byte sequence
        self.rest = np.zeros(1 << 20)  # log of the chance of the node's other edges, however small; -inf only where there is none
        self.best = np.zeros(1 << 20, np.int32)  # ids of the library's encoding of each unit; unit with first node m has best[begin[m]:begin[m] + size[m]]
        self.begin, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)
        self.encoded = 0
        self.nodes = self.edges = 0
        self.sequences: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.fresh: dict[str, int] = {}

    def nodes_of(self, parts: list[list[str]]) -> np.ndarray:
        """First nodes of all units, in order; lattices that are missing are built together."""
        flat, self.fresh = list(chain.from_iterable(parts)), {}
        out = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        if self.fresh:
            built = self._build(list(self.fresh))
            late = np.flatnonzero(out < 0)
            out[late] = built[-1 - out[late]]
        return out

    def __missing__(self, unit: str) -> int:
        """-1 - the unit's number among those that are to be built."""
        return self.fresh.setdefault(unit, -1 - len(self.fresh))

    def _build(self, fresh: list[str]) -> np.ndarray:
        """Adds lattices: matches piece by piece length, then backward sums from the units' ends, all units at once. Their first nodes."""
        v = self.v
        point = np.frombuffer("".join(fresh).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, fresh), np.int64, len(fresh))
        end = np.repeat(np.cumsum(size), size)
        n = len(point)
        pos, code, length = np.arange(n), np.zeros(n, np.uint64), 0
        at, to, label, weight = [], [], [], []
        single = np.zeros(n, np.bool_)
        while len(pos):
            code = _add(code, point[pos + length])
            length += 1
            found = v.find(code)
            is_piece = found >= 0
            if length == 1:
                single[pos[is_piece]] = True
            at.append(pos[is_piece])
            to.append(pos[is_piece] + length)
            label.append(found[is_piece])
            weight.append(v.weights[found[is_piece]])
            on = (found > -2) & (pos + length < end[pos])
            pos, code = pos[on], code[on]
        odd = np.flatnonzero(~single)
        if len(odd):
            names, which = np.unique(point[odd], return_inverse=True)
            labels, weights = [], []
            for c in names.tolist():
                raw = chr(c).encode(errors="replace")
                ids = tuple(v.bytes[x] for x in raw) if v.bytes else (v.unknown,)
                weights.append(v.byte_weight * len(ids))
                if len(ids) == 1:
                    labels.append(ids[0])
                else:
                    if ids not in self.numbers:
                        self.sequences.append(ids)
                        self.numbers[ids] = -len(self.sequences)
                    labels.append(self.numbers[ids])
            at.append(odd)
            to.append(odd + 1)
            label.append(np.array(labels, np.int64)[which])
            weight.append(np.array(weights)[which])
        at, to, label, weight = (np.concatenate(x) for x in (at, to, label, weight))
        order = np.argsort(at, kind="stable")
        at, to, label, weight = at[order], to[order], label[order], weight[order]
        first = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=n))))
        beta = np.zeros(n + 1)
        last = to == end[at]
        left = end - np.arange(n)  # characters up to the unit's end
        by = np.argsort(left, kind="stable")
        groups = np.searchsorted(left[by], np.arange(1, int(left.max()) + 2))
        for a, b in zip(groups[:-1].tolist(), groups[1:].tolist()):
            node = by[a:b]
            many = first[node + 1] - first[node]
            head = np.cumsum(many) - many
            e = np.repeat(first[node] - head, many) + np.arange(int(many.sum()))
            x = weight[e] + np.where(last[e], 0.0, beta[np.minimum(to[e], n)])
            most = np.maximum.reduceat(x, head)
            beta[node] = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, many)), head))
        lp = weight + np.where(last, 0.0, beta[np.minimum(to, n)]) - beta[at]
        run = np.cumsum(np.exp(lp))
        run -= np.repeat((run - np.exp(lp))[first[:-1]], np.diff(first))
        run[first[1:] - 1] = 1.0
        base, e, m = self.nodes, self.edges, len(at)
        short = np.minimum(lp, 0.0).astype(np.float32)
        chance, other = np.exp(short.astype(np.float64)), np.zeros(m)
        same = np.arange(m)
        for k in range(1, m):
            same = same[: np.searchsorted(same, m - k)]
            same = same[at[same + k] == at[same]]
            if not len(same):
                break
            other[same] += chance[same + k]
            other[same + k] += chance[same]
        while e + m > len(self.top):
            for name in ("top", "logp", "next", "label", "rest"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros_like(old))))
        while base + n + 1 >= len(self.first):
            for name in ("first", "begin", "size"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros_like(old))))
        self.top[e : e + m], self.logp[e : e + m], self.label[e : e + m] = run, short, label
        with np.errstate(divide="ignore"):
            self.rest[e : e + m] = np.log(other)
        if v.by_unit:
            flat, many = v.encode_units(fresh)
            while self.encoded + len(flat) > len(self.best):
                self.best = np.concatenate((self.best, np.zeros_like(self.best)))
            node = base + np.cumsum(size) - size
            self.begin[node], self.size[node] = self.encoded + np.cumsum(many) - many, many
            self.best[self.encoded : self.encoded + len(flat)] = flat
            self.encoded += len(flat)
        self.next[e : e + m] = np.where(last, -1, base + to)
        self.first[base : base + n + 1] = e + first
        self.nodes, self.edges = base + n, e + m
        starts = base + np.cumsum(size) - size
        self.update(zip(fresh, starts.tolist()))
        return starts

    def trim(self) -> None:
        if len(self) > UNITS:
            rest = list(islice(self.items(), UNITS // 2, None))
            self.nodes = rest[0][1]
            self.edges = int(self.first[self.nodes])
            self.encoded = int(self.begin[self.nodes])
            for unit, _ in rest:
                del self[unit]


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def walk(lat: Lattices, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ways from the given nodes to the ends of their units: edges in order, and where each way begins. All ways take a step together."""
    now, who, got, step = node, np.arange(len(node)), [], 0
    while len(who):
        low, pick = lat.first[now], lat.first[now + 1] - 1
        open_ = np.flatnonzero(low < pick)
        u = uniform(seed[who[open_]] + np.uint64(((step + 1) << 32) + 1))
        while len(open_):  # from the longest piece, mostly the likeliest, to shorter ones
            down = np.flatnonzero(lat.top[pick[open_] - 1] > u)
            open_, u = open_[down], u[down]
            pick[open_] -= 1
            more = np.flatnonzero(low[open_] < pick[open_])
            open_, u = open_[more], u[more]
        got.append((who, pick))
        now = lat.next[pick].astype(np.int64)
        on = np.flatnonzero(now >= 0)
        who, now, step = who[on], now[on], step + 1
    if not got:
        return np.zeros(0, np.int64), np.zeros(len(node) + 1, np.int64)
    many = np.zeros(len(node), np.int64)
    for who, _ in got:
        many[who] += 1
    at = np.concatenate(([0], np.cumsum(many)))
    out = np.empty(int(at[-1]), np.int64)
    for step, (who, edge) in enumerate(got):
        out[at[who] + step] = edge
    return out, at


def _below(phi, limit: float, log_u):
    """Gumbels at phi, truncated at limit."""
    return phi - np.log(np.exp(phi - limit) - log_u)


class Fresh:
    """Sampled ways through units of a batch (by their numbers), with what the search needs of each choice."""

    def __init__(self, lat: Lattices, units: np.ndarray, starts: np.ndarray, seed: np.ndarray):
        self.units = units
        self.edge, self.at = walk(lat, starts, seed)
        self.run = np.concatenate(([0.0], np.cumsum(lat.logp[self.edge].astype(np.float64))))
        self.rest = lat.rest[self.edge]
        inside = np.arange(len(self.edge)) - np.repeat(self.at[:-1], np.diff(self.at))
        self.log_u = np.log(uniform(np.repeat(seed, np.diff(self.at)) + (inside.astype(np.uint64) << np.uint64(32)) + np.uint64(2)))


class Way:
    """One segmentation: choices shared with the way that it left, then a short tail to the end of the unit where it left, then fresh choices.

    keys: of the bundles of what else could have been chosen, from position `frozen` on.
    """

    def __init__(self, head: np.ndarray, head_logp: float, tail: list[int], tail_before: list[float], tail_keys: list[float], unit: int, fresh: Fresh, a: int, b: int, key: float):
        self.key, self.frozen, self.unit, self.fresh, self.a, self.b = key, len(head) + min(1, len(tail)), unit, fresh, a, b
        self.edge = np.concatenate((head, tail, fresh.edge[a:b])).astype(np.int64) if len(tail) else fresh.edge[a:b]
        self.tail_before, self.base = tail_before, head_logp  # log-probability before each later choice of the tail, and after the tail
        phi = fresh.run[a:b] + (head_logp - fresh.run[a]) + fresh.rest[a:b]
        self.keys = np.concatenate((tail_keys, _below(phi, key, fresh.log_u[a:b]))) if tail_keys else _below(phi, key, fresh.log_u[a:b])
        self.logp = float(head_logp + fresh.run[b] - fresh.run[a])
        self.taken: dict[int, list[int]] = {}

    def place(self, t: int) -> tuple[int, float]:
        """The unit of the choice behind keys[t], and the log-probability before it."""
        if t < len(self.tail_before):
            return self.unit, self.tail_before[t]
        i = self.a + t - len(self.tail_before)
        return int(self.fresh.units[np.searchsorted(self.fresh.at, i, "right") - 1]), float(self.base + self.fresh.run[i] - self.fresh.run[self.a])


class _Draws:
    """Uniform numbers from a row's seed, one after the other."""

    def __init__(self, seed: int):
        self.x = (seed ^ 0x6A09E667F3BCC909) & 0xFFFFFFFFFFFFFFFF

    def __call__(self) -> float:
        self.x = (self.x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = self.x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        return (((z ^ (z >> 31)) >> 11) + 0.5) / (1 << 53)


def _pick(weights: list[float], u: float) -> int:
    u *= sum(weights)
    for i, w in enumerate(weights):
        u -= w
        if u < 0:
            return i
    return len(weights) - 1


def top_k(lat: Lattices, first_unit: int, seed: int, k: int) -> Generator[int, tuple[Fresh, int, int], tuple[list[Way], float]]:
    """The k best ways of a text by perturbed value, in order, and the key that would come next.

    For each way yields the unit of the batch from which on it takes fresh choices, and is sent these choices, and where the
    text's begin and end there.
    """
    draw = _Draws(seed)

    def gumbel(phi: float, limit: float) -> float:
        return phi - math.log(math.exp(phi - limit) - math.log(draw()))

    f, a, b = yield first_unit
    start = Way(np.zeros(0, np.int64), 0.0, [], [], [], first_unit, f, a, b, -math.log(-math.log(draw())))
    done, heap, number = [start], [], 0

    def push(way: Way) -> None:
        nonlocal number
        if len(way.keys):
            t = int(way.keys.argmax())
            if (key := float(way.keys[t])) > -math.inf:
                number += 1
                heapq.heappush(heap, (-key, number, way, t))

    push(start)
    while len(done) < k and heap:
        key, _, way, t = heapq.heappop(heap)
        key, at = -key, way.frozen + t
        unit, before = way.place(t)
        chosen = int(way.edge[at])
        taken = way.taken.setdefault(t, [chosen])
        node = int(np.searchsorted(lat.first[: lat.nodes + 1], chosen, "right")) - 1
        rest = [e for e in range(int(lat.first[node]), int(lat.first[node + 1])) if e not in taken]
        chance = [math.exp(lat.logp[e]) for e in rest]
        pick = rest.pop(i := _pick(chance, draw()))
        before_next, left = before + float(lat.logp[pick]), sum(c for j, c in enumerate(chance) if j != i)
        taken.append(pick)
        tail, tail_before, tail_keys, now = [pick], [], [], int(lat.next[pick])
        while now >= 0:
            edges = range(int(lat.first[now]), int(lat.first[now + 1]))
            chance = [math.exp(lat.logp[e]) for e in edges]
            i = _pick(chance, draw())
            other = sum(c for j, c in enumerate(chance) if j != i)
            tail_before.append(before_next)
            tail_keys.append(gumbel(before_next + math.log(other), key) if other > 0 else -math.inf)
            tail.append(edges[i])
            before_next += float(lat.logp[edges[i]])
            now = int(lat.next[edges[i]])
        f, a, b = yield unit + 1
        new = Way(way.edge[:at], before_next, tail, tail_before, tail_keys, unit, f, a, b, key)
        done.append(new)
        way.keys[t] = gumbel(before + math.log(left), key) if rest and left > 0 else -math.inf  # what is left of the bundle
        push(way)
        push(new)
    return done, -heap[0][0] if heap else -math.inf


_STATE: dict[str, Lattices] = {}
CACHES["pieces"] = [_STATE]


def lattices(path: str) -> Lattices:
    if path not in _STATE:
        _STATE[path] = Lattices(Vocabulary(path))
    return _STATE[path]


def units(text: str) -> list[str]:
    """The text's units; joined, they are the text with a space in front and spaces marked."""
    return _UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


def sample_texts(lat: Lattices, texts: list[str], row_seed: np.ndarray, k: int, with_best: bool = False) -> list[tuple]:
    """For each text: its ways and the next key, and, if asked for, the ids of its deterministic encoding."""
    parts = [units(t) for t in texts]
    many = np.fromiter(map(len, parts), np.int64, len(parts))
    at = np.concatenate(([0], np.cumsum(many)))
    starts = lat.nodes_of(parts)
    inside = (np.arange(len(starts)) - np.repeat(at[:-1], many)).astype(np.uint64)
    row_of = np.repeat(row_seed, many)
    search = [top_k(lat, a, int(x), k) for a, x in zip(at[:-1].tolist(), row_seed)]
    found: list = [None] * len(texts)
    todo, low = list(range(len(texts))), np.fromiter(map(next, search), np.int64, len(texts))
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        for j in range(k):  # all texts' ways number j together
            size = at[1:][todo] - low
            cut = np.concatenate(([0], np.cumsum(size)))
            u = np.arange(cut[-1]) + np.repeat(low - cut[:-1], size)
            fresh = Fresh(lat, u, starts[u], mix(row_of[u] ^ ((inside[u] * np.uint64(k) + np.uint64(j + 1)) * _GOLD)))
            ends, on, wanted = fresh.at[cut].tolist(), [], []
            for i, a, b in zip(todo, ends, ends[1:]):
                try:
                    wanted.append(search[i].send((fresh, a, b)))
                    on.append(i)
                except StopIteration as e:
                    found[i] = e.value
            todo, low = on, np.array(wanted, np.int64)
            if not todo:
                break
    if not with_best:
        return found
    if not lat.v.by_unit:
        return [(*x, np.array(ids, np.int32)) for x, ids in zip(found, lat.v.encode(texts))]
    size = lat.size[starts].astype(np.int64)
    cut = np.concatenate(([0], np.cumsum(size)))
    best = lat.best[np.arange(cut[-1]) + np.repeat(lat.begin[starts] - cut[:-1], size)]
    return [(*x, best[a:b]) for x, a, b in zip(found, cut[at].tolist(), cut[at[1:]].tolist())]


def ids_of(lat: Lattices, edge: np.ndarray) -> np.ndarray:
    """Piece ids of a way."""
    label = lat.label[edge]
    if not (label < 0).any():
        return label
    return np.fromiter(chain.from_iterable(lat.sequences[-1 - x] if x < 0 else (x,) for x in label.tolist()), np.int32)


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, seed: int = SEED, model: str | None = None, with_ids: bool = True, with_digests: bool = False) -> DataFrame:
    """A row for each sampled segmentation: row key, rank, n_pieces, ids_crc32, log_prob, perturbed, inclusion, and ids if asked for.

    with_digests adds decoded_crc32 and round_trip (of the text that the row's ids decode to: its UTF-8's crc32, and whether it
    is the row's text), and encoded_pieces and encoded_crc32 (of the library's own encoding of the whole text).
    """
    path = model or default_model()

    def sampled(lat: Lattices, part: pa.RecordBatch) -> pa.RecordBatch:
        keys = part.column(0).to_pylist()
        row_seed = mix(np.array([hash_key(x) for x in keys], np.uint64) + np.uint64(seed))
        rows, ids, digests = [], [], []
        texts = part.column(1).to_pylist()
        for i, (ways, following, *best) in enumerate(sample_texts(lat, texts, row_seed, k, with_digests)):
            if with_digests:
                raw, encoded = texts[i].encode(), (len(best[0]), zlib.crc32(best[0].astype("<u4").tobytes()))
            for rank, way in enumerate(ways):
                found = ids_of(lat, way.edge).astype("<u4")
                if with_digests:
                    back = lat.v.decode_bytes(found.tolist())
                    digests.append((zlib.crc32(back), back == raw, *encoded))
                inclusion = 1.0 if following == -math.inf else -math.expm1(-math.exp(min(way.logp - following, 700.0)))
                rows.append((i, rank, len(found), zlib.crc32(found.tobytes()), way.logp, way.key, inclusion))
                ids.append(found.astype(np.int32) if with_ids else None)
        where, *rest = zip(*rows)
        columns = [part.column(0).take(pa.array(where)), *(pa.array(c, t) for c, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())))]
        names = [key, "rank", "n_pieces", "ids_crc32", "log_prob", "perturbed", "inclusion"]
        if with_digests:
            columns += [pa.array(c, t) for c, t in zip(zip(*digests), (pa.int64(), pa.bool_(), pa.int64(), pa.int64()))]
            names += ["decoded_crc32", "round_trip", "encoded_pieces", "encoded_crc32"]
        return pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=names + ["ids"] * with_ids)

    def each(batch: pa.RecordBatch):
        lat, collecting = lattices(path), gc.isenabled()
        gc.disable()  # no cycles come up here, and the collector would go through all that the worker keeps again and again
        try:
            for part in chunks(batch, "__text", 1 << 20):
                lat.trim()
                yield sampled(lat, part)
        finally:
            if collecting:
                gc.enable()

    frame = docs.select(docs[key], text_of(text).alias("__text"))
    schema = f"`{key}` {frame.schema.fields[0].dataType.simpleString()}, rank int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double"
    schema += ", decoded_crc32 long, round_trip boolean, encoded_pieces long, encoded_crc32 long" * with_digests
    return mapped(frame, each, schema + ", ids array<int>" * with_ids, "pieces")


def hash_key(x) -> int:
    """A row key's seed."""
    return zlib.crc32(b"null" if x is None else str(x).encode()) | (zlib.adler32(str(x).encode()) << 32)


def encode(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """docs with `ids`, the library's own (deterministic) encoding of each whole text."""
    path = model or default_model()
    kept = [c for c in docs.columns if c != "ids"]

    def each(batches):
        import sentencepiece

        begun()
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            ids = [sp.encode(t, num_threads=1) if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=[*kept, "ids"])
        ended()

    frame = docs.select(*[docs[c] for c in kept], text_of(text).alias("__text"))
    return frame.mapInArrow(each, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1]), "ids array<int>"]))


def decode(df: DataFrame, ids: str = "ids", out: str = "text", model: str | None = None) -> DataFrame:
    """df with the text of each array of piece ids; null ids give an empty text."""
    path = model or default_model()
    kept = [c for c in df.columns if c != out]

    def each(batch: pa.RecordBatch):
        v = lattices(path).v
        texts = [v.decode(x) if x else "" for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, out])

    frame = df.select(*[df[c] for c in kept], df[ids].alias("__ids"))
    return mapped(frame, each, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1]), f"`{out}` string"]), "pieces")


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of K sampled segmentations of every document, of the texts that they decode to, and of the document's own encoding."""
    return sample(table(spark, sf_dir, "documents"), with_ids=False, with_digests=True)
