"""Media columns: copies of images found by local descriptors.

Corners are local maxima of a Harris response on several scales; each gets the orientation of its patch's intensity
centroid and 128 binary brightness tests turned by it. Descriptors meet in Hamming tables, one for each 32-bit quarter
(two descriptors within 3 bits agree in at least one), and count as met if all their bits differ in MATCH_BITS at most.
In a table's bucket every image meets one leader, and is compared with the leader that it meets most often, corner by
corner: both are linked if enough matched corners agree on one similarity transform. Linked images become one component.
Buckets that still span components are gone through in blocks of at most BLOCK slots, and all their images of different
components that meet are compared too, so no pair that meets is left out, and no group is expanded into its pairs. These
pairs are mostly chance and grow with the square of the images, so they never travel with their corners: images fall into
sides, pairs of sides are cells, and each cell gets its pairs as packed numbers and the brightness tests of each of its
images once. Only pairs with enough matched corners there are joined with the corners' places.
Classes are the connected components, equal images included.

Images are grey-scale or colour, PGM/PPM (P5, P6) or PNG (8 bits, not interlaced) in a binary column.

Defined cases: a null, empty or unreadable image has no corners and is only near equal bytes; an image without corners
(one under 2 EDGE pixels wide or high has none) likewise; repeated rows fall in one class; a null id is a row like any other, and a class's id is its smallest non-null
id (null if it has none); images of any size are read whole; an empty table gives an empty table; extra columns, also
such as have a result's name, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table, unneeded, written
from .near_dedup import contracted, grouped, groups
from .vectext import chunks, mix

LEVELS = (1.0, 0.7071, 0.5)
RADIUS = 12
APART = 4  # pixels that corners keep from each other
EDGE = 9  # pixels at the border without corners: their tests would mostly see the border, which a cropped copy has elsewhere
BITS = 128
RESPONSE = 4e-6  # least corner response of an image with brightness 0 to 1
MATCH_BITS = 20  # most differing bits of matched descriptors
AGREE = 6  # matched corners that agree on a transform
WITHIN = 1.5  # pixels
BLOCK = 512  # slots of a bucket that a task looks at together with as many others
PART = 1 << 22  # corner pairs that are compared at once
SIDE = 1 << 19  # corners on one side of a cell, on average

_rng = np.random.default_rng(BITS)
# points in a disc, so that a test stays inside the patch however turned
_TESTS = _rng.uniform(0, 2 * np.pi, (BITS, 2))
_TESTS = (RADIUS - 2) * np.sqrt(_rng.uniform(0, 1, (BITS, 2)))[..., None] * np.stack((np.cos(_TESTS), np.sin(_TESTS)), -1)
_TURNS = 36
_ANGLE = np.arange(_TURNS) * (2 * np.pi / _TURNS)
_SPIN = np.stack((np.stack((np.cos(_ANGLE), -np.sin(_ANGLE)), -1), np.stack((np.sin(_ANGLE), np.cos(_ANGLE)), -1)), -2)
_TURNED = np.round(np.einsum("tij,bkj->tbki", _SPIN, _TESTS)).astype(np.int64)  # (turn, bit, point, (x, y))
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_X**2 + _Y**2) <= RADIUS**2


def decode(raw: bytes | None) -> np.ndarray | None:
    """The image's brightness, 0 to 1; None if it can't be read."""
    try:
        if raw and raw[:2] in (b"P5", b"P6"):
            return _pnm(raw)
        if raw and raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
    except (ValueError, IndexError, KeyError, zlib.error):
        pass
    return None


def _pnm(raw: bytes) -> np.ndarray | None:
    head = re.match(rb"P[56](?:(?:\s|#[^\n]*\n)+(\d{1,9}))(?:(?:\s|#[^\n]*\n)+(\d{1,9}))(?:(?:\s|#[^\n]*\n)+(\d{1,9}))\s", raw[:4096])
    if not head:
        return None
    w, h, most = map(int, head.groups())
    n = 1 if raw[1:2] == b"5" else 3
    if not 0 < most <= 255 or not w * h:
        return None
    return (np.frombuffer(raw, np.uint8, w * h * n, head.end()).reshape(h, w, n) / most).mean(2)


def _png(raw: bytes) -> np.ndarray | None:
    at, body, head = 8, [], None
    while at < len(raw):
        size, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        part = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = part
        elif kind == b"IDAT":
            body.append(part)
        at += size + 12
    if head is None or len(head) < 13:
        return None
    w, h, depth, color, lace = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9], head[12]
    if depth != 8 or lace or color not in (0, 2, 4, 6) or not w * h:
        return None
    n = {0: 1, 2: 3, 4: 2, 6: 4}[color]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, w + 1, n), np.uint8)
    for y in range(h):
        how, line = int(rows[y, 0]), rows[y, 1:].reshape(w, n).astype(np.int64)
        above = out[y, 1:].astype(np.int64)
        if how == 0:
            out[y + 1, 1:] = line
        elif how == 2:
            out[y + 1, 1:] = (line + above) & 255
        elif how == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0) & 255
        elif how in (3, 4):
            before = [0] * n
            for x in range(w):
                for c in range(n):
                    left, up, corner = before[c], int(above[x, c]), int(out[y, x, c])
                    if how == 3:
                        guess = (left + up) // 2
                    else:
                        a, b, d = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                        guess = left if a <= b and a <= d else up if b <= d else corner
                    before[c] = (int(line[x, c]) + guess) & 255
                out[y + 1, x + 1] = before
        else:
            return None
    return (out[1:, 1:, : 3 if n >= 3 else 1] / 255).mean(2)


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2 r + 1, edges repeated."""
    c = np.cumsum(np.cumsum(np.pad(x, ((r + 1, r), (r + 1, r)), "edge"), 0), 1)
    k = 2 * r + 1
    return (c[k:, k:] - c[:-k, k:] - c[k:, :-k] + c[:-k, :-k]) / (k * k)


def _shrunk(x: np.ndarray, f: float) -> np.ndarray:
    if f == 1.0:
        return x
    h, w = max(1, int(x.shape[0] * f)), max(1, int(x.shape[1] * f))
    y, z = (np.arange(h) + 0.5) / f - 0.5, (np.arange(w) + 0.5) / f - 0.5
    a, b = np.clip(np.floor(y).astype(int), 0, x.shape[0] - 1), np.clip(np.floor(z).astype(int), 0, x.shape[1] - 1)
    a1, b1 = np.minimum(a + 1, x.shape[0] - 1), np.minimum(b + 1, x.shape[1] - 1)
    u, v = np.clip(y - a, 0, 1)[:, None], np.clip(z - b, 0, 1)[None, :]
    return (x[a][:, b] * (1 - u) + x[a1][:, b] * u) * (1 - v) + (x[a][:, b1] * (1 - u) + x[a1][:, b1] * u) * v


def describe(image: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, scale, angle) of each corner, and its 128 bits as two uint64."""
    places, bits = [np.zeros((0, 4))], [np.zeros((0, 2), np.uint64)]
    for f in LEVELS if image is not None else ():
        x = _shrunk(image, f)
        if min(x.shape) < RADIUS:
            continue
        dy, dx = np.zeros_like(x), np.zeros_like(x)
        dy[1:-1], dx[:, 1:-1] = (x[2:] - x[:-2]) / 2, (x[:, 2:] - x[:, :-2]) / 2
        xx, yy, xy = _box(dx * dx, 2), _box(dy * dy, 2), _box(dx * dy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        near = np.pad(r, APART, constant_values=-np.inf)
        near = np.maximum.reduce([near[k : len(near) - 2 * APART + k] for k in range(2 * APART + 1)])
        near = np.maximum.reduce([near[:, k : near.shape[1] - 2 * APART + k] for k in range(2 * APART + 1)])
        peak = (r == near) & (r > RESPONSE)
        peak[:EDGE], peak[-EDGE:], peak[:, :EDGE], peak[:, -EDGE:] = False, False, False, False
        py, px = np.nonzero(peak)
        if not len(py):
            continue
        wide = np.pad(x, RADIUS, "edge")  # tests beyond the border see the border
        patch = wide[py[:, None, None] + (_Y + RADIUS), px[:, None, None] + (_X + RADIUS)] * _DISC
        angle = np.arctan2((patch * _Y).sum((1, 2)), (patch * _X).sum((1, 2)))
        smooth = _box(wide, 1)
        t = _TURNED[np.round(angle / (2 * np.pi / _TURNS)).astype(int) % _TURNS]
        value = smooth[py[:, None, None] + t[..., 1] + RADIUS, px[:, None, None] + t[..., 0] + RADIUS]
        flag = value[:, :, 0] > value[:, :, 1] + 1e-3
        bits.append(np.packbits(flag, axis=1).view(np.uint64))
        places.append(np.column_stack(((px + 0.5) / f, (py + 0.5) / f, np.full(len(px), 1 / f), angle)))
    return np.concatenate(places), np.concatenate(bits)


def consensus(a: np.ndarray, b: np.ndarray) -> int:
    """The most matches (rows of a and b: x, y, scale, angle) that agree on one similarity transform, counting each corner once."""
    scale, turn = b[:, 2] / a[:, 2], b[:, 3] - a[:, 3]
    c, s = scale * np.cos(turn), scale * np.sin(turn)

    def agreeing(i: slice) -> np.ndarray:
        """Row i: the matches that match i's transform puts where they are."""
        dx, dy = a[None, :, 0] - a[i, None, 0], a[None, :, 1] - a[i, None, 1]
        x, y = c[i, None] * dx - s[i, None] * dy + b[i, None, 0], s[i, None] * dx + c[i, None] * dy + b[i, None, 1]
        near = np.hypot(x - b[None, :, 0], y - b[None, :, 1]) <= WITHIN * np.maximum(1.0, scale[i])[:, None]
        return near & (np.abs(np.log(scale[None, :] / scale[i, None])) < 0.2)

    step = max(1, PART // 8 // len(a))
    count, best = np.concatenate([agreeing(slice(i, i + step)).sum(1) for i in range(0, len(a), step)]), 0
    for i in np.argsort(-count, kind="stable").tolist():
        if count[i] <= best:
            break
        ok = agreeing(slice(i, i + 1))[0]
        best = max(best, min(len(np.unique(np.round(a[ok, :2]), axis=0)), len(np.unique(np.round(b[ok, :2]), axis=0))))
    return best


def descriptors(images: DataFrame, image_id: str = "image_id", image: str = "image") -> DataFrame:
    """image_id, node (the bytes' digest), and arrays of places and bits of each image."""

    def each(batch: pa.RecordBatch):
        for part in chunks(batch, "image", 1 << 20):
            found = [describe(decode(x)) for x in part.column(2).to_pylist()]
            at = np.cumsum([0, *(len(p) for p, _ in found)])
            places, bits = np.concatenate([p for p, _ in found]), np.concatenate([b for _, b in found])
            arrays = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (*places.astype(np.float32).T, *np.ascontiguousarray(bits).view(np.int64).T)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["image_id", "node", "x", "y", "s", "a", "lo", "hi"])

    raw = F.coalesce(images[image], F.lit(b""))
    frame = images.select(images[image_id].cast("long").alias("image_id"), F.unhex(F.md5(raw)).alias("node"), raw.alias("image"))
    return mapped(frame, each, "image_id long, node binary, x array<float>, y array<float>, s array<float>, a array<float>, lo array<long>, hi array<long>")


def matches(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """How many corners of two images (places, bits) match in brightness tests and agree on one transform."""
    if not len(a[1]) or not len(b[1]):
        return 0
    best, least, step = [], [], max(1, PART // len(b[1]))
    for i in range(0, len(a[1]), step):
        far = np.bitwise_count(a[1][i : i + step, None, 0] ^ b[1][None, :, 0]) + np.bitwise_count(a[1][i : i + step, None, 1] ^ b[1][None, :, 1])
        best.append(far.argmin(1))
        least.append(far.min(1))
    best, least = np.concatenate(best), np.concatenate(least)
    ok = np.flatnonzero(least <= MATCH_BITS)
    return consensus(a[0][ok], b[0][best[ok]]) if len(ok) >= AGREE else 0


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of image numbers whose corners agree, as their digests."""

    def corners(row: dict, s: str) -> tuple[np.ndarray, np.ndarray]:
        return np.column_stack([np.array(row[s + c], np.float64) for c in "xysa"]), np.column_stack([np.array(row[s + c], np.int64) for c in ("lo", "hi")]).view(np.uint64)

    def each(batch: pa.RecordBatch):
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            ok = [matches(corners(r, "a_"), corners(r, "b_")) >= AGREE for r in part.to_pylist()]
            yield part.select(["node_a", "node_b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda s: nodes.select(F.col("n").alias(s), F.col("node").alias(f"node_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in ("x", "y", "s", "a", "lo", "hi")])
    met = pairs.join(side("a"), "a").join(side("b"), "b").drop("a", "b")
    return mapped(met, each, "node_a binary, node_b binary").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _met(lo: str, hi: str):
    """Whether the descriptor in lo and hi and a leader's are within MATCH_BITS."""
    return F.bit_count(F.col("lo").bitwiseXOR(F.col(lo))) + F.bit_count(F.col("hi").bitwiseXOR(F.col(hi))) <= MATCH_BITS


def _meeting(rows: pa.Table) -> np.ndarray:
    """Pairs (a, b) of images of different components whose slots are in one group and within MATCH_BITS; slots of two blocks only across."""
    group, own, label, n, lo, hi = (rows[c].to_numpy() for c in ("group", "own", "label", "n", "lo", "hi"))
    lo, hi = lo.view(np.uint64), hi.view(np.uint64)
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    alone = np.repeat(np.logical_and.reduceat(own, start), np.diff(np.append(start, len(group))))
    i, k, found = np.arange(len(group)), 1, []
    while len(i):
        i = i[i + k < len(group)]
        i = i[group[i] == group[i + k]]
        j = i + k
        far = np.bitwise_count(lo[i] ^ lo[j]) + np.bitwise_count(hi[i] ^ hi[j])
        ok = (far <= MATCH_BITS) & (label[i] != label[j]) & ((own[i] != own[j]) | alone[i])
        found.append(np.column_stack((np.minimum(n[i], n[j])[ok], np.maximum(n[i], n[j])[ok])))
        k += 1
    return np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)


def _cells(pairs: np.ndarray, sides: int) -> Iterator[pa.RecordBatch]:
    """The pairs of each cell, packed: the number of the pair of sides that its images fall into, and the pairs' numbers."""
    side = (mix(pairs.astype(np.uint64)) % np.uint64(sides)).astype(np.int64)
    cell = side.min(1) * sides + side.max(1)
    order = np.argsort(cell, kind="stable")
    names, start = np.unique(cell[order], return_index=True)
    packed = [x.tobytes() for x in np.split(pairs[order], start[1:])] if len(names) else []
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary())], names=["cell", "pairs"])


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """The different pairs in packed ones."""
    return np.unique(np.frombuffer(b"".join(x for x in column.to_pylist() if x), np.int64).reshape(-1, 2), axis=0)


def _by_cell(f: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for batches that are sorted by cell: it gets the rows of one cell."""

    def each(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        _, start = np.unique(rows["cell"].to_numpy(), return_index=True)
        for i, j in zip(start.tolist(), [*start[1:].tolist(), rows.num_rows]):
            yield f(rows.slice(i, j - i))

    return grouped(each)


def _matched(rows: pa.Table) -> pa.RecordBatch:
    """The pairs of a cell that have AGREE corners or more with a match, without which they can't agree; the cell's images come with their tests."""
    pairs, images = _unpacked(rows["pairs"]), rows.filter(rows["n"].is_valid()).combine_chunks()
    n = images["n"].to_numpy()
    order = np.argsort(n)
    lo, hi = (images[c].combine_chunks() for c in ("lo", "hi"))
    at, size = lo.offsets.to_numpy(), lo.value_lengths().to_numpy()
    bits = [x.values.to_numpy().view(np.uint64) for x in (lo, hi)]
    a, b = (order[np.searchsorted(n, pairs[:, k], sorter=order)] for k in (0, 1))
    ok = np.zeros(len(pairs), np.bool_)
    for i, (p, m, q, l) in enumerate(zip(at[a].tolist(), size[a].tolist(), at[b].tolist(), size[b].tolist())):
        step, found = max(1, PART // max(1, l)), 0
        for r in range(p, p + m if l else p, step):
            s = slice(r, min(r + step, p + m))
            far = np.bitwise_count(bits[0][s, None] ^ bits[0][q : q + l]) + np.bitwise_count(bits[1][s, None] ^ bits[1][q : q + l])
            found += np.count_nonzero(far.min(1) <= MATCH_BITS)
        ok[i] = found >= AGREE
    return pa.RecordBatch.from_arrays([pa.array(pairs[ok, 0]), pa.array(pairs[ok, 1])], names=["a", "b"])


def _candidates(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of images of different components that meet in a bucket and have AGREE corners or more with a match."""
    spans = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    corners = nodes.agg(F.sum(F.size("lo"))).first()[0] or 0
    sides = max(4, -(-corners // SIDE))
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = written(groups(placed.join(spans, "bucket"), "size", "n", BLOCK, ["label", "n", "lo", "hi"], lambda rows: _cells(_meeting(rows), sides), "cell long, pairs binary"), "apart-pairs")

    def images(rows: pa.Table) -> pa.RecordBatch:
        n = np.unique(_unpacked(rows["pairs"]))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), rows["cell"][0].as_py())), pa.array(n)], names=["cell", "n"])

    there = met.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_by_cell(images), "cell long, n long")
    rows = there.join(nodes.select("n", "lo", "hi"), "n").select("cell", "n", "lo", "hi", F.lit(None).cast("binary").alias("pairs"))
    none = F.lit(None).cast("array<long>")
    rows = rows.union(met.select("cell", F.lit(None).cast("long"), none, none, "pairs"))
    return rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_by_cell(_matched), "a long, b long")


def copies(images: DataFrame, image_id: str = "image_id", image: str = "image") -> DataFrame:
    """image_id, class_id and n_links (other different images that it was linked to) of each row."""
    rows = written(descriptors(images, image_id, image).withColumn("n", F.monotonically_increasing_id()), "descriptors")
    first = written(rows.groupBy("node").agg(F.min("image_id").alias("first_id"), F.min("n").alias("n")), "images")
    nodes = rows.drop("image_id").join(first.select("n"), "n", "left_semi") if rows.count() > first.count() else rows.drop("image_id")
    # Hamming tables: a slot for each corner and 32-bit quarter of its tests
    points = nodes.select("n", F.explode(F.arrays_zip("lo", "hi")).alias("p")).select("n", "p.lo", "p.hi")
    quarters = [F.col("lo").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("lo", 32), F.col("hi").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("hi", 32)]
    bucket = F.explode(F.array(*[F.xxhash64(F.lit(i), q) for i, q in enumerate(quarters)])).alias("bucket")
    # one image leads a bucket; only buckets with two images or more
    lead = points.select("n", bucket).groupBy("bucket").agg(F.min("n").alias("a"), F.max("n").alias("top"), F.count("*").alias("size")).where("a <> top").select("bucket", "a", "size")
    slots = written(points.select("n", "lo", "hi", bucket).join(lead, "bucket"), "slots")
    leader = slots.where("n = a").groupBy("bucket").agg(F.min(F.struct("lo", "hi")).alias("d"))
    met = slots.where("n <> a").join(leader.select("bucket", F.col("d.lo").alias("la"), F.col("d.hi").alias("ha")), "bucket").where(_met("la", "ha"))
    met = met.groupBy("n", "a").agg(F.count("*").alias("times")).groupBy("n").agg(F.max(F.struct("times", "a")).alias("best"))
    links = written(_agreeing(written(met.select(F.col("best.a").alias("a"), F.col("n").alias("b")), "image-pairs"), nodes), "image-links")
    labels = contracted(first.select("node", F.col("node").alias("label")), links)
    # what the buckets still hold apart
    placed = slots.drop("a").join(labels.join(first, "node").select("n", F.xxhash64("label").alias("label")), "n")
    placed = written(placed, "placed")
    unneeded(slots)
    more = written(_agreeing(written(_candidates(placed, nodes), "candidates"), nodes), "apart-links")
    labels, links = contracted(labels, more), links.union(more)
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    known = written(first.select("node", "first_id").join(labels, "node").select("node", "first_id", "label"), "image-labels")
    heads = written(known.groupBy("label").agg(F.min("first_id").alias("class_id")), "image-heads")
    known = written(known.join(heads, "label").join(degree, "node", "left").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "image-classes")
    return rows.select("image_id", "node").join(known, "node").select("image_id", "class_id", "n_links")


def picture(vector: np.ndarray, size: int = 72) -> np.ndarray:
    """A picture drawn from a vector: its numbers are the coarse shades, a hash of them the finer ones."""
    v = np.tanh(5 * np.resize(np.nan_to_num(np.asarray(vector, np.float64)), 64))
    seed = np.uint64(zlib.crc32(v.tobytes()))
    out = np.zeros((size, size))
    for cells, weight in ((8, 0.5), (16, 0.8), (size // 2, 0.5)):
        shade = v if cells == 8 else (mix(np.arange(1, cells * cells + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (seed << np.uint64(8)) + np.uint64(cells)) >> np.uint64(11)) / 2.0**52 - 1
        out += weight * _shrunk(shade.reshape(cells, cells), size / cells)
    return (out - out.min()) / max(float(out.max() - out.min()), 1e-9)


def pgm(x: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (x.shape[1], x.shape[0]) + np.clip(np.round(x * 255), 0, 255).astype(np.uint8).tobytes()


def edited(x: np.ndarray, seed: int) -> np.ndarray:
    """A cropped copy with other contrast and a box pasted in."""
    r = mix(np.arange(1, 8, dtype=np.uint64) + np.uint64(seed & 0xFFFFFFFF) * np.uint64(0x9E3779B9))
    side = len(x)
    cut, box = side // 8, side // 9
    left, top = int(r[0] % np.uint64(cut)), int(r[1] % np.uint64(cut))
    y = x[top : top + side - cut, left : left + side - cut] * 0.8 + 0.1
    a, b = int(r[2] % np.uint64(side - cut - box)), int(r[3] % np.uint64(side - cut - box))
    y[a : a + box, b : b + box] = 0.95
    return y


def album(embeddings: DataFrame) -> DataFrame:
    """A media table for tests and the query, as the tables hold no media: each row's picture (image_id 2 * vec_id) and an edited copy of it (2 * vec_id + 1)."""

    def each(batch: pa.RecordBatch):
        for start in range(0, batch.num_rows, 64):
            part, ids, images = batch.slice(start, 64), [], []
            for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                x = picture(np.array(v if v is not None and len(v) else [0.0], np.float64))
                ids += [None, None] if i is None else [2 * i, 2 * i + 1]
                images += [pgm(x), pgm(edited(x, zlib.crc32(str(i).encode())))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["image_id", "image"])

    return mapped(embeddings.select("vec_id", "embedding"), each, "image_id long, image binary")


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, class_id, n_links of every image of the album drawn from all embeddings."""
    return copies(album(table(spark, sf_dir, "embeddings")))
