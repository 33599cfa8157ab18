"""Near duplicates by Order MinHash.

A text's words (lower case, letters and digits) give 2-word k-mers, each labelled with its occurrence number. For each hash
function the `row` smallest labelled k-mers are taken and kept in text order: the sketch. Two texts share a sketch only if
the same k-mers are smallest and stand in the same order, which follows edit similarity. FAMILIES says how many sketches
texts of which length get: three k-mers from 17 words on, two up to 20 words, so that any two texts whose lengths fit have a
family in common. Equal sketches make candidates; a banded alignment over the words verifies them: edit similarity,
1 - edits / longer length, of SIMILARITY or more. Classes are the connected components of verified links, and of equal texts.

No group is expanded into its pairs. In each bucket the most connected text leads, and every text is aligned with one leader,
the one that it shares most sketches with; linked texts become one component. Buckets that still span components are gone
through again by length and with other leaders, as long as that links a fiftieth of what it aligns. What a bucket then still
holds apart is settled exactly: two alike texts share one of the rarest fifth of their words, so the texts of a bucket that
are in different components and share such a word are found in blocks of at most BLOCK texts and aligned. So no alike pair
that shares a sketch is left out. Equal texts collapse before any of this.

Defined cases: null and empty texts are equal texts; a text without words is only near equal texts; texts under two
words have one k-mer; repeated rows fall in one class; a null id is a row like any other, and a class's id is its smallest
non-null id (null if it has none); one row of each class stays, the one with that id, and one of them where rows repeat it;
very long texts are sketched and aligned whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begun, ended, mapped, table, text_of, written
from .vectext import WORDY, Pieces, Texts, chunks, hashes, lowered, mix, mults, repeats

SHINGLE = 2  # an edit spoils two k-mers at most, so that alike texts keep enough of them
FAMILIES = ((17, 1 << 62, 40, 3), (1, 20, 32, 2))  # least and most words, sketches, k-mers in a sketch
SIMILARITY = 0.8
BLOCK = 512  # texts of a bucket that a task looks at together with as many others
BAG = 512  # bins of a text's word counts, that bound the edits between two texts from below
GOES_ON = 0.02  # share of the aligned pairs that a round must link for another one
RANKED = (2_000, 65_536)  # texts and words that order words by frequency; any order gives the same pairs, a good one fewer to align

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin."""
    p = Pieces(texts, WORDY[texts.data])
    return hashes(texts.data, p), p.at


def shingles(h: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingles in text order, and where each text's begin; a text under k words has one, without words none."""
    n = np.diff(at)
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate(([0], np.cumsum(many)))
    row = np.repeat(np.arange(len(n)), many)
    pos = np.arange(begin[-1]) - begin[row] + at[row]
    padded = np.concatenate((h, np.zeros(k, np.uint64)))
    size = np.minimum(n[row], k)
    code = np.zeros(len(pos), np.uint64)
    for j, m in enumerate(mults(k, 9)):
        code += np.where(j < size, mix(padded[pos + j] + np.uint64(j)) * m, np.uint64(0))
    return mix(code + repeats(code, row)[0].astype(np.uint64) * _GOLD), begin


def _family(code: np.ndarray, start: np.ndarray, size: np.ndarray, count: int, row: int, salt: int) -> np.ndarray:
    """An array (texts, count) of sketches of `row` k-mers; each text owns `size` k-mers from `start` on."""
    out = np.zeros((len(start), count), np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i, m in enumerate(mults(count, salt)):
        x = mix(code ^ m)
        value, where = [], []
        for _ in range(row):
            least = np.minimum.reduceat(x, start)
            at_least = np.flatnonzero(x == np.repeat(least, size))
            # the first position of each text's smallest value
            first = at_least[np.searchsorted(at_least, start)]
            value.append(np.where(least == top, np.uint64(0), code[first]))
            where.append(np.where(least == top, np.int64(1 << 60), first))
            x[first] = top
        order = np.argsort(np.stack(where), axis=0, kind="stable")
        got = np.zeros(len(start), np.uint64)
        for k in range(row):
            got = mix(got * np.uint64(3) + np.take_along_axis(np.stack(value), order, 0)[k] + m)
        out[:, i] = got | np.uint64(1)
    return out


def sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """An array (texts, all families' sketches) of Order MinHash sketches; 0 where a text's length is not a family's."""
    code, begin = shingles(h, at)
    n, parts = np.diff(at), []
    for k, (least, most, count, row) in enumerate(FAMILIES):
        out = np.zeros((len(n), count), np.uint64)
        mine = np.flatnonzero((n >= least) & (n <= most))
        if len(mine):
            size = (begin[1:] - begin[:-1])[mine]
            start = np.cumsum(size) - size
            out[mine] = _family(code[np.arange(size.sum()) + np.repeat(begin[mine] - start, size)], start, size, count, row, 5 + k)
        parts.append(out)
    return np.concatenate(parts, axis=1)


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Edit distances of pairs (a not longer than b), exact where they are at most width; all pairs take a row together."""
    n = np.array([len(a) for a, _ in pairs])
    gap = np.array([len(b) for _, b in pairs]) - n
    rows, span = int(n.max()), 2 * width + 1
    a = np.zeros((len(pairs), rows), np.uint64)
    b = np.zeros((len(pairs), rows + span + width), np.uint64)  # words' hashes are never 0, 1 is padding on one side
    a[:] = 1
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = x
        keep = y[: b.shape[1] - width]
        b[i, width : width + len(keep)] = keep
    far, c = np.int32(1 << 28), np.arange(span, dtype=np.int32)
    row = np.where(c >= width, c - width, far)[None, :].repeat(len(pairs), 0).astype(np.int32)
    out = np.full(len(pairs), far)
    by_end: dict[int, list[int]] = {}
    for i, k in enumerate(n.tolist()):
        by_end.setdefault(k, []).append(i)
    for i in by_end.get(0, []):
        out[i] = gap[i]
    for r in range(1, rows + 1):
        new = row + (a[:, r - 1 : r] != b[:, r - 1 : r - 1 + span])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        if r <= width:
            new[:, : width - r] = far
            new[:, width - r] = r
        row = np.minimum.accumulate(new - c, axis=1) + c
        for i in by_end.get(r, []):
            if gap[i] <= width:
                out[i] = row[i, width + gap[i]]
    return out


def alike(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float = SIMILARITY) -> np.ndarray:
    """Whether 1 - edits / longer length reaches the similarity, for pairs of word sequences."""
    out = np.zeros(len(pairs), np.bool_)
    todo = []
    for i, (a, b) in enumerate(pairs):
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        most = int((1 - similarity) * len(b) + 1e-9)
        if not len(a) or len(b) - len(a) > most:
            out[i] = not len(b)
            continue
        # edits leave at least (longer length - edits) words in common, as bags
        both = np.sort(np.concatenate((mix(a + repeats(a, np.zeros(len(a), np.int64))[0].astype(np.uint64) * _GOLD), mix(b + repeats(b, np.zeros(len(b), np.int64))[0].astype(np.uint64) * _GOLD))))
        if len(b) - int((both[1:] == both[:-1]).sum()) <= most:
            todo.append((i, a, b, most))
    width = 8
    while todo:
        todo.sort(key=lambda x: len(x[1]))
        left, at = [], 0
        while at < len(todo):
            stop = min(len(todo), at + max(1, 60_000 // (2 * width + 1)))
            while stop > at + 1 and len(todo[stop - 1][1]) > 2 * len(todo[at][1]) + 64:
                stop = (at + 1 + stop) // 2
            part = todo[at:stop]
            for (i, a, b, most), d in zip(part, _banded([(a, b) for _, a, b, _ in part], width).tolist()):
                if d <= min(width, most):
                    out[i] = True
                elif width < most:
                    left.append((i, a, b, most))
            at = stop
        todo, width = left, width * 3
    return out


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row (a number of its own), doc_id, node (the text's digest), n_words and sketch of each row."""
    t = text_of(text)
    frame = docs.select(F.monotonically_increasing_id().alias("row"), docs[doc_id].cast("long").alias("doc_id"), F.unhex(F.md5(t.cast("binary"))).alias("node"), t.alias("__text"))

    def each(batch: pa.RecordBatch):
        for part in chunks(batch, "__text", 1 << 20):
            h, at = words(lowered(part.column(3)))
            s = sketches(h, at)
            begin = np.concatenate(([0], np.cumsum((s != 0).sum(1))))
            flat = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(s[s != 0].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(at)), flat], names=["row", "doc_id", "node", "n_words", "sketch"])

    return mapped(frame, each, "row long, doc_id long, node binary, n_words long, sketch array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike. Both joins are plain inner joins, so a leader with very many partners can be split."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("__a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("__b"))

    def each(batch: pa.RecordBatch):
        for part in chunks(batch, "__a", 1 << 20):
            (ha, ia), (hb, ib) = words(lowered(part.column(2))), words(lowered(part.column(3)))
            ok = alike([(ha[p:q], hb[r:s]) for p, q, r, s in zip(ia, ia[1:], ib, ib[1:])])
            yield part.select(["a", "b"]).filter(pa.array(ok))

    return mapped(pairs.join(a, "a").join(b, "b").select("a", "b", "__a", "__b"), each, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node and label (its component's smallest node) for every node that has an edge; smallest labels spread and pointers jump until nothing moves."""
    both = written(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a")), "links")
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    while True:
        sent = both.join(labels, both.src == labels.node).groupBy("dst").agg(F.min("label").alias("near"))
        near = written(labels.join(sent, labels.node == sent.dst).select("node", "label", F.least("label", "near").alias("near")), "near")
        up = near.select(F.col("node").alias("near"), F.col("near").alias("top"))
        new = written(near.join(up, "near").select("node", F.least("near", "top").alias("label"), (F.least("near", "top") != F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels


def _fits(x: str, y: str):
    """Lengths that the similarity allows."""
    return F.least(x, y) >= F.greatest(x, y) * F.lit(SIMILARITY) - F.lit(1e-9)


def labelled(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words, each with its occurrence number in its text hashed in."""
    return mix(h + repeats(h, np.repeat(np.arange(len(at) - 1), np.diff(at)))[0].astype(np.uint64) * _GOLD)


def rarest(word: np.ndarray, at: np.ndarray, known: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of each text's labelled words up to the number of edits allowed and one more, rarest first by one order for all texts, and where each text's begin.

    Two alike texts have at least (length - edits allowed) words in common, for either length, so the first common word
    in the order is among these words of both.
    """
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    i = np.searchsorted(known, word)
    rank = np.where(np.append(known, np.uint64(0))[i] == word, np.append(often, 0)[i], 0)
    order = np.lexsort((word, rank, row))
    most = np.minimum(n, ((1 - SIMILARITY) * n + 1e-9).astype(np.int64) + 1)
    keep = np.arange(len(word)) - at[row] < most[row]
    return order[keep], np.concatenate(([0], np.cumsum(most)))


def _prefixes(texts: DataFrame) -> DataFrame:
    """node, words (the different ones among the rarest of each text) and bag (its counts of words in BAG bins)."""

    def all_words(batch: pa.RecordBatch):
        for part in chunks(batch, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(labelled(*words(lowered(part.column(1)))).view(np.int64))], names=["word"])

    sample = texts.orderBy("node").limit(RANKED[0])
    counted = mapped(sample, all_words, "word long").groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    found = sorted((r.word & 0xFFFFFFFFFFFFFFFF, r.n) for r in counted.orderBy(F.desc("n"), "word").limit(RANKED[1]).collect())
    known, often = np.array([w for w, _ in found], np.uint64), np.array([n for _, n in found], np.int64)

    def each(batch: pa.RecordBatch):
        for part in chunks(batch, "text", 1 << 20):
            h, at = words(lowered(part.column(1)))
            place, begin = rarest(labelled(h, at), at, known, often)
            own = [np.unique(h[place[p:q]]).view(np.int64) for p, q in zip(begin, begin[1:])]
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *own])))
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            bag = np.bincount(row * BAG + (h % np.uint64(BAG)).astype(np.int64), minlength=(len(at) - 1) * BAG).reshape(-1, BAG)
            bag = np.minimum(bag, 32767).astype(np.int16)
            yield pa.RecordBatch.from_arrays([part.column(0), flat, pa.array([b.tobytes() for b in bag], pa.binary())], names=["node", "words", "bag"])

    return mapped(texts.select("node", "text"), each, "node binary, words array<long>, bag binary")


def _meeting(nodes: list[bytes], own: np.ndarray, label: np.ndarray, size: np.ndarray, word: np.ndarray, many: np.ndarray, bag: np.ndarray, bucket: int, buckets: list[set[int]]) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of a block's texts in different components whose lengths fit and that share a word (each has `many` of them, in order).

    Texts of two blocks only across; a pair that meets in several buckets only in the first of them.
    """
    n = len(nodes)
    row = np.repeat(np.arange(n), many)
    order = np.argsort(word, kind="stable")
    row, word = row[order], word[order]
    cut = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1], [True])))
    share = np.zeros((n, n), np.bool_)
    for p, q in zip(cut[:-1][np.diff(cut) > 1], cut[1:][np.diff(cut) > 1]):
        share[np.ix_(row[p:q], row[p:q])] = True
    share &= (label[:, None] != label[None, :]) & (np.minimum(size[:, None], size[None, :]) >= SIMILARITY * np.maximum(size[:, None], size[None, :]) - 1e-9)
    if not own.all():
        share &= own[:, None] != own[None, :]
    met = np.argwhere(np.triu(share, 1))
    for start in range(0, len(met), 4096):
        i, j = met[start : start + 4096].T
        more = bag[i].astype(np.int32) - bag[j]
        edits = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))  # each edit takes one word off at most
        ok = edits <= (1 - SIMILARITY) * np.maximum(size[i], size[j]) + 1e-9
        for i, j in met[start : start + 4096][ok].tolist():
            if min(buckets[i] & buckets[j]) == bucket:
                yield (nodes[i], nodes[j]) if nodes[i] < nodes[j] else (nodes[j], nodes[i])


def _word_pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The pairs of each group of texts."""
    group = rows["group"].to_numpy()
    cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    found: list[tuple[bytes, bytes]] = []
    for p, q in zip(cut, cut[1:]):
        part = rows.slice(p, q - p)
        lists = part["words"].combine_chunks()
        found.extend(_meeting(part["node"].to_pylist(), part["own"].to_numpy(), part["label"].to_numpy(), part["n_words"].to_numpy(), pc.list_flatten(lists).to_numpy(), pc.list_value_length(lists).to_numpy(), np.frombuffer(b"".join(part["bag"].to_pylist()), np.int16).reshape(-1, BAG), part["bucket"][0].as_py(), [set(x) for x in part["buckets"].to_pylist()]))
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])


def grouped(f: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for batches that are sorted by their first column: it gets whole groups of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun()
        left: list[pa.RecordBatch] = []  # of a group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy()
            stop = int(np.searchsorted(group, group[-1]))
            if left and (stop or left[0].column(0)[0].as_py() != group[-1]):
                yield from f(pa.Table.from_batches([*left, batch.slice(0, stop)]))
                left = []
            elif stop:
                yield from f(pa.Table.from_batches([batch.slice(0, stop)]))
            left.append(batch.slice(stop))
        if left:
            yield from f(pa.Table.from_batches(left))
        ended()

    return each


def groups(rows: DataFrame, size: str, key: str, block: int, columns: list[str], f: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over the rows of each bucket, which has `size` rows, or of each two blocks of it where it has more than `block`.

    A row falls into a block by its key, and goes to each pair of blocks that has its own; `own` tells which of the two it is.
    f gets whole groups, sorted by `group`, at most about two blocks of one at once.
    """
    n_blocks = F.ceil(F.col(size) / block)
    own, other = F.pmod(F.xxhash64(key), n_blocks), F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1))
    dealt = rows.select(*rows.columns, own.alias("__block"), other.alias("__other"))
    group = F.xxhash64("bucket", F.least("__block", "__other"), F.greatest("__block", "__other"))
    dealt = dealt.select(group.alias("group"), (F.col("__block") <= F.col("__other")).alias("own"), *columns)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(grouped(f), schema)


def _apart(placed: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Pairs (a, b) of texts in one bucket and different components that share a rare word and whose lengths fit; None if no bucket spans components."""
    spans = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    rest = written(placed.join(spans, "bucket"), "apart")
    if not rest.limit(1).count():
        return None
    loose = texts.join(rest.select("node").distinct().hint("merge"), "node", "left_semi")
    prefixes = written(_prefixes(written(loose, "loose")), "prefixes")
    held = rest.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))  # as many as a text has sketches
    rest = rest.join(prefixes.join(held, "node"), "node").withColumn("label", F.xxhash64("label"))
    return groups(rest, "n", "node", BLOCK, ["label", "node", "n_words", "words", "bag", "bucket", "buckets"], _word_pairs, "a binary, b binary").distinct()  # a block's own rows alone may give its pairs twice


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) with the components that links join made one."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    ends = written(ends.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).where("a <> b").distinct(), "component-links")
    if not ends.limit(1).count():
        return labels
    moves = components(ends).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return written(labels.join(moves, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "components")


def _star(placed: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b): each text with a leader in another component, among those of fitting length the one that it shares most buckets with.

    The first round's leaders are the texts with the most others in their buckets, as the source of many edited copies is;
    later ones lead among texts of like length, in an order of their own for each round.
    """
    if number == 0:
        weight = placed.groupBy("node").agg(F.sum("n").alias("weight"))
        slots = placed.join(weight, "node").withColumn("group", F.col("bucket"))
    else:
        level = F.floor(F.log("n_words") / F.lit(-math.log(SIMILARITY)))
        slots = placed.withColumn("level", F.explode(F.array(level, level + 1))).withColumn("group", F.xxhash64("bucket", "level"))
        slots = slots.withColumn("weight", F.xxhash64("node", F.lit(number)))
    slots = written(slots.select("group", "node", "n_words", "label", "weight"), "slots")
    lead = slots.groupBy("group").agg(F.max(F.struct("weight", "node", "n_words", "label")).alias("lead"), F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    lead = written(lead.where("low <> high").select("group", "lead"), "leaders")
    met = slots.join(lead, "group").where((F.col("label") != F.col("lead.label")) & _fits("n_words", "lead.n_words"))
    met = met.groupBy("node", "lead.node").agg(F.count("*").alias("n")).toDF("b", "a", "n")
    return met.groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node, class_id, class_node (the digest of the class's first text) and stays of each row."""
    rows = written(sketched(docs, doc_id, text), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = rows.groupBy("node").agg(F.min(first).alias("first"), F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, "nodes")
    slots = nodes.select("node", "n_words", F.explode("sketch").alias("bucket"))
    full = slots.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    slots = written(slots.join(full, "bucket"), "slots")
    digest = F.unhex(F.md5(text_of(text).cast("binary")))

    # the texts that share a sketch with another, once each; the join is a shuffled one at every size
    wanted = written(slots.select("node").distinct(), "wanted")
    texts = docs.select(digest.alias("node"), text_of(text).alias("text")).join(wanted.hint("merge"), "node", "left_semi")
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
    labels, number = wanted.select("node", F.col("node").alias("label")), 0
    while True:
        placed = written(slots.join(labels, "node"), "placed")
        pairs = written(_star(placed, number), "star")
        links = written(verified(pairs, texts), "star-links")
        n_pairs, n_links = pairs.count(), links.count()
        if n_links:
            labels = contracted(labels, links)
        if not n_links or n_links < GOES_ON * n_pairs:
            break
        number += 1
    apart = _apart(written(slots.join(labels, "node"), "placed") if n_links else placed, texts)
    if apart is not None:
        links = written(verified(written(apart, "apart-pairs"), texts), "apart-links")
        if links.limit(1).count():
            labels = contracted(labels, links)
    known = written(nodes.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label")), "known")
    heads = known.groupBy("label").agg(F.min(F.struct(F.col("first"), F.col("node"))).alias("f"))
    heads = written(heads.select("label", F.col("f.first.doc_id").alias("class_id"), F.col("f.first.row").alias("head"), F.col("f.node").alias("class_node")), "heads")
    known = written(known.join(heads, "label").select("node", "class_id", "class_node", "head"), "classes")
    return rows.select("row", "doc_id", "node").join(known, "node").select("doc_id", "node", "class_id", "class_node", (F.col("row") == F.col("head")).alias("stays"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the one with the smallest id (other columns break ties)."""
    found = classes(docs)
    heads = written(found.where("stays").select(F.col("node").alias("__node")), "kept")
    named = docs.withColumn("__node", F.unhex(F.md5(text_of("text").cast("binary"))))
    near = named.join(heads, "__node", "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col("doc_id").isNull(), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return near.groupBy("__node").agg(F.min_by(whole, order).alias("d")).select("d.*")


def op4_near_dedup_omh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document, and whether it is the row of its class that stays."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "stays")
