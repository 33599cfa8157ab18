"""The training-data operators against brute force, exact round trips and held-out labels."""

import collections
import itertools
import math
import pathlib
import random
import re
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stowage.llm import common, crf, html, labelled, media, near_dedup, nbsvm, packing, piece_sampling, quality_lines, queries, sharding, tokens, toxicity, vectext

SF = "/root/testdata/sf0.001"
ODD = ["", None, "a", "  two  spaces ", "tab\t\n\n new  line \n", "x<|endoftext|>y <|endoftext|> z", "日本語 😀 x² é q", "word " * 3000, "a" * 20000, "same text", "same text", "it's, done. (yes!) A.B.C 12.5 \r\n z"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, null and repeated ids, repeated rows, and columns whose names clash with results."""
    rows = [(i if i != 3 else None, t, "en", "s", i, 7, 1.5) for i, t in enumerate(ODD)] + [(9, "same text", "en", "s", 9, 7, 1.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, score double")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def test_token_counts(spark, docs, tok):
    got = {r.doc_id: r for r in queries.op2_token_counts(spark, SF).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 1024)


def test_token_counts_odd(odd, tok):
    got = tokens.count_tokens(odd).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in got)
    assert all(r.n_tokens == len(tok.encode(r.text or "", add_special_tokens=False).ids) and r.score == 1.5 for r in got)
    assert tokens.count_tokens(odd.where("false")).count() == 0


def test_token_counts_other_libraries(odd):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    sp, word = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    short = odd.where("length(text) < 100")
    for r in tokens.count_tokens(short, tokenizer=public_tokenizers.path("piece_bpe_32k.model")).collect():
        assert r.n_tokens == len(sp.encode(r.text))
    for r in tokens.count_tokens(short, tokenizer=public_tokenizers.path("word_bpe_49k.json")).collect():
        assert r.n_tokens == len(word.encode(r.text, add_special_tokens=False).ids)


def test_caches_stay_bounded(monkeypatch, tok):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 20)
    texts = [" ".join(f"w{i}x{j}," for j in range(40)) for i in range(6)]
    ids = tokens.Ids(tokens.library(tokens.default_tokenizer()))
    lengths = tokens.Lengths(tokens.library(tokens.default_tokenizer()))
    for t in texts + texts:
        flat, at = ids.encode([t, t])
        want = tok.encode(t, add_special_tokens=False).ids
        assert flat.tolist() == want * 2 and at.tolist() == [0, len(want), 2 * len(want)] and lengths.count(t) == len(want)
    assert len(lengths) <= 20


def test_worker_memory_stays_bounded(monkeypatch, tok):
    monkeypatch.setattr(tokens, "CACHE_IDS", 3000)
    ids = tokens.Ids(tokens.library(tokens.default_tokenizer()))
    for i in range(40):  # words of thousands of ids, which come once
        t = f"it is {i} " + f"{i}9z" * 700 + " and more"
        assert ids.encode([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids
        assert ids.encode(["it is"])[0].tolist() == tok.encode("it is", add_special_tokens=False).ids
    assert max(map(len, ids)) <= tokens.CACHE_CHARS and int(ids.at[ids.used]) <= 3000


def test_stages_leave_no_caches_to_others(spark, odd):
    from stowage.llm.common import mapped

    def held(batch):
        yield pa.RecordBatch.from_arrays([pa.array([len(tokens._IDS)])], names=["n"])

    packing.pack(odd.repartition(8)).count()
    assert {r.n for r in mapped(odd.repartition(8).select("doc_id"), held, "n long").collect()} == {0}


def packed_ok(rows, texts, tok):
    """Every id of every text in exactly one piece, pieces of a power of two, one piece a sequence."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    for i, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.length <= 1024 and r.length & (r.length - 1) == 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_packing(spark, docs, tok):
    packed_ok(queries.op6_packing_binary(spark, SF).collect(), docs, tok)


def test_packing_odd(odd, tok):
    one = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    packed_ok(packing.pack(one).collect(), {r.doc_id: r.text for r in one.collect()}, tok)
    full = packing.pack(odd, with_ids=True).collect()
    assert all(len(r.ids) == r.length == r.bucket for r in full) and packing.pack(odd.where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, most=1000)


def test_binary_pieces():
    n = np.arange(1, 5000)
    lengths, many = packing.binary_pieces(n)
    assert (np.add.reduceat(lengths, np.cumsum(many) - many) == n).all() and (many == n // 1024 + np.array([bin(x % 1024).count("1") for x in n])).all()


def base_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri, rep = collections.defaultdict(list), set()
    for i in range(len(w) - 2):
        tri[tuple(w[i : i + 3])].append(i)
    for v in tri.values():
        if len(v) > 1:
            rep |= {i + k for i in v for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


def test_quality_lines(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = []
    for r in queries.op7_quality_lines(spark, SF).collect():
        b = base_counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.base_failed and r.kept)
        if r.doc_id in labels and not r.base_failed:
            right.append(r.kept == bool(labels[r.doc_id]))
    assert np.mean(right) > 0.95


def test_quality_lines_odd(odd):
    model = quality_lines.fit([("good line here\n" * 3, 1), ("### $$$ %%%\n" * 3, 0)])
    for r in quality_lines.label(odd, model).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(r.text or "")
    assert quality_lines.label(odd.where("false"), model).count() == 0
    assert quality_lines.label(odd, quality_lines.fit([])).where("kept").count() == 0  # all too short or repetitive


def test_lines_are_told_apart(spark):
    sentence = "The old harbour lies quiet in the evening and the boats come home with the tide"
    rng, words = random.Random(3), sentence.lower().split()
    line = lambda: " ".join(rng.choice(words) for _ in range(12)).capitalize() + "."
    junk = lambda: " ".join(rng.choice(["### win", "$$$", "CLICK NOW", "<|> %%%", "BUY!!!"]) for _ in range(8))
    good = ["\n".join(line() for _ in range(rng.randint(1, 9))) for _ in range(120)]
    bad = ["\n".join(junk() if i % 3 < 2 else line() for i in range(rng.randint(2, 9))) for _ in range(120)]
    model = quality_lines.fit([*((t, 1) for t in good), *((t, 0) for t in bad)])
    body, tail = [line() for _ in range(20)], [junk() for _ in range(10)]
    texts = ["\n".join(body + tail), "\n".join(tail + body[:2] + tail), "\n".join(body), "\n".join(tail)]
    got = {r.doc_id: r for r in quality_lines.label(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    size = lambda lines: sum(len(t.split()) for t in lines)
    for i, (content, all_lines) in enumerate(((body, body + tail), (body[:2], tail + body[:2] + tail), (body, body), ([], tail))):
        assert abs(got[i].content_share - size(content) / size(all_lines)) < 1e-9
    assert [got[i].kept for i in range(4)] == [True, False, True, False]


def test_crf_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(20):
        e, at, c = rng.normal(size=9), np.array([0, 4, 4, 9]), crf.Chain(rng.normal(size=(2, 2)), float(rng.normal()))
        m, v = crf.marginals(e, at, c), crf.viterbi(e, at, c)
        for a, b in ((0, 4), (4, 9)):
            ways = {y: c.begin * y[0] + sum(e[a + i] * y[i] for i in range(b - a)) + sum(c.move[y[i], y[i + 1]] for i in range(b - a - 1)) for y in itertools.product([0, 1], repeat=b - a)}
            z = sum(map(math.exp, ways.values()))
            assert np.allclose(m[a:b], sum(math.exp(s) * np.array(y) for y, s in ways.items()) / z)
            assert tuple(v[a:b].astype(int)) == max(ways, key=ways.get)


def held_out_rows(rows, labels, field):
    pairs = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert all(0 <= s <= 1 for s, _, _ in pairs)
    return pairs


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_toxicity_held_out(spark, sf):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    pairs = held_out_rows(queries.QUERIES["op8_toxicity_crf"](spark, sf).collect(), labels, "toxic")
    hit = [p for _, p, y in pairs if y]
    assert np.mean(hit) >= 0.75 and np.mean([p for _, p, y in pairs if not y]) <= 0.03


def test_all_hits_are_learned_from(monkeypatch):
    seen = []

    def fit(columns, many, windows, label, **_):
        seen.append((len(windows) - 1, label))
        return np.zeros(many), crf.Chain()

    monkeypatch.setattr(crf, "fit", fit)
    toxic = [(f"a{i} " + "the vilest word of all " * 10, 1) for i in range(800)]
    toxicity.fit(toxic + [(f"b{i} " + "the nicest word of all " * 10, 0) for i in range(800)])
    assert seen[0][0] >= 8000 + 1600


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    pairs = held_out_rows(queries.QUERIES["op9_quality_nbsvm"](spark, sf).collect(), labels, "quality")
    assert np.mean([p == y for _, p, y in pairs]) >= 0.97


def test_dual_descent_is_optimal_and_scored_alike():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcd " if k % 2 else "bcdx "), 30)) for k in range(24)]
    y = np.array([1 if k % 2 else -1 for k in range(24)])
    rows = list(nbsvm.Distinct().rows(vectext.Texts(pa.array(texts, pa.large_string()))))
    counts = {s: 1.0 + sum(np.bincount(f, minlength=1 << nbsvm.BITS) for f, t in zip(rows, y) if t == s) for s in (1, -1)}
    r = nbsvm._ratios(rows, y)
    assert np.allclose(r, np.log((counts[1] / counts[1].sum()) / (counts[-1] / counts[-1].sum())))
    used = np.unique(np.concatenate(rows))
    x = np.zeros((24, len(used)))
    for i, f in enumerate(rows):
        x[i, np.searchsorted(used, f)] = r[f]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # the same problem by projected gradient on the dense dual
    q, alpha = (x @ x.T) * np.outer(y, y), np.zeros(24)
    for _ in range(20_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, 0.05)
    want = x @ (x.T @ (alpha * y))
    w = nbsvm.dual_descent(rows, y, r, rounds=5000, least=1e-12)
    model = nbsvm.Model(w, r * r, 1.0, 0.0)
    assert np.allclose(model.margins(vectext.Texts(pa.array(texts, pa.large_string()))), want, atol=1e-6)


def test_fit_sample_is_bounded_and_repeatable(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(60)] * 2 + [(None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2 + [(None, 1), (3, None)], "doc_id long, quality long")
    all_rows = labelled.sample(docs, labels, "quality")
    learnable = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(all_rows) == len(learnable) and labelled.sample(docs.repartition(7), labels, "quality") == all_rows
    assert len(labelled.sample(docs, labels, "quality", rows=10)) == 10 and len(labelled.sample(docs, labels, "quality", chars=550)) == 5
    assert labelled.sample(docs.where("false"), labels, "quality") == []


def test_spans_point_at_words(spark):
    bad = [(f"the {w} is a {w} of the town number {i}", 1) for i, w in enumerate(["idiot", "moron"] * 20)]
    good = [(f"the baker is a friend of the town number {i}", 0) for i in range(80)]
    model = toxicity.fit(bad + good)
    df = spark.createDataFrame([(1, "Ünder, the IDIOT came"), (2, "the friend came"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.tag(df, model).collect()}
    assert [got[1].text[a:b] for a, b in got[1].spans] == ["IDIOT"] and got[2].spans == [] and got[3].spans == []
    assert got[1].score > 0.7 > got[2].score


def test_classifiers_odd(odd):
    for fit, use in ((nbsvm.fit, nbsvm.score), (toxicity.fit, toxicity.tag)):
        for examples in ([], [("only one class", 1)], [("a b c", 1), ("d e f", 0), ("", 0)]):
            got = use(odd, fit(examples)).collect()
            assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 and r.n_tokens == 7 for r in got)
            assert len({round(r.score, 12) for r in got if r.text == "same text"}) == 1
        assert use(odd.where("false"), fit([])).count() == 0


def test_sharding(spark, docs):
    rows = queries.QUERIES["op5_sharding_splitters"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    total, shard_bytes = 0, collections.Counter()
    for r in rows:
        assert r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.grown_shard is None
        shard_bytes[r.shard] += r.size
        total += r.size
    most = max(r.size for r in rows)
    assert set(shard_bytes) == set(range(8)) and all(abs(b - total / 8) <= most for b in shard_bytes.values())
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_sharding_odd_and_rows_law(spark, odd):
    for law in ("bytes", "rows"):
        got = sharding.shard(odd, law=law).collect()
        assert len(got) == len(ODD) + 1
    n = collections.Counter(r.shard for r in sharding.shard(odd, law="rows").collect())
    assert max(n.values()) - min(n[s] for s in range(8)) <= 1
    assert sharding.shard(odd.where("false")).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.repeat(F.lit("x"), (F.col("id") % 90 + 1).cast("int"))).alias("text"))
    size = collections.Counter()
    for r in sharding.shard(hot).collect():
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 2 * 91
    with pytest.raises(ValueError):
        sharding.shard(odd, law="none")


def test_shards_end_at_splitters(spark):
    sizes = [1 + (i * 37) % 400 for i in range(2000)] + [30_000]
    docs = spark.createDataFrame([(i, "x" * n, "clash") for i, n in enumerate(sizes)], "doc_id long, text string, shard string")
    for law in ("bytes", "rows"):
        got = sharding.shard(docs, law=law).collect()
        order = sorted(got, key=lambda r: (r.shard, r.slot))
        total, before, row = sum(sizes) + len(sizes), 0, 0
        for r in order:  # the law, from the order alone
            want = (2 * before + r.size) * 8 // (2 * total) if law == "bytes" else row * 8 // len(order)
            assert r.shard == want
            before, row = before + r.size, row + 1
        seen = {}
        for r in order:  # equal texts lie together
            seen.setdefault(r.text_crc32, []).append((r.shard, r.slot))
        assert max(b[0] - a[0] for v in seen.values() for a, b in zip(v, v[1:])) <= 1


def test_places_match_sorted_search():
    rng = np.random.default_rng(2)
    s = np.unique(rng.integers(0, 6, (40, 2)), axis=0)
    keys = rng.integers(0, 6, (300, 2))
    got = sharding._places(keys[:, 0], keys[:, 1], s[:, 0], s[:, 1])
    assert got.tolist() == [sum(tuple(x) <= tuple(k) for x in s.tolist()) for k in keys.tolist()]


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_alignment_is_exact():
    rng, pairs, want = random.Random(3), [], []
    for _ in range(300):
        a = [rng.randint(10, 40) for _ in range(rng.randint(0, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 14)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = [rng.randint(10, 40)] * rng.randint(0, 1)
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
        want.append(not a and not b or bool(a and b) and 1 - edits(a, b) / max(len(a), len(b)) >= 0.8 - 1e-9)
    assert near_dedup.alike(pairs).tolist() == want


def brute_classes(texts):
    """Components of equal texts and of pairs whose words are 0.8 alike, over all pairs."""
    h, at = near_dedup.words(vectext.lowered(pa.array(texts, pa.large_string())))
    w = [h[a:b] for a, b in zip(at, at[1:])]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    bags = [set(x.tolist()) for x in w]
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i] != texts[j] and min(len(w[i]), len(w[j])) >= 0.8 * max(len(w[i]), len(w[j])) and len(bags[i] & bags[j]) >= 0.5 * len(bags[i] | bags[j]) and len(w[i])]
    ok = near_dedup.alike([(w[i], w[j]) for i, j in near])
    for (i, j), x in [*zip(near, ok), *(((i, j), True) for i, j in itertools.combinations(range(len(texts)), 2) if (texts[i] or "") == (texts[j] or ""))]:
        if x:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_near_duplicates(spark, docs):
    found = queries.QUERIES["op4_near_dedup_omh"](spark, SF).collect()
    ids = sorted(docs)
    mine = {r.doc_id: r.class_id for r in found}
    assert same_partition([mine[i] for i in ids], brute_classes([docs[i] for i in ids]))
    assert all(r.stays == (r.class_id == r.doc_id) and r.class_id <= r.doc_id for r in found)


def test_near_duplicates_chains_and_odd(spark, odd):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(80)]
    texts = [" ".join(base)]
    for k in range(6):  # a chain: neighbours alike, its ends not
        base = [f"v{k}{i}" if i // 12 == k else x for i, x in enumerate(base)]
        texts.append(" ".join(base))
    texts += [" ".join(f"u{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(5)] + ["!!!", "???", "one two three", "One, two three."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mine = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert same_partition([mine[i] for i in range(len(texts))], brute_classes(texts))
    got = near_dedup.classes(odd).collect()
    assert len(got) == len(ODD) + 1 and len({r.class_id for r in got if r.doc_id in (9, 10)}) == 1
    assert near_dedup.classes(odd.where("false")).count() == 0
    assert len([r for r in got if r.stays]) == len({r.node for r in got}) and [r.doc_id for r in got if r.stays and r.class_id is None] == [None]
    kept = near_dedup.deduplicated(odd).collect()
    assert sorted(r.text or "" for r in kept) == sorted({t or "" for t in ODD}) and [r.doc_id for r in kept if r.text == "same text"] == [9]


def sharing(texts):
    """Pairs of texts that share a sketch and are alike."""
    h, at = near_dedup.words(vectext.lowered(pa.array(texts, pa.large_string())))
    s, by = near_dedup.sketches(h, at), collections.defaultdict(list)
    for i, row in enumerate(s.tolist()):
        for k in enumerate(row):
            if k[1]:
                by[k].append(i)
    met = sorted({p for v in by.values() for p in itertools.combinations(v, 2)})
    return [p for p, ok in zip(met, near_dedup.alike([(h[at[i] : at[i + 1]], h[at[j] : at[j + 1]]) for i, j in met])) if ok]


def test_near_duplicates_around_a_shared_passage(spark):
    rng = random.Random(7)
    passage, texts = [f"p{i}" for i in range(60)], []
    for k in range(150):  # pairs alike only in their own words; all texts meet in the passage's buckets
        own = [f"k{k}x{i}" for i in range(17)]
        other = list(own)
        for i in rng.sample(range(17), 3):
            other[i] = f"k{k}y{i}"
        texts += [" ".join(passage + own), " ".join(passage + other)]
    pairs = sharing(texts)
    assert len(pairs) >= 145 and all(i // 2 == j // 2 for i, j in pairs)
    found = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [p for p in pairs if found[p[0]] != found[p[1]]] == []
    assert all(c // 2 == i // 2 for i, c in found.items())


def test_near_duplicates_in_a_template(spark, monkeypatch):
    rng, texts = random.Random(11), []
    common = [f"t{i}" for i in range(70)]
    for k in range(20):  # pairs that share 70 % with all others
        own = [f"k{k}x{i}" for i in range(30)]
        other = [w if rng.random() > 0.2 else f"k{k}y{i}" for i, w in enumerate(own)]
        texts += [" ".join(common + own), " ".join(common + other)]
    for block in (512, 8):  # buckets in one block, and in many
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        found = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert all(found[i] == i // 2 * 2 for i in range(len(texts)))


def test_near_duplicates_of_long_texts(spark):
    rng = random.Random(12)
    long = [f"w{rng.randint(0, 999)}" for _ in range(20_000)]
    texts = [" ".join(long), " ".join(w for w in long if rng.random() > 0.01), " ".join(rng.sample(long, len(long)))]
    found = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {0: 0, 1: 0, 2: 2}


def test_alike_texts_share_a_sketch():
    rng = np.random.default_rng(1)
    for size, edited in ((12, 2), (20, 4), (20, 3), (50, 10), (100, 20), (100, 15), (300, 60)):
        a = rng.integers(1, 1 << 60, (200, size)).astype(np.uint64)
        b = a.copy()
        for row in b:
            row[rng.choice(size, edited, replace=False)] = rng.integers(1, 1 << 60, edited)
        at = np.arange(201) * size
        s = near_dedup.sketches(a.ravel(), at)
        met = ((s == near_dedup.sketches(b.ravel(), at)) & (s != 0)).any(1)
        assert met.mean() >= 0.97, (size, edited, met.mean())


def test_rarest_words_meet():
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        a = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 40))]
        b = [w for w in a if rng.random() > 0.08]
        texts += [" ".join(a), " ".join(b)]
    h, at = near_dedup.words(vectext.lowered(pa.array(texts, pa.large_string())))
    word = near_dedup.labelled(h, at)
    known = np.unique(word)
    place, cut = near_dedup.rarest(word, at, known[::2], np.arange(len(known[::2])) % 7)
    rare = word[place]
    near = list(itertools.combinations(range(len(texts)), 2))
    ok = near_dedup.alike([(h[at[i] : at[i + 1]], h[at[j] : at[j + 1]]) for i, j in near])
    assert all(set(rare[cut[i] : cut[i + 1]].tolist()) & set(rare[cut[j] : cut[j + 1]].tolist()) for (i, j), x in zip(near, ok) if x and at[i] < at[i + 1])


def test_lcs_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 12))] for _ in "ab")
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
        c = html.common(a, b)
        rest = iter(b)
        assert len(c) == n[-1][-1] and c == sorted(set(c)) and all(a[k] in rest for k in c)


def test_lcs_in_little_memory(monkeypatch):
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 40))] for _ in range(2))
        whole = html.common(a, b)
        monkeypatch.setattr(html, "CELLS", 8)
        cut = html.common(a, b)
        monkeypatch.undo()
        rest = iter(b)
        assert len(cut) == len(whole) and cut == sorted(set(cut)) and all(a[i] in rest for i in cut)


def test_html_pages(spark):
    import html as std

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.QUERIES["op3_html_differencing"](spark, SF).collect():
        body = pages[r.page_id].split("<article>", 1)[1].split("</article>", 1)[0]
        parts = [" ".join(std.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_html_differencing_without_marks(spark):
    page = "<html><head><title>t</title></head><body><div>Site name</div><p>Home &gt; News</p><p>{}</p><p>{}</p><p>All rights reserved</p></body></html>"
    rows = [(i, f"http://h.example/a/{i}", page.format(f"Story {i}", f"More &amp; more {i}"), 1) for i in range(6)]
    rows += [(10, None, None, 1), (11, "http://h.example/b", "", 1), (12, "http://g.example/x", "<p>Alone</p><script>var a='</p>';</script>", 1), (13, "http://g.example/y", "<main><p>In</p><div class='comments'><p>No</p></div></main><p>Out</p>", 1)]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert html.extract(df).count() == len(rows)
    for i in range(1, 6):
        assert got[i] == f"Story {i}\nMore & more {i}"
    assert (got[10], got[11], got[12], got[13]) == ("", "", "Alone", "In")
    assert html.extract(df.where("false")).count() == 0


def test_html_differencing_beyond_copies(spark):
    page = "<div>Site name</div><p>{}</p><p>All rights reserved</p>"
    rows = [(i, f"http://h.example/a/{i}", page.format("One story")) for i in range(1, 6)]
    rows += [(6, "http://h.example/a/6", ""), (7, "http://h.example/b", page.format("Another story")), (8, "http://i.example/b", page.format("Another story"))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    alone = "Site name\nAnother story\nAll rights reserved"
    assert got == {i: "One story" for i in range(1, 6)} | {6: "", 7: "Another story", 8: alone}


def test_html_partners_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(160):
        lines = rng.choice([["x", "a", "y"], ["x", "b", "y"], ["x", "y"], ["y", "c"], []])
        rows.append((i, f"http://{rng.choice('gggh')}.example/{rng.choice('ab')}{rng.choice('ab')}/{rng.randint(0, 99)}", "".join(f"<p>{t}</p>" for t in lines), lines))
    host = lambda r: r[1].split("/")[2]
    path = lambda r: r[1].split("example")[1]
    begin = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want, loose = {}, 0
    for r in rows:
        others = [(begin(path(r), path(o)), o) for o in rows if host(o) == host(r) and o[3] and o[3] != r[3]]
        near = [o[3] for n, o in others if n == max(n for n, _ in others)]
        want[r[0]] = {"\n".join(t for k, t in enumerate(r[3]) if k not in html.common(list(map(ord, r[3])), list(map(ord, o)))) for o in near} if r[3] else {""}
        loose += len(want[r[0]]) > 1
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and all(got[i] in want[i] for i in want) and loose < len(rows) / 2


def test_sampled_segmentations_are_exact():
    lat = piece_sampling.lattices(piece_sampling.default_model())
    v = lat.v

    def ways(s):
        return [((), 0.0)] if not s else [(ids + r, w + x) for ids, end, w in v.edges(s, 0) for r, x in ways(s[end:])]

    every = ways("▁the▁cat.")
    z = math.log(sum(math.exp(w) for _, w in every))
    p = {ids: math.exp(w - z) for ids, w in every}
    n, first, mass = 3000, collections.Counter(), 0.0
    seeds = vectext.mix(np.arange(n).astype(np.uint64) * np.uint64(77) + np.uint64(5))
    for found, key in piece_sampling.sample_texts(lat, ["the cat."] * n, seeds, 3):
        ids = [tuple(piece_sampling.ids_of(lat, w.edge).tolist()) for w in found]
        assert len(set(ids)) == 3 and found[0].key >= found[1].key >= found[2].key >= key
        assert all(abs(math.exp(w.logp) - p[i]) < 1e-6 for w, i in zip(found, ids))
        first[ids[0]] += 1
        mass += sum(p[i] / -math.expm1(-math.exp(w.logp - key)) for w, i in zip(found, ids))
    assert abs(mass / n - 1) < 0.02  # inclusion scores make an unbiased sum
    for ids, q in p.items():
        assert abs(first[ids] / n - q) < 0.04


def test_rare_segmentations_are_given():
    lat = piece_sampling.lattices(piece_sampling.default_model())
    seeds = vectext.mix(np.arange(3).astype(np.uint64) + np.uint64(9))
    for found, key in piece_sampling.sample_texts(lat, ["a", "t", "I"], seeds, 3):
        assert len({tuple(piece_sampling.ids_of(lat, w.edge).tolist()) for w in found}) == len(found) == 2 and key == -math.inf


def test_segmentations_round_trip(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.default_model())
    rows = piece_sampling.sample(odd, k=3).collect()
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(sp.decode(r.ids) == text[r.doc_id] and len(r.ids) == r.n_pieces and 0 <= r.inclusion <= 1 for r in rows if r.doc_id != 6)
    back = piece_sampling.decode(piece_sampling.sample(odd, k=2)).collect()
    assert all(r.text == text[r.doc_id] for r in back)
    per = collections.Counter(r.doc_id for r in rows)
    assert per[0] == 1 and per[7] == 3
    assert all(r.text == sp.decode(r.ids) for r in piece_sampling.decode(piece_sampling.encode(odd.where("length(text) < 50"))).collect())
    again = piece_sampling.sample(odd.repartition(3), k=3).collect()
    assert sorted((str(r.doc_id), r.rank, r.ids_crc32) for r in again) == sorted((str(r.doc_id), r.rank, r.ids_crc32) for r in rows)
    assert piece_sampling.sample(odd.where("false")).count() == 0


def test_query_encodes_and_decodes(spark, odd, docs, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.default_model())
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    more = spark.createDataFrame([(50, "\n a\n\n  b\x00c \n"), (51, "Mr. X, u.s.a.,b\u3000\u00a0 naïve\r\n...  "), (52, " ")], "doc_id long, text string")
    rows = [*queries.op10_piece_sampling(spark, SF).collect(), *piece_sampling.sample(odd.where("doc_id <> 9").select("doc_id", "text").union(more), with_digests=True, with_ids=False).collect()]
    text = docs | {}
    own = {r.doc_id: r.text or "" for r in odd.select("doc_id", "text").union(more).collect()}
    for r in rows[: 3 * len(docs)]:
        assert (r.encoded_pieces, r.encoded_crc32) == (len(x := sp.encode(text[r.doc_id])), crc(x))
        assert r.round_trip and r.decoded_crc32 == zlib.crc32(text[r.doc_id].encode())
    for r in rows[3 * len(docs) :]:
        assert (r.encoded_pieces, r.encoded_crc32) == (len(x := sp.encode(own[r.doc_id])), crc(x))
        assert r.round_trip and r.decoded_crc32 == zlib.crc32(own[r.doc_id].encode())
    lat = piece_sampling.lattices(piece_sampling.default_model())
    monkeypatch.setattr(lat.v, "by_unit", False)  # as with a model whose pieces go across units
    seeds = np.arange(2).astype(np.uint64)
    assert [best.tolist() for _, _, best in piece_sampling.sample_texts(lat, ["the cat.", ""], seeds, 3, True)] == [sp.encode("the cat."), []]


def png(x):
    """A grey PNG whose rows use all five filters."""
    raw, prev = b"", np.zeros(x.shape[1], np.int64)
    for y, row in enumerate(x.astype(np.int64)):
        left, corner = np.concatenate(([0], row[:-1])), np.concatenate(([0], prev[:-1]))
        p = left + prev - corner
        a, b, c = abs(p - left), abs(p - prev), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, prev, corner))
        guess = [0 * row, left, prev, (left + prev) // 2, paeth][y % 5]
        raw += bytes([y % 5]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        prev = row
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    head = x.shape[1].to_bytes(4, "big") + x.shape[0].to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_formats():
    x = np.random.default_rng(0).integers(0, 256, (23, 31)).astype(np.uint8)
    assert np.allclose(media.decode(png(x)) * 255, x) and np.allclose(media.decode(media.pgm(x / 255)) * 255, x)
    for bad in (None, b"", b"nothing", b"P5 9", b"P5 9 9 0\n" + bytes(81), b"P5 9 9 255\n" + bytes(80), b"P5 0 9 255\n", b"P6 # no end", b"P5" + b" " * 9999, b"\x89PNG\r\n\x1a\n", png(x)[:60]):
        assert media.decode(bad) is None
    assert media.decode(b"P5 # a note\n 2\t1 # another\n255\n" + bytes([0, 255])).tolist() == [[0.0, 1.0]]


def test_consensus_in_parts(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 1, (90, 120))
    a, b = media.describe(x), media.describe(np.rot90(x))
    whole = media.matches(a, b)
    monkeypatch.setattr(media, "PART", 64)
    assert media.matches(a, b) == whole >= media.AGREE and media.matches(a, media.describe(rng.uniform(0, 1, (90, 120)))) < media.AGREE


def brute_copies(images):
    """Components over all pairs that share a quarter of a descriptor within MATCH_BITS and whose corners agree, and of equal bytes."""
    found, parent = [media.describe(media.decode(x)) for x in images], list(range(len(images)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, j in itertools.combinations(range(len(images)), 2):
        a, b = found[i][1], found[j][1]
        far = np.bitwise_count(a[:, None] ^ b[None]).sum(2)
        quarter = (np.ascontiguousarray(a).view(np.uint32)[:, None] == np.ascontiguousarray(b).view(np.uint32)[None]).any(2)
        if (images[i] or b"") == (images[j] or b"") or (quarter & (far <= media.MATCH_BITS)).any() and media.matches(found[i], found[j]) >= media.AGREE:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(images))]


def test_copies_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    images, logo = [], media.picture(rng.normal(0, 0.125, 64), 40)
    for k in range(8):  # unrelated pictures with one logo, so that all meet in its buckets
        x = media.picture(rng.normal(0, 0.125, 64), 96)
        x[10:50, 10:50] = logo
        images += [media.pgm(x), media.pgm(media.edited(x, k))]
    images += [images[0], None, b"", media.pgm(np.zeros((30, 30)))]
    frame = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(images)], "image_id long, image binary, class_id string")
    for block in (512, 4):
        monkeypatch.setattr(media, "BLOCK", block)
        got = {r.image_id: r.class_id for r in media.copies(frame).collect()}
        assert same_partition([got[i] for i in range(len(images))], brute_copies(images))


def test_copies_are_found(spark):
    rng = np.random.default_rng(4)
    rows, truth = [], {}
    for i in range(12):
        x = media.picture(rng.normal(0, 0.125, 64))
        for k, y in enumerate((x, media.edited(x, i), x[6:, 4:], np.rot90(x) if i < 4 else x[:88, :90])):
            rows.append((i * 10 + k, png(np.clip(y * 255, 0, 255).astype(np.uint8)) if k % 2 else media.pgm(y)))
            truth[i * 10 + k] = i
    rows += [(900, None), (901, b"junk"), (902, b""), (0, rows[0][1])]
    got = [(r.image_id, r.class_id) for r in media.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()]
    assert len(got) == len(rows)
    found = dict(got)
    assert all(truth[a] == truth[b] for a, b in found.items() if a in truth)
    assert np.mean([found[i] == truth[i] * 10 for i in truth]) > 0.9
    assert found[900] == found[902] == 900 and found[901] == 901
    assert media.copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0


def test_copies_that_share_one_quarter(spark, monkeypatch):
    rng = np.random.default_rng(6)
    bits = rng.integers(0, 1 << 62, (12, 2))
    other = bits ^ ((1 << 5) | (1 << 40))  # a bit in each quarter
    other[0, 0] ^= 1 << 5  # but one
    x, y = rng.uniform(0, 90, 12).tolist(), rng.uniform(0, 90, 12).tolist()
    rows = [(i, bytes([i]), x, y, [1.0] * 12, [0.0] * 12, b[:, 0].tolist(), b[:, 1].tolist()) for i, b in enumerate((bits, other))]
    frame = spark.createDataFrame(rows, "image_id long, node binary, x array<float>, y array<float>, s array<float>, a array<float>, lo array<long>, hi array<long>")
    monkeypatch.setattr(media, "descriptors", lambda *_: frame)
    assert sorted((r.image_id, r.class_id) for r in media.copies(frame).collect()) == [(0, 0), (1, 0)]


def test_pairs_by_chance_travel_without_corners(spark, monkeypatch):
    rng = np.random.default_rng(12)
    bits = rng.integers(0, 1 << 62, (30, 13, 2))
    places = rng.uniform(0, 90, (30, 13, 2))
    bits[:, 12] = bits[0, 12]  # one corner in all images, so that all pairs meet
    flip = sum(1 << k for k in (5, 40))  # a bit in each quarter, so that nothing else is in one bucket
    bits[21, :12], places[21] = bits[20, :12] ^ flip, places[20]
    bits[23, :7] = bits[22, :7] ^ flip  # corners that match and agree on no transform
    rows = [(i, bytes([i]), *places[i].T.tolist(), [1.0] * 13, [0.0] * 13, *bits[i].T.tolist()) for i in range(30)]
    frame = spark.createDataFrame(rows, "image_id long, node binary, x array<float>, y array<float>, s array<float>, a array<float>, lo array<long>, hi array<long>")
    monkeypatch.setattr(media, "descriptors", lambda *_: frame)
    joined, agreeing = [], media._agreeing

    def noted(pairs, nodes):
        name = {r.n: r.node[0] for r in nodes.select("n", "node").collect()}
        joined.append({tuple(sorted((name[r.a], name[r.b]))) for r in pairs.collect()})
        return agreeing(pairs, nodes)

    monkeypatch.setattr(media, "_agreeing", noted)
    for block, side in ((512, 1 << 19), (4, 16)):
        joined.clear()
        monkeypatch.setattr(media, "BLOCK", block)
        monkeypatch.setattr(media, "SIDE", side)
        got = {r.image_id: r.class_id for r in media.copies(frame).collect()}
        assert joined[1] == {(20, 21), (22, 23)}
        assert got == {i: 20 if i == 21 else i for i in range(30)}


def test_unneeded_tables_go(spark):
    rows = common.written(spark.range(9).repartition(3), "some table")
    folder = pathlib.Path(urllib.parse.unquote(urllib.parse.urlparse(rows.inputFiles()[0]).path)).parent
    assert folder.name.startswith("some table") and rows.count() == 9
    common.unneeded(rows)
    assert not folder.exists() and folder.parent.exists()


def test_album_recall(spark):
    got = {r.image_id: r.class_id for r in queries.QUERIES["op1_media_copies"](spark, SF).collect()}
    assert set(got) == {2 * r.vec_id + k for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect() for k in (0, 1)}
    pairs = [got[i] == got[i + 1] for i in got if i % 2 == 0]
    assert np.mean(pairs) >= 0.9 and all(c // 2 == i // 2 for i, c in got.items())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == sorted(want)


def test_hashes_and_pieces():
    t = vectext.Texts(pa.array(["ab cd\nab", None, "", " x", "y"]))
    p = vectext.Pieces(t, ~vectext.SPACE[t.data])
    assert p.row.tolist() == [0, 0, 0, 3, 4] and p.at.tolist() == [0, 3, 3, 3, 4, 5]
    h = vectext.hashes(t.data, p)
    assert h[0] == h[2] and len(set(h.tolist())) == 4
    assert vectext.repeats(h, p.row)[0].tolist() == [0, 0, 1, 0, 0]
