"""Invariants and small cases of the core operators."""

import itertools

import pytest
from pyspark.sql import functions as F

from stowage.config import ShuffleConfig
from stowage.functions import text as T
from stowage.operators import histograms, jobs, logs, routing, sampling, sorting
from stowage.plans import packing, padding
from stowage.sources import tables
from stowage.streaming import words


def hist(spark, counts):
    return spark.createDataFrame(list(counts.items()), "key string, w long")


def test_config_defaults_and_errors(spark):
    c = ShuffleConfig.from_spark(spark)
    assert (c.alpha, c.beta, c.bins, c.batch_size, c.global_seed, c.binomial_mode) == (0.01, 0.1, 64, 100, 1337, "exact")
    spark.conf.set("spark.stowage.bins", "8")
    try:
        assert ShuffleConfig.from_spark(spark).bins == 8
    finally:
        spark.conf.unset("spark.stowage.bins")
    for bad in ({"histogram": "x"}, {"balanced_shuffle_order": "x"}, {"binomial_mode": "x"}, {"bins": 0}):
        with pytest.raises(ValueError):
            ShuffleConfig(**bad)
    assert ShuffleConfig(fake_padding="Associative").is_associative


def test_java_hash(spark):
    def h(s):
        x = 0
        for c in s:
            x = (31 * x + ord(c)) & 0xFFFFFFFF
        return x - (1 << 32) if x >= 1 << 31 else x

    words_ = ["", "a", "Brand#13", "polygenelubricants", "é€"]
    rows = spark.createDataFrame([(w,) for w in words_], "k string").select("k", T.java_hash(F.col("k")).alias("h")).collect()
    assert {r.k: r.h for r in rows} == {w: h(w) for w in words_}
    assert h("polygenelubricants") == -(1 << 31)
    bins = spark.createDataFrame([("polygenelubricants",)], "k string").select(packing.fallback_bin(F.col("k"), 7).alias("b")).first().b
    assert 0 <= bins < 7


def test_space_words_keep_leading_and_drop_trailing(spark):
    rows = spark.createDataFrame([("  a b ",), ("",), ("   ",), ("x",)], "l string").select(T.words_space(F.col("l")).alias("w")).collect()
    assert [r.w for r in rows] == [["", "a", "b"], [""], [], ["x"]]


def test_strip_words_may_be_empty(spark):
    rows = spark.createDataFrame([(" Don't -- stop ",)], "l string").select(T.words_strip(F.col("l")).alias("w")).collect()
    assert rows[0].w == ["dont", "", "stop"]


def test_tab_pairs_reject_other_arities(spark):
    k, v = tables.tab_pairs(F.col("line"))
    good = spark.createDataFrame([("a\t1.5",)], "line string").select(k.alias("k"), v.alias("v")).first()
    assert (good.k, good.v) == ("a", 1.5)
    with pytest.raises(Exception, match="not two fields"):
        spark.createDataFrame([("a\tb\tc",)], "line string").select(k, v).collect()


def test_tagged_record_types(spark):
    with pytest.raises(ValueError):
        tables.tagged(F.lit(1), F.lit(1), "float", "int", F.lit(False))


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("x y\nz\n")
    (tmp_path / "in" / "deep" / "b.txt").write_text("z\n")
    src = f"file://{tmp_path}/in"
    assert tables.text_lines(spark, src, recursive=True).count() == 3
    assert {r.path.rsplit("/", 1)[1]: r.content for r in tables.whole_files(spark, src).collect()} == {"a.txt": "x y\nz\n", "b.txt": "z\n"}
    jobs.run(spark, f"{src}/a.txt", "HIST", f"file://{tmp_path}/hist")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/hist").collect()) == ["x\t1", "y\t1", "z\t1"]
    with pytest.raises(ValueError):
        jobs.run(spark, src, "nothing", f"file://{tmp_path}/no")
    spark.createDataFrame([(1, "p"), (2, "q")], "a int, b string").write.parquet(f"file://{tmp_path}/part-1")
    tables.parquet_to_csv(spark, f"file://{tmp_path}/part-*", f"file://{tmp_path}/csv")
    got = tables.csv_pairs(spark, f"file://{tmp_path}/csv", ["a"], ["b"]).collect()
    assert sorted((r.key, r.value) for r in got) == [("1", "p"), ("2", "q")]
    tables.write_text(tables.csv_pairs(spark, f"file://{tmp_path}/csv", ["a", "b"], ["b"]), f"file://{tmp_path}/txt")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/txt").collect()) == ["1,p", "2,q"]


def test_all_jobs_run(spark, tmp_path):
    (tmp_path / "pairs.txt").write_text("a\t1\nb\t2\na\t3\n")
    for name in ("median", "invertedindex", "hist_median", "terasort", "pagerank"):
        jobs.run(spark, f"file://{tmp_path}/pairs.txt", name, f"file://{tmp_path}/{name}")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/median").collect()) == ["a\t2.0", "b\t2.0"]
    assert "a\tcount=2\tmedian=1.0" in [r.value for r in spark.read.text(f"file://{tmp_path}/hist_median").collect()]


def test_index_moves_each_pair_once(spark):
    docs = spark.createDataFrame([(10, "a b  a\nb c"), (9, "a\n\n \t\n b "), (9, "c a"), (None, "d a"), (8, None)], "doc_id long, text string")
    got = jobs.inverted_index(docs, "doc_id", T.words_of_lines(F.col("text")))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    expected = {"a": "10,9", "b": "10,9", "c": "10,9", "": "9", "d": ""}
    assert {r.word: r.docs for r in got.collect()} == expected and got.count() == len(expected)
    lines = jobs.inverted_index(T.lines(docs, "text", "doc_id"), "doc_id", T.words_space(F.col("line")))
    assert {r.word: r.docs for r in lines.collect()} == expected
    named = jobs.inverted_index(docs.select(F.format_string("d%s", "doc_id").alias("path"), "text"), "path", T.words_of_lines(F.col("text")), ", ")
    assert {r.word: r.docs for r in named.collect()}["c"] == "d10, d9"


def test_greedy_balances(spark):
    plan = packing.plan(hist(spark, {"a": 10, "b": 8, "c": 6, "d": 4, "e": 2}), 2)
    loads = [r.load for r in packing.loads(plan, 2).collect()]
    assert sum(loads) == 30 and abs(loads[0] - loads[1]) <= 4
    with pytest.raises(ValueError):
        packing.plan(hist(spark, {"a": 1}), 2, order="random")


def test_next_fit_raises_when_bins_run_out(spark):
    with pytest.raises(Exception, match="BinsExhausted"):
        packing.plan(hist(spark, {"a": 250, "b": 1}), 2, "next_fit").collect()


@pytest.mark.parametrize("rule", ["greedy", "split_lightest", "split_sequential"])
def test_no_weight_is_lost(spark, rule):
    counts = {f"k{i:02d}": 5 + (i * 7) % 11 for i in range(30)}
    plan = packing.plan(hist(spark, counts), 4, rule)
    assert sum(r.load for r in packing.loads(plan, 4).collect()) == sum(counts.values())


def lightest_by_hand(weights, bins):
    """The split on the lightest bin, step by step: (bin, first part, rest's bin)."""
    mean, loads, out = sum(weights) / bins, [0] * bins, []
    for w in weights:
        b = min(range(bins), key=lambda i: (loads[i], i))
        if loads[b] + w <= mean:
            loads[b] += w
            out.append((b, w, None))
            continue
        first = min(w, max(0, int(mean - loads[b])))
        other = min(b + 1, bins - 1)
        loads[b] += first
        loads[other] += w - first
        out.append((b, first, other))
    return out


@pytest.mark.parametrize("counts", [[90, 75, 60, 5, 3, 2], [1000, 1, 1], [7] * 20, [1, 500, 1, 400]])
def test_split_on_the_lightest_in_full(spark, counts):
    named = {f"k{i:02d}": w for i, w in enumerate(counts)}
    got = sorted(tuple(r) for r in packing.plan(hist(spark, named), 4, "split_lightest").collect())
    assert [(r[2], r[3], r[4]) for r in got] == lightest_by_hand(counts, 4)


def test_split_in_order_with_keys_over_a_bin(spark):
    got = sorted(tuple(r) for r in packing.plan(hist(spark, {"a": 10, "b": 50, "c": 20, "d": 20}), 4, "split_sequential").collect())
    assert [(r[2], r[3], r[4]) for r in got] == [(0, 10, None), (0, 15, 1), (2, 20, None), (2, 5, 3)]


def test_too_many_keys_for_a_plan(spark):
    with pytest.raises(ValueError, match="heavy"):
        packing.plan(hist(spark, {"a": 1, "b": 1}), 2, most=1)
    assert packing.heavy_rows(hist(spark, {"a": 900, "b": 60, "c": 40}), 2, share=5) == [("a", 900)]


def test_fakes_are_exchanged(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.format_string("k%d", F.col("id") % 50)).alias("key"), F.col("id").alias("value"), F.col("id").alias("row"))
    out = routing.planned_reduce(rows, "key", "value", "row", ShuffleConfig(alpha=1.0, bins=4), "count")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "direct_shuffle_partition_id" in plan
    assert {r.key: r.value for r in out.collect()} == {"hot": 2000, **{f"k{i}": 20 for i in range(50)}}


def test_settings_act(spark):
    rows = spark.range(400).select(F.format_string("k%d", F.col("id") % 9).alias("key"), F.col("id").alias("value"), F.col("id").alias("row"))
    plain = {r.key: r.s for r in rows.groupBy("key").agg(F.sum("value").alias("s")).collect()}
    for c in (ShuffleConfig(alpha=1.0, bins=3, histogram="HashedCount"), ShuffleConfig(alpha=1.0, bins=3, balanced_shuffle="split_lightest"), ShuffleConfig(alpha=0.5, bins=3, c=4)):
        assert {r.key: r.value for r in routing.planned_reduce(rows, "key", "value", "row", c).collect()} == plain
    binned = sampling.prebin(spark.range(100), "id", 2, 1).withColumn("is_fake", F.col("id") % 2 == 0)
    for mode, groups in (("TaggedBatch", ["bin"]), ("FlaggedBatch", ["bin", "is_fake"])):
        got = routing.batches_of(binned, ["id"], ShuffleConfig(shuffle_mode=mode, batch_size=10)).groupBy(*groups, "batch_no").count().collect()
        assert max(r["count"] for r in got) == 10 and sum(r["count"] for r in got) == 100 and len(got) >= 10


def test_large_repeats_are_cut(spark):
    got = sampling.times(spark.range(3), F.col("id") * 10, "i", block=4).groupBy("id").agg(F.count("*").alias("n"), F.max("i").alias("top")).collect()
    assert {(r.id, r.n, r.top) for r in got} == {(1, 10, 9), (2, 20, 19)}


def test_broken_batches_are_errors(spark):
    sent = tables.whole_batches(spark.range(5).select("id", F.lit(1).alias("batch")), "batch")
    with pytest.raises(Exception, match="holds 5 records"):
        tables.from_whole_batches(sent.withColumn("records", F.lit(4)), "batch", "id bigint").collect()


def test_empty_histogram(spark):
    plan = packing.plan(hist(spark, {"a": 1}).where("false"), 3)
    assert plan.count() == 0 and [r.load for r in packing.loads(plan, 3).collect()] == [0, 0, 0]


def test_merges_agree(spark):
    a, b = hist(spark, {"x": 2, "y": 1}), hist(spark, {"y": 1, "z": 1})
    c = hist(spark, {"x": 1})
    one = {r.key: r.w for r in histograms.centralized(a, [b, c], "key").collect()}
    two = {r.key: r.w for r in histograms.decentralized(a, [b, c], "key").collect()}
    assert one == two == {"x": 3, "y": 2, "z": 1}


def test_capped_plus_overflow_is_exact(spark):
    rows = spark.createDataFrame([(0, k) for k in ["oak", "elm", "elm", "oak", "elm", "ash"]], "part int, key string")
    got = {r.key: (r.w, r.overflow) for r in histograms.capped(rows, "part", "key").collect()}
    assert got == {"oak": (1, 1), "elm": (1, 2), "ash": (1, 0)}


def test_binomial_modes():
    for mode in ("exact", "normal", "fast", "library"):
        b = sampling.Binomial(7, mode)
        assert b.draw(0, 0.5) == 0 and b.draw(10, 0.0) == 0 and b.draw(10, 1.0) == 10
        draws = [b.draw(1000, 0.5) for _ in range(50)]
        assert all(0 <= x <= 1000 for x in draws) and abs(sum(draws) / 50 - 500) < 20
        again = sampling.Binomial(7, mode)
        assert [again.draw(1000, 0.5) for _ in range(1)] == [sampling.Binomial(7, mode).draw(1000, 0.5)]
    with pytest.raises(ValueError):
        sampling.Binomial(1, "other")


def test_uniform_bins_are_even(spark):
    n = [r["count"] for r in sampling.prebin(spark.range(20000), "id", 8, 42).groupBy("bin").count().collect()]
    assert len(n) == 8 and max(abs(x - 2500) for x in n) < 250
    assert {r.bin for r in sampling.prebin(spark.range(100), "id", 1, 42, "Hierarchical").collect()} == {0}


def test_padding_plan(spark):
    loads = spark.createDataFrame([(0, 17), (1, 41)], "bin int, cnt long")
    one = padding.drawn(loads, 2, 1.0, 0.1, 123, target=100.0).collect()
    assert one == padding.drawn(loads, 2, 1.0, 0.1, 123, target=100.0).collect()
    plan = {r.bin: r.fake_cnt for r in padding.planned(loads, 2, 1.0, 0.1, 100.0).collect()}
    sums = {r.src_bin: r.s for r in padding.drawn_matrix(loads, 2, 1.0, 0.1, 5, target=100.0).groupBy("src_bin").agg(F.sum("fake_cnt").alias("s")).collect()}
    assert plan == sums == {0: int(1.1 * (150.0 - 17)), 1: int(1.1 * (150.0 - 41))}
    with pytest.raises(ValueError):
        padding.drawn(loads, 3, 1.0, 0.1, 1)


SKEWED = [120, 64, 51, 47, 33, 29, 22, 18, 17, 13, 12, 11, 9, 8, 6, 4, 3, 1, 1]


@pytest.mark.parametrize("mode, merge", list(itertools.product(["associative", "RepeatReal"], ["sum", "min", "max", "count"])))
def test_planned_reduce_equals_plain(spark, mode, merge):
    rows = [(f"key{k:02d}", v) for k, n in enumerate(SKEWED) for v in range(n)]
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "key string, value long, row long")
    got = {r.key: r.value for r in routing.planned_reduce(df, "key", "value", "row", ShuffleConfig(alpha=1.0, bins=10, fake_padding=mode), merge).collect()}
    f = {"sum": sum, "min": min, "max": max, "count": len}[merge]
    assert got == {k: f([v for q, v in rows if q == k]) for k, _ in rows}


def test_planned_reduce_sets_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 2, 3)], "key string, value long, row long")
    config = ShuffleConfig(alpha=1.0, bins=2)
    assert {r.key: sorted(r.value) for r in routing.planned_reduce(df, "key", "value", "row", config, "list").collect()} == {"a": [1, 1], "b": [2]}
    assert {r.key: sorted(r.value) for r in routing.planned_reduce(df, "key", "value", "row", config, "set").collect()} == {"a": [1], "b": [2]}
    assert routing.planned_reduce(df.where("false"), "key", "value", "row", config).count() == 0


def test_split_routing_splits(spark):
    df = spark.range(10000).select(F.lit("hot").alias("key"), "id")
    plan = packing.plan(histograms.counting(df, "key"), 4, "split_lightest")
    bins = [r["count"] for r in routing.by_plan(df, plan, 4, row="id", seed=1).groupBy("bin").count().orderBy("bin").collect()]
    assert len(bins) == 2 and abs(bins[0] - 2500) < 200


def test_bins_are_partitions(spark):
    df = sampling.prebin(spark.range(1000), "id", 7, 1)
    pairs = routing.place(df, 7).select("bin", F.spark_partition_id().alias("p")).distinct().collect()
    assert sorted((r.bin, r.p) for r in pairs) == [(b, b) for b in range(7)]


def test_column_sort_random(spark):
    for n, columns in ((0, 3), (1, 3), (500, 5), (57, 2)):
        df = spark.range(n).select((F.xxhash64("id") % 50).alias("key"), F.col("id").alias("row"))
        got = [r.key for r in sorting.column_sort(df, "key", "row", columns).orderBy("rank").collect()]
        assert got == sorted(r.key for r in df.collect())


def test_scaling_edges(spark):
    df = spark.range(10)
    assert sampling.scaled(df, 1.0, F.lit(0), F.col("id"), 1).count() == 10
    assert sampling.scaled(df, 0.0, F.lit(0), F.col("id"), 1).count() == 0
    assert sampling.scaled(df, 3.0, F.lit(0), F.col("id"), 1).count() == 30
    assert sampling.scaled(df, 1.55, F.lit(0), F.col("id"), 1).count() == 15


def test_permuted_keeps_every_row(spark):
    got = routing.permuted(spark.range(500), "id", ShuffleConfig(bins=10, global_seed=3), 5.0).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 501))
    assert sorted(r.id for r in got) == list(range(500)) and [r.id for r in got] != list(range(500))
    assert [r.tag for r in got] == sorted(r.tag for r in got)


def test_pagerank_duplicate_lines(spark):
    lines = spark.createDataFrame([("a b c",), ("a b c",), ("b a",), ("c",)], "line string")
    got = {r.id: r.rank for r in jobs.pagerank(jobs.edges_of(lines), 1).collect()}
    assert got == pytest.approx({"a": 1.0, "b": 0.575, "c": 0.575})


def test_log_stamps_are_year_month_day(spark):
    lines = spark.createDataFrame([("r", "24/12/31 23:59:58 INFO x"), ("r", "25/01/01 00:00:03 INFO DAGScheduler: Job 4 finished: reduce at A.scala:9, took 1.25 s"), ("r", "noise")], "run string, line string")
    r = logs.jobs(lines).first()
    assert (r.elapsed_sec, r.job_id, r.description, r.location, r.duration_sec) == (5.0, 4, "reduce", "A.scala:9", 1.25)


def test_stream_counts(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", "stream_words"
    spark.createDataFrame([("b a",), ("a",)], "text string").write.parquet(src)
    stream = spark.readStream.schema("text string").parquet(src)
    q = words.word_counts(stream).writeStream.outputMode("complete").format("memory").queryName(out).start()
    try:
        q.processAllAvailable()
        assert {r.word: r.cnt for r in spark.table(out).collect()} == {"a": 2, "b": 1}
    finally:
        q.stop()
    events = spark.createDataFrame([(1, "x"), (2, "x"), (9000, "y")], "s long, event_type string").select(F.timestamp_seconds("s").alias("ts"), "event_type")
    assert {(r.event_type, r.cnt) for r in words.event_counts(events).collect()} == {("x", 2), ("y", 1)}
