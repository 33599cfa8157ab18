"""The registered queries, each over whole tables, with a DuckDB twin in the same words."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ShuffleConfig
from .functions import text as T
from .operators import histograms as H
from .operators import jobs, logs, routing, sampling, sorting
from .plans import packing, padding
from .sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BINS, SEED = 4, 1337


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def draw(use: str, row: str, seed: int = SEED) -> str:
    """SQL for sampling.salted."""
    return f"(('0x' || substr(md5('{use}:{seed}:' || ({row})::varchar), 1, 8))::bigint)"


def _docs(spark, d):
    return S.table(spark, d, "documents")


def _lines(spark, d):
    return T.lines(_docs(spark, d), "text", "doc_id")


LINES = "(select doc_id, unnest(string_split(text, chr(10))) as line from documents)"
WS = f"(select doc_id, unnest(regexp_split_to_array(regexp_replace(line, '\\s+$', ''), '\\s+')) as word from {LINES} where not (length(line) > 0 and regexp_replace(line, '\\s+$', '') = ''))"
W = "(select doc_id, word from (select doc_id, unnest(regexp_split_to_array(lower(text), '\\W+')) as word from documents) where word <> '')"

# --- word and key jobs


@query(f"select word, count(*)::bigint as cnt from {W} group by word")
def word_count(spark, d):
    return jobs.counts(T.words(F.col("text")), _docs(spark, d))


@query(f"select word, count(*)::bigint as cnt from {WS} group by word")
def word_count_ws(spark, d):
    return jobs.counts(T.words_space(F.col("line")), _lines(spark, d))


@query("select word, count(*)::bigint as cnt from (select unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '\\s+')) as word from documents) where word <> '' group by word")
def word_count_clean(spark, d):
    return jobs.counts(T.words_clean(F.col("text")), _docs(spark, d))


@query("select regexp_replace(lower(p), '[^a-z0-9]', '', 'g') as word, count(*)::bigint as cnt from (select unnest(regexp_split_to_array(text, '\\s+')) as p from documents) where p <> '' group by 1")
def word_count_strip(spark, d):
    return jobs.counts(T.words_strip(F.col("text")), _docs(spark, d))


@query(f"select word, count(*)::bigint as cnt from {W} group by word order by cnt desc, word limit 20")
def top_words(spark, d):
    return sorting.top(word_count(spark, d), "cnt", ["word"])


@query("select l_suppkey as key, sum(l_quantity::bigint)::bigint as value from lineitem group by 1")
def key_sum(spark, d):
    """A planned, padded reduce; the twin is the plain aggregate."""
    rows = S.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_quantity").cast("bigint").alias("value"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row"))
    return routing.planned_reduce(rows, "key", "value", "row", ShuffleConfig(alpha=0.1, bins=BINS), "sum")


@query("select event_type as key, sum(user_id)::bigint as value from events group by 1")
def key_sum_split(spark, d):
    """A planned reduce that splits heavy keys over bins."""
    rows = S.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("value"), F.col("event_id").alias("row"))
    return routing.planned_reduce(rows, "key", "value", "row", ShuffleConfig(alpha=1.0, bins=BINS, fake_padding="associative"), "sum")


@query("select event_type as key, min(value) as min_value, max(value) as max_value from events group by 1")
def key_min_max(spark, d):
    return S.table(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))


@query("select o_custkey as key, count(*)::bigint as cnt from orders group by 1")
def key_count(spark, d):
    return S.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("cnt"))


@query("select l_suppkey as key, median(l_quantity)::double as median from lineitem group by 1")
def median_by_key(spark, d):
    return jobs.median_by_key(S.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), "l_quantity"), "key", "l_quantity")


@query("select event_type as key, round(median(value), 6)::double as median from events group by 1")
def median_by_event(spark, d):
    return jobs.median_by_key(S.table(spark, d, "events").select(F.col("event_type").alias("key"), "value"), "key", "value").withColumn("median", F.round("median", 6))


@query(f"select word, count(*)::bigint as cnt, 1.0::double as median from {WS} group by word")
def count_median(spark, d):
    return jobs.count_median(T.words_space(F.col("line")), _lines(spark, d))


@query(f"select word, string_agg(distinct doc_id::varchar, ',' order by doc_id::varchar) as docs from {WS} group by word")
def inverted_index_ids(spark, d):
    return jobs.inverted_index(_docs(spark, d), "doc_id", T.words_of_lines(F.col("text")))


@query("select word, string_agg(f, ', ' order by f) as docs from (select distinct 'doc-' || doc_id as f, word from " + W + ") group by word")
def inverted_index_files(spark, d):
    files = _docs(spark, d).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), "text")
    return jobs.inverted_index(files, "path", T.words(F.col("text")), ", ")


@query(f"select word, doc_id, count(*)::bigint as cnt from {W} group by word, doc_id")
def inverted_index_tf(spark, d):
    return jobs.inverted_index_tf(_docs(spark, d), "doc_id", T.words(F.col("text")))


EDGES = """select distinct c_nationkey as src, s_nationkey as dst from customer join orders on o_custkey = c_custkey
join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey"""
_RANK = "select src as id, 1.0::double as rank from deg"
PAGERANK = f"with e as ({EDGES}), deg as (select src, count(*) as deg from e group by src), r0 as ({_RANK})" + "".join(
    f", r{i} as (select e.dst as id, 0.15 + 0.85 * sum(r.rank / deg.deg) as rank from e join deg on deg.src = e.src join r{i - 1} r on r.id = e.src group by e.dst)" for i in range(1, 6)
) + " select id, round(rank, 6)::double as rank from r5"


def _trade(spark, d):
    c, o, li, s = (S.table(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier"))
    joined = c.join(o, c.c_custkey == o.o_custkey).join(li, li.l_orderkey == o.o_orderkey).join(s, s.s_suppkey == li.l_suppkey)
    return joined.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


@query(PAGERANK)
def pagerank(spark, d):
    return jobs.pagerank(_trade(spark, d), 5).select("id", F.round("rank", 6).alias("rank"))


# --- parsing


@query(f"select doc_id, count(*)::bigint as lines, sum(length(line))::bigint as chars from {LINES} group by doc_id")
def lines_from_text(spark, d):
    return _lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("select event_type as key, event_id::double as value from events")
def tsv_parse(spark, d):
    made = S.table(spark, d, "events").select(F.concat_ws("\t", "event_type", F.col("event_id").cast("string")).alias("line"))
    k, v = S.tab_pairs(F.col("line"))
    return made.select(k.alias("key"), v.alias("value"))


@query("select o_orderkey::varchar as id, o_orderstatus || chr(9) || o_orderpriority as rest from orders")
def id_rest_parse(spark, d):
    made = S.table(spark, d, "orders").select(F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("line"))
    i, r = S.id_and_rest(F.col("line"))
    return made.select(i.alias("id"), r.alias("rest"))


@query("select s_nationkey::varchar as src, s_suppkey::varchar as dst from supplier")
def adjacency_parse(spark, d):
    lists = S.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.concat_ws(" ", F.col("s_nationkey").cast("string"), F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string")), " ")).alias("line"))
    return jobs.edges_of(lists.select("line"))


@query("select is_fake, key_str, key_long, value_int, value_long from (select event_id % 7 = 0 as is_fake, case when event_id % 2 = 0 then event_type end as key_str, case when event_id % 2 = 1 then user_id end as key_long, case when event_id % 2 = 0 then event_id::int end as value_int, case when event_id % 2 = 1 then event_id end as value_long from events)")
def codec_round_trip(spark, d):
    """Tagged records of mixed types through their portable text form and back."""
    e = S.table(spark, d, "events")
    fake = F.col("event_id") % 7 == 0
    even = e.where("event_id % 2 = 0").select(*S.tagged(F.col("event_type"), F.col("event_id"), "str", "int", fake))
    odd = e.where("event_id % 2 = 1").select(*S.tagged(F.col("user_id"), F.col("event_id"), "long", "long", fake))
    back = S.from_json_batch(S.to_json_batch(even.unionByName(odd)), S.TAGGED)
    return back.select("is_fake", F.col("key.str").alias("key_str"), F.col("key.long").alias("key_long"), F.col("value.int").alias("value_int"), F.col("value.long").alias("value_long"))


@query("select event_id, number as batch, is_fake, event_type from (select event_id, event_type, event_id % 7 = 0 as is_fake, (event_id // 50)::bigint as number from events)")
def batch_codec(spark, d):
    """Records in batches with their number and each record's length, and back."""
    e = S.table(spark, d, "events").select("event_id", (F.col("event_id") % 7 == 0).alias("is_fake"), "event_type", F.floor(F.col("event_id") / 50).alias("batch"))
    sent = S.written(S.whole_batches(e, "batch"), "batches")
    return S.from_whole_batches(sent, "batch", "event_id bigint, is_fake boolean, event_type string")


# --- files


def _folder(spark):
    return f"{S.shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("select event_type as key, event_id::double as value from events")
def text_files(spark, d):
    """Lines written to a tree of text files and read from all of its folders."""
    out = _folder(spark)
    made = S.table(spark, d, "events").select("event_id", F.concat_ws("\t", "event_type", F.col("event_id").cast("string")).alias("line"))
    for half in (0, 1):
        S.write_text(made.where(F.col("event_id") % 2 == half), f"{out}/deep/{half}", "line")
    k, v = S.tab_pairs(F.col("line"))
    return S.text_lines(spark, out, recursive=True).select(k.alias("key"), v.alias("value"))


@query("select 'region=' || n_regionkey as folder, sum(length(n_name) + 1)::bigint as chars, count(*)::bigint as lines from nation group by 1")
def whole_file_sizes(spark, d):
    """Files read whole, with their paths."""
    out = _folder(spark)
    S.table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), "n_name").repartition(1).write.partitionBy("region").text(out)
    files = S.whole_files(spark, f"{out}/*/*.txt").select(F.regexp_extract("path", "region=[0-9]+", 0).alias("folder"), "content")
    return files.groupBy("folder").agg(F.sum(F.length("content")).alias("chars"), F.sum(F.regexp_count("content", F.lit("\n"))).cast("bigint").alias("lines"))


@query("select s_name || ',' || s_nationkey as key, s_suppkey::varchar as value from supplier")
def csv_keyed(spark, d):
    """Parquet parts as one CSV file, and key and value by the names of its columns."""
    out = _folder(spark)
    S.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.parquet(f"{out}/parts")
    S.parquet_to_csv(spark, f"{out}/parts/*.parquet", f"{out}/csv")
    return S.csv_pairs(spark, f"{out}/csv", ["s_name", "s_nationkey"], ["s_suppkey"])


def _named(spark, lines, job):
    """A named job from text files to text files."""
    out = _folder(spark)
    S.write_text(lines, f"{out}/in")
    jobs.run(spark, f"{out}/in", job, f"{out}/out")
    return spark.read.text(f"{out}/out")


@query(f"select word || chr(9) || count(*) as value from {WS} group by word")
def job_hist(spark, d):
    return _named(spark, _lines(spark, d).select("line"), "hist")


@query(f"select word || chr(9) || 'count=' || count(*) || chr(9) || 'median=1.0' as value from {WS} group by word")
def job_hist_median(spark, d):
    return _named(spark, _lines(spark, d).select("line"), "hist_median")


@query("select event_type || chr(9) || median(event_id::double)::varchar as value from events group by event_type")
def job_median(spark, d):
    made = S.table(spark, d, "events").select(F.concat_ws("\t", "event_type", F.col("event_id").cast("string")).alias("line"))
    return _named(spark, made, "median")


@query("select word || chr(9) || string_agg(id, ',' order by id) as value from (select distinct o_orderkey::varchar as id, unnest(string_split(o_orderpriority, ' ')) as word from orders) group by word")
def job_index(spark, d):
    made = S.table(spark, d, "orders").select(F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("line"))
    return _named(spark, made, "invertedindex")


# --- sorts

RANGE_SORT = f"select substr(line, 1, 10) as prefix, substr(line, 11) as rest, row_number() over (order by substr(line, 1, 10), substr(line, 11))::bigint as row_no from {LINES}"


@query(RANGE_SORT)
def range_sort(spark, d):
    return sorting.range_sort(_lines(spark, d))


@query("select o_custkey as key, o_orderkey, row_number() over (order by o_custkey, o_orderkey)::bigint as rank from orders")
def sort_ranked(spark, d):
    return sorting.ranked(S.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey"), ["key", "o_orderkey"])


@query(
    "with c as (select coalesce(max(k), 1)::bigint as c from (select unnest(range(1, 2000)) as k), (select count(*) as n from orders) where k * 2 * (k - 1) * (k - 1) <= n), "
    "n as (select greatest(ceil(count(*) / any_value(c)::double), 2 * (any_value(c) - 1) * (any_value(c) - 1), 1)::bigint as m, any_value(c) as c from orders, c), r as (select ceil(m / c::double)::bigint * c as r from n), "
    "s as (select o_custkey as key, row_number() over (order by o_custkey, o_orderkey)::bigint as rank from orders) select key, rank, ((rank - 1) // r)::int as reducer_id from s, r"
)
def column_sort(spark, d):
    return sorting.column_sort(S.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey"), "key", "o_orderkey")


@query("select 0::bigint as violations")
def order_check(spark, d):
    """Neighbours of the sorted part keys that are out of order: none."""
    rows = S.table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return sorting.order_violations(rows, "l_partkey", ["l_partkey", "l_orderkey", "l_linenumber"])


@query("select count(*)::bigint as violations from (select o_totalprice as v, lag(o_totalprice) over (order by o_orderkey) as b from orders) where v < b")
def order_check_planted(spark, d):
    """Prices in the order of their keys: out of order in many places."""
    return sorting.order_violations(S.table(spark, d, "orders").select("o_totalprice", "o_orderkey"), "o_totalprice", ["o_orderkey"])


# --- samples and random bins

SAMPLED = f"(select l_suppkey as key, l_orderkey % 4 as part from lineitem where {draw('sample', 'l_orderkey || chr(45) || l_linenumber')} < {int(0.3 * (1 << 32))})"


def _sampled(spark, d):
    rows = S.table(spark, d, "lineitem").withColumn("row", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return sampling.bernoulli(rows, F.col("row"), 0.3, SEED).select(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") % 4).alias("part"))


@query(f"select key, count(*)::bigint as w from {SAMPLED} group by key")
def bernoulli_histogram(spark, d):
    return H.counting(_sampled(spark, d), "key")


@query(f"select key, sum(w)::bigint as w, sum(overflow)::bigint as overflow from (select part, key, 1 as w, count(*) - 1 as overflow from {SAMPLED} group by part, key) group by key")
def capped_histogram(spark, d):
    return H.merged([H.capped(_sampled(spark, d), "part", "key").drop("part")], "key", ("w", "overflow"))


@query("select event_type as key, count(*)::bigint as w from events group by 1")
def merged_histogram(spark, d):
    e = S.table(spark, d, "events").withColumnRenamed("event_type", "key")
    return H.centralized(H.counting(e.where("event_id % 2 = 0"), "key"), [H.counting(e.where("event_id % 2 = 1"), "key")], "key")


@query("select event_type as key, sum(user_id)::bigint as w from events group by 1")
def full_histogram(spark, d):
    return H.full(S.table(spark, d, "events").withColumnRenamed("event_type", "key"), "key", "user_id")


@query("select event_type as key, count(*)::bigint as w from events group by 1")
def decentralized_histogram(spark, d):
    """Three parts' histograms merged by the strategy's name."""
    e = S.table(spark, d, "events").withColumnRenamed("event_type", "key")
    parts = [H.counting(e.where(F.col("event_id") % 3 == i), "key") for i in range(3)]
    return H.merge("decentralized", parts[0], parts[1:], "key")


@query("select event_type as key, 2 * count(*)::bigint as w from events group by 1")
def saved_histogram(spark, d):
    """A histogram saved, loaded, cleared, and both merged with the first."""
    path = _folder(spark)
    h = H.counting(S.table(spark, d, "events").withColumnRenamed("event_type", "key"), "key")
    H.save(h, path)
    return H.merge("centralized", h, [H.load(spark, path), H.cleared(h)], "key")


@query("select event_type as key, string_agg(distinct (user_id % 50)::varchar, ',' order by (user_id % 50)::varchar) as members from events group by 1")
def set_reduce(spark, d):
    """Sets of values merged over bins."""
    rows = S.table(spark, d, "events").select("event_id", F.col("event_type").alias("key"), (F.col("user_id") % 50).cast("string").alias("value"))
    sets = routing.two_level(sampling.prebin(rows, "event_id", BINS, SEED), "key", "value", "set")
    return sets.select("key", F.array_join(F.array_sort("value"), ",").alias("members"))


@query("select l_suppkey as key, string_agg(l_linenumber::varchar, ',' order by l_linenumber::varchar) as members from lineitem group by 1")
def list_reduce(spark, d):
    """Lists of values merged over bins."""
    rows = S.table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row"), F.col("l_suppkey").alias("key"), F.col("l_linenumber").cast("string").alias("value"))
    lists = routing.two_level(sampling.prebin(rows, "row", BINS, SEED), "key", "value", "list")
    return lists.select("key", F.array_join(F.array_sort("value"), ",").alias("members"))


@query(f"select id, 'key-' || ({draw('key', 'id')} % 17) as key, ({draw('value', 'id')} % 1000)::bigint as value from (select unnest(range(5000)) as id)")
def generated_rows(spark, d):
    return sampling.generated(spark, 5000, 17, SEED)


@query("select s_suppkey, 0::bigint as never, s_suppkey % 50 as always, true as possible from supplier")
def binomial_bounds(spark, d):
    """Draws of every mode with chance 0, 1 and one half, as many as the planner makes: one for each of few rows."""
    found = S.table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey") % 50).collect()
    samplers, rows = [sampling.Binomial(SEED, m) for m in ("exact", "normal", "fast", "library")], []
    for i, n in found:
        draws = [[s.draw(n, p) for s in samplers] for p in (0.0, 1.0, 0.5)]
        rows.append((i, max(draws[0]), min(draws[1]), all(0 <= x <= n for x in draws[2])))
    return spark.createDataFrame(rows, "s_suppkey long, never long, always long, possible boolean")


JAVA_HASH = "list_reduce(list_prepend(0::bigint, list_transform(string_split({0}, ''), lambda c: unicode(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296)"
SIGNED_HASH = "(case when {h} >= 2147483648 then {h} - 4294967296 else {h} end)"


def java_hash_sql(text: str) -> str:
    return SIGNED_HASH.format(h=JAVA_HASH.format(text))


@query(f"select {java_hash_sql('p_brand')}::varchar as key, count(*)::bigint as w from part group by 1")
def hashed_histogram(spark, d):
    return H.counting(S.table(spark, d, "part").select(H.key_of(F.col("p_brand"), "HashedCount").alias("key")), "key")


@query(f"select event_id, ({draw('bin', 'event_id')} % {BINS})::int as bin from events")
def prebin_uniform(spark, d):
    return sampling.prebin(S.table(spark, d, "events").select("event_id"), "event_id", BINS, SEED)


@query(f"select event_id, (case when {draw('coin', 'event_id')} % 2 = 0 then {draw('inner', 'event_id')} % 3 else 3 + {draw('inner', 'event_id')} % 4 end)::int as bin from events")
def prebin_hierarchical(spark, d):
    return sampling.prebin(S.table(spark, d, "events").select("event_id"), "event_id", 7, SEED, "Hierarchical")


SCALED = f"(select o_orderkey, o_custkey % 4 as part, row_number() over (partition by o_custkey % 4 order by {draw('scale', 'o_orderkey')}, o_orderkey) as i, count(*) over (partition by o_custkey % 4) as n from orders)"


@query(f"select o_orderkey from {SCALED} where i <= floor(0.25 * n)")
def scale_down(spark, d):
    return sampling.scaled(S.table(spark, d, "orders").select("o_orderkey", "o_custkey"), 0.25, F.col("o_custkey") % 4, F.col("o_orderkey"), SEED).select("o_orderkey")


@query(f"select o_orderkey from (select o_orderkey, unnest(range(2 + (i <= floor(0.5 * n))::int)) from {SCALED})")
def scale_up(spark, d):
    return sampling.scaled(S.table(spark, d, "orders").select("o_orderkey", "o_custkey"), 2.5, F.col("o_custkey") % 4, F.col("o_orderkey"), SEED).select("o_orderkey")


FLIP = draw("flip", "s_suppkey::varchar || chr(47) || i::varchar")


@query(f"select s_suppkey, count(*) filter (where {FLIP} < {int(0.4 * (1 << 32))})::bigint as successes from (select s_suppkey, unnest(range(1, s_suppkey % 50 + 2)) as i from supplier) group by s_suppkey")
def binomial_exact(spark, d):
    return sampling.binomial_by_hash(S.table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50 + 1).alias("n")), "s_suppkey", "n", 0.4, SEED)


# --- plans

HIST = "h as (select l_suppkey as key, count(*)::bigint as w from lineitem group by 1)"
EVENT_HIST = "h as (select event_type as key, count(*)::bigint as w from events group by 1)"


def _hist(spark, d):
    return H.counting(S.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "key"), "key")


def _event_hist(spark, d):
    return H.counting(S.table(spark, d, "events").withColumnRenamed("event_type", "key"), "key")


def fold(hist: str, start: str, state: str, bin_: str, select: str, order: str = "key", n: int = BINS) -> str:
    """SQL that walks the ordered histogram: `state` and `bin_` say how a step changes the state s, with t the total."""
    zero = ", ".join("0::bigint" for _ in range(n))
    return (
        f"with recursive {hist}, t as (select sum(w)::bigint as t from h), o as (select key, w, row_number() over (order by {order}) as i from h), "
        f"r as (select 0::bigint as i, {start.format(zero=zero)} as s, null::int as b union all select o.i, {state}, {bin_} from r join o on o.i = r.i + 1 cross join t) "
        f"select {select} from r join o on o.i = r.i cross join t"
    )


LIGHTEST = "(list_position(r.s, list_min(r.s)) - 1)"
GREEDY_STATE = f"list_transform(range({BINS}), lambda k: r.s[k + 1] + case when k = {LIGHTEST} then o.w else 0 end)"
GREEDY_SELECT = "o.key as key, o.w as w, r.b as bin"


@query(fold(HIST, "[{zero}]", GREEDY_STATE, f"{LIGHTEST}::int", GREEDY_SELECT))
def greedy_bins(spark, d):
    return packing.plan(_hist(spark, d), BINS, "greedy").select("key", "w", "bin")


@query(fold(HIST, "[{zero}]", GREEDY_STATE, f"{LIGHTEST}::int", GREEDY_SELECT, f"{java_hash_sql('key::varchar')}, key"))
def greedy_bins_hash_order(spark, d):
    return packing.plan(_hist(spark, d), BINS, "greedy", "hashcode").select("key", "w", "bin")


NEXT_CAP = f"ceil(2 * t / {BINS + 1}.0)"
NEXT_OVER = f"(r.s[2] + o.w > {NEXT_CAP})"


@query(fold(EVENT_HIST, "[0::bigint, 0::bigint]", f"case when {NEXT_OVER} then [r.s[1] + 1, o.w] else [r.s[1], r.s[2] + o.w] end", f"(r.s[1] + {NEXT_OVER}::int)::int", GREEDY_SELECT))
def nextfit_bins(spark, d):
    return packing.plan(_event_hist(spark, d), BINS, "next_fit").select("key", "w", "bin")


ROOM = f"greatest(0, (t - {BINS} * list_min(r.s)) // {BINS})"
FITS = f"({BINS} * (list_min(r.s) + o.w) <= t)"
FIRST = f"(case when {FITS} then o.w else least(o.w, {ROOM}) end)"


@query(
    fold(HIST, "[{zero}]", f"list_transform(range({BINS}), lambda k: r.s[k + 1] + case when k = {LIGHTEST} then {FIRST} else 0 end + case when k = least({LIGHTEST} + 1, {BINS - 1}) then o.w - {FIRST} else 0 end)", f"{LIGHTEST}::int", GREEDY_SELECT)
)
def split_lightest_bins(spark, d):
    return packing.plan(_hist(spark, d), BINS, "split_lightest").select("key", "w", "bin")


# a prefix sum is enough where no key is larger than a bin, as in this table
SPLIT_SQL = f"""with {HIST}, c as (select key, w, sum(w) over (order by key)::bigint - w as before, ceil(sum(w) over () / {BINS}.0)::bigint as cap from h)
select key, w, (before // cap)::int as bin, least(w, cap - before % cap)::bigint as first_w, case when w > cap - before % cap then (before // cap + 1)::int end as rest_bin from c"""


@query(SPLIT_SQL)
def split_bins(spark, d):
    return packing.plan(_hist(spark, d), BINS, "split_sequential")


@query(f"select bin, max(key) as hi_key from ({SPLIT_SQL}) group by bin")
def bin_cutoffs(spark, d):
    return packing.cutoffs(split_bins(spark, d))


@query(f"with p as ({SPLIT_SQL}), x as (select bin, first_w as x from p union all select rest_bin, w - first_w from p where rest_bin is not null) select b.bin::int as bin, coalesce(sum(x), 0)::bigint as load from (select unnest(range({BINS})) as bin) b left join x on x.bin = b.bin group by b.bin")
def planned_loads(spark, d):
    return packing.loads(split_bins(spark, d), BINS)


@query(f"select p_brand as key, ((({java_hash_sql('p_brand')}) % {BINS} + {BINS}) % {BINS})::int as bin from (select distinct p_brand from part)")
def fallback_bins(spark, d):
    """Keys that no plan knows."""
    empty = spark.createDataFrame([], "key string, w long, bin int, first_w long, rest_bin int")
    return routing.by_plan(S.table(spark, d, "part").select(F.col("p_brand").alias("key")).distinct(), empty, BINS)


GREEDY_SQL = ORACLES["greedy_bins"]
LOADS_SQL = f"select b.bin::int as bin, count(l.l_orderkey)::bigint as cnt from (select unnest(range({BINS})) as bin) b left join ({GREEDY_SQL}) p on p.bin = b.bin left join lineitem l on l.l_suppkey = p.key group by b.bin"


def _routed(spark, d):
    rows = S.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_quantity").cast("bigint").alias("value"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row"))
    return routing.by_plan(rows, packing.plan(_hist(spark, d), BINS, "greedy"), BINS)


@query(LOADS_SQL)
def bin_loads(spark, d):
    return routing.bin_counts(_routed(spark, d), BINS)


@query(f"with c as (select bin, max(key) as hi_key from ({SPLIT_SQL}) group by bin) select l_orderkey, l_linenumber, coalesce((select min(c.bin) from c where c.hi_key >= l_suppkey), {BINS})::int as bin from lineitem")
def range_route(spark, d):
    highs = bin_cutoffs(spark, d).orderBy("bin").collect()  # a row a bin
    bin_ = routing.by_cutoffs(F.col("l_suppkey"), [r["hi_key"] for r in highs], [r["bin"] for r in highs])
    return S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bin_.alias("bin"))


@query("select event_type as key, sum(event_id)::bigint as value from events group by 1")
def split_reduce(spark, d):
    """Heavy keys split over bins and joined again equal the plain aggregate."""
    rows = S.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("value"), F.col("event_id").alias("row"))
    routed = routing.by_plan(rows, packing.plan(H.counting(rows, "key"), BINS, "split_lightest"), BINS, row="row", seed=SEED)
    return routing.two_level(routed, "key", "value", "sum")


IDEAL = "floor(greatest(0.0::double, 1.1::double * (1.75::double * d - cnt::double / 1.0::double)))::bigint"
PAD_SQL = f"with l as ({LOADS_SQL}), m as (select avg(cnt)::double as d from l) select bin, cnt, {IDEAL} as fake_cnt from l, m"


@query(PAD_SQL)
def pad_plan(spark, d):
    return padding.planned(bin_loads(spark, d), BINS, 1.0, 0.1)


@query(f"select bin as src_bin, fake_cnt from ({PAD_SQL})")
def pad_plan_matrix_sums(spark, d):
    return padding.drawn_matrix(bin_loads(spark, d), BINS, 1.0, 0.1, SEED, "library").groupBy("src_bin").agg(F.sum("fake_cnt").alias("fake_cnt"))


@query("select l_suppkey as key, sum(l_quantity::bigint)::bigint as value from lineitem group by 1")
def padded_reduce(spark, d):
    """Fakes of every kind exchanged with the real rows; none reaches the sums."""
    real = _routed(spark, d).withColumn("is_fake", F.lit(False))
    plan = padding.drawn(routing.bin_counts(real, BINS), BINS, 1.0, 0.1, SEED, "library")
    fakes = padding.repeated(plan, sampling.first_rows(real.select("bin", "key", "value", "row"), "bin", ["key", "row"]))
    made = padding.synthetic(plan).select("bin", F.lit(-1).cast("bigint").alias("key"), "value", F.col("key").alias("row"), "is_fake")
    return routing.two_level(routing.place(real.unionByName(fakes).unionByName(made), BINS), "key", "value", "sum")


@query(f"with p as ({PAD_SQL}) select bin as part, (cnt + 2 * fake_cnt)::bigint as rows, (2 * fake_cnt)::bigint as fakes from p where cnt + fake_cnt > 0")
def padded_exchange(spark, d):
    """Rows and fakes of each partition behind the exchange: the planned fakes as copies of real rows, and as made-up ones."""
    real = _routed(spark, d).withColumn("is_fake", F.lit(False))
    plan = padding.planned(routing.bin_counts(real, BINS), BINS, 1.0, 0.1).select("bin", "fake_cnt")
    fakes = padding.repeated(plan, sampling.first_rows(real.select("bin", "key", "value", "row"), "bin", ["key", "row"])).drop("fake_cnt")
    made = padding.synthetic(plan).select("bin", F.lit(-1).cast("bigint").alias("key"), "value", F.col("key").alias("row"), "is_fake")
    sent = routing.place(real.unionByName(fakes.select(real.columns)).unionByName(made.select(real.columns)), BINS)
    return sent.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("rows"), F.count_if("is_fake").alias("fakes"))


@query("select event_type, ceil(1.5 * count(*))::bigint as padded, count(*)::bigint as real_rows from events group by 1")
def padded_sizes(spark, d):
    padded = padding.by_factor(S.table(spark, d, "events").select("event_type", "event_id"), "event_type", 1.5)
    return padded.groupBy("event_type").agg(F.count("*").alias("padded"), F.count_if(~F.col("is_fake")).alias("real_rows"))


@query("select ((count(*) // 1024 + 1) * 1024)::bigint as cnt, count(*)::bigint as real_rows from part")
def padded_rectangle(spark, d):
    part = S.table(spark, d, "part").select("p_partkey")
    padded = padding.rectangular(part, (part.count() // 1024 + 1) * 1024)
    return padded.agg(F.count("*").alias("cnt"), F.count_if(~F.col("is_fake")).alias("real_rows"))


# --- permutation, batches, comparison


@query(f"select event_id, row_number() over (order by {draw('tag', 'event_id')}, event_id)::bigint as position from events")
def permute(spark, d):
    tagged = S.table(spark, d, "events").select("event_id", sampling.salted(F.col("event_id"), SEED, "tag").alias("tag"))
    return sorting.ranked(tagged, ["tag", "event_id"], "position").select("event_id", "position")


@query(f"select event_id, {draw('tag', 'event_id')} as tag, row_number() over (order by {draw('tag', 'event_id')}, event_id)::bigint as position from events")
def permuted_order(spark, d):
    """The padded permutation shuffle: fakes are exchanged and written with the rows, and dropped before rows are numbered."""
    rows = S.table(spark, d, "events").select("event_id")
    return routing.permuted(rows, "event_id", ShuffleConfig(bins=BINS, global_seed=SEED), 2.0)


@query("select event_type as key, sum(user_id)::bigint as value from events group by 1")
def permuted_reduce(spark, d):
    """The padded permutation shuffle in front of a reduce."""
    rows = S.table(spark, d, "events").select("event_id", F.col("event_type").alias("key"), F.col("user_id").alias("value"))
    shuffled = routing.permuted(rows, "event_id", ShuffleConfig(bins=BINS, global_seed=SEED), 2.0).select("key", "value")
    return routing.two_level(routing.by_plan(shuffled, packing.plan(H.counting(rows, "key"), BINS, "greedy"), BINS), "key", "value", "sum")


@query(f"select bin, batch_no, count(*)::bigint as rows from (select bin, ((row_number() over (partition by bin order by event_id) - 1) // 100)::bigint as batch_no from (select event_id, ({draw('bin', 'event_id')} % {BINS})::int as bin from events)) group by 1, 2")
def batches(spark, d):
    return routing.batched(prebin_uniform(spark, d), ["bin"], ["event_id"], 100).groupBy("bin", "batch_no").agg(F.count("*").alias("rows"))


@query(f"select bin, is_fake, batch_no, count(*)::bigint as rows from (select bin, is_fake, ((row_number() over (partition by bin, is_fake order by event_id) - 1) // 100)::bigint as batch_no from (select event_id, event_id % 3 = 0 as is_fake, ({draw('bin', 'event_id')} % {BINS})::int as bin from events)) group by 1, 2, 3")
def batches_by_flag(spark, d):
    rows = prebin_uniform(spark, d).withColumn("is_fake", F.col("event_id") % 3 == 0)
    return routing.batched(rows, ["bin", "is_fake"], ["event_id"], 100).groupBy("bin", "is_fake", "batch_no").agg(F.count("*").alias("rows"))


@query("select (select count(*) from (select l_suppkey from lineitem group by 1 having l_suppkey % 5 = 0 or l_suppkey % 7 = 0))::bigint as mismatches, count(distinct l_suppkey)::bigint as keys from lineitem")
def compare_planted(spark, d):
    """Two results that differ in planted keys: a changed value, and a missing key."""
    a = S.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.count("*").alias("value"))
    b = a.where("key % 5 <> 0").withColumn("value", F.col("value") + (F.col("key") % 7 == 0).cast("int"))
    return routing.mismatches(a, b, "key", "value")


@query("select 0::bigint as mismatches, count(distinct l_suppkey)::bigint as keys from lineitem")
def compare_results(spark, d):
    plain = S.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("value"))
    return routing.mismatches(key_sum(spark, d), plain, "key", "value")


@query("select bin, min(event_id) as event_id from (select event_id, (" + draw("bin", "event_id") + f" % {BINS})::int as bin from events) group by bin")
def first_of_bin(spark, d):
    return sampling.first_rows(prebin_uniform(spark, d), "bin", ["event_id"])


# --- logs, written from table columns in the logs' formats


def _log(spark, d):
    e = S.table(spark, d, "events")
    stamp = F.date_format("ts", "yy/MM/dd HH:mm:ss")
    job = F.concat(stamp, F.format_string(" INFO DAGScheduler: Job %d finished: collect at Main.scala:%d, took %s s", "event_id", "user_id", F.format_string("%.3f", F.col("user_id") / 8)))
    executor = F.concat(stamp, F.format_string(" INFO CoarseGrained: Registered executor NettyRpcEndpointRef(spark-client://Executor) (10.0.0.1:1) with ID %d, ResourceProfileId 0", "event_id"))
    stage = F.concat(stamp, F.format_string(" INFO DAGScheduler: Submitting ResultStage %d (MapPartitions), which has no missing parents", "event_id"))
    task = F.concat(stamp, F.format_string(" INFO TaskSetManager: Starting task %d.0 in stage 3.0 (TID %d) (host-%d, executor %d, partition 0", F.col("event_id") % 9, "event_id", F.col("user_id") % 5, F.col("user_id") % 3))
    line = F.element_at(F.array(job, executor, stage, task), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.lit("run").alias("run"), line.alias("line"))


LOG = "(select *, date_trunc('second', ts) as sec, (select min(date_trunc('second', ts)) from events) as sec0 from events)"
SINCE = "(epoch(sec) - epoch(sec0))::double as elapsed_sec"


@query(f"select {SINCE}, event_id::int as job_id, 'collect' as description, 'Main.scala:' || user_id as location, round(user_id / 8.0, 3)::double as duration_sec from {LOG} where event_id % 4 = 0")
def log_jobs(spark, d):
    return logs.jobs(_log(spark, d)).select("elapsed_sec", "job_id", "description", "location", "duration_sec")


@query(f"select {SINCE}, event_id::varchar as executor_id from {LOG} where event_id % 4 = 1")
def log_executors(spark, d):
    return logs.executors(_log(spark, d)).select("elapsed_sec", "executor_id")


@query(f"select {SINCE}, event_id::int as stage_id, 'ResultStage' as type from {LOG} where event_id % 4 = 2")
def log_stages(spark, d):
    return logs.stages(_log(spark, d)).select("elapsed_sec", "stage_id", "type")


@query(f"select {SINCE}, event_id::varchar as task_id, '3.0' as stage_id, (event_id % 9) || '.0' as task_number, (user_id % 3)::varchar as executor_id, 'host-' || (user_id % 5) as host from {LOG} where event_id % 4 = 3")
def log_tasks(spark, d):
    return logs.tasks(_log(spark, d)).select("elapsed_sec", "task_id", "stage_id", "task_number", "executor_id", "host")


TIMES_SQL = "(select s_nationkey, s_suppkey, (s_suppkey % 9 + 1) * 60 + s_suppkey % 50 + 0.5 as real, (s_suppkey % 7) * 60 + s_suppkey % 31 + 0.25 as usr from supplier)"


@query(f"select s_suppkey, real::double as real, round(real::double / first_value(real::double) over w, 6) as real_overhead, round(real::double / lag(real::double) over w, 6) as real_delta, round(usr::double / first_value(usr::double) over w, 6) as user_overhead from {TIMES_SQL} window w as (partition by s_nationkey order by s_suppkey)")
def overhead_table(spark, d):
    key = F.col("s_suppkey")
    block = F.format_string("real\t%dm%d.5s\nuser\t%dm%d.25s\nsys\t0m1.0s", key % 9 + 1, key % 50, key % 7, key % 31)
    times = logs.timings(S.table(spark, d, "supplier").select("s_nationkey", "s_suppkey", block.alias("text")))
    o = logs.overheads(times, "s_nationkey", "s_suppkey")
    return o.select("s_suppkey", "real", F.round("real_overhead", 6).alias("real_overhead"), F.round("real_delta", 6).alias("real_delta"), F.round("user_overhead", 6).alias("user_overhead"))


@query("select right(l, 25) as label, v as value, k as kind, case when lower(l) like '%padded%' then 'padded' when lower(l) like '%split%' then 'split' when lower(l) like '%columns%' then 'oblivious' else 'plain' end as system from (select case p_partkey % 4 when 0 then 'Run of Padded bins no. ' when 1 then 'split keys ' when 2 then 'Columns sorted on rows ' else 'plain run ' end || p_partkey as l, p_size::double as v, case p_partkey % 3 when 0 then 'percent' when 1 then 'factor' else 'raw' end as k from part)")
def label_class(spark, d):
    names = F.array(*[F.lit(x) for x in ("Run of Padded bins no. ", "split keys ", "Columns sorted on rows ", "plain run ")])
    units = F.array(*[F.lit(x) for x in ("%", "x", "")])
    at = lambda a, n: F.element_at(a, (F.col("p_partkey") % n + 1).cast("int"))
    rows = S.table(spark, d, "part").select(F.concat(at(names, 4), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.col("p_size").cast("string"), at(units, 3)).alias("cell"))
    return logs.label_data(rows, "name", "cell", (("padded", "padded"), ("split", "split"), ("columns", "oblivious")), "plain")


@query("select event_type as metric, max(user_id)::bigint as max_value, round(avg(user_id), 6)::double as mean_value, round(stddev_pop(user_id), 4)::double as sd_value from events group by 1")
def metric_summary(spark, d):
    m = logs.metric_summary(S.table(spark, d, "events").withColumnRenamed("event_type", "metric"), "metric", "user_id")
    return m.select("metric", "max_value", F.round("mean_value", 6).alias("mean_value"), F.round("sd_value", 4).alias("sd_value"))


@query("select p_brand as gc_type, count(*)::bigint as runs, round(avg(greatest(p_size - 10.0, 0)), 6)::double as mean_extra, round(avg(p_size * 64.0 / (p_size % 4 + 1)), 6)::double as mean_heap_per_thread from part where p_partkey % 5 <> 0 group by 1")
def heap_pressure(spark, d):
    bad = (F.col("p_partkey") % 5 == 0).cast("int")
    runs = S.table(spark, d, "part").select(F.col("p_brand").alias("gc_type"), (F.col("p_size") % 4 + 1).alias("num_threads"), (F.col("p_size") * 64).alias("heap_size_mb"), F.col("p_size").cast("string").alias("elapsed"), bad.alias("native_exit"), F.lit(0).alias("shielded_exit"))
    out = logs.heap_pressure(runs, spark.createDataFrame([(10.0,)], "base_elapsed double"))
    return out.select("gc_type", "runs", F.round("mean_extra", 6).alias("mean_extra"), F.round("mean_heap_per_thread", 6).alias("mean_heap_per_thread"))
