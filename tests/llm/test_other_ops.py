"""URL filters, chat trees, WARC and the pipeline."""

import base64
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrarow.llm import chat_tree, url_filter, warc
from terrarow.llm.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, df.select(*columns).collect())) == sorted(map(key, cur.fetchall()))


# URL filters


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_cascade_is_exact_on_its_universe(spark):
    names = [f"h{i}.example" for i in range(3000)]
    listed = names[::7] + ["other.example"]
    cascade = url_filter.build_cascade(keys(spark, names), keys(spark, listed), bits_per_key=4)
    assert len(cascade.shards[0]) > 2
    got = keys(spark, names).where(cascade.listed(F.col("key"))).collect()
    assert {r.key for r in got} == set(names[::7])


def test_sharded_and_empty_cascades(spark):
    names = [f"h{i}.example" for i in range(500)]
    cascade = url_filter.build_cascade(keys(spark, names), keys(spark, names[::3]), max_bytes=64)
    assert len(cascade.shards) > 1
    for s in range(len(cascade.shards)):
        own = keys(spark, names).where(cascade.shard_of(F.col("key")) == s)
        assert {r.key for r in own.where(cascade.listed(F.col("key"), s)).collect()} == {r.key for r in own.collect()} & set(names[::3])
    assert keys(spark, names).where(url_filter.build_cascade(keys(spark, names), keys(spark, [])).listed(F.col("key"))).count() == 0


def test_levels_are_bounded_by_the_list(spark):
    """However many other keys there are, no level outgrows a filter over the list."""
    universe = spark.range(200_000).select(F.concat(F.lit("h"), "id", F.lit(".example")).alias("key"))
    listed = [f"h{i}.example" for i in range(0, 2000, 20)] + ["gone.example"]
    cascade = url_filter.build_cascade(universe, keys(spark, listed))
    first = len(cascade.shards[0][0].bits)
    assert len(cascade.shards) == 1 and all(len(x.bits) <= max(64, first) for x in cascade.shards[0])
    assert universe.where(cascade.listed(F.col("key"))).count() == 100


def test_hosts_of_many_dots_rows_and_tables(spark):
    urls = ["http://" + "a." * 3000 + "spam-farm.example.net/x", "http://" + "." * 500, "http://cheap-pills.example.net", "http://cheap-pills.example.net"]
    pages = spark.createDataFrame([(min(i, 2), u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = sorted((r.page_id, r.verdict) for r in url_filter.filter_urls(pages, keys(spark, url_filter.LISTED)).collect())
    assert got == [(0, "block"), (1, "allow"), (2, "block"), (2, "block")]
    assert url_filter.filter_urls(pages.limit(0), keys(spark, url_filter.LISTED)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, keys(spark, [])).collect()} == {"allow"}


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.ORG/x", "http://org/", "http://org", "http://b.example.org/es/1?q", "http://example.org/en/12", "http://x.com/fr/#t", "http://spam-farm.example.org/", "http://sub.spam-farm.example.net?x://y", "a://b://c/d", "http://notorg/"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id bigint, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, keys(spark, url_filter.LISTED)).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.org", "/x", "org/", "allow") and got[4] == ("org", "/", "org/", "allow") and got[5] == ("org", "", None, "allow")
    assert got[6][2:] == ("example.org/es/", "block") and got[7][2:] == ("example.org/en/1", "block") and got[8][1:] == ("/fr/", "com/fr/", "allow")
    assert got[9][2:] == ("org/", "allow") and got[10] == ("sub.spam-farm.example.net", "", None, "block") and got[11][:2] == ("b:", "//c/d") and got[12][2] is None


def test_url_filter_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id bigint, url string")
    plan = url_filter.filter_urls(pages, keys(spark, ["a.b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


# chat


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<\\</s>", "[\\INST]\\[INST]", "<s><|turn|>", "plain\\"])
def test_escapes_are_reversible(text):
    assert chat_tree.unescape(chat_tree.escape(text)) == text
    turns = [("user", text), ("assistant", text), ("<|turn|>", text), ("", "")]
    formatted, mask = chat_tree.format_turns(turns)
    assert chat_tree.parse_turns(formatted) == turns
    assert [chat_tree.unescape(formatted[a:b]) for a, b in mask] == [text]


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 5.0), ("t", 3, 1, "assistant", "b", 1.0), ("t", 4, 3, "user", None, 1.0), ("t", 9, 8, None, "orphan", None), (None, 1, None, "user", "lone", 0.0), ("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0), ("c", 3, 2, "user", "z", 0.0)]
    m = spark.createDataFrame(rows, "tree string, id bigint, parent bigint, role string, text string, score double")
    got = {(r.tree, r.leaf): [t for _, t in chat_tree.parse_turns(r.formatted)] for r in chat_tree.format_trees(m).collect()}
    assert got == {("t", 2): ["q", "a"], ("t", 4): ["q", "b", ""], ("t", 9): ["orphan"], (None, 1): ["lone"], ("c", 1): ["x"], ("c", 3): ["y", "z"]}
    best = {r.tree: (r.leaf, r.score) for r in chat_tree.format_trees(m, top=1).collect()}
    assert best["t"] == (2, 5.0)
    ranks = {(r.tree, r.leaf): r["rank"] for r in chat_tree.format_trees(m).collect()}
    assert ranks == {("t", 2): 1, ("t", 4): 2, ("t", 9): 3, (None, 1): 1, ("c", 1): 1, ("c", 3): 2}


def test_conversations_with_nulls_and_ties(spark):
    """A null conv_id is a conversation; turns equal in number and role come in the order of their texts, equal rows stay."""
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", None), (5, 1, "user", "z"), (5, 1, "user", "y"), (5, 1, "user", "y"), (5, None, None, "first")]
    m = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("tree", F.lit("x"))
    got = {r.tree: chat_tree.parse_turns(r.formatted) for r in chat_tree.format_trees(chat_tree.conversations_as_trees(m)).collect()}
    assert got == {None: [("user", "a"), ("assistant", "")], "5": [("", "first"), ("user", "y"), ("user", "y"), ("user", "z")]}


def test_deep_chain(spark):
    m = spark.range(1, 301).select(F.lit("d").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    r = chat_tree.format_trees(m).collect()
    assert len(r) == 1 and r[0].score == 300.0 and [int(t) for _, t in chat_tree.parse_turns(r[0].formatted)] == list(range(1, 301))


def test_no_messages(spark):
    m = spark.createDataFrame([], "tree string, id bigint, parent bigint, role string, text string, score double")
    assert chat_tree.format_trees(m).count() == 0


# WARC


def test_warc_round_trip(spark, tmp_path):
    warc.register(spark)
    html = [None, "", "a" * 100_000, "é\r\n\r\nWARC/1.1", "same", "same", "<p>100%25</p>", "same"]
    pages = spark.createDataFrame([(i, f"http://x/é%\n{i}" if i else None, h, "z") for i, h in enumerate(html)], "page_id bigint, url string, html string, payload string")
    path = f"file://{tmp_path}/w"
    warc.with_revisits(pages).write.format("warc").option("path", path).mode("append").save()
    back = {r.page_id: r for r in spark.read.format("warc").option("path", path).load().collect()}
    for i, h in enumerate(html):
        data = (h or "").encode()
        r = back[i]
        first = min(j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and r.payload_bytes == len(data)
        assert r.payload == (data if first == i else None) and r.url == (f"http://x/é%\n{i}" if i else "")
    some = spark.read.format("warc").option("path", path).load().where("record_type = 'revisit' AND refers_to = 4")
    assert sorted(r.page_id for r in some.collect()) == [5, 7]
    bare = spark.read.format("warc").option("path", path).option("payload", "false").load()
    assert all(r.payload is None for r in bare.collect())


def test_warc_filters_and_splits(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc.WarcReader(str(tmp_path), True)
    assert [type(f) for f in reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("page_id",), 3)])] == [GreaterThan]
    assert reader.filters == [("record_type", {"response"})]


def test_unwanted_payloads_are_neither_read_nor_inflated(tmp_path):
    import random

    r = random.Random(2)
    big = ["".join(r.choices("0123456789abcdef", k=3_000_000)) for _ in range(4)]
    rows = [{"page_id": i, "url": "u", "html": big[i // 2] if i % 2 else f"small {i}", "refers_to": None} for i in range(8)]
    path = f"file://{tmp_path}/w"
    writer = warc.WarcWriter(path)
    writer.commit([writer.write(rows)])
    read = {}
    for payload, filters in ((True, []), (False, []), (True, [("page_id", {0, 4})])):
        reader = warc.WarcReader(path, payload)
        reader.filters = filters
        stretches = []
        make = warc._Stretch
        try:
            warc._Stretch = lambda f, make=make, stretches=stretches: stretches.append(make(f)) or stretches[-1]
            got = [x for p in reader.partitions() for x in reader.read(p)]
        finally:
            warc._Stretch = make
        assert [x[0] for x in got] == ([0, 4] if filters else list(range(8)))
        assert all(x[6] == (rows[x[0]]["html"].encode() if payload else None) for x in got)
        read[payload, bool(filters)] = sum(x.read_bytes for x in stretches)
    assert read[True, False] > 5_000_000 and read[False, False] < 0.8 * read[True, False] and read[True, True] < 0.8 * read[True, False]
    # every split gives each record once
    old = warc.SPLIT_BYTES
    try:
        warc.SPLIT_BYTES = 1000
        reader = warc.WarcReader(path, False)
        parts = reader.partitions()
        assert len(parts) > 1000
        some = [x[0] for p in parts[:5] + parts[1500:1700] + parts[-3000:] for x in reader.read(p)]
        assert len(some) == len(set(some)) >= 3
    finally:
        warc.SPLIT_BYTES = old


def test_rows_of_one_page_id(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (1, "u", "abc"), (2, "u", "abc"), (2, "u", "other")], "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.html, r.refers_to or 0) for r in warc.with_revisits(pages).collect())
    assert got == [(1, "abc", 0), (1, "abc", 0), (2, "abc", 1), (2, "other", 0)]


def test_warc_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", ""), (4, "u", None), (None, "u", "abc")], "page_id bigint, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.with_revisits(pages, least_bytes=2).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None, None: None}


def test_warc_of_nothing(spark, tmp_path):
    warc.register(spark)
    path = f"file://{tmp_path}/none"
    warc.with_revisits(spark.createDataFrame([], "page_id bigint, url string, html string")).write.format("warc").option("path", path).mode("append").save()
    assert spark.read.format("warc").option("path", path).load().count() == 0


# pipeline


def test_pipeline_keeps_columns_and_packs_the_rest(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, DIR), name)
        assert out.columns == docs.columns
        ids.append({r.doc_id for r in out.collect()})
        assert ids[-1] <= {r.doc_id for r in docs.collect()}
        docs = out
    assert len(ids[1]) < len(ids[0]) and ids[3] == ids[2]
    assert not docs.where("text RLIKE 'token = .[0-9a-f]{40}'").count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()} == ids[3]


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, DIR), "none")
        assert docs.count() == 0
