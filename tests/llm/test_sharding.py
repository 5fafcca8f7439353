import hashlib
from collections import defaultdict

from studylake.llm import sharding


def bits(s):
    return format(int(hashlib.md5(s.encode()).hexdigest()[:15], 16), "060b")


def brute(rows, limit):
    """Insert into buckets, splitting on the next bit while a bucket of several rows is over the limit."""
    todo, out = [("", rows)], {}
    while todo:
        name, rows = todo.pop()
        if sum(len((t or "").encode()) for _, t in rows) <= limit or len(rows) == 1:
            for d, _ in rows:
                out[d] = name
        else:
            for bit in "01":
                half = [r for r in rows if bits(str(r[0]))[len(name)] == bit]
                if half:
                    todo.append((name + bit, half))
    return out


def test_only_oversized_buckets_split(spark):
    rows = [(i, "é" * (i * 7 % 50)) for i in range(500)] + [(900, None), (901, ""), (902, "x" * 5000)]
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, depth int, shard string")
    for limit in (300, 2000, 10**9):
        got = sharding.extendible_shards(docs, limit_bytes=limit).collect()
        assert {r.id: r.shard for r in got} == brute(rows, limit)
        sizes = defaultdict(int)
        for r in got:
            sizes[r.shard] += r.n_bytes
        assert all(sizes[r.shard] == r.shard_bytes and (r.shard_bytes <= limit or r.oversized) for r in got)


def test_rows_of_one_key_are_split_on_their_content(spark):
    rows = [(7, f"text {i:04}") for i in range(64)] + [(None, "same row")] * 40 + [(8, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.extendible_shards(docs, limit_bytes=100).collect()
    assert len(got) == 105
    assert all(r.shard_bytes <= 100 for r in got)
    assert len({r.shard for r in got if r.id == 7}) >= 6


def test_equal_rows_fit_wherever_they_lie(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", 10)
    docs = spark.createDataFrame([(1, "8 bytes.")] * 64 + [(None, "x" * 5)] * 9 + [(2, "y" * 40)] * 3, "doc_id long, text string").repartition(16)
    got = sharding.extendible_shards(docs, limit_bytes=16).collect()
    assert len(got) == 76 and all(r.shard_bytes <= 16 or r.oversized and r.shard_rows == 1 for r in got)
    assert sum(r.shard_rows == 2 for r in got if r.id == 1) == 64


def test_directory_leads_each_key_to_its_shard(spark):
    docs = spark.createDataFrame([(i, "x" * 20) for i in range(200)], "doc_id long, text string")
    shards = sharding.extendible_shards(docs, limit_bytes=100).cache()
    table = sharding.directory(shards).collect()
    for r in shards.collect():
        h = int(bits(str(r.id)), 2)
        assert [d.shard for d in table if d.first <= h <= d.last] == [r.shard]


def test_empty_table(spark):
    assert sharding.extendible_shards(spark.createDataFrame([], "doc_id long, text string"), limit_bytes=10).count() == 0
