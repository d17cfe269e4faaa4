import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from oddsmill.llm import sharding as H

from .conftest import ODD


def check(rows, df, shards, most_apart):
    out = df.collect()
    assert len(out) == len(rows)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    counts = [len(slots.get(s, ())) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = defaultdict(Counter)
    for r in out:
        groups[r.g1, r.g2][r.shard] += 1
    linked = [c for c in groups.values() if sum(c.values()) > 1]
    apart = sum(sum(c.values()) - max(c.values()) for c in linked)
    assert apart <= most_apart, (apart, sum(sum(c.values()) for c in linked))


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    out = H.shard(documents, shards=7)
    check(rows, out, 7, 0)
    again = H.shard(documents.repartition(3), shards=7)
    assert sorted((r.doc_id, r.shard, r.slot) for r in out.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in again.collect())


def test_a_group_larger_than_a_shard_fills_whole_shards(spark):
    rows = [(i, "copy") for i in range(300)] + [(1000 + i, f"text {i // 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # 90 rows a shard: 210 of the large group must be apart from the first shard it fills
    check(rows, H.shard(df, shards=10), 10, 210 + 60)


def test_odd_rows(odd, empty):
    check([(r[0], r[1]) for r in ODD], H.shard(odd.withColumn("shard", F.lit(9)), shards=3), 3, 2)
    assert H.shard(empty).count() == 0


def test_all_linked(spark):
    rows = [(i, f"text {i % 5}") for i in range(103)]
    check(rows, H.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4), 4, 50)
