from collections import Counter, defaultdict

from oddsmill.llm import sharding as H


def test_a_hot_group_takes_few_shards_and_pairs_move_on(spark):
    rows = [(i, "copy") for i in range(1000)] + [(2000 + i, f"pair {i // 2}") for i in range(1000)] + [(5000 + i, f"text {i}") for i in range(1000)]
    out = H.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=20).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == len(rows) and set(counts.values()) == {150}
    groups = defaultdict(Counter)
    for r in out:
        groups[r.g1, r.g2][r.shard] += 1
    hot = next(c for c in groups.values() if sum(c.values()) == 1000)
    assert len(hot) == 7  # 1000 of 150 a shard
    assert not [c for c in groups.values() if sum(c.values()) == 2 and len(c) > 1]


def test_full_shards_cut_only_where_room_ends(spark):
    rows = [(i, f"text {i // 3}") for i in range(900)]  # all linked, 90 a shard
    out = H.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    shards_of = defaultdict(set)
    for r in out:
        shards_of[r.g1, r.g2].add(r.shard)
    assert set(Counter(r.shard for r in out).values()) == {90}
    assert sum(len(s) > 1 for s in shards_of.values()) < 10
