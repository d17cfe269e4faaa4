"""The cut against the least that exhaustive search finds, and rounds until nothing moves."""

import random
from functools import cache

import pytest

from oddsmill.llm import sharding as S


def least_apart(groups, quotas):
    """Fewest documents apart from the largest part of their group, over all ways to fill the quotas."""

    @cache
    def best(k, room):
        if k == len(groups):
            return 0
        m = groups[k]

        def spread(s, left, taken):
            if s == len(room):
                if not left:
                    yield tuple(taken)
                return
            for n in range(min(left, room[s]) + 1):
                yield from spread(s + 1, left - n, [*taken, n])

        return min(m - max(t) + best(k + 1, tuple(sorted(r - n for r, n in zip(room, t, strict=True)))) for t in spread(0, m, []))

    return best(0, tuple(sorted(quotas)))


@pytest.mark.parametrize("seed", [1, 2])
def test_cut_is_near_the_least(spark, seed):
    rnd = random.Random(seed)
    sizes = [rnd.randint(2, 4) for _ in range(5)]
    rows = [f"group {k}" for k, m in enumerate(sizes) for _ in range(m)]
    rows += [f"single {i}" for i in range(24 - len(rows))]
    rnd.shuffle(rows)
    out = S.shard(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), shards=3)
    got = S.cut_links(out).first()
    quotas = [8, 8, 8]
    least = least_apart([*sizes], quotas)
    assert got.linked == sum(sizes) and least <= got.apart <= least + max(sizes) // 2, (sizes, least, got)
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sorted(counts) == quotas


def test_groups_are_whole_while_there_is_room(spark):
    rows = [f"pair {i // 2}" for i in range(600)] + [f"single {i}" for i in range(600)]
    out = S.shard(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), shards=7)
    assert S.cut_links(out).first().apart == 0
    few = S.shard(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), shards=7, rounds=0)
    assert S.cut_links(few).first().apart < 7  # nothing voted: only gaps' ends cut
