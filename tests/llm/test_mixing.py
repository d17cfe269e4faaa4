import re
from collections import defaultdict

from oddsmill.llm import mixing as M

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def check(rows, out, slack):
    size = defaultdict(int)
    for r in rows:
        size[r[1]] += len(WORD.findall(r[2] or ""))
    want, took = targets(dict(size)), defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        took[r.source] += r.taken
    for s in size:
        assert abs(took[s] - want[s]) <= slack


def test_documents_meet_their_targets_and_reruns_agree(documents):
    rows = [(r.doc_id, r.source, r.text) for r in documents.collect()]
    out = M.taken(M.mix(documents)).collect()
    check(rows, out, 128)
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in M.taken(M.mix(documents.repartition(3))).collect())


def test_odd_rows(odd, empty):
    check([(r[0], r[3], r[1]) for r in ODD], M.taken(M.mix(odd, block_words=2)).collect(), 3)
    assert M.taken(M.mix(empty)).count() == 0


def test_limit_is_met_exactly(spark):
    rows = [(i, "word " * 10, "a") for i in range(3)] + [(9, "w " * 970, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in M.taken(M.mix(df, block_words=4)).collect()}
    assert out[0].target == 90 and all(out[i].taken == 30 for i in range(3))
    assert abs(out[9].taken - 910) <= 4


def test_slots_are_a_permutation_and_no_block_is_overused(documents):
    m = M.mix(documents, block_words=16, shard_blocks=64)
    slots = m.slots.collect()
    assert sorted(r.slot for r in slots) == list(range(len(slots)))
    uses = defaultdict(int)
    for r in slots:
        uses[r.sid, r.block] += 1
        assert r.shard == r.slot // 64
    n = {r.sid: r.n_blocks for r in m.sources.collect()}
    assert max(uses.values()) <= 3 and all(0 <= b < n[s] for s, b in uses)
    # every epoch reads each block at most once
    assert len({(r.sid, r.epoch, r.block) for r in slots}) == len(slots)
    shards = defaultdict(set)
    for r in slots:
        shards[r.shard].add(r.sid)
    assert sum(len(x) for x in shards.values()) > len(shards) * 5  # sources are mixed, not laid end to end


def test_texts_hold_the_words_taken(documents):
    m = M.mix(documents)
    want = {r.doc_id: r.taken for r in M.taken(m).collect() if r.taken}
    out = M.mixed_texts(documents, m)
    assert out.columns == documents.columns
    got, original = defaultdict(int), {r.doc_id: WORD.findall(r.text) for r in documents.collect()}
    for r in out.collect():
        words = WORD.findall(r.text)
        assert set(words) <= set(original[r.doc_id]) and r.n_chars == len(r.text)
        got[r.doc_id] += len(words)
    assert got == want
