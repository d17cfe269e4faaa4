"""The mixture recomputed without Spark: the draw, its correction, the permutations and the words taken."""

import math
import re
import struct
from collections import Counter, defaultdict

import xxhash

from oddsmill.llm import mixing as M

from .test_mixing import targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hashed(*values):
    """xxhash64 of longs, ints given as ("i", value), texts and nulls."""
    seed = 42
    for v in values:
        if v is None:
            continue
        raw = struct.pack("<i", v[1]) if isinstance(v, tuple) else v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return signed(seed)


def permuted(x, n, *key):
    a = math.ceil(math.sqrt(max(n, 1)))
    b = (max(n, 1) + a - 1) // a
    while True:
        left, right = x % a, x // a
        for k in range(4):
            if k % 2 == 0:
                left = (left + hashed(right, ("i", k), *key) % a) % a
            else:
                right = (right + hashed(left, ("i", k), *key) % b) % b
        x = right * a + left
        if x < n:
            return x


def in_line(keys, rows):
    """Keys in the order of the two-level running sums."""
    n = max(1, math.isqrt(max(0, rows)))
    return sorted(keys, key=lambda k: (hashed(*k) % n, k))


def brute(rows, weights=(5, 2, 1), most=3, block_words=16, shard_blocks=64, seed=42):
    size = {i: len(WORD.findall(t or "")) for i, _, t in rows}
    by_source = Counter()
    for i, s, _ in rows:
        by_source[s] += size[i]
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    want = targets(dict(by_source), weights, most)
    blocks = [-(-by_source[s] // block_words) for s in names]
    quota = [min(most * n, math.floor(want[s] * n / by_source[s] + 0.5)) if by_source[s] else 0 for s, n in zip(names, blocks, strict=True)]
    first = [sum(quota[:k]) for k in range(len(quota))]
    total = sum(quota)
    drawn = {}
    for slot in range(total):
        place = hashed(seed, slot // shard_blocks, slot) % total
        drawn[slot] = max(k for k in range(len(quota)) if quota[k] and first[k] <= place)
    held, freed = {}, []
    for k in range(len(quota)):
        own = defaultdict(list)
        for slot in sorted(s for s in drawn if drawn[s] == k):
            own[slot // shard_blocks].append(slot)
        line = [slot for (shard,) in in_line([(x,) for x in own], total // shard_blocks) for slot in own[shard]]
        for t, slot in enumerate(line):
            if t < quota[k]:
                held[slot] = (k, t)
            else:
                freed.append(slot)
    had = Counter(drawn.values())
    wanting = [(k, had[k] + j) for k in range(len(quota)) for j in range(quota[k] - had[k])]
    held |= dict(zip(freed, wanting, strict=True))
    uses = Counter((k, permuted(t % blocks[k], blocks[k], k, t // blocks[k], ("i", seed))) for k, t in held.values())
    taken = Counter()
    for k, s in enumerate(names):
        at = 0
        for i, key, n in in_line([(i, hashed(t or ""), size[i]) if t is not None else (i, 42, 0) for i, x, t in rows if x == s], len(rows)):
            for w in range(n):
                taken[i] += uses[k, (at + w) // block_words]
            at += n
    counts = Counter((slot // shard_blocks, k) for slot, k in drawn.items()), Counter((slot // shard_blocks, k) for slot, (k, _) in held.items())
    return {i: taken[i] for i, _, _ in rows}, counts


def test_draw_and_words_agree_with_brute_force(documents):
    rows = [(r.doc_id, r.source, r.text) for r in documents.collect()]
    m = M.mix(documents, block_words=16, shard_blocks=64)
    want, (drawn, held) = brute(rows)
    counts = m.shard_counts().collect()
    assert {(r.shard, r.sid): r.drawn for r in counts if r.drawn} == drawn
    assert {(r.shard, r.sid): r.blocks for r in counts if r.blocks} == held
    assert {r.doc_id: r.taken for r in M.taken(m).collect()} == want
    # the correction moves few slots: about the noise of the draw
    moved = sum(max(0, drawn[x] - held[x]) for x in drawn)
    assert moved < 3 * math.sqrt(sum(held.values()) * len({k for _, k in drawn}))
    assert all(n <= 64 for n in Counter(shard for shard, _ in held.elements()).values())


def test_words_are_counted_as_by_the_pattern(spark):
    texts = ["", " ", "\n\t ", "a", " a", "a ", "a  b\tc\n", "\x0b\x0cx\ry ", "é 日本 \x85 \xa0", None, " \n" * 50 + "z" + " \n" * 50, "x" * 3000 + " y" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", M.n_words(df["t"]).alias("n")).collect())
    assert got == {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
