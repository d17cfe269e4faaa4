import random
import re

import xxhash
from pyspark.sql import functions as F

from oddsmill.llm import simhash as S
from oddsmill.llm.components import components

from .conftest import ODD


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids_fps):
    fps = sorted({f for _, f in ids_fps})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    first = {}
    for i, f in ids_fps:
        r = find(f)
        first[r] = i if first.get(r) is None else (first[r] if i is None else min(first[r], i))
    return sorted([(i, f"{f:016x}", first[find(f)]) for i, f in ids_fps], key=str)


def got(df, **more):
    out = S.grouped(df, **more).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id").collect()
    return sorted([tuple(r) for r in out], key=str)


def test_documents_and_odd_rows(documents, odd, empty):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in documents.collect()]
    assert got(documents) == brute_groups(rows)
    assert got(odd) == brute_groups([(r[0], brute_fingerprint(r[1])) for r in ODD])
    assert S.grouped(empty).count() == 0


def test_long_texts_are_read_in_parts(monkeypatch):
    text = " ".join(random.Random(2).choices(["Aé", "bb", "c\t", "dd\n"], k=4000))
    monkeypatch.setattr(S, "PART_BYTES", 97)
    assert S.fingerprint(text) == brute_fingerprint(text)


def test_hot_choices_link_the_same_components(spark):
    rnd = random.Random(1)
    centre, fps = rnd.getrandbits(64), set()
    for _ in range(150):
        f = centre
        for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 4, 6])):
            f ^= 1 << b
        fps.add(f)
    fps |= {rnd.getrandbits(64) for _ in range(50)}
    nodes = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")

    def classes(hot):
        out = {}
        for r in components(S.links(nodes, hot)).collect():
            out.setdefault(r.root, set()).add(r.node)
        return sorted(map(sorted, out.values()))

    assert classes(1) == classes(10**6)
    want = brute_groups([(i, f) for i, f in enumerate(sorted(fps))])
    sizes = sorted(len(c) for c in classes(20))
    from collections import Counter

    assert sizes == sorted(n for n in Counter(r[2] for r in want).values() if n > 1)


def test_deduplicate_keeps_one_row_of_each_group(spark, documents, odd, empty):
    kept = [r.doc_id for r in S.deduplicate(documents).collect()]
    assert sorted(kept) == sorted({r[2] for r in got(documents)})
    out = S.deduplicate(odd.withColumn("fp", F.lit(1)).withColumn("root", F.lit(2)))
    assert out.columns == [*odd.columns, "fp", "root"]
    assert out.count() == len({str(r[2]) for r in got(odd)})
    assert S.deduplicate(empty).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)] + [(300, 301), (301, 300)]
    random.Random(3).shuffle(edges)
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}
