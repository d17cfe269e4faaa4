import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from oddsmill.llm import shingle_dedup as D


def sets_of(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_groups(rows):
    """Sorted groups of ids whose five-word shingles link them at 0.8."""
    root, sets = {i: i for i, _ in rows}, {i: sets_of(t) for i, t in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, _ in rows:
        for k, _ in rows:
            if i < k and len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]):
                root[find(k)] = find(i)
    out = {}
    for i, _ in rows:
        out.setdefault(find(i), []).append(i)
    return sorted(map(sorted, out.values()))


def got(df, **more):
    out = {}
    for r in D.grouped(df, **more).collect():
        out.setdefault(r.root, []).append(r.doc_id)
    return sorted(map(sorted, out.values()))


def edited(rnd, words, changes):
    words = list(words)
    for i in rnd.sample(range(len(words)), changes):
        words[i] = f"new{rnd.getrandbits(40)}"
    return " ".join(words)


def near_copies(seed=5):
    """Texts of 100 and 300 words, each with copies of one to six words changed."""
    rnd, rows = random.Random(seed), []
    for n in [100, 300] * 20:
        words = [f"w{rnd.getrandbits(30)}" for _ in range(n)]
        for changes in (0, 1, 2, 6):
            rows.append((len(rows), edited(rnd, words, changes)))
    return rows


def test_near_stage_links_what_brute_force_links(spark):
    rows = near_copies()
    want = brute_groups(rows)
    assert len(want) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == want
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()) == sorted(g[0] for g in want)


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(documents) == brute_groups(rows)


def test_chains_and_bands_that_many_share(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, edited(rnd, words, 1 + i % 2)) for i in range(120)]
    for i in range(120, 150):  # a chain: each text drops three words more
        rows.append((i, " ".join(f"c{k}" for k in range(3 * (i - 120), 3 * (i - 120) + 90))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    assert got(docs) == want
    assert got(docs, hot=8) == want


def test_parities_differ_in_no_more_places_than_sets():
    rnd = random.Random(8)
    for n in (1, 5, 100, 1000, 5000):
        a = {rnd.getrandbits(64) for _ in range(n)}
        for changed in (0, 1, n // 9, n // 3, n):
            b = set(sorted(a)[changed:]) | {rnd.getrandbits(64) for _ in range(changed)}
            x, y = (np.array(D.parities(np.array(sorted(s), np.uint64))) for s in (a, b))
            places = sum(int(z).bit_count() for z in (x ^ y).view(np.uint64))
            assert places <= len(a ^ b) and (places - len(a ^ b)) % 2 == 0


def test_a_family_just_short_of_similar_makes_few_pairs(spark):
    """Texts about 0.7 alike share bands by the thousand, but hardly a pair that is no link leaves the join."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, edited(rnd, words, 5 + i % 3)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    signed = D.signatures(docs).cache()
    met = signed.select("node", "sketch", "odd", F.size("marks").alias("size"), F.posexplode("keys").alias("band", "key"), F.col("node").alias("root"))
    n = met.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
    pairs = {(r.u, r.v) for r in D.candidates(met.join(n, ["band", "key"])).collect()}
    assert pairs == {(r.u, r.v) for r in D.candidates(met.join(n, ["band", "key"]), hot=7).collect()}
    node = {r.doc_id: r.node for r in signed.collect()}
    sets = {node[i]: sets_of(t) for i, t in rows}
    similar = {(u, v) for u in sets for v in sets if u < v and len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v])}
    near = {(u, v) for u in sets for v in sets if u < v and len(sets[u] & sets[v]) >= 0.75 * len(sets[u] | sets[v])}
    assert similar <= pairs and len(pairs - near) <= len(pairs) * 0.02
    assert got(docs) == want and got(docs, hot=7) == want


def test_links_join_components_as_one_graph_would(spark):
    """Random links: components of some, then of the rest, against components of all at once."""
    rnd = random.Random(11)
    links = [tuple(rnd.sample(range(-40, 40), 2)) for _ in range(37)]
    frame = lambda x: spark.createDataFrame(x, "u long, v long")
    rows = D._merged(D.components(frame(links[:25])), frame(links[25:])).collect()
    root = {x: x for link in links for x in link}
    for _ in links:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    assert len(rows) == len(root) and {r.node: r.root for r in rows} == root


def test_keys_and_sketch_are_bits_of_a_simhash():
    """Bit by bit without numpy: over half of the shingles' hashes have it; texts at 0.8 differ in about 15 % of the bits."""
    rnd, mask = random.Random(12), (1 << 64) - 1
    for n in (1, 2, 7, 300):
        marks = sorted({rnd.getrandbits(64) for _ in range(n)})
        counts = [0] * (64 * D.WORDS)
        for h in marks:
            for w, t in enumerate(map(int, D._TIMES)):
                x = h * t & mask
                x = (x ^ x >> 31) * int(D._MIX) & mask
                x ^= x >> 32
                for at, byte in enumerate(x.to_bytes(8, "little")):
                    for bit in range(8):
                        counts[64 * w + 8 * at + bit] += byte >> (7 - bit) & 1
        bits = D.fingerprint(np.array(marks, np.uint64))
        assert bits.tolist() == [int(2 * c > n) for c in counts]
        made = D.keys(bits).tolist()
        assert len(made) == D.TABLES and [k >> D.BITS for k in made] == list(range(D.TABLES))
        assert [[k >> i & 1 for i in range(D.BITS)] for k in made] == bits[128 : 128 + D.TABLES * D.BITS].reshape(D.TABLES, D.BITS).tolist()
    both = [rnd.getrandbits(64) for _ in range(160)]
    a, b = (np.array(sorted(both + [rnd.getrandbits(64) for _ in range(20)]), np.uint64) for _ in range(2))
    assert 0.11 < (D.fingerprint(a) != D.fingerprint(b)).mean() < 0.19


def test_only_nodes_with_a_near_neighbour_stay_under_a_key(spark):
    """Each row at most once, however large the group: against all pairs under each key."""
    rnd = random.Random(13)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, edited(rnd, words, i % 7)) for i in range(60)] + [(60 + i, " ".join(f"x{rnd.getrandbits(30)}" for _ in range(150))) for i in range(60)]
    signed = D.signatures(spark.createDataFrame(rows, "doc_id long, text string")).dropDuplicates(["node"]).cache()
    nodes = signed.collect()
    apart = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a.sketch, b.sketch))
    alike = lambda a, b: min(a["size"], b["size"]) >= 0.8 * max(a["size"], b["size"]) - 1e-9
    want = {(k, a.node) for a in nodes for b in nodes if a.node != b.node and alike(a, b) and apart(a, b) <= D.FAR for k in set(a["keys"]) & set(b["keys"])}
    got = [(r.key, r.node) for r in D.neighbours(signed).collect()]
    assert want and sorted(got) == sorted(want)
