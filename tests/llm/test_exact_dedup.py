import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from oddsmill.llm import exact_dedup as X

from .conftest import ODD


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, len(t or "")))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] if m[0] is not None else 0))
        for m in members:
            out.append((m[0], keep[0], len(members), m == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r["_id"], r["keep_id"], r["group_size"], r["kept"], r["_sha"]) for r in df.collect()], key=str)


def test_odd_rows(odd):
    assert got(X.exact_groups(odd)) == brute([(r[0], r[1]) for r in ODD])


def test_documents(documents):
    assert got(X.exact_groups(documents)) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_colliding_addresses_change_nothing(documents):
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(5))
    assert got(X.exact_groups(documents, address=weak)) == got(X.exact_groups(documents))


def test_chunks_join_to_the_text(spark, documents):
    cut = documents.select(X.normalised(F.col("text")).alias("n")).select("n", X.chunks(F.col("n"), 16, 64).alias("c"))
    assert cut.where(F.array_join("c", "") != F.col("n")).count() == 0
    sizes = cut.select(F.explode("c").alias("c")).select(F.max(F.char_length("c"))).first()[0]
    assert 16 < sizes <= 64


def test_deduplicate_keeps_columns_and_one_row_of_a_group(spark, odd, empty):
    clash = odd.withColumn("kept", F.lit("mine")).withColumn("group_size", F.lit(0))
    out = X.deduplicate(clash)
    assert out.columns == clash.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "5", "6", "7", "None"]
    assert X.deduplicate(empty).count() == 0
    assert X.exact_groups(empty).count() == 0


def test_chunks_follow_the_text_in_every_script(spark):
    import random

    rnd = random.Random(9)
    alphabets = {"latin": (0x61, 0x7A), "cyrillic": (0x430, 0x44F), "arabic": (0x627, 0x64A), "thai": (0xE01, 0xE2E), "han": (0x4E00, 0x9FA5), "hangul": (0xAC00, 0xD7A3), "deseret": (0x10400, 0x1044F)}
    rows = []
    for name, (a, b) in alphabets.items():
        text = "".join(chr(rnd.randint(a, b)) for _ in range(30_000))
        rows += [(name, text), (name, text[:7000] + chr(a + 1) + text[7000:])]
    df = spark.createDataFrame(rows, "script string, t string").select("script", X.chunks(F.col("t")).alias("c"))
    for script in alphabets:
        one, two = (set(r.c) for r in df.where(F.col("script") == script).collect())
        assert len(one) > 15 and len(one & two) >= 0.8 * len(one), script


def test_ids_of_any_type(spark):
    rows = [("b", "x y"), ("a", "x  y"), ("c", "xy"), (None, "x  y"), ("d", "z")]
    out = got(X.exact_groups(spark.createDataFrame(rows, "doc_id string, text string")))
    assert [(i, k, n, kept) for i, k, n, kept, _ in out] == [("a", "a", 4, True), ("b", "a", 4, False), ("c", "a", 4, False), ("d", "d", 1, True), (None, "a", 4, False)]


def test_helper_names_may_be_taken(spark, odd):
    clash = odd.select("*", *[F.lit(n).alias(n) for n in ("_len", "_hash", "_kept", "_times", "_i", "_n", "_s", "in0", "_text_key", "_copy", "_plan")])
    out = X.deduplicate(clash)
    assert out.columns == clash.columns and {r["_kept"] for r in out.collect()} == {"_kept"}
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in X.deduplicate(odd).collect())
