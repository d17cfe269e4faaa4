"""Extra columns whose names the operators use themselves, null in some rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oddsmill.llm import bpe, exact_dedup, mixing, quality, secret_scan, sharding, simhash, token_output

NAMES = "sid start size uses kept keep_id fp root shard slot address chunk text_key n_words token_ids decoded base found block epoch u v component_id group_size id url html lines".split()


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.select("*", *[(F.when(F.col("doc_id") > 3, F.lit(i)) if i % 2 else F.lit(None).cast("string")).alias(n) for i, n in enumerate(NAMES)])


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_stages(spark, odd, clashing, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, clashing, "")
    assert out.columns == clashing.columns
    key = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
    assert key(out) == key(run(spark, odd, ""))


def test_operators(spark, odd, clashing, tmp_path):
    same = lambda f: sorted(map(str, f(clashing).collect())) == sorted(map(str, f(odd).collect()))
    path = bpe.vocabulary_path()
    assert same(lambda d: bpe.digests(bpe.round_trip(d, path)))
    assert same(lambda d: exact_dedup.exact_groups(d))
    assert same(lambda d: secret_scan.scan(d))
    assert same(lambda d: quality.measured(d).drop("rejected_by"))
    assert same(lambda d: simhash.grouped(d))
    assert same(lambda d: sharding.shard(d, shards=3))
    assert same(lambda d: mixing.taken(mixing.mix(d, block_words=4)))
    token_output.write_tokens(clashing, str(tmp_path / "t"), token_output.tokenizer_path())
    assert token_output.checksums(spark, str(tmp_path / "t")).count() == odd.count()
