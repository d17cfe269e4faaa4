import base64
import hashlib
import re
from collections import defaultdict

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from oddsmill.llm import bpe, mixing

from .test_quality import brute as quality_of
from .test_shingle_dedup import brute_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_run_agrees_with_brute_force(spark, tmp_path, documents):
    rows = documents.collect()
    spark.createDataFrame(rows, documents.schema).write.parquet(str(tmp_path / "documents.parquet"))
    kept = [r for r in rows if quality_of(r.text)[-1]]
    groups = defaultdict(list)
    for r in kept:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append(r)
    kept = [min(g, key=lambda r: (-len(r.text), r.doc_id)) for g in groups.values()]
    heads = {min(g) for g in brute_groups([(r.doc_id, r.text) for r in kept])}
    kept = [r for r in kept if r.doc_id in heads]
    docs = spark.createDataFrame(kept, documents.schema)
    # the mixture of these rows, copy by copy, from its segments
    used, texts = defaultdict(list), {r.doc_id: r.text for r in kept}
    for s in mixing.mix(docs).used_segments().collect():
        used[s.doc_id].append((s.word_from, s.word_to, s.uses))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary_path(), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, segments in used.items():
        words = WORD.findall(texts[i])
        for k in range(1, max(u for *_, u in segments) + 1):
            chosen = [w for a, b, u in sorted(segments) if u >= k for w in words[a:b]]
            text = texts[i] if len(chosen) == len(words) else " ".join(chosen)
            ids = enc.encode_ordinary(text)
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)


def test_stages_keep_the_columns_and_take_odd_rows(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
        out = stage(spark, odd, "")
        if name != "byte_bpe":
            assert out.columns == odd.columns
        out.collect()
