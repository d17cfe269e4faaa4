import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from oddsmill.llm import bpe, pretokens

from .conftest import ODD


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows_of(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()], key=str)


def wanted(reference, rows):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [(i, reference.encode_ordinary(t or "")) for i, t in rows]
    return sorted([(i, len(x), sha(",".join(map(str, x)).encode()), sha((t or "").encode())) for (i, x), (_, t) in zip(ids, rows)], key=str)


def test_documents_and_odd_rows(documents, odd, empty, reference):
    path = bpe.vocabulary_path()
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert rows_of(bpe.digests(bpe.round_trip(documents, path))) == wanted(reference, rows)
    assert rows_of(bpe.digests(bpe.round_trip(odd, path))) == wanted(reference, [(r[0], r[1]) for r in ODD])
    assert bpe.round_trip(empty, path).count() == 0


def test_encode_then_decode(odd):
    path = bpe.vocabulary_path()
    out = bpe.decode(bpe.encode(odd, path), path).collect()
    assert sorted([(r.text or "").encode() for r in out]) == sorted((r[1] or "").encode() for r in ODD)
    for r in out:
        raw = (r.text or "").encode()
        ends = [*r.token_offsets[1:], len(raw)]
        v = bpe.vocabulary(path)
        for i, a, b in zip(r.token_ids, r.token_offsets, ends):
            assert v.bytes[v.starts[i] : v.starts[i] + v.lengths[i]].tobytes() == raw[a:b]
    again = bpe.encode(bpe.encode(odd, path), path)
    assert again.columns == [*odd.columns, "token_ids", "token_offsets"] and again.count() == len(ODD)


def test_pieces_agree_with_the_pattern(monkeypatch):
    pattern = regex.compile(P.PATTERN)
    monkeypatch.setattr(pretokens, "CHUNK_CHARS", 150)
    rnd = random.Random(3)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "　", "\xa0", "é", "1", "²", "!", "..", "x", "\U0001f600", "\x1c", "\x85", "A", "''", "日", "\x00"]
    texts = ["".join(rnd.choice(parts) for _ in range(n)) for n in [rnd.randint(0, 50) for _ in range(3000)] + [2500] * 20] + [None, ""]
    got = list(pretokens.pieces(texts))
    assert got == [[m.encode() for m in pattern.findall(t or "")] for t in texts]


def test_merging_agrees_with_the_library(reference):
    rnd = random.Random(4)
    ranks = bpe.ranks(bpe.vocabulary_path())
    pieces = ["a" * n for n in (1, 3, 199, 200, 201, 1000)] + ["".join(rnd.choice("abcdetnoi") for _ in range(n)) for n in (5, 50, 250, 3000)]
    for p in pieces:
        assert bpe.merge(p.encode(), ranks) == reference.encode_ordinary(p)
        assert bpe._merge_long(p.encode(), ranks) == reference.encode_ordinary(p)


def test_cache_stays_bounded(reference):
    m = bpe.Merger(bpe.ranks(bpe.vocabulary_path()))
    m.most = 10
    for i in range(100):
        text = f"{i} word{i} again " + "x" * i
        assert next(m.encode([text])).tolist() == reference.encode_ordinary(text)
        assert len(m.known) <= 20


def test_distinct_pieces_are_told_apart():
    rnd = random.Random(6)
    words = [bytes(rnd.choices(b"\0ab", k=rnd.randint(1, 20))) for _ in range(5000)]
    raw, ends = b"".join(words), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    place, number = pretokens.distinct(raw, starts, ends)
    assert all(raw[starts[place[k]] : ends[place[k]]] == w for k, w in zip(number, words))
    assert len(place) < len(words)


def test_long_texts_are_encoded_in_parts(monkeypatch, reference):
    monkeypatch.setattr(pretokens, "CHUNK_CHARS", 120)
    texts = ["short", " ".join(["some", "words", "'s", "ünd", "\n", "12"] * 300), None, "x" * 900, "end"]
    got = [x.tolist() for x in bpe.vocabulary(bpe.vocabulary_path()).encode(texts)]
    assert got == [reference.encode_ordinary(t or "") for t in texts]
