"""Every code point, against the libraries as they are."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from oddsmill.llm import bpe
from oddsmill.llm import token_output as O

#: Planes with characters; surrogates are no code points of a text.
POINTS = [c for c in [*range(0x40000), *range(0xE0000, 0xE1000)] if not 0xD800 <= c < 0xE000]
BLOCKS = [POINTS[at : at + 2048] for at in range(0, len(POINTS), 2048)]
TEXTS = ["\n".join(f"a1{chr(c)}a1{chr(c)} {chr(c)}" for c in block) for block in BLOCKS]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_code_point_is_encoded_and_decoded_as_by_tiktoken(reference):
    v = bpe.vocabulary(bpe.vocabulary_path())
    for text, ids in zip(TEXTS, v.encode(TEXTS), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text), text[:20]
        assert b"".join(v.decode(ids, v.offsets(ids))) == text.encode()


def test_every_code_point_is_encoded_as_by_the_tokenizers_library():
    library = Tokenizer.from_file(O.tokenizer_path())
    for text, ids in zip(TEXTS, O.Pieces(O.tokenizer_path()).encode(TEXTS), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:20]


def test_pieces_merged_together_are_those_merged_alone(reference):
    rnd = random.Random(8)
    pieces = [" ".join([""] * rnd.randint(0, 2) + ["".join(rnd.choice("abcdetnoiéß日1-") for _ in range(rnd.randint(1, 60)))]).encode() for _ in range(3000)]
    pieces += [b"a" * n for n in (1, 2, 3, 64, 200, 201, 500)]
    m = bpe.Merger(bpe.ranks(bpe.vocabulary_path()))
    ids, counts = m.merged(pieces)
    assert sum(counts) == len(ids)
    packed = m.learn(pieces)
    for p, own in zip(pieces, packed, strict=True):
        assert memoryview(own).cast("I").tolist() == bpe.merge(p, m.rank)
    assert m.learn([]) == []
