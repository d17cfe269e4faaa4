import pytest
from tokenizers import Tokenizer

from oddsmill.llm import token_output as O

TEXTS = [
    "a <|endoftext|> b", "<|endoftext|><|endoftext|>", " x<|endoftext|>y", "a\n\n<|endoftext|>  b", "", None,
    "no such token <|endoftext>", "ends so<|endoftext|>", "x" * 5000 + " <|endoftext|> é " + "word " * 3000,
]


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[4:7]])
def test_added_tokens_are_those_of_the_library_as_loaded(texts):
    library = Tokenizer.from_file(O.tokenizer_path())
    got = [x.tolist() for x in O.Pieces(O.tokenizer_path()).encode(texts)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_files_hold_them(spark, tmp_path):
    df = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "c")], "doc_id long, text string")
    O.write_tokens(df, str(tmp_path / "t"), O.tokenizer_path())
    rows = O.read_tokens(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [64, 220, 50256, 275, 2] == list(rows[0].ids) and rows[1].start == 5
