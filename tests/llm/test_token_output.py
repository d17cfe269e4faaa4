import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from oddsmill.llm import token_output as O

from .conftest import ODD


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(O.tokenizer_path())


def brute(library, rows):
    out, start = [], 0
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def stored(spark, df, path):
    O.write_tokens(df, path, O.tokenizer_path())
    return [tuple(r) for r in O.checksums(spark, path).orderBy("start").collect()]


def test_documents(spark, documents, library, tmp_path):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    assert stored(spark, documents.repartition(5), str(tmp_path / "t")) == brute(library, rows)
    starts = sorted((r.start, len(r.ids)) for r in O.read_tokens(spark, str(tmp_path / "t")).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    one = O.look_up(spark, str(tmp_path / "t"), [17]).collect()
    assert [r.doc_id for r in one] == [17] and one[0].ids == [*library.encode(rows[17][1], add_special_tokens=False).ids, 2]
    plan = O.look_up(spark, str(tmp_path / "t"), [17])._jdf.queryExecution().toString()
    assert "PushedFilters: [EqualTo(doc_id,17)" in plan or "EqualTo(doc_id,17)" in plan


def test_odd_rows(spark, odd, empty, library, tmp_path):
    got = stored(spark, odd, str(tmp_path / "o"))
    ids = sorted([r[0] for r in ODD], key=lambda i: (i is not None, i or 0))
    texts = {r[0]: r[1] for r in ODD}
    assert got == brute(library, [(i, texts[i]) for i in ids])
    assert stored(spark, empty, str(tmp_path / "e")) == []
