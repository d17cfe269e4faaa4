import re

from oddsmill.llm import quality as Q

from .conftest import ODD


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    chars, dup = sum(map(len, words)), len(lines) - len(set(lines))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    kept = not failed and 2 * len(words) <= chars <= 20 * len(words) and 10 * symbols <= len(words) and 2 * dup <= len(lines)
    return len(words), chars, symbols, dup, len(covered), failed, kept


def got(df):
    return sorted([(r[0], *r[1:8]) for r in Q.measured(df).drop("rejected_by").collect()], key=str)


def test_odd_rows(spark, odd, empty):
    small = [(r[0], r[1]) for r in ODD if len(r[1] or "") < 9000] + [(50, "a b c d e " * 4 + "\n" + "x y\nx y\n \n \n"), (51, "a b c d e f a b c d e"), (52, "## " * 30), (53, "same words again here now and more of it\n" * 2)]
    assert got(spark.createDataFrame(small, "doc_id long, text string")) == sorted([(i, *brute(t)) for i, t in small], key=str)
    assert Q.measured(empty).count() == 0 and Q.filtered(empty).count() == 0
    assert Q.filtered(odd).columns == odd.columns


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    out = got(documents)
    short = {i: brute(t) for i, t in rows if len(t) < 6000}
    assert [r for r in out if r[0] in short] == sorted([(i, *b) for i, b in short.items()], key=str)
    kept = sorted(r[0] for r in out if r[7])
    assert sorted(r.doc_id for r in Q.filtered(documents).collect()) == kept


def test_cascade_orders_by_rejections_per_cost_and_verdicts_stay(documents):
    import time

    slow = Q.Rule("slow", lambda t: time.sleep(0.001) or False)
    rules = (slow, *Q.RULES)
    found = Q.estimate(documents, rules, sample_rows=100)
    assert [e.worth for e in found] == sorted((e.worth for e in found), reverse=True)
    assert next(e for e in found if e.name == "slow").worth == 0
    assert {r.name for r in Q.cascade(documents, rules)} == {r.name for r in rules}
    ids = lambda rs: sorted(r.doc_id for r in Q.filtered(documents, rules=rs).collect())
    assert ids(Q.RULES) == ids(tuple(reversed(Q.RULES)))


def test_short_circuit():
    seen = []
    rules = (Q.Rule("a", lambda t: seen.append("a") or True), Q.Rule("b", lambda t: seen.append("b") or False))
    assert Q.first_rejection(Q.Text("x"), rules) == "a" and seen == ["a"]
