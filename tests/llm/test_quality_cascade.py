import time

import numpy as np

from oddsmill.llm import quality as Q


def sample(needed, own, rejected):
    full = np.zeros((len(rejected), len(Q.MEASURES)))
    for name, cost in needed.items():
        full[:, Q.MEASURES.index(name)] = cost
    return Q.Sample(full, np.full((len(rejected), len(own)), own, float), np.array(rejected, bool))


def test_order_counts_what_is_left_and_shared_costs_once():
    rules = (Q.Rule("a", None, ("words",)), Q.Rule("b", None, ("words", "n_distinct")), Q.Rule("c", None, ("entropy",)))
    # a rejects half; b all that a does and little else; c little, at a low cost
    rejected = [[i < 50, i < 55, 80 <= i < 90] for i in range(100)]
    found = Q.ordered_by(sample({"words": 10.0, "n_distinct": 10.0, "entropy": 6.0}, (0.1, 0.1, 0.1), rejected), rules)
    assert [e.name for e in found] == ["a", "c", "b"]
    assert [round(e.seen, 2) for e in found] == [1.0, 0.5, 0.4]
    assert abs(found[2].cost - 10.1) < 1e-9 and abs(found[2].rejected - 5 / 40) < 1e-9  # words are made by then
    # the same rules where words and variety are made anyway
    assert Q.ordered_by(sample({"words": 10.0, "n_distinct": 10.0, "entropy": 6.0}, (0.1, 0.1, 0.1), rejected), rules, ("words", "n_distinct"))[0].name == "b"


def test_a_costly_rule_sees_the_survivors_only(documents):
    def costly(t):
        time.sleep(0.0005)
        return t.n_words > 10_000

    rules = (Q.Rule("costly", costly, ("raw", "words")), *Q.RULES)
    ordered = Q.cascade(documents, rules)
    assert ordered[-1].name == "costly"
    found = {r.rule: r for r in Q.audit(documents, ordered).collect()}
    everything, rejected_before = documents.count(), sum(r.rejected for r in found.values() if r.rule != "costly")
    assert rejected_before > 0 and found["costly"].seen == everything - rejected_before
    unordered = {r.rule: r for r in Q.audit(documents, rules).collect()}
    assert unordered["costly"].seen == everything
    assert sum(r.seconds for r in found.values()) < sum(r.seconds for r in unordered.values())
    assert sum(r.rejected for r in found.values()) == sum(r.rejected for r in unordered.values())


def test_variety_and_entropy():
    assert Q.Text("").entropy == 0.0 and Q.Text("aaaa").entropy == 0.0
    assert abs(Q.Text("ab ab").entropy - 1.0) < 1e-12 and abs(Q.Text("\U0001f600é aé").entropy - 1.5) < 1e-12
    rule = {r.name: r.rejects for r in Q.RULES}
    assert rule["variety"](Q.Text("so it is " * 40)) and not rule["variety"](Q.Text(" ".join(map(str, range(40)))))
    assert rule["entropy"](Q.Text("aa ab ba bb " * 10)) and not rule["entropy"](Q.Text("the quick brown fox jumps over the lazy dog"))


def test_order_given_fixes_all_columns(documents):
    rows = lambda: sorted(Q.measured(documents, ordered=Q.RULES).collect(), key=str)
    assert rows() == rows()
