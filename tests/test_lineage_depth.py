import pytest

from oddsmill.operators import governance


def test_a_longer_chain_raises_and_a_cycle_does_not(spark):
    chain = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(6)], "child string, parent string")
    assert governance.lineage(chain, "a0", most=6).count() == 7
    with pytest.raises(RuntimeError):
        governance.lineage(chain, "a0", most=5)
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    assert governance.lineage(ring, "a", most=5).count() == 2
