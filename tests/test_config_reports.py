import json

import pytest

from oddsmill import tools
from oddsmill.__main__ import main
from oddsmill.operators import scorecard
from oddsmill.plans.cache import Cache
from oddsmill.sources import config as C
from oddsmill.sources import reports as R

GOOD = {"project": "p", "sources": [{"name": "a", "path": "a.parquet"}], "spark": {"k": "v"}, "features": {"group": ["id"], "recipes": [{"name": "r", "operation": "ratio", "columns": ["x", "y"]}]}}


def test_configs_are_checked_written_and_read(tmp_path, capsys):
    for name in ("c.yaml", "c.json"):
        path = str(tmp_path / "sub" / name)
        C.dump(C.from_dict(GOOD), path)
        again = C.load(path)
        assert again == C.from_dict(GOOD) and again.plan().recipes[0].columns == ("x", "y")
        assert main(["validate", path]) == 0
    wrong = {"project": "", "sources": [{"name": "a"}, {"name": "a", "path": "x", "colour": 1}], "engine": "other", "checkpoint_enabled": True, "extra": 1, "features": {"recipes": [{"operation": "ratio"}]}}
    found = C.problems(wrong)
    for part in ("project is missing", "source a is named twice", "source 0: path is missing", "unknown setting: colour", "unknown engine", "needs checkpoint_dir", "unknown setting: extra", "features:"):
        assert any(part in x for x in found), part
    assert "at least one source is needed" in C.problems({"project": "p"}) and "engine spark needs" in " ".join(C.problems(GOOD | {"spark": {}}))
    (tmp_path / "bad.json").write_text(json.dumps(wrong))
    assert main(["validate", str(tmp_path / "bad.json")]) == 1
    with pytest.raises(ValueError):
        C.load(str(tmp_path / "c.ini")) if (tmp_path / "c.ini").write_text("x") else None


def test_templates_and_paths(tmp_path, monkeypatch):
    assert all(C.template(*t) for t in C.templates())
    assert main(["init", "basic/scorecard", str(tmp_path / "t.yaml")]) == 0 and C.load(str(tmp_path / "t.yaml")).project == "scorecard"
    with pytest.raises(ValueError):
        C.template("basic", "none")
    monkeypatch.setenv("BASE", "/data")
    assert C.resolve_path("$BASE/x") == "/data/x" and C.resolve_path("s3a://b/x") == "s3a://b/x" and C.resolve_path("x", "/root") == "/root/x"


def test_sources_are_read_as_declared(spark, sf_dir):
    assert C.Source("n", f"{sf_dir}/nation.parquet", columns=("n_name",)).read(spark).columns == ["n_name"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5, None), ('say "x", y', 0.25, 3)], "name string, v double, n int")
    text = R.markdown(df, "T")
    assert text.startswith("## T\n\n| name | v | n |\n| --- | --- | --- |\n| a\\|b | 1.5 |  |")
    assert "&lt;" in R.html_table(spark.createDataFrame([("<x>",)], "a string"), "t") and R.page("p", {"s": df}).count("<table>") == 1
    paths = R.bundle({"one": df, "two": df.limit(0)}, str(tmp_path / "b"))
    assert len(paths) == 5 and '"say ""x"", y",0.25,3' in (tmp_path / "b" / "one.csv").read_text()
    with pytest.raises(ValueError):
        R.markdown(spark.range(R.MOST + 1))
    assert R.rows_of(spark.range(R.MOST + 1), first=3)[1] == [["0"], ["1"], ["2"]]
    bins = spark.createDataFrame([(g, k) for g in ("x", None) for k in (5, 1, 3)], "g string, k int")
    assert sorted((str(r.g), r.k) for r in R.first_bins(bins, "g", "k", 2).collect()) == [("None", 1), ("None", 3), ("x", 1), ("x", 3)]


def test_cache_keeps_what_is_asked_for_twice(spark):
    cache, made = Cache(), []
    make = lambda: made.append(1) or spark.range(5)
    assert [cache.get("a", make).count() for _ in range(4)] == [5] * 4 and len(made) == 2
    assert cache.stats() == {"held": ["a"], "hits": 2, "misses": 2, "hit_rate": 0.5}
    assert cache.drop("a") and not cache.drop("a")
    cache.clear()


def test_tools(spark, tmp_path):
    rows = [(float(i % 50), float(i % 7), int((i % 50) * 2 + (i % 7) * 5 + i % 13 > 70)) for i in range(2000)]
    data = str(tmp_path / "d.parquet")
    df = spark.createDataFrame(rows, "a double, b double, y int")
    df.write.parquet(data)
    card = str(tmp_path / "card.json")
    (tmp_path / "card.json").write_text(scorecard.Scorecard.fit(df, ["a", "b"], "y").spec())
    out = tools.call(spark, "score_predict", {"data_path": data, "card_path": card, "output_path": str(tmp_path / "s.parquet")})
    assert out["rows"] == 2000 and out["min_score"] <= out["mean_score"] <= out["max_score"]
    assert tools.call(spark, "model_evaluate", {"data_path": data, "card_path": card, "target_col": "y"})["auc"] > 0.9
    assert tools.call(spark, "feature_select", {"data_path": data, "target_col": "y", "max_features": 1})["selected"] == ["a"]
    assert tools.call(spark, "binning_analyze", {"data_path": data, "target_col": "y", "feature": "a"})["iv"] > 0.5
    with pytest.raises(ValueError, match="missing: target_col"):
        tools.call(spark, "feature_select", {"data_path": data})
    assert set(tools.SCHEMAS) == set(tools.TOOLS)
