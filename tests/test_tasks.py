import numpy as np
import pytest

from duolith.plans import tasks


@pytest.fixture(scope="module")
def settings(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tasks")
    rng = np.random.default_rng(9)
    a, n = rng.random(200) < 0.5, rng.random(200).round(3) * 10
    left = "\n".join(f"r{i},{str(bool(a[i])).lower()},{n[i]:.2f}" for i in rng.permutation(200))
    right = "\n".join(f"r{i},{'hi' if n[i] > 5 else 'lo'},{str(bool(a[i])).lower() if i % 19 else 'nan'}" for i in range(200))
    (folder / "l.csv").write_text("id,flag,weight\n" + left + "\n")
    (folder / "r.csv").write_text("id,level,mark\n" + right + "\n")
    return {"left": str(folder / "l.csv"), "right": str(folder / "r.csv"), "out": str(folder / "mined"), "min_itm_in": 0.1, "min_itm_out": 0.1, "max_inits": 3, "max_var_s0": 1, "max_var_s1": 1, "nb_buckets": 4, "parts_type": "rejective", "redescriptions": str(folder / "mined")}


def test_mine_and_go_on(spark, settings):
    found = tasks.run(spark, "mine", settings)
    sides = {(x["left"], x["right"]) for x in found}
    assert ("flag", "mark") in sides and any(r == "[level=hi]" for _, r in sides)
    rest = {k: v for k, v in settings.items() if k != "out"}
    assert {(x["left"], x["right"]) for x in tasks.run(spark, "filter", rest | {"min_fin_acc": 0.99})} == {("flag", "mark")} | {s for s in sides if next(x for x in found if (x["left"], x["right"]) == s)["acc"] >= 0.99}
    assert len(tasks.run(spark, "normalize", rest)) == len(found)
    assert all(y["acc"] >= 0.5 for y in tasks.run(spark, "improve", rest))
    assert min(x["pval"] for x in tasks.run(spark, "rnd", rest | {"copies": 2})) == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        tasks.run(spark, "no such", rest)
