"""End-to-end run over generated survey files of two waves."""

import random
from dataclasses import replace

import pytest

from panelspark import spec
from panelspark.operators import assemble
from panelspark.plans import survey
from panelspark.plans.queries_models import quick_stacking
from panelspark.sources import results, sections


def _write(path, header, rows, bom=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "\n".join([",".join(header)] + [",".join("" if v is None else str(v) for v in r) for r in rows])
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode())


def _wave4(root, n=120, wave=4):
    rng = random.Random(wave)
    base = root / f"wave{wave}" / "household"
    regions = [1, 2, 5, 8, 14, 17, 51, 99]
    hh = [f"H{i}" for i in range(n)]
    poor = {h: rng.random() < 0.4 for h in hh}
    _write(base / "HH_SEC_A.csv", [f"y{wave}_hhid", "hh_a01_1", "clustertype", f"y{wave}_rural"],
           [(h, regions[i % 8], 1 if poor[h] else 2, None) for i, h in enumerate(hh)], bom=True)
    members = [(h, m, rng.randint(1, 2), rng.randint(20, 80), 1 if m == 1 else 2)
               for h in hh for m in range(1 if h != "H3" else 2, rng.randint(2, 6) + 1)]
    _write(base / "HH_SEC_B.csv", [f"y{wave}_hhid", f"indidy{wave}", "hh_b02", "hh_b04", "hh_b05"], members)
    _write(base / "HH_SEC_C.csv", [f"y{wave}_hhid", f"indidy{wave}", "hh_c01", "hh_c07", "hh_c09"],
           [(h, m, 1, 11 if poor[h] else 17, None if rng.random() < 0.3 else 19) for h, m, *_ in members])
    _write(base / "HH_SEC_I.csv", [f"y{wave}_hhid", "hh_i01", "hh_i09", "hh_i10", "hh_i11", "hh_i12", "hh_i15", "hh_i17",
                                   "hh_i18", "hh_i19"],
           [(h, 1, rng.randint(1, 4), 1 if poor[h] else 2, 3, 2 if poor[h] else 1, 1, 9 if poor[h] else 1,
             None if poor[h] else 1, 4 if poor[h] else 1) for h in hh])
    return len(members)


def _wave1(root, n=40):
    base = root / "wave1" / "household"
    hh = [f"F{i}" for i in range(n)]
    _write(base / "SEC_A_T.csv", ["hhid", "region", "locality"], [(h, 1 + i % 3, 1 + i % 3) for i, h in enumerate(hh)])
    _write(base / "SEC_B_C_D_E1_F_G1_U.csv", ["hhid", "sbmemno", "sbq2", "sbq4", "sbq5", "scq1", "scq6", "scq7"],
           [(h, m, 1, 30 + m, m, 1, 11, 12) for h in hh for m in (2, 1, 3)])
    _write(base / "SEC_H1_J_K2_O2_P1_Q1_S1.csv",
           ["hhid", "sjq1", "sjq3_1", "sjq6", "sjq15", "sjq16", "sjq18", "sjq19", "sjq8"],
           [(h, 1, 2, 1, 1, 1 + i % 5, 9, 1, 1 + i % 11) for i, h in enumerate(hh)])


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    path = tmp_path_factory.mktemp("survey")
    _wave4(path)
    _wave1(path)
    return path


def test_wave4_assembly(spark, root):
    df = assemble.load_wave(spark, str(root), 4)
    assert df.columns == ["hhid", "household_size", *[f.name for f in spec.FEATURES]]
    rows = {r["hhid"]: r for r in df.collect()}
    assert len(rows) == 120
    # No member 1: the head is the first remaining member.
    assert rows["H3"]["relationship_to_head"] == "2"
    assert {r["rural_urban"] for r in rows.values()} == {"1", "2"}


def test_wave1_layout_and_codes(spark, root):
    df = assemble.load_wave(spark, str(root), 1)
    assert "child_stool_disposal" not in df.columns
    rows = {r["hhid"]: r for r in df.collect()}
    assert all(r["household_size"] == 3 and r["head_age"] == "31" for r in rows.values())
    assert rows["F1"]["toilet_facility"] == "5" and rows["F0"]["toilet_facility"] == "1"
    assert rows["F4"]["water_source"] == "9" and rows["F2"]["rural_urban"] == "2"
    assert rows["F0"]["lighting_fuel"] == "10"


def test_all_waves_in_one_table(spark, root):
    both = assemble.load_waves(spark, str(root), (1, 4))
    counts = {r["wave"]: r["n"] for r in both.groupBy("wave").agg({"hhid": "count"}).toDF("wave", "n").collect()}
    assert counts == {1: 40, 4: 120}
    assert both.where("wave = 1 and child_stool_disposal is not null").count() == 0
    with pytest.raises(FileNotFoundError):
        sections.read_section(spark, str(root), 2, "A")
    with pytest.raises(KeyError):
        sections.wave_layout(9)


def test_explain_compare_verify(spark, root, tmp_path):
    settings = spec.Settings(
        cluster=spec.ClusterSettings(n_init=2), stacking=quick_stacking(("glm", "drf"), cv=2),
        attribution=spec.AttributionSettings(background_size=4, per_zone_sample=3, nsamples=120))
    out = str(tmp_path / "out")
    tables = survey.explain_wave(spark, str(root), 4, settings, out)
    assert tables["attribution"].count() > 0
    sizes = tables["zone_sample_sizes"].where("n_total > 0").collect()
    assert {r["n_explained"] for r in sizes} == {3}
    assert "Zanzibar" in {r["zone"] for r in sizes}
    for cap in (None, 3):
        report = survey.verify_results(spark, out, cap=cap).collect()
        assert {r["status"] for r in report} == {"PASS"}, report
        assert len(report) == 7
    failed = {r["check"] for r in survey.verify_results(spark, out, cap=4).where("status = 'FAIL'").collect()}
    assert failed == {"sample_cap"}
    zone_table = results.read_table(spark, f"{out}/explanation", "zone_x_feature")
    ranks = {r["zone"]: r["zone_rank"] for r in spec.zone_table(spark, settings.attribution.include_islands).collect()}
    assert {(r["zone"], r["zone_rank"]) for r in zone_table.collect()} <= set(ranks.items())
    comparison = survey.compare_waves(spark, out)
    full = comparison["feature_x_wave"]
    assert full.columns == ["feature", "w4", "best", "position"]
    bare = {r["feature"] for r in comparison["feature_x_wave_no_geo"].collect()}
    assert not bare & set(spec.GEO_FEATURES) and "household_size" in bare
    stored = results.read_table(spark, f"{out}/comparison", "feature_x_wave")
    assert stored.count() == full.count()


def test_evaluate_wave(spark, root, tmp_path):
    settings = spec.Settings(cluster=spec.ClusterSettings(n_init=2), stacking=quick_stacking(("glm",), cv=2),
                             experiment=replace(spec.ExperimentSettings(), seeds=(42, 43)))
    tables = survey.evaluate_wave(spark, str(root), 4, settings, str(tmp_path / "out"))
    values = {(r["seed"], r["metric"]): r["value"] for r in tables["summary"].collect()}
    assert all(values[(s, "accuracy")] > 0.8 and values[(s, "auc_macro")] > 0.9 for s in (42, 43))
    assert {"silhouette", "calinski_harabasz", "davies_bouldin", "train_test_gap"} <= {m for _, m in values}
    mean = {r["metric"]: r["mean"] for r in tables["aggregate"].collect()}
    assert mean["accuracy"] == pytest.approx((values[(42, "accuracy")] + values[(43, "accuracy")]) / 2)


def test_head_by_number(spark, tmp_path):
    _wave4(tmp_path, 4)
    base = tmp_path / "wave4" / "household"
    members = [("H0", 10, 1, 40, 2), ("H0", 2, 2, 41, 3), ("H1", 12, 1, 50, 4), ("H1", 3, 2, 51, 5), ("H2", 11, 1, 60, 6), ("H2", 1, 2, 61, 1)]
    _write(base / "HH_SEC_B.csv", ["y4_hhid", "indidy4", "hh_b02", "hh_b04", "hh_b05"], members)
    for heads_only, h2 in ((True, "61"), (False, "61")):
        rows = {r["hhid"]: r for r in assemble.load_wave(spark, str(tmp_path), 4, heads_only=heads_only).collect()}
        assert [rows[h]["head_age"] for h in ("H0", "H1", "H2")] == ["41", "51", h2]
        assert rows["H0"]["household_size"] == 2
