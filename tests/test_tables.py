import json
import os

import duckdb
import pytest

import __spark_entry__ as entry
from parcelforge.operators import encoding as E
from parcelforge.operators import forest, stats
from parcelforge.operators import timeseries as T
from parcelforge.plans import files, registry
from parcelforge.sources import fields as src

SF = "/root/testdata/sf0.001"
Y = [f"yield_{y}" for y in range(2021, 2028)]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, oracle, name):
    df = registry.queries()[name](spark, SF)
    rows = df.select(sorted(df.columns)).collect()
    rel = oracle.execute(registry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(r[i] for i in order) for r in rel.fetchall()]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def one(spark, values):
    df = spark.createDataFrame([("f", *[None if v is None else float(v) for v in [*values, *[None] * (7 - len(values))]])], "k string, " + ", ".join(f"{c} double" for c in Y))
    return T.features(src.nan_to_null(df), Y, ["k"]).first(), df


def test_slopes_of_nothing_are_rounded_as_in_sql(spark, oracle):
    """The exact slope is 0: what is left is the rounding of the recurrence, in the order of the years; equal values leave none."""
    rows = [[30.2, 20.5, 62 / 3, 21.0, 77 / 3, 21.0, 28.2], [23.0, 26.0, 16.5, 14.5, 31.0, 19.0, 137 / 6], [24.0, 20.0, 33.5, 68 / 3, 28.0, 24.75, 68 / 3], [21.2] * 7]
    years = range(1995, 2002)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, " + ", ".join(f"yield_{y} double" for y in years))
    got = [r["trend_slope"] for r in T.features(df, [f"yield_{y}" for y in years], ["k"]).orderBy("k").collect()]
    want = [oracle.execute(f"SELECT regr_slope(v, y) FROM (VALUES {', '.join(f'({v!r}::DOUBLE, {y})' for v, y in zip(r, years))}) t(v, y)").fetchone()[0] for r in rows]
    assert [(x > 0) - (x < 0) for x in got] == [(x > 0) - (x < 0) for x in want] == [-1, 1, 1, 0]


def test_series(spark):
    r, _ = one(spark, [5])
    assert r["insufficient_data"] and r["mean_yield"] is None and r["trend_significant"] is None
    r, _ = one(spark, [1, 3])
    assert (r["trend_slope"], r["recent_vs_historical"], r["trend_p_value"], r["mean_yoy_change"]) == (2, 0, 0, 2)
    r, _ = one(spark, [2, 2, 2])
    assert (r["std_yield"], r["cv_yield"], r["trend_slope"], r["trend_r2"], r["trend_p_value"], r["max_abs_z"], r["best_year"], r["worst_year"]) == (0, 0, 0, 0, 1, 0, 2021, 2021)
    r, df = one(spark, [1, None, 4])
    change = T.yearly_change(df, Y, ["k"]).first()
    assert (r["mean_yoy_change"], r["max_yoy_increase"], r["last_year_trend"]) == (3, 3, 3) and change["yoy_change_2022"] is None and change["yoy_change_2023"] is None
    r, _ = one(spark, [1, 1, 1, 1, 1, 1, 10])
    assert r["max_abs_z"] == pytest.approx(2.2678, abs=1e-4) and (r["n_anomaly_years"], r["anomaly_years"]) == (1, [2027])
    r, _ = one(spark, [17.8, 18.2, 19.1, 20.3, 19.7])
    assert r["trend_slope"] == pytest.approx(0.59) and 0 < r["trend_p_value"] < 0.05 and r["trend_significant"] == 1
    r, _ = one(spark, [float("nan"), 1, 2])
    assert r["mean_yield"] == 1.5 and not r["insufficient_data"]


def test_p_value_at_critical_points(spark):
    from pyspark.sql import functions as F

    for df, t in {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 10: 2.228}.items():
        p = spark.range(1).select(T.two_sided_p(F.lit(t * t / (t * t + df)), F.lit(df))).first()[0]
        assert p == pytest.approx(0.05, abs=1e-4)


def test_bins_maps_and_codes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.0,), (20.0,), (20.01,), (40.0,), (60.0,), (60.01,), (None,)], "a double")
    assert [r[0] for r in df.select(E.size_code(F.col("a"))).collect()] == [-1, 0, 1, 1, 2, 3, -1]
    assert [r[0] for r in df.select(E.size_class(F.col("a"))).collect()] == [None, "small", "medium", "medium", "large", "xlarge", None]
    some = spark.createDataFrame([("drip",), ("other",), (None,)], "s string")
    assert [r[0] for r in some.select(E.lookup(F.col("s"), E.IRRIGATION)).collect()] == [1.0, 0.5, 0.5]
    crops = spark.createDataFrame([("Corn",), ("apple",), (None,), ("corn",)], "c string")
    assert {r["label"]: r["code"] for r in E.label_codes(crops, "c").collect()} == {"apple": 0, "corn": 1, "unknown": 2}
    with pytest.raises(Exception, match="null label"):
        E.label_codes(crops, "c", None).collect()
    assert E.one_hot(crops, "c", "crop", ["corn"]).agg({"crop__corn": "sum"}).first()[0] == 1


def test_scaling_of_constants_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0, None, None), (2, 5.0, 1.0, None), (3, 5.0, 4.0, None), (4, 5.0, 2.0, None)], "k long, a double, b double, c double")
    assert [tuple(r)[1:] for r in E.min_max(df, ["a", "b", "c"]).orderBy("k").collect()] == [(0, 0, 0), (0, 0.25, 0), (0, 1, 0), (0, 0.5, 0)]
    assert [r["b"] for r in E.impute_median(df, ["b", "c"]).orderBy("k").collect()] == [2, 1, 4, 2]
    z = E.standardise(df, ["a", "b"]).orderBy("k").collect()
    assert [r["a"] for r in z] == [0] * 4 and z[0]["b"] is None and z[2]["b"] == pytest.approx(1.336306, abs=1e-6)
    one, two = E.impute_and_standardise(df, ["a", "b", "c"]), E.standardise(E.impute_median(df, ["a", "b", "c"]), ["a", "b", "c"])
    for got, want in zip(one.orderBy("k").collect(), two.orderBy("k").collect()):
        assert tuple(got) == pytest.approx(tuple(want)) and None not in tuple(got)
    assert E.impute_and_standardise(df.limit(0), ["a", "b"]).collect() == []


def test_geojson_and_csv(spark, tmp_path):
    ring = [[-115.52, 33.05], [-115.51, 33.05], [-115.51, 33.06], [-115.52, 33.05]]
    feature = lambda i, kind, c: {"type": "Feature", "properties": {"field_id": i, "field_name": i, "crop_type": "corn", "area_ha": 2.5, "yield_2021": 1.0, "slope_pct": None}, "geometry": {"type": kind, "coordinates": c}}
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature("F1", "Polygon", [ring]), feature("F2", "MultiPolygon", [[ring], [ring]])]}, indent=1))
    df = src.read_geojson(spark, str(path))
    rows = {r["field_id"]: r for r in df.collect()}
    assert len(rows["F1"]["polygons"]) == 1 and len(rows["F2"]["polygons"]) == 2 and rows["F1"]["polygons"][0][0][1].x == -115.51
    assert df.schema["polygons"].metadata == {"srid": 4326} and src.yield_columns(df) == [f"yield_{y}" for y in range(2021, 2026)]
    assert "polygons" not in src.attributes(df).columns and src.schema_report(df).first()["rows"] == 2
    src.write_csv(spark.createDataFrame([("a", [2023], None)], "k string, years array<int>, v double"), str(tmp_path / "out"), single_file=True)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.split() == ["k,years,v", "a,[2023],"]


#: Fields of known features, as boxes in longitude and latitude.
BOXES = {"F001": (-115.52, 33.05, -115.516, 33.054), "F003": (-115.518, 33.04, -115.514, 33.045), "F008": (-115.522, 33.035, -115.516, 33.04), "F014": (-115.545, 33.044, -115.5395, 33.051)}


@pytest.mark.parametrize("lines", [False, True])
def test_from_geojson_to_csv(spark, tmp_path, lines):
    crops = {"F001": "alfalfa", "F003": "wheat", "F008": "cotton", "F014": "corn"}
    yields = {"F001": [18.8, 19.0, 17.8, 20.3, 19.2]}
    made = []
    for i, (a, b, c, d) in BOXES.items():
        y = yields.get(i, [1.0, 2.0, 3.0, None, 5.0])
        made.append({"type": "Feature", "properties": {"field_id": i, "crop_type": crops[i], "soil_type": "clay", "irrigation_type": "drip", "area_ha": 10.0 * len(made) + 5, "slope_pct": 1.0, **{f"yield_{2021 + k}": v for k, v in enumerate(y)}}, "geometry": {"type": "Polygon", "coordinates": [[[a, b], [c, b], [c, d], [a, d], [a, b]]]}})
    path = tmp_path / "f.geojson"
    path.write_text("\n".join(map(json.dumps, made)) if lines else json.dumps({"type": "FeatureCollection", "features": made}, indent=1))
    files.export(spark, str(path), str(tmp_path / "out"), lines=lines)
    read = {n: {r["field_id"]: r for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out" / n)).collect()} for n in ("geometry_features", "attribute_features", "spatial_context_features", "topology_features", "time_series_features", "full_feature_matrix")}
    near = lambda x, tolerance=1e-4: pytest.approx(x, rel=tolerance)
    g = read["geometry_features"]
    assert tuple(g["F001"])[1:] == (16.568, 1.6342, 0.779631, near(1.1818), 16.568, 1.0, 1.0, 4, 17.0424, 0.972164, 379.75, 448.77, -115.518, 33.052)
    assert (g["F014"]["area_ha"], g["F014"]["compactness"], g["F014"]["bbox_width_m"], g["F008"]["area_ha"], g["F003"]["area_ha"]) == (39.8681, 0.75285, 524.35, 31.07, 20.7122)
    t = read["topology_features"]
    assert (t["F003"]["n_adjacent_fields"], t["F008"]["total_shared_length_m"], t["F001"]["is_isolated"], t["F003"]["different_crop_count"]) == (1, near(186.79), 1, 1)
    c = read["spatial_context_features"]
    assert (c["F008"]["edge_density"], c["F014"]["edge_density"], c["F001"]["dominant_neighbor_crop"], c["F003"]["fragmentation_index"]) == (4.000057, 4.085552, "isolated", 1.0)
    y = read["time_series_features"]
    assert (y["F001"]["mean_yield"], y["F001"]["best_year"], y["F001"]["anomaly_years"], y["F003"]["mean_yoy_change"]) == (19.02, 2024, "[]", near(4 / 3))
    whole = read["full_feature_matrix"]["F001"].asDict()
    assert len(whole) == 25 and (whole["geom_area_ha"], whole["attr_area_ha"], whole["ts_mean"], whole["attr_irrigation"]) == (near(16.568), 5.0, near(19.02), 1.0)
    a = read["attribute_features"]
    assert list(a["F001"].asDict())[:8] == ["field_id", "area_ha", "slope_pct", "mean_yield", "yield_efficiency", "slope_area_ratio", "irrigation_efficiency_score", "area_size_code"] and "yoy_change_2025" in a["F001"].asDict()
    assert (a["F001"]["area_ha"], a["F014"]["area_ha"], a["F001"]["crop__alfalfa"], a["F001"]["crop__corn"], a["F001"]["soil__clay"]) == (0.0, 1.0, 1, 0, 1)


def test_forest(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", float(i % 3 == 0) + i / 1000, float(i)) for i in range(90)], "k long, crop string, x double, y double")
    model, prepared, names = forest.fit(rows, ["x", "y"], "crop", trees=10)
    again = forest.fit(rows, ["x", "y"], "crop", trees=10)[0]
    assert model.featureImportances == again.featureImportances and sum(model.featureImportances.toArray()) == pytest.approx(1)
    done = forest.predict(model, prepared, names, ["k", "crop"])
    assert stats.accuracy(done, "crop", "predicted").first()["accuracy"] > 0.95 and model.getNumTrees == 10
    assert stats.fold_count(rows, "crop") == 5
    folds = stats.stratified_folds(rows, "crop", "k").groupBy("crop", "fold").count().collect()
    assert {r["count"] for r in folds} == {6, 12}


def test_cross_validation(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", float(i % 3 == 0) + i / 1000, float(i)) for i in range(90)], "k long, crop string, x double, y double")
    found = forest.cross_validate(rows, ["x", "y"], "crop", "k", most=3, trees=10).collect()
    assert [r["fold"] for r in found] == [0, 1, 2] and {r["support"] for r in found} == {30} and not any(r["skipped"] for r in found)
    each = [r["accuracy"] for r in found]
    assert min(each) > 0.9 and found[0]["mean"] == pytest.approx(sum(each) / 3) and found[0]["deviation"] == pytest.approx((sum((x - sum(each) / 3) ** 2 for x in each) / 3) ** 0.5)
    few = rows.where("crop = 'a' OR k = 0")
    assert [tuple(r) for r in forest.cross_validate(few, ["x", "y"], "crop", "k").collect()] == [(None, 0, 0.0, 0.0, 0.0, True)]


def test_folds_are_even_in_every_class(spark):
    rows = spark.createDataFrame([(i, "abc"[(i % 10) // 4]) for i in range(2003)] + [(5000 + i, None) for i in range(7)], "k long, c string")
    folds = stats.stratified_folds(rows, "c", "k").collect()
    assert len(folds) == 2010
    for c in ("a", "b", "c", None):
        n = [sum(r["c"] == c and r["fold"] == f for r in folds) for f in range(5)]
        assert max(n) - min(n) <= 1


def test_percentiles_of_large_tables_are_exact(spark, monkeypatch):
    """Bracketed again and again, until few values are left, as by the exact aggregate: of ties, nulls, heavy tails and empty columns."""
    import random

    import numpy as np

    rng = random.Random(8)
    values = [(rng.paretovariate(0.3), float(rng.randint(0, 3)), None if rng.random() < 0.5 else rng.gauss(0, 1), None, i) for i in range(5000)]
    df = spark.createDataFrame(values, "a double, b double, c double, d double, e long")
    shares = [0.0, 0.25, 0.5, 0.777, 1.0]
    monkeypatch.setattr(stats, "VALUES", 20)
    monkeypatch.setattr(stats, "ACCURACY", 40)
    monkeypatch.setattr(stats, "IN_ONE_BUFFER", -1)
    got = df.agg(*(x.alias(c) for c, x in stats.percentiles(df, df.columns, shares).items())).first()
    for i, c in enumerate("abcde"):
        have = [float(v[i]) for v in values if v[i] is not None]
        assert got[c] == (pytest.approx(np.quantile(have, shares).tolist(), rel=1e-12) if have else None)
    assert [r["b"] for r in E.impute_median(spark.createDataFrame([(5.0,), (None,), (1.0,), (2.0,)], "b double"), ["b"]).orderBy("b").collect()] == [1, 2, 2, 5]


def test_categories_are_bounded(spark):
    with pytest.raises(ValueError, match="too many"):
        E.categories(spark.range(E.MOST_CATEGORIES + 1).selectExpr("CAST(id AS string) AS s"), "s")


def test_registered_forest_is_whole(spark):
    from parcelforge.plans import model_queries as M

    assert set(registry.queries()) - set(registry.oracle_sql()) == {"rf_predict", "importances", "rf_report", "rf_accuracy", "cv_scores"}
    model, rows, names = M._fitted(spark, SF)
    done = forest.predict(model, rows, names, ["field_id", "crop_type"]).selectExpr("lower(crop_type) AS label", "predicted", "probability").cache()
    report = {r["class"]: r for r in stats.report(done, "label", "predicted").collect()}
    assert set(report) == {*names, "macro avg", "weighted avg"} and report["weighted avg"]["support"] == rows.count() and 0.3 < report["weighted avg"]["recall"] <= 1
    assert stats.accuracy(done, "label", "predicted").first()["accuracy"] == pytest.approx(report["weighted avg"]["recall"])
    assert (model.getNumTrees, model.numFeatures, rows.count()) == (100, len(M.FEATURES), M.full_matrix(spark, SF).where("crop_type IS NOT NULL").count())
    top = registry.queries()["importances"](spark, SF).collect()
    assert len(top) == 15 and {r["feature"] for r in top} <= set(M.FEATURES)


def test_adjacency_matrix_has_all_fields(spark):
    found = registry.queries()["adjacency_matrix"](spark, SF).collect()
    edges = [r for r in registry.queries()["adjacency_symmetric"](spark, SF).collect() if r["shared_length_m"] > 0]
    assert {(r["src"], r["dst"]) for r in found} == {(r["src"], r["dst"]) for r in edges} and len({r["src"] for r in found}) > 8


def test_rows_of_a_fit_are_not_broadcast_and_are_kept_once(spark):
    df = spark.range(60).selectExpr("id AS k", "CAST(id % 3 AS string) AS c", "double(id) AS x")
    joins = lambda rows: [x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    found = joins(forest.labelled(df, ["x"], "c")[0])
    assert found and all("rightHint=(strategy=broadcast)" in x for x in found)
    assert any("leftHint=(strategy=merge)" in x for x in joins(stats.stratified_folds(df, "c", "k")))
    kept = []
    _, rows, _ = forest.fit(df, ["x"], "c", trees=2, keep=lambda r: kept.append(r.localCheckpoint()) or kept[0])
    assert len(kept) == 1 and rows is kept[0]
