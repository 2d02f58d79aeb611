"""GeoJSON: parallel reading, boxes of nested geometry, lines of a kind, lengths."""

import json

import pytest
from pyspark.sql import functions as F

from axlewatch.functions import exprs as X
from axlewatch.operators import network as N
from axlewatch.sources import files, geojson


def feature(name, kind, body):
    key = "geometries" if kind == "GeometryCollection" else "coordinates"
    return {"type": "Feature", "properties": {"shapeName": name}, "geometry": {"type": kind, key: body}}


def square(x, y):
    return [[x, y], [x + 1, y], [x + 1, y + 1], [x, y]]


def many(n):
    return [feature(f"D{i}", "MultiPolygon", [[square(i, 0)], [square(i, 5), square(i, 5)[:2]]]) for i in range(n)]


def shown(df):
    return [(r["name"], tuple(r["box"]), r["polygons"]) for r in df.orderBy("ord").collect()]


@pytest.mark.parametrize("form", ["collection", "indented", "lines"])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, form):
    features = many(300)
    whole = {"type": "FeatureCollection", "name": "districts", "features": features}
    text = {"collection": json.dumps(whole), "indented": json.dumps(whole, indent=2),
            "lines": "\n".join(map(json.dumps, features)) + "\n"}[form]
    (tmp_path / "d.json").write_text(text)
    # the same features with their type last can only be parsed whole
    turned = [dict(reversed(f.items())) for f in features]
    (tmp_path / "turned.json").write_text(json.dumps({"features": turned}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = geojson.scan_shapes(spark, f"{tmp_path}/d.json")
        assert rows.rdd.getNumPartitions() > 5
        got = shown(rows)
        assert shown(geojson.scan_shapes(spark, f"{tmp_path}/turned.json")) == got
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [g[0] for g in got] == [f"D{i}" for i in range(300)]
    assert got[7][1] == (7.0, 0.0, 8.0, 6.0)
    assert [[len(ring) for ring in polygon] for polygon in got[7][2]] == [[4], [4]]


def test_empty_collections_and_features_without_geometry(spark, tmp_path):
    (tmp_path / "none.json").write_text('{"type":"FeatureCollection","features":[]}')
    assert geojson.scan_shapes(spark, f"{tmp_path}/none.json").count() == 0
    bare = [{"type": "Feature", "properties": {"shapeName": "A"}, "geometry": None}, feature("B", "Polygon", []),
            feature("C", "Point", [1, 2]), feature("D", "Polygon", [square(0, 0)])]
    (tmp_path / "bare.json").write_text(json.dumps({"type": "FeatureCollection", "features": bare}))
    rows = {r["name"]: r for r in geojson.scan_shapes(spark, f"{tmp_path}/bare.json").collect()}
    assert rows["A"]["box"] is None and rows["B"]["box"] is None
    assert tuple(rows["C"]["box"]) == (1.0, 2.0, 1.0, 2.0) and rows["C"]["polygons"] == []
    assert len(rows["D"]["polygons"]) == 1


def points(geometry):
    if isinstance(geometry, dict):
        return [p for part in ("coordinates", "geometries") for p in points(geometry.get(part) or [])]
    if geometry and isinstance(geometry[0], (int, float)):
        return [tuple(map(float, geometry[:2]))]
    return [p for part in geometry for p in points(part)]


@pytest.mark.parametrize("kind,body", [
    ("Point", [3, 4.5]), ("MultiPoint", [[1, 2], [-3, 4, 9]]), ("LineString", [[1, 2], [0, 7]]),
    ("Polygon", [square(1, 1), square(2, 2)]), ("MultiPolygon", [[square(1, 1)], [square(8, -2)]]),
    ("GeometryCollection", [{"type": "Point", "coordinates": [9, 9]}, {"type": "GeometryCollection", "geometries": [
        {"type": "Polygon", "coordinates": [square(-4, 0)]}]}]),
    ("Polygon", [])])
def test_boxes_of_any_nesting(spark, kind, body):
    geometry = feature("x", kind, body)["geometry"]
    df = spark.createDataFrame([(json.dumps(geometry),)], "g string")
    row = df.select(X.shape_points(F.parse_json("g")).alias("p"), X.shape_bbox(F.parse_json("g")).alias("b")).first()
    want = points(geometry)
    assert sorted(map(tuple, row["p"])) == sorted(want)
    if want:
        xs, ys = zip(*want)
        assert tuple(row["b"]) == (min(xs), min(ys), max(xs), max(ys))
    else:
        assert row["b"] is None


def test_geometry_deeper_than_the_limit_is_an_error(spark):
    deep = "[" * 30 + "1,2" + "]" * 30
    df = spark.createDataFrame([(f'{{"coordinates":{deep}}}',)], "g string")
    with pytest.raises(Exception, match="nests too deep"):
        df.select(X.shape_points(F.parse_json("g"))).collect()
    assert df.select(X.shape_points(F.parse_json("g"), 40)).first()[0] == [[1.0, 2.0]]


def test_an_island_of_a_kept_district_stays(spark, tmp_path):
    both = [feature("Coast", "MultiPolygon", [[square(29, 41)], [square(50, 10)]]), feature("Far", "Polygon", [square(50, 10)])]
    (tmp_path / "d.json").write_text(json.dumps({"type": "FeatureCollection", "features": both}))
    extent = spark.createDataFrame([(29.0, 41.0, 29.5, 41.5)], "min_lon double, min_lat double, max_lon double, max_lat double")
    rings = N.bbox_intersects(geojson.scan_districts(spark, f"{tmp_path}/d.json"), extent)
    assert [r["name"] for r in rings.collect()] == ["Coast", "Coast"]
    files.write_geography(N.bbox_intersects(geojson.scan_shapes(spark, f"{tmp_path}/d.json"), extent), f"{tmp_path}/net")
    stored = files.scan_geography(spark, f"{tmp_path}/net").collect()
    assert [(r["name"], r["vertices"], len(r["polygons"])) for r in stored] == [("Coast", 8, 2)]


def test_boxes_and_polygons_are_computed_once(spark, tmp_path):
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, many(5))) + "\n")
    extent = spark.createDataFrame([(2.0, 0.0, 2.5, 1.0)], "min_lon double, min_lat double, max_lon double, max_lat double")
    near = N.bbox_intersects(geojson.scan_shapes(spark, f"{tmp_path}/d.json"), extent).where(F.size("polygons") > 0)
    assert [r["name"] for r in near.orderBy("name").collect()] == ["D1", "D2"]
    text = near.select("name", "box", F.size("polygons"), "polygons")._jdf.queryExecution().optimizedPlan().toString()
    # each of the two steps down a geometry reads it once, above and below a filter together
    assert text.count("parseJson") == 1 and text.count("MultiPolygon") == 1, text


def test_a_line_is_of_the_kind_of_its_first_station(spark):
    rows = [("A", 0, "Metro"), ("A", 1, "Teleferik"), ("B", 3, "Teleferik"), ("B", 4, "Metro"), ("C", 0, None), ("C", 1, "Teleferik")]
    df = spark.createDataFrame(rows, "line_id string, seq long, kind string")
    assert sorted((r["line_id"], r["seq"]) for r in N.exclude_type(df).collect()) == [("A", 0), ("A", 1), ("C", 0), ("C", 1)]


def test_length_is_rounded_once(spark):
    df = spark.createDataFrame([("L", 0, "a", 0.0, 0.0), ("L", 1, "b", 1.235, 1.2346)],
                               "line_id string, seq long, name string, km double, km_exact double")
    assert N.line_totals(df).first()["length_km"] == 1.23
    assert N.line_totals(df.drop("km_exact")).first()["length_km"] == 1.24
