import json

import pytest
from pyspark.sql import functions as F

from tessella.errors import CubeError
from tessella.functions.sketches import CentroidSketch, KmvSketch, SampleSketch, TopKSketch
from tessella.operators import set_algebra as algebra
from tessella.operators.static_cube import build_cube, show_cube
from tessella.plans.shapes import generate_xunits
from tessella.spec import CubeSpec

ROWS = [("CZ", "Prague", "F", 10, "u1"), ("CZ", "Brno", "M", 20, "u2"), ("US", None, "F", 40, "u1"), (None, None, "F", 80, "u3")]
SCHEMA = "country string, city string, gender string, pv long, user_id string"
MEASURES = [{"name": "pv", "agg": "sum", "input": "pv"}, {"name": "n", "agg": "count"}]


def spec(measures=MEASURES, **more):
    return CubeSpec.from_dict({"apiVersion": "v1", "name": "web", "dimensions": [{"name": "geo", "levels": ["country", "city"]}, {"name": "gender"}], "measures": measures, "includeGlobal": True} | more)


@pytest.fixture(scope="module")
def web(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def cells(df):
    return {r["xunit"]: r for r in df.collect()}


def test_web_fixture(web):
    got = {k: (r["pv"], r["n"]) for k, r in cells(build_cube(spec(), web)).items()}
    assert len(got) == 12 and got["/G"] == (150, 4) and got["/geo/country=CZ"] == (30, 2) and got["/geo/country=US"] == (40, 1)
    assert got["/geo/country=CZ/city=Prague"] == (10, 1) and got["/gender/gender=F"] == (130, 3) and got["/gender/gender=F,/geo/country=CZ"] == (10, 1)


def test_cells_are_those_of_the_row_lattice(web):
    s = spec(includeGlobal=False, filterRules=[{"type": "not_alone", "dim": "gender"}])
    want = {}
    for country, city, gender, pv, _ in ROWS:
        for x in generate_xunits(s, {"geo": [country, city], "gender": [gender]}, pruned=False):
            want[str(x)] = want.get(str(x), 0) + pv
    assert {k: r["pv"] for k, r in cells(build_cube(s, web)).items()} == want


def test_rules(web):
    assert len(cells(build_cube(spec(filterRules=[{"type": "top_level", "dim": "geo"}]), web))) == 5
    with pytest.raises(CubeError):
        build_cube(spec(includeGlobal=False, filterRules=[{"type": "min_dimensions", "n": 3}]), web)


def test_sketches(web):
    ms = [{"name": "u", "agg": "count_distinct", "input": "user_id"}, {"name": "t", "agg": "top_k", "input": "city", "by": "pv"}, {"name": "s", "agg": "reservoir_sample", "input": "user_id"}]
    got = cells(build_cube(spec(ms), web))
    g = got["/G"]
    assert g["t"] == '[{"key":"Brno","score":20.0},{"key":"Prague","score":10.0}]' and set(SampleSketch.from_bytes(g["s__sketch"]).values) == {"u1", "u2", "u3"}
    assert [got[x]["u"] for x in ("/G", "/gender/gender=F", "/gender/gender=M", "/geo/country=CZ")] == [3.0, 2.0, 1.0, 2.0]
    f, m, cz = (KmvSketch.from_bytes(got[x]["u__sketch"]) for x in ("/gender/gender=F", "/gender/gender=M", "/geo/country=CZ"))
    assert f.intersection_estimate(cz) == 1.0 and f.union_estimate(m) == 3.0 and f == KmvSketch().extend(["u1", "u3"])
    assert TopKSketch.from_bytes(got["/geo/country=US"]["t__sketch"]).items == [] and got["/geo/country=US"]["t"] == "[]"


def test_centroid(spark):
    df = spark.createDataFrame([("eng", [1.0, 0.0]), ("eng", [0.0, 1.0]), ("eng", None), ("ops", [None, 4.0])], "channel string, e array<double>")
    s = CubeSpec.from_dict({"apiVersion": "v1", "name": "c", "dimensions": [{"name": "channel"}], "measures": [{"name": "m", "agg": "centroid", "input": "e"}]})
    got = cells(build_cube(s, df))
    assert got["/channel/channel=eng"]["m"] == [0.5, 0.5] and got["/channel/channel=ops"]["m"] == [0.0, 4.0]
    assert CentroidSketch.from_bytes(got["/channel/channel=eng"]["m__sketch"]).count == 2
    with pytest.raises(CubeError, match="elements"):
        build_cube(s, df.unionByName(spark.createDataFrame([("x", [1.0])], df.schema)))


def test_numbers_and_strictness(web):
    ms = [{"name": a, "agg": a, "input": "pv"} for a in ("min", "max", "avg", "variance", "quantile")]
    g = cells(build_cube(spec(ms), web, quantile_width=10.0))["/G"]
    assert (g["min"], g["max"], g["avg"], g["quantile"]) == (10, 80, 37.5, 25.0) and '"populationVariance":718.75' in g["variance"]
    with pytest.raises(CubeError):
        build_cube(spec(ms), web, strict=True)
    with pytest.raises(CubeError):
        build_cube(spec([]), web)
    bad = web.withColumn("pv", F.lit(float("nan")))
    with pytest.raises(Exception, match="finite"):
        build_cube(spec([ms[2]]), bad).collect()


def test_guard_scrubbing_empty_and_nulls(spark, web):
    many = {"dimensions": [{"name": "user_id"}, {"name": "gender"}], "maxDictionaryEntries": 3}
    with pytest.raises(CubeError, match="maxDictionaryEntries"):
        build_cube(spec(**many), web)
    df = spark.createDataFrame([("a/b=c,d", None, "F", 1, "u")], SCHEMA)
    assert "/geo/country=a___b###c+++d" in cells(build_cube(spec(), df))
    assert build_cube(spec(), web.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "x", None, None, None)] * 2, SCHEMA)
    assert [(r["xunit"], r["pv"], r["n"]) for r in build_cube(spec(), nulls).collect()] == [("/G", None, 2)]
    assert show_cube(build_cube(spec([*MEASURES, {"name": "u", "agg": "count_distinct", "input": "user_id"}]), web), limit=2).columns == ["xunit", "pv", "n", "u"]


def test_many_shapes_in_several_passes(spark):
    dims = [{"name": f"d{i}", "levels": [{"name": "x", "expr": f"CAST(id % {i + 2} AS STRING)"}, {"name": "y", "expr": "CAST(id % 2 AS STRING)"}]} for i in range(4)]
    s = CubeSpec.from_dict({"apiVersion": "v1", "name": "c", "dimensions": dims, "measures": [{"name": "n", "agg": "count"}], "includeGlobal": True})
    got = {r["xunit"]: r["n"] for r in build_cube(s, spark.range(60)).collect()}
    want = {}
    for i in range(60):
        for x in generate_xunits(s, {f"d{k}": [str(i % (k + 2)), str(i % 2)] for k in range(4)}):
            want[str(x)] = want.get(str(x), 0) + 1
    assert got == want


def test_merge_is_the_whole(web):
    ms = [*MEASURES, {"name": "a", "agg": "avg", "input": "pv"}, {"name": "v", "agg": "variance", "input": "pv"}, {"name": "q", "agg": "quantile", "input": "pv"}, {"name": "u", "agg": "count_distinct", "input": "user_id"}, {"name": "t", "agg": "top_k", "input": "user_id", "by": "pv"}, {"name": "s", "agg": "reservoir_sample", "input": "user_id"}, {"name": "c", "agg": "centroid", "input": "array(CAST(pv AS DOUBLE))"}]
    s = spec(ms)
    parts = [build_cube(s, web.where(c), raw=True) for c in ("gender = 'F' AND pv < 50", "gender = 'M' OR pv > 50")]
    merged, whole = cells(algebra.merge_cubes(parts, s)), cells(build_cube(s, web))
    assert set(merged) == set(whole)
    for x, r in merged.items():
        a, b = r.asDict(), whole[x].asDict()
        assert json.loads(a.pop("v")) == pytest.approx(json.loads(b.pop("v")))
        assert a == b


def test_algebra_over_cells(spark):
    df = spark.createDataFrame([("Bash", "ok", 10, "s1"), ("Bash", "error", 20, "s1"), ("Bash", "ok", 30, "s2"), ("Read", "ok", 40, "s2"), ("Read", "error", 50, "s3")], "tool string, outcome string, tokens long, sid string")
    s = CubeSpec.from_dict({"apiVersion": "v1", "name": "c", "dimensions": [{"name": "tool"}, {"name": "outcome"}], "measures": [{"name": "u", "agg": "count_distinct", "input": "sid"}, {"name": "n", "agg": "count"}], "includeGlobal": True})
    raw = build_cube(s, df, raw=True)
    r = algebra.set_ops(raw, "/tool/tool=Bash", "/outcome/outcome=error", "u").first()
    assert (r["intersection_estimate"], r["union_estimate"], r["lift"]) == (1.0, 3.0, 0.75)
    assert algebra.set_ops(raw, "/tool/tool=Bash", "/no/x=1", "u").count() == 0
    tools = raw.where(algebra.slice_of("tool") | (F.col("xunit") == "/G"))
    assert [(r["a"], r["b"], r["jaccard"]) for r in algebra.all_pairs(tools, "u").collect()] == [("/tool/tool=Bash", "/tool/tool=Read", 1 / 3)]
    no_global = algebra.all_pairs(raw.where(algebra.slice_of("tool")), "u").first()
    assert no_global["lift"] is None
    rate = {r["xunit"]: r["rate"] for r in algebra.rates(build_cube(s, df), "n", "outcome", "outcome", "error").collect()}
    assert rate == {"/G": 0.4, "/tool/tool=Bash": 1 / 3, "/tool/tool=Read": 0.5}


def test_bottom_k_is_the_sketch_of_each_cell(spark, monkeypatch):
    from tessella.operators import bottom_k as bk

    monkeypatch.setattr(bk, "ROWS_AT_ONCE", 70)
    rows = [(f"c{i % 3}" if i % 11 else None, f"t{i % 4}" if i % 7 else None, f"u{i * 7 % 900}" if i % 5 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "country string, city string, who string").repartition(3)
    s = CubeSpec.from_dict({"apiVersion": "v1", "name": "c", "dimensions": [{"name": "geo", "levels": ["country", "city"]}, {"name": "city"}], "measures": [{"name": "u", "agg": "count_distinct", "input": "who"}, {"name": "n", "agg": "count"}], "includeGlobal": True})
    want = {}
    for country, city, who in rows:
        for x in generate_xunits(s, {"geo": [country, city], "city": [city]}):
            want.setdefault(str(x), set()).update([who] if who else [])
    small = {x: KmvSketch(1024).extend(v) for x, v in want.items()}
    got = cells(build_cube(s, df))
    assert {x: KmvSketch.from_bytes(r["u__sketch"]) for x, r in got.items()} == small
    keyed = df.select(F.col("country").alias("a"), F.col("who").alias("x"))
    out = bk.bottom_k_cells(keyed, "x", [], ["a"], [(["a"], ["a"]), ([], [])], 16, "h").collect()
    assert {r["a"]: list(r["h"]) for r in out} == {c: [h - 2**63 for h in KmvSketch(16).extend(w for k, _, w in rows if w and (c is None or k == c)).hashes] for c in ("c0", "c1", "c2", None)}


def test_functions_in_sql(spark, web):
    from tessella.functions.encoding import content_id
    from tessella.functions.register import register
    from tessella.functions.states import AverageState, QuantileState
    from tessella.xunits import XUnit

    register(spark)
    ms = [{"name": "u", "agg": "count_distinct", "input": "user_id"}, {"name": "t", "agg": "top_k", "input": "city", "by": "pv"}, {"name": "s", "agg": "reservoir_sample", "input": "user_id"}]
    build_cube(spec(ms, includeGlobal=False, filterRules=[{"type": "top_level", "dim": "gender"}]), web).createOrReplaceTempView("cube")
    r = spark.sql("SELECT kmv_estimate(kmv_merge(u__sketch)) AS u, topk_json(topk_merge(t__sketch)) AS t, sample_json(sample_merge(s__sketch)) AS s FROM cube WHERE xunit LIKE '/gender%' AND NOT contains(xunit, ',')").first()
    assert r["u"] == 3.0 and r["t"] == '[{"key":"Brno","score":20.0},{"key":"Prague","score":10.0}]' and r["s"].count("u") == 3
    assert spark.sql("SELECT hex(xunit_content_id(xunit)) AS i FROM cube WHERE xunit LIKE '/gender%' AND NOT contains(xunit, ',') ORDER BY 1 DESC").first()["i"].lower() == max(content_id(XUnit.parse(f"/gender/gender={g}")).hex() for g in "FM")
    q = QuantileState(1.0, {1: 1, 4: 1})
    spark.createDataFrame([(bytearray(AverageState(6.0, 4).to_bytes()), bytearray(q.to_bytes()))] * 2, "a binary, q binary").createOrReplaceTempView("states")
    assert spark.sql("SELECT average_value(average_merge(a)), quantile_at(quantile_merge(q), 1.0) FROM states").first()[:] == (1.5, 4.5)
    assert str(spark.sql("SELECT bucket_start(TIMESTAMP '2024-01-01 05:30:00', 3600000000, 0) AS b").first()["b"]) == "2024-01-01 05:00:00"


def test_estimates_beyond_a_sketch_are_those_of_one_sketch(spark):
    """Cells of 3000 values, by the sketch that adds them one by one."""
    rows = [("a", f"v{i}") for i in range(3000)] + [("b", f"v{i}") for i in range(1500, 4500)]
    spec = CubeSpec.from_dict({"apiVersion": "v1", "name": "c", "dimensions": [{"name": "k", "levels": ["k"]}], "measures": [{"name": "d", "agg": "count_distinct", "input": "v"}], "includeGlobal": True})
    cube = build_cube(spec, spark.createDataFrame(rows * 2, "k string, v string").repartition(7), raw=True)
    a, b, every = (KmvSketch().extend(x) for x in ([v for k, v in rows if k == "a"], [v for k, v in rows if k == "b"], [v for _, v in rows]))
    shown = {r["xunit"]: (r["d"], bytes(r["d__sketch"])) for r in build_cube(spec, spark.createDataFrame(rows, "k string, v string")).collect()}
    for cell, sketch in (("/k/k=a", a), ("/G", every)):
        assert shown[cell][1] == sketch.to_bytes() and shown[cell][0] == pytest.approx(sketch.estimate(), rel=1e-12)
    assert abs(a.estimate() / 3000 - 1) < 0.12
    got = algebra.set_ops(cube, "/k/k=a", "/k/k=b", "d").first()
    assert got["union_estimate"] == pytest.approx(a.union_estimate(b)) and got["intersection_estimate"] == pytest.approx(a.intersection_estimate(b)) and got["jaccard"] == pytest.approx(a.jaccard(b))
