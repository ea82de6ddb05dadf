import datetime as dt
import json
import urllib.error
import urllib.request
from threading import Thread

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella import cli
from tessella.errors import ConflictError, CubeError, IncompleteError
from tessella.functions import times as tm
from tessella.functions.encoding import content_id, decode_unit
from tessella.functions.states import AverageState
from tessella.operators.series import series
from tessella.operators.static_cube import build_cube
from tessella.operators.temporal_cube import build_temporal, state_schema
from tessella.plans import correction as cor
from tessella.plans.range_query import CoveragePlan, ResolutionPlan, Segment, TemporalQuery, decompose
from tessella.serve import CubeView, SeriesView, answer, serve
from tessella.sources.bench_rows import bench_rows, digest, read_range, splitmix64, write_layouts
from tessella.sources.control import ControlStore
from tessella.sources.window_store import WindowStore
from tessella.spec import CubeSpec
from tessella.xunits import XUnit

RAW = {
    "apiVersion": "cubism/v2alpha1", "name": "sales", "dimensions": [{"name": "geo", "levels": ["country"]}],
    "measures": [{"name": "revenue", "agg": "sum", "input": "revenue"}, {"name": "n", "agg": "count"}, {"name": "mean", "agg": "avg", "input": "revenue"}],
    "includeGlobal": True, "temporal": {"eventTime": "ts", "baseResolution": "1d", "allowedLateness": "6h", "rollups": ["7d"]},
}
SPEC = CubeSpec.from_dict(RAW)
BASE = [("e1", "2026-04-06", "US", 10.0), ("e2", "2026-04-06", "GB", 20.0), ("e3", "2026-04-07", "US", 30.0), ("e4", "2026-04-07", "GB", 40.0), ("e5", "2026-04-08", "US", 50.0)]
LATE = [("e6", "2026-04-07", "US", 70.0), ("e7", "2026-04-07", "DE", 90.0)]
T = tm.parse_time
D = tm.DAY


def rows(spark, data):
    at = lambda d: dt.datetime.fromisoformat(d + "T10:00:00+00:00")
    return spark.createDataFrame([(e, at(d), c, r) for e, d, c, r in data], "event_id string, ts timestamp, country string, revenue double")


def shown(states, registry):
    names = {bytes(r["xunit_id"]): str(decode_unit(r["xunit_canonical"])) for r in registry.collect()}
    return {(tm.parse_time(r["bucket_start"]), names[bytes(r["xunit_id"])]): (r["revenue_v1"], r["n_v1"], AverageState.from_bytes(r["mean_v1"]).value()) for r in states.withColumn("bucket_start", F.col("bucket_start").cast("string")).collect()}


def test_times():
    assert tm.parse_resolution("90m") == 5_400_000_000 and tm.show_resolution(5_400_000_000) == "90m" and tm.show_resolution(7 * D) == "1w" and tm.parse_resolution("month") == "month"
    for bad in ("0s", "5", "x", "-1d"):
        with pytest.raises(CubeError):
            tm.parse_resolution(bad)
    assert tm.bucket(-1, 10_000_000) == tm.Range(-10_000_000, 0)
    with pytest.raises(CubeError):
        tm.Range(5, 5)
    assert tm.window_id(T("2026-04-07"), D) == "2026-04-07" and tm.window_id(T("2026-04-07"), 3_600_000_000) == "2026-04-07T00:00:00Z" and tm.window_id(5, 1).endswith(".000005Z")
    names = [w for w, _ in tm.affected_windows(tm.Range(T("2026-04-06T23:00:00Z"), T("2026-04-08")), D)]
    assert names == ["2026-04-06", "2026-04-07"]
    assert tm.is_on_time(0, D + 5, D, 6) and not tm.is_on_time(0, D + 6, D, 6)


@given(st.integers(-10**15, 10**15), st.integers(1, 10**12), st.integers(-10**12, 10**12))
def test_buckets_hold_their_time_and_touch(at, width, origin):
    b = tm.bucket(at, width, origin)
    assert at in b and b.length == width and (b.start - origin) % width == 0 and tm.bucket(b.end, width, origin).start == b.end


def test_build(spark):
    b = build_temporal(SPEC, rows(spark, BASE))
    got = shown(b.states, b.registry)
    assert got[(T("2026-04-06"), "/G")] == (30.0, 2, 15.0) and got[(T("2026-04-07"), "/geo/country=GB")] == (40.0, 1, 40.0) and len(got) == 8
    assert b.coverage is None and b.registry.count() == 3 and {bytes(r[0]) for r in b.registry.select("xunit_id").collect()} >= {content_id(XUnit()), content_id(XUnit.parse("/geo/country=US"))}
    assert b.states.schema.names == state_schema(SPEC).names
    assert b.explain() == {"source_rows": 5, "null_event_times": 0, "generated_xunits": 10, "buckets": 3, "output_rows": 8}


def test_windows_nulls_and_types(spark):
    window = tm.Range(T("2026-04-06"), T("2026-04-08"))
    b = build_temporal(SPEC, rows(spark, BASE), window)
    assert b.coverage == (window.start, window.end, True)
    assert build_temporal(SPEC, rows(spark, BASE), tm.Range(T("2026-04-05"), T("2026-04-08"))).coverage[2] is False
    assert build_temporal(SPEC, rows(spark, BASE), tm.Range(T("2027-01-01"), T("2027-01-02"))).coverage is None
    holes = rows(spark, BASE).withColumn("ts", F.when(F.col("event_id") != "e5", F.col("ts")))
    with pytest.raises(CubeError, match="1 rows have no event time"):
        build_temporal(SPEC, holes, window)
    q = build_temporal(SPEC, holes, None, "quarantine")
    assert q.null_event_times == 1 and q.states.agg(F.max("bucket_start")).first()[0] == dt.datetime(2026, 4, 7)
    with pytest.raises(CubeError, match="not a timestamp"):
        build_temporal(SPEC, rows(spark, BASE).withColumn("ts", F.lit("x")))


def test_all_states_have_bytes(spark):
    ms = [{"name": a, "agg": a, "input": "revenue"} for a in ("sum", "min", "max", "variance")] + [{"name": "q", "agg": "quantile", "input": "revenue", "state": {"quantileBinWidth": 10.0}}, {"name": "u", "agg": "count_distinct", "input": "country", "state": {"kmvSize": 16}}, {"name": "s", "agg": "reservoir_sample", "input": "country"}, {"name": "c", "agg": "centroid", "input": "array(revenue)"}]
    b = build_temporal(CubeSpec.from_dict(RAW | {"measures": ms}), rows(spark, BASE))
    r = b.states.where(F.col("xunit_id") == F.lit(content_id(XUnit()))).orderBy("bucket_start").first()
    assert [bytes(r[c])[:3] for c in ("variance_v1", "q_v1", "u_v1", "s_v1", "c_v1")] == [b"VAR", b"QNT", b"KMV", b"SMP", b"CTR"] and bytes(r["u_v1"])[4:8] == b"\x10\0\0\0"


def test_plans():
    assert [(s.range.start, s.range.end, s.aligned) for s in decompose(tm.Range(5, 35), 10)] == [(5, 10, False), (10, 30, True), (30, 35, False)]
    assert decompose(tm.Range(1, 9), 10) == (Segment(tm.Range(1, 9), False),) and decompose(tm.Range(5, 15), 10)[0].aligned is False
    t = SPEC.temporal
    q = TemporalQuery.of(t, "c", [XUnit()], ["n"], 0, 8 * D)
    assert ResolutionPlan.of(q, t).resolution == 7 * D and ResolutionPlan.of(TemporalQuery.of(t, "c", [], [], 0, 2 * D), t).resolution == D
    with pytest.raises(CubeError):
        TemporalQuery.of(t, "c", [], [], 0, D, "1h")
    plan = ResolutionPlan.of(TemporalQuery.of(t, "c", [], [], 0, 2 * D, "1d"), t)
    with pytest.raises(IncompleteError) as e:
        CoveragePlan.of(plan, [[("a", 1), ("b", None)]], exact=True)
    assert e.value.missing == ["b"] and CoveragePlan.of(plan, [[("a", 1)]], True).segments[0].is_exact and not CoveragePlan.of(plan, [[]]).segments[0].is_exact
    with pytest.raises(CubeError):
        CoveragePlan.of(plan, [])


def test_control_protocol(tmp_path):
    c = ControlStore(str(tmp_path / "c.db"))
    assert c.claim("q", "w", "r1", 1, 5)[1] and not c.claim("q", "w", "r1", 1, 5)[1]

    def refused(kind, f, *a):
        with pytest.raises(ConflictError) as e:
            f(*a)
        assert e.value.kind == kind

    refused("RunConflict", c.claim, "q", "w", "r1", 2, 5)
    refused("RunNotAppended", c.publish, "r1", None)
    refused("UnknownRun", c.publish, "zz", None)
    c.record_append("r1", 7)
    c.record_append("r1", 7)
    refused("RunConflict", c.record_append, "r1", 8)
    refused("StaleRevision", c.publish, "r1", 3)
    assert c.publish("r1", None).revision == 1 and c.generation("q", "w") == 1
    assert c.publish("r1", 99).revision == 1 and c.generation("q", "w") == 1  # already so: no change, whatever was expected
    c.claim("q", "w", "r2", 2, 5)
    c.record_append("r2", 9)
    assert c.publish("r2", 1).snapshot == 9 and c.publish("r1", 2).revision == 1 and c.generation("q", "w") == 3  # the last one rolls back
    again = ControlStore(str(tmp_path / "c.db"))
    assert again.current("q", "w").run_id == "r1" and again.run("r2").state == "published" and again.observed_generation("r2") == 1


def opened(spark, tmp_path):
    store = WindowStore(spark, f"file://{tmp_path}/wh", "sales", ControlStore())
    store.create()
    for k, day in enumerate(("2026-04-06", "2026-04-07", "2026-04-08")):
        cor.publish_window(SPEC, store, rows(spark, BASE), day, tm.Range(T(day), T(day) + D), 1, f"first-{k}", None)
    return store


def test_corrections_equal_a_clean_build(spark, tmp_path):
    store = opened(spark, tmp_path)
    every = rows(spark, BASE + LATE)
    done = cor.correct(SPEC, store, every, tm.Range(T("2026-04-07"), T("2026-04-10")))
    assert [w for w, _ in done.published] == ["2026-04-07", "2026-04-08"] and done.unpublished == ["2026-04-09"]
    clean = build_temporal(SPEC, every)
    assert shown(store.visible(), store.registry()) == shown(clean.states, clean.registry)
    assert shown(store.read("2026-04-07"), store.registry())[(T("2026-04-07"), "/geo/country=DE")] == (90.0, 1, 90.0)
    assert cor.inspect(store, "first-1") == ("published", False)
    store.control.publish("first-1", 2)  # rolls back
    assert (T("2026-04-07"), "/geo/country=DE") not in shown(store.read("2026-04-07"), store.registry())
    with pytest.raises(CubeError):
        store.read("2026-04-09")
    assert cor.strategy(["sum", "count"]) == "full_rebuild"


def test_recovery_and_interference(spark, tmp_path):
    store = opened(spark, tmp_path)
    b = build_temporal(SPEC, rows(spark, BASE + LATE), tm.Range(T("2026-04-07"), T("2026-04-08")))
    n = b.states.count()
    args = ("2026-04-07", 2, "fix", 1, b.states, b.registry, n, ["sum"])
    store.control.claim("sales", "2026-04-07", "fix", 2, n)
    store.append("2026-04-07", 2, "fix", b.states, b.registry)  # and here the first try died
    with pytest.raises(ConflictError):
        store.append("2026-04-07", 2, "fix", b.states, b.registry)
    assert cor.execute(store, *args).revision == 2 and cor.execute(store, *args).revision == 2
    store.control.publish("first-1", 2)
    with pytest.raises(ConflictError, match="RunNoLongerCurrent"):
        cor.execute(store, *args)
    store.control.claim("sales", "2026-04-08", "slow", 3, n)
    cor.publish_window(SPEC, store, rows(spark, BASE), "2026-04-08", tm.Range(T("2026-04-08"), T("2026-04-09")), 2, "quick", 1)
    store.control.publish("first-2", 2)  # back to revision 1: the generation tells
    with pytest.raises(ConflictError, match="WindowChangedSinceClaim"):
        cor.execute(store, "2026-04-08", 3, "slow", 1, b.states, b.registry, n, ["sum"])

    def broken(name):
        if name == "2026-04-07":
            raise OSError("gone")

    with pytest.raises(cor.PartialCorrection) as e:
        cor.correct(SPEC, store, rows(spark, BASE), tm.Range(T("2026-04-06"), T("2026-04-09")), "again", broken)
    assert [w for w, _ in e.value.progress.published] == ["2026-04-06"] and e.value.progress.not_reached == ["2026-04-08"]


def test_series_and_http(spark, tmp_path):
    store = opened(spark, tmp_path)
    windows = [{"window_id": d, "bucket_start": T(d)} for d in ("2026-04-06", "2026-04-07", "2026-04-08", "2026-04-09")]
    ask = {"selector": "/geo/country=US", "measure": "mean", "start": T("2026-04-06"), "end": T("2026-04-09") + 5, "resolution": "1d", "windows": windows[:3]}
    view = SeriesView(SPEC, store)
    got = view.series(ask)
    assert [(p["value"], p["is_exact"]) for p in got["points"]] == [(30.0, True), (None, False)] and got["source_resolution"] == "1d"
    assert [p["value"] for p in view.series(ask | {"measure": "revenue", "gap_policy": "zero"})["points"]] == [90.0, 0.0]
    with pytest.raises(CubeError):
        view.series(ask | {"exact": True, "windows": windows})
    with pytest.raises(CubeError):
        series(store.read("2026-04-06"), CoveragePlan(D, ()), [], "n_v1", "count")
    spec = CubeSpec.from_dict({"apiVersion": "v1", "name": "c", "dimensions": [{"name": "geo", "levels": ["country"]}], "measures": [{"name": "revenue", "agg": "sum", "input": "revenue"}, {"name": "who", "agg": "count_distinct", "input": "event_id"}], "includeGlobal": True})
    path = f"{tmp_path}/cube"
    build_cube(spec, rows(spark, BASE)).write.parquet(path)
    cube = CubeView.open(spark, path)
    assert cube.meta()["dimensions"] == ["geo"] and cube.meta()["sketches"] == [{"measure": "who", "kind": "kmv"}] and cube.meta()["has_global"]
    server = serve(cube, 0, view)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    get = lambda p: json.load(urllib.request.urlopen(url + p))
    assert [c["label"] for c in get("/api/cells?dim=geo")["cells"]] == ["US", "GB"] and get("/api/cell?xunit=/geo/country=US")["sketches"]["who"]["estimate"] == 3.0
    assert get("/api/setops?a=/geo/country=US&b=/geo/country=GB")["union"] == 5.0
    assert json.load(urllib.request.urlopen(urllib.request.Request(url + "/api/series", json.dumps(ask).encode())))["points"][0]["value"] == 30.0
    assert b"Cube" in urllib.request.urlopen(url + "/").read()
    for bad, status in (("/api/cell?xunit=/no/x=1", 404), ("/api/cells?dim=no", 404), ("/api/cells?dim=geo&sort=no", 400), ("/api/setops?a=/G&b=/G&measure=revenue", 400), ("/nope", 404), ("/api/cells", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(bad)
        assert e.value.code == status, bad
    server.shutdown()
    assert answer(cube, None, "POST", "/api/series")[0] == 404


def test_command_line(spark, tmp_path, capsys):
    spec, static = tmp_path / "t.yaml", tmp_path / "s.yaml"
    spec.write_text(SPEC.to_yaml())
    static.write_text("apiVersion: v1\nname: s\ndimensions: [{name: country}]\nmeasures: [{name: n, agg: count}]\n")
    (tmp_path / "in.csv").write_text("ts,country,revenue\n2026-04-06T10:00:00Z,US,1.5\n2026-04-07T10:00:00Z,GB,2.5\n")
    assert cli.run(["validate", str(spec)]) == 0 and cli.run(["run", str(static), "--input", str(tmp_path / "in.csv"), "--output", f"{tmp_path}/cube"]) == 0
    assert spark.read.parquet(f"{tmp_path}/cube").count() == 2
    states, registry = f"{tmp_path}/st", f"{tmp_path}/re"
    assert cli.run(["temporal-build", str(spec), "--input", str(tmp_path / "in.csv"), "--window-start", "2026-04-06T00:00:00Z", "--window-end", "2026-04-07T00:00:00Z", "--states-output", states, "--registry-output", registry, "--explain"]) == 0
    build = ["iceberg-build", str(spec), "--states-input", states, "--registry-input", registry, "--window-id", "2026-04-06", "--revision", "1", "--run-id", "r", "--warehouse", f"file://{tmp_path}/w", "--control-db", f"{tmp_path}/c.db"]
    assert cli.run(build) == 0 and cli.run(build) == 0
    out = capsys.readouterr().out
    assert '"generated_xunits"' in out and '"rows": 2' in out
    static.write_text("apiVersion: v9\nname: ''\ndimensions: []\n")
    assert cli.run(["validate", str(static)]) == 1 and capsys.readouterr().err.count("error:") == 3


def test_bench_rows_and_layouts(spark, tmp_path):
    import numpy as np

    assert int(splitmix64(np.array([0], np.uint64))[0]) == 0xE220A8397B1DCDAF  # the published first output for seed 0
    rows_ = bench_rows(spark, 500)
    assert rows_.select("bucket_start").distinct().count() > 100 and rows_.agg(F.min("amount")).first()[0] >= 1
    b = build_temporal(SPEC, rows(spark, BASE))
    write_layouts(b.states, b.registry, ["revenue_v1", "n_v1", "mean_v1"], f"{tmp_path}/l", 2)
    assert {n: spark.read.parquet(f"{tmp_path}/l/{n}").count() for n in ("per_measure", "wide", "tagged_struct", "registry_states", "xunit_registry")} == {"per_measure": 24, "wide": 8, "tagged_struct": 8, "registry_states": 8, "xunit_registry": 3}
    assert read_range(spark, f"{tmp_path}/l/wide", T("2026-04-07"), T("2026-04-08")).count() == 3
    again = spark.read.parquet(f"{tmp_path}/l/registry_states")
    assert digest(b.states, ["n_v1", "mean_v1"]) == digest(again, ["n_v1", "mean_v1"]) != digest(again.limit(7), ["n_v1", "mean_v1"])
