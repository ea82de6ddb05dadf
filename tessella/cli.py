"""Command line: ``python -m tessella.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from .errors import CubeError, SpecError
from .functions.times import Range, parse_time
from .spec import CubeSpec


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("validate", help="check a spec").add_argument("spec")
    run = sub.add_parser("run", help="build a static cube")
    run.add_argument("spec")
    run.add_argument("--input", required=True)
    run.add_argument("--output")
    run.add_argument("--show", type=int, default=10)
    t = sub.add_parser("temporal-build", help="build temporal states")
    t.add_argument("spec")
    t.add_argument("--input", required=True)
    for name in ("--window-start", "--window-end", "--states-output", "--registry-output"):
        t.add_argument(name)
    t.add_argument("--null-policy", choices=["reject", "quarantine"], default="reject")
    t.add_argument("--explain", action="store_true")
    w = sub.add_parser("window-build", aliases=["iceberg-build"], help="append and publish a window of states")
    w.add_argument("spec")
    for name in ("--states-input", "--registry-input", "--window-id", "--run-id", "--warehouse"):
        w.add_argument(name, required=True)
    w.add_argument("--revision", type=int, required=True)
    w.add_argument("--catalog-db", help="taken for the sake of old scripts; the layout of folders is the catalog")
    w.add_argument("--control-db", default=":memory:")
    s = sub.add_parser("serve", help="answer questions about a cube over HTTP")
    s.add_argument("cube")
    s.add_argument("--port", type=int, default=8080)
    for name in ("--spec", "--warehouse", "--catalog-db"):
        s.add_argument(name)
    s.add_argument("--control-db", default=":memory:")
    return p


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _spec(path: str) -> CubeSpec:
    text = Path(path).read_text()
    return CubeSpec.from_json(text) if path.endswith(".json") else CubeSpec.from_yaml(text)


def run(argv: list[str]) -> int:
    a = _parser().parse_args(argv)
    try:
        if a.command == "validate":
            spec = _spec(a.spec)
            print(f"ok: {spec.name}, {len(spec.dimensions)} dimensions, {len(spec.measures)} measures")
        elif a.command == "run":
            _run(a)
        elif a.command == "temporal-build":
            _temporal(a)
        elif a.command in ("window-build", "iceberg-build"):
            _window(a)
        else:
            _serve(a)
    except SpecError as e:
        print("\n".join(f"error: {x}" for x in e.problems), file=sys.stderr)
        return 1
    except (CubeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def _run(a) -> None:
    from .operators.static_cube import build_cube, show_cube
    from .sources.tables import read_source, write_cube

    began, spark = time.time(), _session()
    cube = build_cube(_spec(a.spec), read_source(spark, a.input)).cache()
    print(f"{cube.count()} cells in {time.time() - began:.2f} s")
    show_cube(cube, limit=a.show).show(a.show, truncate=False)
    if a.output:
        write_cube(cube, a.output)


def _temporal(a) -> None:
    from .operators.temporal_cube import build_temporal, write_fixtures
    from .sources.tables import read_source

    if bool(a.window_start) != bool(a.window_end) or bool(a.states_output) != bool(a.registry_output):
        raise CubeError("a window has a start and an end; states and registry are written together")
    window = Range(parse_time(a.window_start), parse_time(a.window_end)) if a.window_start else None
    build = build_temporal(_spec(a.spec), read_source(_session(), a.input), window, a.null_policy)
    if a.states_output:
        write_fixtures(build, a.states_output, a.registry_output)
    print(json.dumps({"rows": build.states.count(), "null_event_times": build.null_event_times, "coverage": build.coverage} | ({"explain": build.explain()} if a.explain else {})))


def _window(a) -> None:
    from .plans.correction import execute
    from .sources.control import ControlStore
    from .sources.window_store import WindowStore

    spec, spark = _spec(a.spec), _session()
    store = WindowStore(spark, a.warehouse, spec.name, ControlStore(a.control_db))
    store.create()
    states, registry = spark.read.parquet(a.states_input), spark.read.parquet(a.registry_input)
    now = store.control.current(spec.name, a.window_id)
    pub = execute(store, a.window_id, a.revision, a.run_id, now.revision if now else None, states, registry, states.count(), [m.agg for m in spec.measures])
    print(json.dumps({"window": a.window_id, "revision": pub.revision, "run": pub.run_id, "snapshot": pub.snapshot, "rows": store.read(a.window_id).count()}))


def _serve(a) -> None:
    from .serve import CubeView, SeriesView, serve
    from .sources.control import ControlStore
    from .sources.window_store import WindowStore

    if bool(a.spec) != bool(a.warehouse):
        raise CubeError("--spec and --warehouse go together")
    spark, more = _session(), None
    if a.spec:
        spec = _spec(a.spec)
        more = SeriesView(spec, WindowStore(spark, a.warehouse, spec.name, ControlStore(a.control_db)))
    server = serve(CubeView.open(spark, a.cube), a.port, more)
    print(f"http://127.0.0.1:{server.server_port}")
    server.serve_forever()


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
