"""Corrections: affected windows are rebuilt whole from the corrected source and published in place of what was there."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConflictError, CubeError
from ..functions.states import CAPABILITIES
from ..functions.times import Range, affected_windows
from ..operators.temporal_cube import build_temporal
from ..sources.control import CLAIMED, PUBLISHED, Publication, Run
from ..sources.window_store import WindowStore
from ..spec import CubeSpec

NOT_STARTED, AWAITING_APPEND, AWAITING_PUBLISH, DONE = "not_started", "awaiting_append", "awaiting_publish", "published"


def strategy(aggs: list[str]) -> str:
    """A shortcut would need every state to be subtractable and idempotent; none is both, so windows are rebuilt."""
    return "additive" if aggs and all(CAPABILITIES[a][3] and CAPABILITIES[a][2] for a in aggs) else "full_rebuild"


def stage_of(run: Run | None) -> str:
    """What a run still waits for."""
    if run is None:
        return NOT_STARTED
    return AWAITING_APPEND if run.state == CLAIMED else DONE if run.state == PUBLISHED else AWAITING_PUBLISH


def inspect(store: WindowStore, run_id: str) -> tuple[str, bool]:
    """The stage of a run, and whether it is what its window shows."""
    run = store.control.run(run_id)
    now = store.control.current(run.cube, run.window) if run else None
    return stage_of(run), bool(now and now.run_id == run_id)


def execute(store: WindowStore, window: str, revision: int, run_id: str, observed: int | None, states: DataFrame, registry: DataFrame, expected_rows: int, aggs: list[str]) -> Publication:
    """Claim, append or recover, check that the window has not moved, publish. May be called again after any failure.

    ``observed`` is the revision that was current before the states were built, None for a first publication.
    """
    if strategy(aggs) != "full_rebuild":
        raise CubeError("only full rebuilds are carried out")
    control = store.control
    run, _ = control.claim(store.cube, window, run_id, revision, expected_rows)
    stage = stage_of(run)
    if stage == AWAITING_APPEND:
        snapshot = store.snapshot_of(window, revision, run_id)  # an earlier try may have got so far
        control.record_append(run_id, store.append(window, revision, run_id, states, registry) if snapshot is None else snapshot)
    now = control.current(store.cube, window)
    if stage == DONE and (now is None or now.revision != revision):
        raise ConflictError("RunNoLongerCurrent", f"run {run_id!r} was published, and window {window!r} has moved on")
    if stage != DONE and observed is not None and control.observed_generation(run_id) != control.generation(store.cube, window):
        raise ConflictError("WindowChangedSinceClaim", f"window {window!r} was published by others since run {run_id!r} was claimed")
    return control.publish(run_id, observed)


@dataclass
class Correction:
    """What a correction did, window by window."""

    published: list[tuple[str, Publication]] = field(default_factory=list)
    unpublished: list[str] = field(default_factory=list)
    not_reached: list[str] = field(default_factory=list)


class PartialCorrection(CubeError):
    """A window failed; ``progress`` tells what was done before."""

    def __init__(self, window: str, cause: Exception, progress: Correction):
        super().__init__(f"window {window!r}: {cause}")
        self.window, self.progress = window, progress


def plan(spec: CubeSpec, store: WindowStore, changed: Range) -> list[tuple[str, Range, int | None]]:
    """Affected windows with their current revisions; None where nothing is published, which a correction leaves alone."""
    out = []
    for name, r in affected_windows(changed, spec.temporal.base, spec.temporal.origin):
        now = store.control.current(store.cube, name)
        out.append((name, r, now.revision if now else None))
    return out


def correct(spec: CubeSpec, store: WindowStore, source: DataFrame, changed: Range, prefix: str = "correction", before: Callable[[str], None] | None = None) -> Correction:
    """Rebuilds every published window that ``changed`` touches from ``source``, which holds all rows and not only the late ones.

    Current revisions are read first, so whoever publishes meanwhile wins and this fails. All windows are built in one pass over the source and kept; each is then published from its buckets.
    """
    done, todo = Correction(), plan(spec, store, changed)
    done.unpublished = [n for n, _, revision in todo if revision is None]
    todo = [w for w in todo if w[2] is not None]
    if not todo:
        return done
    whole = Range(min(r.start for _, r, _ in todo), max(r.end for _, r, _ in todo))
    built = build_temporal(spec, source, whole, "quarantine", ordered=False)
    states, registry = built.states.persist(), built.registry.persist()
    try:
        sizes = {r["b"]: r["n"] for r in states.groupBy(F.unix_micros("bucket_start").alias("b")).agg(F.count("*").alias("n")).collect()}
        for k, (name, window, revision) in enumerate(todo):
            try:
                if before:
                    before(name)
                inside = states.where((F.unix_micros("bucket_start") >= window.start) & (F.unix_micros("bucket_start") < window.end))
                names = registry.join(inside.select("xunit_id").distinct(), "xunit_id", "left_semi")
                rows = sum(n for b, n in sizes.items() if window.start <= b < window.end)
                done.published.append((name, execute(store, name, revision + 1, f"{prefix}-{name}-r{revision + 1}", revision, inside, names, rows, [m.agg for m in spec.measures])))
            except Exception as e:
                done.not_reached = [n for n, _, _ in todo[k + 1 :]]
                raise PartialCorrection(name, e, done) from e
    finally:
        states.unpersist()
        registry.unpersist()
    return done


def publish_window(spec: CubeSpec, store: WindowStore, source: DataFrame, name: str, window: Range, revision: int, run_id: str, observed: int | None) -> Publication:
    """Builds one window and publishes it as a revision."""
    built = build_temporal(spec, source, window, "quarantine", ordered=False)
    states = built.states.persist()
    try:
        return execute(store, name, revision, run_id, observed, states, built.registry, states.count(), [m.agg for m in spec.measures])
    finally:
        states.unpersist()
