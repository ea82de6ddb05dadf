"""The control store: which run of which window is claimed, appended and published. SQLite on the driver; every change is one transaction.

A window's generation goes up with each change of its publication and with nothing else, so a run that
recovers can tell whether the window has moved since it was claimed, even back to the same revision.
"""

from __future__ import annotations

import sqlite3
import time
from dataclasses import dataclass

from ..errors import ConflictError, CubeError

CLAIMED, APPENDED, PUBLISHED = "claimed", "appended", "published"
#: Tries of a transaction that finds the store busy, and the first pause between them.
TRIES, PAUSE_S = 8, 0.01


@dataclass(frozen=True)
class Run:
    run_id: str
    cube: str
    window: str
    revision: int
    expected_rows: int
    state: str
    snapshot: int | None = None


@dataclass(frozen=True)
class Publication:
    revision: int
    run_id: str
    snapshot: int


class ControlStore:
    def __init__(self, path: str = ":memory:"):
        self.db = sqlite3.connect(path, timeout=5.0, isolation_level=None, check_same_thread=False)
        self.db.execute("CREATE TABLE IF NOT EXISTS runs (run_id TEXT PRIMARY KEY, cube TEXT, win TEXT, revision INTEGER, rows INTEGER, state TEXT, snapshot INTEGER, seen INTEGER)")
        self.db.execute("CREATE TABLE IF NOT EXISTS publications (cube TEXT, win TEXT, revision INTEGER, run_id TEXT, snapshot INTEGER, PRIMARY KEY (cube, win))")
        self.db.execute("CREATE TABLE IF NOT EXISTS generations (cube TEXT, win TEXT, n INTEGER, PRIMARY KEY (cube, win))")

    def _change(self, work):
        for k in range(TRIES):
            try:
                self.db.execute("BEGIN IMMEDIATE")
            except sqlite3.OperationalError:
                if k == TRIES - 1:
                    raise
                time.sleep(PAUSE_S * 2**k)
                continue
            try:
                out = work()
                self.db.execute("COMMIT")
                return out
            except BaseException:
                self.db.execute("ROLLBACK")
                raise

    def run(self, run_id: str) -> Run | None:
        row = self.db.execute("SELECT run_id, cube, win, revision, rows, state, snapshot FROM runs WHERE run_id = ?", (run_id,)).fetchone()
        return Run(*row) if row else None

    def current(self, cube: str, window: str) -> Publication | None:
        row = self.db.execute("SELECT revision, run_id, snapshot FROM publications WHERE cube = ? AND win = ?", (cube, window)).fetchone()
        return Publication(*row) if row else None

    def publications(self, cube: str) -> dict[str, Publication]:
        return {w: Publication(r, i, s) for w, r, i, s in self.db.execute("SELECT win, revision, run_id, snapshot FROM publications WHERE cube = ? ORDER BY win", (cube,))}

    def generation(self, cube: str, window: str) -> int:
        row = self.db.execute("SELECT n FROM generations WHERE cube = ? AND win = ?", (cube, window)).fetchone()
        return row[0] if row else 0

    def observed_generation(self, run_id: str) -> int | None:
        row = self.db.execute("SELECT seen FROM runs WHERE run_id = ?", (run_id,)).fetchone()
        return row[0] if row else None

    def claim(self, cube: str, window: str, run_id: str, revision: int, expected_rows: int) -> tuple[Run, bool]:
        """The run and whether it is new. A run claimed again with other inputs is a conflict."""
        if not window or revision < 1:
            raise CubeError("a window has a name and a revision of 1 or more")

        def work():
            old = self.run(run_id)
            if old:
                if (old.cube, old.window, old.revision, old.expected_rows) != (cube, window, revision, expected_rows):
                    raise ConflictError("RunConflict", f"run {run_id!r} was claimed for other inputs")
                return old, False
            self.db.execute("INSERT INTO runs VALUES (?, ?, ?, ?, ?, ?, NULL, ?)", (run_id, cube, window, revision, expected_rows, CLAIMED, self.generation(cube, window)))
            return self.run(run_id), True

        return self._change(work)

    def record_append(self, run_id: str, snapshot: int) -> Run:
        def work():
            run = self.run(run_id)
            if run is None:
                raise ConflictError("UnknownRun", f"there is no run {run_id!r}")
            if run.state == CLAIMED:
                self.db.execute("UPDATE runs SET state = ?, snapshot = ? WHERE run_id = ?", (APPENDED, snapshot, run_id))
            elif run.snapshot != snapshot:
                raise ConflictError("RunConflict", f"run {run_id!r} was appended as another snapshot")
            return self.run(run_id)

        return self._change(work)

    def publish(self, run_id: str, expected: int | None) -> Publication:
        """Compare and swap: ``expected`` is the revision that the caller saw. What is published already is no change; an older run may be published again, which rolls back."""

        def work():
            run = self.run(run_id)
            if run is None:
                raise ConflictError("UnknownRun", f"there is no run {run_id!r}")
            if run.state == CLAIMED:
                raise ConflictError("RunNotAppended", f"run {run_id!r} has appended nothing yet")
            now = self.current(run.cube, run.window)
            if now and now.revision == run.revision:
                return now
            if (now.revision if now else None) != expected:
                raise ConflictError("StaleRevision", f"window {run.window!r} is at {now.revision if now else None}, not {expected}")
            self.db.execute("INSERT OR REPLACE INTO publications VALUES (?, ?, ?, ?, ?)", (run.cube, run.window, run.revision, run_id, run.snapshot))
            self.db.execute("INSERT INTO generations VALUES (?, ?, 1) ON CONFLICT (cube, win) DO UPDATE SET n = n + 1", (run.cube, run.window))
            self.db.execute("UPDATE runs SET state = ? WHERE run_id = ?", (PUBLISHED, run_id))
            return self.current(run.cube, run.window)

        return self._change(work)
