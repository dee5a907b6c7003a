"""Snapshots of active hazards: replays, late updates, an interrupted refresh."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from stepfree.shared import new_folder
from stepfree.streaming.snapshot import UPDATE, Snapshots

T = datetime(2024, 1, 1)


def _batch(spark, *rows):
    return spark.createDataFrame([(i, T + timedelta(hours=h), status, "gravel", 52.5, -1.9) for i, h, status in rows], UPDATE)


def test_snapshots(spark, monkeypatch):
    shots = Snapshots(new_folder(spark, "snap"), seconds=1)
    assert shots.seconds == 5
    with pytest.raises(FileNotFoundError):
        shots.read(spark, "grid")
    active = lambda: sorted((r.id, r.status) for r in shots.read(spark, "active").collect())
    shots.refresh(_batch(spark, (1, 0, "reported"), (2, 0, "reported"), (3, 0, "resolved")), 0)
    assert active() == [(1, "reported"), (2, "reported")]
    risks = {r.hazards for r in shots.read(spark, "grid").collect()}
    assert risks == {2}
    second = _batch(spark, (1, 5, "resolved"), (2, -1, "resolved"), (3, 1, "under_review"), (1, 4, "reported"))
    for _ in range(2):  # run again under the same number
        shots.refresh(second, 1)
        assert active() == [(2, "reported"), (3, "under_review")]
    import stepfree.streaming.snapshot as module

    def broken(active):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(module, "risk_cells", broken)
        with pytest.raises(RuntimeError):
            shots.refresh(_batch(spark, (2, 9, "resolved")), 2)
    assert active() == [(2, "reported"), (3, "under_review")] and shots.version(spark) == 1
    shots.refresh(_batch(spark, (2, 9, "resolved")), 2)
    assert active() == [(3, "under_review")]
    shots.refresh(_batch(spark, (3, 9, "rejected")), 3)
    assert active() == [] and shots.read(spark, "grid").count() == 0
