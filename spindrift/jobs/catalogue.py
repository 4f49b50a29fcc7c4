"""All queries by name, with SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from spindrift.jobs import alignment, audits, clocks, features, frames, recording, settings, traces, trains
from spindrift.jobs.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "alignment", "audits", "clocks", "features", "frames", "recording", "settings", "traces", "trains"]
