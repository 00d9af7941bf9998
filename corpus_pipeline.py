"""The corpus pipeline: each stage works on what its predecessor kept."""

from __future__ import annotations

from strandlake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
