"""The corpus pipeline of ``quiverlake.llm.pipeline``: its stages, its run and its SQL, by the names the driver looks for."""

from quiverlake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
