"""The corpus pipeline of the llm subpackage: STAGES, ORACLE_SQL and run(spark, sf_dir)."""

from advertlake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
