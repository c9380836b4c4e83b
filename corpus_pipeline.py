"""The training-data pipeline: ``STAGES``, ``run(spark, sf_dir)`` and ``ORACLE_SQL``. Counted as part of ``parcelforge.llm``, where its body is."""

from parcelforge.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
