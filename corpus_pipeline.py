"""A corpus from raw documents to token files: the stages of ``ridgeline.llm.pipeline`` under the names of the driver's contract."""

from ridgeline.llm.pipeline import ORACLE_SQL, STAGES, drop_contaminated, drop_near_duplicates, drop_toxic, mix, run, write_tokens

__all__ = ["ORACLE_SQL", "STAGES", "drop_contaminated", "drop_near_duplicates", "drop_toxic", "mix", "run", "write_tokens"]
