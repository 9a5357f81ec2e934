"""A training corpus from the documents table; the stages are in attestor.llm.pipeline."""

from attestor.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
