"""From raw documents to token ids, in five stages; treeloom.llm.stages says
what each of them does with odd rows."""

from treeloom.llm.stages import ORACLE_SQL, STAGES, bpe_stage, language_stage, line_stage, mixing_stage, run, simhash_stage, with_length

__all__ = ["ORACLE_SQL", "STAGES", "bpe_stage", "language_stage", "line_stage", "mixing_stage", "run", "simhash_stage", "with_length"]
