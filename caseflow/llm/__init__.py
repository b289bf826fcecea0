"""Training-data operators and their registered queries."""


def load_all() -> tuple[dict, dict]:
    """Every query of this subpackage, and the SQL of those that have one."""
    import corpus_pipeline
    from caseflow.llm import queries  # noqa: F401
    from caseflow.llm.registry import ORACLES, QUERIES

    own = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return QUERIES | {"pipeline": corpus_pipeline.run}, ORACLES | own
