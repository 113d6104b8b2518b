"""Operations of a training-data pipeline: operators and their queries."""

# Importing a module registers its queries.
from hirelake.llm import (  # noqa: F401
    bpe,
    chat,
    decontaminate,
    langid,
    licenses,
    line_dedup,
    near_vectors,
    pii,
    secret_scan,
    simhash,
    token_alignment,
    url_filter,
    whitening,
)
from hirelake.llm.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
