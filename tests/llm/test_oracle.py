"""The corpus queries that SQL can state give its rows."""

import corpus_pipeline
import pytest
from sitelens.llm import queries
from tests import oracle

ALL = queries.ORACLE_SQL | {"pipeline": corpus_pipeline.ORACLE_SQL}


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sf, name):
    run = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
    assert oracle.compare(run(spark, sf), oracle.connect(sf), ALL[name]) is None
