"""What __spark_entry__.py adds: the queries of the operators and the pipeline over them."""

import corpus_pipeline

from clademill.llm import queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLE_SQL = {**queries.ORACLE_SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
