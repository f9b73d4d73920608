"""A session with the library's functions in its SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from verbena.functions import quant, tokenizers
from verbena.sources import gguf

#: Sum over query tokens of the best dot product with a document token, as one SQL expression: it runs where rows are.
MAXSIM = """
CREATE OR REPLACE TEMPORARY FUNCTION semantic_maxsim(query ARRAY<ARRAY<FLOAT>>, document ARRAY<ARRAY<FLOAT>>) RETURNS DOUBLE
RETURN CASE WHEN query IS NULL OR document IS NULL OR size(query) = 0 OR size(document) = 0 OR coalesce(size(query[0]), 0) = 0 THEN NULL
  WHEN NOT coalesce(forall(concat(query, document), t -> coalesce(size(t) = size(query[0]) AND forall(t, x -> x IS NOT NULL), false)), false)
  THEN CAST(raise_error('token matrices must be rectangular and free of nulls') AS DOUBLE)
  ELSE aggregate(transform(query, q -> coalesce(array_max(filter(transform(document, d -> aggregate(zip_with(q, d, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)), v -> NOT isnan(v))), CAST('-Infinity' AS DOUBLE))), CAST(0 AS DOUBLE), (s, x) -> s + x) END
"""


def load(spark: SparkSession) -> SparkSession:
    """Registers the data source, table functions and scalar functions of model containers, tokenizers and scores."""
    gguf.register(spark)
    quant.register(spark)
    tokenizers.register(spark)
    spark.sql(MAXSIM)
    return spark


def connect(name: str = "verbena", extension: bool = True, **conf: str) -> SparkSession:
    """The active session or a new one, with the functions loaded unless ``extension`` is false; relations need none of them."""
    builder = SparkSession.builder.appName(name)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    return load(spark) if extension else spark
