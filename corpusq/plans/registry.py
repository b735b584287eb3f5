"""Registration of a query together with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: Spark 4.1 takes a union of equally partitioned sides for partitioned itself and leaves out the exchange
#: before a grouping. After adaptive execution has read the sides in other partitions, groups fall apart:
#: a union of card pairs lost half of its rows in one of three runs. So the queries run without it.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


class Catalog:
    """Queries and SQL of one module. Integers leave every query as longs, as they do in the SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def wrap(query: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                spark.conf.set(UNION_PARTITIONING, "false")
                d = query(spark, sf_dir)
                small = [c for c, t in d.dtypes if t in ("int", "smallint", "tinyint")]
                return d.withColumns({c: F.col(c).cast("long") for c in small}) if small else d

            run.__doc__, run.__name__ = query.__doc__, query.__name__
            key = name or query.__name__
            self.queries[key] = run
            if sql:
                self.sql[key] = sql
            return query

        return wrap
