"""Arrow-batch plumbing shared by the text operators.

Every text operator is a narrow scan: two or three columns go to Python in Arrow batches, a plain function
runs over each text, and only the rows it finds come back.  No shuffle is involved, so the operators scale
with the number of input splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Operators of a plan that a shuffle precedes.
SHUFFLES = ("Join", "Aggregate", "Sort", "Window", "Repartition", "Distinct")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give Python work at least two tasks per core.

    A table of a few unsplittable files would leave most cores idle; such a table is hashed on ``key`` once.
    Tables that already have enough splits (any large one) stay as they are.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(x in plan for x in SHUFFLES):  # partitioned as the session wants; asking for their number would run the shuffle
        return df
    want = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want // 2 else df.repartition(want, key)


def scan(df: DataFrame, columns: list[str], schema: T.StructType, fn: Callable[..., Iterable[tuple]]) -> DataFrame:
    """Apply ``fn(*values)`` to each row's ``columns`` and return the tuples it yields as rows of ``schema``."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                out.extend(fn(*values))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def rows_schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
