"""Row-generating Python functions over Arrow batches, for what columns can't express."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are turned at once; a batch's memory is this many inputs and their outputs.
ROWS = 512


def flat_map(df: DataFrame, make: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """make(*row) gives any number of rows of the schema for each row of df."""
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                out = [r for row in zip(*(c.to_pylist() for c in part.columns)) for r in make(*row)]
                if out:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, kind)
