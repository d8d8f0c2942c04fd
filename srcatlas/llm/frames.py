"""Tables whose other columns may have any name: under plain names inside of an operator, as they were outside."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns with any names, which ``run`` sees and gives as they are."""
    names = df.columns
    inner = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])

    def under_plain_names(batches):
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(inner.fieldNames())

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(under_plain_names, inner).toDF(*schema.fieldNames())


def plainly(docs: DataFrame, known: tuple[str, ...], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` over a table whose columns but the known ones have plain names; its result under the names of before."""
    names = [c if c in known else f"column {i}" for i, c in enumerate(docs.columns)]
    plain = [n.replace(" ", "_") for n in names]
    return run(docs.toDF(*plain)).select(*plain).toDF(*docs.columns)
