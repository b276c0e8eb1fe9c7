"""Rows of texts through Python in Arrow batches: keys stay the Arrow arrays that they are, whatever their type or nulls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a schema given as DDL."""
    return to_arrow_schema(StructType.fromDDL(schema))


def map_texts(docs: DataFrame, text: str, keep: dict[str, str], schema: str, of: Callable[[], Callable]) -> DataFrame:
    """Columns of docs, named by keep (new name to old), and the columns of schema, which come from the texts.

    of() is called once for each task and gives a function from a list of texts (None where null) to either a list of
    columns, or a pair of a list of columns and a list of the places of the texts that their rows belong to."""
    rows = docs.select(*[F.col(f"`{old}`").alias(f"k{i}") for i, old in enumerate(keep.values())], F.col(f"`{text}`").cast("string").alias("t"))
    kept = ", ".join(f"`k{i}` {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:-1]))
    out = f"{kept}, {schema}" if kept else schema
    kinds = list(arrow_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = of()
        for batch in batches:
            found = answer(batch.column(batch.num_columns - 1).to_pylist())
            held = batch.columns[:-1]
            if isinstance(found, tuple):
                found, places = found
                held = [c.take(pa.array(places, pa.int64())) for c in held]
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays([*held, *arrays], [*(f"k{i}" for i in range(len(held))), *(f.name for f in kinds)])

    done = rows.mapInArrow(run, out)
    return done.select(*[F.col(f"k{i}").alias(name) for i, name in enumerate(keep)], *[F.col(f"`{f.name}`") for f in kinds])
