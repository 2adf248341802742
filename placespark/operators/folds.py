"""Ordered folds over groups, with a state of constant size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], values: list[str], outputs: str, begin: Callable[[], object], step: Callable[..., tuple[object, tuple | None]]) -> DataFrame:
    """keys and outputs: each group's rows in order go through step(state, *values) -> (state, output row or none).

    Rows are dealt by key, sorted, and read as a stream: a group is never held, only its state, so a hot key costs one task its
    time but not its memory. Ties of order may fall either way. A null key is a group; nulls reach step as None.
    """
    made = T._parse_datatype_string(outputs)
    schema = T.StructType([rows.select(*keys).schema[k] for k in keys] + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = object(), None
        for batch in batches:
            own = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            given = zip(*[batch.column(f"v{i}").to_pylist() for i in range(len(values))], strict=True)
            out: list[tuple] = []
            for key, now in zip(own, given, strict=True):
                if key != group:
                    group, state = key, begin()
                state, row = step(state, *now)
                if row is not None:
                    out.append((*key, *row))
            columns = list(zip(*out, strict=True)) if out else [()] * len(schema)
            types = [batch.schema.field(k).type for k in keys] + [None] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(c, t or _arrow(schema[i].dataType)) for i, (c, t) in enumerate(zip(columns, types, strict=True))], names=schema.fieldNames())

    named = rows.select(*keys, *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    ordered = named.repartition(*keys).sortWithinPartitions(*keys, *[f"o{i}" for i in range(len(order))])
    return ordered.select(*keys, *[f"v{i}" for i in range(len(values))]).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[kind.simpleString()]
