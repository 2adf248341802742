"""Arrow maps and intermediate tables shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placespark.intermediate import shared_folder, written

__all__ = ["arrow_map", "discard", "fitting_partitions", "shared_folder", "written"]


def discard(table: DataFrame) -> None:
    """Remove a written table that nothing will read again, as what was made of it is written itself."""
    files, spark = table.inputFiles(), table.sparkSession
    if files and "/table-" in files[0]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def arrow_map(df: DataFrame, inputs: dict[str, Column | str], outputs: str, function: Callable[..., list], keep: list[str] | None = None) -> DataFrame:
    """Columns keep (all of df's by default) and outputs: function gets the input arrays of a batch and returns the output arrays.

    df's own columns travel in one struct, so that their names can't clash with those of inputs or outputs; a result
    that does clash stands last, as columns of the same name would in a join. An input given as the path of a kept column, or of
    a field inside one, is read from that struct, so that a long text travels once.
    """
    kept = df.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(1).alias("one"))
    apart = {n: c for n, c in inputs.items() if not isinstance(c, str)}
    given = F.struct(*[c.alias(n) for n, c in apart.items()]) if apart else F.struct(F.lit(1).alias("one"))
    source = df.select(row.alias("row"), given.alias("given"))
    made = T._parse_datatype_string(outputs)
    schema = T.StructType([source.schema["row"], T.StructField("made", made)])
    paths = {n: None if n in apart else c.split(".") for n, c in inputs.items()}

    def found(batch: pa.RecordBatch, name: str) -> pa.Array:
        if paths[name] is None:
            return batch.column("given").field(name)
        array = batch.column("row")
        for field in paths[name]:
            array = array.field(field)
        return array

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = function(*[found(batch, n) for n in paths])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.StructArray.from_arrays(arrays, names=made.names)], names=["row", "made"])

    out = source.mapInArrow(run, schema)
    return out.select(*([F.col("row")[c].alias(c) for c in kept]), *[F.col("made")[c].alias(c) for c in made.names])


def fitting_partitions(spark: SparkSession, rows: int, rows_a_task: int) -> int:
    """Shuffle partitions that leave about rows_a_task to each, not fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_a_task))
