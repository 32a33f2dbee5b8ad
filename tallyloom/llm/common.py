"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources.staging import shared_dir, staged

__all__ = ["SPACE_CLASS", "WORD_PATTERN", "fold", "fold_sorted", "hash_sample", "id_text", "shared_dir", "staged", "struct_of", "table", "type_of", "words"]

#: The white space that separates words, and the pattern of a word.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def id_text(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(id_text(doc_id).cast("binary")) % modulus


def hash_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows in the order of a hash of ``key``: a bounded sample that reruns repeat."""
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(limit)


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def type_of(spec: str) -> T.DataType:
    """A type from ``name`` or ``name[]``, without a session: functions are declared when modules are imported."""
    return T.ArrayType(_TYPES[spec[:-2]]) if spec.endswith("[]") else _TYPES[spec]


def struct_of(spec: str) -> T.StructType:
    """A struct from ``name type, name type, ...``."""
    return T.StructType([T.StructField(*(n, type_of(t))) for n, t in (x.split() for x in spec.split(","))])


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], folder: Callable[[], object], spec: str) -> DataFrame:
    """Fold each group's rows in order, within one streamed pass over sorted partitions.

    ``folder()`` makes a group's state: ``add`` takes the columns of a row other than the keys, ``rows`` gives its
    results as tuples, which come out after the keys. Only the state of one group is held: sorting spills to disk.
    ``spec`` lists the results; keys keep their types.
    """
    data = df.select(*keys, *[c for c in df.columns if c not in keys])
    out = T.StructType([data.schema[k] for k in keys] + struct_of(spec).fields)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(out)
        key, state, done = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or row[:n] != key:
                    if state is not None:
                        done += [key + r for r in state.rows()]
                    key, state = row[:n], folder()
                state.add(*row[n:])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), shape)], schema=shape)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[key + r for r in state.rows()]), shape)], schema=shape)

    return data.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
