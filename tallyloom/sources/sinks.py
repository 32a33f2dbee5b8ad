"""Sinks: cell contracts, canonical JSON and reports from small frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_cells(df: DataFrame) -> DataFrame:
    """Every column as text: null is empty, booleans are true/false, doubles have all their digits."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        text = F.when(c, "true").otherwise("false") if isinstance(f.dataType, T.BooleanType) else c.cast("string")
        out.append(F.when(c.isNull(), "").otherwise(text).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """Fixed header; a folder that exists is an error."""
    csv_cells(df).write.mode("errorifexists").csv(path, header=True, emptyValue="")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").json(path, ignoreNullFields=False)


def canonical_json(columns: list[str]) -> Column:
    """One JSON text per row: keys sorted, no spaces, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def write_cache(df: DataFrame, path: str) -> None:
    """Entries keyed by a hash, in folders by its first two digits."""
    df.withColumn("prefix", F.substring("key", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A Markdown table of a small frame; ``limit`` rows are the report's length."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(head + [f"| {' | '.join(cell(v) for v in r)} |" for r in rows])
