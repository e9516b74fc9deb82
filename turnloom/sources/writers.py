"""Writing results: lines, documents, tables by part."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, *, mode: str = "overwrite") -> int:
    """JSON lines; gives the number of rows, counted while writing."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return int(seen.get["n"])


def write_array(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """One JSON list per output file: brackets and commas are put around the rows of each partition, in one pass."""

    def listed(batches):
        import pandas as pd

        sign = "["
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"value": [sign + pdf["value"].iloc[0], *("," + v for v in pdf["value"].iloc[1:])]})
                sign = ","
        yield pd.DataFrame({"value": ["]" if sign == "," else "[]"]})

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInPandas(listed, "value string").write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """A quoted CSV table with a heading."""
    df.write.mode(mode).option("header", True).option("quoteAll", True).csv(path)


def write_ids(df: DataFrame, column: str, path: str, *, mode: str = "overwrite") -> None:
    df.select(F.col(column).cast("string")).write.mode(mode).text(path)


def write_parts(df: DataFrame, path: str, by: tuple[str, ...] = ("left_out", "part"), *, mode: str = "overwrite") -> None:
    """A folder per value of ``by``; rows are brought together first, so each folder gets few files."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).json(path)


def write_all(df: DataFrame, outputs: dict[str, tuple[str, object]], *, mode: str = "overwrite") -> None:
    """Several outputs of one computed table: name -> (path, DataFrame -> DataFrame). The table is stored once in the shared folder."""
    from turnloom.runtime import stored

    once = stored(df, "fan-out")
    for path, part in outputs.values():
        part(once).write.mode(mode).json(path)


def derived_paths(path: str) -> tuple[str, str]:
    """Where the labelled dialogues and the annotations left over of an input go."""
    stem, ending = os.path.splitext(path)
    return f"{stem}_with_refer{ending or '.json'}", f"{stem}_missed_refer{ending or '.json'}"
