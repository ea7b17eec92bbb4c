"""Sinks: cut lists, policy tables, and writes that refuse to overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_documents(cuts: DataFrame, media: DataFrame) -> DataFrame:
    """One JSON document a file: version, video, and its cuts in order (seconds, three decimals)."""
    s = lambda c: F.round(F.col(c) / 1_000_000, 3)
    listed = F.array_sort(F.collect_list(F.struct(s("start_us").alias("start"), s("end_us").alias("end"))))
    rows = cuts.groupBy("filename").agg(listed.alias("cuts")).join(media, "filename")
    video = F.struct("filename", F.round(F.col("duration_us") / 1_000_000, 3).alias("duration"))
    return rows.select("filename", F.to_json(F.struct(F.lit(1).alias("version"), video.alias("video"), "cuts")).alias("value"))


def write_cuts(cuts: DataFrame, media: DataFrame, path: str) -> None:
    """A line a file; read_cuts reads them back."""
    cut_documents(cuts, media).select("value").write.mode("errorifexists").text(path)


def write_policy_table(df: DataFrame, path: str, *, form: str = "csv") -> None:
    """Flat metrics; arrays and structs go as JSON text where the form is csv."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    flat = df.withColumns({c: F.to_json(c) for c in nested}) if form == "csv" and nested else df
    out = flat.write.mode("errorifexists")
    out.option("header", True).csv(path) if form == "csv" else out.parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Fails if path exists; the commit protocol makes the files appear together."""
    df.write.mode("errorifexists").parquet(path)
