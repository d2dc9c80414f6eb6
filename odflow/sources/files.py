"""Reading raw flows, graphs, mappings and folds; writing partitions and scores."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_raw(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet by suffix, otherwise CSV with a header. CSV columns are text unless a schema is given."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def write_partitions(flows: DataFrame, path: str, by: Sequence[str] = ("study_area", "partition")) -> None:
    """One table, a folder per study area and partition, so that readers prune by folder.

    A large partition is written by many tasks: rows are spread by origin within it.
    """
    columns = [c for c in by if c in flows.columns]
    flows.repartition(*columns, "origin").write.mode("overwrite").partitionBy(*columns).parquet(path)


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _one_object(shape: str) -> Column:
    """The text as an object of the shape, NULL unless it is one JSON object and nothing else.

    ``from_json`` does not look at what follows a document. Here the text stands within a list and within an object: what follows
    it would have to close both in one place.
    """
    within = lambda before, after, outer: F.from_json(F.concat(F.lit(before), "value", F.lit(after)), outer)
    alone = (F.size(within("[", "]", f"array<{shape}>")) == 1) & F.regexp_replace("value", r"^\s+", "").startswith("{")
    return F.when(alone, within('{"x":', "}", f"x {shape}")["x"])


def _parsed(texts: DataFrame, shape: str) -> DataFrame:
    """``doc`` of texts that must hold one object each; blank texts have none."""
    doc = _one_object(shape)
    wrong = F.raise_error(F.concat(F.lit("not one JSON object of the expected shape: "), F.substring("value", 1, 80)))
    # The planner may look at a text before the filter of blank ones does.
    return texts.select(F.when(doc.isNotNull(), doc).when(F.trim("value") != "", wrong).alias("doc"))


def _read_objects(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """``doc`` of every object. A file of which each line is an object is read by lines, in parts; any other must be one object as a whole."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    kinds = lines.groupBy("file").agg(F.bool_and(_one_object(shape).isNotNull()).alias("by_lines"))
    whole = [r.file for r in kinds.where("NOT by_lines").collect()]  # a row per file that holds one document
    if not whole:
        return _parsed(lines, shape)
    others = [r.file for r in kinds.where("by_lines").collect()]
    named = lambda files: [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in files]
    documents = _parsed(spark.read.text(named(whole), wholetext=True), shape)
    return documents.unionByName(_parsed(spark.read.text(named(others)).where("trim(value) <> ''"), shape)) if others else documents


def read_adjacency(spark: SparkSession, path: str, study_area: str) -> DataFrame:
    """Edges from JSON objects {zone: [neighbours]}, one object per line or per file."""
    links = _read_objects(spark, path, "map<string,array<string>>")
    return links.select(F.explode("doc").alias("src", "near")).select(
        F.lit(study_area).alias("study_area"), "src", F.explode("near").alias("dst")
    )


def read_mapping(spark: SparkSession, path: str, study_area: str) -> DataFrame:
    """Zone-to-group rows from JSON objects {zone: group}, one object per line or per file."""
    pairs = _read_objects(spark, path, "map<string,string>")
    return pairs.select(F.explode("doc").alias("zone", "group")).select(
        F.lit(study_area).alias("study_area"), "zone", "group"
    )


def read_blocks(spark: SparkSession, path: str, study_area: str) -> DataFrame:
    """(study_area, zone, block) from one JSON document {"blocks": [[zone, …], …]} per file; a block is its place in the document."""
    document = _parsed(spark.read.text(path, wholetext=True).where("trim(value) <> ''"), "struct<blocks:array<array<string>>>")
    return document.select(F.posexplode("doc.blocks").alias("block", "members")).select(
        F.lit(study_area).alias("study_area"), F.explode("members").alias("zone"), "block"
    )


def write_scores(scores: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = scores.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"scores are written as parquet or csv, not {fmt}")
