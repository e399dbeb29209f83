"""Folders of cases and traces: scans that bear broken and missing files, and writers that can be run again.

A corpus is a folder per case with metadata.json, transcript.*, expected_output.json and, maybe, meeting_note.txt; traces are JSON files,
one per meeting. Files are listed and read by Spark (a partition holds files of several cases), JSON is a VARIANT: what can't be
parsed is null and counted, never an exception. A file is one value of one task, a case a few of them.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of a scan of cases.
KINDS = ("metadata", "transcript", "expected_output", "meeting_note")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a folder of this machine in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: what several steps read is computed once, and plans stay small."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _decoded(content: Column) -> Column:
    """UTF-8 without its mark; bytes that are none become replacement characters."""
    return F.regexp_replace(F.try_validate_utf8(F.decode(content, "UTF-8")), "^﻿", "")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id (the folder's name), a text column for each of KINDS (null if missing), transcript_file, metadata and expected_output
    as VARIANT (null if broken), and problem: MISSING_<kind> or BROKEN_<kind> of the first of the three that a case needs, or
    null. Of several transcripts the first by name counts; an empty file counts as missing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    name, case = F.element_at(parts, -1), F.element_at(parts, -2)
    kind = F.when(name == "metadata.json", "metadata").when(name == "expected_output.json", "expected_output").when(name == "meeting_note.txt", "meeting_note").when(name.rlike("^transcript\\..+"), "transcript")
    rows = files.select(case.alias("case_id"), name.alias("file"), kind.alias("kind"), _decoded(F.col("content")).alias("text")).where("kind is not null")
    one = rows.groupBy("case_id").agg(
        *(F.min_by("text", F.when(F.col("kind") == k, F.col("file"))).alias(k) for k in KINDS), F.min(F.when(F.col("kind") == "transcript", F.col("file"))).alias("transcript_file"),
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS[:3]),
    )
    parsed = one.withColumns({f"{k}_json": F.try_parse_json(F.col(k)) for k in ("metadata", "expected_output")})
    problem = F.coalesce(
        *(F.when(F.col(f"n_{k}") == 0, f"MISSING_{k.upper()}") for k in KINDS[:3]), F.when(F.col("transcript").isNull(), "BROKEN_TRANSCRIPT"),
        *(F.when(F.col(f"{k}_json").isNull(), f"BROKEN_{k.upper()}") for k in ("metadata", "expected_output")),
    )
    return parsed.withColumn("problem", problem).drop(*(f"n_{k}" for k in KINDS[:3]))


def traces(spark: SparkSession, path: str) -> DataFrame:
    """file, meeting_id, n_clauses, records (array of JSON texts: the list under `records`, the file itself if it is a list, else
    none) and problem: BROKEN_JSON, NO_MEETING_ID, REPEATED_CLAUSE or REPEATED_MEETING (of the files of one meeting all but the
    first by name), or null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.try_parse_json(_decoded(F.col("content"))).alias("v"))
    text = lambda p: F.try_variant_get("v", p, "string")
    ids = F.transform(F.try_variant_get("v", "$.clauses", "array<variant>"), lambda c: F.try_variant_get(c, "$.clause_id", "string"))
    items = F.coalesce(F.try_variant_get("v", "$.records", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array().cast("array<variant>"))
    rows = rows.select("file", F.col("v").isNull().alias("broken"), text("$.meeting_id").alias("meeting_id"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"), F.transform(items, lambda r: F.to_json(r)).alias("records"))
    # files are few beside their contents: the first file of each meeting comes from a grouping of names
    first = rows.where("meeting_id is not null").groupBy("meeting_id").agg(F.min("file").alias("first_file"))
    rows = rows.join(first, "meeting_id", "left")
    problem = (
        F.when(F.col("broken"), "BROKEN_JSON").when(F.coalesce("meeting_id", F.lit("")) == "", "NO_MEETING_ID").when(F.size(F.array_distinct("ids")) < F.size("ids"), "REPEATED_CLAUSE")
        .when(F.col("file") != F.col("first_file"), "REPEATED_MEETING")
    )
    return rows.select("file", "meeting_id", F.size("ids").alias("n_clauses"), "records", problem.alias("problem"))


def write_cases(rows: DataFrame, path: str) -> None:
    """A folder per case_id with its files: rows of case_id, file and text. Tasks write files themselves, so path must be a file
    system that all executors mount; a file is there as a whole or not at all, and a run that is repeated writes it over."""
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"cases can only be written to a mounted folder, not to {path}")

    def put(batches):
        for batch in batches:
            for case, file, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                folder = os.path.join(path, str(case))
                os.makedirs(folder, exist_ok=True)
                part = os.path.join(folder, f".{file}.{os.getpid()}")
                with open(part, "wb") as out:
                    out.write((text or "").encode("utf-8"))
                os.replace(part, os.path.join(folder, file))  # whole or not at all
            yield batch.slice(0, 0)

    ordered = rows.select(F.col("case_id").cast("string").alias("case_id"), "file", "text")
    ordered.mapInArrow(put, "case_id string, file string, text string").write.format("noop").mode("overwrite").save()


def write_lines(rows: DataFrame, path: str, order: list[str]) -> tuple[int, str]:
    """rows as JSON Lines, in order, and a report of them: how many, and SHA-256 over the digests of all (whatever their order)."""
    lines = rows.select(*order, F.to_json(F.struct(*rows.columns)).alias("value"))
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)
    written = rows.sparkSession.read.text(path).select(F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("d"))
    found = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("d"), F.lit(0)).cast("string").alias("digest")).select("n", F.sha2("digest", 256).alias("digest")).first()
    return int(found["n"]), found["digest"]


def committed_once(path: str):
    """A sink for `foreachBatch`: each batch is a folder of its number, written over if it comes again, so a batch that is replayed after
    a failure counts once."""
    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return commit


def committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows that batches have committed."""
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")
