"""Readers: question sets, scored JSONL (strict and lenient), cells keyed by folder name, CSV grids, JSON arrays, pages."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions.text import strip
from verdigris.operators.quality import DataQualityError
from verdigris.sources import schema as S

#: Regime, role, dataset, model and seed in a cell's folder name (a fixed value).
CELL = r"repl-(chat|default)-(train|eval)-(\w+)-(.+)-s(4[234])-\d+$"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One object per line; gzip by extension. Broken lines are an error; blank ones are skipped, or with strict an error too."""
    lines = spark.read.text(path)
    return parsed_lines(lines if strict else lines.where(~blank("value")), schema)


def blank(line: str) -> Column:
    return strip(F.col(line)) == ""


def parsed_lines(lines: DataFrame, schema: str, *keep: str) -> DataFrame:
    """lines (value) as rows of the schema, with the columns keep; a line that is no such object is an error."""
    parsed = lines.select("value", *keep, F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    message = F.when(blank("value"), F.lit("blank line")).when(F.col("r._corrupt").isNotNull(), F.concat(F.lit("not a valid object: "), F.left("value", F.lit(80))))
    # The message is part of every row's value, so the check can't be pruned away.
    return parsed.select(F.when(message.isNotNull(), F.raise_error(message).cast(parsed.schema["r"].dataType)).otherwise(F.col("r")).alias("r"), *keep).select("r.*", *keep).drop("_corrupt")


def bad_lines(spark: SparkSession, path: str, required: dict[str, type], blanks: bool = True, limit: int = 5) -> list[tuple[int, str]]:
    """(line number from 1, problem) of the first lines that are blank, no object, or lack a key or its type.

    For error reports: lines are numbered over the whole path, which reads it twice.
    """

    def problem(line: str) -> str | None:
        if not line.strip():
            return "blank line" if blanks else None
        try:
            row = json.loads(line)
        except ValueError as e:
            return f"invalid JSON: {e}"
        if not isinstance(row, dict):
            return "not an object"
        for key, kind in required.items():
            if key not in row:
                return f"missing key {key!r}"
            if not isinstance(row[key], kind) or (isinstance(row[key], bool) and kind is not bool):
                return f"{key!r} must be of type {kind.__name__}"
        return None

    # The error path is the one place for an RDD: no DataFrame source of text lines numbers them.
    lines = spark.sparkContext.textFile(path).zipWithIndex().map(lambda x: (x[1] + 1, problem(x[0]))).filter(lambda x: x[1] is not None)
    return lines.take(limit)


def read_stub(spark: SparkSession, dataset: str, paths: dict[str, str], split: str = "train") -> DataFrame:
    """The stub prompts of triviaqa, svamp or all: the small files that a dry run takes in place of a data set."""
    if dataset not in ("triviaqa", "svamp", "all"):
        raise ValueError(f"no stub for {dataset!r}")
    parts = [f(spark, paths[n], split) for n, f in (("triviaqa", read_questions), ("svamp", read_arithmetic)) if dataset in (n, "all")]
    return union_sources(*parts)


def read_questions(spark: SparkSession, path: str, split: str, dataset: str = "triviaqa", both: bool = False) -> DataFrame:
    """References are the non-empty aliases, or else the value; with both, the value and its aliases."""
    q = read_jsonl(spark, path, S.QUESTION, strict=True)
    aliases = F.filter(F.coalesce("Answer.Aliases", F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != ""))
    value = F.array("Answer.Value")
    refs = F.array_distinct(F.concat(value, aliases)) if both else F.when(F.size(aliases) > 0, aliases).otherwise(value)
    return q.select(F.col("QuestionId").alias("prompt_id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.col("Question").alias("prompt"), refs.alias("reference_answers"), F.col("Question").alias("question"), "source_index")


def read_arithmetic(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Prompt is body and question; whole answers print without a fraction."""
    q = read_jsonl(spark, path, S.ARITHMETIC, strict=True)
    a = F.col("Answer")
    answer = F.when(a == F.floor(a), a.cast("decimal(38,0)").cast("string")).otherwise(a.cast("string"))
    prompt = F.concat_ws(" ", "Body", "Question")
    return q.select(F.col("ID").alias("prompt_id"), F.lit("svamp").alias("dataset"), F.lit(split).alias("split"), prompt.alias("prompt"), F.array(answer).alias("reference_answers"), prompt.alias("question"), "source_index")


def read_biographies(spark: SparkSession, path: str, split: str = "eval") -> DataFrame:
    q = read_jsonl(spark, path, S.PROMPT)
    return q.withColumns({"dataset": F.coalesce("dataset", F.lit("bio")), "split": F.coalesce("split", F.lit(split)), "question": F.coalesce("question", "prompt"), "reference_answers": F.coalesce("reference_answers", F.array().cast("array<string>"))})


def union_sources(*parts: DataFrame, limit: int | None = None) -> DataFrame:
    """The parts one after another; limit keeps the first rows in the order of parts, files and lines."""
    if limit is None:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
    # Rows of a file keep their order within a partition, and partitions theirs: the number that Spark gives them rises with both.
    out = union_sources(*[p.withColumns({"_part": F.lit(i), "_place": F.monotonically_increasing_id()}) for i, p in enumerate(parts)])
    return out.orderBy("_part", "_place").limit(limit).drop("_part", "_place")


def read_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return read_jsonl(spark, path, S.RECORD, strict)


def with_cell_key(df: DataFrame, column: str = "_path") -> DataFrame:
    """regime, split_role, dataset_key, model_key and seed_key from the file's folder name; other folders are left out."""
    folder = F.element_at(F.split(column, "/"), -2)
    names = ("regime", "split_role", "dataset_key", "model_key", "seed_key")
    out = df.where(folder.rlike(CELL)).withColumns({n: F.regexp_extract(folder, CELL, i + 1) for i, n in enumerate(names)})
    return out.withColumn("seed_key", F.col("seed_key").cast("int"))


def read_cells(spark: SparkSession, pattern: str, schema: str = S.RECORD) -> DataFrame:
    """Records of all cells that a glob finds, with their cell key."""
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("_path")).where(~blank("value"))
    return with_cell_key(parsed_lines(lines, schema, "_path")).drop("_path")


def read_snapshot(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, sha256) of artifacts, hashed where they are read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"))


def read_csv(spark: SparkSession, path: str, schema: str = S.MEASUREMENT) -> DataFrame:
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: str, sha256: str | None = None) -> DataFrame:
    """An array of objects; with sha256, an error unless the file's bytes have that digest."""
    if sha256 is not None and [r.sha256 for r in read_snapshot(spark, path).collect()] != [sha256]:
        raise DataQualityError(f"{path} isn't the file that its digest names")
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """Topics, the first of each title in the file's order."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", "array<struct<entity: string, wikipedia_title: string, frequency_bin: string>>")).alias("pos", "t")).select("pos", "t.*")
    first = F.row_number().over(Window.partitionBy("wikipedia_title").orderBy("pos"))
    return rows.withColumn("_k", first).where("_k = 1").drop("_k")


def fetch_pages(titles: DataFrame, fetch: Callable[[str], str | None], title: str = "wikipedia_title", known: DataFrame | None = None, pause: float = 0.0) -> DataFrame:
    """titles with intro: fetch runs on executors, once per row that known (title, intro) lacks; None leaves the row out.

    pause: seconds that a task waits between two fetches.
    """
    if known is not None:
        met = titles.join(known.select(title, "intro").dropDuplicates([title]), title, "left")
        fresh = fetch_pages(met.where("intro is null").drop("intro"), fetch, title, None, pause)
        return met.where("intro is not null").unionByName(fresh)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in titles.schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = []
            for t in pdf[title]:
                found.append(fetch(t))
                time.sleep(pause)
            pdf = pdf.assign(intro=found)
            yield pdf[pdf["intro"].notna()]

    return titles.mapInPandas(run, f"{kinds}, intro string")


def intro_in_band(df: DataFrame, low: int = 200, high: int = 2000) -> DataFrame:
    return df.where(F.length(strip(F.col("intro"))).between(low, high))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise DataQualityError(f"missing columns: {', '.join(missing)}")
    return df
