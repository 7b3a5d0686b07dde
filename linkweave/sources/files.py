"""Scans of per-paper files and tables of strings. Lists of files are resolved on the driver, contents by the executors."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from linkweave.functions import paper_ids
from linkweave.functions.text import normalize_chars
from linkweave.functions.urls import url_set
from linkweave.operators.scoring import mllm_rows
from linkweave.session import filled


def read_strings(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """CSV in which every column is a string and an empty cell an empty string; a missing required column is an error."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False)
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    df = reader.csv(path)
    lack = [c for c in required if c not in df.columns]
    if lack:
        raise ValueError(f"{path}: missing {', '.join(lack)}; found {', '.join(df.columns)}")
    return df.fillna("")


def with_ix(df: DataFrame) -> DataFrame:
    """With ``ix``, a row number that follows the sorted paths of the files and the order of rows within one, however files are packed into tasks.

    ``df`` is a scan of files that aren't split, as CSV of several lines a row is. The list of paths is the driver's, as in any scan.
    """
    ranks = df.sparkSession.createDataFrame([(p, k) for k, p in enumerate(sorted(df.inputFiles()))], "_path string, _rank long")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    at = df.withColumn("_path", F.input_file_name()).withColumn("_row", row)
    return at.join(F.broadcast(ranks), "_path", "left").withColumn("ix", F.coalesce("_rank", F.lit(0)) * F.lit(1 << 33) + F.col("_row")).drop("_path", "_row", "_rank")


def read_located(spark: SparkSession, path: str) -> DataFrame:
    """Gold or predictions with context: ``paper_id, target, url, location`` are required."""
    return with_ix(read_strings(spark, path, required=("paper_id", "target", "url", "location")))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """Addresses only: the first of ``url, url_raw, url_norm`` that there is, as ``url``."""
    df = read_strings(spark, path, required=("paper_id",))
    col = next((c for c in ("url", "url_raw", "url_norm") if c in df.columns), None)
    if col is None:
        raise ValueError(f"{path}: no column url, url_raw or url_norm")
    return df.select("paper_id", F.col(col).alias("url"))


def read_gold_dir(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*-gold.csv`` of a folder: rows of the test split with a label."""
    df = with_ix(read_strings(spark, f"{folder}/*-gold.csv", required=("paper_id", "url", "Label", "split")))
    return df.filter((F.trim("split") == "test") & (F.trim("Label") != "")).withColumnRenamed("Label", "label")


def read_predictions(spark: SparkSession, folders: list[str]) -> DataFrame:
    """All ``*_all_predictions.csv`` but gold ones, with ``pipeline``, the start of the file's name, and the ``url`` to score.

    A false positive is scored by the output's address, any other by the gold one; the normalised form stands in for an empty one.
    """
    df = with_ix(read_strings(spark, [f"{f}/*_all_predictions.csv" for f in folders])).withColumn("_file", F.regexp_extract(F.input_file_name(), r"([^/]*_all_predictions\.csv)", 1))
    df = df.filter(~F.col("_file").endswith("_gold_all_predictions.csv")).withColumn("pipeline", F.regexp_replace("_file", "_all_predictions\\.csv$", ""))
    pick = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    url = F.when(F.col("match_rule") == "genuine_fp", pick("url_output", "url_output_norm")).otherwise(pick("url_gold", "url_gold_norm"))
    return df.withColumn("url", url).withColumnsRenamed({"pred_label_name": "pred_label", "gold_label_name": "gold_label"}).drop("_file")


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    """The accepted set: ``paper_id, url, target_norm``, addresses from the field only."""
    rows = mllm_rows(with_ix(read_strings(spark, path)), "gold", False)
    return rows.select("paper_id", F.explode("urls").alias("url"), "target_norm").distinct()


def _file_columns(df: DataFrame, content: str) -> DataFrame:
    return df.select(F.col("path").alias("file"), paper_ids.from_file(F.col("path")).alias("paper_id"), F.decode(F.col("content"), "UTF-8").alias(content))


def read_binary(spark: SparkSession, path: str, pattern: str, recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)


def find_pdfs(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``file, paper_id, length`` of PDF files, without reading them."""
    d = read_binary(spark, path, "*.pdf", recursive)
    return d.select(F.col("path").alias("file"), paper_ids.from_file(F.col("path")).alias("paper_id"), "length")


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for content in b["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                out += [(n, z.read(n).decode("utf-8", "replace")) for n in sorted(z.namelist()) if n.lower().endswith(".md")]
        yield pd.DataFrame(out, columns=["file", "text"])


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``paper_id, file, text`` of a folder of Markdown files, one file, or a zip of them; characters normalised."""
    if path.lower().endswith(".zip"):
        raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(filled(_unzip), "file string, text string")
        raw = raw.withColumn("paper_id", paper_ids.from_file(F.col("file")))
    else:
        raw = _file_columns(read_binary(spark, path, "*.md"), "text")
    return raw.select("paper_id", "file", normalize_chars(F.col("text")).alias("text"))


def read_layout_text(spark: SparkSession, path: str) -> DataFrame:
    """``paper_id, file, text`` of flat layout texts."""
    d = _file_columns(read_binary(spark, path, "*.txt", recursive=False), "text")
    return d.withColumn("paper_id", F.regexp_replace("paper_id", r"\.layout$", ""))


_SPANS = "array<struct<text:string,size:double,bbox:array<double>>>"
LAYOUT = (
    "toc array<array<string>>, page_count int, pages array<struct<page_number:int,height:double,"
    f"boxes:array<struct<boxclass:string,x0:double,y0:double,x1:double,y1:double,textlines:array<struct<spans:{_SPANS}>>>>,"
    "fulltext:array<struct<type:int,bbox:array<double>,lines:array<struct<spans:array<struct<text:string>>>>>>,"
    "links:array<struct<kind:int,uri:string,`from`:array<double>>>>>"
)


def read_layout_json(spark: SparkSession, path: str) -> DataFrame:
    """``paper_id, file, page, toc, page_count, p`` (a page's struct) of layout JSON: one file a page, ``<paper>_<nn>.json``, or a folder a
    paper. Files that don't parse give nothing."""
    d = spark.read.schema(LAYOUT + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    d = d.withColumn("file", F.col("_metadata.file_path")).filter("pages is not null")
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.json$", "")
    paper = F.when(stem.rlike(r"_\d+$"), F.regexp_replace(stem, r"_\d+$", "")).otherwise(F.element_at(F.split("file", "/"), -2))
    d = d.withColumn("paper_id", paper).select("paper_id", "file", "toc", "page_count", F.explode("pages").alias("p"))
    return d.select("paper_id", "file", F.col("p.page_number").alias("page"), "toc", "page_count", "p")


# --- sinks ---


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The given fields in order, empty where a row has none, with a header."""
    have = set(df.columns)
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in fields]
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object a line; nulls stay."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_by_paper(df: DataFrame, path: str, paper: str = "paper_id") -> None:
    """A folder of JSON lines for each paper."""
    df.withColumn("_p", F.col(paper)).repartition("_p").write.mode("overwrite").partitionBy("_p").option("ignoreNullFields", False).json(path)


def url_keys_of(df: DataFrame) -> DataFrame:
    """``paper_id, url`` (canonical, distinct) of a table of strings."""
    return df.select(paper_ids.exact(F.col("paper_id")).alias("paper_id"), F.explode(url_set(F.col("url"))).alias("url")).distinct()
