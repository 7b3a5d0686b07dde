"""Output of multimodal models: schemas, flattening, prompts as columns, and the batched call itself, whose client is injected."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import paper_ids
from linkweave.functions.text import first_filled
from linkweave.sources.files import read_binary
from linkweave.session import filled

# The payloads' types. Enumerations are plain strings, checked by ``valid``.
BODY = "items array<struct<url_printed:string,target_sentence:string,preceding_sentence:string,trailing_sentence:string,at_paragraph_start:boolean,at_paragraph_end:boolean,url_lines_joined:boolean,url_span_pages:boolean,confidence:double>>"
NOTES_FOUND = "footnotes array<struct<footnote_marker:string,footnote_content:string,urls:array<string>,y_ratio:double,confidence:double>>"
NOTES_RESTORED = "items array<struct<footnote_marker:string,original_sentence:string,restored_sentence:string,preceding_sentence:string,trailing_sentence:string,confidence:double>>"
ENTRIES = "references array<struct<index:string,full_text:string,urls:array<string>,citation_keys:array<string>,confidence:double>>"
CITATIONS = "citations array<struct<marker:string,style:string,snippet:string,confidence:double>>"
RESTORED = "items array<struct<marker:string,original_sentence:string,restored_sentence:string,preceding_sentence:string,trailing_sentence:string,confidence:double>>"
ROLES = "pages array<struct<page:int,role:string,confidence:double>>"
ROLE_NAMES = ("body", "mixed", "references", "other")

ITEM = (
    "pdf_file string, restored_sentence string, target_sentence string, original_sentence string, target string, preceding_sentence string, preceding string,"
    " trailing_sentence string, trailing string, url string, url_printed string, urls string"
)
FIELDS = ("paper_id", "location", "target", "preceding", "trailing", "url")


def items_of(payload: Column) -> Column:
    """The items of a file: a list, or an object's ``items``; each with the object's ``pdf_file`` where it has none."""
    item = "array<struct<" + ",".join(f"{a}:{b}" for a, b in (x.split() for x in ITEM.split(", "))) + ">>"
    listed = F.from_json(payload, item)
    wrapped = F.from_json(payload, f"pdf_file string, items {item}")
    return F.when(F.trim(payload).startswith("["), F.transform(listed, lambda i: F.struct(i["pdf_file"].alias("file"), i.alias("i")))).otherwise(F.transform(wrapped["items"], lambda i: F.struct(F.coalesce(i["pdf_file"], wrapped["pdf_file"]).alias("file"), i.alias("i"))))


def url_field(c: Column) -> Column:
    """A list of addresses (as JSON text) or one, as ``a | b``, without quotes and brackets."""
    listed = F.filter(F.transform(F.from_json(c, "array<string>"), lambda u: F.regexp_replace(F.trim(u), r"^[\"']+|[\"']+$", "")), lambda u: u != "")
    one = F.regexp_replace(F.regexp_replace(F.trim(c), r"^\[|\]$", ""), r"^[\"']+|[\"']+$", "")
    return F.when(c.rlike(r"^\s*\[\s*\""), F.array_join(listed, " | ")).when(F.trim(c) == "[]", F.lit("")).otherwise(F.trim(one))


def flatten(files: DataFrame, location: str) -> DataFrame:
    """The six columns of the flat table, from ``file, payload``."""
    d = files.select("file", F.explode(items_of(F.col("payload"))).alias("x"))
    i = lambda k: F.coalesce(F.col(f"x.i.{k}"), F.lit(""))
    pid = paper_ids.from_file(F.coalesce(F.nullif(F.trim("x.file"), F.lit("")), F.col("file")))
    pid = F.regexp_replace(pid, r"(?:_body_urls|\.url_footnotes|\.url_references|_footnotes|_references)$", "")
    return d.select(pid.alias("paper_id"), F.lit(location).alias("location"), first_filled(i("restored_sentence"), i("target_sentence"), i("original_sentence"), i("target")).alias("target"), first_filled(i("preceding_sentence"), i("preceding")).alias("preceding"), first_filled(i("trailing_sentence"), i("trailing")).alias("trailing"), url_field(first_filled(i("url"), i("url_printed"), i("urls"))).alias("url"))


def read_items(spark: SparkSession, path: str, location: str) -> DataFrame:
    files = read_binary(spark, path, "*.json").select(F.col("path").alias("file"), F.decode(F.col("content"), "UTF-8").alias("payload"))
    return flatten(files, location)


def own_pages(items: DataFrame) -> DataFrame:
    """Of an address that several pages of a pdf gave, the pages whose text holds it; all where none does. ``pdf, page, url, page_text``."""
    from pyspark.sql import Window

    from linkweave.functions.text import squash
    from linkweave.functions.urls import in_page

    w = Window.partitionBy("pdf", squash(F.col("url")))
    d = items.withColumn("_own", F.coalesce(in_page(F.col("url"), F.col("page_text")), F.lit(False)))
    return d.withColumn("_any", F.max("_own").over(w)).filter("_own or not _any").drop("_own", "_any")


def prompt(template: str, **fields: Column) -> Column:
    """A template with ``{name}`` replaced by the row's fields; null is empty."""
    out = F.lit(template)
    for k, v in fields.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


#: Characters of a page's text layer that go into a prompt.
TEXT_LAYER = 3000


def text_section(text: Column, title: str = "TEXT LAYER") -> Column:
    """The beginning of a text layer as a section of a prompt; nothing where there is none."""
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(F.lit(f"\n{title}:\n---\n"), F.substring(text, 1, TEXT_LAYER), F.lit("\n---\n")))


def clip(width: Column, height: Column, part: str, share: float | Column) -> Column:
    """``x0, y0, x1, y1`` of the top of a page up to ``share`` of its height, or of the bottom from there on."""
    at = height * (F.lit(share) if isinstance(share, float) else share)
    top = part == "top"
    return F.struct(F.lit(0.0).alias("x0"), (F.lit(0.0) if top else at).alias("y0"), width.alias("x1"), (at if top else height).alias("y1"))


def with_neighbours(pages: DataFrame, *cols: str) -> DataFrame:
    """The previous and next page's columns as ``prev_*`` and ``next_*``."""
    from pyspark.sql import Window

    w = Window.partitionBy("pdf").orderBy("page")
    for c in cols:
        pages = pages.withColumn(f"prev_{c}", F.lag(c).over(w)).withColumn(f"next_{c}", F.lead(c).over(w))
    return pages


def page_batches(pages: DataFrame, size: int = 6) -> DataFrame:
    """``pdf, batch, pages``: pages in groups of ``size``, in order."""
    b = F.floor((F.col("page") - 1) / F.lit(size)).cast("int")
    return pages.groupBy("pdf", b.alias("batch")).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))


def call_model(df: DataFrame, client: Callable[[str], str], tries: int = 3, parallelism: int | None = None, pause: float = 0.0) -> DataFrame:
    """Rows with ``prompt`` sent to an injected ``client``; ``answer`` is JSON text, an empty object after ``tries`` failures, ``error`` says why.

    Failures stay with their row. ``parallelism`` bounds the tasks, and so the calls, at a time; ``pause`` seconds pass after every call. How long a call may
    take is the client's to bound.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, errors = [], []
            for p in b["prompt"]:
                answer, error = "{}", None
                for _ in range(tries):
                    try:
                        answer = client(p)
                        json.loads(answer)
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001
                        answer, error = "{}", f"{type(e).__name__}: {e}"
                    finally:
                        if pause:
                            time.sleep(pause)
                answers.append(answer)
                errors.append(error)
            yield b.assign(answer=answers, error=errors)

    d = df.repartition(parallelism) if parallelism else df
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", answer string, error string"
    return d.mapInPandas(filled(run), schema)


def two_steps(df: DataFrame, detect: Callable[[str], str], extract: Callable[[str], str], found: str, next_prompt: Callable[[DataFrame], Column]) -> DataFrame:
    """A detecting call, and an extracting one only for rows in which it found something (``found``: its payload's schema, one array)."""
    field = found.split()[0]
    one = call_model(df, detect).withColumn("found", F.from_json("answer", found)[field]).filter(F.size("found") > 0).drop("answer", "error", "prompt")
    return call_model(one.withColumn("prompt", next_prompt(one)), extract)


def valid(role: Column, confidence: Column) -> Column:
    return role.isin(*ROLE_NAMES) & confidence.between(0.0, 1.0)
