"""Converters of PDF files: a contract for services that aren't part of this package (TEI service, layout, OCR, rasters), and how they are called."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.session import filled


class Converter(Protocol):
    """Turns the bytes of a PDF into text (TEI XML, layout JSON, Markdown). Raises ``Transient`` for what may pass, anything else for what won't."""

    def __call__(self, name: str, content: bytes) -> str: ...


class Rasterizer(Protocol):
    """PNG of a page (from 1) or of its clip ``(x0, y0, x1, y1)`` in points, and the text layer there."""

    def render(self, content: bytes, page: int, dpi: int, clip: tuple[float, float, float, float] | None = None) -> bytes: ...

    def text(self, content: bytes, page: int, clip: tuple[float, float, float, float] | None = None) -> str: ...


class Transient(Exception):
    """A failure that may pass: a service that is busy or restarting."""


def valid_tei(text: str | None) -> bool:
    head = (text or "")[:500].lower()
    return len(text or "") >= 200 and ("<tei" in head or "<?xml" in head)


def convert(pdfs: DataFrame, converter: Converter, tries: int = 3, pause: float = 5.0, parallelism: int | None = None, valid: Callable[[str | None], bool] = valid_tei) -> DataFrame:
    """``file, output, error`` of PDFs ``file, content``; ``parallelism`` bounds the calls at a time.

    Transient failures are tried again after ``pause``, twice as long each time; others, and output that isn't ``valid``, fail at once and stay with their row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            outputs, errors = [], []
            for name, content in zip(b["file"], b["content"]):
                output, error = None, None
                for k in range(tries):
                    try:
                        output, error = converter(name, bytes(content)), None
                        if not valid(output):
                            output, error = None, "no valid output"
                        break
                    except Transient as e:
                        error = f"transient: {e}"
                        if k + 1 < tries:
                            time.sleep(pause * 2**k)
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                        break
                outputs.append(output)
                errors.append(error)
            yield pd.DataFrame({"file": b["file"], "output": pd.Series(outputs, dtype="object"), "error": pd.Series(errors, dtype="object")})

    d = pdfs.select("file", "content")
    return (d.repartition(parallelism) if parallelism else d).mapInPandas(filled(run), "file string, output string, error string")


def unconverted(pdfs: DataFrame, done: DataFrame) -> DataFrame:
    """The PDFs without a valid output in ``done`` (``file, output``)."""
    return pdfs.join(done.filter(F.col("output").isNotNull()).select("file").distinct(), "file", "left_anti")
