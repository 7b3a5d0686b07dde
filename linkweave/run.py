"""Entry point: scan, extraction and sinks of a dialect.

    python -m linkweave.run --dialect tei --input FOLDER --output FOLDER [--modules body footnote reference] [--by-paper]

Every module writes its items as JSON lines, a summary by paper and one of the corpus; with ``--by-paper`` also a folder for each paper. A module that fails
doesn't stop the others; its error is in what ``run`` returns.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators import extract_layout, extract_markdown, extract_tei
from linkweave.operators.scoring import run_summary
from linkweave.session import cut, get_session
from linkweave.sources import files, tei

MODULES: dict[str, dict[str, tuple[Callable[[SparkSession, str], DataFrame], Callable[[DataFrame], DataFrame]]]] = {
    "tei": {"body": (tei.read_tei, extract_tei.body), "footnote": (tei.read_tei, extract_tei.footnotes), "reference": (tei.read_tei, extract_tei.references)},
    "layout": {"body": (files.read_layout_text, extract_layout.body), "footnote": (files.read_layout_json, extract_layout.footnotes), "reference": (files.read_layout_json, extract_layout.references)},
    "markdown": {"body": (files.read_markdown, extract_markdown.body), "footnote": (files.read_markdown, lambda d: extract_markdown.restored_footnotes(d)[0]), "reference": (files.read_markdown, extract_markdown.restored_references)},
}


def run(spark: SparkSession, dialect: str, source: str, out: str, modules: tuple[str, ...] = ("body", "footnote", "reference"), by_paper: bool = False) -> dict[str, dict]:
    """The totals of each module, or its error."""
    done: dict[str, dict] = {}
    for name in modules:
        read, extract = MODULES[dialect][name]
        try:
            scanned = read(spark, source)
            items = cut(extract(scanned), f"{dialect}-{name}")
            url = F.col("url") if "url" in items.columns else F.explode_outer("urls")
            per, totals = run_summary(items.select("paper_id", url.alias("url")), scanned)
            files.write_jsonl(items, f"{out}/{name}/items")
            if by_paper:
                files.write_by_paper(items, f"{out}/{name}/papers")
            files.write_jsonl(per, f"{out}/{name}/summary")
            done[name] = totals.first().asDict()
            files.write_jsonl(totals.withColumns({"dialect": F.lit(dialect), "location": F.lit(name), "input": F.lit(source)}), f"{out}/{name}/run_summary")
        except Exception as e:  # noqa: BLE001
            done[name] = {"error": f"{type(e).__name__}: {e}"}
    return done


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--dialect", choices=list(MODULES), required=True)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--modules", nargs="+", choices=["body", "footnote", "reference"], default=["body", "footnote", "reference"])
    p.add_argument("--by-paper", action="store_true")
    a = p.parse_args()
    spark = SparkSession.getActiveSession() or get_session()
    for name, totals in run(spark, a.dialect, a.input, a.output, tuple(a.modules), a.by_paper).items():
        print(name, totals)


if __name__ == "__main__":
    main()
