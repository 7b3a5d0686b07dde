"""Files in, files out, and streams that don't read a file twice."""

import zipfile

from pyspark.sql import functions as F

from linkweave.sources import files
from linkweave.streaming import incremental


def test_csv(spark, tmp_path):
    (tmp_path / "a-gold.csv").write_text('file,paper_id,preceding,target,trailing,url,Label,location,split\nf,PMC1,,"A, ""b""",,"x.org/1 and y.org/2",0,footnote,test\nf,PMC1,,c,,,3,footnote,train\n')
    g = files.read_gold_dir(spark, str(tmp_path)).collect()
    assert len(g) == 1 and g[0]["target"] == 'A, "b"' and g[0]["preceding"] == "" and g[0]["label"] == "0"
    (tmp_path / "X_all_predictions.csv").write_text("paper_id,pred_label_name,gold_label_name,match_rule,url_output,url_output_norm,url_gold,url_gold_norm\nPMC1,project,project,genuine_fp,o.org,,g.org,\nPMC1,project,project,exact,o.org,,,gn.org\n")
    (tmp_path / "X_gold_all_predictions.csv").write_text("paper_id\nz\n")
    p = files.read_predictions(spark, [str(tmp_path)]).collect()
    assert sorted((r["pipeline"], r["url"]) for r in p) == [("X", "gn.org"), ("X", "o.org")]
    try:
        files.read_strings(spark, str(tmp_path / "a-gold.csv"), required=("nope",))
        raise AssertionError
    except ValueError:
        pass


def test_markdown_and_zip(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "P1.md").write_text("ﬁne\r\n")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/P2.md", "text")
        z.writestr("in/skip.txt", "no")
    assert [(r["paper_id"], r["text"]) for r in files.read_markdown(spark, str(tmp_path / "d")).collect()] == [("P1", "fine\n")]
    assert [(r["paper_id"], r["text"]) for r in files.read_markdown(spark, str(tmp_path / "z.zip")).collect()] == [("P2", "text")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", 'a "q", b', None)], "paper_id string, target string, trailing string")
    files.write_csv(df, str(tmp_path / "c"), ["paper_id", "target", "url"])
    assert [tuple(r) for r in files.read_strings(spark, str(tmp_path / "c")).collect()] == [("p", 'a "q", b', "")]
    files.write_jsonl(df, str(tmp_path / "j"))
    assert '"trailing":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    files.write_by_paper(df, str(tmp_path / "b"))
    assert (tmp_path / "b" / "_p=p").exists()


def test_stream_reads_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    (src / "A.md").write_text("one")

    def run():
        q = incremental.ingest(incremental.markdown_stream(spark, str(src)), lambda d: d.select("paper_id", "text"), str(out), str(ck))
        q.awaitTermination()
        return sorted(tuple(r)[:2] for r in spark.read.parquet(str(out)).select("paper_id", "text").collect())

    assert run() == [("A", "one")]
    assert run() == [("A", "one")]
    (src / "B.md").write_text("two")
    assert run() == [("A", "one"), ("B", "two")]


def test_latest_and_pending(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "d", 1)], "id int, v string, t int")
    assert sorted((r["id"], r["v"]) for r in incremental.latest(df, ["id"], "t").collect()) == [(1, "b"), (2, "d")]
    done = spark.createDataFrame([("x",)], "file string")
    assert [r["file"] for r in incremental.pending(done.union(done.select(F.lit("y"))), done).collect()] == ["y"]
