import json

import pytest
from pyspark.sql import functions as F

from semweave.functions.text import clean_title, strip_text, word_count, year_from_date
from semweave.operators import text as X
from semweave.sources import papers as P
from semweave.sources import tables as TB
from tests.conftest import SF001


def test_year_from_date(spark):
    rows = [("2024-01-02",), (None,), ("",), ("abcd-1",), ("-5",), ("2024",)]
    df = spark.createDataFrame(rows, "d string")
    zero = [r[0] for r in df.select(year_from_date("d")).collect()]
    drop = [r[0] for r in df.select(year_from_date("d", null_date="drop")).collect()]
    assert zero == [2024, 0, 0, None, None, 2024]
    assert drop == [2024, None, None, None, None, 2024]


def test_unicode_strip_and_words(spark):
    df = spark.createDataFrame([(" a b\x1fc\t d\x85 ",), ("",), (None,), ("one",)], "t string")
    out = df.select(strip_text("t").alias("s"), word_count(strip_text("t")).alias("n")).collect()
    assert [r["n"] for r in out] == [4, 0, 0, 1]
    assert out[0]["s"] == "a b\x1fc\t d"
    assert out[2]["s"] == ""


def test_clean_title(spark):
    df = spark.createDataFrame([("\tA\nB  ",), (None,)], "t string")
    assert [r[0] for r in df.select(clean_title("t")).collect()] == ["A B", ""]


def test_json_lines_edge_cases(spark, tmp_path):
    lines = [
        json.dumps({"update_date": "2021-05-01", "title": "ok", "abstract": "alpha beta"}),
        "not json",
        "",
        "[1, 2]",
        json.dumps({"title": "no date", "abstract": "gamma"}),
        json.dumps({"update_date": None, "title": "null date", "abstract": "delta"}),
        json.dumps({"update_date": "", "title": "empty date", "abstract": "eps"}),
        json.dumps({"update_date": "abcd-01-01", "title": "bad", "abstract": "zeta"}),
        json.dumps({"update_date": "2024", "title": None, "abstract": "eta"}),
        json.dumps({"update_date": "2024-01-01", "title": "blank", "abstract": "   "}),
        json.dumps({"update_date": "2024-01-01", "title": "missing"}),
    ]
    path = tmp_path / "papers.jsonl"
    path.write_text("\n".join(lines) + "\n")
    raw = P.read_papers(spark, str(path))
    zero = P.clean_papers(raw, min_year=0).orderBy("abstract").collect()
    assert [r["abstract"] for r in zero] == ["alpha beta", "delta", "eps", "eta", "gamma"]
    years = {r["abstract"]: r["year"] for r in zero}
    assert years == {"alpha beta": 2021, "delta": 0, "eps": 0, "eta": 2024, "gamma": 0}
    assert {r["abstract"]: r["title"] for r in zero}["eta"] == ""
    drop = P.clean_papers(raw, min_year=0, null_date="drop").collect()
    # a typed read cannot tell a missing key from null: both are dropped here
    assert sorted(r["abstract"] for r in drop) == ["alpha beta", "eta"]
    rej = P.read_papers(spark, str(path), with_rejects=True)
    assert rej.filter("rejected").count() == 2  # "not json" and "[1, 2]"
    with pytest.raises(Exception):
        P.read_papers(spark, str(path), mode="failfast").count()


def test_eda_golden_sf0001(spark):
    papers = P.clean_papers(TB.papers_from_documents(TB.load_table(spark, SF001, "documents")))
    s = X.eda_stats(papers).first()
    assert s["total_papers"] == 200
    assert (s["len_min"], s["len_median"], s["len_max"]) == (2, 241.5, 2933)
    assert abs(s["len_mean"] - 395.235) < 1e-9
    assert (s["short_5"], s["short_10"]) == (4, 7)
    assert papers.filter(F.col("n_words") >= 200).count() == 120
    years = X.year_distribution(papers).collect()
    assert sum(r["papers"] for r in years) == 200 and years[0]["year"] == 2007


def test_length_histogram_edges(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (5,), (5,)], "n_words int")
    h = X.length_histogram(df, bins=4).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 1, 0, 2]  # as numpy.histogram; last bin closed
    same = spark.createDataFrame([(3,), (3,)], "n_words int")
    h2 = X.length_histogram(same, bins=2).orderBy("bin").collect()
    assert (h2[0]["lo"], h2[-1]["hi"]) == (2.5, 3.5)
    assert sum(r["count"] for r in h2) == 2


def test_read_papers_with_own_key(spark, tmp_path):
    path = tmp_path / "k.jsonl"
    path.write_text("\n".join([
        json.dumps({"id": 17, "update_date": "2020-01-01", "title": "a", "abstract": "x y"}),
        json.dumps({"id": 3, "update_date": "2021-01-01", "title": "b", "abstract": "z"}),
        "broken"]) + "\n")
    raw = P.read_papers(spark, str(path), id_col="id")
    got = sorted((r.paper_id, r.year, r.n_words) for r in P.clean_papers(raw).collect())
    assert got == [(3, 2021, 1), (17, 2020, 2)]
    auto = P.read_papers(spark, str(path))
    assert auto.select("paper_id").distinct().count() == 2
