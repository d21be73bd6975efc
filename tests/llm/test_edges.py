"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from semweave.llm import (
    decontamination,
    language_model,
    licenses,
    line_dedup,
    mixing,
    near_dedup,
    ranking,
    repetition,
    token_counts,
    wrapper,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(40_000))
ROWS = [
    (1, "one two three four five six seven", "en", "a", 10),
    (2, "one two three four five six seven", "en", None, 10),  # tie with 1
    (3, None, None, "a", None),
    (4, "", "en", "", 0),
    (5, " \n\t ", "en", "b", 4),
    (None, "a text without an id", "en", "b", 20),
    (6, LONG, "de", "a", len(LONG)),
    (7, "short", None, "c", 5),
    (7, "short", None, "c", 5),  # repeated row
]
CLASH = ["id", "n", "c", "kept", "component_id", "w", "x", "y", "part", "block", "slot", "position", "share", "key",
         "n_words", "score", "rank", "line", "doc", "held", "host", "src", "_metadata"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, None), (6, 1, 1), (6, 0, 0), (None, 1, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, ""), (None, "x y")],
                                 "item_id long, text string")


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def operators(labels, bench, model):
    return {
        "near_dedup": near_dedup.near_duplicates,
        "language_model": language_model.score_documents,
        "repetition": repetition.quality_rules,
        "mixing": mixing.mix_sources,
        "line_dedup": line_dedup.line_dedup,
        "ranking": lambda d: ranking.quality_scores(d, labels),
        "decontamination": lambda d: decontamination.decontaminate(d, bench),
        "licenses": licenses.scan,
        "token_counts": lambda d: token_counts.token_counts(d, model),
    }


NAMES = ["near_dedup", "language_model", "repetition", "mixing", "line_dedup", "ranking", "decontamination",
         "licenses", "token_counts"]


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_row(docs, labels, bench, model, name):
    out = operators(labels, bench, model)[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_change_nothing(docs, labels, bench, model, name):
    op = operators(labels, bench, model)[name]
    plain, clash = op(docs), op(clashing(docs))
    cols = [c for c in plain.columns if c not in CLASH or name not in ("line_dedup",)]
    key = lambda rows: sorted(map(repr, (tuple(r[c] for c in cols) for r in rows)))
    assert key(plain.select(cols).collect()) == key(clash.select(cols).collect())


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, labels, bench, model, name):
    assert operators(labels, bench, model)[name](spark.createDataFrame([], DOCS)).count() == 0


def test_near_dedup_values(docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in
           near_dedup.near_duplicates(docs).collect()}
    assert {(1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (7, 1, 7, True)} <= got
    assert (None, 1, None, True) in got


def test_decontamination_values(docs, bench):
    got = {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in decontamination.decontaminate(docs, bench).collect()}
    assert got[1] == got[2] == (True, 1)
    assert not any(got[k][0] for k in (3, 4, 5, 6, 7, None))
    none = decontamination.decontaminate(docs, bench.where("false"))
    assert none.where("contaminated").count() == 0 and none.count() == len(ROWS)


def test_ranking_without_both_labels(docs, labels):
    out = ranking.quality_scores(docs, labels.where("false")).collect()
    assert {r["score"] for r in out} == {0.5}


def test_pages(spark):
    rows = [(1, "http://h.example/1", "<html><body><p>a &amp; b</p><p>c\n d</p><nav>menu</nav></body></html>"),
            (2, None, "<p>no host</p>"), (3, "http://h.example/2", None), (4, "http://h.example/3", ""),
            (None, "http://h.example/4", "<article><h1>t</h1><p>x<br>y</p><div class='ad'>buy</div></article>"),
            (5, "::", "<p>open <b>bold<p>next < 3 <script>var x='</p>'</script>"),
            (6, "http://h.example/6", "<p>" + "long " * 30_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrapper.extract(clashing(df)).collect()}
    assert got[1] == "a & b\n\nc d" and got[2] == "no host" and got[3] == got[4] == ""
    assert got[None] == "t\n\nx y" and got[5] == "open bold\n\nnext < 3"
    assert got[6] == ("long " * 30_000).strip()
    assert wrapper.extract(df.where("false")).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, bench, tmp_path, k):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = corpus_pipeline.STAGES[k][1]
    extra = docs.withColumn("kept", F.lit("clash")).withColumn("slot_", F.lit(1))
    out = stage(spark, extra, str(tmp_path))
    assert out.count() <= len(ROWS)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == extra.columns
    assert stage(spark, extra.where("false"), str(tmp_path)).count() == 0
