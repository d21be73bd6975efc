"""Values of the pipeline's stages on odd rows: nulls, empty texts, short repeats, shared ids."""

import corpus_pipeline as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in texts], DOCS)


def test_line_stage_takes_short_repeats_and_drops_what_it_empties(spark, tmp_path):
    docs = rows(spark, [(1, "Menu\nfirst text here\nHome"), (2, "Menu\nsecond text\nHome"), (3, "Menu\nHome"),
                        (4, None), (5, ""), (6, " \n"), (None, "Menu\nno id"), (7, "own\nown\nown line"), (8, "Home")])
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in P.line_stage(spark, docs, str(tmp_path)).collect()}
    assert got == {(1, "Menu\nfirst text here\nHome", 25), (2, "second text", 11), (4, None, 0), (5, "", 0), (6, " \n", 2),
                   (None, "Menu\nno id", 10), (7, "own\nown line", 12)}


def test_filtering_stages_keep_and_drop_by_id(spark, tmp_path):
    clean = " ".join(f"word{k}" for k in range(60))
    bad = "again and again " * 40
    docs = rows(spark, [(1, clean), (2, bad), (3, None), (4, ""), (5, "too short"), (None, clean), (6, clean + " more"), (6, bad)])
    got = sorted((r["doc_id"], r["text"]) for r in P.quality_stage(spark, docs, str(tmp_path)).collect())
    assert got == sorted([(1, clean), (6, clean + " more"), (6, bad)])
    left = sorted((r["doc_id"], r["text"] or "") for r in P.near_dedup_stage(
        spark, rows(spark, [(9, clean), (1, clean), (4, ""), (5, None), (2, clean + " end")]), str(tmp_path)).collect())
    assert left == [(1, clean), (4, ""), (5, "")]
