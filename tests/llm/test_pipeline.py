"""The pipeline against a chain of plain steps."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    rows = [(1, text, "en", "a", 9), (2, text, "en", "b", 9), (3, text + " more", "en", "c", 9), (4, None, None, None, None), (5, "12 34", "en", "a", 5), (6, "a quite different text password = Kq92LmPx0z", "en", "a", 9), (7, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append(sorted(r["doc_id"] for r in docs.collect()))
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS), name
        if k == 3:
            masked = {r["doc_id"]: r for r in docs.collect()}[6]
            assert masked["text"] == "a quite different text [secret]" and masked["n_chars"] == len(masked["text"])
    assert seen == [[1, 2, 3, 6], [2, 3, 6], [2, 6], [2, 6], [2, 6]]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2


def test_null_and_repeated_ids(spark, tmp_path):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    clean, live = "nothing of note in a clean text", "here a password = Kq92LmPx0z of someone"
    rows = [(None, base, "en", "a", 9), (1, base, "en", "a", 9), (1, base, "en", "a", 9), (None, base + " more", "en", "a", 9), (None, "quite another text without an id", "en", "a", 9), (7, live, "en", "a", 9), (7, clean, "en", "a", 9), (8, "12 34", "en", "a", 9), (8, "words that share an id with numbers", "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), "stage")
        seen.append({(r["doc_id"], r["text"]) for r in docs.collect()})
        assert docs.count() == (8 if len(seen) == 1 else len(seen[-1]))
    alone = {(None, "quite another text without an id"), (7, clean), (8, "words that share an id with numbers")}
    assert seen[0] == {(r[0], r[1]) for r in rows} - {(8, "12 34")}
    assert seen[1] == alone | {(1, base), (None, base + " more"), (7, live)}
    assert seen[2] == alone | {(1, base), (7, live)}
    assert seen[3] == alone | {(1, base), (7, "here a [secret] of someone")}


def test_stages_leave_their_rows_and_decisions_only(spark, tmp_path):
    from emberlog.llm import common

    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    rows = [(k, text + f" {k}" * (k % 3) + " password = Kq92LmPx0z" * (k % 2), "en", "a", 9) for k in range(12)]
    docs = corpus_pipeline.materialise(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    for name, stage in corpus_pipeline.STAGES[:4]:
        mark = common.written_so_far()
        out = stage(spark, docs, str(tmp_path))
        assert common.written_so_far() - mark <= 2, name
        docs = corpus_pipeline.materialise(out, "stage")
        assert docs.count() > 0
