"""Whole rows that pass without a join, one row of each group of copies, pairs that meet once."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from emberlog.llm import common, exact_dedup, minhash, packing  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_that_no_decision_names_are_not_shuffled(spark, tmp_path):
    rows = [(k, f"words of text number {k}" + " password = Kq92LmPx0z" * (k == 3), "en", "a", 9) for k in range(12)] + [(12, "12 34", "en", "a", 5), (None, None, "en", "a", None)]
    docs = common.materialise(spark.createDataFrame(rows, SCHEMA), "docs")
    mark = common.written_so_far()
    kept = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert "Join" not in plan(kept) and common.written_so_far() == mark
    assert sorted(map(tuple, kept.collect())) == sorted(rows[:12])
    for stage in (corpus_pipeline.exact, corpus_pipeline.secret):
        assert plan(stage(spark, docs, str(tmp_path))).startswith("Union"), stage


@pytest.mark.parametrize("hash_bytes", [16, 1])
def test_one_of_each(spark, hash_bytes):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "A b", "a b", "a  b", "\u00c4 b", "\u00e4 b", *map(str, range(300))]), rng.choice(["en", None]), "s", rng.randrange(3)) for _ in range(600)]
    rows += [rows[0], rows[1]]
    groups = {}
    for r in rows:
        groups.setdefault("".join(c.lower() if c.isascii() else c for c in r[1] or ""), []).append(r)
    order = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    want = sorted((max(g, key=order) for g in groups.values()), key=str)
    docs = common.materialise(spark.createDataFrame(rows, SCHEMA), "docs")
    got = sorted(map(tuple, exact_dedup.one_of_each(docs, hash_bytes=hash_bytes).collect()), key=str)
    assert got == want


def test_parted(spark):
    docs = common.materialise(spark.range(5000).withColumnRenamed("id", "k"), "docs")
    keys = common.materialise(docs.where("k % 7 = 0"), "keys")
    named, others = common.parted(docs, "k", common.key_bitmap(keys, "k", written=True))
    a, b = {r[0] for r in named.collect()}, {r[0] for r in others.collect()}
    assert a | b == set(range(5000)) and not a & b and a >= set(range(0, 5000, 7)) and len(a) < 1000
    empty = common.key_bitmap(keys.where("k < 0"), "k")
    assert [x.count() for x in common.parted(docs, "k", empty)] == [0, 5000]


def test_rare_pairs_meet_once(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(40):
        own = list(base)
        own[rng.randrange(60)], own[rng.randrange(60)] = rng.choice("xyz"), rng.choice("uv")
        texts.append((k, " ".join(own)))
    docs = common.materialise(spark.createDataFrame(texts, "id long, text string"), "docs")
    crowded = common.materialise(spark.createDataFrame([(k, 0 if k % 4 == 0 else k) for k in range(40)], "rep long, comp long"), "crowded")
    met = [tuple(r) for r in minhash.rare_meetings(crowded, docs, 5, 80, "id", "text").collect()]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for _, t in texts]
    close = {(a, b) for a in range(40) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and not (a % 4 == 0 and b % 4 == 0)}
    assert close and close <= set(met) and len(met) == len(set(met))


def test_a_store_that_ends_with_its_task_gives_the_same_pieces(spark):
    from emberlog.llm.queries import PACK_TOKENIZER

    docs = spark.createDataFrame([(k, f"Some words, number {k % 5}. " * k) for k in range(30)], "doc_id long, text string")
    kept, ended = (sorted(map(tuple, packing.tokenise(docs, PACK_TOKENIZER, store_bytes=b, keep_store=keep).collect())) for b, keep in ((packing.STORE_BYTES, True), (2000, False)))
    assert kept == ended and len(kept) == 30
