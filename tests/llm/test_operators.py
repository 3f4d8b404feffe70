"""Corpus operators against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

import collections
import functools
import hashlib
import math
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from emberlog.llm import ann, chunks, exact_dedup, graph, kernels, langid, line_dedup, lm, minhash, packing, pieces, secrets, suffix

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, text_a string, block int, place int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, f"src{(i or 0) % 5}", len(t or ""), "clash", "clash", "clash", 1, 2) for i, t, lang in rows], SCHEMA)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = {"en": "the of and house water light stone green river bird".split(), "fr": "le de et maison eau lumière pierre vert rivière oiseau".split()}
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "fr"
        words = [rng.choice(vocabulary[lang]) + rng.choice(["", "", "s", ",", ".\n"]) for _ in range(rng.randint(1, 120))]
        rows.append((i, " ".join(words), lang))
    rows += [(100 + k, rows[7][1], "en") for k in range(5)] + [(110, rows[7][1].upper(), "en"), (111, rows[8][1] + " tail", "en"), (112, rows[10][1] + "\n" + rows[11][1], "en")]
    rows += [(120, None, None), (121, "", "en"), (122, " \n\t ", "en"), (123, "123 456 !!", "en"), (124, "x", None), (125, ("long words here " * 9000), "en"), (126, "ÀÉ ünï \U0001f600 日本語", "fr"), (3, rows[3][1], "fr")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus())


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def tokens(text):
    return (text or "").encode().translate(LOWER).split()


@pytest.mark.parametrize("hash_bytes", [16, 1])
def test_exact(docs, hash_bytes):
    low = lambda t: (t or "").encode().translate(LOWER)
    groups = collections.defaultdict(list)
    for i, t, _ in corpus():
        groups[low(t)].append(i)
    got = exact_dedup.exact_dedup(docs, hash_bytes=hash_bytes).collect()
    assert len(got) == len(corpus())
    want = sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted(tuple(r) for r in got) == want


def test_near(docs):
    sets = {}
    for i, t, _ in corpus():
        w = tokens(t)
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    label = {i: i for i in sets}
    for _ in sets:
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    label[a] = min(label[a], label[b])
    for r in minhash.near_duplicates(docs, width=4).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    label = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: c for v, c in label.items() if any(v in e and e[0] != e[1] for e in edges)}


def kept_bytes(rows):
    """What is left of each row's bytes when 100-byte strings that start earlier are taken out; rows of one id come in the order given."""
    first, out = {}, []
    for row, (i, t, _) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first.setdefault(b[p : p + 100], (row, p)) != (row, p):
                gone[p : p + 100] = b"\1" * 100
        out.append((i, bytes(x for x, g in zip(b, gone) if not g), sum(gone)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("size, hot, block, levels", [(8 << 20, 20_000, 256, {}), (3000, 2, 2, {}), (3000, 20_000, 2, {"fan_bits": 2, "first": 3, "following": 2})])
def test_suffix(docs, monkeypatch, size, hot, block, levels):
    monkeypatch.setattr(suffix, "chunked", functools.partial(chunks.chunked, size=size))
    monkeypatch.setattr(suffix, "shared_counts", functools.partial(chunks.shared_counts, **levels))
    got = [(r["doc_id"], bytes(r["kept"]), sum(s["end"] - s["start"] for s in r["removed"])) for r in suffix.remove_repeats(docs, hot=hot, block=block).collect()]
    assert sorted(got, key=lambda r: (r[0], r[1])) == kept_bytes(corpus())


def test_common_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(30):
        t = rng.integers(0, 2, int(rng.integers(1, 400))).astype(np.uint8)
        b, sa = bytes(t), suffix.suffix_array(t)
        got = suffix.permuted_common_prefix(t, sa, 100)
        for before, i in zip([None, *sa.tolist()], sa.tolist()):
            assert got[i] == (0 if before is None else min(100, len(os.path.commonprefix([b[before:], b[i:]]))))


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(150):
        t = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 60))).astype(np.uint8)
        b = bytes(t)
        want = sorted(range(len(b)), key=lambda i: b[i:])
        small = suffix._types(t.astype(np.int64))
        assert suffix.suffix_array(t).tolist() == want
        lms = np.array([i for i in want if i and small[i] and not small[i - 1]], np.int64)
        assert suffix._induce_buckets(t.astype(np.int64), small, 256, lms).tolist() == want


def test_lm(docs):
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    out, w = lm.lm_scores(docs, langid.remainder("doc_id", 7) != 2)
    count, pair, context = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t, _ in corpus():
        x = [*tokens(t), b"\0"]
        if train(i):
            count.update(x)
            c = [b"\1", *x[:-1]]
            context.update(c)
            pair.update(zip(c, x))
    n, v = sum(count.values()), len(count)
    assert (w.tokens, w.types) == (n, v) and 0 <= w.unigram < 1 and ((0 <= w.bigram) & (w.bigram < 1)).all()
    texts = collections.defaultdict(list)
    for i, t, _ in corpus():
        texts[i].append(t)
    for r in out.collect():
        x = [*tokens(texts[r["doc_id"]][0]), b"\0"]
        score = 0
        for c, t in zip([b"\1", *x[:-1]], x):
            lam = w.bigram[int(math.log2(context[c])) + 1] if context[c] else 0
            score += math.log10(lam * pair[c, t] / max(1, context[c]) + (1 - lam) * (w.unigram * count[t] / n + (1 - w.unigram) / (v + 1)))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["train"]) == (len(x), sum(count[t] > 0 for t in x), n, train(r["doc_id"]))
        assert r["base_score"] == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in x)) and r["score"] == pytest.approx(score)


def test_language(docs):
    model = langid.fit(docs, F.lit(True))
    got = {r["doc_id"]: r for r in langid.language_id(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (120, 121, 122, 123)] == ["und"] * 4 and all(0 <= r["score"] <= 1 for r in got.values())
    right = [got[i]["lang_pred"] == lang for i, _, lang in corpus() if i < 60]
    assert np.mean(right) > 0.95
    two = langid.identify(" ".join([corpus()[0][1], corpus()[1][1]] * 6), model)
    assert sorted(two[2]) == ["en", "fr"] and sum(two[3]) == pytest.approx(1)
    assert langid.identify("abc", langid.fit(docs, F.lit(False)))[0] == "und"


def test_secrets(spark):
    key = "AKIA" + "QWERTYUIOPASDFGH"
    rows = [(1, f'password = "hunter22x9Q" é {key} {"ab12" * 7}', "en"), (2, "PassWord:short token=abcde", "en"), (3, None, None), (4, "a" * 24 + " api_key: Zx9Kq2LmP0", "en"), (5, "api-key=Zx9Kq2LmP0 apikey=Zx9Kq2LmP0", "en"), (6, "api_key: Zx9Kq2LmP0", "en"), (8, f"{key}{key}", "en")]
    df = table(spark, rows)
    scan = secrets.secret_scan(df)
    got = {r["doc_id"]: r for r in scan.collect()}
    assert [(got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) for i in (1, 2, 3, 4, 5, 8)] == [(1, 1, 1), (0, 0, 0), (0, 0, 0), (1, 0, 1), (1, 0, 0), (0, 1, 0)]
    assert got[1]["spans"] == "assign:0:23,access:27:47,hex:48:76"
    assert got[1]["base_sha256"] == hashlib.sha256(got[1]["spans"].encode()).hexdigest() and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    verdicts = {s["kind"]: (s["verdict"], s["owners"]) for s in got[4]["secrets"]}
    assert verdicts["assign"] == ("copied", 3) and verdicts["hex"] == ("sample", 1)
    clean = {r["doc_id"]: r["clean"] for r in df.join(scan, "doc_id").select("doc_id", secrets.redact(F.col("text"), F.col("secrets")).alias("clean")).collect()}
    assert clean[1] == f'[secret]" é [secret] {"ab12" * 7}' and clean[3] is None and clean[6] == "api_key: Zx9Kq2LmP0"


def test_redact_overlaps(spark):
    found = [{"start": a, "end": b, "verdict": "live"} for a, b in ((0, 3), (2, 8), (4, 6), (10, 11))]
    df = spark.createDataFrame([("abcdefghijKlm", found)], "t string, s array<struct<start:long,end:long,verdict:string>>")
    assert df.select(secrets.redact(F.col("t"), F.col("s"), "*")).first()[0] == "*ij*lm"


@pytest.mark.parametrize("length", [4096, 7])
def test_packing(docs, length):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs.where("doc_id <> 3 and doc_id <> 125"), path, length).collect()
    by_piece = {(r["doc_id"], r["piece"]): r for r in got}
    n = 0
    for i, t, _ in corpus():
        if i in (3, 125):
            continue
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), length)):
            r = by_piece[i, k]
            assert (r["start"], r["length"], r["ids_crc32"]) == (a, len(ids[a : a + length]), zlib.crc32(np.array(ids[a : a + length], "<u4").tobytes()))
            n += 1
    assert n == len(got)
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for offset, size in sorted(own):
            assert offset == end
            end += size
        assert end <= length
    assert len(places) <= 1.1 * math.ceil(sum(r["length"] for r in got) / length) + 1


def test_packing_keeps_columns_of_any_name(spark):
    names = ["doc_id", "piece", "length", "place", "bucket", "before", "n", "buckets", "c0", "offset", "sequence_id", "odd name"]
    rows = [(k if k else None, 0, 1 + k % 3, *range(9)) for k in range(20)]
    got = packing.pack(spark.createDataFrame(rows, names), 5).collect()
    assert set(got[0].asDict()) == set(names) and all((r["place"], r["bucket"], r["before"], r["c0"], r["odd name"]) == (0, 1, 2, 5, 8) for r in got)
    ends = collections.Counter()
    for r in got:
        ends[r["sequence_id"]] += r["length"]
    assert len(got) == 20 and max(ends.values()) <= 5 and len(ends) == 8


def test_best_two_fit():
    counts = np.zeros(11, np.int64)
    for size in (6, 3, 2, 2):
        counts[size] += 1
    assert packing.bins(counts, 10) == [(1, [(6, 1), (2, 2)]), (1, [(3, 1)])]
    assert packing.bins(np.array([0, 0, 0, 7]), 10) == [(2, [(3, 3)]), (1, [(3, 1)])]


def test_lines(docs):
    seen, ends = set(), collections.defaultdict(set)
    got = collections.defaultdict(list)
    for r in line_dedup.line_dedup(docs.where("doc_id not in (3, 125)")).collect():
        got[r["doc_id"]].append(r)
    lines = []
    for i, t, _ in sorted((r for r in corpus() if r[0] not in (3, 125)), key=lambda r: r[0]):
        own = [] if t is None else t.split("\n")
        gone = []
        for k, line in enumerate(own):
            w = line_dedup.words_of(line)
            if w and any(w == v or (len(w) >= 5 and len(v) >= 5 and line_dedup.within_one(line, other)) for v, other in lines):
                gone.append(k)
            if w:
                lines.append((w, line))
        assert (got[i][0]["n_lines"], got[i][0]["removed"], got[i][0]["n_removed"]) == (len(own), gone, len(gone)), i
    assert not seen and not ends


def removed_lines(spark, texts):
    found = line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return {r["doc_id"]: r["removed"] for r in found.collect() if r["removed"]}


def test_lines_with_longer_forms(spark):
    assert removed_lines(spark, ["one two three four five six", "one two three four five nine", "one two three four five six seven"]) == {1: [0], 2: [0]}
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(4, 10))) for _ in range(150)] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 7))) for _ in range(250)]
    rng.shuffle(texts)
    want = {}
    for i, t in enumerate(texts):
        if any(t == u or min(len(t.split()), len(u.split())) >= 5 and line_dedup.within_one(t, u) for u in texts[:i]):
            want[i] = [0]
    assert removed_lines(spark, texts) == want and 0 < len(want) < len(texts)


def test_lines_with_moved_words(spark):
    assert removed_lines(spark, ["b c d e f a", "a b c d e g", "a b c d e f"]) == {2: [0]}


def test_pieces(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    a = pieces.encode(docs, path, heat=0.5, seed=3)
    got = {r["doc_id"]: r for r in pieces.decode(a, path).collect()}
    again = {r["doc_id"]: r["ids"] for r in pieces.encode(docs.repartition(3), path, heat=0.5, seed=3).collect()}
    for i, t, _ in corpus():
        assert got[i]["text"] == t and got[i]["ids"] == again[i]
    assert {r["doc_id"]: r["ids"] for r in pieces.encode(docs, path, heat=0.5, seed=4).collect()}[0] != again[0]


def test_segmentations_follow_their_weights():
    lattice = pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    into, forward = lattice.edges("▁thert")

    def paths(j):
        return [((), 1.0)] if j == 0 else [(t + ids, p * math.exp(w)) for a, ids, w in into[j] for t, p in paths(a)]

    total = math.exp(forward[-1])
    want = {t: p / total for t, p in paths(6)}
    got = collections.Counter(tuple(x.tolist()) for x in lattice.encode(["thert"] * 20_000, list(range(20_000))))
    assert sum(want.values()) == pytest.approx(1) and set(got) <= set(want)
    assert max(abs(got[t] / 20_000 - p) for t, p in want.items()) < 0.02
    for text in ("", " ", "a▁b  c\n\n日本 \U0001f600", "x" * 200 + " y"):
        assert lattice.decode(lattice.encode([text], [5])[0]) == text


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 8))
    x[100:130] = x[100]
    rows = [(k, v.tolist(), k) for k, v in enumerate(x)] + [(2000, None, 0), (2100, [0.0] * 8, 0), (2200, [float("nan")] * 8, 0), (2300, [1.0], 0), (2400, [None] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 100 == 0, 10, parts=8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        hits += len({i for i, _ in got[q]} & set(want.tolist()))
        assert all(s == pytest.approx(d[i]) for i, s in got[q])
    assert hits >= 0.9 * 150 and sorted(got) == list(range(0, 1500, 100))
    assert [i for i, _ in got[100]] == list(range(101, 111))


def test_partitions_are_balanced():
    x = np.random.default_rng(0).standard_normal((400, 4))
    parts = ann.balanced_parts(ann.neighbour_graph(x, 8), 8)
    assert set(np.bincount(parts)) == {50}


def test_empty_tables(spark, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    model = langid.fit(empty, F.lit(True))
    frames = [exact_dedup.exact_dedup(empty), minhash.near_duplicates(empty), suffix.remove_repeats(empty), lm.lm_scores(empty, F.lit(True))[0], langid.language_id(empty, model), secrets.secret_scan(empty), packing.pack_documents(empty, path), line_dedup.line_dedup(empty), pieces.encode(empty, public_tokenizers.path("piece_bpe_32k.model"))]
    assert [f.count() for f in frames] == [0] * len(frames)
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_word_hashes():
    data = "Aa b c\n\taa  AA".encode()
    h, offsets = kernels.words(np.frombuffer(data, np.uint8), np.array([0, 2, len(data)]))
    assert offsets.tolist() == [0, 1, 4] and h[0] == h[2] == h[3] and len(set(h.tolist())) == 2
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (kernels.unpack_keys(kernels.pack_keys(keys)) == keys).all()


@pytest.mark.parametrize("reach,shuffles", [(2, 4), (5, 3)])
def test_minhash_in_crowded_regions(spark, reach, shuffles):
    """Texts that share most of their words, so that regions are crowded and few pairs are links: rare shingles, the last pass and block edges against brute force."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):
        own = list(base)
        for at in rng.sample(range(60), 3):
            own[at] = f"x{k}a{at}"
        rows.append((k, " ".join(own), "en"))
        if k % 10 == 0:
            own[rng.randrange(60)] = f"y{k}"
            rows.append((500 + k, " ".join(own), "en"))
    sets = {i: {tuple(t.split()[a : a + 5]) for a in range(56)} for i, t, _ in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links
    for _ in range(len(sets)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffles))
    try:
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(spark, rows), reach=reach).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == label


def test_search_on_two_levels(spark):
    """Parts that are divided again, rows that are all alike, and fewer candidates than asked for."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 8))
    x[:400] = x[0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 100 == 0, part_rows=64).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q in range(0, 3000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(found[q]) & {int(k) for k in np.lexsort((np.arange(3000), d))[:10]})
    assert hits >= 0.9 * 300 and found[100] == [k for k in range(11) if k != 100][:10]
    few = {r["query_id"] for r in ann.search(df.limit(4), F.col("vec_id") == 0).collect()}
    assert few == {0} and ann.search(df.limit(4), F.col("vec_id") == 0).count() == 3
