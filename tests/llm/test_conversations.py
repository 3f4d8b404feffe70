"""Conversation tries, conversation repair and slack packing against brute force, with nulls, ties, repeats, long conversations and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from emberlog.llm import prefix_trie, queries, repair, slack
from tests.llm.test_operators import corpus, table

SCHEMA = "conv_id long, turn long, role string, text string, part int, digest string, depth int, gone string, segment string, copies string, h string, n string"


def talks():
    rng = random.Random(5)
    say = lambda: " ".join(rng.choice("yes no maybe well then stop. why? fine!".split()) for _ in range(rng.randint(1, 4)))
    rows = []
    for c in [*range(45), 60, 61, 79, 400, -3, -20, 10**12]:
        n = 70 if c == 7 else 0 if c == 40 else rng.randint(1, 9)
        for t in range(n):
            rows.append((c, t, ("system" if t == 0 and rng.random() < 0.3 else ("user", "assistant")[t % 2]) if rng.random() < 0.9 else rng.choice(["tool", "", None, "user"]), rng.choice([say(), say(), "same words.", "", None, " \t", "ünï \U0001f600!"])))
    rows += [(c, t, "user", "the first words of many") for c in range(100, 140) for t in range(1)] + [(c, t, ("user", "assistant")[t % 2], f"copy {t}.") for c in range(200, 230) for t in range(4)]
    rows += [(5, None, "user", "without a turn"), (5, None, "user", "without a turn"), (5, 2, "user", "a tie"), (None, 1, "user", "no conversation"), (None, None, None, None), (300, None, None, None), (301, 5, "user", "gap."), (301, 9, "assistant", "gap.")]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("talks")
    spark.createDataFrame([(*r, 1, "x", 2, "x", "x", "x", "x", "x") for r in talks()], SCHEMA).repartition(3).write.parquet(str(path / "conversations.parquet"))
    table(spark, corpus()).write.parquet(str(path / "documents.parquet"))
    return str(path)


def md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def rank(row):
    return (row[0] is not None, row[0] or 0, md5(row[1], row[2]))


def rebuilt():
    own = collections.defaultdict(list)
    for c, t, role, text in talks():
        if c is not None:
            own[c].append((t, role or "", text or ""))
    out = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fix(c / 20)) * 0 - (c % 20 if c >= 0 else -(-c % 20))
        pick = lambda k: [(r, x) for _, r, x in sorted(own.get(k, []), key=rank)]
        out[c] = pick(base)[:h] + pick(c)[h:]
    return out


def trie_rows():
    members = collections.defaultdict(list)
    talk = rebuilt()
    for c, turns in talk.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, own in members.items():
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", p[-1][1].encode())) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(own) - 1) * words
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(talk[c]) == len(p))))
    return [(min(own), len(p), min(members[p[:-1]]) if p else None, len(own), kids[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, own in members.items()]


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_op11(spark, folder):
    got = queries.queries()["op11_prefix_trie"](spark, folder).collect()
    assert sorted(tuple(r[c] for c in TRIE) for r in got) == sorted(trie_rows(), key=lambda r: r)


@pytest.mark.parametrize("block", [1, 3])
def test_trie_by_other_blocks_and_runs(spark, folder, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "RUN", 4)
    got = prefix_trie.trie(*prefix_trie.rebuilt(spark.read.parquet(folder + "/conversations.parquet")), block=block).collect()
    assert sorted(tuple(r[c] for c in TRIE) for r in got) == sorted(trie_rows())


REPAIR = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def least_edits(rows):
    """By (cost, letters) from every state, turn by turn from the end."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {0: (0, ""), 3: (0, "")}

    def insert(g):
        for _ in range(2):
            g = {s: min(w) for s in after if (w := [*([g[s]] if s in g else []), *([(g[after[s]][0] + 3, "I" + g[after[s]][1])] if after[s] in g else [])])}
        return g

    best = insert(best)
    for initial, stays, cut in reversed(rows):
        now = {}
        for s in after:
            ways = [(best[s][0] + 4, "D" + best[s][1])] if s in best else []
            to = 1 if initial == "s" and s == 0 else after[s] if initial == " sua"[after[s]] else None
            if stays and to in best:
                ways.append((best[to][0] + 3 * cut, "K" + best[to][1]))
            if stays and after[s] in best:
                ways.append((best[after[s]][0] + 3 + 3 * cut, "R" + best[after[s]][1]))
            if ways:
                now[s] = min(ways)
        best = insert(now)
    return best[0]


def repair_rows():
    own = collections.defaultdict(list)
    for c, t, role, text in talks():
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own[c] += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, rows in own.items():
        rows.sort(key=rank)
        numbers = [t for t, *_ in rows if t is not None]
        seen, coded, faults = set(), [], collections.Counter()
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            coded.append((role[:1], fault not in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = least_edits(coded)
        turns, left = [], iter(rows)
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else next(left)
            if letter != "D":
                users = sum(r[:1] in ("u", "a") for r, _ in turns)
                turns.append((role if letter == "K" else ("user", "assistant")[users % 2], text))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest()
        out.append((c, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_op12(spark, folder):
    got = queries.queries()["op12_structure_repair"](spark, folder).collect()
    assert by_id(tuple(r[c] for c in REPAIR) for r in got) == by_id(repair_rows())


@pytest.mark.parametrize("segment_rows", [1, 3])
def test_repair_in_segments(spark, folder, segment_rows):
    reports, turns = repair.repair(repair.damaged(spark.read.parquet(folder + "/conversations.parquet")), segment_rows=segment_rows)
    want = {r[0]: r for r in repair_rows()}
    assert by_id(tuple(r) for r in reports.collect()) == by_id(r[:-1] for r in want.values())
    own = collections.defaultdict(list)
    for r in turns.orderBy("part", "segment").collect():
        own[r["conv_id"]] += [f"{t['role']}:{t['text']}" for t in r["turns"]]
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in own.items()} == {c: r[-1] for c, r in want.items()}


def test_cheapest_edits():
    """The big-integer minimum against pairs of cost and letters, also where letters are put aside often."""
    rng = random.Random(2)
    for _ in range(300):
        own = [(rng.choice("suaox"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 40))]
        codes = bytes(("sua".find(i) if i in "sua" else 3) | f << 2 for i, f in own)
        want = least_edits([(i, f not in (1, 2), f == 3) for i, f in own])
        assert repair.cheapest(codes) == want
        assert all(repair.cheapest(codes, block) == want for block in (1, 2, 5))


@pytest.mark.parametrize("name,columns", [("op11_prefix_trie", TRIE), ("op12_structure_repair", REPAIR)])
def test_sql_agrees_on_rows_without_ties(spark, name, columns):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    got = queries.queries()[name](spark, sf).collect()
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want)


def padding(places, capacity):
    total = 0
    for own in places.values():
        end = 0
        for offset, size in sorted(own):
            assert offset == end
            end += size
        assert end <= capacity
        total += capacity - end if end & (end - 1) else 0
    return total


@pytest.mark.parametrize("capacity", [4096, 64, 8, 1])
def test_op13(spark, folder, capacity):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = spark.read.parquet(folder + "/documents.parquet")
    got = (queries.queries()["op13_bin_slack"](spark, folder) if capacity == 4096 else slack.pack_documents(docs, path, capacity)).collect()
    ids, places, pieces = {}, collections.defaultdict(list), collections.defaultdict(list)
    for i, t, _ in corpus():
        ids.setdefault(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    for r in got:
        own = ids[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) and r["doc_tokens"] == len(own)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
    copies = collections.Counter(i for i, *_ in corpus())
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted([*range(len(own))] * copies[i]) for i, own in ids.items()}
    assert padding(places, capacity) == 0


def test_slack_plan():
    assert slack.closest({9: 1, 5: 2, 4: 3, 3: 1}, 12) in ({9: 1, 3: 1}, {5: 1, 4: 1, 3: 1}, {4: 3})
    assert slack.closest({7: 2}, 6) == {} and slack.closest({2: 5}, 7) == {2: 3}
    rng = np.random.default_rng(0)
    for capacity in (2, 8, 32):
        for _ in range(60):
            counts = np.append(0, rng.integers(0, 5, capacity) * (rng.random(capacity) < rng.random()))
            length, number = np.repeat(np.arange(capacity + 1), counts), np.concatenate([np.arange(n) for n in counts])
            rows, places, covered = slack.plan(counts, capacity), collections.defaultdict(list), collections.defaultdict(list)
            for values in slack._parts(rows, length, number):
                for at, start, size, sequence, offset, cut in zip(*values, strict=True):
                    places[sequence].append((offset, size))
                    covered[at] += range(start, start + size)
                    assert cut == (size < length[at])
            assert padding(places, capacity) == 0 and all(sorted(covered[k]) == [*range(n)] for k, n in enumerate(length))


def test_empty_tables(spark):
    talk = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(*prefix_trie.rebuilt(talk)).count() == 0
    reports, turns = repair.repair(repair.damaged(talk))
    assert reports.count() == 0 and turns.count() == 0
    assert slack.pack_documents(table(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_trie_of_one_hot_conversation(spark):
    """One conversation has a third of the turns, and many share all of another."""
    rows = [(1, t, "user", f"t{t}") for t in range(300)] + [(c, t, "user", f"s{t}") for c in range(100, 400) for t in range(2)]
    turns = spark.createDataFrame(rows, "conv_id long, depth long, role string, text string").select("conv_id", (F.col("depth") + 1).alias("depth"), F.md5("text").cast("binary").alias("digest"), F.lit(1).cast("long").alias("words"))
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("n"))).collect()}
    assert len(got) == 303 and (got[1, 0]["n_convs"], got[1, 0]["n_leaves"], got[1, 0]["saved_tokens"], got[100, 2]["n_convs"]) == (301, 2, 598, 300)
