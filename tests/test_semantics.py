"""Semantics that the driver tables do not show."""

import json
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions import times
from emberlog.operators import behaviour, correlate, review, rules, timeline
from emberlog.plans import registry
from emberlog.sources import parsers, readers, sinks


def lines(spark, *raw, path="f"):
    return spark.createDataFrame([(path, k, r) for k, r in enumerate(raw, 1)], "source_path string, line_no long, raw string")


def events(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return timeline.to_timeline(df, {c: F.col(c) for c in df.columns})


@pytest.mark.parametrize(
    "text, function, want",
    [
        ("2024-02-30T00:00:00", times.parse_iso, None), ("2024-02-29", times.parse_iso, datetime(2024, 2, 29)), ("Tue, 5 Mar 2024 01:02:03 +0100", times.parse_iso, datetime(2024, 3, 5, 0, 2, 3)), ("x", times.parse_iso, None),
        ("-1", times.parse_epoch, None), ("12.9", times.parse_epoch, datetime(1970, 1, 1, 0, 0, 12)), ("Feb 30 00:00:00", lambda c: times.parse_syslog(c, 2024), None), ("Foo 3 00:00:00", lambda c: times.parse_syslog(c, 2024), None),
        ("Mar  3 04:05:06 h", lambda c: times.parse_syslog(c, 2024, "Europe/Berlin"), datetime(2024, 3, 3, 3, 5, 6)), ("Mar  3 04:05:06 h", lambda c: times.parse_syslog(c, 2024, "No/Zone"), datetime(2024, 3, 3, 4, 5, 6)),
        ("1700000000000000000", lambda c: times.parse_numeric_or_text(c, 2024), datetime(2023, 11, 14, 22, 13, 20)), ("5", lambda c: times.parse_numeric_or_text(c, 2024), None), ("2024-01-01 12:00:00", lambda c: times.parse_numeric_or_text(c, 2024, "Europe/Berlin"), datetime(2024, 1, 1, 11)),
        ("host-20240131235958.tar", times.acquisition_time, datetime(2024, 1, 31, 23, 59, 58)), ("120240131235958", times.acquisition_time, None), ("0", times.shadow_days, None),
    ],
)
def test_times(spark, text, function, want):
    assert spark.createDataFrame([(text,)], "t string").select(function(F.col("t"))).first()[0] == want


def test_year_rollover(spark):
    got = parsers.resolve_years(lines(spark, "Dec 31 23:59:59 h a: x", "no date", "Jan  1 00:00:01 h a: y"), 2024).orderBy("line_no").collect()
    assert [r["year"] for r in got] == [2023, 2023, 2024]


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_year_rollover_over_segments(spark, size):
    raw = ["no date", "Nov  1 00:00:00 h a: x", "no date", "Jan  1 00:00:01 h a: y", "Dec 30 00:00:00 h a: x", "no date", "no date", "Feb  2 00:00:00 h a: z", "Aug  2 00:00:00 h a: z", "Mar  2 00:00:00 h a: z"]
    got = parsers.resolve_years(lines(spark, *raw).unionByName(lines(spark, "Mar  1 00:00:00 h a: x", "Apr  1 00:00:00 h a: x", path="g")), 2024, size).orderBy("source_path", "line_no").collect()
    assert [r["year"] for r in got] == [2023, 2023, 2023, 2024, 2024, 2024, 2024, 2025, 2025, 2025, 2024, 2024]


def test_auth_line_keeps_first_kind(spark):
    row = parsers.parse_auth(lines(spark, "Mar  3 04:05:06 h sshd[9]: Failed password for root from 192.0.2.1 port 22", "Mar  3 04:05:07 h sshd[9]: nothing"), 2024).collect()
    assert [(r["event_action"], r["user"], r["src_ip"], r["port"], r["pid"]) for r in row] == [("ssh_login_failure", "root", "192.0.2.1", "22", "9")]


def test_audit_hex_and_last_field(spark):
    raw = ['type=EXECVE msg=audit(1700000000.1:7): argc=2 a0="sh" a1=2F746D702F78', 'type=SYSCALL msg=audit(1700000000.1:7): uid=1 uid=2 key="cron_persistence"']
    row = parsers.parse_auditd(lines(spark, *raw)).first()
    assert (row["command"], row["uid"], row["detection_names"], row["timestamp"]) == ("sh /tmp/x", "2", ["audit_cron_persistence"], datetime(2023, 11, 14, 22, 13, 20))


def test_window_keeps_only_recent_failures(spark):
    t = lambda m: datetime(2024, 1, 1, 12, m)
    rows = [(f"f{k}", t(k), "ssh_login_failure", "u", None) for k in range(0, 50, 5)] + [("s", t(50), "ssh_login_success", "u", None)]
    tl = events(spark, rows, "event_id string, timestamp timestamp, event_action string, user string, src_ip string")
    row = behaviour.success_after_failures(tl, 1800, 5).first()
    assert (row["failures"], row["failure_ids"]) == (6, ["f25", "f30", "f35", "f40", "f45"])
    assert behaviour.success_after_failures(tl, 60, 5).count() == 0


def test_policy_counts_twice_lists_once(spark):
    tl = events(spark, [("a", "destructive_command", ["destructive_command"], "behavior", "high")], "event_id string, event_action string, detection_names array<string>, evidence_role string, confidence string")
    row = behaviour.policy_findings(tl).first()
    assert (row["hits"], row["event_ids"], row["confidence"]) == (2, ["a"], "high")


def test_hunts_are_no_hits(spark):
    tl = events(spark, [("a", "grep -r 'bash -i' /", "shell_history"), ("b", "bash -i", "shell_history")], "event_id string, command string, source_type string")
    got = {r["event_id"]: r["detection_names"] for r in rules.apply_builtin_rules(tl).collect()}
    assert got == {"a": [], "b": ["reverse_shell_or_tunnel_pattern"]}


def test_state_gives_candidates_only(spark):
    tl = events(spark, [("a", "crontab -e", "state_observation")], "event_id string, command string, evidence_role string")
    row = rules.apply_builtin_rules(tl).first()
    assert (row["mitre"], row["mitre_candidates"]) == ([], ["T1053.003"])


def test_ioc_boundaries(spark):
    tl = events(spark, [("a", "to 192.0.2.10 and evil.Example"), ("b", "192.0.2.1 xevil")], "event_id string, raw string")
    iocs = spark.createDataFrame([("192.0.2.1", "ip", ""), ("EVIL.example", "domain", ""), ("evil", "literal", "")], "value string, kind string, label string")
    assert sorted((r["event_id"], r["value"]) for r in correlate.match_iocs(tl, iocs).collect()) == [("a", "EVIL.example"), ("b", "192.0.2.1")]


def test_phases_need_behaviour(spark):
    tables = (spark.createDataFrame([("T1", "p1"), ("T2", "p1"), ("T2", "p2")], "mitre string, phase string"), spark.createDataFrame([("stay", "p2")], "signal string, phase string"), spark.createDataFrame([("p1", 1), ("p2", 2)], "phase string, place int"))
    rows = [("state", "state_observation", ["T1"], None, None), ("sure", "behavior", ["T1"], None, None), ("open", "behavior", ["T2"], None, None), ("flag", "behavior", ["T2"], ["STAY "], None), ("kind", "behavior", ["T2"], None, "Stay")]
    tl = events(spark, rows, "event_id string, evidence_role string, mitre array<string>, ttp_flags array<string>, event_category string")
    got = {r["event_id"]: (r["attack_phases"], r["attack_phase_candidates"]) for r in rules.classify_attack_phases(tl, *tables).collect()}
    assert got == {"state": ([], ["p1"]), "sure": (["p1"], []), "open": ([], ["p1", "p2"]), "flag": (["p2"], []), "kind": (["p2"], [])}


def test_following_events_have_no_horizon(spark):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    tl = events(spark, [("a", day(0), "sudo_command"), ("b", day(31), "sudo_command"), ("c", day(400), "sudo_command")], "event_id string, timestamp timestamp, event_action string")
    anchors = spark.createDataFrame([("s", day(0)), ("t", day(1)), ("u", day(500))], "event_id string, start timestamp")
    got = {r["event_id"]: r["next_ids"] for r in behaviour.following_events(tl, anchors).collect()}
    assert got == {"s": ["a", "b", "c"], "t": ["b", "c"]}


def test_policies_count_events_without_ids(spark):
    tl = events(spark, [(None, "destructive_command", "behavior"), (None, "destructive_command", "behavior"), ("a", "destructive_command", "state_observation")], "event_id string, event_action string, evidence_role string")
    row = behaviour.policy_findings(tl).first()
    assert (row["hits"], row["severity"], row["evidence_roles"]) == (3, "high", ["behavior", "state_observation"])


def test_indicators_by_word(spark):
    tl = events(spark, [("a", "peer 2001:db8::1 up", None), ("b", "peer 2001:db8::12", None), ("c", "x", "opt/evil/run"), ("d", "run Bad Thing now", None)], "event_id string, raw string, source_path string")
    tl = tl.withColumn("host", F.lit("evil"))
    iocs = spark.createDataFrame([("2001:DB8::1", "ip", ""), ("/EVIL/", "path", ""), ("bad thing", "literal", ""), ("evil", "literal", "")], "value string, kind string, label string")
    got = sorted((r["event_id"], r["value"]) for r in correlate.match_iocs(tl, iocs).collect())
    assert got == [("a", "2001:DB8::1"), ("c", "/EVIL/"), ("c", "evil"), ("d", "bad thing")]


def test_audit_groups_end_at_their_marker(spark, tmp_path):
    from emberlog.streaming import timelines

    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [(at(59), "n", "1:7", "SYSCALL", "a"), (at(1), "n", "1:8", "SYSCALL", "b"), (datetime(2024, 1, 1, 0, 1, 0), "n", "1:7", "EOE", "c"), (at(2), "m", "1:8", "PATH", "d")]
    spark.createDataFrame(rows, "timestamp timestamp, node string, audit_id string, type string, body string").write.parquet(str(tmp_path / "in"))
    got = timelines.run_available(timelines.stream_audit_groups(timelines.read_stream(spark, str(tmp_path / "in") + "/"))).collect()
    assert [(r["audit_id"], r["types"], r["bodies"], r["timestamp"]) for r in got] == [("1:7", ["EOE", "SYSCALL"], ["a", "c"], at(59))]


def test_chain_detects_changes(spark):
    base = spark.createDataFrame([("c", k, "1", None, "note", "a", f"e{k}", "", str(k)) for k in (1, 2, 3)], "chain string, sequence long, schema_version string, timestamp timestamp, action string, actor string, event_id string, before string, after string")
    linked = base.join(review.append_chain(base), ["chain", "sequence"])
    assert review.verify_chain(linked).count() == 0
    assert {r["problem"] for r in review.verify_chain(linked.where("sequence <> 2")).collect()} == {"sequence", "previous_hash"}


def test_ids_grow_on_collision(spark):
    tl = events(spark, [(None, str(k)) for k in range(40)], "event_id string, raw string")
    short = [r["event_id"] for r in timeline.assign_event_ids(tl, 1).collect()]
    assert len({len(i) for i in short}) >= 1 and all(i.startswith("evt_") for i in short) and any(len(i) == 9 for i in short)


def test_files_round_trip(spark, tmp_path):
    import gzip
    import lzma

    (tmp_path / "a.log").write_bytes("one\r\ntwo ü\nbad \xff".encode("latin-1"))
    got = readers.read_log_lines(spark, str(tmp_path / "a.log")).orderBy("line_no").collect()
    assert [r["line_no"] for r in got] == [1, 2, 3] and got[0]["raw"] == "one"
    (tmp_path / "z").mkdir()
    (tmp_path / "z/a").write_bytes(gzip.compress(b"x\ny"))
    (tmp_path / "z/b").write_bytes(lzma.compress(b"w"))
    (tmp_path / "z/c").write_bytes(b"plain")
    packed = readers.read_compressed_lines(spark, str(tmp_path / "z")).collect()
    assert sorted((r["raw"] or "", r["problem"] or "") for r in packed) == [("", "unsupported"), ("w", ""), ("x", ""), ("y", "")]
    inv = {r["relative"]: r["coverage_status"] for r in readers.file_inventory(spark, str(tmp_path)).collect()}
    assert len(inv) == 4
    tl = events(spark, [("a", "c1", "x"), ("b", "c2", "y")], "event_id string, collection_id string, raw string")
    sinks.write_timeline(tl, str(tmp_path / "out"))
    assert readers.read_timeline(spark, str(tmp_path / "out/json")).count() == 2


def test_streams(spark, tmp_path):
    from emberlog.streaming import timelines

    rows = [(f"e{k}", datetime(2024, 1, 1, 0, k), "ssh_login_failure", "u", "192.0.2.1", "same" if k < 2 else str(k)) for k in range(5)]
    tl = events(spark, rows, "event_id string, timestamp timestamp, event_action string, user string, src_ip string, raw string")
    tl.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tl.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("dedup", timelines.stream_dedupe(stream), "append"), ("fails", timelines.stream_failures(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("dedup").count() == 5
    assert spark.table("fails").agg(F.max("failures")).first()[0] == 5


def test_indicators_in_parts(spark):
    from emberlog.operators import correlate

    events = spark.createDataFrame([(1, "get evil.example now"), (2, "ran /tmp/x as mallory"), (3, "from 10.0.0.9"), (4, "nothing")], "event_id long, raw string")
    events = events.selectExpr("*", *(f"cast(null as string) as {c}" for c in correlate.SEARCHED if c != "raw"))
    iocs = spark.createDataFrame([("evil.example", "domain", "a"), ("/tmp/x", "path", "b"), ("mallory", "literal", "c"), ("10.0.0.9", "ip", "d"), ("absent", "literal", "e")], "value string, kind string, label string")
    got = sorted((r["event_id"], r["value"]) for r in correlate.match_iocs(events, iocs, most=1).collect())
    assert got == [(1, "evil.example"), (2, "/tmp/x"), (2, "mallory"), (3, "10.0.0.9")]


def test_automaton_is_flat_in_the_list(spark):
    """Ten thousand indicators in one pass: no comparison per indicator in the plan, and the rows of brute force."""
    import random

    rng = random.Random(7)
    letters = "ab./:x"
    rows = [(k, "".join(rng.choice(letters) for _ in range(60))) for k in range(60)] + [(97, None), (98, "")]
    listed = [("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))), rng.choice(["ip", "literal", "domain", "path", "odd", None])) for _ in range(10_000)]
    tl = events(spark, rows, "event_id long, raw string").select(*(F.col(c) for c in ("event_id", "raw")), *(F.lit(None).cast("string").alias(c) for c in correlate.SEARCHED if c != "raw"))
    found = correlate.match_iocs(tl, spark.createDataFrame([(v, k, "l") for v, k in listed], "value string, kind string, label string"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    word = set("abcdefghijklmnopqrstuvwxyz0123456789_.:-")
    stands = lambda t, v: any(t.startswith(v, i) and (i == 0 or t[i - 1] not in word) and (i + len(v) == len(t) or t[i + len(v)] not in word) for i in range(len(t)))
    want = {(str(i), v, k or "") for i, t in rows if t for v, k in set(listed) if (v in t if k in ("domain", "path") else stands(t, v))}
    assert {(r["event_id"], r["value"], r["kind"] or "") for r in found.collect()} == want


def test_ranges_and_halo(spark):
    from pyspark.sql import Window

    from emberlog.operators import ranges

    df = spark.range(57).select((F.col("id") * 37 % 57).alias("k"), (F.col("id") % 3).alias("w"))
    for parts in (1, 4, 40):
        own = ranges.ordered_ranges(df, ("k",), parts)
        assert sorted((r["k"], r["position"]) for r in ranges.positions(own).collect()) == [(k, k + 1) for k in range(57)]
        weights = {r["k"]: r["w"] for r in df.collect()}
        assert all(r["sum"] == sum(weights[k] for k in range(r["k"] + 1)) for r in ranges.positions(own, "w", "sum").collect())
        frames = ranges.with_halo(own, 9).select("k", "halo", F.collect_list("k").over(ranges.next_rows(10)).alias("l")).where("not halo").collect()
        assert {r["k"]: r["l"] for r in frames} == {k: list(range(k, min(57, k + 10))) for k in range(57)}
    assert Window and ranges.with_halo(ranges.ordered_ranges(df.limit(0), ("k",)), 3).count() == 0


def test_compressed_files_in_splits(spark, tmp_path):
    import bz2
    import gzip
    import lzma
    import random
    import struct
    import zlib

    from emberlog.sources import files

    rng = random.Random(1)
    lines = [f"{k} " + "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 90))) for k in range(20_000)]
    data = "\n".join(lines).encode()

    def sized(part):
        machine = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = machine.compress(part) + machine.flush()
        return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))

    cut = lambda n: [data[a : a + n] for a in range(0, len(data), n)]
    packed = {
        "one.bz2": bz2.compress(data, 1), "many.bz2": b"".join(map(bz2.compress, cut(90_000))), "one.gz": gzip.compress(data), "many.gz": b"".join(map(gzip.compress, cut(300_000))), "sized.gz": b"".join(map(sized, [*cut(50_000), b""])),
        "one.xz": lzma.compress(data), "many.xz": b"".join(map(lzma.compress, cut(100_000))),
    }
    for name, content in packed.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "ends.bz2").write_bytes(bz2.compress(b"a\r\nb\rc\n\nd"))
    (tmp_path / "none.bz2").write_bytes(bz2.compress(b""))
    (tmp_path / "cut.gz").write_bytes(packed["one.gz"][:-5000])
    (tmp_path / "cut.xz").write_bytes(packed["one.xz"][:-5000])
    (tmp_path / "plain").write_bytes(b"plain")
    size = 40_000
    some = {n: len(files.splits(open(tmp_path / n, "rb"), len(c), size)) for n, c in packed.items()}
    assert some["one.gz"] == some["many.gz"] == some["one.xz"] == 1 and min(some[n] for n in ("one.bz2", "many.bz2", "sized.gz", "many.xz")) > 5
    got = {}
    for r in files.compressed_lines(spark, str(tmp_path), size=size).orderBy("source_path", "line_no").collect():
        got.setdefault(r["source_path"].rsplit("/", 1)[1], []).append((r["line_no"], r["raw"], r["problem"]))
    for name in packed:
        assert got[name] == [(k, line, None) for k, line in enumerate(lines, 1)], name
    assert got["ends.bz2"] == [(1, "a", None), (2, "b", None), (3, "c", None), (4, "", None), (5, "d", None)] and "none.bz2" not in got
    assert got["plain"] == [(0, None, "unsupported")] and got["cut.xz"] == [(0, None, "damaged")]
    assert got["cut.gz"][0] == (0, None, "damaged") and [x[1] for x in got["cut.gz"][1:1001]] == lines[:1000]


def test_inventory_reads_magic_and_streams(spark, tmp_path):
    import hashlib

    (tmp_path / "logs (1)" / "etc").mkdir(parents=True)
    (tmp_path / "logs (1)" / "etc" / "passwd").write_text("root:x")
    (tmp_path / "logs (1)" / "odd.bin").write_bytes(files_magic() + b"\0" * 3_000_000)
    (tmp_path / "logs (1)" / "._auth.log").write_text("x")
    got = {r["relative"]: r for r in readers.file_inventory(spark, str(tmp_path / "logs (1)")).collect()}
    assert set(got) == {"etc/passwd", "odd.bin"} and got["odd.bin"]["source_types"] == ["sqlite_log"] and got["etc/passwd"]["source_types"] == ["passwd"]
    assert got["odd.bin"]["sha256"] == hashlib.sha256(files_magic() + b"\0" * 3_000_000).hexdigest() and got["odd.bin"]["size"] == 3_000_016


def files_magic():
    return b"SQLite format 3\x00"


def test_findings_name_what_they_found(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [(f"f{9 - k}", at(k), "ssh_login_failure", "u", "192.0.2.1", [], "", "auth_log") for k in range(7)] + [("s", at(20), "ssh_login_success", "u", "192.0.2.1", [], "", "auth_log")]
    rows += [("b", at(30), "shell_command", "", None, ["outbound_file_transfer_command", "outbound_ssh_command"], "198.51.100.9", "shell_history"), ("a", at(31), "shell_command", "", None, ["outbound_ssh_command"], "198.51.100.10", "shell_history")]
    rows += [("c", at(40), "user_created", "eve", None, [], "", "auth_log"), ("d", at(41), "user_created", "", None, [], "", "auth_log"), ("e", at(42), "account_locked", "eve", None, [], "", "auth_log"), ("g", None, "group_member_added", "eve", None, [], "", "account_diff")]
    tl = events(spark, rows, "event_id string, timestamp timestamp, event_action string, user string, src_ip string, detection_names array<string>, dst_ip string, source_type string")
    got = {r["title"]: r for r in behaviour.derive_findings(tl).collect()}
    login = got["Successful SSH login after repeated failures"]
    assert login["event_ids"] == ["s", "f7", "f6", "f5", "f4", "f3"] and login["summary"] == "u logged in from 192.0.2.1 after 7 failed attempts within 30 minutes."
    moved = got["Outbound Lateral Movement Evidence"]
    assert moved["event_ids"] == ["b", "a", "b"] and moved["tags"] == ["lateral_movement", "outbound"]
    assert moved["summary"] == "Found 3 action indicator(s) of outbound lateral movement: 2 SSH commands, 1 file transfers, and 0 active SSH connections. Destinations: 198.51.100.10, 198.51.100.9"
    accounts = got["Account Lifecycle Changes Detected"]
    assert accounts["event_ids"] == ["c", "d", "e", "g"] and accounts["severity"] == "high"
    assert accounts["summary"] == "Account changes detected via backup file diffing and log analysis: 1 unique account(s) observed as created (eve) across 2 supporting event(s); 1 group membership change(s)."
    quiet = {r["title"]: r for r in behaviour.derive_findings(tl.where("event_id = 's'").withColumn("event_action", F.lit("known_host_observed"))).collect()}
    assert quiet["Known SSH Destination Observed"]["summary"].startswith("Observed 1 SSH known-host entry.") and quiet["Known SSH Destination Observed"]["event_ids"] == ["s"]
    assert quiet["Lateral Movement Assessment Has Coverage Gaps"]["summary"].endswith("Missing: SSH host history, command history, network state.") and "Account Lifecycle Changes Detected" not in quiet


def test_no_credentials_no_storyline(spark):
    tl = events(spark, [("a", datetime(2024, 1, 1), "password_changed", ""), ("b", datetime(2024, 1, 2), "password_changed", "u")], "event_id string, timestamp timestamp, event_action string, user string")
    row = behaviour.credential_storyline(tl).first()
    assert (row["users"], row["events"], row["title"], row["confidence"]) == (1, 2, "Credential modification activity", "medium")
    assert behaviour.credential_storyline(tl.where("event_id = 'x'")).count() == 0


def test_audit_groups_time_out_and_open_again(spark, tmp_path):
    from emberlog.streaming import timelines

    folder, schema = tmp_path / "in", "timestamp timestamp, node string, audit_id string, type string, body string"
    stream = spark.readStream.schema(schema).parquet(str(folder) + "/*")
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    (folder / "0").mkdir(parents=True)
    query, batch = None, 0
    batches = [
        [(at(0), "n", "1:1", "SYSCALL", "a"), (at(1), "n", "1:2", "SYSCALL", "x")],
        [(at(2), "n", "1:1", "PATH", "b")],
        [(at(3), "n", "1:1", "EOE", "c"), (at(4), "n", "1:1", "CWD", "d")],
        [(at(5), "n", "1:1", "SYSCALL", "late")],
        [(at(500), "m", "9:9", "SYSCALL", "y")],
        [(at(501), "m", "9:9", "SYSCALL", "z")],
    ]
    query = timelines.stream_audit_groups(stream).writeStream.format("memory").queryName("groups").outputMode("append").start()
    seen = []
    for batch, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{batch}"))
        query.processAllAvailable()
        seen.append(sorted((r["audit_id"], tuple(r["bodies"])) for r in spark.table("groups").collect()))
    query.stop()
    assert seen[1] == [] and seen[2] == seen[3] == [("1:1", ("a", "b", "c", "d"))]
    assert seen[5] == [("1:1", ("a", "b", "c", "d")), ("1:1", ("late",)), ("1:2", ("x",))]


def test_auth_lines_are_cut_once(spark):
    from emberlog.sources import parsers

    lines = spark.createDataFrame([("f", 1, "Jan  2 03:04:05 h sshd[9]: Failed password for invalid user a from 192.0.2.1 port 22 ssh2", 2024), ("f", 2, "Jan  2 03:04:05 h su: pam_unix(su:session): session opened by x", 2024), ("f", 3, "Jan  2 03:04:05 user bob account unlocked", 2024), ("f", 4, "Jan  2 03:04:05 h useradd[1]: new user: name=eve, UID=1001, GID=7, home=/h", 2024)], "source_path string, line_no long, raw string, year int")
    df = parsers.parse_auth(lines, 2024)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_") < 40
    got = {r["extra"].get("x", r["event_action"]): r for r in df.collect()}
    assert (got["ssh_login_failure"]["user"], got["ssh_login_failure"]["src_ip"], got["ssh_login_failure"]["pid"], got["ssh_login_failure"]["host"]) == ("a", "192.0.2.1", "9", "h")
    assert got["su_session_opened"]["user"] is None and got["su_session_opened"]["summary"] == "su session opened for unknown user"
    assert got["account_unlocked"]["user"] == "bob" and got["account_unlocked"]["mitre"] == ["T1098"]
    assert (got["user_created"]["uid"], got["user_created"]["gid"], got["user_created"]["extra"]) == ("1001", "7", {"home": "/h"})


def test_rules_behind_the_prefilter(spark):
    """The search for needed words leaves no hit out: texts made of pieces of the rules' own patterns."""
    import random

    rng = random.Random(3)
    pieces = "curl wget | sh bash base64 --decode -d chmod +x x sudo su - -l usermod crontab /etc/cron.d/a cron.d systemctl enable foo.service history -c cat /dev/null > rm -rf auth.log tar /home /etc mysqldump redis-cli save dd if=/x vim-cmd ssh -r a@b /dev/tcp/1 bash -i pty.spawn mkfifo 169.254.169.254 scp telnet nc -z h 80 passwd bob /tmp/a /run/x docker.sock id_rsa .kube/config rclone socat xmr-stak nmap ctr word other xcurl Passw0rd! cat".split()
    rows = [(f"e{k}", " ".join(rng.choices(pieces, k=rng.randint(1, 4))), rng.choice(["shell_history", "auth_log"]), rng.choice(["behavior", "state_observation"])) for k in range(3000)]
    tl = events(spark, rows, "event_id string, command string, source_type string, evidence_role string")
    texts = tl.withColumns({"text": rules.event_text(), "ran": rules.executed_text(), "hunt": rules.indicator_search()})
    plain = rules.add_hits(texts, rules.builtin_hits()).select("event_id", "detection_names", "severity")
    got = rules.apply_builtin_rules(tl).select("event_id", "detection_names", "severity")
    assert got.exceptAll(plain).count() == 0 and plain.where("size(detection_names) > 0").count() > 1000
    assert texts.where(~rules.may_hit()).count() > 50


def test_audit_groups_share_calls(spark, tmp_path, monkeypatch):
    """Many groups are a few calls of Python, and those that close leave the others whole."""
    from emberlog.streaming import timelines

    folder, schema = tmp_path / "in", "timestamp timestamp, node string, audit_id string, type string, body string"
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    updated = []
    batches = [
        [(at(k % 7), f"n{k % 3}", f"1:{k}", "SYSCALL", f"a{k}") for k in range(300)] + [(None, None, "1:1", "CWD", "no time or node")],
        [(at(8), f"n{k % 3}", f"1:{k}", "EOE" if k % 4 == 0 else "PATH", f"b{k}") for k in range(300)],
        [(at(9), f"n{k % 3}", f"1:{k}", "EOE" if k % 4 == 1 else "CWD", f"c{k}") for k in range(300)],
        [(at(500), "m", "9:9", "SYSCALL", "y")],
    ]
    for batch, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{batch}"))
        stream = spark.readStream.schema(schema).parquet(str(folder) + "/*")
        found = timelines.stream_audit_groups(stream, buckets=8)
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        updated += [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress]
    got = sorted((r["node"] or "", r["audit_id"], *r["bodies"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = [("", "1:1", "no time or node")]
    for k in range(300):
        name = (f"n{k % 3}", f"1:{k}")
        want += [(*name, f"a{k}", f"b{k}"), (*name, f"c{k}")] if k % 4 == 0 else [(*name, f"a{k}", f"b{k}", f"c{k}")]
    assert got == sorted(want)
    assert 8 <= max(updated) < 50


def test_related_ids_are_not_shuffled_for_each_state(spark):
    """A path that many files and many state rows share: ids are gathered once, and each row is matched by its own paths."""
    dated = [(f"d{k:04d}", datetime(2024, 1, 1) + timedelta(seconds=k), "bodyfile", "mtime", "/etc/cron.d/x" if k < 600 else "/etc/cron.d/y", None) for k in range(700)]
    state = [(f"s{k}" if k else None, None, "cron_file", None, "etc/cron.d/x", f"src/{k % 9}" if k % 50 else "./etc//cron.d/y") for k in range(3000)]
    tl = events(spark, dated + state, "event_id string, timestamp timestamp, source_type string, timestamp_type string, file_path string, source_path string").withColumn("collection_id", F.lit("c")).localCheckpoint()
    found = correlate.correlate_state_times(tl).where("timestamp_type = 'correlated_mtime'").select("event_id", "related_event_ids", F.get_json_object("extra.correlation", "$.source_event_count").alias("n"))

    def written():
        store, jvm = spark._jsc.sc().statusStore(), spark._jvm
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = written()
    got = found.selectExpr("event_id", "n", "size(related_event_ids) as k", "md5(array_join(related_event_ids, ',')) as m").collect()
    assert written() - before < 1_000_000
    assert len(got) == 3000 and len({r["m"] for r in got}) == 2
    assert {(r["event_id"], r["n"], r["k"]) for r in got if r["event_id"] in (None, "s1", "s50")} == {(None, "700", 700), ("s1", "600", 600), ("s50", "700", 700)}


def test_large_rule_packs_load_as_fast_as_they_parse(spark, tmp_path):
    import time

    import yaml

    text = "tool_tags:\n" + "".join(f"  tool_{k}: {{namespace: tool}}\n" for k in range(12_000))
    (tmp_path / "pack.yaml").write_text(text)
    readers.load_rules(spark, str(tmp_path / "pack.yaml"))
    start = time.process_time()
    want = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    middle = time.process_time()
    assert readers.load_rules(spark, str(tmp_path / "pack.yaml")) == want
    assert time.process_time() - middle < 3 * (middle - start) + 0.2
    (tmp_path / "again.yaml").write_text("tool_tags:\n  a: {}\n  b: {}\n  a: {}\n")
    with pytest.raises(ValueError, match=r"twice: \['a'\]"):
        readers.load_rules(spark, str(tmp_path / "again.yaml"))


def test_audit_fields_are_taken_apart_after_grouping(spark):
    """Lines go through the shuffle once, as text; later fields win and keep the place of the first."""
    raw = ['type=SYSCALL msg=audit(1700000000.1:7): uid=1 comm="a b" uid=2 key=(null)', "type=PATH msg=audit(1700000000.1:7): name=/x comm=c uid=3", "type=CWD msg=audit(1700000000.1:8): ...", 'type=EXECVE msg=audit(1700000000.1:7): argc=2 a0="x" a1="y" a1="z"']
    df = parsers.parse_auditd(lines(spark, *raw))
    got = {r["extra"]["audit_id"]: r for r in df.collect()}
    assert got["7"]["extra"]["fields"] == '{"uid":"3","comm":"c","key":"(null)","name":"/x","argc":"2","a0":"x","a1":"z"}'
    assert (got["7"]["command"], got["7"]["uid"], got["7"]["file_path"], got["8"]["extra"]["fields"], got["8"]["command"]) == ("x z", "3", "/x", "{}", None)
    gathered = df._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [source_path")[1]
    assert r"(\w+=" not in gathered


def test_ids_take_their_form_once_for_each_set_of_paths(spark):
    """The text of ids is made before the last join, and paths are normalised after state is grouped; state without a match stays as it was."""
    dated = [(f"d{k}", datetime(2024, 1, 1) + timedelta(seconds=k), "auditd" if k % 2 else "bodyfile", "mtime", f"/etc//p{k % 3}", None, "c") for k in range(30)]
    state = [("s0", None, "cron_file", None, " ./etc/p0", None, "c"), ("s1", None, "cron_file", None, "etc/p1", "/etc/p2", "c"), ("s2", None, "cron_file", None, "/etc/p9", "", "c"), ("s3", None, "cron_file", None, None, None, "c"), ("s4", None, "cron_file", None, "/etc/p0", None, None), ("s5", None, "passwd", None, "/etc/p0", None, "c"), (None, None, "cron_file", None, "", "var/x", "d")]
    tl = events(spark, dated + state, "event_id string, timestamp timestamp, source_type string, timestamp_type string, file_path string, source_path string, collection_id string")
    lists, texts = correlate.correlate_state_times(tl), correlate.correlate_state_times(tl, related=lambda ids: F.array_join(ids, ","))
    ids = lambda *paths: sorted(r[0] for r in dated if r[4][-2:] in paths)
    want = {"s0": ids("p0"), "s1": ids("p1", "p2")}
    rows = {r["event_id"]: r for r in lists.where("timestamp_type is null or timestamp_type like 'correlated%'").collect()}
    assert len(rows) == 7 and {k: r["related_event_ids"] for k, r in rows.items() if r["timestamp"]} == want
    assert (rows["s0"]["timestamp"], rows["s1"]["timestamp"]) == (dated[0][1], dated[1][1])
    assert json.loads(rows["s1"]["extra"]["correlation"]) == {"method": "bodyfile_or_audit_path_match", "matched_paths": ["/etc/p1", "/etc/p2"], "source_event_count": 20, "source_timestamp_type": "mtime"}
    assert {k: (r["collection_id"], r["file_path"]) for k, r in rows.items() if not r["timestamp"]} == {"s2": ("c", "/etc/p9"), "s3": ("c", None), "s4": (None, "/etc/p0"), "s5": ("c", "/etc/p0"), None: ("d", "")}
    assert {r["event_id"]: r["related_event_ids"] for r in texts.where("timestamp_type like 'correlated%'").collect()} == {k: ",".join(v) for k, v in want.items()}
    assert lists.count() == texts.count() == 37
    plan = registry.queries()["correlate_state_times"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan.split("Join LeftOuter")[0] and "array_join" in plan
    scans = [line for line in plan.splitlines() if "o_orderkey" in line and "Relation" not in line]
    assert scans and not any("RLIKE" in line for line in scans)


def test_state_of_one_set_and_state_without_a_match_go_to_many_tasks(spark):
    dated = [(f"d{k}", datetime(2024, 1, 1), "bodyfile", "mtime", "/etc/x") for k in range(10)]
    state = [(f"s{k}", None, "cron_file", None, "/etc/x" if k < 2000 else f"/none/{k % 7}") for k in range(4000)]
    tl = events(spark, dated + state, "event_id string, timestamp timestamp, source_type string, timestamp_type string, file_path string").withColumn("collection_id", F.lit("c")).localCheckpoint()
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = correlate.correlate_state_times(tl, most=1000).where("event_id like 's%'").selectExpr("event_id", "timestamp is null as alone", "related_event_ids as ids", "spark_partition_id() as p").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r["event_id"] for r in rows) == sorted(r[0] for r in state)
    assert all(r["ids"] == ([] if r["alone"] else [d[0] for d in dated]) for r in rows)
    for alone in (False, True):
        tasks = Counter(r["p"] for r in rows if r["alone"] is alone)
        assert sum(tasks.values()) == 2000 and len(tasks) == 4 and max(tasks.values()) < 1200
