import gzip
import json
from datetime import date, datetime

from pyspark.sql import functions as F

from trafficlens.functions import fingerprint, keyed
from trafficlens.operators import actors, identity, profiles, robots, sessions, traps
from trafficlens.plans import digest, publish
from trafficlens.shared import materialise
from trafficlens.sources import log as source
from trafficlens.sources import sinks

ROBOTS_TS = "2026-01-01T00:00:0{}Z"


def write(path, events):
    path.write_text("".join((e if isinstance(e, str) else json.dumps(e)) + "\n" for e in events))


def test_reading_a_log(spark, tmp_path):
    write(tmp_path / "2026-01-02.jsonl", [{"kind": "request", "rid": "c"}, "", "not json", "[1]"])
    write(tmp_path / "2026-01-01.jsonl", [{"kind": "request", "rid": "a", "new": 1}, {"kind": "hunt", "rid": "b", "attacks": None}])
    with gzip.open(tmp_path / "tls-2026-01-01.jsonl.gz", "wt") as f:
        f.write('{"kind": "tls", "ip": "1.2.3.4"}\n')
    with gzip.open(tmp_path / "2026-01-02.jsonl.gz", "wt") as f:
        f.write('{"kind": "request", "rid": "twin"}\n')
    (tmp_path / "notes.txt").write_text("x")
    files = source.day_files(spark, str(tmp_path))
    assert {(r.stream, r.day, r.gz) for r in files.collect()} == {("events", "2026-01-01", False), ("events", "2026-01-02", False), ("tls", "2026-01-01", True)}
    log = source.read_log(spark, f"{tmp_path}/*.jsonl*", files=files)
    assert [r.kind for r in log.orderBy("seq").collect()] == ["request", "hunt", "tls", "request"]
    assert [r.rid for r in source.read_log(spark, f"{tmp_path}/*.jsonl*", kinds=["hunt"]).collect()] == ["b"]
    lacking = log.where("kind <> 'tls'").select("rid", source.lacks(F.col("raw"), "attacks").alias("l")).collect()
    assert {r.rid: r.l for r in lacking} == {"a": True, "b": False, "c": True}
    _, bad = source.with_malformed(spark, f"{tmp_path}/*.jsonl")
    assert {r.file: (r.malformed, r.not_events) for r in bad.collect()} == {"2026-01-01.jsonl": (0, 0), "2026-01-02.jsonl": (1, 1)}
    source.to_silver(log, str(tmp_path / "silver"))
    assert spark.read.parquet(str(tmp_path / "silver")).where("kind = 'request'").count() == 2


def test_days_and_lifecycle(spark):
    files = spark.createDataFrame([("events", "2026-01-01"), ("events", "2026-01-02"), ("tls", "2026-01-01")], "stream string, day string")
    done = spark.createDataFrame([("tls", "2026-01-01")], "stream string, day string")
    left = lambda h, m: {r.day for r in source.pending_days(files, done, datetime(2026, 1, 3, h, m)).collect()}
    assert left(0, 59) == {"2026-01-01"} and left(1, 0) == {"2026-01-01", "2026-01-02"}
    names = spark.createDataFrame([(n,) for n in ("2026-01-10.jsonl", "2026-01-09.jsonl", "2026-01-08.jsonl", "2026-01-08.jsonl.gz", "tls-2026-01-01.jsonl.gz", "x.jsonl")], "file string")
    plan = {r.file: r.action for r in source.lifecycle_plan(names, 2, 5, date(2026, 1, 10)).collect()}
    assert plan == {"2026-01-10.jsonl": None, "2026-01-09.jsonl": None, "2026-01-08.jsonl": "compress", "2026-01-08.jsonl.gz": None, "tls-2026-01-01.jsonl.gz": "delete"}


def test_order_of_states(spark):
    rules = robots.published_rules(spark)
    schema = "seq int, kind string, ua string, claimed_crawler string, ip string, path string, status int, resource string, standard string"
    read = lambda n, ua, std="robots": (n, "policy_read", ua, None, "1", None, None, None, std)
    fetch = lambda n, ua, path="/internal/x", status=200: (n, "request", ua, None, "1", path, status, "page", None)
    trap = lambda n, ua, std: (n, "trap_hit", ua, None, "1", None, None, None, std)
    rows = [read(1, "a"), fetch(2, "a"), fetch(1, "b"), read(2, "b"), read(1, "c"), trap(1, "d", "llms"), fetch(1, "e", "/x"), read(1, "f", "llms"), fetch(2, "f"), trap(1, "g", "robots"), fetch(2, "g"), read(1, "h"), fetch(2, "h", status=404), trap(1, "i", "sitemap"), read(1, "GPTBot"), fetch(2, "GPTBot", "/docs/")]
    got = {r.client_ua: r.state for r in profiles.profiles(spark.createDataFrame(rows, schema), rules).collect()}
    assert got == {"a": "defiant", "b": "ignorant", "c": "compliant", "d": "miner", "e": "indeterminate", "f": "ignorant", "g": "miner", "h": "compliant", "i": "compliant", "GPTBot": "defiant"}


def test_robots_text(spark):
    text = "# c\nDisallow: /early\nUser-agent: A\nUser-Agent: B # x\nDisallow: /x\nAllow: /x/y$\nSitemap: z\nUser-agent: *\nDisallow:\nDisallow: /p*q\r\n"
    rules = robots.parse_robots(spark.createDataFrame([("f", text)], "file_id string, text string"))
    got = {(r.group_id, r.agent, r.directive, r.pattern) for r in rules.collect()}
    assert got == {(1, a, d, p) for a in "AB" for d, p in (("disallow", "/x"), ("allow", "/x/y$"))} | {(2, "*", "disallow", ""), (2, "*", "disallow", "/p*q")}
    pairs = [("A/1", "/x/y"), ("A/1", "/x/yz"), ("xA", "/x"), ("xA", "/p-1-q/r"), ("b", "/xx"), ("b", "/robots.txt"), ("", "/pq")]
    out = robots.disallowed(spark.createDataFrame(pairs, "ua string, path string"), rules).collect()
    assert {(r.ua, r.path) for r in out if r.disallowed} == {("A/1", "/x/yz"), ("xA", "/p-1-q/r"), ("b", "/xx"), ("", "/pq")}


def test_identity(spark):
    ranges = source.ranges_of(spark.createDataFrame([("OpenAI", ["bad", "10.0.0.0/8", "10.1.0.0/16", "2001:db8::/32"])], "operator string, cidrs array<string>"))
    dns = spark.createDataFrame([("66.0.0.1", "crawl.googlebot.com.", ["66.0.0.1"]), ("66.0.0.2", "crawl.googlebot.com", ["9.9.9.9"]), ("66.0.0.3", "evil.test", ["66.0.0.3"])], "ip string, ptr string, forward array<string>")
    claims = [("10.1.2.3", "GPTBot"), ("11.0.0.1", "GPTBot"), ("2001:db8::5", "GPTBot"), ("oops", "GPTBot"), ("1.1.1.1", "ClaudeBot"), ("1.1.1.1", "CCBot"), ("1.1.1.1", "curl/8"), ("1.1.1.1", "Mozilla"), *((f"66.0.0.{i}", "Googlebot") for i in (1, 2, 3, 4))]
    got = {(r.ip, r.ua): (r.verdict, r.matched_range) for r in identity.verdicts(spark.createDataFrame(claims, "ip string, ua string"), ranges, dns).collect()}
    assert [got[c] for c in claims] == [("verified", "10.0.0.0/8"), ("impersonating", None), ("verified", "2001:db8::/32"), ("impersonating", None), ("unverifiable", None), ("unverifiable", None), ("undeclared", None), ("undeclared", None), ("verified", None), ("impersonating", None), ("impersonating", None), ("unverifiable", None)]
    times = spark.createDataFrame([("i", "c", datetime(2026, 1, 1, h)) for h in (0, 1, 2, 4)], "ip string, claim string, ts timestamp")
    assert identity.dedupe_claims(times).count() == 1
    assert sorted(r.ts.hour for r in identity.dedupe_claims(times, 7200).collect()) == [0, 2, 4]


def test_merge_ranges(spark):
    old = spark.createDataFrame([("A", ["1.0.0.0/8"]), ("B", ["2.0.0.0/8"])], "operator string, cidrs array<string>")
    got = source.fetched_prefixes(spark.createDataFrame([("A", '{"prefixes": [{"ipv4Prefix": "3.0.0.0/8"}, {"ipv6Prefix": "::/8"}, {"ipv4Prefix": "3.0.0.0/8"}, {"x": 1}]}'), ("B", "{}")], "operator string, payload string"))
    assert {r.operator: (r.cidrs, r.changed) for r in source.merge_ranges(old, got).collect()} == {"A": (["3.0.0.0/8", "::/8"], True), "B": (["2.0.0.0/8"], False)}


def test_ja4(spark):
    cols = "c array<int>, e array<int>, s array<int>, a array<string>, sni string, v array<int>"
    rows = [([0x1301, 0x0A0A, 0x1302], [0, 16, 43, 13], [0x0403], ["h2"], "x.test", [0x0304, 0x0303]), ([], [], [], [], None, [])]
    out = spark.createDataFrame(rows, cols).select(fingerprint.ja4(*(F.col(x) for x in ("c", "e", "s", "a", "sni", "v")), F.lit(0x0303)).alias("j")).collect()
    import hashlib

    h = lambda t: hashlib.sha256(t.encode()).hexdigest()[:12]
    assert out[0].j == f"t13d0204h2_{h('1301,1302')}_{h('000d,002b_0403')}" and out[1].j == "t12i000000_000000000000_000000000000"


def minted_trap(key, standard_code, at, ip, ua):
    import base64
    import hashlib
    import hmac

    short = lambda t: hashlib.blake2s(t.encode(), digest_size=4).digest()
    head = (at - keyed.EPOCH).to_bytes(4, "big") + bytes([standard_code]) + short(ip) + short(ua)
    return base64.urlsafe_b64encode(head + hmac.new(key, head, hashlib.blake2s).digest()[:6]).decode().rstrip("=")


def minted_planted(key, kind, ip):
    import base64
    import hashlib
    import hmac

    head = kind << 36 | 5 << 20 | int.from_bytes(hashlib.blake2s(ip.encode(), digest_size=3).digest(), "big") >> 4
    mac = hmac.new(hashlib.blake2b(key, person=b"honeytoken", digest_size=32).digest(), head.to_bytes(5, "big"), hashlib.blake2s).digest()[:5]
    return base64.b32encode(head.to_bytes(5, "big") + mac).decode()


def test_traps_and_replays(spark):
    key, at = b"k" * 32, 1_767_225_600
    token = minted_trap(key, 1, at, "1.1.1.1", "bot")
    forged = [token[:i] + ("A" if token[i] != "A" else "B") + token[i + 1 :] for i in range(26)]
    rows = [(t, datetime(2026, 1, 1, 0, 0, 9), "2.2.2.2", "bot", f"/internal/notes/{t}/handover.html") for t in [token, *forged]]
    hits = traps.trap_hits(spark.createDataFrame(rows, "rid string, ts timestamp, ip string, ua string, path string"), key, robots.published_rules(spark)).collect()
    (h,) = hits
    assert (h.standard, h.delay_seconds, h.same_ip, h.same_ua, h.split_fleet, h.disallowed) == ("robots", 9.0, False, True, True, True)
    planted = minted_planted(key, 1, "1.1.1.1")
    log = spark.createDataFrame([("r", datetime(2026, 1, 1), "1.1.1.1", "/", f"k=%41KIA{planted}", [["X", f"AKIA{planted[:-1]}A"]], None, None)], "rid string, ts timestamp, ip string, path string, raw_query string, headers array<array<string>>, body string, body_encoding string")
    (r,) = traps.honeytoken_hits(log, key).collect()
    assert (r.kind, r.location, r.same_ip, r.token) == ("aws_access_key", "query", True, planted)


VECTORS = [("ip", " [::ffff:1.2.3.4] ", "1.2.3.4"), ("ip", "nope", None), ("domain", "EXAMPLE.com.", "example.com"), ("domain", "bücher.example", "xn--bcher-kva.example"), ("domain", "single", None), ("url", "HTTP://Example.COM:80/A?b#c", "http://example.com/A?b"), ("url", "https://[2001:DB8::1]:8443/x", "https://[2001:db8::1]:8443/x"), ("url", "ftp://a.b/", None), ("wallet", "Ethereum:0xABC", "ethereum:0xabc"), ("wallet", "bitcoin:1AbC", "bitcoin:1AbC"), ("wallet", "doge:1", None), ("pool", " Stratum+TCP://P ", "stratum+tcp://p"), ("sha256", "A" * 64, "a" * 64), ("sha256", "zz", None), ("cve", "cve-2021-44228", "CVE-2021-44228"), ("cve", "CVE-1", None), ("credential", '["a",null]', '["a",null]')]


def test_normalisation(spark):
    df = spark.createDataFrame([(i, k, r) for i, (k, r, _) in enumerate(VECTORS)], "i int, k string, r string")
    got = {r.i: r.v for r in df.select("i", actors.normalize(F.col("k"), F.col("r")).alias("v")).collect()}
    assert [got[i] for i in range(len(VECTORS))] == [v for *_, v in VECTORS]


def test_sessions_actors_digest(spark, tmp_path):
    ind = lambda **k: {"wallets": {}, "pools": [], "urls": [], "miners": []} | k
    events = [
        {"kind": "request", "ts": "2026-01-01T00:00:00Z", "actor": "A", "actor_basis": "ja4", "ip": "1.1.1.1", "sensor": "s1", "indicators": ind(urls=["http://5.6.7.8/a", "http://Evil.test/b"], jndi=True), "tools": [{"name": "zgrab", "kind": "scanner"}]},
        {"kind": "credential", "ts": "2026-01-01T00:01:00.500+00:00", "actor": "A", "user": "u", "password": None},
        {"kind": "hunt", "ts": "2026-01-01T00:00:00Z", "actor": "B", "family": "git", "decoy_served": True},
        {"kind": "request", "ts": "2026-01-01T00:00:00Z", "actor": "C", "indicators": ind(urls=["http://evil.test/c"])},
        {"kind": "request", "ts": "2026-01-01T00:00:00Z", "actor": "D", "tools": [{"name": "nmap", "kind": "scanner"}]},
        {"kind": "identity", "ts": "2026-01-01T00:00:00Z", "claimed": "GPTBot", "verdict": "verified"},
        {"kind": "request", "ts": "2026-01-01T00:00:00Z", "actor": "E", "indicators": {"wallets": {"monero": []}}},
    ]
    write(tmp_path / "2026-01-01.jsonl", events)
    log = materialise(source.read_log(spark, f"{tmp_path}/*.jsonl").drop("raw", "line"))
    s = materialise(sessions.sessions(log))
    got = {r.actor: r for r in s.collect()}
    assert {a: r.stage_reached for a, r in got.items()} == {"A": "payload", "B": "decoy_served", "C": "payload", "D": "seen", "E": "payload"}
    assert got["A"].duration_s == 60.5 and got["A"].exploits == ["log4shell"] and got["A"].sensors == ["s1"]
    found = actors.indicators(s, sessions.credential_pairs(log))
    mine = {(r.type, r.value, r.strength) for r in found.where("actor = 'A'").collect()}
    assert mine == {("ip", "1.1.1.1", "weak"), ("url", "http://5.6.7.8/a", "strong"), ("url", "http://evil.test/b", "strong"), ("infra_ip", "5.6.7.8", "strong"), ("domain", "evil.test", "strong"), ("credential", '["u"]', "weak"), ("tool", "zgrab", "weak")} or ("credential", '["u",null]', "weak") in mine
    assert {r.actor: r.entity for r in actors.entities(found).collect() if r.actor in "AC"} == {"A": "A", "C": "A"}
    sinks.write_actors(actors.actor_records(s, found), str(tmp_path / "actors"), payload_only=True)
    records = [json.loads(x) for p in (tmp_path / "actors").glob("part-*") for x in p.read_text().splitlines()]
    assert [r["actor"] for r in records] == ["A", "C", "E"] and records[0]["first_seen"] == "2026-01-01T00:00:00Z" and len(records[0]) == 12
    assert {r.stage: r.sessions for r in sessions.by_stage(s).collect()} == {"seen": 1, "probed": 0, "decoy_served": 1, "followup": 0, "payload": 3}
    w = digest.in_window(s, datetime(2026, 1, 2), 1)
    d = json.loads(digest.digest(w, datetime(2026, 1, 2), 1).toJSON().first())
    assert d["totals"]["actor_sessions"] == 5 and d["follow_up"][0]["stage"] == "payload"
    docs = [json.loads(r.json) for r in sessions.sessions_json(s, log).collect()]
    assert len(docs) == 5 and all(len(x["timeline"]) == x["event_count"] for x in docs)
    chart = profiles.profiles(log, robots.published_rules(spark))
    assert [json.loads(r.json)["identity_verdict"] for r in profiles.profiles_json(chart).where("client_claimed = 'GPTBot'").collect()] == ["verified"]


def test_publish(spark, tmp_path):
    import base64

    key, src, dst = b"k" * 32, tmp_path / "src", tmp_path / "dst"
    src.mkdir()
    planted = minted_planted(key, 4, "1.1.1.1")
    secret = "ghp_" + planted.lower() + "A" * 20
    trap = minted_trap(key, 1, 1_767_225_600, "1.1.1.1", "bot")
    basic = base64.b64encode(f"u:{secret}".encode()).decode()
    events = [
        {"kind": "request", "rid": "x", "ts": "2026-01-01T01:00:00Z", "ip": "1.1.1.1", "path": f"/internal/notes/{trap}/handover.html", "headers": [["Cookie", "c=1"], ["X-Forwarded-For", "9.9.9.9, unknown"], ["X-Next", "B" * 26]], "body": "private", "body_encoding": "utf-8", "body_len": 7},
        {"kind": "request", "rid": "y", "ts": "2026-01-01T01:00:01Z", "ip": "1.1.1.1", "path": "/", "raw_query": "id=1%20UNION%20SELECT%201", "headers": [["Authorization", f"Basic {basic}"]], "body": base64.b64encode(f"\0{secret}".encode()).decode(), "body_encoding": "base64"},
        {"kind": "credential", "rid": "x", "user": "u", "password": "p"},
        {"kind": "credential", "rid": "y", "user": "u", "password": "p"},
        {"kind": "request", "rid": "z", "path": "/%67hp_" + secret[4:], "headers": []},
        {"kind": "identity", "ip": "1.1.1.1", "verdict": "impersonating", "rdns": "home.test"},
        "junk",
    ]
    write(src / "2026-01-01.jsonl", events)
    write(src / "2026-01-09.jsonl", events)
    empty = spark.createDataFrame([], sinks.MANIFEST)
    now = datetime(2026, 1, 9, 12)
    manifest = materialise(publish.publish(spark, f"{src}/*.jsonl*", str(dst), empty, key, "salt", now))
    assert {(r.stream, r.day, r.malformed, r.dropped, r.rows) for r in manifest.collect()} == {("events", "2026-01-01", 1, 1, 5)}
    out = [json.loads(x) for p in dst.rglob("*.gz") for x in gzip.open(p, "rt").read().splitlines()]
    whole = json.dumps(out)
    for hidden in (secret, trap, planted, planted.lower(), basic, "1.1.1.1", "9.9.9.9", "private", "home.test"):
        assert hidden not in whole
    by = {(e["kind"], e["rid"]): e for e in out}
    x, y = by["request", "x"], by["request", "y"]
    assert x["path"] == "/internal/notes/[beacon]/handover.html" and x["headers"][0] == ["Cookie", "[redacted]"] and x["headers"][1][1].endswith(", unknown") and x["headers"][2][1] == "B" * 26
    assert x["body"] is None and x["body_len"] == 7 and x["ip"].startswith("anon_")
    assert base64.b64decode(y["headers"][0][1][6:]) == b"u:[honeytoken]" and base64.b64decode(y["body"]) == b"\0[honeytoken]" and y["attacks"]
    assert by["credential", "x"]["password"] == "[redacted]" and by["credential", "y"]["password"] == "p"
    assert publish.publish(spark, f"{src}/*.jsonl*", str(dst), manifest, key, "salt", now).count() == 1
    # A run whose manifest was lost is repeated: the day is replaced, not added to; its entry describes the same files.
    (entry,) = manifest.collect()
    (again,) = publish.publish(spark, f"{src}/*.jsonl*", str(dst), empty, key, "salt", now).collect()
    assert again.rows == 5 and again.path.endswith("/stream=events/day=2026-01-01") and again.bytes == sum(p.stat().st_size for p in dst.rglob("*.gz"))
    assert sum(len(gzip.open(p, "rt").read().splitlines()) for p in dst.rglob("*.gz")) == 5 and len(entry.sha256) == 64
    # A day of junk alone leaves no file, and is done with; the earlier day stays as it is.
    (src / "2026-01-03.jsonl").write_text("junk\n")
    both = publish.publish(spark, f"{src}/*.jsonl*", str(dst), materialise(manifest), key, "salt", now)
    assert [(r.day, r.rows, r.malformed, r.path is None) for r in both.collect()] == [("2026-01-01", 5, 1, False), ("2026-01-03", 0, 1, True)]
    assert publish.publish(spark, f"{src}/*.jsonl*", str(dst), materialise(both), key, "salt", now).count() == 2
    # A Basic value of any length is searched to its end.
    far = base64.b64encode((f"u:{'x' * 200_000}{secret}").encode()).decode()
    write(src / "2026-01-04.jsonl", [{"kind": "request", "rid": "far", "path": "/", "headers": [["Authorization", f"Basic {far}"]]}])
    publish.publish(spark, f"{src}/*.jsonl*", str(dst), materialise(both), key, "salt", now)
    text = "".join(gzip.open(p, "rt").read() for p in (dst / "stream=events" / "day=2026-01-04").glob("*.gz"))
    assert text and secret not in base64.b64decode(text.split("Basic ")[1].split('"')[0]).decode() if "Basic " in text else text
