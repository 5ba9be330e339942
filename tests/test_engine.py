import json
import random
import threading
import time
import urllib.error
import urllib.request
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_store import END, HOUR, NEXT, START, request, rows_of

from siltstone import config
from siltstone.functions.values import Pairs
from siltstone.operators import encode
from siltstone.plans import gate
from siltstone.plans.engine import Engine, Limits, QueryError
from siltstone.sources.otlp import Record
from siltstone.sources.store import Store
from siltstone.streaming.janitor import Janitor
from siltstone.streaming.server import Service, serve


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    store = Store(spark, f"file://{tmp_path_factory.mktemp('corpus')}/store", "tenant-a")
    records = [
        Record(START, body="alpha", attributes=Pairs([("status", 10), ("latency", 1.5), ("payload", b"hi"), ("host", "web")])),
        Record(END, body="beta", attributes=Pairs([("status", 30), ("latency", 2.5)])),
        Record(NEXT, body="gamma", attributes=Pairs([("host", "api")])),
    ]
    store.publish(rows_of(spark, request(*records)), 0, 1)
    return store


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


CORPUS = [
    (f"SELECT body FROM logs WHERE event_time_unix_nano >= {END} ORDER BY wal_sequence", [["beta"], ["gamma"]], [("Utf8", True)]),
    ("SELECT wal_sequence FROM logs WHERE body = 'alpha'", [["0"]], [("UInt64", False)]),
    ("SELECT body, log_status_i64, log_latency_f64, log_payload_bytes FROM logs WHERE log_status_i64 = 10", [["alpha", "10", 1.5, "aGk="]], [("Utf8", True), ("Int64", True), ("Float64", True), ("Binary", True)]),
    ("SELECT body FROM logs WHERE log_host_string IS NULL ORDER BY wal_sequence", [["beta"]], [("Utf8", True)]),
    ("SELECT body AS message FROM logs ORDER BY event_time_unix_nano DESC LIMIT 1", [["gamma"]], [("Utf8", True)]),
    ("SELECT count(*) AS rows_counted FROM logs", [["3"]], [("Int64", False)]),
    ("SELECT body, count(*) AS rows_counted FROM logs GROUP BY body ORDER BY body", [["alpha", "1"], ["beta", "1"], ["gamma", "1"]], [("Utf8", True), ("Int64", False)]),
    ("SELECT sum(log_status_i64) AS total FROM logs", [["40"]], [("Int64", True)]),
    ("SELECT avg(log_latency_f64) AS mean FROM logs", [[2]], [("Float64", True)]),
    ("SELECT body, event_time_unix_nano FROM logs WHERE body = 'missing'", [], [("Utf8", True), ("UInt64", False)]),
]


@pytest.mark.parametrize(("sql", "rows", "types"), CORPUS)
def test_corpus(corpus, engine, sql, rows, types):
    r = engine.query(corpus, sql)
    got = json.loads(encode.encode(r.schema, r.rows, r.shown, r.nullable, r.metrics))
    assert sorted(list(x.values()) for x in got["rows"]) == rows
    assert [(c["type"], c["nullable"]) for c in got["schema"]] == types


@pytest.mark.parametrize("sql", ["", "  ", "SELECT 1; SELECT 2", "INSERT INTO logs VALUES (1)", "EXPLAIN SELECT 1", "CREATE TABLE x (a int)", "SET a=b", "SHOW TABLES", "DROP TABLE logs", "DESCRIBE logs", "SELECT * FROM other", "SELECT * FROM default.logs", "SELECT * FROM parquet.`/tmp`", "SELECT java_method('java.lang.Math','abs',-1)", "SELECT * FROM logs WHERE body IN (SELECT reflect('java.lang.Math','abs',-1))", "WITH a AS (SELECT * FROM secret) SELECT * FROM a", "SELECT nothing FROM logs"])
def test_rejected(corpus, engine, sql):
    with pytest.raises(QueryError) as e:
        engine.query(corpus, sql)
    assert e.value.code == "invalid_sql"


@pytest.mark.parametrize("sql", ["VALUES (1)", "SELECT 1;", "WITH a AS (SELECT body FROM logs) SELECT * FROM a UNION SELECT body FROM logs", "SELECT a.body FROM logs a JOIN logs b ON a.wal_sequence = b.wal_sequence", "SELECT body FROM logs WHERE wal_sequence = (SELECT max(wal_sequence) FROM logs)", "SELECT * FROM range(3)"])
def test_accepted(spark, sql):
    gate.check(spark, sql)


def test_limits(spark, corpus):
    with pytest.raises(QueryError) as e:
        Engine(spark, Limits(max_rows=2)).query(corpus, "SELECT body FROM logs")
    assert e.value.code == "row_limit"
    with pytest.raises(QueryError) as e:
        Engine(spark).query(corpus, "SELECT 1", timeout_s=0)
    assert e.value.code == "timeout"
    busy = Engine(spark, Limits(concurrent=1, timeout_s=1))
    busy.permits.acquire()
    with pytest.raises(QueryError) as e:
        busy.query(corpus, "SELECT 1")
    assert e.value.code == "busy"
    busy.permits.release()
    began = time.monotonic()
    with pytest.raises(QueryError) as e:
        Engine(spark, Limits(timeout_s=4)).query(corpus, "SELECT count(*) FROM range(100000000) a JOIN range(100000) b ON a.id % 7 <= b.id % 9")
    assert e.value.code == "timeout" and time.monotonic() - began < 60
    with pytest.raises(QueryError) as e:
        Engine(spark).query(corpus, "SELECT sum(a) FROM VALUES (9223372036854775807), (1) AS t(a)")
    assert e.value.code == "execution"


@pytest.fixture(scope="module")
def spread(spark, tmp_path_factory):
    """Four commits of one row each: three in the first hour, one in the second."""
    store = Store(spark, f"file://{tmp_path_factory.mktemp('spread')}/store", "tenant-a")
    for i, (t, k) in enumerate([(1, 1), (HOUR - 1, 2), (HOUR, 1), (2, 2)]):
        rows = rows_of(spark, request(Record(t, body=f"row-{i}", severity=9 * (i % 2), attributes=Pairs([("a", k)] if i < 3 else [("b", k)]))))
        store.publish(rows.withColumn("wal_sequence", F.lit(i).cast("bigint")), i, i + 1)
    return store


@pytest.mark.parametrize(
    ("where", "kept", "found"),
    [
        (f"event_time_unix_nano >= {HOUR}", 1, {2}), ("event_time_unix_nano > 1", 3, {1, 2, 3}), (f"event_time_unix_nano < {HOUR}", 3, {0, 1, 3}), (f"{HOUR} = event_time_unix_nano", 1, {2}), ("log_a_i64 = 1", 2, {0, 2}),
        ("log_a_i64 BETWEEN 2 AND 2", 1, {1}), ("log_a_i64 = 1 OR log_a_i64 = 2", 4, {0, 1, 2}), ("log_a_i64 IS NULL", 1, {3}), ("log_b_i64 = 2", 1, {3}), ("severity_number = 9", 2, {1, 3}), ("severity_number IS NULL", 2, {0, 2}),
        ("severity_number = 1", 0, set()), ("body = 'row-3' AND log_b_i64 < 3", 1, {3}), ("log_a_i64 <> 1", 4, {1}),
    ],
)
def test_prunes(engine, spread, where, kept, found):
    r = engine.query(spread, f"SELECT wal_sequence FROM logs WHERE {where}")
    assert {x[0] for x in r.rows} == found
    assert r.metrics["files_scanned"] == kept if "OR" not in where and "<>" not in where else r.metrics["files_scanned"] >= 1


@pytest.fixture(scope="module")
def narrow(spark, tmp_path_factory):
    """Two files whose bounds are each one value, in types that casts may change."""
    store = Store(spark, f"file://{tmp_path_factory.mktemp('narrow')}/store", "tenant-a")
    for i, (f, k) in enumerate([(0.1000000001, 300), (2.5, 7)]):
        rows = rows_of(spark, request(Record(1 + i, body=f"{i}x", attributes=Pairs([("f", f), ("k", k), ("s", str(k)), ("b", i == 0)]))))
        store.publish(rows.withColumn("wal_sequence", F.lit(i).cast("bigint")), i, i + 1)
    return store


TYPES = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL(5, 0)", "DECIMAL(20, 0)", "DECIMAL(21, 1)", "DECIMAL(4, 2)", "STRING", "BOOLEAN")


def test_casts_lose_no_row(spark, narrow):
    """Every predicate over a cast column finds in the pruned files what it finds in all."""
    engine, picks = Engine(spark), random.Random(3)
    columns = ("log_f_f64", "log_k_i64", "log_s_string", "log_b_bool", "body", "event_time_unix_nano", "severity_number")
    literals = ("0.1", "300", "'7'", "7", "2.5", "44", "true", "'1x'", "CAST(0.1 AS FLOAT)")
    with narrow.pin() as all_files:
        all_files.frame().createOrReplaceTempView("whole")
        tried = pruned = 0
        for _ in range(90):
            c = picks.choice(columns)
            to, how = picks.choice(TYPES), picks.choice(("TRY_CAST", "CAST"))
            e = c if picks.random() < 0.15 else f"{how}({c} AS {to})"
            where = f"{e} IS NULL" if picks.random() < 0.3 else f"{e} {picks.choice(('=', '<', '<=', '>', '>='))} {picks.choice(literals)}"
            try:
                expected = {r[0] for r in spark.sql(f"SELECT wal_sequence FROM whole WHERE {where}").collect()}
            except PySparkException:  # types that do not compare, or a cast that fails on some row
                continue
            df, files = None, None
            with narrow.pin() as snapshot:
                df, files = engine.plan(engine.session(), snapshot, f"SELECT wal_sequence FROM logs WHERE {where}")
                assert {r[0] for r in df.collect()} == expected, where
            tried, pruned = tried + 1, pruned + (len(files) < 2)
    assert tried > 35 and pruned > 2


def test_casts_that_prune(engine, narrow):
    def scanned(where):
        return engine.query(narrow, f"SELECT wal_sequence FROM logs WHERE {where}").metrics["files_scanned"]

    assert scanned("CAST(log_k_i64 AS DECIMAL(20, 0)) > 100") == 1 and scanned("log_k_i64 < 10") == 1
    assert scanned("TRY_CAST(body AS INT) IS NULL") == 2 and scanned("CAST(log_f_f64 AS FLOAT) = CAST(0.1 AS FLOAT)") == 2 and scanned("CAST(log_k_i64 AS DOUBLE) > 100") == 2


def test_resources(spark, spread):
    small = spark.newSession()
    r = Engine(small).query(spread, "SELECT body, count(*) AS n FROM logs CROSS JOIN range(100000) GROUP BY body ORDER BY body")
    assert len(r.rows) == 4 and r.metrics["memory_peak_bytes"] > 0 and r.metrics["spill_bytes"] >= 0


def test_newest(engine, spread):
    def run(sql):
        r = engine.query(spread, sql)
        return [x[0] for x in r.rows], r.metrics["files_scanned"]

    assert run("SELECT wal_sequence FROM logs ORDER BY event_time_unix_nano DESC, wal_sequence DESC LIMIT 1") == ([2], 1)
    assert run("SELECT wal_sequence FROM logs ORDER BY event_time_unix_nano LIMIT 1") == ([0], 4)
    assert run("SELECT t FROM (SELECT wal_sequence AS event_time_unix_nano, wal_sequence AS t FROM logs) ORDER BY event_time_unix_nano DESC LIMIT 1") == ([3], 4)
    assert run("SELECT body FROM logs WHERE event_time_unix_nano >= 1 ORDER BY event_time_unix_nano DESC LIMIT 1")[1] == 4


def test_encoding():
    import datetime as dt

    schema = T.StructType([
        T.StructField("a", T.LongType(), False), T.StructField("b", T.DoubleType()), T.StructField("c", T.DecimalType(10, 2)), T.StructField("d", T.ArrayType(T.StringType())), T.StructField("e", T.MapType(T.StringType(), T.LongType(), False)),
        T.StructField("f", T.StructType([T.StructField("x", T.BooleanType())])), T.StructField("g", T.TimestampType()), T.StructField("h", T.DateType()), T.StructField("i", T.StringType()),
    ])
    row = (2**62, float("nan"), Decimal("1.50"), ["x", None], {"k": 1}, (True,), dt.datetime(1970, 1, 1, 0, 0, 1, tzinfo=dt.UTC), dt.date(1970, 1, 3), "\x01\"é")
    got = json.loads(encode.encode(schema, [row]))
    assert got["rows"] == [{"a": str(2**62), "b": None, "c": "1.50", "d": ["x", None], "e": [{"key": "k", "value": "1"}], "f": {"x": True}, "g": "1000000", "h": "2", "i": "\x01\"é"}]
    assert [c["type"] for c in got["schema"]][2:5] == ["Decimal128(10, 2)", "List<nullable Utf8>", "Map<Utf8, Int64>"]
    assert encode.value(2.0, T.DoubleType()) == 2 and isinstance(encode.value(2.0, T.DoubleType()), int) and encode.value(7, T.LongType(), "UInt32") == 7
    with pytest.raises(encode.TooLarge):
        encode.encode(schema, [row], max_bytes=64)
    with pytest.raises(encode.Unsupported):
        encode.encode(T.StructType([T.StructField("v", T.VariantType())]), [])


TOML = """
wal_directory = "{0}/wal"
data_directory = "{0}/data"
listen = "127.0.0.1:0"
tokens = [{{token = "secret-a", tenant = "tenant-a"}}, {{token = "secret-b", tenant = "tenant-b"}}]
[retention]
default_ms = 0
tenants = {{tenant-a = 1}}
[ingest]
max_future_skew_ms = 1000
"""


def test_config(tmp_path):
    c = config.load(TOML.format(tmp_path))
    assert c.kept("tenant-a") == 1_000_000 and c.kept("tenant-b") is None and c.max_future_skew == 10**9
    for bad in ("x = 1", TOML.format("a") + "\n[query]\nmax_rows = 0", TOML.format("a").replace("tenant-a = 1", "nobody = 1"), TOML.format("a").replace("secret-b", "secret-a"), TOML.format("a").replace("secret-b", "a b"), "wal_directory = 'x'", TOML.format("a").replace("max_future_skew_ms", "other")):
        with pytest.raises(config.ConfigError):
            config.load(bad)


@pytest.fixture(scope="module")
def server(spark, tmp_path_factory):
    service = Service(spark, config.load(TOML.format(tmp_path_factory.mktemp("daemon"))))
    http = serve(service)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield service, f"http://127.0.0.1:{http.server_address[1]}"
    http.shutdown()
    service.stop()


def call(url, body=None, token="secret-a", kind="application/x-protobuf", method=None):
    headers = {"Content-Type": kind} | ({"Authorization": token if " " in token else f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method)) as r:
            return r.status, r.read(), r.headers
    except urllib.error.HTTPError as e:
        return e.code, e.read(), e.headers


def test_http(server):
    service, url = server
    assert call(f"{url}/live")[0] == 200 and call(f"{url}/ready")[0] == 503
    for token in ("", "wrong", "Basic secret-a", "Bearer  ", "Bearer secret-a x"):
        status, _, headers = call(f"{url}/v1/logs", b"", token)
        assert status == 401 and headers["WWW-Authenticate"] == "Bearer"
    now = time.time_ns()
    assert call(f"{url}/v1/logs", request(Record(10**18, body="old"), Record(now, body="new")))[0] == 200
    assert call(f"{url}/v1/logs", request(Record(body="b")), "secret-b", "Application/X-Protobuf; a=b")[0] == 200
    assert call(f"{url}/v1/logs", b"", kind="application/json")[0] == 415
    assert call(f"{url}/v1/logs", b"\xff\x00")[0] == 400
    status, body, _ = call(f"{url}/v1/logs", request(Record(2**64 - 1)))
    assert status == 400 and b"too far in the future" in body
    assert call(f"{url}/v1/logs")[0] == 405 and call(f"{url}/v1/traces", b"")[0] == 404

    def sql(text, token="secret-a", **options):
        status, body, _ = call(f"{url}/v1/query", json.dumps({"sql": text} | options).encode(), token, "application/json")
        return status, json.loads(body)

    # acknowledged rows are visible before they are published, and not twice after
    assert not service.stores["tenant-a"].commits
    assert [r["body"] for r in sql("SELECT body FROM logs ORDER BY body")[1]["rows"]] == ["new", "old"]
    service.publish_all()
    assert call(f"{url}/v1/logs", request(Record(10**18, body="third", attributes=Pairs([("late", 7)]))))[0] == 200
    got = sql(f"SELECT body, log_late_i64 AS late FROM logs WHERE event_time_unix_nano <= {10**18} ORDER BY body")[1]
    assert [(r["body"], r["late"]) for r in got["rows"]] == [("old", None), ("third", "7")] and got["metrics"]["files_pruned"] >= 1
    assert sql("SELECT body FROM logs ORDER BY event_time_unix_nano DESC, wal_sequence DESC LIMIT 2")[1]["rows"] == [{"body": "new"}, {"body": "third"}]
    service.publish_all()
    assert [r["body"] for r in sql("SELECT body FROM logs WHERE body <> 'third' ORDER BY body")[1]["rows"]] == ["new", "old"]
    assert sql("SELECT count(*) AS n FROM logs")[1]["rows"] == [{"n": "3"}]
    status, got = sql("SELECT body FROM logs WHERE body <> 'third' ORDER BY body")
    assert status == 200 and [r["body"] for r in got["rows"]] == ["new", "old"]
    assert [r["body"] for r in sql("SELECT body FROM logs", "secret-b")[1]["rows"]] == ["b"]
    for (text, options), code in {("SELECT nope FROM logs", ()): (400, "invalid_sql"), ("SELECT 1", (("timeout_ms", 0),)): (408, "timeout"), ("SELECT body FROM logs", (("max_rows", 1),)): (422, "row_limit"), ("SELECT 1", (("extra", 1),)): (400, "invalid_request"), ("SELECT parse_json('1') AS v", ()): (422, "unsupported_result_type")}.items():
        status, got = sql(text, **dict(options))
        assert (status, got["error"]["code"]) == code
    assert call(f"{url}/v1/query", b"x" * 70_000, kind="application/json")[0] == 400
    assert call(f"{url}/v1/query", b"{}", "wrong")[0] == 401
    assert call(f"{url}/v1/query", method="OPTIONS")[2]["Access-Control-Allow-Methods"] == "POST, OPTIONS"
    service.response_bytes = 64
    assert sql("SELECT body FROM logs")[1]["error"]["code"] == "response_too_large"
    service.response_bytes = 1 << 20
    time.sleep(0.01)
    gone = service.janitor.sweep()
    assert gone["tenant-a"] and not gone["tenant-b"] and call(f"{url}/ready")[0] == 200
    assert sql("SELECT count(*) AS n FROM logs")[1]["rows"] == [{"n": "0"}]


def test_janitor_is_not_ready_after_a_failure(tmp_path):
    class Broken:
        def retire_before(self, _):
            raise OSError

    j = Janitor(config.load(TOML.format(tmp_path)), {"tenant-a": Broken()})
    with pytest.raises(OSError):
        j.sweep()
    assert not j.ready
