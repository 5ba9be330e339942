import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions.values import Pairs
from siltstone.operators import project, prune
from siltstone.sources import frames, otlp
from siltstone.sources.otlp import Record, Resource, Scope
from siltstone.sources.store import Conflict, Damaged, Store, opened, sealed
from siltstone.streaming.ingest import Behind, Ingest

START, END, NEXT = 1_699_999_200_000_000_000, 1_700_002_799_999_999_999, 1_700_002_800_000_000_000
HOUR = 3_600_000_000_000


def request(*records, resource=(), scope=()):
    return otlp.encode([Resource(Pairs(resource), [Scope(Pairs(scope), list(records))])])


def frames_of(spark, *payloads, received=NEXT):
    rows = [(i, "tenant-a", received + i, 1, p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "wal_sequence bigint, tenant_id string, received_time_unix_nano bigint, signal int, payload binary")


def rows_of(spark, *payloads, **options):
    found = frames_of(spark, *payloads)
    return project.project(found, project.discover(found, **options)).orderBy("wal_sequence", "record_index")


def test_fixed_columns(spark):
    tags = Pairs([("tags", [1, "x", None, b"hi"]), ("ok", True), ("msg", 'a"b\\c\n日'), ("n", 3), ("raw", b"hi")])
    first = Resource(Pairs([("zone", "eu"), ("service.name", "api"), ("tenant.id", "attacker")]), [Scope(Pairs([("lib", "probe")]), [
        Record(END, START, 9, "INFO", 'say "hi"\\日\n', tags, b"\x11" * 16, b"\x22" * 8), Record(NEXT, 0, 13, "WARN", "later-hour"), Record(0, START, body="", trace_id=bytes(16), span_id=bytes(8)),
    ])])
    second = Resource(Pairs(), [Scope(Pairs(), [Record(severity=1, severity_text=" ", span_id=b"1234567"), Record(NEXT, body=otlp.StringIndex(4), attributes=Pairs([("missing", None)]), trace_id=b"1" * 17, span_id=b"1" * 9)])])
    a, b, c, d, e = rows_of(spark, otlp.encode([first, second])).collect()
    assert (a.event_time_unix_nano, a.tenant_id, a.service_name, a.observed_time_unix_nano) == (END, "tenant-a", "api", START)
    assert a.resource_attributes == '{"service.name":"api","tenant.id":"attacker","zone":"eu"}'
    assert a.log_attributes == '{"msg":"a\\"b\\\\c\\n日","n":3,"ok":true,"raw":{"$bytes":"aGk="},"tags":[1,"x",null,{"$bytes":"aGk="}]}'
    assert (bytes(a.trace_id), bytes(a.span_id), a.log_n_i64, bytes(a.log_raw_bytes)) == (b"\x11" * 16, b"\x22" * 8, 3, b"hi")
    assert (b.log_attributes, b.trace_id, b.severity_text) == ("{}", None, "WARN")
    assert (c.time_unix_nano, c.event_time_unix_nano, c.body, c.trace_id, c.span_id) == (None, START, "", None, None)
    assert (d.event_time_unix_nano, d.severity_text, d.body, d.span_id, d.service_name, d.resource_attributes) == (NEXT, " ", None, None, None, "{}")
    assert (e.body, e.trace_id, e.span_id, e.log_attributes, e.record_index) == (None, None, None, '{"missing":null}', 4)


def test_caps_follow_names_then_arrival(spark):
    two = [request(Record(START, attributes=Pairs([("z", 1)]))), request(Record(START, attributes=Pairs([("c", 3), ("a", 1), ("b", 2)])))]
    found = frames_of(spark, *two)
    assert [i.path[0] for i in project.discover(found, max_columns=3)] == ["z", "a", "b"]
    assert [i.path[0] for i in project.discover(found, max_columns=1)] == ["z"]
    assert project.discover(found, max_columns=0) == []


def test_skew():
    with pytest.raises(otlp.FutureTimestamp):
        otlp.accept(request(Record(START + otlp.DAY + 1)), START)
    assert otlp.accept(request(Record(START + otlp.DAY), Record(observed=1)), START)[0] == START
    with pytest.raises(otlp.FutureTimestamp):
        otlp.accept(request(Record(2**64 - 1)), START)
    for bad in (b"\xff\x00", b"\x0a\x05a", b"\x0a\x02\x12\x09"):
        with pytest.raises(otlp.InvalidRequest):
            otlp.decode(bad)


SIMPLE = st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False) | st.text(max_size=5) | st.binary(max_size=5)


@given(st.lists(st.tuples(st.text(max_size=4), SIMPLE | st.lists(SIMPLE, max_size=3) | st.lists(st.tuples(st.text(max_size=3), SIMPLE), max_size=3).map(Pairs)), max_size=4).map(Pairs), st.integers(0, 2**64 - 1), st.integers(-(2**31), 2**31 - 1))
def test_wire_format_reads_back(attributes, time, severity):
    r = Record(time, 5, severity, "x", attributes, attributes, b"a", b"b")
    got = otlp.decode(otlp.encode([Resource(attributes, [Scope(Pairs(), [r])])]))[0]
    assert got.attributes == attributes and got.scopes[0].records == [r]


def test_frames(tmp_path):
    w = frames.Writer(tmp_path, "t", segment_bytes=100)
    for i in range(6):
        assert w.append(i, b"x" * 30) == i
    w.close()
    assert len(frames.segments(tmp_path)) == 6
    assert [f.sequence for f in frames.read_from(tmp_path, 2, 5)] == [2, 3, 4]
    last = frames.segments(tmp_path)[-1][1]
    last.write_bytes(last.read_bytes()[:-3])
    assert frames.next_sequence(tmp_path) == 5  # a torn tail
    w = frames.Writer(tmp_path, "t")
    assert w.append(9, b"y") == 5
    w.close()
    first = frames.segments(tmp_path)[0][1]
    good = first.read_bytes()
    first.write_bytes(good[:-1] + b"?")
    with pytest.raises(frames.Corrupt):
        list(frames.read_from(tmp_path))
    first.write_bytes(good)
    assert len(frames.retain(tmp_path, 3)) == 3
    assert [f.sequence for f in frames.read_from(tmp_path, 3)] == [3, 4, 5]
    frames.segments(tmp_path)[1][1].unlink()
    with pytest.raises(frames.Corrupt):
        list(frames.read_from(tmp_path, 3))
    c = frames.Checkpoint(tmp_path)
    c.commit(4)
    with pytest.raises(ValueError):
        c.commit(3)
    with pytest.raises(frames.Busy):
        frames.Writer(tmp_path / "q", "t", queue_bytes=10).append(1, b"x" * 11)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", "tenant-a")


def test_publish_pin_restart(spark, store):
    rows = rows_of(spark, request(Record(START, body="a"), Record(NEXT, body="b", attributes=Pairs([("k", 1)]))))
    commit = store.publish(rows, 0, 1)
    assert [f["rows"] for f in commit["files"]] == [1, 1] and store.publish(rows, 0, 1) is commit
    with pytest.raises(Conflict):
        store.publish(rows, 2, 3)
    with store.pin() as before:
        store.publish(rows.withColumn("wal_sequence", F.lit(1).cast("bigint")).drop("log_k_i64").withColumn("log_j_string", F.lit("x")), 1, 2)
        assert before.frame().count() == 2
    again = Store(spark, store.files.root, "tenant-a")
    for s in (store, again):
        got = s.pin()
        assert got.schema.names[-2:] == ["log_j_string", "log_k_i64"] and s.next == 2
        rows = {(r.body, r.log_k_i64, r.log_j_string) for r in got.frame().collect()}
        assert rows == {("a", None, None), ("b", 1, None), ("a", None, "x"), ("b", None, "x")}
    assert again.pin().scan(["body"], NEXT, NEXT).count() == 2
    with pytest.raises(KeyError):
        again.pin().scan(["nothing"])


def test_rows_lie_newest_first_in_a_file(spark, store):
    times = [START + (i * 7919) % 1000 for i in range(200)]
    rows = rows_of(spark, request(*(Record(t, body=str(t)) for t in times))).repartition(3)
    commit = store.publish(rows, 0, 1)
    for f in commit["files"]:
        got = [r[0] for r in spark.read.parquet(f"{store.files.root}/{f['path']}").select("event_time_unix_nano").coalesce(1).collect()]
        assert got == sorted(got, reverse=True) and len(got) == f["rows"]


def test_recovery(spark, store):
    rows = rows_of(spark, request(Record(START, body="a")))
    store.publish(rows, 0, 1)
    files = store.files
    name = files.names("commits")[0]
    files.write("commits/00000000000000000001-00000000000000000002.json", "{}")
    files.write("data/date=2023-11-14/hour=22/stray.parquet", "x")
    again = Store(spark, files.root, "tenant-a")
    assert again.next == 1 and [n for n in files.names("commits") if n.endswith(".json")] == [name]
    assert not files.exists("data/date=2023-11-14/hour=22/stray.parquet")
    assert again.pin().frame().count() == 1
    files.write("retired/1.json", "{}")
    with pytest.raises(Damaged):
        Store(spark, files.root, "tenant-a")
    with pytest.raises(Damaged):
        opened(sealed({"a": 1}).replace('"a": 1', '"a": 2'))


@pytest.mark.parametrize("step", ["move", "write", "statistics"])
def test_a_failed_publication_shows_nothing_and_can_be_repeated(spark, store, monkeypatch, step):
    rows = rows_of(spark, request(Record(START, body="a"), Record(NEXT, body="b")))
    owner = store if step == "statistics" else store.files
    good = getattr(owner, step)

    def fail(*args):
        raise OSError("disk")

    monkeypatch.setattr(owner, step, fail)
    with pytest.raises(OSError):
        store.publish(rows, 0, 1)
    monkeypatch.setattr(owner, step, good)
    assert store.pin().frame().count() == 0 and store.next == 0
    store.publish(rows, 0, 1)
    again = Store(spark, store.files.root, "tenant-a")
    assert again.pin().frame().count() == 2 and {f["path"] for f in again.commits[0]["files"]} == {x for x in again.files.walk("data") if x.endswith(".parquet")}


def test_retention(spark, store):
    for i, received in enumerate((START, NEXT)):
        store.publish(rows_of(spark, request(Record(10**18, body=str(i)))).withColumns({"wal_sequence": F.lit(i).cast("bigint"), "received_time_unix_nano": F.lit(received)}), i, i + 1)
    assert store.retire_before(START) == []  # strictly before
    held = store.pin()
    gone = store.retire_before(START + 1)
    assert len(gone) == 1 and store.collect_retired() == []
    assert [r.body for r in store.pin().frame().collect()] == ["1"] and held.frame().count() == 2
    held.close()
    assert store.collect_retired() == gone
    assert [r.body for r in Store(spark, store.files.root, "tenant-a").pin().frame().collect()] == ["1"]


def test_ingest(spark, store, tmp_path):
    w = frames.Writer(tmp_path / "wal", "tenant-a")
    for i in range(3):
        w.append(NEXT, request(Record(START + i, body=f"row-{i}", attributes=Pairs([(f"k{i}", i)]))))
    ingest = Ingest(spark, str(tmp_path / "wal"), store)
    ingest.start(str(tmp_path / "state")).awaitTermination()
    assert store.next == 3 and ingest.checkpoint.load() == 3
    w.append(NEXT, request(Record(NEXT, body="row-3")))
    batch = ingest.read()
    ingest.publish(batch)
    ingest.publish(batch)  # as after a crash
    ingest.run_once()
    w.append(NEXT, otlp.encode([]))  # a frame without records
    ingest.run_once()
    rows = Store(spark, store.files.root, "tenant-a").pin().frame()
    assert sorted(r.body for r in rows.collect()) == ["row-0", "row-1", "row-2", "row-3"] and store.next == 5
    assert {"log_k0_i64", "log_k1_i64", "log_k2_i64"} <= set(rows.columns)
    w.close()
    with pytest.raises(Behind):
        Ingest(spark, str(tmp_path / "wal"), Store(spark, f"file://{tmp_path}/empty", "tenant-a"))


def test_generations(spark, store, tmp_path):
    w = frames.Writer(tmp_path / "wal", "tenant-a", segment_bytes=400)
    for i in range(5):
        w.append(NEXT, request(Record(START + i, body="x" * 100)))
    size = len(frames.packed(frames.Frame(0, NEXT, "tenant-a", request(Record(START, body="x" * 100))))) - frames.HEAD.size
    assert [frames.generation_end(tmp_path / "wal", i, 2 * size) for i in (0, 3, 5)] == [3, 5, 5]  # the frame that crosses is in
    Ingest(spark, str(tmp_path / "wal"), store, max_bytes=2 * size).run_once()
    assert [(c["first"], c["next"], c["rows"]) for c in store.commits] == [(0, 3, 3), (3, 5, 2)]


def test_a_stream_takes_a_generation_at_a_time(spark, store, tmp_path):
    w = frames.Writer(tmp_path / "wal", "tenant-a", segment_bytes=400)
    for i in range(5):
        w.append(NEXT, request(Record(START + i, body="x" * 100)))
    size = len(frames.packed(frames.Frame(0, NEXT, "tenant-a", request(Record(START, body="x" * 100))))) - frames.HEAD.size
    ingest = Ingest(spark, str(tmp_path / "wal"), store, max_bytes=2 * size)
    stream = ingest.start(str(tmp_path / "state"), interval_ms=100)
    deadline = time.monotonic() + 60
    while store.next < 5 and time.monotonic() < deadline:
        time.sleep(0.2)
    stream.stop()
    assert [(c["first"], c["next"], c["rows"]) for c in store.commits] == [(0, 3, 3), (3, 5, 2)]
    for i in range(5):
        w.append(NEXT, request(Record(START + i, body="x" * 100)))
    ingest.start(str(tmp_path / "state2")).awaitTermination()  # all there is, in generations too
    assert [(c["first"], c["next"]) for c in store.commits] == [(0, 3), (3, 5), (5, 8), (8, 10)]


def test_next_sequence_reads_what_is_new(tmp_path, monkeypatch):
    w = frames.Writer(tmp_path, "t")
    seen = []
    good = frames.read_segment
    monkeypatch.setattr(frames, "read_segment", lambda path, last, at=0: (seen.append(at), good(path, last, at))[1])
    for i in range(3):
        w.append(1, b"x" * 10)
        assert frames.next_sequence(tmp_path) == i + 1
    assert seen[0] < seen[1] < seen[2]
    with (tmp_path / f"{0:020d}.frames").open("ab") as f:
        f.write(b"SLF1 torn")
    assert frames.next_sequence(tmp_path) == 3


# Pruning ------------------------------------------------------------------

COLUMN = {"nulls": 0, "rows": 2, "min": 5, "max": 9}


@pytest.mark.parametrize(
    ("predicate", "skipped"),
    [
        (("=", "c", 4), True), (("=", "c", 5), False), (("=", "c", 10), True), ((">", "c", 9), True), ((">", "c", 8), False), ((">=", "c", 9), False), ((">=", "c", 10), True),
        (("<", "c", 5), True), (("<=", "c", 5), False), (("<=", "c", 4), True), (("between", "c", 7, 6), True), (("between", "c", 1, 4), True), (("between", "c", 1, 5), False),
        (("null", "c"), True), (("null", "absent"), False), (("=", "absent", 1), True), (("=", "c", "4"), False), (("=", "c", 4.0), False), (None, False),
        (("and", ("=", "c", 5), ("=", "c", 4)), True), (("=", "c", float("nan")), False), (("=", "blank", 1), True), (("=", "boundless", 1), False),
    ],
)
def test_skips(predicate, skipped):
    columns = {"c": COLUMN, "blank": {"nulls": 2, "rows": 2}, "boundless": {"nulls": 0, "rows": 2}}
    assert prune.skips(predicate, columns) is skipped
    assert not prune.skips(predicate, None)


def made(times):
    return {"path": str(times), "rows": len(times), "hour": min(times) // HOUR * HOUR, "event_min": min(times), "event_max": max(times), "columns": {"event_time_unix_nano": {"nulls": 0, "rows": len(times), "min": min(times), "max": max(times)}}, "times": times}


FILES = st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(0, 20), min_size=1, max_size=4)).map(lambda x: made([x[0] * HOUR + t for t in x[1]])), max_size=6)
CONDITION = st.tuples(st.sampled_from(["=", "<", "<=", ">", ">="]), st.just("event_time_unix_nano"), st.integers(0, 3).flatmap(lambda h: st.integers(-1, 21).map(lambda t: h * HOUR + t)))
MEETS = {"=": int.__eq__, "<": int.__lt__, "<=": int.__le__, ">": int.__gt__, ">=": int.__ge__}


@given(FILES, st.lists(CONDITION, max_size=3))
@settings(max_examples=300)
def test_pruning_loses_no_row(files, conditions):
    def rows(some):
        return sorted(t for f in some for t in f["times"] if all(MEETS[op](t, x) for op, _, x in conditions))

    assert rows(prune.prune(files, conditions)) == rows(files)


@given(FILES, st.integers(1, 8))
def test_newest_loses_no_row(files, limit):
    def top(some):
        return sorted((t for f in some for t in f["times"]), reverse=True)[:limit]

    assert top(prune.newest(files, limit)) == top(files)
