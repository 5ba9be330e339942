import json
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from siltstone.functions import dynamic
from siltstone.functions.blake3 import hexdigest
from siltstone.functions.dynamic import Generation, Identity, flatten, names
from siltstone.functions.values import MAX_DEPTH, Pairs, StringIndex, TooDeep, canonical, canonical_attributes


@pytest.mark.parametrize(
    ("value", "text"),
    [
        (-2, "-2"), (True, "true"), (1.5, "1.5"), (2.0, "2.0"), (b"hi", '{"$bytes":"aGk="}'), (b"", '{"$bytes":""}'), ([1, "x", None, b"hi"], '[1,"x",null,{"$bytes":"aGk="}]'),
        (Pairs([("z", True), ("a", 1)]), '{"a":1,"z":true}'), (math.nan, '{"$float":"NaN"}'), (math.inf, '{"$float":"Infinity"}'), (-math.inf, '{"$float":"-Infinity"}'),
        ('a"b\\c\n日', '"a\\"b\\\\c\\n日"'), (StringIndex(3), "null"), (1e16, "1e16"), (1e-7, "1e-7"), (2.5e-5, "0.000025"), (Pairs([("k", 1), ("k", 2)]), '{"k":2}'),
    ],
)
def test_canonical(value, text):
    assert canonical(value) == text


def test_depth():
    value = []
    for _ in range(MAX_DEPTH - 1):
        value = [value]
    assert canonical(value).startswith("[[")
    with pytest.raises(TooDeep):
        canonical([value])


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=3) | st.lists(st.tuples(st.text(max_size=4), x), max_size=3).map(Pairs), max_leaves=12)


@given(VALUES)
def test_canonical_is_json_with_sorted_keys(value):
    text = canonical(value)
    loaded = json.loads(text, object_pairs_hook=lambda p: p if [k for k, _ in p] == sorted({k for k, _ in p}) else pytest.fail("order"))
    assert loaded is not pytest


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_read_back(x):
    assert float(canonical(x)) == x


def test_blake3_of_the_specification():
    assert hexdigest(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert hexdigest(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert len({hexdigest(bytes(n)) for n in (1023, 1024, 1025, 2049, 5000)}) == 5


HTTP = Pairs([("http", Pairs([("status", 200), ("request", Pairs([("id", "abc")]))]))])


@pytest.mark.parametrize(("depth", "columns"), [(0, {"log_http_json"}), (1, {"log_http_status_i64", "log_http_request_json"}), (2, {"log_http_status_i64", "log_http_request_id_string"})])
def test_depth_of_columns(depth, columns):
    assert set(names(flatten("log", HTTP, depth)).values()) == columns


def test_later_keys_replace():
    assert list(flatten("log", [("status", 1), ("status", "ok")], 4).items()) == [(Identity("log", ("status",), "string"), "ok")]
    assert set(flatten("log", [*HTTP, ("http", 7)], 4)) == {Identity("log", ("http",), "i64")}
    assert not flatten("log", [("a", None), ("b", StringIndex(1))], 4)


def test_collisions():
    both = [Identity("log", ("HTTP-Status",), "i64"), Identity("log", ("http_status",), "i64")]
    got = names(both)
    for i in both:
        message = bytes([3]) + (1).to_bytes(8, "big") + len(i.path[0]).to_bytes(8, "big") + i.path[0].encode() + bytes([2])
        assert got[i] == f"log_http_status_i64__{hexdigest(message)[:8]}"
    assert names(both[:1]) == {both[0]: "log_http_status_i64"}


def test_caps():
    found = flatten("log", [("c", 3), ("a", 1), ("b", 2)], 4)
    assert [i.path for i in dynamic.admitted_by_frame(found, 1)] == [("a",)]
    assert dynamic.admitted_by_frame(found, 0) == []
    g = Generation(2)
    g.admit([Identity("log", ("z",), "i64")])
    g.admit(found)
    assert [i.path[0] for i in g.admitted] == ["z", "a"]
