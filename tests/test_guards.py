import json

import pytest

from ledgerloom.functions import variant
from ledgerloom.operators import guards


def nested(n, value):
    """value inside n objects and arrays, one in the other."""
    for i in range(n):
        value = {"x": value} if i % 2 else [value]
    return value


PAYLOADS = [
    ({"a": [{"b_1": "Any value; here."}], "_": None}, "ok"), ([], "ok"), (3, "ok"), (nested(10, 1), "ok"), (nested(11, 1), "deep"), (nested(10, {}), "ok"), (nested(10, [1]), "deep"),
    ({"a b": 1}, "key"), ({"a": [[{"b.c": 1}]]}, "key"), ({"Name": 1}, "key"), ({"1a": 1}, "key"), ({"": 1}, "key"), ({"a\n": 1}, "key"), ({"é": 1}, "key"), (nested(9, {"B": 1}), "key"),
]


def test_payloads_in_a_table(spark):
    rows = [(i, json.dumps(p), v) for i, (p, v) in enumerate(PAYLOADS)] + [(100, "{", "unreadable"), (101, None, "unreadable"), (102, '{"a": 1, "a": 2}', "unreadable")]
    got = variant.payload_verdicts(spark.createDataFrame(rows, "i long, payload string, want string"), "payload")
    assert [(r.i, r.verdict) for r in got.where("verdict <> want").collect()] == []


def test_containment(spark):
    cases = [
        ({"a": 1}, {"a": 1.0, "b": 2}, True), ({"a": 1}, {"a": "1"}, True), ({"a": 1}, {"a": "one"}, False), ({"a": 1}, {"b": 1}, False), ({"a": "X  y"}, {"a": " x Y "}, True),
        ({"a": "12"}, {"a": 12}, True), ({"a": True}, {"a": True}, True), ({"a": True}, {"a": False}, False), ({"a": None}, {"a": None}, True), ({"a": None}, {}, False),
        ({"l": [{"p": 1}, {"p": 2}]}, {"l": [{"p": 1, "q": 9}, {"p": "2"}]}, True), ({"l": [{"p": 1}]}, {"l": [{"p": 1}, {"p": 1}]}, False), ({"l": []}, {"l": []}, True), ({"l": []}, {"l": {}}, False),
        ({"l": [{"p": 1}]}, {"l": [1]}, False), ({"o": {"x.1:y": {"z": 1}}}, {"o": {"x.1:y": {"z": 1}}}, True), ({"o": {}}, {"o": 3}, False), ({}, {"a": 1}, True), ({}, [1], False),
    ]
    rows = [(i, json.dumps(a), json.dumps(b), want) for i, (a, b, want) in enumerate(cases)] + [(100, "{}", "no", False), (101, None, "{}", False), (102, "{}", None, False)]
    got = variant.matches(spark.createDataFrame(rows, "i long, a string, b string, want boolean"), "a", "b")
    assert [(r.i, r.matches) for r in got.where("matches <> want").collect()] == []


def test_guards():
    for payload, verdict in PAYLOADS:
        if verdict == "ok":
            guards.check_payload(payload)
        else:
            with pytest.raises(ValueError, match="deep" if verdict == "deep" else "key"):
                guards.check_payload(payload)
    with pytest.raises(ValueError):
        guards.check_payload({1: 2})
    with pytest.raises(TypeError):
        guards.check_arguments(lambda a: a, {"b": 1})
    guards.check_arguments(lambda a: a, {"a": 1})
    assert guards.check_name("lens 12") == "lens 12"
    for bad in ("S00042", "P0007", "WH/IN/0001", "WH/INT/00001", "INV/2024/7"):
        with pytest.raises(ValueError):
            guards.check_name(bad)


def test_fixture_contract(spark):
    from ledgerloom.plans.details import missing_fields

    named = {"sale_order": ["name", "state", "delivery_status"], "quant": ["quantity"]}
    assert missing_fields(spark, "/root/testdata/sf0.001", named) == [("sale_order", "delivery_status")]
