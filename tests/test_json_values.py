import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linewright.functions import json_values as J

PARSER = J.StrictParser()


@pytest.mark.parametrize(
    "text",
    [
        "{'a':1}",
        '{"a":1} xx',
        '{"a":NaN}',
        "[Infinity]",
        '{"a":1,}',
        '["raw\ncontrol"]',
        r'["\ud800"]',
        "1e999",
        "9" * 400,
        "[" * 128 + "]" * 128,
        "[" * 100_000,
        "01",
        "not json {",
        "",
    ],
)
def test_rejected(text):
    with pytest.raises(ValueError):
        PARSER.parse(text)


@pytest.mark.parametrize(
    "text",
    ['{"a":1}', " [1] ", "5", '"x"', "null", "[" * 127 + "]" * 127, r'["\ud83d\ude00"]', "[" + "{}," * 500 + "1]"],
)
def test_accepted(text):
    PARSER.parse(text)


@pytest.mark.parametrize(
    "text, canonical",
    [
        ('{"b":1, "a":[1.0, 2.50]}', '{"a":[1.0,2.5],"b":1}'),
        ("[1e16,1e15,1.5e-7,0.00001,-0,1e2]", "[1e16,1000000000000000.0,1.5e-7,0.00001,-0.0,100.0]"),
        ("[18446744073709551615,18446744073709551616]", "[18446744073709551615,1.8446744073709552e19]"),
        (r'["é\/\u0001"]', '["é/\\u0001"]'),
        ('{"a":1,"a":2}', '{"a":2}'),
        ('{"z":1e20,"a":{"c":"x","b":[]}}', '{"a":{"b":[],"c":"x"},"z":1e20}'),
    ],
)
def test_canonical(text, canonical):
    assert PARSER.canonical(PARSER.parse(text)) == canonical


def test_pretty_with_and_without_delicate_numbers():
    assert PARSER.pretty(PARSER.parse('{"b":[],"a":[1,{"c":2}]}')) == (
        '{\n  "a": [\n    1,\n    {\n      "c": 2\n    }\n  ],\n  "b": []\n}'
    )
    assert PARSER.pretty(PARSER.parse('{"b":1e20,"a":[1]}')) == (
        '{\n  "a": [\n    1\n  ],\n  "b": 1e20\n}'
    )


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.text(max_size=12),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=6), inner, max_size=4),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(json_values)
def test_fix_is_idempotent_up_to_tags(value):
    first: list[str] = []
    once = J.fix_parsed(value, first)
    again: list[str] = []
    assert J.fix_parsed(once, again) == once
    assert again == []


@settings(max_examples=200, deadline=None)
@given(json_values)
def test_canonical_round_trip(value):
    PARSER.delicate = False
    text = PARSER.canonical(value)
    assert PARSER.parse(text) == value
    assert text == json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
