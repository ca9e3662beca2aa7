"""Everything that is encoded comes back byte by byte."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import weftline
from weftline.functions import codecs
from weftline.functions.context_coder import cm_decode, cm_encode
from weftline.operators.tokens import array_spans, find_keys, largest_array, nested_members, parse_row

TOKENS = st.one_of(
    st.integers(-(2**70), 2**70).map(str), st.sampled_from(["true", "false", "null", "-0", "1.50", "[]", "{}", '"2024-02-31T00:00:00Z"', '"0099-01-01T00:00:00"', '"123E4567-e89b-12d3-a456-426614174000"']),
    st.text(max_size=8).map(json.dumps), st.datetimes().map(lambda d: f'"{d.isoformat()}Z"'), st.uuids().map(lambda u: f'"{u}"'), st.text(max_size=4),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(TOKENS, max_size=30))
def test_any_column(tokens):
    kind, payload = codecs.encode_tokens(tokens)
    assert codecs.decode_tokens(kind, payload) == tokens


@pytest.mark.parametrize(
    "kind,tokens",
    [("delta_varint", ["1", "-5", str(2**53), str(-(2**53))]), ("bitmap", ["true", "false"] * 9), ("timestamp", ['"2024-01-01T00:00:00.500+02:00"', '"2024-01-01T00:00:01.250+02:00"']),
     ("enum", ['"a"', '"b"', "[1]"]), ("string", ['"x"', '""']), ("uuid", ['"123e4567-e89b-12d3-a456-426614174000"'])],
)
def test_each_encoding_applies(kind, tokens):
    assert codecs.encode_tokens(tokens, kind)[0] == kind


def test_enum_holds_at_most_255_values():
    assert codecs.enc_enum([f'"{k}"' for k in range(255)]) and codecs.enc_enum([f'"{k}"' for k in range(256)]) is None


@given(st.lists(st.integers(-(2**62), 2**62)))
def test_varints(values):
    assert codecs.get_varints(b"".join(map(codecs.put_varint, values))) == values


JSON = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=6)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=4), x, max_size=3)), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=5), JSON, min_size=1, max_size=5), st.sampled_from([None, 1]))
def test_rows_rebuild(value, indent):
    line = json.dumps(value, indent=indent)
    parts, values = parse_row(line)
    assert "".join(p + v for p, v in zip(parts, [*values, ""], strict=True)) == line
    assert [json.loads(v) for v in values] == list(value.values())
    assert [k for k, _ in nested_members(line)] == [json.dumps(k)[1:-1] for k in value]


def test_scanners():
    assert parse_row("x") is parse_row("") is parse_row(None) is parse_row('{"a":1') is None
    assert parse_row('{"a": 1}tail')[0] == ['{"a": ', "}tail"]
    assert find_keys('{"a":"\\"b\\":1","c":{"d" : "e"}}') == ["a", "c", "d"]
    text = '{"x":[1,{"a":1}],"y":[{"a":[{"b":1},{"b":2}]},{"a":2}],"z":[{"q":1},{"q":2},{"q":3}]}'
    assert [len(s[2]) for s in array_spans(text)] == [2, 2, 3]
    assert text[largest_array(text)[0]:].startswith('[{"q":1}')


def _lines(kind: int, n: int) -> bytes:
    r = random.Random(kind)
    make = [
        lambda i: {"any": r.choice([1, True, None, "s", 1.5, [1]]), "no": i}, lambda i: {"when": r.choice([i, 946684800 + i, 946684799 - i]), "no": i},
        lambda i: {"id": i, "meta": {k: i for k in r.sample("abc", r.randint(1, 3))}}, lambda i: {"items": [{"x": i}], "id": i}, lambda i: {"x": 1},
        lambda i: {"name": r.choice(["é", "日本", "\U0001F600"]), "id": i}, lambda i: {"log": 'a"b\\c\n', "q": "\u0001", "id": i}, lambda i: {"f": r.choice([1e300, -0.0, 1e-7]), "i": i},
        lambda i: {f"c{k}": None if r.random() < 0.8 else k for k in range(20)}, lambda i: [{"type": "a", "x": i}, {"type": "b", "count": i, "active": True}, {"type": "c", "data": {}, "meta": None}][i % 3],
        lambda i: {"id": i, "meta": {"x": i} if i % 3 else {"x": i, "y": None}}, lambda i: {"a": {"b": {"c": {"d": {"e": i}}}}}, lambda i: {f"b{k}": r.random() < 0.5 for k in range(10)},
        lambda i: {"ts1": f"2024-01-01T00:00:{i % 60:02d}Z", "ts2": f"2024-01-01T00:00:{i % 60:02d}+00:00"}, lambda i: {"session": f"{r.getrandbits(64):x}", "id": i}, lambda i: {"data": [], "tags": [], "id": i},
    ]
    return "\n".join(json.dumps(make[kind](i), ensure_ascii=i % 2 == 0) for i in range(n)).encode()


@pytest.mark.parametrize("kind", range(16))
def test_adversarial_lines(kind):
    data = _lines(kind, 200)
    for mode, part in (("fast", data), ("balanced", data[:700]), ("max", data[:200])):
        assert weftline.decompress(weftline.compress(part, mode)) == part


@pytest.mark.parametrize("data", [b"", b"x", b"\xff" * 256, bytes(range(256)), b"A" * 65536, b"\n\n", b'{"a":1}\n\n{"a":2}\n' * 9, b'{"d":[' + b", ".join([b'{"a":1}'] * 7) + b'],"m":{}}'])
def test_bytes(data):
    assert weftline.decompress(weftline.compress(data)) == data
    assert weftline.decompress(weftline.compress(data) * 2) == data * 2


def test_damage_is_found():
    blob = bytearray(weftline.compress(_lines(4, 50)))
    blob[-1] ^= 1
    with pytest.raises(ValueError):
        weftline.decompress(bytes(blob))
    with pytest.raises(ValueError):
        weftline.decompress(b"NOPE" + bytes(blob[4:]))
    with pytest.raises(ValueError):
        weftline.decompress(bytes(blob[:-3]))


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=120))
def test_context_coder(data):
    assert cm_decode(cm_encode(data)) == data


def test_formats_and_sizes():
    assert weftline.detect_format(b' {"a":1}') == "json" and weftline.detect_format(b'{"a":1}\n{"a":2}') == "ndjson" and weftline.detect_format(b"a,b") == "generic"
    data = _lines(13, 400)
    assert len(weftline.compress(data)) < len(data) / 10
    ids = [f'"{k:08x}-0000-0000-0000-000000000000"' for k in range(100)]
    assert len(codecs.encode_tokens(ids, "uuid")[1]) == 4 + 1600


def test_cli(tmp_path):
    from weftline.cli import main

    source, packed, back = tmp_path / "a.ndjson", tmp_path / "a.wft", tmp_path / "b"
    source.write_bytes(_lines(2, 300))
    assert main(["compress", str(source), "-o", str(packed), "--chunk-rows", "100"]) == 0
    assert main(["decompress", str(packed), "-o", str(back)]) == 0 and back.read_bytes() == source.read_bytes()
    assert main(["info", str(packed)]) == 0
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "x").write_bytes(_lines(4, 50))
    assert main(["bench", str(folder), "--save", str(tmp_path / "r.json")]) == 0 and json.loads((tmp_path / "r.json").read_text())[-1]["file"] == "TOTAL"
    d = tmp_path / "dict"
    assert main(["train-dict", str(source), "-o", str(d), "--max-size", "2000"]) == 0
    assert main(["compress", str(source), "-o", str(packed), "--dict", str(d)]) == 0
    assert main(["decompress", str(packed), "-o", str(back), "--dict", str(d)]) == 0 and back.read_bytes() == source.read_bytes()


def test_repeated_keys_give_way_to_numbers():
    from weftline import api

    text = json.dumps({"deep": [{"name": k, "deep": {"name": "x:", "other": "name"}} for k in range(40)], "odd": [1, "\u00e9"]}, ensure_ascii=False).encode()
    steps = [c for c, _ in api.chains(text, "json")]
    assert [[s["x"] for s in c] for c in steps] == [[], ["array"], ["keys"]]
    assert all(api._inverse(c, b) == text for c, b in api.chains(text, "json"))
    assert [c for c, _ in api.chains(b'{"a\x01": 1, "b": 2, "b": 3}', "json")] == [[]]


def test_frames_with_a_dictionary_of_their_own():
    from weftline.sources.frames import trained, untrained

    data = "\n".join(f"line {k % 70} of some log with words {k * 7919 % 1000}" for k in range(2000)).encode()
    assert untrained(trained(data, 19)) == data and trained(data[:8000], 19) is None and trained(b"x" * 9000, 19) is None
