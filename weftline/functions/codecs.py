"""Exact byte layouts of the column encoders, one column of tokens at a time, with their inverses.

Each ``enc_*`` returns None where the tokens don't fit the encoding or would not come back byte by
byte (a minus zero, an impossible date, upper case in a UUID); the caller then takes another.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from datetime import datetime, timedelta, timezone

from .scalar import INT, ISO, UUID

_INT, _ISO, _UUID = re.compile(INT), re.compile(ISO), re.compile(UUID)
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
SEPARATOR = "\x01"


def put_varint(n: int) -> bytes:
    """Zigzag, then seven bits a byte, low bits first."""
    z, out = (n << 1) ^ (n >> 63) if n >= 0 else ((-n) << 1) - 1, bytearray()
    while z >= 128:
        out.append(z & 127 | 128)
        z >>= 7
    out.append(z)
    return bytes(out)


def get_varints(data: bytes) -> list[int]:
    out, z, shift = [], 0, 0
    for b in data:
        z |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(z >> 1 if not z & 1 else -((z + 1) >> 1))
            z, shift = 0, 0
    return out


def _deltas(values: list[int]) -> bytes:
    return b"".join(put_varint(b - a) for a, b in zip([0, *values], values, strict=False))


def _sums(data: bytes) -> list[int]:
    out, at = [], 0
    for d in get_varints(data):
        at += d
        out.append(at)
    return out


def enc_delta(tokens: list[str]) -> bytes | None:
    if not all(_INT.match(t) and str(int(t)) == t and -(2**62) < int(t) < 2**62 for t in tokens):
        return None
    return _deltas([int(t) for t in tokens])


def dec_delta(data: bytes) -> list[str]:
    return [str(n) for n in _sums(data)]


def enc_bitmap(tokens: list[str]) -> bytes | None:
    if not set(tokens) <= {"true", "false"}:
        return None
    out = bytearray(-(-len(tokens) // 8))
    for k, t in enumerate(tokens):
        out[k >> 3] |= (t == "true") << (k & 7)
    return struct.pack("<I", len(tokens)) + bytes(out)


def dec_bitmap(data: bytes) -> list[str]:
    n = struct.unpack_from("<I", data)[0]
    return ["true" if data[4 + (k >> 3)] >> (k & 7) & 1 else "false" for k in range(n)]


def _stamp(token: str) -> tuple[int, str, int] | None:
    if not _ISO.match(token):
        return None
    suffix = re.search('(Z|[+-][0-9]{2}:[0-9]{2})?"$', token)[1] or ""
    digits = re.search("[.]([0-9]+)", token)
    digits = digits[1] if digits else ""
    try:
        local = datetime.strptime(token[1:20], "%Y-%m-%dT%H:%M:%S").replace(tzinfo=timezone.utc)
    except ValueError:
        return None
    offset = 0 if suffix in ("", "Z") else (-1 if suffix[0] == "-" else 1) * (int(suffix[1:3]) * 60 + int(suffix[4:6]))
    if len(digits) > 6:
        return None
    return (local - _EPOCH) // timedelta(microseconds=1) + int((digits + "000000")[:6]) - offset * 60_000_000, suffix, len(digits)


def enc_timestamp(tokens: list[str]) -> bytes | None:
    found = [_stamp(t) for t in tokens]
    if not found or None in found or len({x[1:] for x in found}) > 1:
        return None
    _, suffix, digits = found[0]
    head = struct.pack("<IB6sBI", len(found), len(suffix), suffix.encode(), digits, 0)
    out = head + _deltas([x[0] for x in found])
    return out if dec_timestamp(out) == tokens else None


def dec_timestamp(data: bytes) -> list[str]:
    _, n, suffix, digits, _ = struct.unpack_from("<IB6sBI", data)
    suffix = suffix[:n].decode()
    offset = 0 if suffix in ("", "Z") else (-1 if suffix[0] == "-" else 1) * (int(suffix[1:3]) * 60 + int(suffix[4:6]))
    out = []
    for us in _sums(data[16:]):
        t = _EPOCH + timedelta(microseconds=us + offset * 60_000_000)
        out.append('"' + t.strftime("%Y-%m-%dT%H:%M:%S").rjust(19, "0") + (f".{t.microsecond:06d}"[: digits + 1] if digits else "") + suffix + '"')
    return out


def _put_text(t: str) -> bytes:
    raw = t.encode()
    return struct.pack("<I", len(raw)) + raw


def _get_text(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", data, at)[0]
    return data[at + 4 : at + 4 + n].decode(), at + 4 + n


def enc_enum(tokens: list[str]) -> bytes | None:
    values = [v for v, _ in sorted(Counter(tokens).items(), key=lambda x: (-x[1], x[0]))]
    if not values or len(values) > 255:
        return None
    code = {v: k for k, v in enumerate(values)}
    return bytes([len(values)]) + b"".join(map(_put_text, values)) + struct.pack("<I", len(tokens)) + bytes(code[t] for t in tokens)


def dec_enum(data: bytes) -> list[str]:
    at, values = 1, []
    for _ in range(data[0]):
        v, at = _get_text(data, at)
        values.append(v)
    n = struct.unpack_from("<I", data, at)[0]
    return [values[c] for c in data[at + 4 : at + 4 + n]]


def enc_string(tokens: list[str]) -> bytes | None:
    if not all(len(t) > 1 and t[0] == t[-1] == '"' for t in tokens):
        return None
    return struct.pack("<I", len(tokens)) + b"".join(_put_text(t[1:-1]) for t in tokens)


def dec_string(data: bytes) -> list[str]:
    at, out = 4, []
    for _ in range(struct.unpack_from("<I", data)[0]):
        v, at = _get_text(data, at)
        out.append(f'"{v}"')
    return out


def enc_uuid(tokens: list[str]) -> bytes | None:
    if not all(_UUID.match(t) and t == t.lower() for t in tokens):
        return None
    return struct.pack("<I", len(tokens)) + b"".join(bytes.fromhex(t.strip('"').replace("-", "")) for t in tokens)


def dec_uuid(data: bytes) -> list[str]:
    h = [data[k : k + 16].hex() for k in range(4, len(data), 16)]
    return [f'"{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}"' for x in h]


def enc_raw(tokens: list[str]) -> bytes | None:
    return None if any(SEPARATOR in t for t in tokens) else struct.pack("<I", len(tokens)) + SEPARATOR.join(tokens).encode()


def dec_raw(data: bytes) -> list[str]:
    return data[4:].decode().split(SEPARATOR) if struct.unpack_from("<I", data)[0] else []


def enc_prefixed(tokens: list[str]) -> bytes:
    """Tokens of any content, each with its length."""
    return struct.pack("<I", len(tokens)) + b"".join(map(_put_text, tokens))


def dec_prefixed(data: bytes) -> list[str]:
    at, out = 4, []
    for _ in range(struct.unpack_from("<I", data)[0]):
        v, at = _get_text(data, at)
        out.append(v)
    return out


CODECS = {
    "raw": (enc_raw, dec_raw), "delta_varint": (enc_delta, dec_delta), "bitmap": (enc_bitmap, dec_bitmap), "timestamp": (enc_timestamp, dec_timestamp),
    "enum": (enc_enum, dec_enum), "string": (enc_string, dec_string), "uuid": (enc_uuid, dec_uuid), "prefixed": (enc_prefixed, dec_prefixed),
}
#: Fixed order of the numbers that stand for encodings in files.
TAGS = ["raw", "delta_varint", "bitmap", "nulls", "timestamp", "enum", "string", "uuid", "prefixed"]


def encode_tokens(tokens: list[str], kind: str | None = None) -> tuple[str, bytes]:
    """(encoding, payload): the given encoding if it fits, else the smallest that does.

    Columns with null tokens keep a bitmap of the others and encode those alone.
    """
    if "null" in tokens and any(t != "null" for t in tokens):
        some = [t for t in tokens if t != "null"]
        bits = enc_bitmap(["true" if t != "null" else "false" for t in tokens])
        inner, payload = encode_tokens(some, kind)
        return "nulls", bytes([TAGS.index(inner)]) + struct.pack("<I", len(bits)) + bits + payload
    if kind and (p := CODECS[kind][0](tokens)) is not None and CODECS[kind][1](p) == tokens:
        return kind, p
    fits = [(len(p), TAGS.index(k), k, p) for k, (e, _) in CODECS.items() if (p := e(tokens)) is not None]
    for _, _, k, p in sorted(fits):
        if CODECS[k][1](p) == tokens:
            return k, p
    raise AssertionError("the prefixed encoding fits all tokens")


def decode_tokens(kind: str, payload: bytes) -> list[str]:
    if kind != "nulls":
        return CODECS[kind][1](payload)
    n = struct.unpack_from("<I", payload, 1)[0]
    some = iter(decode_tokens(TAGS[payload[0]], payload[5 + n :]))
    return [next(some) if p == "true" else "null" for p in dec_bitmap(payload[5 : 5 + n])]
