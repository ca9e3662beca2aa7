"""One-machine interface on bytes and files: compress, decompress, info, detect_format.

A file is a run of frames. Each has a fixed header, the transform's description and a payload:

    frame := "WFT1" version mode format coder original compressed crc32 meta_size meta payload

The transform is a chain of steps. NDJSON and JSON arrays of objects are turned to columns: rows are
grouped by template, each group's columns are encoded by type, rows of small groups and lines that
don't parse stay as they are. In any JSON, keys that repeat can give way to numbers. A chain is used
only if its inverse gives the input back byte by byte.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

from .functions.codecs import TAGS, decode_tokens, encode_tokens
from .functions.context_coder import SETTINGS, cm_decode, cm_encode
from .operators.tokens import largest_array, parse_row
from .sources.frames import candidates, decoded

MAGIC, HEAD = b"WFT1", struct.Struct("<4sBBBBQQII")
MODES, FORMATS, CODERS = ["fast", "balanced", "max"], ["generic", "json", "ndjson"], ["raw", "zlib", "zstd", "zstd_dict", "cm", "zstd_trained"]
MIN_GROUP = {"ndjson": 5, "json": 3}
_SPACE = " \t\n\f\r"


def detect_format(data: bytes) -> str:
    """generic, json or ndjson."""
    text = data.decode("utf-8", "replace")
    if text.lstrip(_SPACE)[:1] not in ("{", "["):
        return "generic"
    lines = [x for x in (y.lstrip(_SPACE) for y in text.split("\n")) if x]
    return "ndjson" if len(lines) >= 2 and sum(x[0] == "{" for x in lines) > 0.8 * len(lines) else "json"


def detect_from_extension(path: str) -> str | None:
    m = re.search("[.]([^./]+)$", path)
    return {"json": "json", "ndjson": "ndjson", "jsonl": "ndjson"}.get(m[1].lower()) if m else None


def to_columns(rows: list[str], least: int) -> bytes:
    """Rows grouped by template, as encoded columns; all other rows kept as text."""
    groups: dict[tuple[str, ...], list[tuple[int, list[str]]]] = {}
    rest = []
    for k, row in enumerate(rows):
        parsed = parse_row(row)
        if parsed:
            groups.setdefault(tuple(parsed[0]), []).append((k, parsed[1]))
        else:
            rest.append((k, row))
    out, described = [], []
    for template, members in groups.items():
        if len(members) < least:
            rest += [(k, rows[k]) for k, _ in members]
            continue
        places = encode_tokens([str(k) for k, _ in members], "delta_varint")
        columns = [places, *(encode_tokens(list(c)) for c in zip(*(v for _, v in members), strict=True))]
        described.append({"t": template, "c": [[TAGS.index(kind), len(p)] for kind, p in columns]})
        out += [p for _, p in columns]
    meta = json.dumps({"n": len(rows), "g": described, "r": sorted(rest)}, separators=(",", ":"), ensure_ascii=False).encode()
    return struct.pack("<I", len(meta)) + meta + b"".join(out)


def from_columns(data: bytes) -> list[str]:
    n = struct.unpack_from("<I", data)[0]
    meta, at = json.loads(data[4 : 4 + n]), 4 + n
    rows: list[str] = [""] * meta["n"]
    for k, row in meta["r"]:
        rows[k] = row
    for group in meta["g"]:
        columns = []
        for tag, size in group["c"]:
            columns.append(decode_tokens(TAGS[tag], data[at : at + size]))
            at += size
        for k, *values in zip(*columns, strict=True):
            rows[int(k)] = "".join(p + v for p, v in zip(group["t"], [*values, ""], strict=True))
    return rows


_STRING = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:[ \t\r\n]*+:)?+', re.S)


def _interned(text: str) -> tuple[dict, str] | None:
    """(step, text with repeated keys as marked numbers); None where there is nothing to gain or a mark is in the text."""
    if "\x01" in text or "\x02" in text:
        return None
    keys = Counter(m[0][1 : m[0].rindex('"')] for m in _STRING.finditer(text) if m[0][-1] == ":")
    names = [k for k, n in sorted(keys.items(), key=lambda x: (-x[1], x[0])) if n > 1][:65535]
    if not names:
        return None
    number = {k: f"\x01{n}\x02" for n, k in enumerate(names)}

    def swap(m: re.Match) -> str:
        end = m[0].rindex('"')
        return number.get(m[0][1:end], m[0][: end + 1]) + m[0][end + 1 :] if m[0][-1] == ":" else m[0]

    return {"x": "keys", "k": names}, _STRING.sub(swap, text)


def chains(data: bytes, kind: str) -> list[tuple[list[dict], bytes]]:
    """(steps, transformed bytes) of the chains that give ``data`` back, the empty one among them."""
    out: list[tuple[list[dict], bytes]] = [([], data)]
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return out
    if kind == "ndjson":
        out.append(([{"x": "lines"}], to_columns(text.split("\n"), MIN_GROUP[kind])))
    if kind == "json" and (span := largest_array(text)) and len(span[2]) >= 5:
        e = span[2]
        body = to_columns([text[a:b] for a, b in e], MIN_GROUP[kind])
        out.append(([{"x": "array", "p": text[: e[0][0]], "s": [text[a[1] : b[0]] for a, b in zip(e, e[1:], strict=False)], "q": text[e[-1][1] :]}], body))
    if kind != "generic" and (swapped := _interned(text)):
        out.append(([swapped[0]], swapped[1].encode()))
    return [c for c in out if _inverse(*c) == data]


def _inverse(chain: list[dict], body: bytes) -> bytes:
    """Undo the steps of a chain, the last one first."""
    for step in reversed(chain):
        if step["x"] == "lines":
            body = "\n".join(from_columns(body)).encode()
        elif step["x"] == "array":
            body = (step["p"] + "".join(e + s for e, s in zip(from_columns(body), [*step["s"], ""], strict=True)) + step["q"]).encode()
        elif step["x"] == "keys":
            body = re.sub("\x01([0-9]+)\x02", lambda m: f'"{step["k"][int(m[1])]}"', body.decode()).encode()  # noqa: B023
        else:
            raise ValueError(f"unknown step {step['x']}")
    return body


def compress(data: bytes, mode: str = "fast", format: str | None = None, level: int | None = None, dictionary: bytes | None = None, chunk_rows: int | None = None) -> bytes:
    """The frames of ``data``; the smallest of the plain and the transformed candidates wins."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    kind = format or detect_format(data)
    if chunk_rows and kind == "ndjson":
        lines = data.split(b"\n")
        chunks = [b"\n".join(lines[k : k + chunk_rows]) + (b"\n" if k + chunk_rows < len(lines) else b"") for k in range(0, len(lines), chunk_rows)]
        return b"".join(compress(c, mode, kind, level, dictionary) for c in chunks if c)
    tries = []
    for chain, body in chains(data, kind):
        packed = zlib.compress(json.dumps(chain, separators=(",", ":"), ensure_ascii=False).encode(), 9) if chain else b""
        if mode == "fast":
            every = candidates(body, level, dictionary)
        else:
            every = [("cm", k, cm_encode(body, k)) for k in range(len(SETTINGS) if mode == "max" else 1)]
        tries += [(len(packed) + len(p), coder, packed, p) for coder, _, p in every]
    _, coder, packed, payload = min(tries, key=lambda x: x[:2])
    head = HEAD.pack(MAGIC, 1, MODES.index(mode), FORMATS.index(kind), CODERS.index(coder), len(data), len(payload), zlib.crc32(data), len(packed))
    return head + packed + payload


def _frames(blob: bytes):
    at = 0
    while at < len(blob):
        if len(blob) - at < HEAD.size:
            raise ValueError("a frame's header is cut short")
        magic, version, mode, kind, coder, size, compressed, crc, meta = HEAD.unpack_from(blob, at)
        if magic != MAGIC or version != 1:
            raise ValueError("not a frame of this version")
        begin = at + HEAD.size
        at = begin + meta + compressed
        if at > len(blob):
            raise ValueError("a frame is cut short")
        yield MODES[mode], FORMATS[kind], CODERS[coder], size, compressed, crc, blob[begin : begin + meta], blob[begin + meta : at]


def offsets(path: str) -> list[tuple[int, int]]:
    """(offset, size) of every frame of a file, from the headers alone."""
    out, at, end = [], 0, Path(path).stat().st_size
    with open(path, "rb") as f:
        while at < end:
            f.seek(at)
            head = f.read(HEAD.size)
            if len(head) < HEAD.size:
                raise ValueError("a frame's header is cut short")
            magic, version, _, _, _, _, compressed, _, meta = HEAD.unpack(head)
            if magic != MAGIC or version != 1:
                raise ValueError("not a frame of this version")
            out.append((at, HEAD.size + meta + compressed))
            at += out[-1][1]
    return out


def decompress(blob: bytes, dictionary: bytes | None = None) -> bytes:
    """The bytes of all frames; raises ValueError where a frame is damaged."""
    out = []
    for _, _, coder, size, _, crc, meta, payload in _frames(blob):
        try:
            body = cm_decode(payload) if coder == "cm" else decoded(coder, payload, dictionary)
            data = _inverse(json.loads(zlib.decompress(meta)), body) if meta else body
        except Exception as e:
            raise ValueError(f"a frame can't be decoded: {e}") from e
        if len(data) != size or zlib.crc32(data) != crc:
            raise ValueError("a frame's size or check sum differs")
        out.append(data)
    return b"".join(out)


def info(blob: bytes) -> list[dict]:
    """The header of every frame."""
    return [{"mode": m, "format": f, "coder": c, "original": n, "compressed": k, "crc32": crc, "ratio": n / k if k else 0.0} for m, f, c, n, k, crc, _, _ in _frames(blob)]


def compress_file(source: str, target: str, **options) -> dict:
    data = Path(source).read_bytes()
    kind = options.pop("format", None) or (detect_format(data) if detect_format(data) != "generic" else detect_from_extension(source) or "generic")
    blob = compress(data, format=kind, **options)
    Path(target).write_bytes(blob)
    return {"original": len(data), "compressed": len(blob)}


def decompress_file(source: str, target: str, dictionary: bytes | None = None) -> int:
    data = decompress(Path(source).read_bytes(), dictionary)
    Path(target).write_bytes(data)
    return len(data)
