"""python -m weftline.cli compress|decompress|train-dict|bench|info"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from . import api
from .sources.frames import COMPARED, train_dictionary


def _read(path: str) -> bytes:
    return sys.stdin.buffer.read() if path == "-" else Path(path).read_bytes()


def _write(path: str, data: bytes) -> None:
    if path == "-":
        sys.stdout.buffer.write(data)
    else:
        Path(path).write_bytes(data)


def bench(folder: str, mode: str = "fast") -> list[dict]:
    """Sizes and times of every file of a folder, in the order of names, with a TOTAL row."""
    import zstandard

    rows = []
    for p in sorted(x for x in Path(folder).iterdir() if x.is_file()):
        data, t = p.read_bytes(), time.perf_counter()
        blob = api.compress(data, mode)
        took = time.perf_counter() - t
        if api.decompress(blob) != data:
            raise ValueError(f"{p}: not restored")
        rows.append({"file": p.name, "original": len(data), "compressed": len(blob), "zstd": len(zstandard.ZstdCompressor(level=COMPARED[mode]).compress(data)), "ms": took * 1000})
    rows.append({"file": "TOTAL"} | {k: sum(r[k] for r in rows) for k in ("original", "compressed", "zstd", "ms")})
    return [r | {"bpb": 8 * r["compressed"] / r["original"] if r["original"] else 0.0, "improvement_pct": 100 * (1 - r["compressed"] / r["zstd"]) if r["zstd"] else 0.0} for r in rows]


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="weftline")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress")
    c.add_argument("input")
    c.add_argument("-o", "--output", default="-")
    c.add_argument("-m", "--mode", choices=api.MODES, default="fast")
    c.add_argument("-f", "--format", choices=api.FORMATS)
    c.add_argument("-l", "--level", type=int)
    c.add_argument("--dict")
    c.add_argument("--chunk-rows", type=int)
    d = sub.add_parser("decompress")
    d.add_argument("input")
    d.add_argument("-o", "--output", default="-")
    d.add_argument("--dict")
    t = sub.add_parser("train-dict")
    t.add_argument("inputs", nargs="+")
    t.add_argument("-o", "--output", required=True)
    t.add_argument("--max-size", type=int, default=65536)
    b = sub.add_parser("bench")
    b.add_argument("folder")
    b.add_argument("-m", "--mode", choices=api.MODES, default="fast")
    b.add_argument("--save")
    i = sub.add_parser("info")
    i.add_argument("input")
    a = top.parse_args(argv)
    dictionary = Path(a.dict).read_bytes() if getattr(a, "dict", None) else None
    if a.command == "compress":
        data = _read(a.input)
        kind = a.format or (k if (k := api.detect_format(data)) != "generic" else api.detect_from_extension(a.input) or "generic")
        _write(a.output, api.compress(data, a.mode, kind, a.level, dictionary, a.chunk_rows))
    elif a.command == "decompress":
        _write(a.output, api.decompress(_read(a.input), dictionary))
    elif a.command == "train-dict":
        _write(a.output, train_dictionary([_read(p) for p in a.inputs], a.max_size))
    elif a.command == "bench":
        rows = bench(a.folder, a.mode)
        print("\n".join(json.dumps(r) for r in rows))
        if a.save:
            Path(a.save).write_text(json.dumps(rows, indent=1))
    else:
        print("\n".join(json.dumps(r) for r in api.info(_read(a.input))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
