"""A bit-level context-mixing coder for one frame.

Many models predict the next bit, each from another context: the last 1 to 9 bytes, words, bytes with
gaps, the place in a JSON text, the column, runs, what followed a context the last time, and the longest
earlier match. Their predictions are mixed by online logistic regression, in several mixers whose
weights are chosen by different small contexts, a last mixer weighs those, and two calibration tables
correct the outcome. An arithmetic coder writes the bits.

The coder is a strict fold over bits, slow by nature, and meant for small frames; frames run in
parallel. All of its arithmetic is on whole numbers, so a frame decodes on any machine.
"""

from __future__ import annotations

import struct
from decimal import Decimal, getcontext
from functools import lru_cache

import numpy as np

#: Contexts of the models, and the settings (limit of a count, shift of the mixers' rate) that a frame may use.
CONTEXTS = 24
SETTINGS = ((127, 14), (30, 13))
_HASH = np.uint64(0x9E3779B97F4A7C15)
_MORE = 0xFF51AFD7ED558CCD
_FULL = 1 << 64


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(stretch of 12-bit probabilities, squash of -2047..2047), both on whole numbers, 256 to a unit."""
    getcontext().prec = 20
    stretch = np.array([max(-2047, min(2047, int((256 * (Decimal(2 * k + 1) / Decimal(8191 - 2 * k)).ln()).to_integral_value()))) for k in range(4096)], np.int64)
    squash = np.array([int((65536 / (1 + (Decimal(-k) / 256).exp())).to_integral_value()) for k in range(-2047, 2048)], np.int64)
    return stretch, np.clip(squash, 16, 65520)


class _Calibration:
    """Probabilities by a context and the bucket of a stretched prediction, between which it interpolates."""

    def __init__(self, contexts: int, squash: np.ndarray):
        self.table = [int(squash[min(4094, k * 128)]) for k in range(33)] * contexts

    def p(self, context: int, stretched: int) -> int:
        at, self.part = divmod(stretched + 2047, 128)
        self.at = context * 33 + at
        return (self.table[self.at] * (128 - self.part) + self.table[self.at + 1] * self.part) >> 7

    def update(self, bit: int) -> None:
        at = self.at + (self.part >= 64)
        self.table[at] += ((bit << 16) - bit - self.table[at]) >> 6


class _Model:
    """Probability of the next bit as a whole number of 1/65536."""

    SETS = (2048, 256, 256, 512)

    def __init__(self, size: int, setting: int = 0):
        limit, self.shift = SETTINGS[setting]
        self.stretch, self.squash = _tables()
        bits = max(10, min(20, (max(1, size) * 4 - 1).bit_length()))
        self.rows, self.n = (1 << bits) - 1, 2 * CONTEXTS + 2
        self.table = np.full(CONTEXTS << (bits + 4), 32768, np.int64)
        self.count = np.zeros(CONTEXTS << (bits + 4), np.int64)
        self.first = np.arange(CONTEXTS, dtype=np.int64) << (bits + 4)
        self.rate = np.array([65536 * 2 // (2 * k + 3) for k in range(limit + 1)], np.int64)
        self.sure = np.array([min(k, 32) * 2 for k in range(limit + 1)], np.int64)
        self.next = np.array([min(k + 1, limit) for k in range(limit + 1)], np.int64)
        self.weights = np.full((sum(self.SETS), self.n), 65536 * 3 // (2 * CONTEXTS), np.int64)
        self.weights[:, CONTEXTS : 2 * CONTEXTS] = 0
        self.begin = np.cumsum((0, *self.SETS[:-1])).astype(np.int64)
        self.last = np.full((256, len(self.SETS)), 65536 // len(self.SETS), np.int64)
        self.fine = (_Calibration(256, self.squash), _Calibration(65536, self.squash))
        self.x = np.zeros(self.n, np.int64)
        self.x[-1] = 256
        self.matched = [32768 + 400 * min(k, 64) for k in range(65)]
        self.data, self.partial = bytearray(), 1
        self.seen: dict[int, int] = {}
        self.match, self.length = 0, 0
        self.after: dict[int, int] = {}
        self.word = self.before = self.key = self.depth = self.line = self.run = 0
        self.quoted = self.escaped = False
        self.token = 0
        self._contexts()
        self._row()

    def _contexts(self) -> None:
        """The contexts of the next byte."""
        d, n = self.data, len(self.data)
        c = [d[-k] if n >= k else 0 for k in range(1, 10)]
        tail = int.from_bytes(bytes(c), "little")  # the last byte comes first
        order = lambda k: tail & ((1 << 8 * k) - 1)
        column, above = n - self.line, 0
        if self.line and self.last_line + column < self.line:
            above = d[self.last_line + column]
        then = self.after.get(order(2), 0)
        state = self.depth << 2 | self.quoted << 1 | self.escaped
        contexts = [
            0, *(order(k) for k in (1, 2, 3, 4, 5, 6, 7, 9)), self.word << 8 | c[0], self.word << 32 ^ self.before, c[1], c[1] << 8 | c[2], c[0] << 8 | c[2],
            self.key << 4 | state, self.key << 16 ^ order(2), self.key << 24 ^ order(3) << 1 ^ self.token, self.key << 8 ^ self.token << 1, min(column, 255) << 8 | above, above << 16 | order(2),
            then << 8 | c[0], then << 16 | self.after.get(order(3) | 1 << 24, 0) << 8 | c[0], min(self.run, 255) << 8 | c[0], c[1] << 24 | c[2] << 16 | c[3] << 8 | self.quoted,
        ]
        self.hash = np.array([(x * _MORE + k * 0x2545F4914F6CDD1D) % _FULL for k, x in enumerate(contexts)], np.uint64)
        self.c1, self.state, self.expected = c[0], state, 0
        if self.length and self.match < n:
            self.expected = d[self.match] | 256

    def _row(self) -> None:
        """Where the contexts have their slots for the next four bits."""
        mixed = (self.hash + np.uint64(self.partial)) * _HASH
        mixed ^= mixed >> np.uint64(29)
        mixed *= _HASH
        self.row = self.first + ((mixed >> np.uint64(40)).astype(np.int64) & self.rows) * 16
        self.nibble = 1

    def p(self) -> int:
        self.at = self.row + self.nibble
        self.own = self.table[self.at]
        self.known = self.count[self.at]
        x, s = self.x, CONTEXTS
        x[:s] = self.stretch[self.own >> 4]
        x[s : 2 * s] = (self.own - 32768) * self.sure[self.known] >> 11
        want = -1
        self.bucket = min(self.length, 64) if self.length < 16 else min(64, 16 + (self.length - 16) // 4)
        if self.expected and (self.expected | 256) >> (8 - self.partial.bit_length() + 1) == self.partial:
            want = self.expected >> (8 - self.partial.bit_length()) & 1
        self.want = want
        lean = int(self.stretch[self.matched[self.bucket] >> 4]) if want >= 0 else 0
        x[-2] = lean if want == 1 else -lean
        chosen = (self.bucket // 8 << 8 | self.partial if want >= 0 else self.partial, self.c1, self.partial, min(self.state, 255) << 1 | (want >= 0))
        self.sets = self.begin + np.array([min(a, b - 1) for a, b in zip(chosen, self.SETS, strict=True)], np.int64)
        self.w = self.weights[self.sets]
        self.dots = np.clip((self.w * x).sum(axis=1) >> 16, -2047, 2047)
        self.each = self.squash[self.dots + 2047]
        self.top = self.last[self.partial]
        self.mixed = int(min(2047, max(-2047, int((self.top * self.dots).sum()) >> 16)))
        p = int(self.squash[self.mixed + 2047])
        q = self.fine[0].p(self.partial, self.mixed), self.fine[1].p((self.c1 << 8 | self.partial) & 65535, self.mixed)
        return max(32, min(65503, (2 * p + q[0] + q[1]) >> 2))

    def update(self, bit: int) -> None:
        goal = (bit << 16) - bit
        self.weights[self.sets] = self.w + ((goal - self.each)[:, None] * self.x >> self.shift)
        self.last[self.partial] = self.top + ((goal - int(self.squash[self.mixed + 2047])) * self.dots >> 16)
        self.table[self.at] = self.own + ((goal - self.own) * self.rate[self.known] >> 16)
        self.count[self.at] = self.next[self.known]
        for f in self.fine:
            f.update(bit)
        if self.want >= 0:
            self.matched[self.bucket] += ((65535 if self.want == bit else 0) - self.matched[self.bucket]) >> 6
            if self.want != bit:
                self.length, self.expected = 0, 0
        self.partial = self.partial << 1 | bit
        self.nibble = self.nibble << 1 | bit
        if self.partial > 255:
            self._byte(self.partial & 255)
            self.partial = 1
            self._contexts()
            self._row()
        elif self.nibble > 15:
            self._row()

    def _byte(self, byte: int) -> None:
        d = self.data
        c1, c2, c3 = (d[-k] if len(d) >= k else 0 for k in (1, 2, 3))
        self.after[c1 | c2 << 8], self.after[c1 | c2 << 8 | c3 << 16 | 1 << 24] = byte, byte
        self.run = self.run + 1 if byte == c1 else 0
        d.append(byte)
        if 65 <= byte & 223 <= 90 or byte > 127:
            self.word = (self.word * 0x2F0B4C47 + byte + 1) & 0xFFFFFFFF
        elif self.word:
            self.before, self.word = self.word, 0
        if self.quoted:
            self.token = (self.token * 0x2F0B4C47 + byte + 1) & 0xFFFFFF
            if byte == 34 and not self.escaped:
                self.quoted = False
            self.escaped = byte == 92 and not self.escaped
        elif byte == 34:
            self.quoted, self.token = True, 0
        elif byte == 58:
            self.key, self.token = self.token, 0
        elif byte in (123, 91):
            self.depth = min(self.depth + 1, 60)
        elif byte in (125, 93):
            self.depth = max(self.depth - 1, 0)
        elif byte == 44:
            self.token = 1
        if byte == 10:
            self.last_line, self.line = self.line, len(d)
        if self.length and self.match < len(d) - 1 and d[self.match] == byte:
            self.match, self.length = self.match + 1, self.length + 1
        else:
            self.length = 0
        if len(d) >= 5:
            h = int.from_bytes(d[-5:], "little")
            if not self.length and (at := self.seen.get(h)) is not None:
                self.match, k = at, 0
                while k < 300 and at - k > 0 and d[at - k - 1] == d[-k - 1]:
                    k += 1
                self.length = k
            self.seen[h] = len(d)

    last_line = 0


def cm_encode(data: bytes, setting: int = 0) -> bytes:
    model, low, high, out = _Model(len(data), setting), 0, 0xFFFFFFFF, bytearray()
    for byte in data:
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            mid = low + ((high - low) >> 16) * model.p()
            low, high = (low, mid) if bit else (mid + 1, high)
            model.update(bit)
            while not (low ^ high) & 0xFF000000:
                out.append(high >> 24)
                low, high = low << 8 & 0xFFFFFFFF, high << 8 & 0xFFFFFFFF | 255
    # as few bytes as name a number of the last interval, zeros being read beyond the end
    for n in range(1, 5):
        top = -(-low >> (32 - 8 * n)) if n < 4 else low
        if top << (32 - 8 * n) <= high:
            out += top.to_bytes(n, "big")
            break
    return struct.pack("<IB", len(data), setting) + bytes(out)


def cm_decode(data: bytes) -> bytes:
    n, setting = struct.unpack_from("<IB", data)
    at, model, low, high, out = 9, _Model(n, setting), 0, 0xFFFFFFFF, bytearray()
    x = int.from_bytes(data[5:9].ljust(4, b"\0"), "big")
    for _ in range(n):
        byte = 0
        for _ in range(8):
            mid = low + ((high - low) >> 16) * model.p()
            bit = int(x <= mid)
            low, high = (low, mid) if bit else (mid + 1, high)
            model.update(bit)
            byte = byte << 1 | bit
            while not (low ^ high) & 0xFF000000:
                low, high = low << 8 & 0xFFFFFFFF, high << 8 & 0xFFFFFFFF | 255
                x = x << 8 & 0xFFFFFFFF | (data[at] if at < len(data) else 0)
                at += 1
        out.append(byte)
    return bytes(out)
