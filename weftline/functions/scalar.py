"""Scalar building blocks as Column expressions; all of them run inside whole-stage codegen."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

INT = "^-?[0-9]+$"
FLOAT = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
ISO = '^"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?"$'
UUID = '^"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"$'
#: Whole seconds that count as points in time: the years 2000 to 2099.
EPOCH = (946684800, 4102444800)


def as_long(raw: Column) -> Column:
    """The token as a long, or null; try_cast alone would take blanks and suffixes."""
    return F.when(raw.rlike(INT), raw.try_cast("bigint"))


def classify(raw: Column) -> Column:
    """The kind of a JSON token: null bool int epoch_s epoch_ms float iso uuid text."""
    n = as_long(raw)
    return (
        F.when(raw.isNull() | (raw == "null"), "null").when(raw.isin("true", "false"), "bool")
        .when(n.between(*EPOCH), "epoch_s").when(n.between(EPOCH[0] * 1000, EPOCH[1] * 1000), "epoch_ms").when(n.isNotNull(), "int")
        .when(raw.rlike("[.eE]") & raw.rlike(FLOAT), "float").when(raw.rlike(ISO), "iso").when(raw.rlike(UUID), "uuid").otherwise("text")
    )


def zigzag(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1))))


def varint_len(n: Column) -> Column:
    """Bytes of the zigzag LEB128 form of a signed number."""
    out = None
    for k in range(1, 10):
        half = 1 << (7 * k - 1)
        test = n.between(-half, half - 1)
        out = F.when(test, k) if out is None else out.when(test, k)
    return out.otherwise(10).cast("int")


def varint_hex(n: Column) -> Column:
    """The zigzag LEB128 bytes of a signed number, in hexadecimal."""
    z = zigzag(n)
    part = lambda k: F.shiftrightunsigned(z, 7 * k)
    byte = lambda k: F.lpad(F.hex(part(k).bitwiseAND(F.lit(127)) + F.when(part(k + 1) != 0, 128).otherwise(0)), 2, "0")
    last = F.lpad(F.hex(part(9)), 2, "0")
    return F.concat(byte(0), *[F.when(part(k) != 0, byte(k)).otherwise("") for k in range(1, 9)], F.when(part(9) != 0, last).otherwise(""))


#: Groups of seven bits that a whole number of 38 decimal digits can take in zigzag form, and those in a limb of 56 bits.
WIDE_GROUPS, LIMB = 19, 8


def wide_varint_len(n: Column) -> Column:
    """:func:`varint_len` of a decimal(38, 0), which may be beyond 64 bits."""
    out = F.when(n.try_cast("bigint").isNotNull(), varint_len(n.try_cast("bigint")))
    for k in range(10, WIDE_GROUPS):
        half = 1 << (7 * k - 1)
        out = out.when(n.between(F.lit(Decimal(-half)), F.lit(Decimal(half - 1))), k)
    return out.when(n.isNotNull(), WIDE_GROUPS).cast("int")


def wide_varint_hex(n: Column) -> Column:
    """:func:`varint_hex` of a decimal(38, 0) between -4e37 and 4e37, which may be beyond 64 bits."""
    rest = F.when(n >= 0, n * 2).otherwise(n * -2 - 1).cast("decimal(38,0)")
    size, limb, limbs = wide_varint_len(n), F.lit(Decimal(1 << (7 * LIMB))), []
    for _ in range(0, WIDE_GROUPS, LIMB):
        low = rest % limb
        limbs.append(low.cast("bigint"))
        rest = ((rest - low) / limb).cast("decimal(38,0)")
    part = lambda k: F.shiftrightunsigned(limbs[k // LIMB], 7 * (k % LIMB)).bitwiseAND(F.lit(127))
    byte = lambda k: F.lpad(F.hex(part(k) + F.when(size > k + 1, 128).otherwise(0)), 2, "0")
    wide = F.concat(*[F.when(size > k, byte(k)).otherwise("") for k in range(WIDE_GROUPS)])
    short = n.try_cast("bigint")
    return F.when(short.isNotNull(), varint_hex(short)).when(n.isNotNull(), wide)


def octets(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def iso_parts(raw: Column) -> tuple[Column, Column, Column, Column]:
    """(suffix style, offset in minutes, fraction digits, epoch microseconds) of a quoted ISO text."""
    suffix = F.regexp_extract(raw, '(Z|[+-][0-9]{2}:[0-9]{2})?"$', 1)
    sign = F.when(F.substring(suffix, 1, 1) == "-", -1).otherwise(1)
    offset = F.when(suffix.rlike("^[+-]"), sign * (F.substring(suffix, 2, 2).cast("int") * 60 + F.substring(suffix, 5, 2).cast("int"))).otherwise(0)
    digits = F.length(F.regexp_extract(raw, "[.]([0-9]+)", 1))
    local = F.try_to_timestamp(F.substring(raw, 2, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    micros = F.unix_micros(local) + F.rpad(F.regexp_extract(raw, "[.]([0-9]{1,6})", 1), 6, "0").cast("long") - offset.cast("long") * 60_000_000
    return F.when(suffix == "", "none").when(suffix == "Z", "zulu").otherwise("offset"), offset, digits, micros


def iso_from_parts(style: Column, offset: Column, digits: Column, micros: Column) -> Column:
    """The inverse of :func:`iso_parts` for up to six fraction digits."""
    local = micros + offset.cast("long") * 60_000_000
    whole = F.date_format(F.timestamp_micros(local), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(digits > 0, F.concat(F.lit("."), F.substring(F.lpad(F.pmod(local, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit(1), digits))).otherwise("")
    zone = F.format_string("%s%02d:%02d", F.when(offset < 0, "-").otherwise("+"), F.floor(F.abs(offset) / 60).cast("int"), F.pmod(F.abs(offset), F.lit(60)).cast("int"))
    return F.concat(F.lit('"'), whole, fraction, F.when(style == "zulu", "Z").when(style == "offset", zone).otherwise(""), F.lit('"'))


def uuid_pack(raw: Column) -> Column:
    """16 bytes of a quoted UUID."""
    return F.unhex(F.regexp_replace(raw, '["-]', ""))


def uuid_unpack(packed: Column) -> Column:
    h = F.lower(F.hex(packed))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit('"'), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit('"'))


#: The upper bound of each range of bytes and the range's class.
BYTE_CLASSES = ((31, 0), (32, 1), (47, 5), (57, 2), (64, 5), (90, 3), (96, 5), (122, 4), (126, 5), (127, 11), (159, 6), (191, 7), (223, 8), (254, 9), (255, 10))


def byte_class(b: Column) -> Column:
    """The class, 0 to 11, of a byte value."""
    out = None
    for upper, kind in BYTE_CLASSES:
        out = F.when(b <= upper, kind) if out is None else out.when(b <= upper, kind)
    return out


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / 1048576.0))


def bits_per_byte(encoded: Column, original: Column) -> Column:
    return F.when(original > 0, encoded * 8.0 / original).otherwise(0.0)


def improvement(encoded: Column, other: Column) -> Column:
    return F.when(other > 0, (1 - encoded / other) * 100.0).otherwise(0.0)


def zstd_level(n: Column) -> Column:
    """The level for a frame of n bytes: high for small frames, lower for large ones."""
    return F.when(n <= 1 << 20, 19).when(n <= 10 << 20, 13).otherwise(9)


def squash(x: Column) -> Column:
    """The probability of a logit."""
    return 1 / (1 + F.exp(-x))


def stretch(p: Column) -> Column:
    """The logit of a probability, the inverse of :func:`squash`."""
    return F.log(p / (1 - p))
