"""Columns that encode and decode log lines, offset lists, headers and wire lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgledger import schema as S


# ---------------------------------------------------------------- log lines
def stamp(seconds: Column) -> Column:
    """At least ten digits, zero padded; longer numbers aren't cut."""
    digits = seconds.cast("string")  # far cheaper than a formatter, which is left what has a sign or is null
    return F.when(seconds >= 0, F.lpad(digits, F.greatest(F.lit(10), F.length(digits)), F.lit("0"))).otherwise(F.format_string("%010d", seconds))


def line(hash_: Column, token: Column, arrival: Column, expires: Column, date: Column) -> Column:
    """A record as one line, without its line feed; no expiry prints as ten dashes."""
    until = F.when(expires > 0, stamp(expires)).otherwise(F.lit(S.NEVER))
    return F.concat(F.lit("{"), hash_, F.lit("}\t"), stamp(arrival), F.lit("~"), until, F.lit("~"), stamp(date), F.lit("\t"), token)


def line_bytes(text: Column) -> Column:
    return (F.octet_length(text) + 1).cast("bigint")


def line_hash(text: Column) -> Column:
    """The hash between braces before the first tab; null unless it has 64 characters."""
    return F.get(F.regexp_extract_all(text, F.lit(rf"^\{{([^}}\t]{{{S.HASH_CHARS}}})\}}\t"), F.lit(1)), F.lit(0))


def line_is_bad(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"^\{[^\t]*\}\t"), F.lit(False))


def parse_line(text: Column) -> Column:
    """Struct of the record's fields; unreadable ones are null, an expiry of dashes is 0."""
    parts = F.split(text, "\t", -1)
    times = F.split(F.get(parts, F.lit(1)), "~", -1)
    number = lambda i: F.get(times, F.lit(i)).try_cast("bigint")
    expires = F.when(F.get(times, F.lit(1)) == S.NEVER, F.lit(0).cast("bigint")).otherwise(number(1))
    return F.struct(line_hash(text).alias("hash"), F.get(parts, F.lit(2)).alias("token"), number(0).alias("arrival"), expires.alias("expires"), number(2).alias("date"))


# ---------------------------------------------------------------- offset lists
def decimal_list(offsets: Column) -> Column:
    """``4096,4198,``: every number with a comma after it."""
    return F.array_join(F.transform(offsets, lambda x: F.concat(x.cast("string"), F.lit(","))), "")


def from_decimal_list(text: Column) -> Column:
    """The positive numbers of the list; parts that are no numbers are skipped."""
    numbers = F.transform(F.split(text, ","), lambda x: F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("bigint")))
    return F.filter(numbers, lambda x: x > 0)


def hex_list(offsets: Column) -> Column:
    """``1000,1066,`` in lower-case hex, negative numbers with a sign; null for an empty list."""
    one = lambda x: F.concat(F.when(x < 0, "-").otherwise(""), F.lower(F.hex(F.abs(x))), F.lit(","))
    return F.when(F.size(offsets) > 0, F.array_join(F.transform(offsets, one), ""))


def from_hex_list(text: Column) -> Column:
    """Struct of ``offsets`` and ``ok``.

    A list that doesn't end in a comma is an error. Empty parts are skipped; from the first bad part on
    nothing is decoded, and ``ok`` is false. Zero and negative numbers are kept; parts beyond 64 bits are bad.
    """
    parts = F.filter(F.split(text, ","), lambda x: x != "")
    good = lambda x: x.rlike(r"^(?:[+-]?0*(?:[0-9a-fA-F]{1,15}|[0-7][0-9a-fA-F]{15})|-0*8000000000000000)$")
    bad = F.coalesce(F.array_position(F.transform(parts, lambda x: ~good(x)), True), F.lit(0))
    usable = F.when(bad > 0, F.slice(parts, F.lit(1), (bad - 1).cast("int"))).otherwise(parts)
    # as unsigned 64 bits, of which the cast of the least number's negative would not fit
    size = lambda x: F.conv(F.regexp_replace(x, r"^[+-]?0*(?=.)", ""), 16, 10).cast("decimal(20,0)")
    number = lambda x: F.when(x.startswith("-"), -size(x)).otherwise(size(x)).cast("bigint")
    ends = text.endswith(",")
    empty = F.array().cast("array<bigint>")
    return F.struct(F.when(ends, F.transform(usable, number)).otherwise(empty).alias("offsets"), F.coalesce(ends & (bad == 0), F.lit(False)).alias("ok"))


# ---------------------------------------------------------------- checks, padding, headers
def crc(text: Column) -> Column:
    """CRC-32 (IEEE) in lower-case hex, not padded."""
    return F.lower(F.hex(F.crc32(text.cast("binary"))))


def _nulls(text: Column, n: int) -> Column:
    return F.repeat(F.chr(F.lit(0)), F.greatest(F.lit(n) - F.octet_length(text), F.lit(0)))


def left_pad(text: Column, n: int) -> Column:
    """NUL characters before the text up to n bytes; never cut."""
    return F.concat(_nulls(text, n), text)


def null_pad(text: Column, n: int) -> Column:
    return F.concat(text, _nulls(text, n))


def remove_null_pad(text: Column) -> Column:
    """Without any NUL, interior ones too."""
    return F.replace(text, F.chr(F.lit(0)))


def encode_header(hash_chars: Column, key_chars: Column) -> Column:
    """The log's settings as base64 of JSON, padded to the header's length."""
    settings = F.to_json(F.struct(hash_chars.alias("Ka"), key_chars.alias("Kl")))
    return null_pad(F.base64(settings.cast("binary")), S.HEADER_BYTES)


def decode_header(header: Column) -> Column:
    return F.from_json(F.unbase64(remove_null_pad(header)).cast("string"), "Ka INT, Kl INT")


# ---------------------------------------------------------------- wire lines
def wire_fields(hash_: Column, token: Column, arrival: Column, expires: Column, date: Column) -> Column:
    return F.concat_ws(" ", hash_, token, arrival.cast("string"), expires.cast("string"), date.cast("string"))


def wire_line(fields: Column) -> Column:
    """``ADD``, the fields' checksum, the fields."""
    return F.concat(F.lit("ADD "), crc(fields), F.lit(" "), fields)


def parse_wire(text: Column, strict: bool = False) -> Column:
    """Struct of ``code`` and the fields: 401 wrong number of parts, 402 bad checksum, 403 bad number, else 60.

    A line has 7 parts, as clients send it. ``strict``: as a server that asks for 8 parts and then 5 fields
    among the remaining 6, which no line fulfils.
    """
    parts = F.split(text, " ", -1)
    at = lambda i: F.get(parts, F.lit(i))
    whole = lambda x: x.rlike(r"^[+-]?[0-9]+$")
    number = lambda i: F.when(whole(at(i)), at(i).try_cast("bigint"))
    fields = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), " ")
    arity = (F.size(parts) == (8 if strict else 7)) & (at(0) == "ADD")
    bad_number = F.lit(True) if strict else number(4).isNull() | number(5).isNull() | number(6).isNull()
    code = F.when(~F.coalesce(arity, F.lit(False)), 401).when(at(1) != crc(fields), 402).when(bad_number, 403).otherwise(S.ADDED)
    good = lambda c: F.when(code == S.ADDED, c)
    return F.struct(code.alias("code"), good(at(2)).alias("hash"), good(at(3)).alias("token"), good(number(4)).alias("arrival"), good(number(5)).alias("expires"), good(number(6)).alias("date"))


# ---------------------------------------------------------------- numbers
def is_pow2(n: Column) -> Column:
    """A single bit set, or none: 0 counts."""
    return n.bitwiseAND(n - 1) == 0


def hex_to_int(text: Column) -> Column:
    """Null for what isn't hexadecimal."""
    return F.when(text.rlike("^[0-9a-fA-F]+$"), F.conv(text, 16, 10).cast("int"))


def offset_to_char(offset: Column) -> Column:
    """The last hex digit of a positive offset, else empty."""
    return F.when(offset > 0, F.lower(F.hex(offset % 16))).otherwise("")


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("int")


def epochs(ts: Column) -> Column:
    """Struct of seconds, milli-, micro- and nanoseconds since the epoch; the last in steps of a microsecond."""
    micro = F.unix_micros(ts)
    return F.struct(F.unix_seconds(ts).alias("seconds"), F.unix_millis(ts).alias("millis"), micro.alias("micros"), (micro * 1000).alias("nanos"))
