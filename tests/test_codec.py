import base64
import json
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from msgledger import schema as S
from msgledger.functions import codec
from msgledger.sources import logfile, wire

HASHES = [
    "1f336527e48d01d68bc296400efce5d1c0f2eb8637a3d22daa31adf8776d4a56",
    "f4aa4fa1dac703176f555cde67e6e281b990c333913452607a081f9d02a3e206",
    "0430ff077f0df9f30fc1dd85913955bfaa6c8d9b1b4f91faec7ab09028d13edd",
    "54d4b361de101f0aa993fec365cf0aecf723b9b49af5dd4020869a8b0ae75abf",
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_generated_hashes(spark):
    assert [r.hash for r in logfile.test_hashes(spark, 4).orderBy("seq").collect()] == HASHES


def test_line(spark):
    lit = F.lit
    got = one(spark, codec.line(lit(HASHES[0]), lit("F"), lit(1700000000), lit(0), lit(1699990000)))
    assert got == "{" + HASHES[0] + "}\t1700000000~----------~1699990000\tF"
    assert len(got) + 1 == 102
    assert "12345678901~0000000005~-000000001\tlonger token" in one(spark, codec.line(lit(HASHES[0]), lit("longer token"), lit(12345678901), lit(5), lit(-1)))


def test_parse_line(spark):
    lines = ["{" + HASHES[1] + "}\t0000000007~----------~0000000009\tF", "{abc}\t1~2~3\tX", "no braces", "", "{" + HASHES[1] + "}", "{" + HASHES[1] + "}\tx~y\t"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", codec.parse_line(F.col("line")).alias("p"), codec.line_is_bad(F.col("line")).alias("bad")).orderBy("i").collect()
    assert tuple(rows[0].p) == (HASHES[1], "F", 7, 0, 9)
    assert tuple(rows[1].p) == (None, "X", 1, 2, 3)
    assert [r.bad for r in rows] == [False, False, True, True, True, False]
    assert [r.p.hash for r in rows[2:]] == [None, None, None, HASHES[1]]
    assert rows[5].p.arrival is None


def test_lists(spark):
    a = F.array(*[F.lit(x).cast("bigint") for x in (4096, 4198)])
    assert one(spark, codec.hex_list(a)) == "1000,1066,"
    assert one(spark, codec.decimal_list(a)) == "4096,4198,"
    assert one(spark, codec.from_decimal_list(F.lit("4096,abc,-5,, 7,0,"))) == [4096]
    assert one(spark, codec.hex_list(F.array().cast("array<bigint>"))) is None
    assert one(spark, codec.hex_list(F.array(F.lit(-255).cast("bigint"), F.lit(0).cast("bigint")))) == "-ff,0,"
    cases = {"1000,1066,": ([4096, 4198], True), "1000": ([], False), ",,a,": ([10], True), "a,zz,b,": ([10], False), "-ff,0,": ([-255, 0], True), "": ([], False)}
    for text, want in cases.items():
        got = one(spark, codec.from_hex_list(F.lit(text)))
        assert (got.offsets, got.ok) == want, text


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 2**55), min_size=1, max_size=8))
def test_lists_round_trip(spark, xs):
    a = F.array(*[F.lit(x).cast("bigint") for x in xs])
    assert one(spark, codec.from_decimal_list(codec.decimal_list(a))) == xs
    assert one(spark, codec.from_hex_list(codec.hex_list(a))).offsets == xs
    assert one(spark, codec.hex_list(a)) == "".join(f"{x:x}," for x in xs)


@pytest.mark.parametrize("text", ["abc", "", "é𝒳", "x" * 1000, f"{HASHES[0]} F 1700000000 0 1699990000"])
def test_crc(spark, text):
    assert one(spark, codec.crc(F.lit(text))) == f"{zlib.crc32(text.encode()):x}"


def test_padding_and_header(spark):
    assert one(spark, codec.left_pad(F.lit("ab"), 4)) == "\0\0ab"
    assert one(spark, codec.null_pad(F.lit("abcde"), 4)) == "abcde"
    assert one(spark, codec.remove_null_pad(F.lit("\0a\0b\0"))) == "ab"
    header = one(spark, codec.encode_header(F.lit(3), F.lit(7)))
    assert len(header) == 4095
    assert json.loads(base64.b64decode(header.rstrip("\0"))) == {"Ka": 3, "Kl": 7}


def test_numbers(spark):
    rows = spark.createDataFrame([(0,), (1,), (6,), (8,), (4096,), (-3,)], "n bigint").select(codec.is_pow2(F.col("n")).alias("p"), codec.offset_to_char(F.col("n")).alias("c")).collect()
    assert [(r.p, r.c) for r in rows] == [(True, ""), (True, "1"), (False, "6"), (True, "8"), (True, "0"), (False, "")]
    assert [one(spark, codec.hex_to_int(F.lit(x))) for x in ("ff", "FF", "zz1", "", "0")] == [255, 255, None, None, 0]
    e = one(spark, codec.epochs(F.lit("2024-01-01 00:00:01.5").cast("timestamp")))
    assert tuple(e) == (1704067201, 1704067201500, 1704067201500000, 1704067201500000000)


def wire_of(fields):
    return f"ADD {zlib.crc32(fields.encode()):x} {fields}"


def test_wire(spark):
    good = f"{HASHES[0]} F 1700000000 0 1699990000"
    assert wire_of(good).split()[1] == "19173e21"
    lines = {
        wire_of(good): (60, HASHES[0], 1700000000),
        wire_of(good) + " more": (401, None, None),
        "ADD": (401, None, None),
        "": (401, None, None),
        wire_of(good).replace("ADD", "PUT"): (401, None, None),
        "ADD 0 " + good: (402, None, None),
        wire_of(good.replace("1700000000", "17e8")): (403, None, None),
        wire_of(good.replace(" 0 ", " 99999999999999999999 ")): (403, None, None),
    }
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r.line: (r.code, r.hash, r.arrival) for r in wire.parsed(frame).collect()} == lines
    strict = {r.line: r.code for r in wire.parsed(frame, strict=True).collect()}
    assert strict[wire_of(good)] == 401 and strict[wire_of(good) + " more"] in (402, 403)
    crc_over_six = wire_of(good + " more")
    assert {r.code for r in wire.parsed(spark.createDataFrame([(crc_over_six,)], "line string"), strict=True).collect()} == {403}


def test_wire_round_trip(spark):
    arts = logfile.bulk_articles(spark, 20, 1_700_000_000)
    got = wire.parsed(wire.encoded(arts)).select(*S.ARTICLE.names).collect()
    assert sorted(got) == sorted(arts.select(*S.ARTICLE.names).collect())
    assert all(re.fullmatch(r"ADD [0-9a-f]{1,8} [0-9a-f]{64} F \d+ \d+ \d+", r.line) for r in wire.encoded(arts).collect())


def test_hex_offsets_of_64_bits(spark):
    from msgledger.functions import codec

    rows = [("7fffffffffffffff,-8000000000000000,0010,", [2**63 - 1, -(2**63), 16], True), ("8000000000000000,1,", [], False), ("1,10000000000000000,", [1], False)]
    got = spark.createDataFrame([(r[0],) for r in rows], "t string").select("t", codec.from_hex_list(F.col("t")).alias("d")).collect()
    assert [(r.t, r.d.offsets, r.d.ok) for r in got] == rows


def test_stamp_is_the_formatter(spark):
    numbers = [None, 0, 5, -5, -12345678901, 9999999999, 10000000000, 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x bigint").select(codec.stamp(F.col("x")).alias("got"), F.format_string("%010d", "x").alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_hash_of_odd_lines(spark):
    h = HASHES[0]
    texts = {None: None, "": None, "{" + h + "}\tx": h, "{" + h + "}\t{" + h + "}\t": h, "{" + h + "}": None, "{" + h + "0}\tx": None, "{" + h[1:] + "}\tx": None, " {" + h + "}\tx": None, "\n{" + h + "}\tx": None, "{" + "é😀" * 32 + "}\tx": "é😀" * 32, "{" + h[1:] + "\n}\tx": h[1:] + "\n"}
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(codec.line_hash(F.col("t")).alias("got")).collect()
    assert [r.got for r in rows] == list(texts.values())
