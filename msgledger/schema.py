"""Schemas, result codes and layout constants of the history log and its index."""

from __future__ import annotations

from pyspark.sql import types as T

ARTICLE = T.StructType(
    [
        T.StructField("hash", T.StringType()),
        T.StructField("token", T.StringType()),
        T.StructField("arrival", T.LongType()),
        T.StructField("expires", T.LongType()),
        T.StructField("date", T.LongType()),
    ]
)
INDEX_REQUEST = T.StructType([T.StructField("hash", T.StringType()), T.StructField("offset", T.LongType())])
INDEX_ROW = T.StructType([T.StructField("pfx", T.StringType()), T.StructField("key", T.StringType()), T.StructField("offsets", T.ArrayType(T.LongType()))])
LOG_LINE = T.StructType([T.StructField("offset", T.LongType()), T.StructField("line", T.StringType())])

# Result codes.
DUPES, RETRY, ADDED, WRITE, ERROR, PASS, LOCK, INVALID = 0x1C, 0x2C, 0x3C, 0x4C, 0xE1, 0xF1, 0xFF, -999
CODES = {"dupes": DUPES, "retry": RETRY, "added": ADDED, "write": WRITE, "error": ERROR, "pass": PASS, "lock": LOCK, "invalid": INVALID}

# Layout. The header takes 4095 bytes and a line feed; 3 hex digits route, 7 more are the key.
HEADER_BYTES = 4095
FIRST_OFFSET = HEADER_BYTES + 1
HASH_CHARS, ROUTE_CHARS, KEY_CHARS = 64, 3, 7
SEARCH = -1
NEVER = "----------"
TTL_SECONDS = 5
TICK_SECONDS = 10
HEX_DIGITS = "0123456789abcdef"
