import pytest
from pyspark.sql import functions as F

from msgledger.functions import routing
from tests.test_codec import HASHES

GOLDEN = [(0, "s1f3"), (499, "shash"), (1, "sf3"), (7, "s33"), (15, "s13"), (62, "s3")]


def routes(spark, hashes, mode):
    frame = spark.createDataFrame([(h,) for h in hashes], "hash string")
    return [tuple(r) for r in frame.select(routing.db_index(F.col("hash"), mode), routing.table_name(F.col("hash"), mode)).collect()]


@pytest.mark.parametrize("mode", range(6))
def test_golden_and_fallbacks(spark, mode):
    assert routes(spark, HASHES[:1], mode) == [GOLDEN[mode]]
    non_hex = {0: (0, "szz1"), 1: (0, "shash"), 2: (0, "sz1"), 3: (0, "s00"), 4: (0, "s00"), 5: (0, "s1")}
    assert routes(spark, ["zz1" + HASHES[0][3:]], mode) == [non_hex[mode]]
    assert routes(spark, ["1f", ""], mode) == [(0, "s000")] * 2


@pytest.mark.parametrize("mode", range(6))
def test_bijective(spark, mode):
    m = routing.MODES[mode]
    own = routing.catalog(spark).where(F.col("mode") == mode)
    assert own.select("db_index", "table_name").distinct().count() == 4096
    assert own.select("db_index").distinct().count() == m.dbs
    assert {r["count"] for r in own.groupBy("db_index").count().collect()} == {m.tables}


def test_keys(spark):
    h = "1a2b3c4d5e6f0" + "0" * 51
    r = spark.createDataFrame([(h,)], "h string").select(routing.prefix(F.col("h")), routing.key(F.col("h")), routing.full_key(F.col("h")), routing.route(F.upper("h"))).first()
    assert tuple(r) == ("1a2", "b3c4d5e", "1a2b3c4d5e", "1a2")


def test_memory_model(spark):
    got = {r.mode: (r.cache_mb, r.conn_mb, r.estimated_mb) for r in routing.memory_model(routing.mode_table(spark)).collect()}
    assert got == {0: (390, 0, 395), 1: (4096, 3276, 7377), 2: (112, 12, 129), 3: (192, 51, 248), 4: (128, 102, 235), 5: (0, 409, 414)}


def test_names(spark):
    r = spark.range(1).select(routing.db_name(F.lit(26), 64), routing.db_name(F.lit(64), 64), routing.db_path(F.lit(5), 1), routing.db_path(F.lit(255), 4096), routing.db_path(F.lit(5), 16)).first()
    assert tuple(r) == ("01a", "000", "hashdb.sqlite3", "hashdb_0ff.sqlite3", "hashdb_005.sqlite3")
    assert routing.mode_of(9) == routing.MODES[0]
