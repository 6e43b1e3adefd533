import random

import pytest
from pyspark.sql import functions as F

from msgledger import schema as S
from msgledger.functions import codec
from msgledger.operators import acl, caches, index, log, lookup, stats, ttl
from msgledger.plans.views import events
from msgledger.sources import logfile
from tests.test_codec import HASHES


@pytest.fixture(scope="module")
def logged(spark):
    arts = logfile.bulk_articles(spark, 300, 1_700_000_000).withColumn("token", F.repeat(F.lit("é"), F.col("seq").cast("int") % 4 + 1))
    return log.with_offsets(log.with_lines(arts)).cache()


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_offsets(spark, bucket):
    arts = logfile.bulk_articles(spark, 60, 1_700_000_000).withColumn("token", F.repeat(F.lit("é"), F.col("seq").cast("int") % 4 + 1)).repartition(5)
    rows = log.with_offsets(log.with_lines(arts), bucket=bucket).orderBy("seq").collect()
    at = 4096
    for r in rows:
        assert r.offset == at
        at += len(r.line.encode()) + 1


def test_totals_and_empty(spark, logged):
    t = log.totals(logged).first()
    assert (t.lines, t.bytes) == (300, sum(len(r.line.encode()) + 1 for r in logged.collect()))
    none = logged.where("false")
    assert tuple(log.totals(none).first()) == (0, 0)
    assert log.with_offsets(none.drop("offset")).count() == 0


def test_file_round_trip(spark, logged, tmp_path):
    logfile.export(logged, str(tmp_path / "parts"))
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "parts").glob("part-*")))
    file = tmp_path / "history.dat"
    file.write_bytes(whole)
    assert whole[4095:4096] == b"\n"
    back = logfile.read(spark, str(file))
    assert sorted(map(tuple, logfile.records(back).collect())) == sorted((r.offset, r.line) for r in logged.collect())
    assert tuple(logfile.header(back).first().settings) == (3, 7)
    rebuilt, built = (sorted(map(tuple, x.collect())) for x in (index.rebuild(logfile.records(back)), index.build(logged)))
    assert rebuilt == built


def test_statuses(spark):
    rows = [("", "F", 225), (None, "F", 225), (HASHES[0], "", 225), (HASHES[0], None, 225), (HASHES[0][:63], "F", -999), ("zz1" + HASHES[0][3:], "F", 44), (HASHES[0].upper(), "F", 225), (HASHES[0], "F", 0)]
    frame = spark.createDataFrame([(h, t, 0, 0, 0, w) for h, t, w in rows], "hash string, token string, arrival bigint, expires bigint, date bigint, want int")
    got = log.validate(frame, F.lit(5))
    assert all(r.status == r.want and r.arrival == 5 for r in got.collect())
    assert {r.status for r in log.validate(frame, normalise=True).where(F.col("want") == 225).where("hash <> '' AND token <> ''").collect()} == {0}
    requests = spark.createDataFrame([(HASHES[0], -1, None), (HASHES[0], 0, 225), (HASHES[0], -2, 225), (HASHES[0], 9, 60), ("ab", -1, -999), (None, -1, -999)], "hash string, offset bigint, want int")
    assert all(r.s == r.want for r in requests.select("want", lookup.request_status(F.col("hash"), F.col("offset")).alias("s")).collect())


@pytest.mark.parametrize("width", [1, 3, 10])
def test_verified_lookup(spark, logged, width):
    history = logged.where("seq % 2 = 0")
    got = {r.seq: r.status for r in lookup.verified(logged.select("seq", "hash"), index.build(history, width), history.select("offset", "line"), width).collect()}
    assert got == {i: S.PASS if i % 2 else S.DUPES for i in range(300)}
    if width == 1:  # without verification nearly all would be duplicates
        assert lookup.unverified(logged.select("seq", "hash"), index.build(history, width), width).count() == 300


def most_rows(df):
    """Rows of the operator of the plan that gives most, after a run."""
    plan, rows = df._jdf.queryExecution(), [0]

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.metrics().contains("numOutputRows"):
            rows.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    plan.toRdd().count()
    walk(plan.executedPlan())
    return max(rows)


def test_verified_lookup_makes_no_row_for_each_candidate(spark):
    n = 20_000  # all under 16 keys: 1,250 candidates for each request
    own = spark.range(n).select(F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("hash"), (F.col("id") + 1).alias("offset"))
    lines = own.select("offset", F.concat(F.lit("{"), "hash", F.lit("}\t1~2~3\tF")).alias("line"))
    df = lookup.verified(own.select("seq", "hash"), index.build(own, 1), lines, 1)
    assert df.where("status = 28").count() == n
    assert n <= most_rows(df) <= 2 * n


def test_counters_make_no_row_for_each_candidate(spark, sf_dir, tmp_path):
    from msgledger.plans.queries import counters

    own = events(spark, sf_dir)
    n = own.count() * 40  # 4,096 keys: five candidates for each request
    own.crossJoin(spark.range(40)).withColumn("event_id", F.col("event_id") + 1000 * F.col("id")).drop("id").write.parquet(str(tmp_path / "events.parquet"))
    df = counters(spark, str(tmp_path))
    assert n <= most_rows(df) <= 2 * n
    assert {r.name: r.value for r in df.collect()} == {"dupes": n // 2, "pass": n // 2}


def bytes_sent(df):
    """Bytes that the exchanges of the plan write, after a run."""
    plan = df._jdf.queryExecution()

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        own = node.metrics().apply("shuffleBytesWritten").value() if node.nodeName() == "Exchange" else 0
        own += sum(walk(node.children().apply(i)) for i in range(node.children().size()))
        return own + (walk(node.plan()) if "QueryStage" in node.nodeName() else 0)

    plan.toRdd().count()
    return walk(plan.executedPlan())


@pytest.mark.parametrize("name", ["counters", "dup_lookup_verified"])
def test_lookup_sends_no_hashes(spark, sf_dir, tmp_path, name):
    """Hashes are made of 8 bytes of a row, and carrying their 64 characters through each exchange takes most of the disk."""
    from msgledger.plans.queries import QUERIES

    own = events(spark, sf_dir)
    n = own.count() * 40
    own.crossJoin(spark.range(40)).withColumn("event_id", F.col("event_id") + 1000 * F.col("id")).drop("id").write.parquet(str(tmp_path / "events.parquet"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        assert 0 < bytes_sent(QUERIES[name](spark, str(tmp_path))) < 100 * n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("width", [1, 3, 10])
def test_verified_lookup_of_rows_that_hold_no_hash(spark, width):
    """The same answers where hashes and lines are made of other columns; of lines that stand twice, twice in the index, that are bad or null."""
    rng = random.Random(width)
    hashes = [f"{rng.getrandbits(256):064x}" for _ in range(60)]
    texts = [rng.choice(["{" + h + "}\t1~2~3\tF", "{" + h + "}\t1~2~3\tF", "broken", "{" + h[1:] + "}\tx", "", None]) for h in hashes[:50]] + ["{" + hashes[0] + "}\tx"] * 3
    lines = spark.createDataFrame(list(enumerate(texts, 1)), S.LOG_LINE)
    keys = [(hashes[i % 50][:width], [i % 50 + 1]) for i in range(55)] + [(hashes[0][:width], [51, 52, 53, 0, 7, 99]), ("abcdefabcd"[:width], [2])]
    held = {k: [x for j, v in keys if j == k for x in v] for k, _ in keys}
    own = spark.createDataFrame([(k[:3], k[3:], v) for k, v in held.items()] + [(None, "", [3]), ("a", None, [4])], S.INDEX_ROW)
    asked = spark.createDataFrame(list(enumerate([*hashes, None, "", "ab", hashes[0], hashes[0]])), "seq bigint, hash string")
    want = lookup.verified(asked, own, lines, width).collect()
    turned = lookup.verified(asked.select("seq", F.reverse("hash").alias("turned")), own, lines.select("offset", F.reverse("line").alias("turned")), width, hash_=F.reverse("turned"), line=F.reverse("turned"))
    assert turned.columns == ["seq", "hash", "status"]
    assert sorted(turned.collect(), key=lambda r: r.seq) == sorted(want, key=lambda r: r.seq) and len(want) == 65
    assert {S.DUPES, S.PASS} <= {r.status for r in want}


@pytest.mark.parametrize("width", [1, 3, 10])
def test_verified_lookup_equals_a_loop(spark, width):
    rng = random.Random(width)
    hashes = [f"{rng.getrandbits(256):064x}" for _ in range(120)]
    lines = [(i + 1, rng.choice(["{" + h + "}\t1~2~3\tF", "{" + h + "}\t1~2~3\tF", "broken", "{" + h[1:] + "}\tx", "", None])) for i, h in enumerate(hashes[:80])]
    held = {}  # entries, also of offsets that the log lacks, none, and zero; two stand under a key that isn't their hash's
    for i, h in enumerate(hashes[:60] + hashes[100:]):
        held.setdefault(h[:width], []).append(i + 1)
    held.setdefault(hashes[90][:width], []).extend([0, 1, 7])
    held.setdefault("abcdefabcd"[:width], [0, -1])
    asked = [(i, h) for i, h in enumerate([*hashes, None, "", "ab", hashes[0]])]
    entries = [(k[:3], k[3:], v) for k, v in held.items()]
    got = lookup.verified(spark.createDataFrame(asked, "seq bigint, hash string"), spark.createDataFrame(entries, S.INDEX_ROW), spark.createDataFrame(lines, S.LOG_LINE), width)
    log_, want = dict(lines), {}
    for seq, h in asked:
        read = [(at in log_, log_.get(at) or "") for at in (held.get(h[:width], []) if h is not None else []) if at > 0]
        hit = any(line.startswith("{" + h + "}\t") and len(h) == 64 for _, line in read)
        want[seq] = S.DUPES if hit else S.RETRY if len(read) == 1 and read[0][0] and not (read[0][1].startswith("{") and "}\t" in read[0][1]) else S.PASS
    rows = got.collect()
    assert {r.seq: r.status for r in rows} == want and len(rows) == len(asked)
    if width == 10:
        assert {S.DUPES, S.RETRY, S.PASS} == set(want.values())


def test_unreadable_candidates(spark):
    h = HASHES[0]
    lines = spark.createDataFrame([(4096, "broken"), (4200, "{" + h + "}\t1~2~3\tF"), (4300, "broken too")], S.LOG_LINE)
    requests = spark.createDataFrame([(1, h), (2, HASHES[1]), (3, HASHES[2]), (4, HASHES[3])], "seq bigint, hash string")
    entries = [(h[:3], h[3:10], [4300, 4200]), (HASHES[1][:3], HASHES[1][3:10], [4096]), (HASHES[2][:3], HASHES[2][3:10], [9999])]
    got = lookup.verified(requests, spark.createDataFrame(entries, S.INDEX_ROW), lines)
    assert {r.seq: r.status for r in got.collect()} == {1: S.DUPES, 2: S.RETRY, 3: S.PASS, 4: S.PASS}


def test_overlong_hash_never_verifies(spark):
    long = HASHES[0] + "0"
    own = log.with_offsets(log.with_lines(spark.createDataFrame([(0, long, "F", 1, 0, 1)], "seq bigint, hash string, token string, arrival bigint, expires bigint, date bigint")))
    got = lookup.verified(own.select("seq", "hash"), index.build(own), own.select("offset", "line")).first()
    assert got.status == S.PASS


def test_index(spark, logged, tmp_path):
    whole = index.build(logged, 2)
    halves = [index.build(logged.where(f"seq % 2 = {i}"), 2) for i in (0, 1)]
    key = lambda df: sorted((r.pfx, r.key, r.offsets) for r in df.collect())
    assert key(index.merge(*halves)) == key(whole)
    revived = spark.createDataFrame([("aa", "", None)], "pfx string, key string, offsets array<bigint>")
    assert key(index.merge(revived, revived)) == [("aa", "", [])]
    full = index.build(logged)
    index.write(full, str(tmp_path / "index"))
    back = spark.read.parquet(str(tmp_path / "index"))
    h = logged.first().hash
    assert index.lookup(back, h).first().offsets == index.lookup(full, h).first().offsets
    plan = index.lookup(back, h)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(pfx), IsNotNull(key), EqualTo(pfx" in plan
    assert index.entries(spark.createDataFrame([("a", "b", [0, -1, 5])], S.INDEX_ROW)).collect()[0].offset == 5


def test_adding(spark):
    offers = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "c")], "seq bigint, hash string")
    history = spark.createDataFrame([("b",), ("b",)], "hash string")
    assert sorted(map(tuple, lookup.check_then_add(offers, history).select("seq", "hash").collect())) == [(1, "a"), (4, "c")]
    assert {r.seq: r.status for r in lookup.add_status(offers, history).collect()} == {1: 60, 2: 28, 3: 28, 4: 60, 5: 28}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_ttl(spark, batch):
    rng = random.Random(batch)
    rows = [(i, rng.randrange(4), rng.randrange(2000)) for i in range(500)] + [(500, None, 5), (501, 1, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = ttl.admitted(spark.createDataFrame(rows, "seq bigint, key bigint, micros bigint"), 100)
        got = sorted((r.key, r.micros) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last, want = {}, []
    for _, k, m in sorted((r for r in rows if None not in r), key=lambda r: (r[1], r[2], r[0])):
        if k not in last or m >= last[k] + 100:
            last[k] = m
            want.append((k, m))
    assert got == want


def test_golden_counts(spark, sf_dir):
    own = events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.unix_micros("ts").alias("micros"))
    assert ttl.admitted(own, 86_400_000_000).count() == 313
    assert stats.rate(events(spark, sf_dir)).count() == 999


def brute_append(cached, new):
    if not cached:
        return new
    out = list(cached)
    for x in reversed(new):
        if x <= 0:
            continue
        if x in out:
            break
        out.append(x)
    return out


def test_appending(spark):
    cases = [([1], [2, 1]), ([1], [1, 2, 3]), ([], [3, -1]), (None, [4]), ([5, 6], [0, -2, 7]), ([5], []), ([1, 2], [3, 2, 4, 4])]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<bigint>, b array<bigint>")
    rows = frame.select("i", caches.append_offsets_stopping(F.col("a"), F.col("b")).alias("x"), caches.append_offsets(F.col("a"), F.col("b")).alias("u"), caches.contains(F.col("a"), F.lit(5)).alias("has")).orderBy("i").collect()
    assert [r.x for r in rows] == [brute_append(a, b) for a, b in cases]
    assert [set(r.u) for r in rows] == [set(a or []) | {x for x in b if x > 0} for a, b in cases]
    assert [r.has for r in rows] == [5 in (a or []) for a, _ in cases]


def test_first_and_last(spark):
    pairs = spark.createDataFrame([(1, "k", "a"), (2, "k", "b"), (3, "m", "c")], "seq int, key string, value string")
    assert {r.key: r.value for r in caches.first_wins(pairs, "key", "value").collect()} == {"k": "a", "m": "c"}
    assert {r.key: r.value for r in caches.last_wins(pairs, "key", "value").collect()} == {"k": "b", "m": "c"}


def test_counters(spark):
    named = spark.createDataFrame([("a", 2), ("a", 3), ("b", 1)], "name string, n bigint")
    assert {r.name: r.value for r in stats.counters(named).collect()} == {"a": 2, "b": 1}
    assert {r.name: r.value for r in stats.counters(named, F.col("n")).collect()} == {"a": 5, "b": 1}
    assert stats.counter(named, "none").first().value == 0


def test_acl(spark):
    peers = acl.set_peer(acl.setup(spark, ["x", "y", "x"]), "x", False)
    who = spark.createDataFrame([("x",), ("y",), (None,)], "peer string")
    assert [r.peer for r in acl.allowed(who, peers).collect()] == ["y"]
    assert {r.peer: r.allowed for r in acl.is_allowed(who, acl.setup(spark)).collect()} == {"x": False, "y": False, None: False}


def test_expired(spark):
    rows = spark.createDataFrame([(0,), (5,), (10,), (11,)], "expires bigint")
    assert sorted(r.expires for r in log.expired(rows, F.lit(10)).collect()) == [5, 10]


def test_lines_after_their_records(logged):
    rows = logged.orderBy("seq").collect()
    assert all(b.offset - a.offset == len(a.line.encode()) + 1 for a, b in zip(rows, rows[1:], strict=False))
    assert logged.select(codec.line_hash(F.col("line")).alias("h"), "hash").where("h <> hash OR h IS NULL").count() == 0


def test_time_to_live_of_any_key(spark):
    from msgledger import schema as S
    from msgledger.operators import ttl

    a, b = "a" * 64, "b" * 64
    rows = [(1, a, 0, 7), (2, a, 4_999_999, 8), (3, a, 5_000_000, 9), (4, a, 5_000_000, 1), (5, b, 1, 2), (6, "", 3, 3), (7, None, 3, 3), (8, b, None, 3), (9, a, 9_999_999, 4), (10, a, 10_000_000, 5)]
    df = spark.createDataFrame(rows, "seq bigint, key string, micros bigint, value int")
    assert {r.seq: r.answer for r in ttl.answers(df).collect()} == {1: S.PASS, 2: 7, 3: S.PASS, 4: 9, 5: S.PASS, 6: S.INVALID, 7: S.INVALID, 8: S.ERROR, 9: 9, 10: S.PASS}
    assert {r.seq: r.answer for r in ttl.extended(df).collect()} == {1: S.PASS, 2: 7, 3: 7, 4: 7, 5: S.PASS, 6: S.INVALID, 7: S.INVALID, 8: S.ERROR, 9: 7, 10: 7}
    assert sorted(r.seq for r in ttl.admitted(df).collect()) == [1, 3, 5, 6, 10]  # an empty key is a key to it
    assert ttl.answers(df.limit(0)).count() == ttl.extended(df.limit(0)).count() == 0


def test_cached_values_live_their_time(spark):
    from pyspark.sql import functions as F

    from msgledger.operators import ttl

    sets = spark.createDataFrame([(1, 10, 0, "x"), (2, 10, 3, "y"), (3, 10, 6, "z"), (4, 20, 5, "w")], "seq bigint, key bigint, micros bigint, hash string")
    gets = spark.createDataFrame([(1, 10, -1), (2, 10, 0), (3, 10, 4), (4, 10, 5), (5, 10, 6), (6, 10, 11), (7, 20, 9), (8, 30, 1)], "seq bigint, key bigint, micros bigint")
    first = {r.seq: r.value for r in ttl.cached_at(sets, gets, F.min_by("hash", F.struct("micros", "seq")), 5).collect()}
    assert first == {1: None, 2: "x", 3: "x", 4: None, 5: "z", 6: None, 7: "w", 8: None}
    every = {r.seq: sorted(r.value) for r in ttl.cached_at(sets, gets, F.collect_set("hash"), 5).collect()}
    assert every[3] == ["x", "y"] and every[5] == ["z"] and every[4] == []


def test_an_index_lookup_reads_one_directory(spark, sf_dir, tmp_path):
    import re

    from msgledger.operators import index
    from msgledger.plans.queries import logged

    index.write(index.build(logged(spark, sf_dir)), str(tmp_path / "ix"))
    hash_ = logged(spark, sf_dir).first().hash
    own = index.lookup(spark.read.parquet(str(tmp_path / "ix")), hash_)
    assert own.count() == 1
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*pfx_hi", plan)


def test_helper_columns_do_not_clash(spark):
    from msgledger.operators import log

    df = spark.createDataFrame([(i, "x" * i, i, i, i) for i in range(1, 30)], "seq bigint, line string, bytes int, bucket int, own int")
    for bucket in (4, 100):
        got = log.with_offsets(df, base=0, bucket=bucket).orderBy("seq").collect()
        assert got[0].asDict().keys() == {*df.columns, "offset"}
        assert [r.offset for r in got] == [sum(j + 1 for j in range(1, i)) for i in range(1, 30)]
