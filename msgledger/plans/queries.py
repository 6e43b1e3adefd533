"""The driver's queries over the history operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgledger import schema as S
from msgledger.functions import codec, routing
from msgledger.operators import acl, caches, index, log, lookup, stats, ttl
from msgledger.plans.views import ARTS, LINES, OFFERS, SECONDS, arts, crc_sql, events, fields, index_sql, offers, stem_line, stems, table
from msgledger.sources import logfile, wire
from msgledger.streaming.ingest import Ledger

c = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


def placed_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's order and offsets; hashes and lines, most of its bytes, are made where they are used and not sorted.

    For a line's length any hash will do, as all are of one length but the null of a null.
    """
    return log.with_offsets(stems(spark, sf_dir), line=stem_line(hash=F.when(c("seq").isNotNull(), "0" * S.HASH_CHARS)))


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_stems(spark, sf_dir).select("seq", *[v.alias(k) for k, v in fields().items()], stem_line().alias("line"), "offset")


def requests_and_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return arts(spark, sf_dir).select("seq", "hash"), logged(spark, sf_dir).where("seq % 2 = 0")


WITH_LOG = f"WITH {ARTS}, {LINES}"


# ---------------------------------------------------------------- the flagship
@query(
    f"""WITH {OFFERS}, acc AS (SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY hash ORDER BY seq) = 1),
l AS (SELECT *, '{{' || hash || '}}' || chr(9) || printf('%010d', arrival) || '~----------~' || printf('%010d', arrival) || chr(9) || 'F' AS line FROM acc)
SELECT seq, hash, (4096 + coalesce(sum(strlen(line) + 1) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset",
  hash[1:3] AS pfx, hash[4:10] AS "key", ('0x' || hash[1:1])::INT AS db_index, 's' || hash[2:3] AS table_name FROM l"""
)
def new_offers_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which offers are new, and where would each be stored?"""
    fresh = lookup.first_seen(offers(spark, sf_dir)).withColumns({"token": F.lit("F"), "expires": F.lit(0).cast("bigint"), "date": c("arrival")})
    placed = log.with_offsets(log.with_lines(fresh))
    h = c("hash")
    return placed.select("seq", "hash", "offset", routing.prefix(h).alias("pfx"), routing.key(h).alias("key"), routing.db_index(h, 2).alias("db_index"), routing.table_name(h, 2).alias("table_name"))


# ---------------------------------------------------------------- keys and validation
@query(f"""WITH {ARTS} SELECT seq, hash, lower(hash[1:3]) AS route, hash[1:3] AS pfx, hash[4:10] AS "key", hash[1:10] AS full_key FROM arts""")
def hash_keys(spark, sf_dir):
    h = c("hash")
    return arts(spark, sf_dir).select("seq", "hash", routing.route(h).alias("route"), routing.prefix(h).alias("pfx"), routing.key(h).alias("key"), routing.full_key(h).alias("full_key"))


def damaged(spark, sf_dir):
    i = c("seq") % 50
    h = F.when(i == 0, "").when(i == 2, F.upper("hash")).when(i == 3, F.substring("hash", 1, 63)).when(i == 4, F.concat(F.lit("zz1"), F.substring("hash", 4, 64))).otherwise(c("hash"))
    return arts(spark, sf_dir).withColumns({"hash": h, "token": F.when(i == 1, "").otherwise(c("token")), "arrival": F.when(i == 5, 0).otherwise(c("arrival"))})


DAMAGED = """damaged AS (SELECT seq, CASE seq % 50 WHEN 0 THEN '' WHEN 2 THEN upper(hash) WHEN 3 THEN hash[1:63] WHEN 4 THEN 'zz1' || hash[4:64] ELSE hash END AS hash,
  CASE seq % 50 WHEN 1 THEN '' ELSE token END AS token, CASE seq % 50 WHEN 5 THEN 0 ELSE arrival END AS arrival FROM arts)"""


@query(
    f"""WITH {ARTS}, {DAMAGED} SELECT seq, hash, token, CASE arrival WHEN 0 THEN 1700000000 ELSE arrival END::BIGINT AS arrival,
CASE WHEN hash = '' OR token = '' THEN 225 WHEN length(hash) < 64 THEN -999 WHEN NOT regexp_matches(hash, '^[0-9a-fA-F]{{3}}') THEN 44 WHEN hash <> lower(hash) THEN 225 ELSE 0 END::INT AS status FROM damaged"""
)
def validate_articles(spark, sf_dir):
    return log.validate(damaged(spark, sf_dir), now=F.lit(1700000000)).select("seq", "hash", "token", "arrival", "status")


@query(
    f"""WITH {ARTS}, {DAMAGED}, r AS (SELECT seq, hash, CASE seq % 7 WHEN 0 THEN 0 WHEN 1 THEN 4096 WHEN 2 THEN -5 ELSE -1 END::BIGINT AS "offset" FROM damaged)
SELECT seq, "offset", CASE WHEN length(hash) < 64 THEN -999 WHEN "offset" > 0 THEN 60 WHEN "offset" <> -1 THEN 225 ELSE 0 END::INT AS status FROM r"""
)
def request_status(spark, sf_dir):
    i = c("seq") % 7
    offset = F.when(i == 0, 0).when(i == 1, 4096).when(i == 2, -5).otherwise(S.SEARCH).cast("bigint")
    return damaged(spark, sf_dir).select("seq", offset.alias("offset"), F.coalesce(lookup.request_status(c("hash"), offset), F.lit(0)).alias("status"))


# ---------------------------------------------------------------- the log
@query(f"{WITH_LOG} SELECT seq, line FROM lines")
def log_lines(spark, sf_dir):
    return log.with_lines(arts(spark, sf_dir)).select("seq", "line")


@query(f'{WITH_LOG} SELECT seq, "offset" FROM logged')
def log_offsets(spark, sf_dir):
    # buckets far smaller than in production, so that the two phases show at any scale
    return log.with_offsets(log.with_lines(arts(spark, sf_dir)), bucket=1000).select("seq", "offset")


@query(f"{WITH_LOG} SELECT count(*) AS lines, sum(strlen(line) + 1)::BIGINT AS bytes FROM lines")
def log_totals(spark, sf_dir):
    return log.totals(log.with_lines(arts(spark, sf_dir)))


@query(f"WITH {ARTS} SELECT seq, hash, token, arrival, greatest(expires, 0) AS expires, date, false AS bad FROM arts")
def line_parse_roundtrip(spark, sf_dir):
    lines = log.with_lines(arts(spark, sf_dir)).select("seq", codec.parse_line(c("line")).alias("p"), codec.line_is_bad(c("line")).alias("bad"))
    return lines.select("seq", "p.*", "bad")


@query(f"{WITH_LOG} SELECT seq, seq % 10 < 2 AS bad, CASE WHEN seq % 10 > 2 THEN hash END AS hash FROM lines")
def bad_lines(spark, sf_dir):
    """Lines without their brace, empty ones, and ones whose hash lacks a character, which are readable and have none."""
    i = c("seq") % 10
    line = F.when(i == 0, F.expr("substring(line, 2)")).when(i == 1, "").when(i == 2, F.concat(F.lit("{"), F.expr("substring(line, 3)"))).otherwise(c("line"))
    lines = log.with_lines(arts(spark, sf_dir)).select("seq", line.alias("line"))
    return lines.select("seq", codec.line_is_bad(c("line")).alias("bad"), codec.line_hash(c("line")).alias("hash"))


@query(f'{WITH_LOG} SELECT "offset", line FROM logged WHERE "offset" = 4096 + 102 * 100')
def line_at_offset(spark, sf_dir):
    return log.line_at(logged(spark, sf_dir), S.FIRST_OFFSET + 102 * 100)


@query(f'{WITH_LOG}, r AS (SELECT seq, seq * 51 + 4096 AS "offset" FROM arts) SELECT r.seq, r."offset", hash AS logged_hash FROM r LEFT JOIN logged ON r."offset" = logged."offset"')
def hash_at_offset(spark, sf_dir):
    requests = arts(spark, sf_dir).select("seq", (c("seq") * 51 + S.FIRST_OFFSET).alias("offset"))
    return log.hash_at(logged(spark, sf_dir), requests)


@query("SELECT DISTINCT 4095::INT AS bytes, (user_id % 16)::INT AS ka, (event_id % 64)::INT AS kl FROM events")
def header_roundtrip(spark, sf_dir):
    settings = events(spark, sf_dir).select((c("user_id") % 16).cast("int").alias("ka"), (c("event_id") % 64).cast("int").alias("kl")).distinct()
    header = settings.select(codec.encode_header(c("ka"), c("kl")).alias("h")).select(F.octet_length("h").alias("bytes"), codec.decode_header(c("h")).alias("s"))
    return header.select("bytes", c("s.Ka").alias("ka"), c("s.Kl").alias("kl"))


@query(f"WITH {ARTS}, p AS (SELECT max(arrival) AS now FROM arts) SELECT seq, expires FROM arts, p WHERE expires > 0 AND expires <= now")
def expired_articles(spark, sf_dir):
    own = arts(spark, sf_dir)
    now = own.agg(F.max("arrival").alias("now"))
    return log.expired(own.join(F.broadcast(now)), c("now")).select("seq", "expires")


# ---------------------------------------------------------------- the index
def index_query(width: int) -> Query:
    return lambda spark, sf_dir: index.build(logged(spark, sf_dir), width).select("pfx", "key", codec.decimal_list(c("offsets")).alias("o"))


AS_TEXT = """SELECT pfx, "key", array_to_string(offsets, ',') || ',' AS o FROM"""
for _width in (10, 3):
    query(f"{WITH_LOG}, {index_sql('ix', 'logged', _width)} {AS_TEXT} ix", f"index_build_w{_width}")(index_query(_width))


@query(f"{WITH_LOG}, {index_sql('ix', 'logged', 10)} {AS_TEXT} ix")
def index_rebuild(spark, sf_dir):
    return index.rebuild(logged(spark, sf_dir).select("offset", "line")).select("pfx", "key", codec.decimal_list(c("offsets")).alias("o"))


@query(f"{WITH_LOG}, {index_sql('ix', 'logged', 4)} {AS_TEXT} ix")
def index_merge(spark, sf_dir):
    own = logged(spark, sf_dir)
    halves = [index.build(own.where(f"seq % 2 = {i}"), 4) for i in (0, 1)]
    return index.merge(*halves).select("pfx", "key", codec.decimal_list(c("offsets")).alias("o"))


@query(f"""{WITH_LOG}, {index_sql("ix", "logged", 3)} SELECT pfx, "key", array_to_string(offsets, ',') || ',' AS o FROM ix WHERE pfx = sha256('7')[1:3] AND "key" = ''""")
def index_point_lookup(spark, sf_dir):
    import hashlib

    own = index.lookup(index.build(logged(spark, sf_dir), 3), hashlib.sha256(b"7").hexdigest(), 3)
    return own.select("pfx", "key", codec.decimal_list(c("offsets")).alias("o"))


@query(f"""{WITH_LOG}, {index_sql("ix", "logged", 3)} SELECT pfx, array_to_string(list_transform(offsets, lambda x: printf('%x', x)), ',') || ',' AS hex, array_to_string(offsets, ',') AS back, true AS ok FROM ix""")
def offsets_hex_codec(spark, sf_dir):
    coded = index.build(logged(spark, sf_dir), 3).select("pfx", codec.hex_list(c("offsets")).alias("hex"))
    return coded.withColumn("d", codec.from_hex_list(c("hex"))).select("pfx", "hex", F.array_join(c("d.offsets").cast("array<string>"), ",").alias("back"), "d.ok")


@query(f"""{WITH_LOG}, {index_sql("ix", "logged", 3)} SELECT pfx, array_to_string(offsets, ',') || ',abc,-5,0,' AS dec, array_to_string(offsets, ',') AS back FROM ix""")
def offsets_dec_codec(spark, sf_dir):
    coded = index.build(logged(spark, sf_dir), 3).select("pfx", F.concat(codec.decimal_list(c("offsets")), F.lit("abc,-5,0,")).alias("dec"))
    return coded.select("pfx", "dec", F.array_join(codec.from_decimal_list(c("dec")).cast("array<string>"), ",").alias("back"))


@query(
    """WITH RECURSIVE h(n, s) AS (SELECT 0, '' UNION ALL SELECT n + 1, s || d FROM h, (SELECT unnest(string_split('0 1 2 3 4 5 6 7 8 9 a b c d e f', ' ')) AS d) WHERE n < 3)
SELECT row_number() OVER (ORDER BY s) - 1 AS id, s AS combination FROM h WHERE n = 3"""
)
def hex_combinations(spark, sf_dir):
    return routing.hex_combinations(spark, S.ROUTE_CHARS)


# ---------------------------------------------------------------- lookups
HALF = f"{WITH_LOG}, history AS (SELECT * FROM logged WHERE seq % 2 = 0)"


@query(f"{HALF} SELECT seq, hash, CASE WHEN EXISTS (FROM history h WHERE h.hash[1:3] = logged.hash[1:3] AND h.hash = logged.hash) THEN 28 ELSE 241 END::INT AS status FROM logged")
def dup_lookup_verified(spark, sf_dir):
    history = placed_stems(spark, sf_dir).where("seq % 2 = 0")  # the index is made of it too, so that the log is put in order once
    hash_ = fields()["hash"]
    return lookup.verified(stems(spark, sf_dir).select("seq"), index.build(history.select(hash_.alias("hash"), "offset"), 3), history, 3, hash_=hash_, line=stem_line())


@query(f"{HALF} SELECT count(*) AS false_positives FROM logged WHERE hash NOT IN (SELECT hash FROM history) AND hash[1:3] IN (SELECT hash[1:3] FROM history)")
def dup_lookup_unverified_fp(spark, sf_dir):
    requests, history = requests_and_history(spark, sf_dir)
    return lookup.unseen(lookup.unverified(requests, index.build(history, 3), 3), history).agg(F.count("*").alias("false_positives"))


@query(f"{HALF} SELECT seq, hash FROM logged WHERE hash IN (SELECT hash FROM history)")
def seen_semi(spark, sf_dir):
    requests, history = requests_and_history(spark, sf_dir)
    return lookup.seen(requests, history).select("seq", "hash")


@query(f"{HALF} SELECT seq, hash FROM logged WHERE hash NOT IN (SELECT hash FROM history)")
def unseen_anti(spark, sf_dir):
    requests, history = requests_and_history(spark, sf_dir)
    return lookup.unseen(requests, history).select("seq", "hash")


SPLIT = f"WITH {OFFERS}, m AS (SELECT count(*) // 2 AS half FROM offers), history AS (SELECT hash FROM offers, m WHERE seq < half), batch AS (SELECT offers.* FROM offers, m WHERE seq >= half)"


def history_and_batch(spark, sf_dir):
    own = offers(spark, sf_dir)
    both = own.join(F.broadcast(own.agg(F.floor(F.count("*") / 2).alias("half"))))
    return both.where("seq < half").drop("half"), both.where("seq >= half").drop("half")


@query(f"{SPLIT} SELECT min(seq) AS seq, hash FROM batch WHERE hash NOT IN (SELECT hash FROM history) GROUP BY hash")
def check_then_add(spark, sf_dir):
    history, batch = history_and_batch(spark, sf_dir)
    return lookup.check_then_add(batch, history).select("seq", "hash")


@query(f"{SPLIT} SELECT seq, hash, CASE WHEN hash NOT IN (SELECT hash FROM history) AND row_number() OVER (PARTITION BY hash ORDER BY seq) = 1 THEN 60 ELSE 28 END::INT AS status FROM batch")
def add_status(spark, sf_dir):
    history, batch = history_and_batch(spark, sf_dir)
    return lookup.add_status(batch, history)


@query(f"WITH {OFFERS} SELECT min(seq) AS seq, hash FROM offers GROUP BY hash")
def first_seen(spark, sf_dir):
    return lookup.first_seen(offers(spark, sf_dir)).select("seq", "hash")


@query("SELECT min(doc_id) AS seq, sha256(text) AS hash FROM documents GROUP BY sha256(text)")
def first_seen_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(c("doc_id").alias("seq"), F.sha2("text", 256).alias("hash"))
    return lookup.first_seen(docs)


@query(f"WITH {OFFERS} SELECT hash, count(*) AS n, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS seqs FROM offers GROUP BY hash HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    groups = offers(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("seq")).alias("s")).where("n > 1")
    return groups.select("hash", "n", F.array_join(c("s").cast("array<string>"), ",").alias("seqs"))


DAY_US = 86_400_000_000


@query(
    f"""WITH RECURSIVE e AS (SELECT event_id AS seq, user_id AS "key", epoch_us(ts) AS micros FROM events),
first AS (SELECT "key", min(micros) AS micros FROM e GROUP BY "key"),
a AS (SELECT "key", micros FROM first UNION ALL SELECT "key", (SELECT min(e.micros) FROM e WHERE e."key" = a."key" AND e.micros >= a.micros + {DAY_US}) FROM a WHERE micros IS NOT NULL)
SELECT min(seq) AS seq, e."key", e.micros FROM a JOIN e ON a."key" = e."key" AND a.micros = e.micros GROUP BY e."key", e.micros"""
)
def ttl_dedup(spark, sf_dir):
    own = events(spark, sf_dir).select(c("event_id").alias("seq"), c("user_id").alias("key"), F.unix_micros("ts").alias("micros"))
    return ttl.admitted(own, DAY_US)


QUARTER_US = DAY_US // 4
KEYED = f"""{OFFERS}, e AS (SELECT o.seq, CASE WHEN o.seq % 50 = 0 THEN '' ELSE o.hash END AS "key", epoch_us(ts) AS micros, (o.seq % 7 + 1)::INT AS value
  FROM offers o JOIN events ON event_id = seq)"""


def lives_sql(source: str, ttl_us: int) -> str:
    """``s``: the rows of a table (seq, key, micros) that are let in, as (key, since, first)."""
    return f"""a AS (SELECT "key", min(micros) AS micros FROM {source} GROUP BY "key"
  UNION ALL SELECT "key", (SELECT min(k.micros) FROM {source} k WHERE k."key" = a."key" AND k.micros >= a.micros + {ttl_us}) FROM a WHERE micros IS NOT NULL),
s AS (SELECT k."key", k.micros AS since, min(k.seq) AS first FROM a JOIN {source} k ON a."key" = k."key" AND a.micros = k.micros GROUP BY ALL)"""


def keyed(spark, sf_dir):
    """Offers as (seq, key, micros, value): keys are hashes, each fiftieth is empty."""
    key = F.when(c("seq") % 50 == 0, "").otherwise(c("hash")).alias("key")
    times = events(spark, sf_dir).select(c("event_id").alias("seq"), F.unix_micros("ts").alias("micros"))
    return offers(spark, sf_dir).join(times, "seq").select("seq", key, "micros", (c("seq") % 7 + 1).cast("int").alias("value"))


@query(
    f"""WITH RECURSIVE {KEYED}, k AS (SELECT * FROM e WHERE "key" <> ''), {lives_sql("k", QUARTER_US)}
SELECT k.seq, k."key", CASE WHEN k.seq = s.first THEN 241 ELSE f.value END::INT AS answer FROM k ASOF JOIN s ON k."key" = s."key" AND k.micros >= s.since JOIN k f ON f.seq = s.first
UNION ALL SELECT seq, "key", -999 FROM e WHERE "key" = ''"""
)
def ttl_answers(spark, sf_dir):
    return ttl.answers(keyed(spark, sf_dir), QUARTER_US)


@query(
    f"""WITH {KEYED}, k AS (SELECT *, coalesce(micros - lag(micros) OVER (PARTITION BY "key" ORDER BY micros, seq) >= {QUARTER_US}, true) AS new FROM e WHERE "key" <> ''),
n AS (SELECT *, max(CASE WHEN new THEN micros END) OVER (PARTITION BY "key" ORDER BY micros, seq) AS since FROM k),
f AS (SELECT "key", micros AS since, value FROM k WHERE new)
SELECT seq, n."key", CASE WHEN new THEN 241 ELSE f.value END::INT AS answer FROM n JOIN f ON n."key" = f."key" AND n.since = f.since UNION ALL SELECT seq, "key", -999 FROM e WHERE "key" = ''"""
)
def ttl_extend(spark, sf_dir):
    return ttl.extended(keyed(spark, sf_dir), QUARTER_US)


#: Sets are the even events, gets the odd ones; keys are users.
CACHED = f"""{OFFERS}, u AS (SELECT event_id AS seq, user_id AS "key", epoch_us(ts) AS micros, hash FROM events JOIN offers ON event_id = seq),
k AS (SELECT * FROM u WHERE seq % 2 = 0), g AS (SELECT * FROM u WHERE seq % 2 = 1), {lives_sql("k", DAY_US)},
asked AS (SELECT g.seq, g."key", g.micros, CASE WHEN g.micros < since + {DAY_US} THEN since END AS since, first FROM g ASOF LEFT JOIN s ON g."key" = s."key" AND g.micros >= s.since)"""


def sets_and_gets(spark, sf_dir):
    own = events(spark, sf_dir).select(c("event_id").alias("seq"), c("user_id").alias("key"), F.unix_micros("ts").alias("micros"))
    own = own.join(offers(spark, sf_dir).select("seq", "hash"), "seq")
    return own.where("seq % 2 = 0"), own.where("seq % 2 = 1")


@query(f"""WITH RECURSIVE {CACHED} SELECT asked.seq, asked."key", CASE WHEN since IS NOT NULL THEN k.hash END AS value FROM asked LEFT JOIN k ON k.seq = asked.first""")
def l2_ttl(spark, sf_dir):
    return ttl.cached_at(*sets_and_gets(spark, sf_dir), F.min_by("hash", F.struct("micros", "seq")), DAY_US)


@query(
    f"""WITH RECURSIVE {CACHED}, l AS (SELECT k.seq, k."key", k.micros, s.since FROM k ASOF JOIN s ON k."key" = s."key" AND k.micros >= s.since)
SELECT asked.seq, asked."key", coalesce(string_agg(l.seq::VARCHAR, ',' ORDER BY l.seq), '') AS value
FROM asked LEFT JOIN l ON asked."key" = l."key" AND asked.since = l.since AND l.micros <= asked.micros GROUP BY ALL"""
)
def l3_ttl(spark, sf_dir):
    sets, gets = sets_and_gets(spark, sf_dir)
    own = F.array_join(F.array_sort(F.collect_set(F.when(c("since").isNotNull(), c("seq")))).cast("array<string>"), ",")
    return ttl.cached_at(sets, gets, own, DAY_US)


@query(
    f"""WITH {OFFERS}, acc AS (SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY hash ORDER BY seq) = 1),
l AS (SELECT *, '{{' || hash || '}}' || chr(9) || printf('%010d', arrival) || '~----------~' || printf('%010d', arrival) || chr(9) || 'F' AS line FROM acc)
SELECT seq, hash, (4096 + coalesce(sum(strlen(line) + 1) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", hash[1:3] AS pfx, hash[4:10] AS "key" FROM l"""
)
def ingest_batches(spark, sf_dir):
    """Three batches of offers, the second with half of the first again, into a new ledger; what it holds, and each line's index entry."""
    ledger = Ledger(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/ledger-{uuid.uuid4().hex}")
    own = offers(spark, sf_dir).withColumns({"token": F.lit("F"), "expires": F.lit(0).cast("bigint"), "date": c("arrival")})
    last = own.agg(F.max("seq")).first()[0] or 0
    cuts = [0, last // 3, 2 * last // 3, last + 1]
    for lo, hi in ((0, cuts[1]), (cuts[1] // 2, cuts[2]), (cuts[2], cuts[3])):
        ledger.append(own.where((c("seq") >= lo) & (c("seq") < hi)))
    placed = index.entries(ledger.index())
    return ledger.read().select("seq", "hash", "offset").join(placed, "offset").select("seq", "hash", "offset", "pfx", "key")


# ---------------------------------------------------------------- shards
@query("SELECT * FROM (VALUES (0, 1, 4096, 100000, '1 DB with 4096 tables'), (1, 4096, 1, 500, '4096 separate DBs'), (2, 16, 256, 2000, '16 DBs with 256 tables each'), (3, 64, 64, 1000, '64 DBs with 64 tables each'), (4, 128, 32, 500, '128 DBs with 32 tables each'), (5, 512, 8, 250, '512 DBs with 8 tables each')) t(mode, dbs, tables, cache_pages, text)")
def shard_config(spark, sf_dir):
    return routing.mode_table(spark)


#: For each mode, its database and table as SQL over the first 12 bits v and their text p.
ROUTES = {0: ("0", "'s' || p"), 1: ("v", "'shash'"), 2: ("v >> 8", "'s' || p[2:3]"), 3: ("v >> 6", "printf('s%02x', v & 63)"), 4: ("v >> 5", "printf('s%02x', v & 31)"), 5: ("v >> 3", "printf('s%x', v & 7)")}
BITS = "SELECT *, hash[1:3] AS p, ('0x' || hash[1:3])::INT AS v FROM"


def shard_route(mode: int) -> Query:
    return lambda spark, sf_dir: arts(spark, sf_dir).select("seq", routing.db_index(c("hash"), mode).alias("db_index"), routing.table_name(c("hash"), mode).alias("table_name"))


for _mode, (_db, _table) in ROUTES.items():
    query(f"WITH {ARTS}, b AS ({BITS} arts) SELECT seq, ({_db})::INT AS db_index, {_table} AS table_name FROM b", f"shard_route_m{_mode}")(shard_route(_mode))


def _catalog_sql() -> str:
    path = {0: "'hashdb.sqlite3'", 1: "'hashdb_' || printf('%03x', db_index) || '.sqlite3'"}
    one = "SELECT {m} AS mode, db_index, printf('%03x', db_index) AS db_name, {path} AS path, table_name FROM (SELECT ({db})::INT AS db_index, {t} AS table_name FROM b)"
    parts = [one.format(m=m, db=db, t=t, path=path.get(m, "'hashdb_' || printf('%03d', db_index) || '.sqlite3'")) for m, (db, t) in ROUTES.items()]
    return "WITH b AS (SELECT v::INT AS v, printf('%03x', v) AS p FROM range(4096) t(v)) " + " UNION ALL ".join(parts)


@query(_catalog_sql())
def shard_catalog(spark, sf_dir):
    return routing.catalog(spark)


@query(
    f"WITH {ARTS}, b AS ({BITS} arts), r AS ("
    + " UNION ALL ".join(f"SELECT {m} AS mode, ({db})::INT AS db_index, {t} AS table_name FROM b" for m, (db, t) in ROUTES.items())
    + ") SELECT mode, db_index, count(*) AS rows, count(DISTINCT table_name) AS tables FROM r GROUP BY mode, db_index"
)
def shard_balance(spark, sf_dir):
    return stats.shard_balance(arts(spark, sf_dir).select("hash"))


@query("SELECT mode, (p * 4096 // 1048576)::BIGINT AS mb_per_db, ((p * 4096 // 1048576) * d)::BIGINT AS cache_mb, (d * 8 // 10)::BIGINT AS conn_mb, ((p * 4096 // 1048576) * d + d * 8 // 10 + 5)::BIGINT AS estimated_mb FROM (VALUES (0, 1, 100000), (1, 4096, 500), (2, 16, 2000), (3, 64, 1000), (4, 128, 500), (5, 512, 250)) t(mode, d, p)")
def memory_model(spark, sf_dir):
    return routing.memory_model(routing.mode_table(spark))


@query("SELECT mode, '?cache=shared&mode=rwc&_journal_mode=WAL&_synchronous=NORMAL&_cache_size=' || p || '&_temp_store=memory&_mmap_size=268435456' AS options FROM (VALUES (0, 100000), (1, 500), (2, 2000), (3, 1000), (4, 500), (5, 250)) t(mode, p)")
def connection_options(spark, sf_dir):
    return routing.connection_options(routing.mode_table(spark))


# ---------------------------------------------------------------- counters and rates
@query(f"{HALF} SELECT CASE WHEN hash IN (SELECT hash FROM history) THEN 'dupes' ELSE 'pass' END AS name, count(*) AS value FROM logged GROUP BY 1")
def counters(spark, sf_dir):
    answered = dup_lookup_verified(spark, sf_dir)
    names = F.create_map(*[x for n, code in S.CODES.items() for x in (F.lit(code), F.lit(n))])
    return stats.counters(answered.select(names[c("status")].alias("name")))


@query("SELECT (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, 0::BIGINT AS missing")
def counter_read(spark, sf_dir):
    named = events(spark, sf_dir).select(c("event_type").alias("name"))
    return stats.counter(named, "error").select(c("value").alias("errors")).join(stats.counter(named, "no such").select(c("value").alias("missing")))


@query(f"WITH {ARTS} SELECT token AS name, sum(seq % 5)::BIGINT AS value FROM arts GROUP BY token")
def counters_add(spark, sf_dir):
    return stats.counters(arts(spark, sf_dir).select(c("token").alias("name"), "seq"), c("seq") % 5)


@query(f"WITH {ARTS} SELECT token AS name, count(*) AS value FROM arts GROUP BY token")
def counters_over_shards(spark, sf_dir):
    sharded = arts(spark, sf_dir).groupBy(routing.route(c("hash")).alias("shard"), c("token").alias("name")).agg(F.count("*").alias("value"))
    return stats.over_shards(sharded)


@query(f"SELECT ({SECONDS} // 10 * 10)::BIGINT AS start, count(*) AS n, printf('%.2f', count(*) / 10.0) AS per_second FROM events GROUP BY 1")
def rate_10s(spark, sf_dir):
    return stats.rate(events(spark, sf_dir))


# ---------------------------------------------------------------- caches
@query(f'{WITH_LOG} SELECT hash[1:2] AS "key", arg_min(hash, seq) AS hash FROM logged GROUP BY 1')
def l2_first_wins(spark, sf_dir):
    return caches.first_wins(logged(spark, sf_dir).withColumn("key", F.substring("hash", 1, 2)), "key", "hash")


@query(f"""{WITH_LOG} SELECT printf('%x', "offset" % 16) AS shard, count(*) AS n FROM logged GROUP BY 1""")
def l2_shards(spark, sf_dir):
    return caches.with_shard(logged(spark, sf_dir)).groupBy("shard").agg(F.count("*").alias("n"))


@query(f'{WITH_LOG}, r AS (SELECT seq, seq * 51 + 4096 AS "offset" FROM arts) SELECT r."offset", r.seq, hash FROM r LEFT JOIN logged USING ("offset")')
def l2_lookup(spark, sf_dir):
    requests = arts(spark, sf_dir).select("seq", (c("seq") * 51 + S.FIRST_OFFSET).alias("offset"))
    return caches.look_up(requests, caches.first_wins(logged(spark, sf_dir), "offset", "hash"), "offset")


@query(f"""{WITH_LOG}, {index_sql("ix", "history", 4)}, history AS (SELECT * FROM logged WHERE seq % 2 = 0)
SELECT seq, array_to_string(offsets, ',') AS offsets FROM arts LEFT JOIN ix ON arts.hash[1:3] = ix.pfx AND arts.hash[4:4] = ix."key" """.replace(index_sql("ix", "history", 4) + ", history AS (SELECT * FROM logged WHERE seq % 2 = 0)", "history AS (SELECT * FROM logged WHERE seq % 2 = 0), " + index_sql("ix", "history", 4)))
def l3_lookup(spark, sf_dir):
    requests, history = requests_and_history(spark, sf_dir)
    k = F.substring("hash", 1, 4)
    cache = index.build(history, 4).select(F.concat("pfx", "key").alias("key"), F.array_join(c("offsets").cast("array<string>"), ",").alias("offsets"))
    return caches.look_up(requests.select("seq", k.alias("key")), cache, "key").select("seq", "offsets")


@query(f"WITH {OFFERS} SELECT hash, max(seq) AS seq, arg_max(arrival, seq) AS arrival FROM offers GROUP BY hash")
def l1_last_wins(spark, sf_dir):
    own = offers(spark, sf_dir).withColumn("both", F.struct(c("seq").alias("s"), c("arrival").alias("a")))
    return caches.last_wins(own, "hash", "both").select("hash", c("both.s").alias("seq"), c("both.a").alias("arrival"))


def appended(spark, sf_dir):
    """A cached list of seqs for each hash in the first half of the offers, and new ones in the second that overlap it."""
    own = offers(spark, sf_dir).groupBy(F.substring("hash", 1, 3).alias("key")).agg(F.array_sort(F.collect_list("seq")).alias("s"))
    half = F.ceil(F.size("s") / 2).cast("int")
    return own.select("key", F.slice("s", 1, half).alias("cached"), F.concat(F.slice("s", half, F.size("s")), F.array(F.lit(-1).cast("bigint"))).alias("new"))


@query(f"""WITH {OFFERS} SELECT hash[1:3] AS "key", array_to_string(list_sort(list(seq) FILTER (seq > 0 OR r <= h)), ',') AS merged
FROM (SELECT *, row_number() OVER (PARTITION BY hash[1:3] ORDER BY seq) AS r, ceil(count(*) OVER (PARTITION BY hash[1:3]) / 2) AS h FROM offers) GROUP BY 1""")
def l3_append(spark, sf_dir):
    merged = F.array_sort(caches.append_offsets(c("cached"), c("new")))
    return appended(spark, sf_dir).select("key", F.array_join(merged.cast("array<string>"), ",").alias("merged"))


@query(f"""WITH {OFFERS} SELECT hash[1:3] AS "key", max(seq) AS value, count(*) = 1 AS cached FROM offers GROUP BY 1""")
def l3_contains(spark, sf_dir):
    latest = F.greatest(F.array_max("cached"), F.array_max("new"))
    return appended(spark, sf_dir).select("key", latest.alias("value"), caches.contains(c("cached"), latest).alias("cached"))


@query(f"""WITH {OFFERS} SELECT hash[1:3] AS "key", array_to_string(list(seq ORDER BY CASE WHEN r <= h THEN r ELSE 2 * n - r END), ',') AS merged
FROM (SELECT *, row_number() OVER (PARTITION BY hash[1:3] ORDER BY seq) AS r, count(*) OVER (PARTITION BY hash[1:3]) AS n, ceil(count(*) OVER (PARTITION BY hash[1:3]) / 2) AS h FROM offers) GROUP BY 1""")
def l3_append_exact(spark, sf_dir):
    merged = caches.append_offsets_stopping(c("cached"), c("new"))
    return appended(spark, sf_dir).select("key", F.array_join(merged.cast("array<string>"), ",").alias("merged"))


@query(f'WITH {ARTS} SELECT seq, (seq & (seq - 1)) = 0 AS pow2 FROM arts')
def power_of_two(spark, sf_dir):
    return arts(spark, sf_dir).select("seq", codec.is_pow2(c("seq")).alias("pow2"))


@query("SELECT event_id AS seq, greatest(24 - strlen(event_type), 0)::INT AS padding, strlen(event_type)::INT AS bytes, event_type AS text FROM events")
def null_padding(spark, sf_dir):
    own = events(spark, sf_dir).select(c("event_id").alias("seq"), c("event_type").alias("t"))
    padded = own.select("seq", "t", codec.left_pad(codec.null_pad(c("t"), 20), 24).alias("p"))
    return padded.select("seq", (F.octet_length("p") - F.octet_length("t")).alias("padding"), F.octet_length("t").alias("bytes"), codec.remove_null_pad(c("p")).alias("text"))


@query(f"SELECT event_id AS seq, {SECONDS}::BIGINT AS seconds, (epoch_us(ts) // 1000)::BIGINT AS millis, epoch_us(ts) AS micros, epoch_us(ts) * 1000 AS nanos FROM events")
def epoch_stamps(spark, sf_dir):
    return events(spark, sf_dir).select(c("event_id").alias("seq"), codec.epochs(c("ts")).alias("e")).select("seq", "e.*")


@query("SELECT 3::INT AS least, 9::INT AS most, 7::BIGINT AS kinds, count(*) AS n FROM events")
def random_between(spark, sf_dir):
    drawn = events(spark, sf_dir).select(codec.random_int(3, 9, 1).alias("x"))
    return drawn.agg(F.min("x").alias("least"), F.max("x").alias("most"), F.count_distinct("x").alias("kinds"), F.count("*").alias("n"))


@query("SELECT i AS seq, sha256('test-message-' || i || '-12345678901234567890') AS hash, 'F' AS token, 1700000000::BIGINT AS arrival, 1702592000::BIGINT AS expires, 1700000000::BIGINT AS date FROM range(10000) t(i)")
def bulk_articles(spark, sf_dir):
    return logfile.bulk_articles(spark, 10_000, 1_700_000_000)


# ---------------------------------------------------------------- wire, access, set operations
@query(
    f"""WITH {ARTS}, f AS (SELECT seq, concat_ws(' ', hash, token, arrival, expires, date) AS fields FROM arts), {crc_sql("seq, fields", "fields", "f")}
SELECT seq, 'ADD ' || crc || ' ' || fields AS line FROM crcs"""
)
def wire_encode(spark, sf_dir):
    return wire.encoded(arts(spark, sf_dir)).select("seq", "line")


@query(
    f"""WITH {ARTS}, p AS (SELECT CASE seq % 10 WHEN 0 THEN 401 WHEN 1 THEN 402 WHEN 2 THEN 401 WHEN 3 THEN 403 ELSE 60 END::INT AS code FROM arts)
SELECT code, count(*) AS n, count(*) FILTER (code = 60) AS hashes FROM p GROUP BY code"""
)
def wire_parse(spark, sf_dir):
    i = c("seq") % 10
    bad = F.when(i == 0, F.concat("line", F.lit(" more"))).when(i == 1, F.concat(F.lit("ADD 0 "), F.substring_index("line", " ", -5))).when(i == 2, F.lit("ADD")).otherwise(c("line"))
    good = wire.encoded(arts(spark, sf_dir))
    number = codec.wire_line(F.concat_ws(" ", "hash", "token", F.lit("x"), F.lit("1"), F.lit("2")))
    lines = good.select(F.when(i == 3, number).otherwise(bad).alias("line"))
    return wire.parsed(lines).groupBy("code").agg(F.count("*").alias("n"), F.count("hash").alias("hashes"))


@query(f'WITH {crc_sql("doc_id", "text", "documents")} SELECT doc_id, crc FROM crcs')
def crc_hex(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", codec.crc(c("text")).alias("crc"))


@query("SELECT event_id AS seq, user_id::VARCHAR AS peer FROM events WHERE user_id IN (1, 2, 3, 8)")
def acl_filter(spark, sf_dir):
    peers = acl.set_peer(acl.set_peer(acl.setup(spark, ["1", "2", "3", "5", "1"]), "5", False), "8", True)
    return acl.allowed(events(spark, sf_dir).select(c("event_id").alias("seq"), c("user_id").cast("string").alias("peer")), peers)


@query("SELECT event_id AS seq, user_id IN (1, 2, 3) AS allowed FROM events")
def acl_check(spark, sf_dir):
    peers = acl.setup(spark, ["1", "2", "3"])
    return acl.is_allowed(events(spark, sf_dir).select(c("event_id").alias("seq"), c("user_id").cast("string").alias("peer")), peers).select("seq", "allowed")


@query(
    f"{SPLIT} SELECT 'new' AS op, count(*) AS n FROM (SELECT hash FROM batch EXCEPT SELECT hash FROM history) UNION ALL SELECT 'both', count(*) FROM (SELECT hash FROM batch INTERSECT SELECT hash FROM history) UNION ALL SELECT 'all', count(*) FROM (SELECT hash FROM batch UNION SELECT hash FROM history)"
)
def set_ops(spark, sf_dir):
    history, batch = (x.select("hash") for x in history_and_batch(spark, sf_dir))
    sizes = [("new", batch.subtract(history)), ("both", batch.intersect(history)), ("all", batch.union(history).distinct())]
    return reduce(DataFrame.union, [x.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, x in sizes])


__all__ = ["QUERIES", "SQL", "new_offers_placed"]
