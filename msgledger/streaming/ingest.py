"""Micro-batches into the log and its index."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from msgledger import schema as S
from msgledger.functions import codec
from msgledger.operators import index, log, lookup

LOGGED = "seq bigint, hash string, token string, arrival bigint, expires bigint, date bigint, line string, offset bigint"


#: Hashes of a batch, as estimated, that are broadcast to the log's scan (64 bytes each); a larger batch is joined by shuffle.
BROADCAST_HASHES = 1_000_000
#: The period of the batch ticker and its floor, in milliseconds.
BATCH_MS, LEAST_MS = 5120, 4


@dataclass
class Ledger:
    """A log as a Parquet table in a folder. One writer at a time; readers see whole batches."""

    spark: SparkSession
    path: str
    #: Where the log ends, once it is known: the log is read for it by the first batch of a writer alone.
    end: int | None = field(default=None, init=False)

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOGGED).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOGGED)

    def next_offset(self) -> int:
        if self.end is None:
            last = self.read().agg(F.max(F.col("offset") + codec.line_bytes(F.col("line")))).first()[0]
            self.end = S.FIRST_OFFSET if last is None else last
        return self.end

    def new(self, offers: DataFrame) -> DataFrame:
        """What of a batch the log lacks, each hash once. A batch of bounded size goes to the log's hashes, whose scan isn't shuffled; a larger one meets all of them."""
        first = lookup.first_seen(offers)
        if self.next_offset() == S.FIRST_OFFSET:
            return first
        known = self.read().select("hash")
        # the estimate chooses between two exact ways
        if offers.agg(F.approx_count_distinct("hash")).first()[0] <= BROADCAST_HASHES:
            known = known.join(F.broadcast(offers.select("hash").distinct()), "hash", "left_semi")
        return lookup.unseen(first, known)

    def append(self, articles: DataFrame) -> None:
        """Write what is new of ``articles(seq, hash, token, ...)``, with line and offset.

        A batch that comes again adds nothing, as its hashes are known then. What is new is found once and written beside
        the log, as placing it reads it several times; that folder goes at the end, or with the next batch after a failure.
        """
        valid = log.validate(articles).where("status = 0").drop("status")
        base = self.next_offset()
        columns = [f.split()[0] for f in LOGGED.split(", ")]
        fresh = self.new(valid).select([x for x in columns if x not in ("line", "offset")])
        fresh.write.mode("overwrite").parquet(f"{self.path}/fresh")
        placed = log.with_lines(log.with_offsets(self.spark.read.schema(fresh.schema).parquet(f"{self.path}/fresh"), base=base, line=log.line()))
        written = Observation()
        self.end = None  # unknown while the batch is being written
        placed.select(*columns).observe(written, F.max(F.col("offset") + codec.line_bytes(F.col("line"))).alias("end")).write.mode("append").parquet(f"{self.path}/log")
        self.end = written.get["end"] or base
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/fresh")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def index(self) -> DataFrame:
        return index.build(self.read())

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Append a stream's batches; ``trigger`` as for ``DataStreamWriter.trigger``, all that is there by default, ``ticker()`` for a running stream."""
        return stream.writeStream.foreachBatch(lambda batch, _: self.append(batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ticker(millis: int = BATCH_MS) -> dict[str, str]:
    """The trigger of a batch every so many milliseconds, LEAST_MS at least."""
    return {"processingTime": f"{max(millis, LEAST_MS)} milliseconds"}
