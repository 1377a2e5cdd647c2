"""Import of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators.importing import import_outcomes
from marginalia.operators.indicators import dedup_key
from marginalia.sources.records import RIS_END, ris_fields, ris_record
from marginalia.sources.store import stored
from marginalia.sources.versions import VersionedTable, file_system


def stream_ris(spark: SparkSession, folder: str) -> DataFrame:
    return ris_record(ris_fields(spark.readStream.option("lineSep", "\n" + RIS_END).text(folder)), "ris")


def import_stream(records: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's new records to the Parquet table: a record whose identity is there already, or twice in the
    batch, is left out. A batch that runs again after a failure adds nothing twice."""
    key = dedup_key(F.col("doi"), F.lit(False), F.col("source"), F.col("external_id"), F.col("title"), F.col("year"))

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("hash", key).dropDuplicates(["hash"])
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(table).select("hash"), "hash", "left_anti")
        new.write.mode("append").parquet(table)

    return records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Events per type and window of event time; rows later than the watermark are dropped when streaming."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "5 minutes") -> DataFrame:
    """Sessions of each user: events that follow one another within the gap; a session is told when the watermark has passed it."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("session.start").alias("start"), "n", "total")


class ImportState:
    """What an import has accepted so far, for a stream of batches: every rule of import_outcomes, whatever the batches are.

    Two stored tables hold the accepted identities, by hash and by title and year. A batch reads the buckets of its own hashes and
    titles alone, and writes those that it changes. Batches come in the order of their records' ids. A batch that runs again
    after a failure sees the state before it, as rows and marks carry the batch's number, and gives the same outcomes.
    """

    COLUMNS = ("id", "doi", "source", "strict", "hash", "title_year", "kind")

    def __init__(self, spark: SparkSession, folder: str, known: DataFrame | None = None, buckets: int = 64):
        self.folder, self.tables = folder, {}
        for key in ("hash", "title_year"):
            at = f"{folder}/{key}"
            fs, path = file_system(spark, f"{at}/versions")
            if fs.exists(path):
                self.tables[key] = VersionedTable(spark, at)
                continue
            if known is None:
                known = spark.createDataFrame([], "id long, doi string, source string, strict boolean, hash string, title_year string, kind string, own boolean")
            rows = known.where(F.col(key).isNotNull()).select(*self.COLUMNS, F.coalesce("own", F.lit(False)).alias("own"), F.lit(-1).cast("long").alias("batch"), F.lit(None).cast("long").alias("met"))
            self.tables[key] = VersionedTable.create(rows, at, [key], buckets)

    def step(self, records: DataFrame, batch: int) -> DataFrame:
        """The outcomes of a batch of identities; the state holds them afterwards."""
        rows = stored(records.select(*self.COLUMNS), "batch")
        met = []
        for key, table in self.tables.items():
            keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
            met.append(table.read(buckets=table.touched(keys)).join(keys, key, "left_semi").where(F.col("batch") < batch))
        known = met[0].unionByName(met[1].select(*met[0].columns)).dropDuplicates(["id"])
        known = stored(known.withColumn("own", F.col("own") & (F.col("met").isNull() | (F.col("met") >= batch))), "batch-known")
        out = import_outcomes(rows, known)
        out.write.mode("overwrite").parquet(f"{self.folder}/outcomes/batch={batch}")
        out = rows.sparkSession.read.schema(out.schema).parquet(f"{self.folder}/outcomes/batch={batch}")
        new = rows.join(out.where("outcome = 'imported'").select("id"), "id", "left_semi").select(*self.COLUMNS, F.lit(False).alias("own"), F.lit(batch).cast("long").alias("batch"), F.lit(None).cast("long").alias("met"))
        again = out.where("outcome = 'again'").select(F.col("kept").alias("id"), F.lit(True).alias("again")).distinct()
        now = F.when(F.col("again"), F.lit(batch).cast("long")).when(F.col("met") < batch, F.col("met"))
        for key, table in self.tables.items():
            own = new.where(F.col(key).isNotNull())
            keys = own.select(key).union(known.join(again, "id").where(F.col(key).isNotNull()).select(key))
            change = lambda old, own=own: old.where(F.col("batch") != batch).join(again, "id", "left").withColumn("met", now).select(*own.columns).unionByName(own)
            table.rewrite(table.touched(keys), change)
        return out

    def outcomes(self, spark: SparkSession) -> DataFrame:
        """id, outcome, kept of all batches."""
        fs, path = file_system(spark, f"{self.folder}/outcomes")
        if not fs.exists(path):  # no batch yet
            return spark.createDataFrame([], "id long, outcome string, kept long")
        return spark.read.parquet(f"{self.folder}/outcomes").select("id", "outcome", "kept")


def import_with_state(records: DataFrame, folder: str, checkpoint: str, known: DataFrame | None = None) -> StreamingQuery:
    """Import identities as they arrive, with all rules; outcomes are in ImportState(spark, folder).outcomes()."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            ImportState(batch.sparkSession, folder, known).step(batch, number)

    return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
