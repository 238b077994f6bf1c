"""Rows clustered by a key and a position, so that a page reads the files around its marker and not a whole history.

A run (what one batch appends) is range-partitioned by (key, position) into parts, a folder each, and an index tells for each
key and part the first and last position and the number of rows. A page of n rows behind a marker lies in the part that
holds the marker and the parts behind it until these have more than n rows, in each run; the index names them by a join
on the key. What is read for a page thus depends on the page and the number of runs, not on how long the key's history is;
of the index, which has one row for each key and part, a page reads the key's rows.

A run that is appended again replaces itself; rows that several runs hold count once. ``compact`` makes one run of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.functions.session import shared_folder
from ledgerloom.operators import reports

HISTORY = "address string, ledger_index long, hash string, tx_type string"
HOLDERS = "issuance_id long, as_of_ledger long, object_id string, address string, amount decimal(38,18), flags long"


class Clustered:
    """Rows of a schema in runs under a folder, by the columns of a key and of a position (both lead the schema)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], position: list[str]):
        self.spark, self.path, self.key, self.position = spark, path, key, position
        self.schema = StructType.fromDDL(schema)

    def append(self, rows: DataFrame, run: int, parts: int) -> None:
        """Writes rows as a run, in about so many parts: as many as give files of a convenient size."""
        order = [*self.key, *self.position]
        told = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema))
        spread = told.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
        spread.sortWithinPartitions("part", *order).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/rows/run={run}")
        at = F.struct(*self.position)
        index = self._rows([f"{self.path}/rows/run={run}"]).groupBy(*self.key, "part").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count_distinct(*self.position).alias("n"))
        index.repartitionByRange(*self.key).sortWithinPartitions(*self.key).write.mode("overwrite").parquet(f"{self.path}/index/run={run}")

    def compact(self, into: Clustered, parts: int) -> None:
        """All runs as the first run of another table."""
        into.append(self.rows(), 0, parts)

    def _rows(self, paths: list[str]) -> DataFrame:
        schema = StructType(list(self.schema)).add("run", "integer").add("part", "integer")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*paths)

    def rows(self) -> DataFrame:
        return self._rows([f"{self.path}/rows"]).drop("run", "part").distinct()

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    def chosen(self, asked: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
        """request_id, the key, run, part: where the pages of asked lie. asked has request_id, the key, after (a struct of the
        position, or null: from the beginning), forward, page (rows), and what low and high name: the least and greatest
        value of the position's first column, null for none."""
        lead = self.position[0]
        spans = asked.join(self.index(), self.key)
        beyond = F.col("after").isNull() | F.when(F.col("forward"), F.col("last") > F.col("after")).otherwise(F.col("first") < F.col("after"))
        spans = spans.filter(beyond)
        if low is not None:
            spans = spans.filter(low.isNull() | (F.col("last")[lead] >= low))
        if high is not None:
            spans = spans.filter(high.isNull() | (F.col("first")[lead] <= high))
        order = Window.partitionBy("request_id", "run").orderBy(F.when(F.col("forward"), F.col("part")).otherwise(-F.col("part")))
        # The first part may lie partly before the marker, so only those between it and this one count; page + 1 rows tell whether more follow.
        before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)) - F.first("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        return spans.withColumn("_before", F.coalesce(before, F.lit(0))).filter("_before <= page").select("request_id", *self.key, "run", "part")

    def seek(self, chosen: DataFrame) -> DataFrame:
        """The rows of the chosen parts that belong to the chosen keys; other parts aren't read."""
        shared_folder(self.spark)
        # Worked out once: the parts are asked for here, and joined with the rows below.
        chosen = chosen.select(*self.key, "run", "part").distinct().checkpoint()
        files = sorted((r["run"], r["part"]) for r in chosen.select("run", "part").distinct().collect())  # at most one a part
        if not files:
            return self.spark.createDataFrame([], self.schema)
        rows = self._rows([f"{self.path}/rows/run={run}/part={part}" for run, part in files])
        return rows.join(chosen, [*self.key, "run", "part"], "left_semi").drop("run", "part").distinct()


def history(spark: SparkSession, path: str) -> Clustered:
    """Account history by (address; ledger, hash)."""
    return Clustered(spark, path, HISTORY, ["address"], ["ledger_index", "hash"])


def holders(spark: SparkSession, path: str) -> Clustered:
    """Holders of issuances as of ledgers, by object id."""
    return Clustered(spark, path, HOLDERS, ["issuance_id", "as_of_ledger"], ["object_id"])


def history_rows(links: DataFrame, transactions: DataFrame) -> DataFrame:
    """What ``history`` keeps of the links and transactions of a batch."""
    return links.select("address", "hash").join(transactions.select("hash", "ledger_index", "tx_type"), "hash")


def account_pages(requests: DataFrame, table: Clustered, coverage: DataFrame, accounts: DataFrame) -> DataFrame:
    """The answers of reports.account_history, from clustered history."""
    asked = reports.history_requests(requests, coverage, accounts)
    after = F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("ledger_index"), F.col("_after").alias("hash")))
    wanted = asked.filter(F.col("status") == "success").select("request_id", "address", after.alias("after"), "forward", F.col("_limit").alias("page"), "_low", "_high")
    found = table.seek(table.chosen(wanted, F.col("_low"), F.col("_high")))
    return reports.history_pages(asked, found)


def holder_pages(requests: DataFrame, table: Clustered) -> DataFrame:
    """The answers of reports.holder_pages, from clustered holders."""
    after = F.when(F.col("marker").isNotNull(), F.struct(F.col("marker").alias("object_id")))
    wanted = requests.select("request_id", "issuance_id", "as_of_ledger", after.alias("after"), F.lit(True).alias("forward"), reports.holder_limit().alias("page"))
    return reports.holder_pages(requests, table.seek(table.chosen(wanted)))
