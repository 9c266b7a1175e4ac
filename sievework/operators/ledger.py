"""Calls of outside services, each batch once: what was asked and answered is kept in numbered versions.

Items are cut into numbered batches that never change. A run takes batches without an answer, some at a time, and
commits their answers before it goes on; a batch whose call fails is noted and asked again later, the others of its
round stand. So a run that stops anywhere, by a failure, a limit or a wish, goes on where it was.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions

ANSWERS = "batch long, answer string, error string, tries int"


class Ledger:
    """``call`` takes a batch's texts and gives an answer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    def claim(self, items: DataFrame, n: int = 20) -> int:
        """Adds items (id, text) that aren't in the ledger, in batches of ``n`` in the order of their ids; how many batches there are."""
        now = self.versions.current()
        known = self.versions.read(now, "batches")
        fresh = items.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["id"])
        if known is not None:
            fresh = fresh.join(known.select(F.explode("ids").alias("id")), "id", "left_anti")
        fresh = self.spark.read.parquet(f"{self.versions.root}/{self.versions.write('drafts', fresh.where('id is not null').repartitionByRange('id').sortWithinPartitions('id').select('*', F.spark_partition_id().alias('part'), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias('turn')))}")
        first, starts = now.facts.get("batches", 0), []
        for r in fresh.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each task; batches don't cross tasks
            starts.append((r["part"], first))
            first += -(-r["n"] // n)
        if not starts:
            return first
        begun = F.broadcast(self.spark.createDataFrame(starts, "part int, first long"))
        each = fresh.join(begun, "part").withColumn("batch", F.col("first") + F.floor(F.col("turn") / n))
        made = each.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("r")).select("batch", F.col("r.id").alias("ids"), F.col("r.text").alias("texts"))
        self.versions.commit(now, {"batches": [*now.tables.get("batches", []), self.versions.write("batches", made)]}, {"batches": first})
        return first

    def answers(self) -> DataFrame | None:
        """batch, answer, error, tries: the last word on each batch that was asked."""
        rows = self.versions.read(self.versions.current(), "answers")
        return None if rows is None else rows.groupBy("batch").agg(F.max_by(F.struct("answer", "error", "tries"), "tries").alias("a")).select("batch", "a.*")

    def open_batches(self, tries: int) -> DataFrame:
        """Batches without an answer that were asked fewer than ``tries`` times."""
        rows, said = self.versions.read(self.versions.current(), "batches"), self.answers()
        if said is None:
            return rows.withColumn("tried", F.lit(0))
        out = rows.join(said.select("batch", "error", F.col("tries").alias("tried")), "batch", "left")
        return out.where(F.col("tried").isNull() | (F.col("error").isNotNull() & (F.col("tried") < tries))).withColumn("tried", F.coalesce("tried", F.lit(0))).drop("error")

    def run(self, call: Callable[[list[str]], str], at_once: int = 64, tries: int = 3, rate: float = 0, stop: Callable[[], bool] = lambda: False) -> dict[str, int]:
        """Asks open batches, ``at_once`` a round, until none is left or ``stop``; ``rate``: calls a second over all tasks, 0 for any.

        An executor that is lost in a round has its own calls of that round made again.
        """
        if not self.versions.current().tables.get("batches"):
            return self.state()
        while not stop():
            todo = self.open_batches(tries).orderBy("tried", "batch").limit(at_once)
            number = self.versions.current().facts.get("round", 0) + 1
            folder = self.versions.write("round", todo)
            taken = self.spark.read.parquet(f"{self.versions.root}/{folder}")
            if taken.isEmpty():
                break
            tasks = max(1, min(at_once, self.spark.sparkContext.defaultParallelism))
            pause = tasks / rate if rate else 0.0

            def ask(pdfs):
                for pdf in pdfs:
                    rows = []
                    for batch, texts, tried in zip(pdf["batch"], pdf["texts"], pdf["tried"]):
                        began = time.monotonic()
                        try:
                            rows.append((batch, str(call(list(texts))), None, int(tried) + 1))
                        except Exception as e:  # noqa: BLE001  the service is foreign code; its failure is an entry of the ledger
                            rows.append((batch, None, f"{type(e).__name__}: {e}"[:500], int(tried) + 1))
                        time.sleep(max(0.0, pause - (time.monotonic() - began)))
                    yield pd.DataFrame(rows, columns=["batch", "answer", "error", "tries"])

            said = self.versions.write("answers", taken.repartition(tasks, "batch").mapInPandas(ask, ANSWERS))
            now = self.versions.current()
            self.versions.commit(now, {"answers": [*now.tables.get("answers", []), said]}, {"round": number})
        return self.state()

    def state(self) -> dict[str, int]:
        """batches, answered, failed (asked in vain so far), open."""
        now, said = self.versions.current(), self.answers()
        total = now.facts.get("batches", 0)
        good, bad = said.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())).first() if said is not None else (0, 0)
        return {"batches": total, "answered": good, "failed": bad, "open": total - good}

    def clear(self) -> None:
        """Forgets all batches and answers."""
        now = self.versions.current()
        self.versions.commit(now, dict.fromkeys(now.tables, []), {"batches": 0, "round": 0})
