"""Intermediate tables in the folder that driver and executors share, and narrow jobs over texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are broadcast at most, counted before; a shuffled join serves beyond.
MOST_BROADCAST = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of this machine only where that is unset and no other machine takes part, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables within the shared one."""
    return f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> bool:
    """Deletes all tables of this application. Results of operators read them: write those first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables written by one run of an operator, which results read; ``clear`` deletes them in the end.

    ``keep`` cuts the lineage: a lost executor costs at most the work since the last table.
    ``drop`` deletes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.table_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.table_path)
            path.getFileSystem(conf).delete(path, True)


def sized(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Broadcast if it has at most ``most`` rows, else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size_col: str, most: int = 200_000, heavy: int = 65_536) -> DataFrame:
    """``rows`` left-joined with ``groups``, which has one row for each ``key`` and the number of rows of that key.

    Few groups are broadcast. Of more, those of over ``heavy`` rows, or over the share of rows that leaves at most
    ``most`` of them, are broadcast, and the others' rows are shuffled: no key brings one task more than that.
    """
    if groups.count() <= most:
        return rows.join(F.broadcast(groups), key, "left").drop(size_col)
    bound = max(heavy, rows.count() // most)  # at most rows / bound keys have more rows
    large, small = F.broadcast(groups.where(F.col(size_col) > bound)), groups.where(F.col(size_col) <= bound)
    alone = rows.join(large.select(key), key, "left_anti").join(small, key, "left")
    return rows.join(large, key).drop(size_col).unionByName(alone.drop(size_col))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column is called so, in whatever case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a batch whose texts are in Python at once.
ROWS = 500


def few_at_once(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows; what they held in Arrow is given back in the end, as workers live on."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


Made = Iterator[tuple[list[int] | None, dict]]


def map_texts(rows: DataFrame, run: Callable[[list[str]], Made], fields: str, text_col: str = "text") -> DataFrame:
    """``rows`` without ``text_col``, with the columns ``fields`` that ``run`` makes of the texts. A narrow job.

    ``run`` takes a batch's texts, null ones as empty, and yields positions (none: the texts next in turn, one
    row each) with columns of as many values. The other columns stay in Arrow, so that every id, null ones and
    those beyond 2 ** 53 among them, comes out as it went in.
    """
    rest = [f.name for f in rows.schema if f.name != text_col]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text_col]

    def over(batches):
        for batch in few_at_once(batches):
            turn = 0
            for at, made in run([t or "" for t in batch.column(text_col).to_pylist()]):
                if at is None:
                    at = range(turn, turn + len(next(iter(made.values()))))
                    turn = at.stop
                few = [batch.column(c).take(pa.array(list(at), pa.int64())) for c in rest]
                arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in made.values()]
                yield pa.RecordBatch.from_arrays([*few, *arrays], [*rest, *made])

    return rows.mapInArrow(over, ", ".join([*kinds, fields]))
