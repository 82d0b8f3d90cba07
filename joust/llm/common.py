"""Shared pieces of the training-data operators: table access, cut points, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of an edge list in one file of a cut.
ROWS_A_FILE = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Unset, it is a temporary one in local mode and an error
    on a cluster, whose machines share none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="joust-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut for narrow, small rows: a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Paths of the tables stored since each open scratch() began, the innermost last.
_open: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Lineage cut for wide or many rows: a Parquet table in the shared folder (columnar and compressed). It stays
    until the folder is cleaned, unless it was stored inside a scratch()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._stored_at = path
    return got


class scratch:
    """Tables that are stored inside this block go at its end, but for those that kept() was called with: only they
    may be read afterwards."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> scratch:
        _open.append([])
        return self

    def kept(self, df: DataFrame) -> DataFrame:
        _open[-1].remove(df._stored_at)
        if len(_open) > 1:
            _open[-2].append(df._stored_at)
        return df

    def __exit__(self, *_) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in _open.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


#: Rows of narrow keys that are broadcast (8 to 32 bytes each); beyond, both sides of a join are shuffled.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A stored frame of narrow rows, with the hint to broadcast it if it is counted to be small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that an operator adds for itself: none is one of df's, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def few(batches, rows: int = 256):
    """The same record batches in pieces, so that a task has few texts in Python at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 200) -> DataFrame:
    """Connected components of an undirected edge list as (node, comp), comp being the smallest node.

    Alternating large-star and small-star rounds; every round is two shuffles of the edge list and a cut, no
    edge reaches the driver, and a hub's neighbours are rows of a sort, never a collected list. Self-loops and
    null ends are ignored; an empty edge list gives an empty result. Rounds needed grow with the square of the
    logarithm of the nodes at most; an edge list that is not done after most_rounds is an error, never a result.
    """
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    least = F.least("u", F.min("v").over(Window.partitionBy("u")))
    seen = None
    for round_ in range(most_rounds + 1):
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state["n"] == 0 or seen == (state["n"], state["x"]):
            break
        if round_ == most_rounds:
            raise RuntimeError("components are not done")
        seen = (state["n"], state["x"])
        # large star: what is above u hangs on the least of u and its neighbours, and so does u itself
        both = e.withColumn("end", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))).select("end.*")
        large = both.withColumn("m", least).select(F.when(F.col("v") > F.col("u"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: of those below u, all hang on the least
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u"))).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        # as few files as the rows need: each file of a checkpoint costs its executor a process
        e = cut(small.distinct().coalesce(1 + state["n"] // ROWS_A_FILE))
    out = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return out.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
