"""What the operators of this subpackage share: reading tables, byte-exact text
helpers, durable intermediate tables and connected components.

Conventions for every operator here:

* rows with a null ``text`` are kept and treated as stated in the operator;
* an empty table gives an empty result with the same schema;
* repeated rows (same ``doc_id`` and text) are answered row by row;
* columns of the input other than the ones asked for are dropped first, so a
  column of the input never clashes with a column of the result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only in a session on this machine alone (tests) an unset one becomes a
    temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Rows of small columns that make a file of their own.
ROWS_PER_FILE = 200_000


def gathered(df: DataFrame, rows: int | None, python: bool = False) -> DataFrame:
    """df in as many partitions as so many rows of small columns need, if that is less than it has.

    What ends in Python work keeps its tasks and is dealt anew; other frames end in fewer tasks.

    Each file costs a few processes on the way (a local file system sets its mode
    by one), so small tables are better one file than one for every partition.
    """
    parts = None if rows is None else 1 + rows // ROWS_PER_FILE
    if parts is None or parts >= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(parts) if python else df.coalesce(parts)


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; rows: as many it has at most."""
    shared_dir(df.sparkSession)
    return gathered(df, rows).checkpoint(eager=True)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; rows: as many it has at most."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    gathered(df, rows, True).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of a batch between Spark and Python: texts may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_ROWS_KEY, _BYTES_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows and bytes of an Arrow batch, unless they were lowered already.

    The default of 10,000 rows and 64 MB is hundreds of MB for long texts, on both
    sides. Spark reads the setting when a query runs, so it stays lowered.
    """
    if not 0 < int(spark.conf.get(_ROWS_KEY)) <= BATCH_ROWS:
        spark.conf.set(_ROWS_KEY, BATCH_ROWS)
    if not 0 < int(spark.conf.get(_BYTES_KEY).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(_BYTES_KEY, f"{BATCH_BYTES}b")


def trim() -> None:
    """Give freed memory back to the machine: a worker outlives its task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it has
        pass


def released(batches):
    """batches, and a trim at their end."""
    yield from batches
    trim()


def slices(batch, rows: int):
    """A record batch in parts of at most that many rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def let(value: Column, body) -> Column:
    """Bind value once inside an expression, so a lambda doesn't repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs of characters that aren't white space; null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and every other character as it is."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, small))


#: Parts of the labels that a label's label is looked up for, so that a giant component is no hot key.
SALTS = 16


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Smallest reachable node of every node in edges(a, b), as (node, comp); rows: as many edges at most.

    Each round a node takes the least of its label, its label's label and those
    of its neighbours, and offers the last to the node that its label names: whole
    trees are hooked, not only nodes (FastSV). A chain of n nodes takes about log2 n
    rounds in any order of its ids. Labels only fall, so the loop ends, and it ends
    only when no label moved. Every round is cut by a reliable checkpoint. Hot nodes
    only meet partial min aggregates; labels that many nodes share are looked up
    once, and only if they aren't final, in salted parts.
    """
    nodes = None if rows is None else 2 * rows
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = durable(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(), nodes)
    label = durable(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("comp")), nodes)
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    while True:
        named = label.select("comp").distinct()
        jump = named.join(label.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp").where("up <> comp")
        jump = jump.select("comp", "up", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        far = label.select("node", "comp", salt).join(jump, ["comp", "salt"], "left").select("node", "comp", F.coalesce("up", "comp").alias("far"))
        near = both.join(far.select(F.col("node").alias("y"), "far"), "y").groupBy(F.col("x").alias("node")).agg(F.min("far").alias("near"))
        offer = lambda node, comp: F.struct(node.alias("node"), comp.alias("comp"))
        offers = F.array(offer(F.col("node"), F.least("far", "near")), offer(F.col("comp"), F.col("near")))
        new = far.join(near, "node").select(F.explode(offers).alias("o")).groupBy("o.node").agg(F.min("o.comp").alias("comp"))
        new = durable(new.join(label.select("node", F.col("comp").alias("old")), "node"), nodes)
        moved = not new.where("comp <> old").isEmpty()
        label = new.select("node", "comp")
        if not moved:
            return label
