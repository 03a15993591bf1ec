"""Reading tables, stored intermediate tables and small column helpers shared by the operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words, as a Java character class.
SPACES = r"\x20\x09-\x0D"


#: Bytes of rows that a task function gets at once, about, unless the session says otherwise.
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_own_folder: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    A local session without that setting (a test) gets a temporary folder of
    its own; on a cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="wardlight-llm-"))
    return _own_folder[0]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame, written once to the shared folder and read back.

    This cuts the lineage and survives lost executors; columns that a later
    step does not need are not read again.
    """
    spark = frame.sparkSession
    folder = new_folder(spark, label)
    frame.write.option("compression", "zstd").parquet(folder)
    # Spark deletes the shuffle files of finished steps once the driver's collector finds
    # them unreachable; without a request that can be long after the disks are full.
    spark._jvm.System.gc()
    return spark.read.schema(frame.schema).parquet(folder)


def released(*frames: DataFrame) -> None:
    """Deletes the files of stored frames that nothing will read again."""
    for frame in frames:
        spark = frame.sparkSession
        for folder in {file.rpartition("/")[0] for file in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is never inlined."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents that no model learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def text_blocks(texts: list[str], most_chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most_chars` characters together; a longer text stands alone."""
    start = total = 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > most_chars:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def trimmed(task: Callable) -> Callable:
    """A task function that gives the memory it has freed back to the system at its end.

    Spark keeps its Python workers; what their C library holds on to would stand beside
    the executor's heap in all later steps.
    """

    def run(batches):
        yield from task(batches)
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def mapped(rows: DataFrame, task: Callable, schema) -> DataFrame:
    """The rows through a task function over batches of bounded size.

    By rows alone a batch of texts may be large, and the executor holds it beside its heap, several
    times over, as the Python worker does.
    """
    spark = rows.sparkSession
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return rows.mapInArrow(trimmed(task), schema)


def hashed(frame: DataFrame) -> DataFrame:
    """The smaller side of a join, with a row per key: Spark hashes it by task and sorts neither side."""
    return frame.hint("shuffle_hash")


def in_several(keys: DataFrame) -> DataFrame:
    """(doc_id, keys): of the rows (doc_id, key), the keys of more than one row, by document.

    Counting combines map-side, and the join back may be split by Spark where one key
    is frequent. The keys are stored in between, so that the shuffles of counting are
    gone before those of the join come.
    """
    shared = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-keys")
    return keys.join(hashed(shared), "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows (group, ...), stored, with their `place` in their group by the order and the group's size `n`.

    The order begins with the group. Places come from a range partitioning and from counts of
    rows by partition, so no group is sorted by one task.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(
        dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")),
        "placed",
    )
    # A row for each part of each group: as many as parts and groups together.
    parts = dealt.groupBy("group", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first_at"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "group",
        "part",
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first_at")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("group")).alias("n"),
    )
    return dealt.join(parts, ["group", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def told_apart(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows (doc_id, text, ...) with a number `name` that follows the ids and differs from text to text.

    It is the id itself as long as no id occurs twice, which a count of the ids shows. Else it is
    the place of (id, text) among the distinct ones, null texts counting as empty, and the
    second frame has the ids (name, doc_id) of the numbers. Rows without an id have no number.
    """
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("rows"))
    if ids.where("rows > 1").isEmpty():
        return docs.withColumn(name, F.col("doc_id")), None
    digest = F.sha2(F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")), 256)
    keyed = docs.withColumn("__text_digest", digest)
    pairs = keyed.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "__text_digest").agg(F.lit(0).alias("group"))
    order = [F.col("group"), F.col("doc_id"), F.col("__text_digest")]
    places = stored(
        placed(pairs, order).select(
            F.col("doc_id").alias("__id"), F.col("__text_digest").alias("__digest"), F.col("place").alias(name)
        ),
        "text-numbers",
    )
    same = (keyed["doc_id"] == F.col("__id")) & (F.col("__text_digest") == F.col("__digest"))
    numbered = stored(keyed.join(places, same, "left").drop("__text_digest", "__id", "__digest"), "numbered-texts")
    return numbered, places.select(name, F.col("__id").alias("doc_id"))


def by_text(docs: DataFrame, operate) -> DataFrame:
    """What `operate` finds of rows (doc_id, text), a row per row, if it needs ids that differ from text to text."""
    rows, ids = told_apart(docs.select("doc_id", F.col("text").cast("string").alias("text")), "__number")
    found = operate(rows.select(F.col("__number").alias("doc_id"), "text"))
    if ids is None:
        return found
    own = ids.withColumnRenamed("doc_id", "__id")
    return found.join(own, found["doc_id"] == own["__number"], "left").select(
        F.col("__id").alias("doc_id"), *[found[name] for name in found.columns if name != "doc_id"]
    )
