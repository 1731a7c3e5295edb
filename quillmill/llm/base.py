"""What the training-data operators share: table access, shared storage, joins on hot keys and word rules."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: a word is a longest run of other characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: A key with more rows than this, and than this share of all rows, is dealt to several tasks.
HOT_ROWS, HOT_SHARE = 500, 1e-4

#: Row groups of stored tables: a task holds one in memory while it writes.
ROW_GROUP_BYTES = 32 << 20
#: Rows of a file, where a table's size is known beforehand.
FILE_ROWS = 50_000
#: Rows that Spark sends to a Python worker at a time: texts may be long.
BATCH_ROWS = 1_000

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; queries also send small batches to Python workers from here on (`small_batches`)."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one for a local
    master (driver and executors are one process); on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.gettempdir()}/quillmill-shared"
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Send at most BATCH_ROWS rows at a time to Python workers in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts lineage and survives lost executors. Where `rows`
    bounds its rows, it is written by a task for each FILE_ROWS of them, so that small tables are few files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmill-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df = df if rows is None else df.coalesce(max(8, -(-rows // FILE_ROWS)))
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _made:
        _made.remove(folder)


def folders_of(*tables: DataFrame) -> set[str]:
    """Folders of the tables made by `written` that these read."""
    read = {f.rpartition("/")[0].rpartition("/")[2] for df in tables for f in df.inputFiles()}
    return {x for x in _made if x.rpartition("/")[2] in read}


def dropped(*tables: DataFrame) -> None:
    """Remove the folders of tables made by `written`, once nothing reads them any more."""
    for df in tables:
        for folder in folders_of(df):
            remove(df.sparkSession, folder)


def made_so_far() -> list[str]:
    """Folders that `written` has made and nobody has removed."""
    return list(_made)


def remove_since(spark: SparkSession, before: list[str], *needed: DataFrame) -> None:
    """Remove what `written` made after `before` was taken, but for what tables that are still `needed` read."""
    for folder in set(made_so_far()) - set(before) - folders_of(*needed):
        remove(spark, folder)


def give_back(spark: SparkSession) -> bool:
    """Hands memory that the driver's JVM has freed outside its heap back to the system. Each broadcast and exchange
    has a thread there, and the allocator keeps what threads and the compiler have freed. False where the JVM can't."""
    jvm = spark._jvm
    beans, name = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    given = [(name, "javax.management.ObjectName"), ("systemTrimNativeHeap", "java.lang.String"), (None, "[Ljava.lang.Object;"), (None, "[Ljava.lang.String;")]
    kinds, values = (spark.sparkContext._gateway.new_array(kind, len(given)) for kind in (jvm.java.lang.Class, jvm.java.lang.Object))
    for k, (value, kind) in enumerate(given):
        kinds[k], values[k] = jvm.java.lang.Class.forName(kind), value
    try:  # by the interface's method: the bean server's own class is closed to others
        jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(beans, values)
    except Py4JJavaError:
        return False
    return True


def hot_rows(total: int) -> int:
    return max(HOT_ROWS, int(total * HOT_SHARE))


def parts_of(counted: DataFrame, key: str, n: str, most: int) -> DataFrame:
    """(key, parts) of keys with more than `most` rows; with `most` from `hot_rows` there are at most 1 / HOT_SHARE."""
    return counted.where(F.col(n) > most).select(key, F.ceil(F.col(n) / most).cast("int").alias("parts"))


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """left joined with right (one row a key) on `key`. Rows of `left` with a key of `hot` (key, parts), a table of
    bounded size, are dealt to `parts` tasks by a hash of `by`; right's row is repeated for each of them."""
    hot = F.broadcast(hot.select(key, "parts"))
    dealt = left.join(hot, key, "left").withColumn("part_no", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("parts"))).cast("int")).drop("parts")
    each = right.join(hot, key, "left").withColumn("part_no", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(each, [key, "part_no"], how).drop("part_no")


def words_of(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")
