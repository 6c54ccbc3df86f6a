"""What the operators of this subpackage share: the shared folder, written tables, table access."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGE = Path(__file__).resolve().parents[1]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one made here where it is unset on a single machine."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_listingops_dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = sc._listingops_dir = "file://" + tempfile.mkdtemp(prefix="listingops-")
    return conf.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that tasks can import it from anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_listingops_shipped", False):
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    path = Path(tempfile.mkdtemp(prefix="listingops-"), "listingops_tasks.zip")
    path.write_bytes(held.getvalue())
    sc.addPyFile(str(path))
    sc._listingops_shipped = True


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    if partitions:
        df = df.coalesce(partitions)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table of written(), once every table made from it is written."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salts(rows: int, per_salt: int = 50_000) -> int:
    """How many salts deal rows of one key so that each holds per_salt rows on average, 32 at least."""
    return max(32, -(-rows // per_salt))


def bytes_of(df: DataFrame) -> int:
    """About how many bytes the rows of df take in memory. df is read once."""

    def width(kind: T.DataType) -> int:
        return sum(width(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else 8

    size = F.lit(16 + 8 * len(df.columns))
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType):
            size = size + F.coalesce(F.size(f.name), F.lit(0)) * width(f.dataType.elementType)
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        else:
            size = size + width(f.dataType)
    return df.agg(F.sum(size)).first()[0] or 0


def if_small(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """df, to be broadcast where its rows take limit bytes at most, else joined by a shuffle. df is read once more."""
    return F.broadcast(df) if bytes_of(df) <= limit else df


def ranked_in(df: DataFrame, key: list[str], order: list[str], n_salts: int, out: str) -> DataFrame:
    """df with out: 0-based rank of each row within key, gapless, in an arbitrary but fixed order.

    A key may hold any share of the rows: rows are dealt to (key, salt) by a hash of the order columns, ranked there,
    and moved by the number of rows in the key's lower salts. No task holds more than one salt of a key.
    """
    from pyspark.sql import Window as W

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(n_salts)).cast("int"))
    sizes = salted.groupBy(*key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)))
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy(*key, "_salt").orderBy(*order)) - 1)
    joined = ranked.join(before.select(*key, "_salt", "_before"), [*key, "_salt"])
    return joined.withColumn(out, F.col("_rank") + F.coalesce(F.col("_before"), F.lit(0))).drop("_salt", "_rank", "_before")
