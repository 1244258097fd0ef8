"""What the corpus operators share: a folder that all machines see, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space and \t \n \v \f \r.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one on a local master where it is unset."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plumeria-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared root, never used before."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read from it.

    The result has no lineage beyond its files, so a lost executor costs only the tasks that it ran.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """The intermediate tables of one run of an operator, in a folder of their own that ``drop`` removes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, shared_folder(spark, name), 0

    def store(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` as Parquet and return the table read from it."""
        self.count += 1
        path = f"{self.path}/{self.count}-{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the folder; only for a time when no table of it will be read again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes for ``df`` not to have it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str = "text") -> Column:
    """The text, a null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def without_white_space(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``."""
    for character in WHITE_SPACE:
        text = F.replace(text, F.lit(character))
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
