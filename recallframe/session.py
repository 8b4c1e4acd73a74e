"""Session helpers shared by every operator."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folder of the innermost ``scratch`` block, if there is one.
_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, local mode) a temporary folder of
    this machine is made and set as the checkpoint folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file with all of its content at once; False, and no change, if a file is there already.

    The content is written under another name, which no listing of the file's folder
    shows, and then named: by a hard link on local disks, elsewhere by a rename that
    doesn't overwrite. Of two writers one wins, and a run that breaks off at any
    point leaves the whole file or none.
    """
    context = spark.sparkContext
    hadoop, java = context._jvm.org.apache.hadoop.fs, context._jvm.java
    goal = hadoop.Path(path)
    store = goal.getFileSystem(context._jsc.hadoopConfiguration())
    draft = hadoop.Path(f"{goal.getParent()}.drafts/{uuid.uuid4().hex}")
    store.mkdirs(goal.getParent())
    out = store.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if store.getUri().getScheme() == "file":
            java.nio.file.Files.createLink(java.io.File(goal.toUri().getPath()).toPath(), java.io.File(draft.toUri().getPath()).toPath())
        else:
            keep = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
            keep[0] = getattr(hadoop, "Options$Rename").NONE
            hadoop.FileContext.getFileContext(store.getUri(), context._jsc.hadoopConfiguration()).rename(draft, goal, keep)
        return True
    except Py4JJavaError:
        if store.exists(goal):
            return False
        raise
    finally:
        store.delete(draft, False)


def published(spark: SparkSession, path: str) -> str:
    """The content of a file that ``publish`` made."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    file = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(file.readAllBytes()).decode()
    finally:
        file.close()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``cut`` and ``stored`` write within this block goes when the block ends.

    A frame that is read later must be written within the block, to a place of
    its own or by ``stored(keep=True)``.
    """
    context, home = spark.sparkContext, shared_dir(spark)
    folder = f"{home}/scratch-{uuid.uuid4().hex}"
    before = context.getCheckpointDir()  # shared_dir has set one
    context.setCheckpointDir(folder)
    _scratch.append(folder)
    try:
        yield
    finally:
        _scratch.pop()
        context.setCheckpointDir(before)
        delete(spark, folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, keep: bool = False, codec: str | None = None) -> DataFrame:
    """``df`` written as a compressed table in the shared folder and read again; for wider rows than ``cut``.

    With ``keep`` it outlives the innermost ``scratch`` block. ``codec`` is Parquet's, the session's by default.
    """
    spark = df.sparkSession
    folders = [shared_dir(spark), *_scratch]
    path = f"{folders[-2 if keep and _scratch else -1]}/stored-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that are broadcast at most.
FEW = 1 << 20


def few(keys: DataFrame) -> DataFrame:
    """``keys``, a stored table of numbers, with a broadcast hint if its counted rows are ``FEW`` at most."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add (its own win)."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])
