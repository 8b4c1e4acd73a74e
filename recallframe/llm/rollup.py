"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums, so they are kept up
by signed differences: an insert adds a document's counts, a delete takes them
away, a revised count does both. A batch of changes is summed per group, written
to a folder of its own, and committed by creating a mark under its id, which only
one writer can; a batch that is delivered again finds the mark and changes
nothing. Totals are the sum of the committed batches. Compaction folds the
batches of one listing into a new base without changing a total; their marks
then move aside, so listings hold what isn't folded only, and their rows go with
the next compaction, when no reader of the old base is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallframe.session import publish, published

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def inserted(counts: DataFrame) -> DataFrame:
    """Signed changes that add rows of (source, lang, tokenizer, n_tokens, n_chars). Null counts are 0."""
    sums = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in SUMS[1:]]
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), *sums)


def deleted(counts: DataFrame) -> DataFrame:
    return inserted(counts).select(*KEYS, *[(-F.col(c)).alias(c) for c in SUMS])


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that put ``new`` counts in the place of ``old``, whatever groups the two belong to."""
    return deleted(old).unionByName(inserted(new))


class Rollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._path("/".join([self.folder, *parts]))

    def _names(self, part: str) -> list[str]:
        if not self._fs.exists(self._at(part)):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(part)))

    def _mark(self, text: str, *parts: str) -> bool:
        """Creates a small file with its content; False if it is there already."""
        return publish(self.spark, "/".join([self.folder, *parts]), text)

    def _marked(self, *parts: str) -> str:
        return published(self.spark, "/".join([self.folder, *parts]))

    def committed(self, batch_id: str) -> bool:
        """Whether a batch is committed; looks at its marks, not at a listing. A mark only ever moves from ``open`` to ``folded``."""
        return self._fs.exists(self._at("open", batch_id)) or self._fs.exists(self._at("folded", batch_id))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds the signed ``changes``; False, and no change, if the id is committed already.

        Of two writers of one id the one that creates the mark wins, and the
        other's rows go. A run that broke off left no mark, and the next try writes anew.
        """
        if not batch_id or "/" in batch_id or batch_id.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self.committed(batch_id):
            return False
        name = uuid.uuid4().hex
        sums = changes.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        sums.select(*KEYS, *SUMS).write.parquet(f"{self.folder}/rows/{name}")
        if not self._mark(name, "open", batch_id):
            self._fs.delete(self._at("rows", name), True)
            return False
        if self._fs.exists(self._at("folded", batch_id)):
            # the first writer's batch was folded meanwhile: its mark moved away and made room for this one, which counts for nothing
            self._fs.delete(self._at("open", batch_id), False)
            self._fs.delete(self._at("rows", name), True)
            return False
        return True

    def _base(self) -> tuple[int, str | None, dict[str, str]]:
        """Number of the newest base (0: none), its folder in ``rows``, and the batches (id to folder) that it was the first to hold."""
        bases = self._names("bases")
        if not bases:
            return 0, None, {}
        name, *folded = self._marked("bases", bases[-1]).split("\n")
        return int(bases[-1]), name, dict(x.rsplit("\t", 1) for x in folded)

    def _parts(self) -> tuple[int, list[str], dict[str, str]]:
        """Number of the newest base, the folders that add up to the totals, and the batches (id to folder) among these."""
        # the listing comes first: a batch that is folded meanwhile is then in both, and counts with the base
        listed = self._names("open")
        number, base, folded = self._base()
        batches = {}
        for i in listed:
            if i in folded or self._fs.exists(self._at("folded", i)):
                continue
            batches[i] = self._marked("open", i)
        return number, [base] * bool(base) + list(batches.values()), batches

    def _sum(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/rows/{n}" for n in names])
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where(" or ".join(f"{c} <> 0" for c in SUMS))

    def totals(self) -> DataFrame:
        """The totals of every group that is not empty."""
        return self._sum(self._parts()[1])

    def compact(self) -> bool:
        """Folds the committed batches of one listing into a new base; False if another compaction came first.

        The base counts once its mark is created, last of all. Batches that are
        committed meanwhile aren't in the listing and stay open.
        """
        # the marks of the base before move first, so that a base only names batches of its own
        _, _, folded = self._base()
        for i in folded:
            if self._fs.exists(self._at("open", i)):
                self._fs.mkdirs(self._at("folded"))
                self._fs.rename(self._at("open", i), self._at("folded", i))
        number, names, batches = self._parts()
        name = uuid.uuid4().hex
        self._sum(names).select(*KEYS, *SUMS).coalesce(1).write.parquet(f"{self.folder}/rows/{name}")
        lines = [name, *[f"{i}\t{n}" for i, n in sorted(batches.items())]]
        if not self._mark("\n".join(lines), "bases", f"{number + 1:08d}"):
            self._fs.delete(self._at("rows", name), True)
            return False
        # what the base before was the first to hold is in the new one, and so is the base before itself, but for readers that have just found it
        for old in folded.values():
            self._fs.delete(self._at("rows", old), True)
        if number > 1 and (two_before := self._marked("bases", f"{number - 1:08d}").split("\n")[0]):
            self._fs.delete(self._at("rows", two_before), True)
        return True
