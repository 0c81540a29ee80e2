"""Token counts kept by signed deltas.

A change row says what happened to one document: ``insert`` brings its new counts, ``delete`` takes its old ones away,
``revise`` does both (another tokenizer version, another text). Changes of a batch are summed by source, language and
tokenizer version before they are shuffled, so that a source with a third of all rows is as cheap as any other, and the
sums are appended as one batch. Totals are the sum of all batches: sums of signed integers don't depend on order.

A batch is committed by one atomic rename to a name made from its id; a batch id that is there already is not
committed again, so that a repeated delivery, a retried job or a rival writer changes nothing. Compaction folds batches
into a base that names them; it is committed by a rename too.

Defined cases: null source, language or version are groups of their own; null counts are 0; repeated rows count each;
unknown kinds of change fail the batch; groups whose sums are all 0 aren't returned; an empty batch commits and
changes nothing; other columns of a change aren't read; texts never come here, only their counts, so that long ones cost
no more; sums don't depend on order, so there are no ties.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstore.llm.runtime import exists, hadoop_path

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "chars"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"


def signed(changes: DataFrame) -> DataFrame:
    """One row for each side of each change, with its sign.

    changes: kind, then old and new structs of (source, lang, tokenizer, tokens, chars); the side that a kind lacks is
    not looked at.
    """
    kinds = F.array(F.lit("insert"), F.lit("delete"), F.lit("revise"))
    kind = F.when(F.array_contains(kinds, F.col("kind")), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(F.col("kind"), F.lit("null")))))

    def side(name: str, sign: int) -> Column:
        c = F.col(name)
        count = lambda f: (F.coalesce(c[f], F.lit(0)) * sign).cast("long").alias(f)
        return F.struct(*[c[k].cast("string").alias(k) for k in KEYS], F.lit(sign).cast("long").alias("docs"), count("tokens"), count("chars"))

    sides = F.when(kind == "insert", F.array(side("new", 1))).when(kind == "delete", F.array(side("old", -1))).otherwise(F.array(side("old", -1), side("new", 1)))
    return changes.select(F.inline(sides))


class DeltaRollup:
    """Totals under one folder: batches/<id>, base/<number> and staging."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _batch_path(self, batch_id: str) -> str:
        return f"{self.root}/batches/b{hashlib.sha256(batch_id.encode()).hexdigest()[:40]}"

    def _publish(self, staged: str, to: str) -> bool:
        """Rename that fails if the target is there; the loser's files are cleared."""
        fs, src = hadoop_path(self.spark, staged)
        _, dst = hadoop_path(self.spark, to)
        fs.mkdirs(dst.getParent())
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(src), fs.makeQualified(dst), none)
            return True
        except Exception:
            if not fs.exists(dst):
                raise
            fs.delete(src, True)
            return False

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Append the batch; False if it is there already."""
        to = self._batch_path(batch_id)
        if exists(self.spark, to) or self._folded([to.rpartition("/")[2]]):
            return False
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        sums = signed(changes).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        sums.write.parquet(staged)
        return self._publish(staged, to)

    def _names(self, folder: str) -> list[str]:
        fs, p = hadoop_path(self.spark, f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _base(self) -> str | None:
        names = self._names("base")
        return f"{self.root}/base/{names[-1]}" if names else None

    def _folded(self, names: list[str]) -> set[str]:
        """Those of some batches that the base has; its list of all that it ever folded stays where it lies."""
        base = self._base()
        return {r[0] for r in self.spark.read.parquet(f"{base}/folded").where(F.col("name").isin(names)).collect()} if base and names else set()

    def _deltas(self, names: list[str], base: str | None) -> DataFrame:
        paths = [f"{self.root}/batches/{n}" for n in names] + ([f"{base}/totals"] if base else [])
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def totals(self) -> DataFrame:
        base, names = self._base(), self._names("batches")
        folded = self._folded(names)
        sums = self._deltas([n for n in names if n not in folded], base).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where(" or ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> None:
        """Fold all batches into a new base. A batch's folder goes only after a base that names it is there."""
        base, names = self._base(), self._names("batches")
        folded = self._folded(names)
        fresh = [n for n in names if n not in folded]
        number = int(base.rpartition("/")[2]) + 1 if base else 0
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        self._deltas(fresh, base).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).write.parquet(f"{staged}/totals")
        new = self.spark.createDataFrame([(n,) for n in fresh], "name string")
        (new.union(self.spark.read.parquet(f"{base}/folded")) if base else new).coalesce(1).write.parquet(f"{staged}/folded")
        if self._publish(staged, f"{self.root}/base/{number:012d}"):
            for n in names:
                fs, p = hadoop_path(self.spark, f"{self.root}/batches/{n}")
                fs.delete(p, True)
