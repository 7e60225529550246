"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased; it is stored as two 64-bit hashes. `LineRuns` is the index: tables of
(key hashes, number of documents that have the key), all bucketed by the hashes into the same number of buckets and sorted by them within a bucket. Each new batch
of documents is merge-anti-joined with the keys that a run has settled (those of `limit` documents or more, which need no more counting) and adds its own
run at level 0; `fanout` runs of a level are compacted by merging into one run of the next, so a key is rewritten once a level. As buckets and their
order are the same in all runs, merges and anti-joins of runs neither shuffle nor sort them.

Two uses:
- `line_dedup`: ingest every batch, then lose the lines whose key `min_docs` documents or more have, in every document.
- `admit`: for a growing corpus, keep the lines of a batch that no earlier batch had, then add the batch.

Only the places of lost lines are gathered by document and joined with it.

Defined cases: null or empty text is one empty line; keys shorter than `min_chars` code points are never lost; rows with equal doc_id are one document, and so
are all rows without one; rows with equal doc_id and text have equal results; other columns pass through untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_WS, folder, materialise, no_shuffle_left, remove

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
FANOUT = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["_h1", "_h2"]


def line_key(line: Column) -> Column:
    """The line as it is compared. lower() is right and fast for ASCII; other lines fold A-Z alone."""
    bare = F.btrim(line, F.lit(ASCII_WS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(1), key).alias("_h2")]


def _lines(docs: DataFrame) -> DataFrame:
    """The lines of documents as an array."""
    return docs.withColumn("_lines", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"))


@contextmanager
def _in_order(spark: SparkSession) -> Iterator[None]:
    """Let the planner count on the order in which buckets of one file are sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class LineRuns:
    """Levelled sorted runs of line hashes in the shared folder: a table (key, _n) each. `limit`: from how many documents on a key is settled."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, min_chars: int = MIN_CHARS, limit: int = MIN_DOCS):
        self.spark, self.fanout, self.min_chars, self.limit = spark, max(2, fanout), min_chars, limit
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, counts: DataFrame, level: int) -> str:
        """A run of counts that are dealt like the buckets, so that a bucket is one file."""
        name = f"claimspan_lines{level}_{uuid.uuid4().hex}"
        with no_shuffle_left(self.spark):
            counts.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{folder(self.spark)}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, f"{folder(self.spark)}/{name}")

    def _keys(self, docs: DataFrame) -> DataFrame:
        keys = F.filter(F.array_distinct(F.transform("_lines", line_key)), lambda k: F.char_length(k) >= self.min_chars)
        return _lines(docs.select("doc_id", "text")).select("doc_id", F.explode(keys).alias("_k")).select("doc_id", *_hashes(F.col("_k")))

    def _counts(self, batch: DataFrame) -> DataFrame:
        """In how many documents of the batch each key is: its rows, less those that an id with several rows has too many."""
        each = self._keys(batch).select(*_KEY, F.lit(1).alias("_n"))
        several = materialise(batch.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select(F.col("doc_id").alias("_id")), "lines-ids")
        if several.limit(1).count():
            again = self._keys(batch.join(several, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"))
            each = each.union(again.groupBy("doc_id", *_KEY).agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select(*_KEY, (1 - F.col("_m")).cast("int")))
        return each.groupBy(*_KEY).agg(F.sum("_n").alias("_n")).repartition(self.buckets, *_KEY)

    def add(self, batch: DataFrame) -> None:
        """Add a batch of documents (doc_id, text): what no run has settled of its keys is a sorted run; then the compactions that fall due."""
        with _in_order(self.spark):
            run, level = self._counts(batch), 0
            for known in self.runs():
                run = run.join(known.where(F.col("_n") >= self.limit).hint("merge"), _KEY, "left_anti")
            name = self._write(run, 0)
            while True:
                if level == len(self.levels):
                    self.levels.append([])
                self.levels[level].append(name)
                if len(self.levels[level]) < self.fanout:
                    return
                old, self.levels[level] = self.levels[level], []
                name = self._compacted(old, level + 1)
                level += 1

    def _merged(self, a: str, b: str) -> DataFrame:
        """Two runs as one, merged key by key."""
        n = F.coalesce("_n", F.lit(0)) + F.coalesce("_m", F.lit(0))
        return self.spark.table(a).join(self.spark.table(b).withColumnRenamed("_n", "_m").hint("merge"), _KEY, "full_outer").select(*_KEY, n.alias("_n"))

    def _compacted(self, names: list[str], level: int) -> str:
        """One run of several, two at a time: a merge of three would lose the order of the first two."""
        while len(names) > 1:
            a, b, *rest = names
            names = [self._write(self._merged(a, b), level), *rest]
            self._drop(a)
            self._drop(b)
        return names[0]

    def counts(self) -> DataFrame:
        """Documents of each key over all runs, which are two at most then; of a key that a run has settled, `limit` or more."""
        names = [name for level in self.levels for name in level]
        if not names:
            return self.spark.createDataFrame([], "_h1 long, _h2 long, _n long")
        if len(names) > 2:
            with _in_order(self.spark):
                names = [self._compacted(names[:-1], len(self.levels)), names[-1]]
            self.levels = [[] for _ in self.levels] + [names]
        return self._merged(*names) if len(names) > 1 else self.spark.table(names[0])

    def drop(self) -> None:
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = []


def _without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """The columns of docs as _row, then _lines and _lost: the places of the lines whose key is in the table lost; null if there is none."""
    rows = _lines(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.col("text"))).withColumn("_th", F.xxhash64("text"))
    at = rows.select("_id", "_th", F.posexplode(F.transform("_lines", line_key)).alias("_pos", "_k")).select("_id", "_th", "_pos", *_hashes(F.col("_k")))
    found = at.join(lost.select(*_KEY).hint("merge"), _KEY, "left_semi")
    places = found.groupBy("_id", "_th").agg(F.collect_set("_pos").alias("_lost")).withColumnsRenamed({"_id": "_id2", "_th": "_th2"})
    # Equal rows have equal places.
    joined = rows.join(places, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2")), "left")
    return joined.select("_row", "_lines", "_lost")


def _result(rows: DataFrame) -> DataFrame:
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    kept = F.when(F.col("_lost").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    out = rows.select("_row", F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
    return out.withColumn("kept_sha256", F.sha2("kept_text", 256))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """_row (the columns of docs), n_lines, n_dropped, kept_text, kept_sha256: documents without the lines that recur.

    Every document is in exactly one batch, dealt by a hash of its id; all batches together are all documents."""
    runs = LineRuns(docs.sparkSession, fanout, min_chars, min_docs)
    for b in range(batches):
        runs.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
    # Written first, so that both sides of the semi-join are exchanges, whose hot partitions adaptive execution splits.
    with _in_order(docs.sparkSession):
        lost = materialise(runs.counts().where(F.col("_n") >= min_docs).select(*_KEY), "lines-lost")
    runs.drop()
    return _result(_without(docs, lost))


def admit(batch: DataFrame, runs: LineRuns) -> DataFrame:
    """The batch without the lines that earlier batches had, as line_dedup returns it; the batch joins the runs after. A runs of limit 1 writes no key twice."""
    keys = [run.select(*_KEY) for run in runs.runs()]
    earlier = reduce(DataFrame.union, keys) if keys else runs.spark.createDataFrame([], "_h1 long, _h2 long")
    out = materialise(_result(_without(batch, earlier)), "admitted")
    runs.add(batch)
    return out
