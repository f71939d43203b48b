"""Exact dedup (native): a persistent digest index, bucketed and sorted by digest.

``text_digest`` is the SHA-256 of the text without its white space. The index
is a bucketed, sorted Parquet table (one row per digest ever kept). New data is
first reduced to one row per digest with map-side combine (a digest shared by a
third of all rows costs one row per task), then anti-joined with the index by
sort-merge (the index side needs neither shuffle nor sort) and appended.

Defined results: null text = empty text; of equal texts the row with most code
points stays, then the smallest doc_id, null ids last; rows that repeat a doc_id
and a text are the same document (all marked kept by ``assign``, one of them
stays in ``drop_copies``); an empty table gives no rows; a text of any
length is one digest; further columns pass through ``drop_copies`` whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revkit.llm.common import WS, materialize, scratch, text_or_empty, with_new


def text_digest(text: Column) -> Column:
    """32-byte SHA-256 of the text without white space (UTF-8)."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", "")
    return F.unhex(F.sha2(squeezed.cast("binary"), 256))


def _rank(chars: Column, doc_id: Column) -> Column:
    """Smallest first: most code points, then smallest id, null ids last."""
    return F.struct((-chars).alias("neg_chars"), doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"))


@dataclass(frozen=True)
class DigestIndex:
    """A digest index table: ``digest`` -> the row that stays and its copies.

    The first batch that brings a digest decides its row; later batches find it
    by the anti-join and add nothing for it.
    """

    spark: SparkSession
    name: str
    buckets: int = 64

    @classmethod
    def open(cls, spark: SparkSession, name: str, location: str, buckets: int = 64) -> DigestIndex:
        """Create the table at ``location``, or attach one that is there."""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_chars BIGINT, keep_id BIGINT, group_size BIGINT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        return cls(spark, name, buckets)

    def location(self) -> str:
        rows = self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Location'").collect()
        return rows[0]["data_type"]

    def read(self) -> DataFrame:
        """The index rows as a plain scan: a join against it shuffles both
        sides, which lets adaptive execution split a hot digest."""
        return self.spark.read.schema(self.spark.table(self.name).schema).parquet(self.location())

    def append_new(self, keyed: DataFrame) -> None:
        """Add the digests of ``keyed`` (digest, chars, doc_id) that the index lacks."""
        groups = keyed.groupBy("digest").agg(F.min(_rank(F.col("chars"), F.col("doc_id"))).alias("best"), F.count("*").alias("group_size"))
        known = self.spark.table(self.name).select("digest")
        fresh = groups.hint("merge").join(known, "digest", "left_anti")
        (
            fresh.select("digest", (-F.col("best.neg_chars")).alias("keep_chars"), F.col("best.doc_id").alias("keep_id"), "group_size")
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .insertInto(self.name)
        )
        self.spark.catalog.refreshTable(self.name)


def keyed_docs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    body = text_or_empty(text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_digest(body).alias("digest"), F.length(body).cast("long").alias("chars"))


def fresh_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    location = scratch(spark, "digests")
    return DigestIndex.open(spark, "digests_" + location.rsplit("-", 1)[-1], location, buckets)


def assign(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Append the new digests of ``docs`` and return per document its digest,
    the id that stays, the copies counted with it, and whether it stays."""
    keyed = materialize(keyed_docs(docs, doc_id, text), "digests")
    index.append_new(keyed)
    found = keyed.join(index.read(), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def drop_copies(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the index kept in this batch, with all
    their columns. The join carries the id and length beside the digest, so the
    rows of a hot digest spread over all tasks."""
    index.append_new(keyed_docs(docs, doc_id, text))
    body = text_or_empty(text)
    rows, n = with_new(docs, digest=text_digest(body), chars=F.length(body).cast("long"), id=F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), no_id=F.col(doc_id).isNull())
    key = [n["digest"], n["chars"], n["id"], n["no_id"]]
    best = index.read().select(
        F.col("digest").alias(key[0]), F.col("keep_chars").alias(key[1]), F.coalesce("keep_id", F.lit(0)).alias(key[2]), F.col("keep_id").isNull().alias(key[3])
    )
    return rows.join(best, key, "left_semi").dropDuplicates(key).select(*docs.columns)
