"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revkit.llm.common import materialize


def connected(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in ``links`` (a, b): comp is the smallest id reachable.

    Each round takes the least label among an id and its neighbours, then the
    label of that label, so labels travel exponentially fast; rounds are
    written to the shared folder. Labels are combined before each shuffle, and
    a hub's links are on the side that adaptive execution can split.
    """
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        least = labels.join(near, "id").select("id", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("above"))
        labels = materialize(least.join(up, "comp").select("id", F.least("comp", "above").alias("comp"), "old"), "labels")
        if labels.where("comp <> old").isEmpty():
            return labels.select("id", "comp")
        labels = labels.select("id", "comp")


def merge_labels(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` (id, comp) after linking by ``more`` (a, b) as well."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp"))
    lifted = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
    lifted = lifted.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"), F.col("a").alias("x"), F.col("b").alias("y"))
    lifted = materialize(lifted, "lifted")
    roots = connected(lifted)
    ids = lifted.select(F.col("x").alias("id")).unionByName(lifted.select(F.col("y").alias("id")))
    known = labels.unionByName(ids.distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("comp")))
    return known.join(roots.select(F.col("id").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
