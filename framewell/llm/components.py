"""Connected components of a link table, as joins that converge in a few rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm.shared import stash


def connected(links: DataFrame) -> DataFrame:
    """``(doc_id, label)`` for every id in ``links`` (a, b): the smallest id it can reach. Links, ids and labels stay distributed.

    Each round a node takes the least label among its neighbours' and its own, and then its label's label, so a path of
    length n takes about log n rounds. Messages to a node are combined before they are shuffled, so hubs do no harm.
    """
    edges = links.select("a", "b").filter("a <> b")
    both = stash(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stash(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        sent = both.join(labels.withColumnRenamed("doc_id", "a"), "a").groupBy(F.col("b").alias("doc_id")).agg(F.min("label").alias("sent"))
        near = labels.join(sent, "doc_id").select("doc_id", F.col("label").alias("old"), F.least("label", "sent").alias("label"))
        jump = labels.select(F.col("doc_id").alias("label"), F.col("label").alias("next"))
        new = stash(near.join(jump, "label", "left").select("doc_id", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        changed = not new.filter("label <> old").isEmpty()
        labels = new.select("doc_id", "label")
        if not changed:
            return labels
