"""Connected components of a graph of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.sources.scratch import Scratch

#: Nodes whose labels (two longs each) may be broadcast; more are joined by shuffle.
MAX_BROADCAST_LABELS = 1_000_000


def components(links: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label, so that labels travel twice as far with every round. Only nodes with links take part,
    and minima are combined before the shuffle. The labels that a round looks up (those of the
    neighbours, and those of labels that are not yet their own) are broadcast up to a counted
    bound, so that no task gathers the neighbours of a hub or the members of a component; beyond
    it they are joined by shuffle, where adaptive execution splits the hot keys of the side with
    many rows. Rounds are written tables; the driver sees single numbers.
    """
    both = scratch.keep(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("node", "other"))
    labels = scratch.keep(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")))
    few = labels.limit(MAX_BROADCAST_LABELS + 1).count() <= MAX_BROADCAST_LABELS  # as many in every round
    look_up = F.broadcast if few else (lambda df: df)
    for _ in range(max_rounds):
        nearby = both.join(look_up(labels.toDF("other", "near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        stepped = scratch.keep(labels.join(nearby, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        moving = stepped.select("label").distinct().join(labels.where("label < node").toDF("label", "beyond"), "label")
        jumped = scratch.keep(stepped.join(look_up(moving), "label", "left").select("node", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")))
        changed = jumped.where("label <> was").limit(1).count()
        scratch.drop(labels)
        scratch.drop(stepped)
        labels = scratch.view(jumped, "node", "label")
        if not changed:
            scratch.drop(both)
            return labels
    raise RuntimeError("components did not settle")


def extended(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` of ``components`` after more ``links`` (a, b): the components of what these join.

    Only the labels that the new links touch go through the rounds.
    """
    of = [labels.toDF(x, f"label_{x}") for x in "ab"]
    joined = links.select("a", "b").join(of[0], "a", "left").join(of[1], "b", "left")
    whole = components(joined.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")), scratch)
    fresh = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return scratch.keep(labels.unionByName(fresh).join(whole.toDF("label", "least"), "label", "left").select("node", F.coalesce("least", "label").alias("label")))
