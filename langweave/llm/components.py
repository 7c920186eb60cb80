"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langweave.scratch import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a``, ``b``); the component is its smallest node.

    Each round a node takes the smallest label among its neighbours, hands it to the node it was labelled by, and
    labels are shortened by one jump; a number of rounds about logarithmic in the longest chain settles every node.
    Every round is a written table, so that both sides of each join are plain exchanges (a hub's rows can be split)
    and a lost executor costs one round's work. Nothing but the count of changed labels comes to the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.filter("a != b").distinct(), "links")
    state = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
            "node", F.least("node", "near").alias("component"), F.lit(True).alias("changed")
        ),
        "components",
    )
    while state.filter("changed").limit(1).count():
        seen = state.select(F.col("node").alias("b"), F.col("component").alias("theirs"))
        near = both.join(seen, "b").groupBy("a").agg(F.min("theirs").alias("near"))
        hooked = state.join(near, F.col("node") == F.col("a")).select(
            "node", "component", F.least("component", "near").alias("next")
        )
        hooked = materialize(hooked, "hooked")
        handed = hooked.groupBy(F.col("component").alias("root")).agg(F.min("next").alias("handed"))
        parents = hooked.join(handed, F.col("node") == F.col("root"), "left").select(
            "node", "component", F.least("next", "handed").alias("parent")
        )
        parents = materialize(parents, "parents")
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grandparent"))
        state = materialize(
            parents.join(above, "parent").select(
                "node",
                F.col("grandparent").alias("component"),
                (F.col("grandparent") != F.col("component")).alias("changed"),
            ),
            "components",
        )
    return state.select("node", "component")
