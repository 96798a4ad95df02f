"""Discovery to a fixpoint: what links reach from seeds, round by round.

A round follows the links of the nodes found in the round before, drops those seen already by
an anti-join, and is written as a folder of its own, so its plan is short however many rounds
there are, and a lost executor costs one round at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def reached(links: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """node and depth (links followed, the fewest) of all that ``links`` (src, dst) reach from ``seeds`` (node).

    Null nodes and links with a null end are left out; seeds have depth 0 whether they link or
    not. ``most``: the greatest depth looked for.
    """
    spark = links.sparkSession
    base = f"{shared_dir(spark)}/frontier-{uuid.uuid4().hex}"
    schema = f"node {seeds.schema['node'].dataType.simpleString()}"
    steps = links.where("src is not null and dst is not null").select("src", "dst")
    found, depth = seeds.where("node is not null").select("node").distinct(), 0
    while True:
        found.write.parquet(f"{base}/depth={depth}")
        last = spark.read.schema(schema).parquet(f"{base}/depth={depth}")
        if depth == most or not last.limit(1).count():
            return spark.read.schema(f"{schema}, depth int").option("basePath", base).parquet(f"{base}/depth=*")
        seen = spark.read.schema(schema).parquet(f"{base}/depth=*")
        found = last.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        depth += 1
