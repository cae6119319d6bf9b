"""Frontier loops over DataFrames: each round is written to the shared folder, so plans stay short and lost executors cost nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.session import Scratch

#: Tables of rounds that are read together before they become one.
MOST_TABLES = 32
#: Rounds after which a loop that should have ended is an error.
MOST_ROUNDS = 10_000


def frontier_loop(scratch: Scratch, seeds: DataFrame, step, rounds: int | None = None, tag: str = "loop") -> DataFrame:
    """All rows reached: ``seeds`` (with ``id`` and ``hop`` = 0), then what ``step(frontier, reached, hop)`` adds in each round.

    ``step`` gives rows of the same columns whose ids were not reached before. The loop ends with an empty round or after
    ``rounds``. Rounds are small Parquet tables that are read together; nothing but whether a round is empty comes to the driver.
    """
    spark, paths = scratch.spark, [scratch.path(f"{tag}-0")]
    frontier = scratch.write(seeds, f"{tag}-0")
    schema, hop = frontier.schema, 0
    while (rounds is None or hop < rounds) and not frontier.isEmpty():
        hop += 1
        if hop > MOST_ROUNDS:
            raise RuntimeError(f"{tag}: no end after {MOST_ROUNDS} rounds")
        reached = spark.read.schema(schema).parquet(*paths)
        new = step(frontier, reached, hop).select(*schema.names)
        frontier = scratch.write(new, f"{tag}-{hop}")
        paths.append(scratch.path(f"{tag}-{hop}"))
        if len(paths) > MOST_TABLES:  # one table for all rounds but the last, so that long chains don't open ever more files
            scratch.write(spark.read.schema(schema).parquet(*paths[:-1]), f"{tag}-all-{hop}")
            paths = [scratch.path(f"{tag}-all-{hop}"), paths[-1]]
    return spark.read.schema(schema).parquet(*paths)
