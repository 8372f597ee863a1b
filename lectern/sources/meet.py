"""Groups of askers that meet a copy of a catalogue in one task each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extent(asking: DataFrame, size: int) -> tuple[int, int]:
    """Groups of about `size` askers, as many as there are cores if these suffice, and the most books that one of them has blocked."""
    n, most = asking.agg(F.count("*"), F.max(F.size("gone"))).first()
    return max(1, -(-n // size), min(n, asking.sparkSession.sparkContext.defaultParallelism)), max(most or 0, 0)


def meet(asking: DataFrame, shelves: DataFrame, groups: int, best, schema: str, *key: str) -> DataFrame:
    """best(asking, shelves), iterated: the askers of a group, dealt by `key`, and a copy of the shelves as Arrow columns by name."""
    columns = [asking.columns, shelves.columns]
    nothing = [F.lit(None).cast(df.select(F.struct("*").alias("x")).schema["x"].dataType).alias(name) for df, name in ((asking, "a"), (shelves, "s"))]
    here = F.pmod(F.xxhash64(*key), F.lit(groups)).cast("int").alias("at")
    users = asking.select(here, F.lit(0).alias("kind"), F.struct("*").alias("a"), nothing[1])
    copies = shelves.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("at"), F.lit(1).alias("kind"), nothing[0], F.struct("*").alias("s"))
    dealt = users.unionByName(copies).repartitionById(groups, "at").sortWithinPartitions("kind").select("kind", "a", "s")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[], []]
        for batch in batches:
            asked = int((np.asarray(batch.column(0)) == 0).sum())  # askers come first
            for k, part in enumerate((batch.slice(0, asked), batch.slice(asked))):
                if part.num_rows:
                    parts[k].append(part.column(k + 1).flatten())
        if all(parts):
            sides = [{c: pa.concat_arrays([p[k] for p in some]) for k, c in enumerate(of)} for some, of in zip(parts, columns)]
            parts.clear()
            for found in best(*sides):
                yield pa.RecordBatch.from_arrays([*map(pa.array, found)], names)

    return dealt.mapInArrow(run, schema)
