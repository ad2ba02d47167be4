"""Exact ranks of rows by parallel sorting by regular sampling.

Runs of rows are sorted where they lie, and every so many places of a run one row is a sample. The
samples of all runs are sorted and sampled again in the same way until few enough are left for the driver, which takes
splitters at regular places. Rows then go to the segment between two splitters, a segment is merged
in one task, and the number of rows in the segments before it makes its places exact ranks.

Rows are ordered by a whole number, the largest first, then by id, the smallest first, then by a row
number, so rows that are equal in the first two never crowd a segment. A null id comes last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterline.functions.stage import stage

#: Rows of a locally sorted run at most, and every how many places a row is a sample.
RUN, STEP = 1 << 18, 64
#: Samples that the driver takes splitters from at most, and every how many places one is kept where there are more.
ON_DRIVER, AGAIN = 200_000, 4
#: Rows a segment should hold, while there are fewer than MOST segments.
SEGMENT, MOST = 20_000, 8192
#: Stands for a null id.
LAST = np.iinfo(np.int64).max


def _ids(column) -> np.ndarray:
    return column.fill_null(int(LAST)).to_numpy(zero_copy_only=False)


def _order(score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.lexsort((row, id_, ~score))  # ~x falls where x rises, without overflow


def regular_samples(keys: DataFrame, step: int = STEP, run: int = RUN) -> DataFrame:
    """Every ``step``-th row of each sorted run of keys (score, id, row), from the middle of the first step on."""
    def sample(batches):
        held, rows = [], 0

        def out():
            score, id_, row = (np.concatenate(c) for c in zip(*held, strict=True))
            at = _order(score, id_, row)[min(step // 2, len(score) - 1)::step]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (score, id_, row)], names=["score", "id", "row"])

        for batch in batches:
            if len(batch):
                held.append((batch.column(0).to_numpy(), _ids(batch.column(1)), batch.column(2).to_numpy()))
                rows += len(batch)
            if rows >= run:
                yield out()
                rows = 0
        if held:
            yield out()

    return keys.select("score", "id", "row").mapInArrow(sample, "score long, id long, row long")


def splitters(keys: DataFrame, rows: int, segment: int = SEGMENT, step: int = STEP) -> list[np.ndarray]:
    """Sorted (score, id, row) at which segments begin; the first segment has none."""
    segments = min(MOST, -(-rows // segment))
    if segments < 2:
        return [np.zeros(0, np.int64)] * 3
    samples = stage(regular_samples(keys, step))
    while (n := samples.count()) > ON_DRIVER:
        samples = stage(regular_samples(samples.coalesce(max(1, n // RUN)), AGAIN))
    found = samples.toArrow()
    columns = [found[c].combine_chunks().to_numpy() for c in ("score", "id", "row")]
    order = _order(*columns)
    at = order[np.unique(np.arange(1, segments) * len(order) // segments)]
    return [c[at] for c in columns]


def _segment(score: np.ndarray, id_: np.ndarray, row: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many splitters are not behind each row: rows and splitters are sorted together."""
    n = len(cuts[0])
    merged = _order(*(np.r_[c, x] for c, x in zip(cuts, (score, id_, row), strict=True)))
    passed = np.cumsum(merged < n)
    out = np.empty(len(merged), np.int32)
    out[merged] = passed
    return out[n:]


def ranked(rows: DataFrame, score: str, id_col: str, wanted: int | None = None, among: str | None = None, segment: int = SEGMENT, step: int = STEP) -> DataFrame:
    """The rows with their ``rank`` from 1 by falling ``score``, ties by ``id_col``; null behind the ``wanted`` first.

    With ``among``, the name of a boolean column, only rows where it is true are ranked. ``score`` must
    not be null. ``rows`` should be a written table; it is read several times.
    """
    key = [F.col(score).cast("long").alias("score"), F.col(id_col).cast("long").alias("id")]
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    takes_part = numbered.where(among) if among else numbered
    total = takes_part.count()
    cuts = splitters(takes_part.select(*key, "row"), total, segment, step)

    def deal(batches):
        for batch in batches:
            at = [batch.schema.get_field_index(c) for c in ("score_", "id_", "row_")]
            own = _segment(batch.column(at[0]).to_numpy(), _ids(batch.column(at[1])), batch.column(at[2]).to_numpy(), cuts)
            kept = [i for i in range(batch.num_columns) if i not in at[:2]]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(own)],
                                             names=[*[batch.schema.names[i] for i in kept], "segment_"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = stage(takes_part.select(*rows.columns, F.col("row").alias("row_"), key[0].alias("score_"), key[1].alias("id_"))
                  .mapInArrow(deal, f"{kinds}, row_ long, segment_ int"))
    counts = dict(sorted((r.segment_, r.n) for r in dealt.groupBy("segment_").agg(F.count("*").alias("n")).collect()))
    before = dict(zip(counts, np.cumsum([0, *counts.values()])[:-1].tolist(), strict=True))
    wanted, names = total if wanted is None else wanted, rows.columns

    def merge(key_, table):
        first = before[key_[0].as_py()]
        order = _order(table[score].to_numpy(), _ids(table[id_col].combine_chunks().cast(pa.int64())), table["row_"].to_numpy())
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(first + 1, first + 1 + len(order))
        return table.select(names).append_column("rank", pa.array(place, mask=place > wanted))

    # Segments whose first place is behind the last wanted one need no sorting.
    far = [s for s, n in before.items() if n >= wanted]
    none = F.lit(None).cast("long").alias("rank")
    placed = dealt.where(~F.col("segment_").isin(far)) if far else dealt
    out = placed.groupBy("segment_").applyInArrow(merge, f"{kinds}, rank long")
    if far:
        out = out.union(dealt.where(F.col("segment_").isin(far)).select(*rows.columns, none))
    if among:
        out = out.union(rows.where(~F.coalesce(F.col(among), F.lit(False))).select(*rows.columns, none))
    return out
