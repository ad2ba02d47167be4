"""Target-distribution importance resampling: draw documents that look like a target set.

Features are runs of one to ``longest`` consecutive words, hashed into a fixed number of buckets. A
bucket's gain is the logarithm of how much more frequent it is in the target than in the corpus, in
thousandths; gains are one array of that many whole numbers, and a document's weight is the sum of
its features' gains. Gumbel noise from a hash of seed and id turns the order by weight into a draw
without replacement, and exact ranks come from sorting by regular sampling (``sample_sort``).

All counts cover whole texts and whole tables. A null or empty text has no feature and weight 0; a
null id is an empty text in the hash and comes last among ties. Repeated rows count and are ranked
as often as they occur. Columns other than id and text are not looked at. An empty table gives no
rows; an empty target gives the gains of a target without features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craterline.functions.stage import stage
from craterline.llm.common import Memo, slices, text_runs, word_runs
from craterline.llm.sample_sort import ranked

BUCKETS, LONGEST, SEED, FEWEST = 10_000, 1, 2024, 20
#: Fixed value: bytes that words consist of are digits, letters and all that are not ASCII; A-Z becomes a-z.
WORD_BYTES = bytes(b if chr(b).isdigit() or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_memos: dict[int, Memo] = {}


def _word_runs(text: bytes, size: int) -> Iterator[list[bytes]]:
    return word_runs(text.translate(WORD_BYTES), size)


def feature_runs(column, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For a run of texts at a time: rows and how many words each has there, the row and the bucket of every feature.

    A long text comes in several runs; its features across their borders are in the later one.
    """
    if buckets not in _memos:
        _memos[buckets] = Memo("resampling", lambda new: [zlib.crc32(w) % buckets for w in new])
    first = 0
    for texts in slices(column, 256):
        row_before, tail = None, []
        for run in text_runs(texts, parts=_word_runs):
            words = [w for _, own in run for w in own]
            rows, sizes = (np.fromiter(c, np.int64, len(run)) for c in ((first + r for r, _ in run), (len(own) for _, own in run)))
            owners, found = [np.repeat(rows, sizes)], [np.fromiter(_memos[buckets].look_up(words), np.int32, len(words))]
            if longest > 1:
                for row, own in run:
                    before = tail if row == row_before else []
                    both = before + own
                    grams = [b" ".join(both[i:i + n]) for n in range(2, longest + 1) for i in range(max(0, len(before) - n + 1), len(both) - n + 1)]
                    owners.append(np.full(len(grams), first + row))
                    found.append(np.fromiter((zlib.crc32(g) % buckets for g in grams), np.int32, len(grams)))
                    row_before, tail = row, both[-(longest - 1):]
            yield rows, sizes, np.concatenate(owners), np.concatenate(found)
        first += len(texts)


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features of a table; each task adds up its own first."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found in feature_runs(batch.column(0), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return (texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").cast("long").alias("n")))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Every bucket's gain in thousandths, from two tables (bucket, n)."""
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    # At most `buckets` rows come to the driver.
    rows = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).toArrow()
    s, t = np.zeros(buckets), np.zeros(buckets)
    at = rows["bucket"].to_numpy()
    s[at], t[at] = rows["s"].to_numpy(), rows["t"].to_numpy()
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(documents: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """Id, ``n_words``, ``n_features`` and ``weight`` of every document."""
    kind = documents.schema[id_col].dataType.simpleString()

    def weigh(batches):
        for batch in batches:
            words, features, weight = np.zeros((3, len(batch)), np.int64)
            for rows, sizes, owners, found in feature_runs(batch.column(1), longest, len(gain)):
                np.add.at(words, rows, sizes)
                features += np.bincount(owners, minlength=len(batch))
                weight += np.bincount(owners, weights=gain[found], minlength=len(batch)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)],
                                             names=[id_col, "n_words", "n_features", "weight"])

    return (documents.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(weigh, f"`{id_col}` {kind}, n_words long, n_features long, weight long"))


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of the SHA-256 of ``<seed>:<id>``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(documents: DataFrame, target: DataFrame, percent: int, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
             fewest: int = FEWEST, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", segment: int | None = None) -> DataFrame:
    """Id, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` of every document; ``percent`` of those with ``fewest`` words have a rank."""
    gain = gains(bucket_counts(documents, text_col, longest, buckets), bucket_counts(target, target_text, longest, buckets), buckets)
    scored = stage(weights(documents, gain, id_col, text_col, longest)
                   .withColumn("score", F.col("weight") + gumbel(id_col, seed)).withColumn("eligible", F.col("n_words") >= fewest))
    drawn = percent * scored.where("eligible").count() // 100
    options = {"segment": segment} if segment else {}
    return ranked(scored, "score", id_col, wanted=drawn, among="eligible", **options).drop("eligible")
