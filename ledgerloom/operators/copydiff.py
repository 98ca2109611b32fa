"""Field-by-field differences between two copies of the same data."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..session import ship

ROWS_PER_BUCKET = 200_000


_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Presence:
    """Compressed bitmap over ordinals: words of 64 ordinals that are full are kept as runs (start, end), words that are neither
    empty nor full as they are, with their positions, and empty words not at all. Operations work on runs and stored words, so
    their cost follows the compressed size."""

    def __init__(self, full: np.ndarray, at: np.ndarray, words: np.ndarray):
        self.full, self.at, self.words = full, at, words

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Presence:
        o = np.unique(ordinals)
        at, first = np.unique(o >> 6, return_index=True)
        bits = np.uint64(1) << (o & 63).astype(np.uint64)
        words = np.bitwise_or.reduceat(bits, first) if len(o) else np.empty(0, np.uint64)
        filled = words == _FULL
        return cls(_runs(at[filled]), at[~filled], words[~filled])

    def _has_run(self, at: np.ndarray) -> np.ndarray:
        """Whether each word position lies in a run of full words."""
        i = np.searchsorted(self.full[:, 0], at, side="right") - 1
        return (i >= 0) & (at < self.full[i, 1]) if len(self.full) else np.zeros(len(at), bool)

    def _stored(self, at: np.ndarray) -> np.ndarray:
        """The stored word at each position, full in a run, else empty."""
        out = np.where(self._has_run(at), _FULL, np.uint64(0))
        i = np.minimum(np.searchsorted(self.at, at), max(0, len(self.at) - 1))
        if len(self.at):
            out = np.where(self.at[i] == at, self.words[i], out)
        return out

    def _combine(self, other: Presence, negate: bool) -> Presence:
        """self AND other, or AND NOT. Runs are cut where either side changes; mixed words are combined one by one."""
        mixed = np.unique(np.concatenate((self.at, other.at)))
        cuts = np.unique(np.concatenate((self.full.ravel(), other.full.ravel(), mixed, mixed + 1)))
        begin, end = cuts[:-1], cuts[1:]
        keep = self._has_run(begin) & (other._has_run(begin) != negate) & ~np.isin(begin, mixed)
        mine, theirs = self._stored(mixed), other._stored(mixed)
        words = mine & (~theirs if negate else theirs)
        some = words != 0
        runs = np.stack((begin[keep], end[keep]), 1) if len(cuts) > 1 else np.empty((0, 2), np.int64)
        return Presence(runs, mixed[some], words[some])

    def and_not(self, other: Presence) -> Presence:
        return self._combine(other, True)

    def intersect(self, other: Presence) -> Presence:
        return self._combine(other, False)

    def ordinals(self) -> np.ndarray:
        """The ordinals that are present, in order."""
        sizes = (self.full[:, 1] - self.full[:, 0]) * 64
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        of_runs = np.repeat(self.full[:, 0] * 64, sizes) + within
        word, bit = np.nonzero(np.unpackbits(self.words.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64))
        return np.sort(np.concatenate((of_runs, self.at[word] * 64 + bit)).astype(np.int64))


def _runs(at: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of neighbouring positions."""
    if not len(at):
        return np.empty((0, 2), np.int64)
    breaks = np.flatnonzero(np.diff(at) != 1)
    return np.stack((at[np.concatenate(([0], breaks + 1))], at[np.concatenate((breaks, [len(at) - 1]))] + 1), 1)


def compare_bucket(batch: pa.Table, fields: Sequence[str], missing: tuple[str, str]) -> pa.Table:
    """Differences within one bucket of keys: (key, difference).

    batch: key, right (whether the row is of the right copy), and for each field f its value f and kind f_kind; one row
    per key and side. Keys get ordinals shared by both sides; presence bitmaps give the missing ones, and the values of
    the others are compared in the order of their ordinals.
    """
    codes = batch["key"].combine_chunks().dictionary_encode()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    names, ordinal = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)
    right, n = batch["right"].to_numpy().astype(bool), len(names)
    a, b = Presence.of(ordinal[~right].astype(np.int64)), Presence.of(ordinal[right].astype(np.int64))
    found: list[tuple[np.ndarray, str]] = [(a.and_not(b).ordinals(), missing[1]), (b.and_not(a).ordinals(), missing[0])]
    both, place = a.intersect(b).ordinals(), np.empty((2, n), np.int64)
    place[right.astype(int), ordinal] = np.arange(len(right))
    for f in fields:
        unlike = np.zeros(len(both), bool)
        for c in (f, f"{f}_kind"):
            v = batch[c].to_numpy()
            unlike |= v[place[0, both]] != v[place[1, both]]
        found.append((both[unlike], f))
    return pa.table(
        {
            "key": pa.chunked_array([pc.take(names, pa.array(o)) for o, _ in found], pa.string()),
            "difference": pa.chunked_array([pa.array([d] * len(o), pa.string()) for o, d in found], pa.string()),
        }
    )


def copy_differences(
    left: DataFrame, right: DataFrame, key: Column, numbers: Sequence[str], missing: tuple[str, str], key_name: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Keys missing on either side and fields whose numbers differ: (key_name, difference), one row each.

    key: text column over either side; missing: what to call a key that is not in (left, right). Rows without key don't
    count. A key delivered twice on a side counts once; should its rows disagree, the greatest values stand. Numbers are
    compared as numbers; blank equals blank only; unreadable cells are compared by their text. Empty tables give only
    missing keys or nothing. Other columns are never looked at, so clashing names do no harm.

    Rows are reduced to one per key and side on the map side. Keys are then spread by hash over buckets of about
    rows_per_bucket rows, and each bucket is compared in one Arrow group: memory depends on the bucket, not on the data.
    Counting the input for the number of buckets is the one job that runs while the plan is built.
    """

    def one(df: DataFrame, is_right: bool) -> DataFrame:
        cells = []
        for f in numbers:
            amount = parse.parse_amount(f)
            kind = F.when(amount.isNotNull(), 1).when(parse.filled(f).isNotNull(), 2).otherwise(0).cast("byte")
            value = F.coalesce((amount * 1_000_000).try_cast("bigint"), F.xxhash64(amount, F.when(amount.isNull(), parse.filled(f))))
            cells += [value.alias(f), kind.alias(f"{f}_kind")]
        return df.select(key.alias("key"), F.lit(is_right).alias("right"), *cells).where("key is not null")

    ship(left.sparkSession)
    names = [c for f in numbers for c in (f, f"{f}_kind")]
    both = one(left, False).unionByName(one(right, True))
    once = both.groupBy("key", "right").agg(F.max(F.struct(*names)).alias("v")).select("key", "right", "v.*")
    buckets = max(1, -(-(left.count() + right.count()) // rows_per_bucket))
    schema = "key string, difference string"
    fields, gone = list(numbers), tuple(missing)
    return (
        once.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(17)), F.lit(buckets)))
        .groupBy("bucket")
        .applyInArrow(lambda t: compare_bucket(t, fields, gone), schema)
        .withColumnRenamed("key", key_name)
    )


def filing_copy_differences(prior: DataFrame, copy: DataFrame, period: str = "2026-03") -> DataFrame:
    """copy_differences of one delivered snapshot of prior and its copy: (invoice_id, difference)."""
    return copy_differences(
        prior.where(parse.filled("gstr2b_period") == period), copy, parse.record_key("invoice_id"),
        ("taxable_value", "cgst", "sgst", "igst"), ("missing_in_prior", "missing_in_copy"), "invoice_id",
    )
