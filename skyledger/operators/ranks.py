"""Order statistics and running sums that no single task has to hold, as lazy plans.

Rows are first counted per distinct value, with a map-side combine; all that follows reads that one
exchange. The values of a group are cut into buckets by a rule that keeps their order and needs no
look at the data (so many to every doubling of the magnitude); the buckets' sums are added up in
order, at most some ten thousand a group, and each bucket adds its own values behind the sum of those
before it. The buckets only balance the work: the results are exact. They balance badly where all
values of a large group differ by less than a thousandth of their size; subtract an offset then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets to a doubling of the magnitude, and the magnitude around 0 below which values are not told apart.
PER_OCTAVE, SMALL = 512, 2.0**-20
#: Buckets to a doubling where the rows are read again for the wanted ones: a bucket may hold many values.
FEW_OCTAVE = 64
#: Bits by which values are told apart first and in each further reading; values that may be listed.
FIRST_BITS, MORE_BITS, LISTED = 16, 8, 1 << 20
#: Rows sorted at once, and buckets that a task holds before it puts equal ones together.
SORTED, BUCKETS = 1 << 17, 1 << 18


def _same(left: DataFrame, right: DataFrame, by: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"{prefix}{c}"]) for c in by], F.lit(True))


def _renamed(df: DataFrame, by: list[str], prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in by), *[c for c in df.columns if c not in by])


def attach(df: DataFrame, small: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Joins a table with a row a group, null-safely. Whether it is broadcast follows from the size that
    it turns out to have; without keys it is one row and always is."""
    s = _renamed(small, by, "_of_")
    return df.join(s if by else F.broadcast(s), _same(df, s, by, "_of_"), how).drop(*(f"_of_{c}" for c in by))


def bucket(value: Column, per_octave: int = PER_OCTAVE) -> Column:
    """A whole number that does not fall as the value rises."""
    x = value.cast("double")
    return (F.signum(x) * F.floor(per_octave * F.log2(1 + F.abs(x) / SMALL))).cast("long")


def _before(counts: DataFrame, by: list[str], sums: dict[str, str], descending: bool = False) -> DataFrame:
    """A row per group and bucket: for each pair the bucket's own sum, that of the buckets before it, and
    that of the group."""
    each = counts.groupBy(*by, "_bucket").agg(*(F.sum(c).alias(f"_own_{n}") for n, c in sums.items()))
    order = F.desc("_bucket") if descending else F.asc("_bucket")
    whole = W.partitionBy(*by)
    before = whole.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    found = {f"_before_{n}": F.coalesce(F.sum(f"_own_{n}").over(before), F.lit(0)) for n in sums}
    return each.withColumns(found | {f"_all_{n}": F.sum(f"_own_{n}").over(whole) for n in sums})


def _inside(counts: DataFrame, each: DataFrame, by: list[str], value: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """The rows of the buckets in ``each`` with their running sums."""
    order = F.desc(value) if descending else F.asc(value)
    inside = W.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return attach(counts, each, [*by, "_bucket"]).withColumns({n: F.col(f"_before_{n}") + F.sum(c).over(inside) for n, c in sums.items()})


def running(counts: DataFrame, by: list[str], value: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """counts: one row per group and value. Adds, for each pair (new column: summed column), the sum
    over the values up to and including the row's, in order."""
    rows = counts.withColumn("_bucket", bucket(F.col(value)))
    each = _before(rows, by, sums, descending).select(*by, "_bucket", *(f"_before_{n}" for n in sums))
    return _inside(rows, each, by, value, sums, descending).drop("_bucket", *(f"_before_{n}" for n in sums))


def counted(df: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """by, _v, _n: how often each group has each value that is not null; or the sums of ``weight``."""
    n = F.sum(weight) if weight else F.count("*")
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(n.alias("_n"))


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], weight: str | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles of the values that are not null: a row a group with a
    column for each name in ``at``, and n, the number of values. With ``weight`` a row counts so often."""
    counts = counted(df, by, value, weight).withColumn("_bucket", bucket(F.col("_v")))
    return _looked_up(lambda each: counts, _before(counts, by, {"_upto": "_n"}), by, at)


def quantiles_of_few(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """``quantiles`` of groups that are few, whatever their size, by two readings of the rows: they are
    counted by bucket, and then by value in the buckets that hold a wanted place. What is exchanged and
    broadcast grows with the groups and not with the rows."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), bucket(F.col(value), FEW_OCTAVE).alias("_bucket"))
    each = _before(rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")), by, {"_upto": "_n"})

    def wanted(some: DataFrame) -> DataFrame:
        keys = [*by, "_bucket"]
        s = _renamed(some.select(*keys), keys, "_of_")
        held = rows.join(F.broadcast(s), _same(rows, s, keys, "_of_"), "left_semi")  # a few buckets a group
        return held.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))

    return _looked_up(wanted, each, by, at)


def quantiles_of_columns(df: DataFrame, at: list[float]) -> list[np.ndarray]:
    """Exact, linearly interpolated quantiles of each column of doubles, without those that are missing or
    NaN; none for a column that has no values. The rows are read several times and never exchanged:
    values are counted by their first bits, then those beside a wanted place by more and more of them, until
    a bucket has one value or all that are left can be listed. Values may lie as closely as they like."""
    width = len(df.columns)
    wanted: list[np.ndarray | None] = [None] * width  # the buckets to look into; at first all
    places: list[np.ndarray] = []
    counts, before = [0] * width, [{} for _ in range(width)]
    known: list[dict[int, int]] = [{} for _ in range(width)]  # place: value's key
    bits = FIRST_BITS
    old = 0
    while True:
        each = _by_bits(df, width, old, bits, wanted)
        left = 0
        for f, (bucket_of, n, low, high) in enumerate(each):
            if not old:
                counts[f] = int(n.sum())
                p = np.array(at) * (counts[f] - 1)
                places.append(np.unique(np.concatenate([np.floor(p), np.ceil(p)]).astype(np.int64)) if counts[f] else np.zeros(0, np.int64))
            if not len(n):
                wanted[f] = np.zeros(0, np.int64)
                continue
            parent = bucket_of >> (bits - old) if old else np.zeros(len(n), np.int64)
            starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            upto = np.cumsum(n)
            base = np.array([before[f].get(int(b), 0) for b in parent[starts]]) - (upto[starts] - n[starts])
            end = upto + np.repeat(base, np.diff([*starts, len(n)]))
            first, more = end - n, {}
            for k in places[f].tolist():
                if k in known[f]:
                    continue
                i = int(np.searchsorted(end, k, side="right"))
                if low[i] == high[i]:
                    known[f][k] = int(low[i])
                else:
                    more[int(bucket_of[i])] = (int(first[i]), int(n[i]))
            wanted[f], before[f] = np.array(sorted(more), np.int64), {b: k for b, (k, _) in more.items()}
            left += sum(m for _, m in more.values())
        if not left:
            break
        old, bits = bits, 64 if left <= LISTED else min(bits + MORE_BITS, 64)

    def value(f: int, q: float) -> float:
        p = q * (counts[f] - 1)
        a, b = (float(_value_of(np.array([known[f][int(k)]]))[0]) for k in (np.floor(p), np.ceil(p)))
        return a + (b - a) * (p - np.floor(p))

    return [np.array([value(f, q) for q in at]) if counts[f] else np.zeros(0) for f in range(width)]


def _key_of(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    i = (x + 0.0).view(np.int64)
    return i ^ ((i >> 63) & np.int64(2**63 - 1))


def _value_of(key: np.ndarray) -> np.ndarray:
    return (key ^ ((key >> 63) & np.int64(2**63 - 1))).view(float)


def _by_bits(df: DataFrame, width: int, old: int, bits: int, wanted: list[np.ndarray | None]) -> list[tuple[np.ndarray, ...]]:
    """By column: buckets of so many bits in order, with their numbers of values, least and greatest key; of
    those values that lie in the wanted buckets of ``old`` bits."""

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        b, n, low, high = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(b, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(b[order]) != 0])) if len(b) else np.zeros(0, int)
        return (b[order][starts], *(f.reduceat(x[order], starts) if len(b) else x for f, x in ((np.add, n), (np.minimum, low), (np.maximum, high))))

    def run(batches):
        pending, n = [[] for _ in range(width)], 0
        held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(width)]

        def count():
            for f, parts in enumerate(pending):
                if not parts or wanted[f] is not None and not len(wanted[f]):
                    continue
                x = np.concatenate(parts)
                key = _key_of(x[~np.isnan(x)])
                if wanted[f] is not None:
                    b = key >> (64 - old)
                    i = np.searchsorted(wanted[f], b)
                    key = key[wanted[f].take(i, mode="clip") == b]
                if not len(key):
                    continue
                key.sort()
                b = key >> (64 - bits)
                starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                ends = np.concatenate([starts[1:], [len(key)]])
                held[f].append((b[starts], ends - starts, key[starts], key[ends - 1]))
                if sum(len(p[0]) for p in held[f]) > BUCKETS:
                    held[f] = [merged(held[f])]
                    if len(held[f][0][0]) > BUCKETS // 2:
                        yield from out(f)
            for parts in pending:
                parts.clear()

        def out(f: int):
            if held[f]:
                b, *rest = merged(held[f])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), f), pa.int32()), *(pa.array(a, pa.int64()) for a in (b, *rest))], names=["f", "b", "n", "low", "high"])
            held[f] = []

        for batch in batches:
            for f in range(width):
                pending[f].append(batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= SORTED:
                yield from count()
                n = 0
        yield from count()
        for f in range(width):
            yield from out(f)

    sums = df.mapInArrow(run, "f int, b long, n long, low long, high long").groupBy("f", "b").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    # At most LISTED, or a bucket's parts for each wanted place, which are few.
    f, *rest = (c.to_numpy() for c in sums.orderBy("f", "b").toArrow().select(["f", "b", "n", "low", "high"]).columns)
    return [tuple(c[f == i] for c in rest) for i in range(width)]


def _looked_up(counts: Callable[[DataFrame], DataFrame], each: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """Quantiles from the buckets' sums (``_before``) and the counts by value in some of them."""
    # The wanted places, from 0, as data: the plan does not grow with their number.
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(at.values())))
    place = lambda x: x["q"] * (F.col("_all__upto") - 1)
    held = lambda p, low, high: (p >= low) & (p < high)
    within = lambda x, low, high: held(F.floor(place(x)), low, high) | held(F.ceil(place(x)), low, high)
    # Only the buckets that one of the places lies in are looked into, then only such values.
    first = F.col("_before__upto")
    each = each.where(F.exists(wanted, lambda x: within(x, first, first + F.col("_own__upto")))).drop("_own__upto")
    rows = _inside(counts(each), each, by, "_v", {"_upto": "_n"})
    low, high = F.col("_upto") - F.col("_n"), F.col("_upto")
    rows = rows.select(*by, "_all__upto", "_v", "_upto", "_n", F.explode(F.filter(wanted, lambda x: within(x, low, high))).alias("_w"))
    w = F.col("_w")
    ends = [F.when(held(end(place(w)), low, high), F.col("_v")) for end in (F.floor, F.ceil)]
    g = rows.select(*by, "_all__upto", w["i"].alias("_i"), place(w).alias("_p"), *(e.alias(n) for n, e in zip(("_a", "_b"), ends, strict=True)))
    g = g.groupBy(*by, F.col("_all__upto").alias("n")).agg(F.collect_list(F.struct("_i", "_p", "_a", "_b")).alias("_found"))  # two entries a place at most

    def value(i: int) -> Column:
        own = F.filter("_found", lambda x: x["_i"] == i)
        a, b, p = (F.array_max(own[c]) for c in ("_a", "_b", "_p"))
        return a + (b - a) * (p - F.floor(p))

    return g.select(*by, "n", *(value(i).alias(name) for i, name in enumerate(at)))
