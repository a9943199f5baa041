"""Best-fit packing of documents into sequences of several permitted lengths.

Only the histogram of piece lengths decides a packing, and it has at most as many entries as the largest
permitted length.  ``plan_bins`` runs best-fit decreasing over that histogram, whole runs of equal pieces
at a time, which gives the same bins as placing pieces one by one.  The pieces themselves are ranked within
their length and looked up in the plan by Spark; no piece passes through the driver.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import saved

BUCKET_ROWS = 1_000


@dataclass
class Run:
    """Bins filled alike: ``count`` bins from number ``first`` on, with ``used`` of ``size`` tokens."""

    first: int
    count: int
    size: int
    used: int


@dataclass
class Plan:
    cost: float = 0.0
    slots: list = field(default_factory=list)  # (length, rank_from, rank_to, first_bin, per_bin, offset)
    bins: list = field(default_factory=list)  # (first_bin, end_bin, capacity)

    def slots_by_capacity(self) -> list:
        """The slots cut where the final capacity of their bins changes, with that capacity."""
        runs, out = sorted(self.bins), []
        firsts = [r[0] for r in runs]
        for length, start, stop, first, each, offset in self.slots:
            last = first + -(-(stop - start) // each)
            at = first
            while at < last:
                _, end, capacity = runs[bisect.bisect_right(firsts, at) - 1]
                end = min(end, last)
                rank_to = min(stop, start + (end - first) * each)
                out.append((length, start + (at - first) * each, rank_to, at, each, offset, capacity))
                at = end
        return out


def bin_cost(size: int, overhead: float, quadratic: float) -> float:
    """Cost of one sequence of this length: what any sequence costs, its tokens, and their attention to each other."""
    return overhead + size + size * size / quadratic


def plan_bins(histogram: dict[int, int], sizes: list[int], overhead: float = 64.0, quadratic: float = 16384.0) -> Plan:
    """The cheapest of the best-fit packings over every choice of the largest length that may be opened.

    A piece goes to the open bin with the least room that holds it.  If there is none, the bin size with
    the least cost for each token of such pieces is opened.  At the end each bin shrinks to the least
    permitted length that holds its contents, so costs are compared after shrinking.
    """
    longest = max(histogram, default=0)
    plans = [_best_fit(histogram, sizes, s, lambda x: bin_cost(x, overhead, quadratic)) for s in sizes if s >= longest]
    return min(plans, key=lambda p: p.cost)


def _best_fit(histogram: dict[int, int], sizes: list[int], largest: int, cost_of) -> Plan:
    plan, numbered = Plan(), 0
    rooms: list[int] = []  # sorted free rooms of open runs
    by_room: dict[int, list[Run]] = {}

    def put(run: Run) -> None:
        room = run.size - run.used
        if room not in by_room:
            bisect.insort(rooms, room)
            by_room[room] = []
        by_room[room].append(run)

    def take(length: int) -> Run | None:
        i = bisect.bisect_left(rooms, length)
        if i == len(rooms):
            return None
        runs = by_room[rooms[i]]
        run = runs.pop()
        if not runs:
            del by_room[rooms.pop(i)]
        return run

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            run = take(length)
            if run is None:
                open_sizes = [s for s in sizes if length <= s <= largest]
                size = min(open_sizes, key=lambda s: (cost_of(s) / (s // length * length), s))
                run = Run(numbered, -(-left // (size // length)), size, 0)
                numbered += run.count
            each = (run.size - run.used) // length
            full = min(run.count, left // each)
            if full:
                plan.slots.append((length, rank, rank + full * each, run.first, each, run.used))
                put(Run(run.first, full, run.size, run.used + each * length))
                rank, left = rank + full * each, left - full * each
                run = Run(run.first + full, run.count - full, run.size, run.used)
            if run.count and left and left < each:
                plan.slots.append((length, rank, rank + left, run.first, left, run.used))
                put(Run(run.first, 1, run.size, run.used + left * length))
                run = Run(run.first + 1, run.count - 1, run.size, run.used)
                left = 0
            if run.count:
                put(run)
    for runs in by_room.values():
        for run in runs:
            capacity = min(s for s in sizes if s >= run.used)
            plan.bins.append((run.first, run.first + run.count, capacity))
            plan.cost += run.count * cost_of(capacity)
    return plan


def pack_best_fit(
    docs: DataFrame, tokens: Column, lengths: list[int], overhead: float = 64.0, quadratic: float = 16384.0,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Pieces of documents in bins: doc_id, piece, start_token, n_tokens, bin_id, bin_offset, capacity.

    ``tokens`` is the length of a document; one longer than the largest permitted length is cut into pieces
    of that length and a rest.  Documents of no tokens (or null) take no place and give no row.  Equal rows
    are separate documents; ties between them are broken by hash and do not change any bin's filling.
    An empty table gives an empty result.  Columns other than doc_id are ignored.
    """
    sizes, spark = sorted(set(lengths)), docs.sparkSession
    top = sizes[-1]
    whole = docs.select("doc_id", tokens.cast("long").alias("_t")).filter(F.col("_t") > 0)
    pieces = whole.select("doc_id", "_t", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("_t") - 1, F.lit(top).cast("long"))).alias("piece", "start_token"))
    pieces = saved(pieces.select(
        "doc_id", F.col("piece").cast("long").alias("piece"), "start_token", F.least(F.lit(top).cast("long"), F.col("_t") - F.col("start_token")).alias("n_tokens")
    ), "pieces")
    # at most as many rows as the largest length
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    plan = plan_bins(histogram, sizes, overhead, quadratic) if histogram else Plan()

    parts = spark.createDataFrame([(k, -(-n // bucket_rows)) for k, n in histogram.items()], "n_tokens long, _parts long")
    dealt = pieces.join(F.broadcast(parts), "n_tokens").withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_parts")))
    sizes_of = dealt.groupBy("n_tokens", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("n_tokens").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes_of.select("n_tokens", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("n_tokens", "_part").orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece")
    ranked = dealt.join(starts, ["n_tokens", "_part"]).withColumn("_rank", F.col("_start") + F.row_number().over(inside) - 1)

    slots = spark.createDataFrame(
        plan.slots_by_capacity(), "_length long, _from long, _to long, _first long, _each long, _offset long, capacity long"
    )
    # a few rows for each length, however many pieces there are
    placed = ranked.join(
        F.broadcast(slots), (F.col("n_tokens") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    )
    nth = F.col("_rank") - F.col("_from")
    return placed.select(
        "doc_id", "piece", "start_token", "n_tokens", (F.col("_first") + F.floor(nth / F.col("_each"))).cast("long").alias("bin_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("n_tokens")).cast("long").alias("bin_offset"), "capacity",
    )
