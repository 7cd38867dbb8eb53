"""Best-fit packing by bin-completion branch and bound.

Pieces of at most ``size`` tokens have few distinct lengths, so the whole corpus
is one histogram, whatever its number of documents. The solver works on that.
Best-fit decreasing gives the first incumbent. A branch takes the largest length
left and completes its sequence by an undominated filling (``fillings`` makes
them all, lazily, large lengths first), applied once or more; it is pruned when
the waste so far exceeds what a better result may waste, and every partial
result that best-fit completes to fewer sequences is the new incumbent. Where
the branches run out first, windows of the incumbent (its most wasteful
sequences among others) are searched in the same way and put back when they
need fewer sequences. The branch budget bounds time alone, never what is packed.

The result is a list of runs (length, ranks, sequences, offset). Pieces learn
their rank within their length from counts per task and length, and find their
run by binary search, so nothing gathers in one task.

Defined results: a null or empty text is a document of the closing id alone;
only documents longer than ``size`` are cut, into pieces of ``size`` and a rest;
equal lengths are dealt in order of task and row; an empty table gives no rows;
further columns are ignored; repeated rows are packed each.
"""

from __future__ import annotations

import heapq
import random
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialize, read_table, trimmed
from .bpe import compile_vocabulary, load_vocabulary, loaded, unload

SIZE, CLOSE = 2048, 0
#: Steps of the search for the whole histogram and for each window of it, sequences of a window, windows tried.
STEPS, WINDOW_STEPS, WINDOW, WINDOWS = 40_000, 6_000, 24, 60
SEED = 4
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


class Pattern(NamedTuple):
    """``count`` sequences that each hold ``lengths`` in this order."""

    lengths: tuple[int, ...]
    count: int


def best_fit(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Best-fit decreasing over counts: groups of equal bins are filled together."""
    by_room: dict[int, list[list]] = defaultdict(list)  # room left -> [lengths, bins]
    rooms: list[int] = []

    def put(lengths: tuple[int, ...], bins: int, room: int) -> None:
        if not by_room[room]:
            heapq.heappush(rooms, room)
        by_room[room].append([lengths, bins])

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        skipped = []
        while left and rooms:
            room = heapq.heappop(rooms)
            if room < length:
                skipped.append(room)
                continue
            groups, by_room[room] = by_room[room], []
            for lengths, bins in groups:
                fits = room // length
                whole = min(bins, left // fits)
                if whole:
                    put((*lengths, *[length] * fits), whole, room - fits * length)
                    left -= whole * fits
                if bins > whole and left:
                    some = left  # fewer than one bin takes
                    if some < fits:
                        put((*lengths, *[length] * some), 1, room - some * length)
                        left, whole = 0, whole + 1
                if bins > whole:
                    put(lengths, bins - whole, room)
            if by_room[room] and not left:
                break
        for room in skipped:
            heapq.heappush(rooms, room)
        fits = size // length
        if left // fits:
            put((length,) * fits, left // fits, size - fits * length)
        if left % fits:
            put((length,) * (left % fits), 1, size - left % fits * length)
    return [Pattern(tuple(g[0]), g[1]) for room in by_room for g in by_room[room]]


def bins_of(patterns: list[Pattern]) -> int:
    return sum(p.count for p in patterns)


def smeared(bits: int, n: int) -> int:
    """``bits`` shifted by 0 to ``n`` places, or-ed."""
    done = 0
    while done < n:
        step = min(done + 1, n - done)
        bits |= bits << step
        done += step
    return bits


def dominated(taken: tuple[int, ...], waste: int, unused: int) -> bool:
    """Whether an unused length could take the place of some of ``taken`` that it holds as a bin (Martello and Toth).

    ``unused`` has a bit for each length of which one is left: it dominates a
    subset of sum s if s <= length <= s + waste, but for an equal length alone.
    """
    one = many = 0
    for x in taken:
        many |= (one | many) << x
        one |= 1 << x
    return bool((smeared(many, waste) | (smeared(one, waste - 1) << 1 if waste else 0) | (smeared(1, waste) & ~1)) & unused)


def fillings(counts: dict[int, int], room: int, budget: list[int], top: int = 0, lengths: list[int] | None = None) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, lengths) of every undominated way to fill ``room``, large lengths first, while the budget lasts.

    ``lengths`` are all lengths, falling; one of ``top`` is not to be had. The
    counts are read as they are: between two results they must be put back.
    """
    lengths = sorted(counts, reverse=True) if lengths is None else lengths
    have = lambda x: counts.get(x, 0) - (x == top)
    if have(room) > 0:
        yield 0, (room,)  # dominates all others
        return
    unused = 0
    for x in lengths[bisect_left(lengths, -room, key=lambda x: -x) :]:
        if have(x) > 0:
            unused |= 1 << x
    stack: list[tuple[tuple[int, ...], int, int]] = [((), room, 0)]  # taken, room left, first length that may be taken
    while stack and budget[0] > 0:
        budget[0] -= 1
        taken, left, at = stack.pop()
        at = bisect_left(lengths, -left, lo=at, key=lambda x: -x)  # the first that fits
        while at < len(lengths) and have(lengths[at]) <= 0:
            at += 1
        if at == len(lengths):
            now = unused
            for x in set(taken):
                if taken.count(x) == have(x):
                    now &= ~(1 << x)
            if not dominated(taken, left, now):
                yield left, taken
            continue
        x = lengths[at]
        stack.append((taken, left, at + 1))  # without a further x
        if taken.count(x) < have(x):
            stack.append(((*taken, x), left - x, at))


def lower_bound(histogram: dict[int, int], size: int) -> int:
    """Martello and Toth's L2: for each threshold, what must stand alone, what is large, and what overflows their room."""
    best = -(-sum(k * n for k, n in histogram.items()) // size)
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[k] for k in lengths], dtype=np.int64)
    for a in [0, *(int(x) for x in lengths if 2 * x <= size)]:
        alone, large, mid = lengths > size - a, (lengths <= size - a) & (2 * lengths > size), (2 * lengths <= size) & (lengths >= a)
        n_large = int(counts[large].sum())
        room = n_large * size - int((counts * lengths)[large].sum())
        over = int((counts * lengths)[mid].sum()) - room
        best = max(best, int(counts[alone].sum()) + n_large + max(0, -(-over // size)))
    return best


def complete(histogram: dict[int, int], size: int, best: list[Pattern], bound: int, steps: int) -> list[Pattern]:
    """The best result that bin completion finds within ``steps``: ``best`` or one with fewer sequences."""
    total = sum(k * n for k, n in histogram.items())
    left, budget = dict(histogram), [steps]  # changed in place on the way down, put back on the way up
    lengths = sorted(histogram, reverse=True)
    done: list[Pattern] = []

    def options() -> Iterator[Pattern]:
        """What may come next: each filling around the largest length, as often as it can be had and then fewer times."""
        top = next((k for k in lengths if left[k]), 0)
        if not top:
            return
        for _, f in fillings(left, size - top, budget, top, lengths):
            items = (top, *f)
            most = min(left[x] // items.count(x) for x in set(items))
            times = most
            while times:
                yield Pattern(items, times)
                times = times // 2 if times > 1 else 0

    used = waste = 0
    stack = [options()]
    while stack and budget[0] > 0 and bins_of(best) > bound:
        nxt = next(stack[-1], None)
        if nxt is None:
            stack.pop()
            if done:
                gone = done.pop()
                used, waste = used - gone.count, waste - gone.count * (size - sum(gone.lengths))
                for x in gone.lengths:
                    left[x] += gone.count
            continue
        budget[0] -= 1
        lost = nxt.count * (size - sum(nxt.lengths))
        if waste + lost > (bins_of(best) - 1) * size - total:
            continue  # a better result may not waste so much
        for x in nxt.lengths:
            left[x] -= nxt.count
        done.append(nxt)
        used, waste = used + nxt.count, waste + lost
        rest = {k: n for k, n in left.items() if n}
        if not rest or len(stack) < 8 or len(stack) % 64 == 0:
            tail = best_fit(rest, size)  # best-fit completions are incumbents too
            budget[0] -= len(rest) // 16
            if used + bins_of(tail) < bins_of(best):
                best = done + tail
        stack.append(options())
    return best


def windows(best: list[Pattern], size: int, bound: int) -> list[Pattern]:
    """``best`` with windows of it searched anew: its most wasteful sequences, and others by chance."""
    rng = random.Random(SEED)
    for k in range(WINDOWS):
        if bins_of(best) <= bound:
            break
        by_waste = sorted((p for p in best if sum(p.lengths) < size), key=lambda p: sum(p.lengths))
        picked: Counter[tuple[int, ...]] = Counter()
        room = WINDOW if k % 2 else WINDOW // 3
        for p in by_waste[: 8 * WINDOW] if k < 2 else rng.sample(by_waste, min(len(by_waste), WINDOW)):
            picked[p.lengths] += min(p.count, max(0, room - picked.total()))
        for p in rng.choices(best, [p.count for p in best], k=WINDOW - picked.total()):
            if picked[p.lengths] < p.count:
                picked[p.lengths] += 1
        have: Counter[tuple[int, ...]] = Counter()
        for p in best:
            have[p.lengths] += p.count
        picked = +Counter({f: min(n, have[f]) for f, n in picked.items()})
        part: Counter[int] = Counter()
        for f, n in picked.items():
            for x in f:
                part[x] += n
        least = lower_bound(part, size)
        start = min(best_fit(part, size), [Pattern(f, n) for f, n in picked.items()], key=bins_of)
        found = complete(part, size, start, least, WINDOW_STEPS) if bins_of(start) > least else start
        if bins_of(found) < picked.total():
            have.subtract(picked)
            for p in found:
                have[p.lengths] += p.count
            best = [Pattern(f, n) for f, n in (+have).items()]
    return best


def solve(histogram: dict[int, int], size: int = SIZE, steps: int = STEPS) -> tuple[list[Pattern], int]:
    """(patterns, lower bound): best-fit decreasing, improved by bin completion on the whole and on windows."""
    histogram = {k: n for k, n in histogram.items() if n}
    bound = lower_bound(histogram, size)
    best = best_fit(histogram, size)
    if bins_of(best) > bound:
        best = complete(histogram, size, best, bound, steps)
    return windows(best, size, bound), bound


def runs(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where the ranks of a length go."""
    at: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for p in sorted(patterns):
        offset = 0
        for length in p.lengths:
            out.append((length, at[length], sequence, offset))
            at[length] += p.count
            offset += length
        sequence += p.count
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4)


def cut(docs: DataFrame, vocabulary: str, size: int = SIZE) -> DataFrame:
    """Pieces with their digest, the task that made them and their place among its pieces of that length."""

    tables, close = compile_vocabulary(docs.sparkSession, vocabulary), CLOSE.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, task = loaded(tables), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            docs_ = iter(batch.column("doc_id").to_pylist())
            for ids, counts in automaton.encode(x.as_py() for x in batch.column("text")):
                rows, ids, begin = [], memoryview(ids.astype("<u4").tobytes()), 0
                for doc, n_ids in zip(islice(docs_, len(counts)), counts.tolist()):
                    for piece, start in enumerate(range(0, n_ids + 1, size)):
                        stop = min(start + size, n_ids)
                        crc = zlib.crc32(ids[4 * (begin + start) : 4 * (begin + stop)])
                        n = stop - start
                        if n < size:  # the document's last id
                            crc, n = zlib.crc32(close, crc), n + 1
                        rows.append((doc, piece, start, n, crc, task, seen[n]))
                        seen[n] += 1
                    begin += n_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long")


def placing(table: np.ndarray):
    """A function over batches of ranked pieces that adds their sequence and offset by the rows of ``runs``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unload()  # all is encoded: workers outlive the job, and would hold the automaton beside what runs next
        key = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), dtype=np.int64) for c in ("length", "rank"))
            row = table[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            extra = [pa.array(row[:, 2] + rank - row[:, 1], pa.int64()), pa.array(row[:, 3], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PIECE), *extra], [*PIECE, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, steps: int = STEPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(cut(docs, vocabulary, size), "pieces")
    counts = materialize(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # ``size`` rows at most
    patterns, _ = solve(histogram, size, steps)
    table = runs(patterns)  # its rows follow the distinct lengths, not the corpus
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("task", "length", "first")

    ranked = pieces.join(firsts.hint("merge"), ["task", "length"]).select(*PIECE, (F.col("first") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(trimmed(placing(table)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), load_vocabulary())
