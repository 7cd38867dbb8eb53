"""Removal of repeated passages by suffix arrays over two-stage sorting.

A byte goes when a string of ``size`` bytes that covers it also starts earlier
(in a smaller doc_id, or earlier in the same text). Sorting every suffix of a
large corpus in one place is out of reach, so suffixes are first dealt out:
among the k-grams of each window of ``size`` bytes the one with the smallest
hash is its anchor. Equal windows have equal anchors, so each window belongs to
the group of one anchor, and groups of an anchor that occurs once need no
sorting. The windows of the other groups form short stretches of text; stretches
that are equal are merged in the map tasks, so a passage that a third of all
texts share sends one stretch per task.

Each task then sorts the suffixes at the window starts of its stretches in two
stages: those smaller than their successor (and the last of a stretch) are
sorted directly; the rest are induced by a scan over the buckets of first bytes.
Adjacent common prefixes of ``size`` bytes or more mark equal windows; all but
the earliest of them go.

Texts equal to an earlier text go as a whole (if they hold a window) and take no
part. Defined results: a null text has no bytes; texts shorter than ``size``
lose nothing; overlapping matches count; texts of any length are read whole;
rows that repeat a doc_id with its text get one decision; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import BUCKET_MB, input_mb, materialize, maybe_broadcast, mix, read_table, release, spread_join, spread_out, trimmed

SIZE, GRAM = 100, 48
#: An anchor is hot from so many places on, or so many a MB of input if that is more:
#: a text of n bytes has n / 27 anchors, so at most about 50,000 anchors are hot.
HOT, HOT_PER_MB = 2000, 2
#: Texts held at once, and bytes of distinct stretches held before they are sent.
SLICE, HELD = 2000, 16_000_000
#: Bytes hashed at once; longer texts are taken in overlapping parts.
PART = 1 << 20
_rng = np.random.default_rng(7_100_048)
BYTE_VALUES = _rng.integers(0, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
LOW = np.uint64((1 << 24) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Winnower:
    """Anchors of the windows of a buffer of texts."""

    def __init__(self, size: int = SIZE, gram: int = GRAM) -> None:
        self.size, self.gram, self.room = size, gram, size - gram + 1
        self.up = self.down = np.zeros(0, np.uint64)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """64-bit hash of the k-gram at each place."""
        n = len(data)
        if len(self.up) <= n:
            self.up, self.down = _powers(BASE, n + 1), _powers(BASE_INVERSE, n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[data] * self.up[:n])])
        return mix((sums[self.gram :] - sums[: -self.gram]) * self.down[: n - self.gram + 1])

    def owners(self, h: np.ndarray) -> np.ndarray:
        """For each window start the place of its anchor: the smallest hash, the last of equals."""
        places = np.arange(len(h), dtype=np.uint64)
        low = (h & ~LOW) | (LOW - places)
        width = 1
        while 2 * width <= self.room:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = self.room - width
        if rest:
            low = np.minimum(low[:-rest], low[rest:])
        return (LOW - (low & LOW)).astype(np.int64)

    def anchors(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, hash, anchor place, first window, last window) of every anchor, places within the text."""
        buffer: list[tuple[int, int, bytes]] = []
        held = 0
        for i, text in enumerate(texts):
            for at in range(0, max(1, len(text) - self.size + 1), PART):
                part = text[at : at + PART + self.size - 1]
                if len(part) < self.size:
                    continue
                buffer.append((i, at, part))
                held += len(part)
                if held >= PART:
                    yield from self._flush(buffer)
                    buffer, held = [], 0
        if buffer:
            yield from self._flush(buffer)

    def _flush(self, buffer):
        data = np.frombuffer(b"".join(p for _, _, p in buffer), np.uint8)
        h = self.hashes(data)
        own = self.owners(h)
        begin = 0
        for i, at, part in buffer:
            mine = own[begin : begin + len(part) - self.size + 1]
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            last = np.append(first[1:], len(mine)) - 1
            place = mine[first]
            yield i, h[place], place - begin + at, first + at, last + at
            begin += len(part)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, print and sha256 of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], ["doc_id", "n_bytes", "text_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, text_sha256 string")


def _deal(keys: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple]:
    bucket = ((keys >> np.uint64(17)) % np.uint64(n)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    for b, lo, hi in zip(found, first, [*first[1:], len(keys)]):
        yield (int(b), *(c[order[lo:hi]].tobytes() for c in columns))


def repeated_anchors(docs: DataFrame, n_buckets: int, hot: int, size: int, gram: int, mb: float) -> DataFrame:
    """doc_id and packed places of the anchors whose hash comes twice or more; in rows of doc_id -1, the hot hashes.

    A hash that comes more than once in a batch sends its count alone, so a
    passage that a third of all texts share sends a row per batch.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Winnower(size, gram)
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text")]
            hashes, docs_, places = [], [], []
            for i, h, place, _, _ in w.anchors(texts):
                hashes.append(h)
                places.append(place.astype(np.uint32))
                docs_.append(np.full(len(h), ids[i], np.int64))
            if not hashes:
                continue
            h, doc, place = np.concatenate(hashes), np.concatenate(docs_), np.concatenate(places)
            found, at, n = np.unique(h, return_inverse=True, return_counts=True)
            one, many = n[at] == 1, n > 1
            alone = _deal(h[one], n_buckets, h[one], doc[one], place[one], np.ones(one.sum(), np.uint32))
            counts = _deal(found[many], n_buckets, found[many], np.full(many.sum(), -1, np.int64), np.zeros(many.sum(), np.uint32), n[many].astype(np.uint32))
            rows = [*alone, *counts, (-1, b"", doc[~one].tobytes(), place[~one].tobytes(), b"")]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", "h", "doc", "place", "n"])

    def by_doc(doc: np.ndarray, place: np.ndarray) -> pd.DataFrame:
        order = np.argsort(doc, kind="stable")
        doc, place = doc[order], place[order]
        found, first = np.unique(doc, return_index=True)
        return pd.DataFrame({"doc_id": found, "places": [place[a:b].tobytes() for a, b in zip(first, [*first[1:], len(doc)])]})

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h, doc, place, n = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("h", np.uint64), ("doc", np.int64), ("place", np.uint32), ("n", np.uint32)))
        found, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, n, len(found))
        hit = (total[at] > 1) & (doc >= 0)
        heavy = pd.DataFrame({"doc_id": [-1], "places": [found[total > hot].tobytes()]})
        return pd.concat([by_doc(doc[hit], place[hit]), heavy])

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield by_doc(np.frombuffer(b"".join(pdf["doc"]), np.int64), np.frombuffer(b"".join(pdf["place"]), np.uint32))

    packed = materialize(docs.mapInArrow(trimmed(emit), "bucket int, h binary, doc binary, place binary, n binary"), "packed-anchors")
    out = spread_out(packed.filter("bucket >= 0"), mb, "bucket").groupBy("bucket").applyInPandas(meet, "doc_id long, places binary").union(packed.filter("bucket < 0").mapInPandas(local, "doc_id long, places binary"))
    out = materialize(out, "anchors")
    release(packed)
    return out


CUTS = "bucket int, doc binary, start binary, length binary, owned binary, bytes binary"


def _cut_rows(doc: list, start: list, owned: list) -> tuple:
    return (-1, np.array(doc, np.int64).tobytes(), np.array(start, np.int64).tobytes(), b"", np.array(owned, np.int32).tobytes(), b"")


class Stretches:
    """Distinct stretches with their earliest (doc, start); later ones are cuts at once."""

    def __init__(self) -> None:
        self.first: dict[tuple[bytes, int], tuple[int, int]] = {}
        self.doc: list[int] = []
        self.start: list[int] = []
        self.owned: list[int] = []
        self.bytes = 0

    def add(self, text: bytes, owned: int, doc: int, start: int) -> None:
        key, at = (text, owned), (doc, start)
        old = self.first.get(key)
        if old is None:
            self.first[key] = at
            self.bytes += len(text) + 200
            return
        if at < old:
            self.first[key], at = at, old
        if at != self.first[key]:
            self.doc.append(at[0])
            self.start.append(at[1])
            self.owned.append(owned)


def stretches(docs: DataFrame, anchors: DataFrame, hot: np.ndarray, n_buckets: int, size: int, gram: int) -> DataFrame:
    """Packed stretches by bucket of their anchor; bucket -1 holds windows that are cuts already.

    Windows of a hot anchor are dealt one by one, by their own hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Winnower(size, gram)
        held = Stretches()
        keys: dict[tuple[bytes, int], int] = {}

        def flush():
            rows = [_cut_rows(held.doc, held.start, held.owned)] if held.doc else []
            by: dict[int, list] = {}
            for key, at in held.first.items():
                by.setdefault((keys[key] >> 17) % n_buckets, []).append((key, at))
            for b, items in by.items():
                rows.append((b, np.array([a[0] for _, a in items], np.int64).tobytes(), np.array([a[1] for _, a in items], np.int64).tobytes(), np.array([len(k[0]) for k, _ in items], np.int32).tobytes(), np.array([k[1] for k, _ in items], np.int32).tobytes(), b"".join(k[0] for k, _ in items)))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "doc", "start", "length", "owned", "bytes"])

        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text")]
            wanted = [np.sort(np.frombuffer(b"".join(p), np.uint32)) for p in batch.column("places").to_pylist()]
            for i, h, place, first, last in w.anchors(texts):
                hit = np.isin(place.astype(np.uint32), wanted[i])
                heavy = np.isin(h, hot) & hit
                for a, b in zip(first[heavy].tolist(), last[heavy].tolist()):
                    for s in range(a, b + 1):
                        text = texts[i][s : s + size]
                        held.add(text, 1, ids[i], s)
                        keys[text, 1] = xxhash.xxh64_intdigest(text)
                hit &= ~heavy
                for key, a, b in zip(h[hit].tolist(), first[hit].tolist(), last[hit].tolist()):
                    text = texts[i][a : b + size]
                    held.add(text, b - a + 1, ids[i], a)
                    keys[text, b - a + 1] = key
            if held.bytes > HELD:
                yield from flush()
                held = Stretches()
                keys.clear()
        yield from flush()

    grouped = anchors.groupBy("doc_id").agg(F.collect_list("places").alias("places"))
    rows = docs.join(grouped.hint("merge"), "doc_id").select("doc_id", "text", "places")
    return rows.mapInArrow(trimmed(run), CUTS)


def suffix_order(text: bytes, starts: list[int], ends: list[int], size: int) -> list[int]:
    """The window starts of all stretches in the order of their suffixes' first ``size`` bytes.

    ``starts[i]:ends[i]`` are the window starts of stretch i. Stage one sorts
    directly the suffixes smaller than their successor, and the last of each
    stretch; stage two scans the buckets of first bytes and places each larger
    one when its successor is met.
    """
    data = np.frombuffer(text, np.uint8)
    greater = np.zeros(len(text) + 1, bool)  # larger than its successor: induced
    follow = np.flatnonzero(data[1:] != data[:-1])
    nxt = np.searchsorted(follow, np.arange(len(text) - 1)) if len(text) > 1 else np.zeros(0, int)
    known = nxt < len(follow)
    j = follow[np.minimum(nxt, max(0, len(follow) - 1))] if len(follow) else nxt
    if len(follow):
        # equal bytes up to j, where the text falls or rises: the sign there decides, if within the first ``size`` bytes
        falls = data[j] > data[j + 1]
        near = j - np.arange(len(text) - 1) < size - 1
        greater[: len(text) - 1] = known & falls & near
    induced = np.zeros(len(text) + 1, bool)
    direct: list[int] = []
    for a, b in zip(starts, ends):
        induced[a : b - 1] = greater[a : b - 1]
        direct.extend((np.flatnonzero(~induced[a:b]) + a).tolist())
    direct.sort(key=lambda i: text[i : i + size])
    flags, larger = induced.tolist(), greater.tolist()
    heads: list[list[int]] = [[] for _ in range(256)]  # larger than their successor: these come first in a bucket
    ends_: list[list[int]] = [[] for _ in range(256)]  # as those, but the last of a stretch and so sorted directly
    tails: list[list[int]] = [[] for _ in range(256)]
    for i in direct:
        (ends_ if larger[i] else tails)[text[i]].append(i)
    order: list[int] = []
    for c in range(256):
        head, end = heads[c], ends_[c]
        at = k = 0
        while at < len(head) or k < len(end):  # head grows while it is scanned: runs of one byte induce in their own bucket
            if k == len(end) or (at < len(head) and text[head[at] : head[at] + size] <= text[end[k] : end[k] + size]):
                i = head[at]
                at += 1
            else:
                i = end[k]
                k += 1
            order.append(i)
            if i and flags[i - 1]:
                heads[text[i - 1]].append(i - 1)
        for i in tails[c]:
            order.append(i)
            if i and flags[i - 1]:
                heads[text[i - 1]].append(i - 1)
    return order


def later_windows(text: bytes, starts: list[int], ends: list[int], at: np.ndarray, size: int) -> list[int]:
    """Window starts equal to an earlier window; ``at`` orders the starts by (doc, place)."""
    order = suffix_order(text, starts, ends, size)
    out: list[int] = []
    run = order[:1]
    for i, j in zip(order, order[1:]):
        if text[i : i + size] == text[j : j + size]:  # adjacent common prefix of ``size`` or more
            run.append(j)
            continue
        if len(run) > 1:
            keep = min(run, key=at.__getitem__)
            out += [x for x in run if x != keep]
        run = [j]
    if len(run) > 1:
        keep = min(run, key=at.__getitem__)
        out += [x for x in run if x != keep]
    return out


def sorted_cuts(packed: DataFrame, size: int, mb: float) -> DataFrame:
    """Per bucket: merge equal stretches, sort the suffixes, emit the later windows (doc_id, packed starts)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        held = Stretches()
        for doc, start, length, owned, text in zip(pdf["doc"], pdf["start"], pdf["length"], pdf["owned"], pdf["bytes"]):
            doc, start, length, owned = np.frombuffer(doc, np.int64), np.frombuffer(start, np.int64), np.frombuffer(length, np.int32), np.frombuffer(owned, np.int32)
            offset = 0
            for d, s, n, o in zip(doc.tolist(), start.tolist(), length.tolist(), owned.tolist()):
                held.add(text[offset : offset + n], o, d, s)
                offset += n
        items = list(held.first.items())
        text = b"".join(k[0] for k, _ in items)
        starts, ends, offset = [], [], 0
        docs_, places = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        for (t, o), (d, s) in items:
            starts.append(offset)
            ends.append(offset + o)
            docs_[offset : offset + o] = d
            places[offset : offset + o] = np.arange(s, s + o)
            offset += len(t)
        at = np.empty(len(text), np.int64)
        at[np.lexsort((places, docs_))] = np.arange(len(text))
        cut = np.array(later_windows(text, starts, ends, at, size), np.int64)
        doc = np.concatenate([docs_[cut], np.repeat(np.array(held.doc, np.int64), held.owned)])
        place = np.concatenate([places[cut], *(np.arange(s, s + o) for s, o in zip(held.start, held.owned))]) if held.doc else places[cut]
        return _by_doc(doc, place)

    def early(key, pdf: pd.DataFrame) -> pd.DataFrame:
        doc, start, owned = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("doc", np.int64), ("start", np.int64), ("owned", np.int32)))
        return _by_doc(np.repeat(doc, owned), np.concatenate([np.arange(s, s + o) for s, o in zip(start.tolist(), owned.tolist())]))

    sorted_ = spread_out(packed.filter("bucket >= 0"), mb, "bucket").groupBy("bucket").applyInPandas(run, "doc_id long, starts binary")
    at_once = packed.filter("bucket < 0").withColumn("part", F.spark_partition_id()).mapInPandas(lambda frames: (early(None, f) for f in frames if len(f)), "doc_id long, starts binary")
    return sorted_.union(at_once)


def _by_doc(doc: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """Window starts per document, as packed (first, last) runs."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order].astype(np.int64)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)]) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    runs = np.stack([place[first], place[last]], 1) if len(doc) else np.zeros((0, 2), np.int64)
    ids, at = np.unique(doc[first], return_index=True) if len(doc) else (doc, first)
    return pd.DataFrame({"doc_id": ids, "starts": [runs[a:b].tobytes() for a, b in zip(at, [*at[1:], len(first)])]})


def removed(runs: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal removed (start, end) of a text from (first, last) runs of window starts."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, runs.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + size)
        else:
            out.append([a, b + size])
    return [(a, b) for a, b in out]


def cut_texts(docs: DataFrame, cuts: DataFrame, size: int) -> DataFrame:
    """doc_id, n_removed, n_spans, kept_sha256, kept (the bytes left) of the texts with cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts in zip(batch.column("text"), batch.column("starts").to_pylist()):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                gone = removed(np.frombuffer(b"".join(starts), np.int64).reshape(-1, 2), size)
                kept, at = [], 0
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                rows.append((sum(b - a for a, b in gone), len(gone), hashlib.sha256(b"".join(kept)).hexdigest()))
            n, spans, sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_removed", "n_spans", "kept_sha256"])

    grouped = cuts.groupBy("doc_id").agg(F.collect_list("starts").alias("starts"))
    return docs.join(grouped.hint("merge"), "doc_id").select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, n_removed long, n_spans long, kept_sha256 string")


def suffix_dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    mb = input_mb(docs)
    seen = materialize(prints(docs), "texts")
    firsts = materialize(seen.groupBy("text_sha256").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "first-ids")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = spread_join(seen, firsts, ["text_sha256"], F.col("doc_id"), "n", total)
    texts = materialize(dealt.select("doc_id", "n_bytes", "text_sha256", (F.col("doc_id") > F.col("first")).alias("copy")), "first-texts")
    release(firsts)
    release(seen)
    copies = texts.filter("copy").select("doc_id").distinct()
    own = docs.join(maybe_broadcast(copies), "doc_id", "left_anti")
    anchors = repeated_anchors(own, max(24, int(1.5 * mb / BUCKET_MB) + 1), max(HOT, int(HOT_PER_MB * mb)), size, gram, mb)
    heavy = [np.frombuffer(r[0], np.uint64) for r in anchors.filter("doc_id < 0 and length(places) > 0").select("places").collect()]
    hot = np.unique(np.concatenate(heavy)) if heavy else np.zeros(0, np.uint64)
    packed = materialize(stretches(own, anchors.filter("doc_id >= 0"), hot, max(48, int(2 * mb) + 1), size, gram), "stretches")
    cuts = materialize(sorted_cuts(packed, size, mb), "cuts")
    release(anchors, packed)
    done = materialize(cut_texts(own, cuts, size).dropDuplicates(["doc_id"]), "cut-texts")
    release(cuts)
    gone = F.col("copy") & (F.col("n_bytes") >= size)
    empty = hashlib.sha256(b"").hexdigest()
    return texts.join(done, "doc_id", "left").select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "text_sha256")).alias("kept_sha256"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"))
