"""Language-model scores from a weighted backoff automaton.

All training documents are counted: every word and every pair of words. The
bigrams are smoothed by absolute discounting (interpolated, so each state's arcs
and its failure arc share one unit of probability) and become an automaton: a
state per word, an arc per pair seen in training, a failure arc with the backoff
weight to the root, whose weights are those of the base score.

The automaton is held in parts that grow with the input. A text's score is its
base score, plus the failure weight of each state on its way, plus for each arc
taken what it has over the failure arc and the root; so every part is summed
where its counts meet, and a text gets back one sum from each:

- pairs with a rare word meet in the bucket of that word (64-bit hashes stand for
  words), which knows the word's count;
- pairs with a rare state meet in the bucket of the state, which knows all its
  arcs; the counts of rare words come from their buckets;
- other pairs meet in the bucket of the pair.

Words and pairs so frequent that they would overfill a bucket are broadcast with
their exact counts instead, VOCABULARY words and MAX_NGRAMS pairs at most. That
is a matter of routing: scores are the same for any values of the two.

Defined results: a null or empty text is its end alone; repeated rows are scored
and counted each; an empty table gives no rows; whole texts of any length are
read; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import WordHashes, input_mb, lower_words, materialize, mix, read_table, release, spread_out, trimmed

#: Frequent words and pairs that are broadcast, at most; all others are joined by bucket.
VOCABULARY, MAX_NGRAMS = 60_000, 2_000_000
#: Pairs below the count are not broadcast.
DISCOUNT, MIN_COUNT = 0.75, 2
RARE, START = 65_534, 65_535  # ids of words that are not broadcast and of the state before the first word
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word holds a line end
CHUNK_TOKENS, SCORED_TOKENS = 1_500_000, 400_000
BUCKET_MB = 6
#: Words whose hashes a task remembers.
MEMO = 400_000


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


class Tokens(NamedTuple):
    """A batch of texts: doc ids, row ids, held-out flags, tokens per text (end included), their hashes."""

    ids: np.ndarray
    rows: np.ndarray
    held: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray


def tokens(batches: Iterator[pa.RecordBatch], most: int = CHUNK_TOKENS) -> Iterator[Tokens]:
    """Texts in chunks of about ``most`` tokens; a longer text is a chunk of its own."""
    memo = WordHashes()
    memo.limit = MEMO
    ids, rows, parts, n = [], [], [], 0
    for batch in batches:
        of_row = batch.column("row" if "row" in batch.schema.names else "doc_id").to_pylist()
        for doc, row, text in zip(batch.column("doc_id").to_pylist(), of_row, batch.column("text")):
            words = lower_words(text.as_py())
            h = np.empty(len(words) + 1, np.uint64)
            h[:-1] = memo.of(words)
            h[-1] = END
            ids.append(doc)
            rows.append(row)
            parts.append(h)
            n += len(h)
            if n >= most:
                yield _chunk(ids, rows, parts)
                ids, rows, parts, n = [], [], [], 0
    if ids:
        yield _chunk(ids, rows, parts)


def _chunk(ids: list, rows: list, parts: list[np.ndarray]) -> Tokens:
    return Tokens(np.array(ids, np.int64), np.array(rows, np.int64), np.array([held_out(i) for i in ids]), np.array([len(p) for p in parts]), np.concatenate(parts))


def _packed(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, bytes of each column) for each bucket that has rows."""
    order = np.argsort(bucket, kind="stable")
    columns = tuple(c[order] for c in columns)
    found, first = np.unique(bucket[order], return_index=True)
    for b, lo, hi in zip(found, first, [*first[1:], len(bucket)]):
        yield (int(b), *(c[lo:hi].tobytes() for c in columns))


PACKED = "kind string, bucket int, a binary, b binary, c binary, d binary"


def _batch(kind: str, row: tuple) -> pa.RecordBatch:
    bucket, *columns = row
    columns += [None] * (4 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([bucket], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)], ["kind", "bucket", "a", "b", "c", "d"])


def _frame(kind: str, rows: Iterator[tuple]) -> pd.DataFrame:
    rows = [(kind, *row, *[None] * (5 - len(row))) for row in rows]
    return pd.DataFrame(rows, columns=["kind", "bucket", "a", "b", "c", "d"])


def _distinct(*keys: np.ndarray) -> tuple:
    """The distinct rows of ``keys`` in order, and how often each comes."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.nonzero(new)[0]
    return (*(k[first] for k in keys), np.diff(np.append(first, len(order))))


def _joined(column: pd.Series, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype)


def _buckets(mb: float) -> int:
    return max(12, int(mb / BUCKET_MB) + 1)


def _bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(n)).astype(np.int32)


def count_words(docs: DataFrame, mb: float) -> DataFrame:
    """Per bucket: hashes, occurrences in all texts, occurrences in training texts."""
    n = _buckets(0.5 * mb)

    def run(batches):
        for t in tokens(batches):
            train = np.repeat(~t.held, t.lengths)
            h, at = np.unique(t.hashes, return_inverse=True)
            total = np.bincount(at, minlength=len(h)).astype(np.uint32)
            seen = np.bincount(at[train], minlength=len(h)).astype(np.uint32)
            for row in _packed(_bucket_of(h, n), h, total, seen):
                yield _batch("word", row)

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h, at = np.unique(_joined(pdf["a"], np.uint64), return_inverse=True)
        total = np.bincount(at, _joined(pdf["b"], np.uint32), len(h)).astype(np.int64)
        seen = np.bincount(at, _joined(pdf["c"], np.uint32), len(h)).astype(np.int64)
        steps = np.bincount((8 * np.log2(total)).astype(int), minlength=512)[:512]
        return pd.DataFrame([(key[0], h.tobytes(), total.tobytes(), seen.tobytes(), int(seen.sum()), int((seen > 0).sum()), int(seen[h == END].sum()), steps.tolist())], columns=["bucket", "a", "b", "c", "n", "v", "ends", "steps"])

    packed = docs.select("doc_id", "text").mapInArrow(trimmed(run), PACKED)
    return spread_out(packed, 0.6 * mb, "bucket").groupBy("bucket").applyInPandas(merge, "bucket int, a binary, b binary, c binary, n long, v long, ends long, steps array<long>")


class Head(NamedTuple):
    """The vocabulary: sorted hashes, training counts; tokens and types of the training texts."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), RARE, np.uint16)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, RARE).astype(np.uint16)


def head_of(words: DataFrame, vocabulary: int) -> Head:
    """The words over the lowest count step that ``vocabulary`` words reach at most."""
    steps = words.select(F.posexplode("steps").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
    n_types = np.zeros(512, np.int64)
    for r in steps:
        n_types[r["i"]] = r["n"]
    above = np.cumsum(n_types[::-1])[::-1]
    fits = np.nonzero(above <= vocabulary)[0]
    step = int(fits[0]) if len(fits) else 512

    def top(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h, total, seen = (_joined(pdf[c], t) for c, t in (("a", np.uint64), ("b", np.int64), ("c", np.int64)))
        keep = (8 * np.log2(total)).astype(int) >= step
        return pd.DataFrame({"h": h[keep].view(np.int64), "c": seen[keep]})

    rows = words.groupBy("bucket").applyInPandas(top, "h long, c long").toPandas()  # ``vocabulary`` rows at most
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    sums = words.agg(F.sum("n"), F.sum("v")).first()
    return Head(h[order], rows["c"].to_numpy(np.int64)[order], sums[0] or 0, sums[1] or 0)


def _pair_of(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit ids of arcs."""
    return mix(mix(state) ^ word)


def _before(t: Tokens, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first token of each text; the state before each token."""
    starts = np.cumsum(t.lengths) - t.lengths
    before = np.concatenate([[START], ids[:-1]]).astype(np.uint32)
    before[starts] = START
    return starts, before


def exchange(docs: DataFrame, head: Head, mb: float) -> DataFrame:
    """Packed counts of the training texts: pairs of frequent words, and by rare word the states before it."""
    n_pairs, n_rare = _buckets(1.2 * mb), _buckets(0.5 * mb)

    def run(batches):
        for t in tokens(batches):
            ids = head.ids(t.hashes)
            _, before = _before(t, ids)
            train = np.repeat(~t.held, t.lengths)
            rare = train & (ids == RARE)
            pairs, n = np.unique((before << np.uint32(16) | ids)[train & (ids != RARE) & (before != RARE)], return_counts=True)
            for row in _packed(((pairs >> np.uint32(16)) % np.uint32(n_pairs)).astype(np.int32), pairs, n.astype(np.uint32)):
                yield _batch("pair", row)
            h, state, n = _distinct(t.hashes[rare], before[rare].astype(np.uint16))
            for row in _packed(_bucket_of(h, n_rare), h, state, n.astype(np.uint32)):
                yield _batch("tail", row)
            at = np.nonzero(rare & (before == RARE))[0]
            h, state, _ = _distinct(t.hashes[at], t.hashes[at - 1])
            for row in _packed(_bucket_of(h, n_rare), h, state):
                yield _batch("arc", row)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), PACKED)


def rare_arcs(packed: DataFrame, mb: float) -> DataFrame:
    """Kind arc, by the bucket of the state: rare state, rare word, the word's count. Kind types: frequent states, rare words after each."""
    n_rare = _buckets(0.5 * mb)

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        tail, arc = pdf[pdf["kind"] == "tail"], pdf[pdf["kind"] == "arc"]
        h, state, n = (_joined(tail[c], t) for c, t in (("a", np.uint64), ("b", np.uint16), ("c", np.uint32)))
        words, at = np.unique(h, return_inverse=True)
        count = np.bincount(at, n, len(words)).astype(np.int64)
        _, state, _ = _distinct(h, state)
        state, n = np.unique(state[state != RARE], return_counts=True)
        h, before, _ = _distinct(_joined(arc["a"], np.uint64), _joined(arc["b"], np.uint64))
        arcs = _packed(_bucket_of(before, n_rare), before, h, count[np.searchsorted(words, h)])
        return pd.concat([_frame("types", [(0, state.tobytes(), n.astype(np.int64).tobytes())]), _frame("arc", arcs)])

    return spread_out(packed.filter("kind in ('tail', 'arc')"), mb, "bucket").groupBy("bucket").applyInPandas(merge, PACKED)


def types_of(*parts: DataFrame) -> np.ndarray:
    """Distinct words after each frequent state, from packed (a: states, b: numbers)."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65_536, np.int64)
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b")):
                np.add.at(total, np.frombuffer(a.as_py(), np.uint16), np.frombuffer(b.as_py(), np.int64))
        state = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(state.astype(np.int32)), pa.array(total[state])], ["state", "n"])

    out = np.zeros(65_536, np.int64)
    for part in parts:
        for r in part.select("a", "b").mapInArrow(flat, "state int, n long").groupBy("state").agg(F.sum("n").alias("n")).collect():  # a row per frequent state
            out[r["state"]] += r["n"]
    return out


class Automaton(NamedTuple):
    """The frequent part. Arcs sorted by (state, word) with their log10 weights; failure weight of each state; root weights; tokens of each state."""

    arcs: np.ndarray
    weights: np.ndarray
    failure: np.ndarray
    root: np.ndarray
    of_state: np.ndarray

    def over(self, arc: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What ``weight`` has over the failure arc and the root."""
        return weight - self.failure[arc >> np.uint32(16)] - self.root[arc & np.uint32(65_535)]

    def taken(self, arc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``arc`` are held, and what those have over the failure arc and the root."""
        if not len(self.arcs):
            return np.zeros(len(arc), bool), np.zeros(0)
        at = np.minimum(np.searchsorted(self.arcs, arc), len(self.arcs) - 1)
        hit = self.arcs[at] == arc
        return hit, self.over(arc[hit], self.weights[at[hit]])


def build(packed: DataFrame, arcs: DataFrame, head: Head, n_train: int, max_ngrams: int = MAX_NGRAMS) -> Automaton:
    """Broadcast the bigrams that fit: the lowest count (MIN_COUNT or more) that ``max_ngrams`` arcs reach. All bigrams count for the failure weights."""

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pairs, at = np.unique(_joined(pdf["a"], np.uint32), return_inverse=True)
        n = np.bincount(at, _joined(pdf["b"], np.uint32), len(pairs)).astype(np.int64)
        keep = n >= MIN_COUNT
        steps = np.bincount((8 * np.log2(n[keep])).astype(int), minlength=512)[:512]
        state, types = np.unique((pairs >> np.uint32(16)).astype(np.uint16), return_counts=True)
        return pd.DataFrame([(pairs[keep].tobytes(), n[keep].tobytes(), steps.tolist(), state.tobytes(), types.astype(np.int64).tobytes())], columns=["a", "b", "steps", "states", "types"])

    merged = materialize(packed.filter("kind = 'pair'").groupBy("bucket").applyInPandas(merge, "a binary, b binary, steps array<long>, states binary, types binary"), "bigrams")
    n_arcs = np.zeros(512, np.int64)
    for r in merged.select(F.posexplode("steps").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
        n_arcs[r["i"]] = r["n"]
    above = np.cumsum(n_arcs[::-1])[::-1]
    step = int(np.nonzero(above <= max_ngrams)[0][0])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b")):
                pairs, n = np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.int64)
                keep = (8 * np.log2(n)).astype(int) >= step
                yield pa.RecordBatch.from_arrays([pa.array(pairs[keep].astype(np.int64)), pa.array(n[keep])], ["pair", "n"])

    rows = merged.select("a", "b").mapInArrow(top, "pair long, n long").toArrow()  # ``max_ngrams`` rows at most
    types = types_of(merged.select(F.col("states").alias("a"), F.col("types").alias("b")), arcs.filter("kind = 'types'"))
    release(merged)
    pairs, n = rows["pair"].to_numpy().astype(np.uint32), rows["n"].to_numpy().astype(np.float64)
    order = np.argsort(pairs)
    return smooth(pairs[order], n[order], head, n_train, types)


def smooth(pairs: np.ndarray, n: np.ndarray, head: Head, n_train: int, types: np.ndarray | None = None) -> Automaton:
    """Interpolated absolute discounting; what the arcs of a state leave goes to its failure arc.

    ``types``: distinct words after each state; without it, ``pairs`` holds all arcs.
    """
    root_p = np.zeros(65_536)
    root_p[: len(head.counts)] = head.counts
    root_p = (root_p + 0.5) / (head.tokens + 0.5 * (head.types + 1))  # all that is unseen shares one half
    of_state = np.zeros(65_536)
    of_state[: len(head.counts)] = head.counts
    of_state[START] = n_train
    state = pairs >> np.uint32(16)
    if types is None:
        left = 1 - np.bincount(state, n - DISCOUNT, 65_536) / np.maximum(of_state, 1)
    else:
        left = DISCOUNT * types / np.maximum(of_state, 1)
    left = np.where((of_state > 0) & (left > 0), left, 1.0)
    weights = np.log10((n - DISCOUNT) / np.maximum(of_state[state], 1) + left[state] * root_p[pairs & np.uint32(65_535)])
    return Automaton(pairs, weights, np.log10(left), np.log10(root_p), of_state)


def route(docs: DataFrame, head: Head, automaton: Automaton, mb: float) -> DataFrame:
    """Texts (kind doc) and what the frequent part says of them (sum), by row; all else by the bucket where its counts meet (tail, state, pair)."""
    n_docs, n_pairs, n_rare = _buckets(2 * mb), _buckets(1.5 * mb), _buckets(0.5 * mb)

    def run(batches):
        logs = np.zeros(65_536)
        logs[: len(head.counts)] = np.log10(head.counts + 0.5)
        known = np.zeros(65_536, np.int32)
        known[: len(head.counts)] = head.counts > 0
        for t in tokens(batches, SCORED_TOKENS):
            ids = head.ids(t.hashes)
            starts, before = _before(t, ids)
            doc = np.repeat(np.arange(len(t.ids)), t.lengths)
            arc = before << np.uint32(16) | ids
            gain = automaton.failure[before]
            frequent = np.nonzero((ids != RARE) & (before != RARE))[0]
            hit, over = automaton.taken(arc[frequent])
            gain[frequent[hit]] += over
            add = lambda x: np.add.reduceat(x, starts)
            of_row = _bucket_of(mix(t.rows.view(np.uint64)), n_docs)
            for row in _packed(of_row, t.rows, t.ids, t.lengths.astype(np.int64) << 1 | t.held):
                yield _batch("doc", row)
            for row in _packed(of_row, t.rows, add(gain), add(logs[ids]), add(known[ids]).astype(np.int32)):
                yield _batch("sum", row)
            rest = frequent[~hit]
            key, n = np.unique(arc[rest].astype(np.uint64) << np.uint64(32) | doc[rest].astype(np.uint64), return_counts=True)
            pair, at = (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            for row in _packed(_bucket_of(mix(pair.astype(np.uint64)), n_pairs), pair, t.rows[at], _seen(n, t.held[at])):
                yield _batch("pair", row)
            rest = np.nonzero(ids == RARE)[0]
            h, state, at, n = _distinct(t.hashes[rest], before[rest].astype(np.uint16), doc[rest])
            for row in _packed(_bucket_of(h, n_rare), h, state, t.rows[at], _seen(n, t.held[at])):
                yield _batch("tail", row)
            rest = np.nonzero(before == RARE)[0]
            state, h, at, n = _distinct(t.hashes[rest - 1], t.hashes[rest], doc[rest])
            for row in _packed(_bucket_of(state, n_rare), state, h, t.rows[at], _seen(n, t.held[at])):
                yield _batch("state", row)

    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(trimmed(run), PACKED)


def _seen(n: np.ndarray, held: np.ndarray) -> np.ndarray:
    return n.astype(np.uint32) << np.uint32(1) | held.astype(np.uint32)


def bucket_sums(routed: DataFrame, arcs: DataFrame, head: Head, automaton: Automaton, mb: float) -> DataFrame:
    """Kinds doc and sum by row: what each bucket's counts add to the rows."""
    n_docs = _buckets(2 * mb)
    norm = np.log10(head.tokens + 0.5 * (head.types + 1))
    automaton = automaton._replace(arcs=automaton.arcs[:0], weights=automaton.weights[:0])  # what the buckets don't read stays here

    def counted(key: np.ndarray, c: pd.Series) -> tuple:
        """Distinct keys with their training counts; of each row its place among them and its count."""
        found, at = np.unique(key, return_inverse=True)
        c = _joined(c, np.uint32)
        tf, held = (c >> np.uint32(1)).astype(np.int64), (c & np.uint32(1)).astype(bool)
        return found, np.bincount(at[~held], tf[~held], len(found)), at, tf

    def pairs(pdf: pd.DataFrame) -> tuple:
        arc, count, at, tf = counted(_joined(pdf["a"], np.uint32), pdf["c"])
        left, root = automaton.failure[arc >> np.uint32(16)], automaton.root[arc & np.uint32(65_535)]
        p = np.maximum(count - DISCOUNT, 0) / np.maximum(automaton.of_state[arc >> np.uint32(16)], 1) + 10 ** (left + root)
        return _joined(pdf["b"], np.int64), tf * np.where(count > 0, np.log10(p) - left - root, 0.0)[at], None, None

    def tails(pdf: pd.DataFrame) -> tuple:
        h, state = _joined(pdf["a"], np.uint64), _joined(pdf["b"], np.uint16)
        _, of_word, word, tf = counted(h, pdf["d"])
        _, of_arc, arc, _ = counted(_pair_of(state.astype(np.uint64), h), pdf["d"])
        c, n = of_arc[arc], of_word[word]
        left, root = automaton.failure[state], np.log10(n + 0.5) - norm
        p = np.maximum(c - DISCOUNT, 0) / np.maximum(automaton.of_state[state], 1) + 10 ** (left + root)
        gain = np.where((c > 0) & (state != RARE), np.log10(p) - left - root, 0.0)
        return _joined(pdf["c"], np.int64), tf * gain, tf * np.log10(n + 0.5), (tf * (n > 0)).astype(np.int32)

    def states(pdf: pd.DataFrame, arcs: pd.DataFrame) -> tuple:
        state, h = _joined(pdf["a"], np.uint64), _joined(pdf["b"], np.uint64)
        _, of_state, s, tf = counted(state, pdf["d"])
        keys, of_arc, arc, _ = counted(_pair_of(state, h), pdf["d"])
        first = np.zeros(len(keys), np.int64)
        first[arc] = np.arange(len(arc))
        types = np.bincount(s[first[of_arc > 0]], minlength=len(of_state))
        left = np.where(of_state > 0, np.log10(np.maximum(DISCOUNT * types, DISCOUNT) / np.maximum(of_state, 1)), 0.0)
        ids = head.ids(h[first])
        root = automaton.root[ids]
        known = _pair_of(_joined(arcs["a"], np.uint64), _joined(arcs["b"], np.uint64))
        n = _joined(arcs["c"], np.int64)
        root[np.searchsorted(keys, known)] = np.log10(n + 0.5) - norm  # every arc of training texts is among the keys
        failed = left[s[first]]
        p = np.maximum(of_arc - DISCOUNT, 0) / np.maximum(of_state[s[first]], 1) + 10 ** (failed + root)
        gain = np.where(of_arc > 0, np.log10(p) - root, failed)
        return _joined(pdf["c"], np.int64), tf * gain[arc], None, None

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        kind = key[0]
        if kind in ("doc", "sum"):
            return pdf[["kind", "bucket", "a", "b", "c", "d"]]
        part = pdf[pdf["kind"] != "arc"]
        row, gain, logs, known = pairs(part) if kind == "pair" else tails(part) if kind == "tail" else states(part, pdf[pdf["kind"] == "arc"])
        rows, at = np.unique(row, return_inverse=True)
        columns = [rows, np.bincount(at, gain, len(rows))]
        columns += [] if logs is None else [np.bincount(at, logs, len(rows)), np.bincount(at, known, len(rows)).astype(np.int32)]
        return _frame("sum", _packed(_bucket_of(mix(rows.view(np.uint64)), n_docs), *columns))

    together = routed.unionByName(arcs.filter("kind = 'arc'")).withColumn("part", F.when(F.col("kind") == "arc", "state").otherwise(F.col("kind")))
    return spread_out(together, 2 * mb, "part", "bucket").groupBy("part", "bucket").applyInPandas(merge, PACKED)


def row_sums(sums: DataFrame, head: Head, mb: float) -> DataFrame:
    """The rows with all that was added to them."""
    norm = float(np.log10(head.tokens + 0.5 * (head.types + 1)))

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        doc, both = pdf[pdf["kind"] == "doc"], pdf[pdf["kind"] == "sum"]
        rows, ids, n = (_joined(doc[c], np.int64) for c in "abc")
        order = np.argsort(rows)
        rows, ids, held, n = rows[order], ids[order], (n[order] & 1).astype(bool), n[order] >> 1
        full = both[both["c"].notna()]
        place = lambda part: np.searchsorted(rows, _joined(part["a"], np.int64))
        total = lambda part, c, kind: np.bincount(place(part), _joined(part[c], kind), len(rows))
        base = total(full, "c", np.float64) - n * norm
        known = total(full, "d", np.int32).astype(np.int64)
        return pd.DataFrame({"doc_id": ids, "held_out": held, "n_tokens": n, "n_known": known, "base_score": base, "score": base + total(both, "b", np.float64)})

    return spread_out(sums, mb, "bucket").groupBy("bucket").applyInPandas(merge, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, vocabulary: int = VOCABULARY, max_ngrams: int = MAX_NGRAMS) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    mb = input_mb(docs)
    words = materialize(count_words(docs, mb), "words")
    head = head_of(words, min(vocabulary, RARE))
    n_train = words.agg(F.sum("ends")).first()[0] or 0  # every training text has one end
    release(words)
    packed = materialize(exchange(docs, head, mb), "lm-packed")
    arcs = materialize(rare_arcs(packed, mb), "lm-arcs")
    automaton = build(packed, arcs, head, n_train=n_train, max_ngrams=max_ngrams)
    release(packed)
    sums = bucket_sums(route(docs, head, automaton, mb), arcs, head, automaton, mb)
    return row_sums(sums, head, mb).withColumn("train_tokens", F.lit(head.tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
