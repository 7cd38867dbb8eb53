"""BPE encoding and decoding by a deterministic token automaton.

The merges of a vocabulary are compiled in rank order. Each merge (u, v) -> w is
a gadget: it adds an arc labelled w and bars the arc v after an arc u wherever
the gadget would have fired there first. Whether an arc may follow another
depends on the gadgets between the right edge of the first and the left edge of
the second alone. The gadgets are then compiled to a deterministic automaton over
the bytes of a word (``TokenAutomaton``): one transition a byte, no search and no
merge loop; the arcs of the path are read back from the states it went through.

The table is compiled once, in a task, for every label of the vocabulary and sent
to all workers. The full table of a 49k vocabulary has over 10**7 cells, nearly
all unused, so a word that leaves the compiled part adds the cells it needs.

The distinct fragments of a chunk of texts take their transitions together, a
numpy step for each byte position; ids are decoded by emitting the labels of
their arcs. Texts are normalized and split as the vocabulary's file says: NFC,
white space, lower case; contractions, letters, single digits, other runs.
Special tokens inside a text become their ids.

Defined results: a null or empty text has no ids; texts of any length are read
whole; rows that repeat are encoded each; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._shared import read_table, trimmed

END = "</w>"
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
WHITE = regex.compile(r"\p{White_Space}+")
CONTROLS = regex.compile(r"[\x1c-\x1f]")
#: States beyond the compiled ones that a worker keeps, characters of text taken at once.
TABLE, CHUNK_CHARS = 80_000, 700_000
#: Answers of ``may_follow`` and ``_same`` that are remembered from one chunk to the next.
ANSWERS = 100_000
#: Longer words are walked one by one: a numpy step a byte pays for many words only.
LONG = 128
#: Arcs below a node up to which the arcs that end there are told apart by what they bar alone.
MOST = 8


def byte_letters() -> list[str]:
    """A printable letter for every byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Cells:
    """Cells of a transition table, (state, byte) to a number: an open-addressing hash that numpy reads many at once."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of ``keys``; -1 where there is none."""
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        mask = len(self.keys) - 1
        while len(open_):
            slots[open_] = (slots[open_] + 1) & mask
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def put(self, key: int, value: int) -> None:
        if 2 * self.n >= len(self.keys):
            self.load(*self.items(), self.bits + 1)
        mask = len(self.keys) - 1
        slot = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.keys[slot] >= 0:
            slot = (slot + 1) & mask
        self.keys[slot], self.values[slot] = key, value
        self.n += 1

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        at = self.keys >= 0
        return self.keys[at], self.values[at]

    def load(self, keys: np.ndarray, values: np.ndarray, bits: int) -> None:
        """Holds these cells alone, in a table of 2**bits or larger."""
        while 2 * len(keys) > 1 << bits:
            bits += 1
        self.__init__(bits)
        mask = len(self.keys) - 1
        left, slots = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]  # of several for one slot the last stays
            won = free[self.keys[slots[free]] == keys[free]]
            self.values[slots[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slots[left] = (slots[left] + 1) & mask
        self.n = len(keys)


class TokenAutomaton:
    """The merges compiled to a deterministic automaton over bytes, with the arcs of the token path as output.

    ``step`` maps (state, byte) to the next state, ``last`` maps (state, byte) to
    the arc that ends a word with that byte, ``arc_of`` maps a state to the arc
    that ends there if the word goes on. A state stands for the places behind it
    from which an arc is still under way: (node of the label trie, arc that ended
    at that place). Arcs that bar the same of the few arcs below a node stand for
    one another, and a place from which none may come is left out. One path alone
    spells a word, so one arc alone ends at each place, whatever follows. The tables hold the cells of all labels; a word that
    leaves them fills further cells, TABLE states at most beyond the compiled
    ones, and then the table falls back to those.
    """

    def __init__(self, vocabulary: str) -> None:
        spec = json.loads(vocabulary)
        arcs: dict[str, int] = spec["model"]["vocab"]
        self.labels = {i: s for s, i in arcs.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {i: s for s, i in self.specials.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.gadgets: dict[int, dict[int, int]] = {}  # rank by left and right symbol
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, (u, v) in enumerate(spec["model"]["merges"], 1):
            pair, w = (arcs[u], arcs[v]), arcs[u + v]
            self.gadgets.setdefault(pair[0], {}).setdefault(pair[1], rank)
            if w not in self.parts:
                self.parts[w], self.rank[w] = pair, rank
        self.n_arcs = 1 + max(self.labels)  # pairs with an arc are kept as one number
        self._forget()
        bytes_of = {c: b for b, c in enumerate(byte_letters())}
        spelled = {i: bytes(bytes_of[c] for c in s.removesuffix(END)) for s, i in arcs.items() if i not in self.specials.values()}
        self._plant(spelled, {i for s, i in arcs.items() if s.endswith(END)})
        self.states: list[tuple[int, ...]] = [(0, -1)]  # node, arc, node, arc...
        self.number = {self.states[0]: 0}
        self.arc_of = np.full(1 << 16, -1, np.int32)
        self.step, self.last = Cells(), Cells()
        labels = [w for w in spelled.values() if 0 < len(w) <= LONG]
        self._walk(np.frombuffer(b"".join(labels), np.uint8), np.array([len(w) for w in labels]))
        self.base = len(self.states)
        self.compiled = (*self.step.items(), *self.last.items())
        self._forget()

    def __getstate__(self) -> dict:
        """Without what ``__setstate__`` makes from the rest."""
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "step", "last")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.number = {s: i for i, s in enumerate(self.states)}
        self.step, self.last = Cells(), Cells()
        self.step.load(*self.compiled[:2], 16)
        self.last.load(*self.compiled[2:], 16)

    def _forget(self) -> None:
        """Empties what ``_left``, ``_right``, ``may_follow``, ``_same`` and ``_below`` remember."""
        self.lefts: dict[int, list[tuple[dict[int, int], float]]] = {}
        self.rights: dict[int, list[tuple[int, float]]] = {}
        self.may: dict[int, bool] = {}
        self.same: dict[int, int | None] = {}
        self.like: dict[tuple[int, int], int] = {}
        self.below: dict[int, list[int] | None] = {}

    def _plant(self, spelled: dict[int, bytes], closing: set[int]) -> None:
        """The trie of the labels that a path can hold: children, arcs and closing arcs of each node."""
        self.children: list[dict[int, int] | None] = [{}]
        self.closing: list[dict[int, int] | None] = [None]
        self.ends: list[int] = [-1]
        self.sizes = np.zeros(max(spelled) + 1, np.int64)
        for arc, word in spelled.items():
            if not word or not self._whole(arc):
                continue
            node = 0
            for b in word[:-1] if arc in closing else word:
                if self.children[node] is None:
                    self.children[node] = {}
                below = self.children[node].get(b)
                if below is None:
                    below = self.children[node][b] = len(self.ends)
                    self.children.append(None)
                    self.closing.append(None)
                    self.ends.append(-1)
                node = below
            self.sizes[arc] = len(word)
            if arc in closing:
                if self.closing[node] is None:
                    self.closing[node] = {}
                self.closing[node][word[-1]] = arc
            else:
                self.ends[node] = arc

    def _shrink(self, kept: np.ndarray) -> np.ndarray:
        """Back to the compiled states and those ``kept``; their numbers from now on."""
        held = [(self.states[s], self.arc_of[s]) for s in kept.tolist()]
        for state in self.states[self.base :]:
            del self.number[state]
        del self.states[self.base :]
        self.step.load(*self.compiled[:2], 16)
        self.last.load(*self.compiled[2:], 16)
        self._forget()
        return np.array([self._state(s, arc) for s, arc in held], np.int64)

    def _state(self, pairs: tuple[int, ...], arc: int) -> int:
        number = self.number.get(pairs)
        if number is None:
            number = self.number[pairs] = len(self.states)
            self.states.append(pairs)
            if number == len(self.arc_of):
                self.arc_of = np.concatenate([self.arc_of, np.full(number, -1, np.int32)])
            self.arc_of[number] = arc
        return number

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Symbols at one edge while ``token`` is built, each with the rank that consumes it."""
        out, until, at = [], float("inf"), token
        while True:
            out.append((at, until))
            if at not in self.parts:
                return out
            until, at = self.rank[at], self.parts[at][side]

    def _left(self, token: int) -> list[tuple[dict[int, int], float]]:
        """The gadgets (rank by right symbol) of each symbol at the right edge of ``token``, with the rank that consumes it."""
        found = self.lefts.get(token)
        if found is None:
            found = self.lefts[token] = [(self.gadgets[x], until) for x, until in self._edge(token, 1) if x in self.gadgets]
        return found

    def _right(self, token: int) -> list[tuple[int, float]]:
        found = self.rights.get(token)
        if found is None:
            found = self.rights[token] = self._edge(token, 0)
        return found

    def may_follow(self, before: int, arc: int) -> bool:
        """Whether ``arc`` may follow ``before``: no gadget fires across the border before an inner one consumes its symbols.

        On equal ranks the left pair goes first, so the right token's own merge loses.
        """
        key = before * self.n_arcs + arc
        known = self.may.get(key)
        if known is None:
            known = self.may[key] = self._borders(self._left(before), self._right(arc))
        return known

    @staticmethod
    def _borders(left: list[tuple[dict[int, int], float]], right: list[tuple[int, float]]) -> bool:
        for fires, x_until in left:
            for y, y_until in right:
                rank = fires.get(y)
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def _arcs_below(self, node: int) -> list[int] | None:
        """The arcs that end below ``node``; None if they are over MOST."""
        if node not in self.below:
            out, todo = list((self.closing[node] or {}).values()), list((self.children[node] or {}).values())
            while todo and len(out) <= MOST:
                at = todo.pop()
                if self.ends[at] >= 0:
                    out.append(self.ends[at])
                out += (self.closing[at] or {}).values()
                todo += (self.children[at] or {}).values()
            self.below[node] = out if len(out) <= MOST else None
        return self.below[node]

    def _same(self, node: int, before: int) -> int | None:
        """What stands for ``before`` at ``node``: the first arc met that bars the same arcs below, -1 if none is barred, None if all are."""
        key = node * self.n_arcs + before
        if key in self.same:
            return self.same[key]
        below, out = self._arcs_below(node), before
        if below is not None:
            left, mask = self._left(before), 0
            for k, arc in enumerate(below):
                mask |= self._borders(left, self._right(arc)) << k
            out = None if not mask else -1 if mask == (1 << len(below)) - 1 else self.like.setdefault((node, mask), before)
        self.same[key] = out
        return out

    def _fill_step(self, state: int, byte: int) -> int:
        """Fills one cell of ``step``: every arc under way reads the byte; the one that may end here starts the next."""
        ended, under_way = -1, []
        pairs = iter(self.states[state])
        for node, before in zip(pairs, pairs):
            below = self.children[node]
            node = below.get(byte) if below else None
            if node is None:
                continue
            arc = self.ends[node]
            if arc >= 0 and ended < 0 and (before < 0 or self.may_follow(before, arc)):
                ended = arc
            if self.children[node] or self.closing[node]:
                same = self._same(node, before) if before >= 0 else before
                if same is not None:
                    under_way += node, same
        under_way += 0, ended
        number = self._state(tuple(under_way), ended)
        self.step.put(state << 8 | byte, number)
        return number

    def _fill_last(self, state: int, byte: int) -> int:
        """Fills one cell of ``last``."""
        pairs = iter(self.states[state])
        for node, before in zip(pairs, pairs):
            arc = (self.closing[node] or {}).get(byte)
            if arc is not None and (before < 0 or self.may_follow(before, arc)):
                self.last.put(state << 8 | byte, arc)
                return arc
        raise ValueError(f"no arc ends a word with byte {byte}")

    @staticmethod
    def _filled(cells: Cells, keys: np.ndarray, fill) -> np.ndarray:
        """The cells of ``keys``; those that are empty are filled first."""
        found = cells.get(keys)
        if found.min() < 0:
            empty = np.flatnonzero(found < 0)
            new, at = np.unique(keys[empty], return_inverse=True)
            found[empty] = np.array([fill(k >> 8, k & 255) for k in new.tolist()], np.int32)[at]
        return found

    def _walk(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words whose bytes stand one after the other in ``data``, and how many ids each has. Words are not empty."""
        data = data.astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        begin, size = starts[order], lengths[order]
        arcs = np.empty(len(data), np.int32)  # the arc that ends at each place if the word goes on
        state = np.zeros(len(lengths), np.int64)
        ascending = size[::-1]
        for i in range(int(size[0]) - 1 if len(size) else 0):
            n = len(size) - int(np.searchsorted(ascending, i + 1, side="right"))  # words that go on after this byte
            at = begin[:n] + i
            state[:n] = self._filled(self.step, state[:n] << 8 | data[at], self._fill_step)
            arcs[at] = self.arc_of[state[:n]]
            if len(self.states) > getattr(self, "base", 1 << 60) + TABLE:
                kept, where = np.unique(state, return_inverse=True)
                state = self._shrink(kept)[where]
        out = np.full(len(data), -1, np.int32)
        if len(lengths):
            end = begin + size - 1
            arc = self._filled(self.last, state << 8 | data[end], self._fill_last)
            while len(end):
                out[end] = arc
                end = end - self.sizes[arc]
                on = end >= begin
                end, begin = end[on], begin[on]
                arc = arcs[end]
        taken = out >= 0
        total = np.concatenate([[0], np.cumsum(taken)])
        return out[taken].astype(np.uint32), total[starts + lengths] - total[starts]

    def _walk_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word, byte by byte."""
        state, near, arcs = 0, {}, []
        for b in word[:-1]:
            key = state << 8 | b
            to = near.get(key)
            if to is None:
                to = near[key] = int(self._filled(self.step, np.array([key]), self._fill_step)[0])
                if len(self.states) > self.base + TABLE:
                    to, near = int(self._shrink(np.array([to]))[0]), {}
            state = to
            arcs.append(self.arc_of[state])
        arc = int(self._filled(self.last, np.array([state << 8 | word[-1]]), self._fill_last)[0])
        out, at = [arc], len(word) - int(self.sizes[arc])
        while at:
            out.append(int(arcs[at - 1]))
            at -= int(self.sizes[out[-1]])
        return np.array(out[::-1], np.uint32)

    def encode_fragments(self, fragments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all normalized fragments, one after the other, and how many each has."""
        if len(self.may) + len(self.same) > ANSWERS:
            self.may, self.same = {}, {}
        if not fragments:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        n_words = np.ones(len(fragments), np.int64)
        several = {i: WORD.findall(f) for i, f in enumerate(fragments) if not f.isalpha()}
        if several:
            n_words[list(several)] = [max(1, len(w)) for w in several.values()]
            fragments = ["\n".join(several[i]) if i in several else f for i, f in enumerate(fragments)]
        data = np.frombuffer("\n".join(fragments).encode("utf-8", "surrogatepass"), np.uint8)  # no word holds a line end
        ends = np.append(np.flatnonzero(data == 10), len(data))
        lengths = np.diff(ends, prepend=-1) - 1
        ids, counts = self._ids(data[data != 10], lengths)
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(n_words)])])

    def _ids(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_walk``, for words of any length; an empty one has no ids."""
        usual = (lengths > 0) & (lengths <= LONG)
        if usual.all():
            return self._walk(data, lengths)
        ids, counts = self._walk(data[np.repeat(usual, lengths)], lengths[usual])
        all_counts = np.zeros(len(lengths), np.int64)
        all_counts[usual] = counts
        starts = np.cumsum(lengths) - lengths
        long_ = {i: self._walk_long(data[starts[i] : starts[i] + lengths[i]].tobytes()) for i in np.flatnonzero(lengths > LONG).tolist()}
        if long_:
            at = np.cumsum(all_counts)  # no long word has a count yet
            places = np.repeat([at[i] for i in long_], [len(x) for x in long_.values()])
            ids = np.insert(ids, places, np.concatenate(list(long_.values())))
            for i, x in long_.items():
                all_counts[i] = len(x)
        return ids, all_counts

    def ids(self, text: str | None) -> list[int]:
        return [i for ids, _ in self.encode([text]) for i in ids.tolist()]

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of the texts, one after the other; number of ids of each) for each chunk of the texts."""
        for part in chunks(texts):
            held = self.fragments_of(part)
            ids, counts = self.encode_fragments(held.fragments)
            counts, ids = held.with_specials(counts, ids)
            n = counts[held.index]
            first = (np.cumsum(counts) - counts)[held.index]
            total = np.concatenate([[0], np.cumsum(n)])
            out = ids[np.repeat(first - total[:-1], n) + np.arange(total[-1])]
            yield out, np.diff(total[held.bounds])

    def fragments_of(self, texts: list[str | None]) -> Fragments:
        """The distinct fragments of the texts, and the place of each occurrence among them."""
        flat: list = []
        bounds = [0]
        for text in texts:
            for special, found in self.pieces(text):
                flat += found if special is None else (special,)
            bounds.append(len(flat))
        place = defaultdict(count().__next__)  # numbers in the order they first come
        index = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        return Fragments(list(place), index, np.array(bounds))

    def _whole(self, arc: int) -> bool:
        """Whether the symbols of ``arc`` end in this one token: nothing fires between its halves before it does."""
        if arc not in self.parts:
            return True
        (u, v), rank = self.parts[arc], self.rank[arc]
        left = [(self.gadgets[x], min(rank, until)) for x, until in self._edge(u, 1) if x in self.gadgets]
        return self._borders(left, self._edge(v, 0))

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.labels[i] for i in ids)

    def pieces(self, text: str | None) -> Iterator[tuple[int | None, list[str]]]:
        """(id, []) for a special token; (None, fragments) for the text between them.

        A fragment is a normalized run without white space: words never cross one.
        """
        if not text:
            return
        parts = self.special_split.split(text) if self.special_split and "<|" in text else [text]
        for part in parts:
            if part in self.specials:
                yield self.specials[part], []
            elif part:
                part = normalized(part)
                odd = CONTROLS.search(part)  # str.split() takes these as white space, the vocabulary doesn't
                yield None, (WHITE.sub(" ", part).split(" ") if odd else part.split())


def normalized(text: str) -> str:
    """NFC, then lower case letter by letter: unlike ``str.lower`` that makes a sigma at a word's end an ordinary one."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "\u03a3" in text:
            return "".join([c.lower() for c in text])
    return text.lower()


class Fragments:
    """Distinct fragments of a chunk (a special token is a fragment of its id), their occurrences, the bounds of the texts."""

    def __init__(self, keys: list, index: np.ndarray, bounds: np.ndarray) -> None:
        self.special = {i: k for i, k in enumerate(keys) if not isinstance(k, str)}
        self.fragments = [k if isinstance(k, str) else "" for k in keys] if self.special else keys
        self.index, self.bounds = index, bounds

    def with_specials(self, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.special:
            return counts, ids
        at = np.array(list(self.special))
        places = (np.cumsum(counts) - counts)[at]
        counts = counts.copy()
        counts[at] = 1
        return counts, np.insert(ids, places, np.array(list(self.special.values()), np.uint32))


def chunks(texts: Iterable[str | None], most: int | None = None) -> Iterator[list[str | None]]:
    """Runs of texts of about CHUNK_CHARS characters; a longer text is a run of its own."""
    part, n = [], 0
    for text in texts:
        part.append(text)
        n += len(text or "") + 100
        if n >= (most or CHUNK_CHARS):
            yield part
            part, n = [], 0
    if part:
        yield part


_COMPILED: dict[bytes, TokenAutomaton] = {}


_TABLES: dict[tuple[str, str], bytes] = {}


def compile_vocabulary(spark: SparkSession, vocabulary: str) -> bytes:
    """The automaton of a vocabulary file's text as workers get it, compiled once per application, in one task: the driver holds the result alone."""
    key = (spark.sparkContext.applicationId, hashlib.sha256(vocabulary.encode("utf-8", "surrogatepass")).hexdigest())
    if key not in _TABLES:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(TokenAutomaton(vocabulary), pickle.HIGHEST_PROTOCOL), 1)], pa.binary())], ["tables"])

        _TABLES.clear()
        _TABLES[key] = bytes(spark.range(1, numPartitions=1).mapInArrow(trimmed(run), "tables binary").collect()[0][0])
    return _TABLES[key]


def loaded(tables: bytes) -> TokenAutomaton:
    """The compiled automaton, unpacked once per Python worker, which keeps it for its next tasks."""
    key = hashlib.sha256(tables).digest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = pickle.loads(zlib.decompress(tables))
    return _COMPILED[key]


def unload() -> None:
    """Drops the automaton that this Python worker keeps, once no further task of the job encodes."""
    _COMPILED.clear()


def load_vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    tables = compile_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = loaded(tables)
        number, label = [str(i) for i in range(len(a.labels))], [a.labels[i] for i in range(len(a.labels))]
        for batch in batches:
            rows = []
            for texts in chunks(x.as_py() for x in batch.column("text")):
                held = a.fragments_of(texts)
                counts, ids = held.with_specials(*a.encode_fragments(held.fragments)[::-1])
                ids, ends = ids.tolist(), np.cumsum(counts).tolist()
                spans = list(zip([0, *ends], ends))
                shown, texts_of = ([" ".join([names[i] for i in ids[x:y]]) for x, y in spans] for names in (number, label))
                index = held.index if counts.all() else held.index[counts[held.index] > 0]
                bounds = held.bounds if counts.all() else np.concatenate([[0], np.cumsum(counts[held.index] > 0)])[held.bounds]
                n = np.concatenate([[0], np.cumsum(counts[index])])[bounds]
                index, bounds = index.tolist(), bounds.tolist()
                for k, (x, y) in enumerate(zip(bounds, bounds[1:])):
                    mine = index[x:y]
                    sha = [hashlib.sha256(" ".join([names[i] for i in mine]).encode("utf-8", "surrogatepass")).hexdigest() for names in (shown, texts_of)]
                    rows.append((int(n[k + 1] - n[k]), *sha))
            n, i, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"), load_vocabulary())
