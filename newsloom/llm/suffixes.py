"""Suffix-array deduplication by a distributed merge sort that knows common prefixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id. What is sorted is a sparse suffix array: of each string's k-grams the least by hash
is its anchor, so equal strings have equal anchors at equal places, and only the suffixes at
anchors, each with the bytes before it, are needed to compare all strings.

Documents are dealt into runs. In order:

- Each run sends hashes of its anchors; those that no other document has drop out before any
  string is exchanged (the search for the distinguishing prefix).
- Each run sorts what is left, keeps one suffix of several equal ones (with the smallest id),
  and sends it front-coded, only the bytes that the one before doesn't share, to the range of
  the alphabet that it belongs to.
- Each range merges its runs with a loser tree whose nodes keep the length of the prefix that
  is known to be common, and compare only what comes after it. Strings are matched within a
  group of suffixes that begin alike, and each run gets back which of its suffixes' strings a
  smaller id has.
- An anchor so frequent that its group could outgrow a task isn't sent as a suffix: the strings
  around it are, one by one, dealt by hash and merged in the same way.
- Runs times ranges would grow with the square of the input. Above ``DIRECT`` runs there are two
  levels: groups of runs are merged within wide ranges first, and what a group holds goes on to
  the ranges as one run; the answers come back the same way.
"""

from __future__ import annotations

import ctypes
import math
from contextlib import suppress
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, narrow, read, release

#: Bytes of a string, of an anchor's k-gram, and k-grams in a string.
LENGTH, GRAM = 50, 24
PLACES = LENGTH - GRAM + 1
#: Bytes of a suffix with those before it, and the byte that stands for none (never in UTF-8).
WIDTH, NONE = LENGTH + PLACES - 1, 0xFF
#: Bytes of text in a run, occurrences that make an anchor frequent, k-grams sampled for a run.
RUN, FREQUENT, SAMPLED = 5 << 20, 50_000, 100
#: Runs that are merged in one level, k-grams sampled at most, texts of one id that are dealt to
#: so many runs, and the least documents and share of them that a sample takes.
DIRECT, MOST_SAMPLED, SALT, LEAST_SAMPLE, SHARE = 256, 1 << 20, 64, 2000, 64
#: Partitions of an exchange at most.
PARTITIONS = 1 << 15
ALL = np.uint32((1 << PLACES) - 1)
LAST = 2**63 - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding(values: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over each window, by doubling."""
    size = 1
    while 2 * size <= width:
        values, size = join(values[: len(values) - size], values[size:]), 2 * size
    rest = width - size
    return join(values[: len(values) - rest], values[rest:]) if rest else values


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each k-gram: a polynomial, doubled from one byte on."""
    by_size, size = {1: mixed(data.astype(np.uint64) + np.uint64(0x9E3779B9))}, 1
    power = lambda n: np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64))
    while 2 * size <= GRAM:
        x = by_size[size]
        by_size[2 * size] = x[: len(x) - size] * power(size) + x[size:]
        size *= 2
    rest = GRAM - size  # a size that was doubled on the way, as GRAM has two bits set
    x, y = by_size[size], by_size[rest]
    n = len(data) - GRAM + 1
    return mixed(x[:n] * power(rest) + y[size : size + n]) | np.uint64(1)


class Laid:
    """The documents of a run in one buffer, by id and text, with gaps of NONE between them."""

    def __init__(self, table: pa.Table):
        ids = [LAST if i is None else i for i in table.column("doc_id").to_pylist()]
        texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        gap = bytes([NONE]) * LENGTH
        self.data = np.frombuffer(gap.join([b"", *[texts[i] for i in self.order], b""]), np.uint8)
        self.size = np.array([len(texts[i]) for i in self.order], np.int64)
        del texts
        self.begin = LENGTH + np.cumsum(self.size + LENGTH) - self.size - LENGTH
        self.ids = np.array([ids[i] for i in self.order], np.int64)
        long = self.size >= LENGTH
        steps = np.zeros(len(self.data) + 1, np.int8)
        steps[self.begin[long]] += 1
        steps[(self.begin + self.size)[long] - LENGTH + 1] -= 1
        self.whole = np.cumsum(steps[:-1], dtype=np.int8).view(bool)  # a string begins here

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, places, "right") - 1

    def anchors(self, part: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all k-grams that are the least of some string."""
        places, hashes = [], []
        for a in range(0, len(self.data) - LENGTH + 1, part):
            starts = self.whole[a : min(a + part, len(self.data) - LENGTH + 1)]
            if not starts.any():
                continue
            h = gram_hashes(self.data[a : a + len(starts) + LENGTH - 1])
            least = np.where(starts, sliding(h, PLACES, np.minimum), np.uint64(0))
            edge = np.zeros(PLACES - 1, np.uint64)
            most = sliding(np.concatenate([edge, least, edge]), PLACES, np.maximum)
            at = np.flatnonzero(h == most)
            places.append(at + a)
            hashes.append(h[at])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        places, first = np.unique(np.concatenate(places), return_index=True)
        return places, np.concatenate(hashes)[first]


class Grams:
    """A run's distinct anchor hashes, dealt to ``parts``, and which anchors have them."""

    def __init__(self, laid: Laid, parts: int):
        self.places, hashes = laid.anchors()
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
        self.count = np.diff(np.r_[first, len(ordered)])
        ids = laid.ids[laid.owner(self.places)][order] if len(order) else np.empty(0, np.int64)
        last = first + self.count - 1
        self.several = ids[first] != ids[last]  # places are in the order of the ids
        distinct = ordered[first]
        part = (distinct % np.uint64(parts)).astype(np.int64)
        self.deal = np.argsort(part, kind="stable")
        self.part, self.key = part[self.deal], (distinct[self.deal] >> np.uint64(32)).astype(np.uint32)
        rank = np.empty(len(first), np.int64)
        rank[self.deal] = np.arange(len(first))
        self.of = np.empty(len(order), np.int64)  # of an anchor: its hash's place in the deal
        self.of[order] = np.repeat(rank, self.count)
        self.count = self.count[self.deal]
        # counts from 127 on are sent beside the flags
        self.flags = (self.several[self.deal].astype(np.uint8) << 7) | np.minimum(self.count, 127).astype(np.uint8)


class Strings:
    """Distinct byte strings of one width in order; of equal ones the first stands for all."""

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
        wide[:, :width] = rows
        del rows
        columns = wide.view(">u8")
        for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
            h = np.zeros(n, np.uint64)
            for c in columns.T:
                h = mixed((h ^ c) * np.uint64(factor))
            order = np.argsort(h, kind="stable")
            ordered = h[order]
            first = np.r_[True, ordered[1:] != ordered[:-1]][:n]
            group = np.cumsum(first) - 1
            stands = order[first]
            if all((c[order] == c[stands][group]).all() for c in columns.T):
                break
        else:
            raise RuntimeError("three hashes in turn took different strings for equal")
        sort = np.lexsort([c[stands] for c in columns.T[::-1]]) if len(stands) else np.empty(0, np.int64)
        rank = np.empty(len(sort), np.int64)
        rank[sort] = np.arange(len(sort))
        self.stands = stands[sort]  # of each distinct string: the row that stands for it
        self.of = np.empty(n, np.int64)  # of each row: its string's number
        self.of[order] = rank[group]
        self.rows = wide[self.stands][:, :width]

    def front_coded(self, chosen: np.ndarray) -> tuple[bytes, bytes]:
        return front_coded(self.rows[chosen])


def front_coded(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Of successive strings: the lengths shared with the one before, and the other bytes."""
    n, width = rows.shape
    shared = np.zeros(n, np.uint8)
    if n > 1:
        differs = rows[1:] != rows[:-1]
        shared[1:] = differs.argmax(axis=1)
    return shared.tobytes(), rows[np.arange(width) >= shared[:, None]].tobytes()


def part_of(rows: np.ndarray, parts: int) -> np.ndarray:
    """The part of each string of LENGTH bytes, by a hash."""
    h = np.zeros(len(rows), np.uint64)
    for c in rows.T:
        h = (h ^ c) * np.uint64(0x100000001B3)
    return (mixed(h) % np.uint64(parts)).astype(np.int64)


def suffix_rows(laid: Laid, places: np.ndarray) -> np.ndarray:
    """From each place on LENGTH bytes, then those before it, backwards."""
    around = sliding_window_view(laid.data, WIDTH)[places - (PLACES - 1)]
    return np.concatenate([around[:, PLACES - 1 :], around[:, PLACES - 2 :: -1]], axis=1)


def string_places(laid: Laid, places: np.ndarray) -> np.ndarray:
    """Where the strings begin that have an anchor at one of the places."""
    around = np.unique((places[:, None] - np.arange(PLACES)).ravel())
    return around[laid.whole[around]]


class Sorted:
    """A run's suffixes at anchors that other documents have too, and its frequent strings."""

    def __init__(self, laid: Laid, grams: Grams, classes: np.ndarray):
        kind = classes[grams.of] if len(grams.of) else np.empty(0, np.uint8)
        self.places = grams.places[kind == 1]
        self.suffixes = Strings(suffix_rows(laid, self.places))
        self.starts = string_places(laid, grams.places[kind == 2])
        self.strings = Strings(sliding_window_view(laid.data, LENGTH)[self.starts])

    def pairs(self):
        return (1, self.places, self.suffixes), (2, self.starts, self.strings)


class Merger:
    """A loser tree over front-coded runs of strings of one width.

    ``known[i]`` is how long the prefix is that the head of run i shares with the last string
    that left the tree (for a loser: with the one that beat it, which is as good). The longer
    one wins without a look at the strings; only if both are equal is it compared, from there.
    """

    def __init__(self, runs: list[tuple[bytes, bytes]], width: int):
        self.width, self.runs = width, [self._strings(*run) for run in runs]
        self.size = 1
        while self.size < max(len(runs), 1):
            self.size *= 2
        self.heads: list = [None] * self.size
        self.known = [-1] * self.size
        self.losers = [0] * self.size
        for i in range(len(runs)):
            self._advance(i)
        self.winner = self._build(1)

    def _strings(self, shared: bytes, rest: bytes):
        last, at, width = b"", 0, self.width
        for n in shared:
            step = width - n
            last = last[:n] + rest[at : at + step]
            at += step
            yield n, last

    def _advance(self, i: int) -> None:
        self.known[i], self.heads[i] = next(self.runs[i], (-1, None))

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads."""
        known = self.known
        m, n = known[a], known[b]
        if m != n:
            return (a, b) if m > n else (b, a)
        if m < 0:
            return a, b
        x, y, at = self.heads[a], self.heads[b], m
        while at < self.width:
            p, q = x[at : at + 16], y[at : at + 16]
            if p != q:
                differs = int.from_bytes(p, "big") ^ int.from_bytes(q, "big")
                at += len(p) - (differs.bit_length() + 7) // 8
                if p < q:
                    known[b] = at
                    return a, b
                known[a] = at
                return b, a
            at += 16
        known[b] = self.width
        return a, b

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self):
        """(run, length shared with the string before, string) in order."""
        heads, known, losers, play = self.heads, self.known, self.losers, self._play
        while heads[self.winner] is not None:
            i = self.winner
            yield i, known[i], heads[i]
            self._advance(i)
            node = (i + self.size) // 2
            while node:
                j = losers[node]
                m, n = known[i], known[j]
                if m < n:
                    losers[node], i = i, j
                elif m == n:
                    i, losers[node] = play(i, j)
                node //= 2
            self.winner = i


def matched(group: list[tuple[bytes, list[tuple[int, int, int]]]], give) -> None:
    """Of suffixes that begin with the same k-gram: ``give(run, number, mask)`` says which of a
    suffix's strings (bit o: the one that begins o bytes before it) smaller ids have."""
    least = [min(m[0] for m in members) for _, members in group]
    if len(group) == 1:
        for doc, run, number in group[0][1]:
            if least[0] < doc:
                give(run, number, int(ALL))
        return
    masks = [0] * len(group)
    for o in range(PLACES):
        first: dict = {}
        keys = [s[: LENGTH - o] + s[LENGTH : LENGTH + o] for s, _ in group]
        for key, doc in zip(keys, least, strict=True):
            if first.get(key, LAST + 1) > doc:
                first[key] = doc
        bit = 1 << o
        for i, key in enumerate(keys):
            if first[key] < least[i]:
                masks[i] |= bit
    for (_, members), mask, smallest in zip(group, masks, least, strict=True):
        for doc, run, number in members:
            found = int(ALL) if smallest < doc else mask
            if found:
                give(run, number, found)


def merge(kind: int, fragments: list[dict]) -> dict[int, list[tuple[int, int]]]:
    """run -> (place of a string in the run's fragment, mask) from the fragments of one range."""
    docs = [docs_of(f).tolist() for f in fragments]
    width = WIDTH if kind == 1 else LENGTH
    alike = GRAM if kind == 1 else LENGTH
    out: dict[int, list] = {f["run"]: [] for f in fragments}
    give = lambda run, number, mask: out[fragments[run]["run"]].append((number, mask))
    at = [0] * len(fragments)
    group: list = []
    for run, shared, string in Merger([(f["shared"], f["rest"]) for f in fragments], width):
        member = (docs[run][at[run]], run, at[run])
        at[run] += 1
        if group and shared >= width:
            group[-1][1].append(member)
            continue
        if group and shared < alike:
            matched(group, give)
            group = []
        group.append((string, [member]))
    if group:
        matched(group, give)
    return out


@dataclass(frozen=True)
class Levels:
    """How runs meet ranges of the alphabet (or parts of the hashes): outright, or in two levels."""

    runs: int
    parts: int
    splits: tuple[bytes, ...]
    direct: int

    @property
    def two(self) -> bool:
        return self.runs > self.direct

    @property
    def width(self) -> int:
        """Runs of a group, and ranges or parts of a wide one."""
        return math.isqrt(max(self.runs, 1) - 1) + 1

    def place(self, kind: int, run: int, wide: int) -> int:
        """The number of a group of runs within a wide range, beyond those of the runs."""
        each = self.width + 1
        return self.runs + ((kind - 1) * each + run // self.width) * each + wide

    def ranges(self, kind: int, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(range or part, which of the ordered strings go there)."""
        n = len(rows)
        if kind == 2:
            to = part_of(rows, self.parts)
            order = np.argsort(to, kind="stable")
            found, begin = np.unique(to[order], return_index=True)
            return [(int(k), c) for k, c in zip(found, np.split(order, begin[1:]), strict=True)]
        lead = np.ascontiguousarray(rows[:, :GRAM]).view(f"S{GRAM}").ravel() if n else np.empty(0, f"S{GRAM}")
        edges = [0, *np.searchsorted(lead, np.array(self.splits, f"S{GRAM}")), n] if self.splits else [0, n]
        return [(k, np.arange(a, b)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]

    def wide(self, kind: int, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(wide range, which of the ordered strings go there, in order)."""
        out: dict[int, list] = {}
        for k, chosen in self.ranges(kind, rows):
            out.setdefault(k // self.width, []).append(chosen)
        return [(k, np.sort(np.concatenate(v))) for k, v in out.items()]


def to_range(kind: int, k: int) -> int:
    return k + (kind - 1) * (1 << 40)


def fragment(to: int, run: int, kind: int, rows: np.ndarray, docs: np.ndarray, chosen: np.ndarray) -> tuple:
    """The chosen of a run's strings for one receiver; numbers that don't follow each other go with them."""
    shared, rest = front_coded(rows[chosen])
    number = np.diff(chosen, prepend=chosen[0]).astype("<u4").tobytes()
    return (to, run, kind, int(chosen[0]), shared, rest, docs[chosen].tobytes() + number)


def numbers_of(row: dict) -> np.ndarray:
    return row["first"] + np.cumsum(np.frombuffer(row["docs"], "<u4", offset=8 * len(row["shared"])).astype(np.int64))


def docs_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["docs"], np.int64, len(row["shared"]))


def combine(levels: Levels):
    """A group of runs within a wide range becomes one run: the distinct strings, each with the
    smallest id, for the ranges; and for the group itself which of the runs' strings they are."""

    def of(table: pa.Table) -> pa.Table:
        frugal()
        rows = table.to_pylist()
        kind, place = rows[0]["kind"], rows[0]["to"]
        if kind == 0:
            return table
        ids, numbers = [docs_of(r) for r in rows], [numbers_of(r) for r in rows]
        width, n = (WIDTH if kind == 1 else LENGTH), -1
        distinct, origin, of_string = bytearray(), [], []
        for run, shared, string in Merger([(r["shared"], r["rest"]) for r in rows], width):
            if n < 0 or shared < width:
                n += 1
                distinct += string
            origin.append(run)
            of_string.append(n)
        origin, of_string = np.array(origin, np.int64), np.array(of_string, np.int64)
        doc, number = np.empty(len(origin), np.int64), np.empty(len(origin), np.int64)
        for k in range(len(rows)):
            mine = np.flatnonzero(origin == k)
            doc[mine], number[mine] = ids[k], numbers[k]
        first = np.flatnonzero(np.r_[True, of_string[1:] != of_string[:-1]])
        least = np.minimum.reduceat(doc, first)
        runs = np.array([r["run"] for r in rows], "<u4")[origin]
        later = np.packbits(doc > least[of_string]).tobytes()
        out = [(-1 - place, place, 0, kind, runs.tobytes(), np.r_[number, of_string].astype("<u4").tobytes(), later)]
        strings = np.frombuffer(bytes(distinct), np.uint8).reshape(-1, width)
        for k, chosen in levels.ranges(kind, strings):
            out.append(fragment(to_range(kind, k), place, kind, strings, least, chosen))
        return as_table(out, NAMES, KINDS)

    return of


def divide(levels: Levels):
    """What a group of runs was told, told to each of its runs."""

    def of(table: pa.Table) -> pa.Table:
        if run_of(table) < levels.runs:
            return table
        told = table.to_pylist()
        own = next(r for r in told if r["kind"] == 0)
        runs = np.frombuffer(own["a"], "<u4")
        number, of_string = np.frombuffer(own["b"], "<u4").reshape(2, -1)
        masks = np.zeros(int(of_string[-1]) + 1, np.uint32)
        kind = own["first"]
        for r in told:
            if r["kind"]:
                masks[np.frombuffer(r["a"], "<u4")] = np.frombuffer(r["b"], "<u4")
        later = np.unpackbits(np.frombuffer(own["c"], np.uint8), count=len(runs)).view(bool)
        mask = np.where(later, ALL, masks[of_string])
        out = []
        for run in np.unique(runs[mask > 0]).tolist():
            mine = (runs == run) & (mask > 0)
            out.append((run, kind, 0, number[mine].tobytes(), mask[mine].astype("<u4").tobytes(), b""))
        return as_table(out, TOLD, TOLD_KINDS)

    return of


SCHEMA = "to long, run int, kind int, first long, shared binary, rest binary, docs binary"
NAMES = ["to", "run", "kind", "first", "shared", "rest", "docs"]
KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
TOLD_SCHEMA = "run int, kind int, first long, a binary, b binary, c binary"
TOLD = ["run", "kind", "first", "a", "b", "c"]
TOLD_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def frugal() -> None:
    """Large arrays go back to the system when they are freed, not to this worker's heap: the
    workers of an executor share its memory."""
    release()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD


def as_table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def run_of(table: pa.Table) -> int:
    return table.column("run")[0].as_py()


def send_hashes(parts: int):
    def of(table: pa.Table) -> pa.Table:
        frugal()
        grams = Grams(Laid(table), parts)
        edges = np.searchsorted(grams.part, np.arange(parts + 1))
        rows = []
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if b > a:
                more = np.flatnonzero(grams.count[a:b] >= 127)
                many = np.stack([more, grams.count[a:b][more]]).astype("<i8").tobytes()
                rows.append((k, run_of(table), grams.key[a:b].tobytes(), grams.flags[a:b].tobytes(), many))
        return as_table(rows, ["part", "run", "keys", "flags", "many"], [pa.int32(), pa.int32(), *[pa.binary()] * 3])

    return of


def classify(frequent: int):
    """A class for each hash of each run: 0 in one document, 1 in several, 2 frequent."""
    return lambda table: classified(table.to_pylist(), frequent)


def classified(rows: list[dict], frequent: int) -> pa.Table:
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows])
    flags = np.concatenate([np.frombuffer(r["flags"], np.uint8) for r in rows])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    several = np.diff(np.r_[first, len(keys)]) > 1
    several |= np.maximum.reduceat(flags[order], first) > 127
    count = (flags & 127).astype(np.int64)
    edges = np.cumsum([0, *[len(r["flags"]) for r in rows]])
    for r, a in zip(rows, edges, strict=False):
        at, many = np.frombuffer(r["many"], "<i8").reshape(2, -1)
        count[a + at] = many
    total = np.add.reduceat(count[order], first)
    found = np.where(several, np.where(total >= frequent, 2, 1), 0).astype(np.uint8)
    classes = np.empty(len(keys), np.uint8)
    classes[order] = np.repeat(found, np.diff(np.r_[first, len(keys)]))
    out = []
    for r, a, b in zip(rows, edges, edges[1:], strict=False):
        out.append((r["run"], r["part"], b - a, np.packbits(classes[a:b] > 0).tobytes(), np.flatnonzero(classes[a:b] == 2).astype("<u4").tobytes()))
    return as_table(out, ["run", "part", "n", "several", "frequent"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()])


def classes_of(rows: list[dict]) -> np.ndarray:
    out = [np.empty(0, np.uint8)]
    for r in sorted(rows, key=lambda r: r["part"]):
        found = np.unpackbits(np.frombuffer(r["several"], np.uint8), count=r["n"])
        found[np.frombuffer(r["frequent"], "<u4")] = 2
        out.append(found)
    return np.concatenate(out)


def send_runs(parts: int, levels: Levels):
    """Front-coded fragments of a run for each receiver, and its classes for its own later use."""

    def of(texts: pa.Table, sent: pa.Table) -> pa.Table:
        frugal()
        if not texts.num_rows:
            return as_table([], NAMES, KINDS)
        run, laid = run_of(texts), Laid(texts)
        classes = classes_of(sent.to_pylist())
        ordered = Sorted(laid, Grams(laid, parts), classes)
        rows = [(-1 - run, run, 0, 0, np.packbits(classes > 0).tobytes(), np.flatnonzero(classes == 2).astype("<u4").tobytes(), len(classes).to_bytes(8, "little"))]
        for kind, places, strings in ordered.pairs():
            if len(strings.stands):
                docs = laid.ids[laid.owner(places[strings.stands])]
                dealt = levels.wide if levels.two else levels.ranges
                for k, chosen in dealt(kind, strings.rows):
                    to = levels.place(kind, run, k) if levels.two else to_range(kind, k)
                    rows.append(fragment(to, run, kind, strings.rows, docs, chosen))
        return as_table(rows, NAMES, KINDS)

    return of


def send_back(table: pa.Table) -> pa.Table:
    """What a range tells each run: numbers of its strings, and masks."""
    rows = table.to_pylist()
    if rows[0]["kind"] == 0:
        return as_table([(r["run"], 0, r["first"], r["shared"], r["rest"], r["docs"]) for r in rows], TOLD, TOLD_KINDS)
    kind, numbers = rows[0]["kind"], {r["run"]: numbers_of(r) for r in rows}
    out = []
    for run, found in merge(kind, rows).items():
        if found:
            at, mask = np.array(found, np.int64).T
            out.append((run, kind, 0, numbers[run][at].astype("<u4").tobytes(), mask.astype("<u4").tobytes(), b""))
    return as_table(out, TOLD, TOLD_KINDS)


def removed(laid: Laid, parts: int, told: list[dict]) -> np.ndarray:
    """Which bytes of the buffer go."""
    own = next(r for r in told if r["kind"] == 0)
    classes = np.unpackbits(np.frombuffer(own["a"], np.uint8), count=int.from_bytes(own["c"], "little"))
    classes[np.frombuffer(own["b"], "<u4")] = 2
    ordered = Sorted(laid, Grams(laid, parts), classes)
    gone = np.zeros(len(laid.data), bool)
    for kind, places, strings in ordered.pairs():
        masks = np.zeros(len(strings.stands), np.uint32)
        for r in told:
            if r["kind"] == kind:
                masks[np.frombuffer(r["a"], "<u4")] = np.frombuffer(r["b"], "<u4")
        if not len(places):
            continue
        ids = laid.ids[laid.owner(places)]
        mask = np.where(ids > ids[strings.stands][strings.of], ALL, masks[strings.of])
        if kind == 2:
            gone[places[mask > 0]] = True
            continue
        for o in range(PLACES):
            starts = places[(mask >> np.uint32(o)) & np.uint32(1) > 0] - o
            gone[starts[laid.whole[starts]]] = True
    del ordered
    n = len(gone)
    total = np.zeros(n + 1, np.int32)
    np.cumsum(gone, dtype=np.int32, out=total[1:])
    covered = np.empty(n, bool)  # by a string that begins at most LENGTH - 1 bytes before
    covered[: LENGTH - 1] = total[1:LENGTH] > 0
    covered[LENGTH - 1 :] = total[LENGTH:] > total[: n - LENGTH + 1]
    return covered


def give_back(parts: int, give, names: list[str], kinds: list):
    def of(texts: pa.Table, told: pa.Table) -> pa.Table:
        frugal()
        rows: list[tuple] = []
        if texts.num_rows:
            laid = Laid(texts)
            gone = removed(laid, parts, told.to_pylist())
            del told
            for begin, size in zip(laid.begin.tolist(), laid.size.tolist(), strict=True):
                rows.append(give(laid.data[begin : begin + size], gone[begin : begin + size]))
            texts = texts.drop_columns(["text", "run"]).take(pa.array(laid.order, pa.int64()))
            del laid, gone
        made = as_table(rows, names, kinds)
        kept = [c for c in texts.column_names if c not in ("text", "run")]
        return pa.table([*[texts.column(c) for c in kept], *made.columns], names=[*kept, *names])

    return of


def survey(rows: DataFrame, run: int) -> tuple[int, list[bytes]]:
    """How many runs the texts make, and where the ranges of the alphabet begin: quantiles of
    about ``SAMPLED`` k-grams a run, ``MOST_SAMPLED`` at most, of a share of the documents where
    there are many."""
    total, docs = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    total = total or 0
    parts = max(24, -(-total // run)) if total > 1 << 20 else 4
    share = 1.0 if total <= 1 << 26 else max(1 / SHARE, min(1.0, LEAST_SAMPLE / docs))
    part = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20)) if share < 1 else rows
    wanted = min(SAMPLED * parts, MOST_SAMPLED)
    step = max(1, int(total * share) // (14 * wanted))  # about every 14th byte has an anchor

    def make():
        def pick(batch: pa.RecordBatch):
            laid = Laid(pa.Table.from_batches([batch]))
            places, hashes = laid.anchors()
            places = places[mixed(hashes) % np.uint64(step) == 0]
            found = sliding_window_view(laid.data, GRAM)[places] if len(places) else []
            yield pa.RecordBatch.from_arrays([pa.array([bytes(x) for x in found], pa.binary())], names=["gram"])

        return pick

    found = sorted(arrow_map(part, make, "gram binary").limit(4 * wanted).toArrow().column("gram").to_pylist())
    return parts, sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []


def grouped(df: DataFrame, key: str, groups: int):
    """Grouped by the key, dealt to as many partitions as there are groups, where that is more
    than the session's: then a task doesn't grow with the input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartition(min(groups, PARTITIONS), key) if groups > least else df).groupBy(key)


def analysed(
    df: DataFrame, id: str, text: str, schema: str, give, run: int, frequent: int, direct: int, keep: dict[str, str]
) -> DataFrame:
    rows = narrow(df, doc_id=id, text=text, **keep)
    runs, splits = survey(rows.select("doc_id", "text"), run)
    parts = max(min(runs, 24), runs // 4)  # of the anchors' hashes
    levels = Levels(runs, runs, tuple(splits), direct)
    # the salt parts repeated rows, and rows without an id
    salted = F.xxhash64("doc_id", "text", F.monotonically_increasing_id() % SALT)
    by_run = grouped(rows.withColumn("run", F.pmod(salted, F.lit(runs)).cast("int")), "run", runs)
    hashes = by_run.applyInArrow(send_hashes(parts), "part int, run int, keys binary, flags binary, many binary")
    classes = hashes.groupBy("part").applyInArrow(classify(frequent), "run int, part int, n long, several binary, frequent binary")
    sent = by_run.cogroup(classes.groupBy("run")).applyInArrow(send_runs(parts, levels), SCHEMA)
    if levels.two:
        sent = grouped(sent, "to", 2 * runs).applyInArrow(combine(levels), SCHEMA)
    told = grouped(sent, "to", 2 * runs).applyInArrow(send_back, TOLD_SCHEMA)
    if levels.two:
        told = told.groupBy("run").applyInArrow(divide(levels), TOLD_SCHEMA)
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types.get(c.split()[1]) or pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])) for c in schema.split(", ")]
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return by_run.cogroup(told.groupBy("run")).applyInArrow(give_back(parts, give, names, kinds), f"{own}, {schema}")


def spans(gone: np.ndarray) -> np.ndarray:
    """(begin, end) of the maximal removed runs of bytes."""
    return np.flatnonzero(np.diff(np.r_[False, gone, False])).reshape(-1, 2)


def dedup(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    run: int = RUN,
    frequent: int = FREQUENT,
    direct: int = DIRECT,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, text, removed``: each row's text without the removed bytes, and their spans in
    bytes. A character that lost some of its bytes goes whole. The columns ``keep`` come along
    as keep0, keep1 and so on.

    Ids are whole numbers below 2^63 - 1. Null texts count as empty; texts of fewer bytes than a
    string stay. Null ids come after all others. Rows with equal ids, or without one, don't remove
    each other's strings; repeated rows each give their row. An empty table gives an empty result.
    A very long text is one task's, whole, at about 30 bytes of memory a byte. Other columns,
    whatever their names, are not read. ``df`` has to give the same rows in the same order if a
    part of it is read again, as a table does.
    """

    def give(raw: np.ndarray, gone: np.ndarray) -> tuple:
        found = [{"begin": a, "end": b} for a, b in spans(gone).tolist()]
        return raw[~gone].tobytes().decode(errors="ignore"), found

    also = {f"keep{k}": c for k, c in enumerate(keep)}
    return analysed(df, id, text, "text string, removed array<struct<begin:long,end:long>>", give, run, frequent, direct, also)


def digests(
    df: DataFrame, id: str = "doc_id", text: str = "text", run: int = RUN, frequent: int = FREQUENT, direct: int = DIRECT
) -> DataFrame:
    """As :func:`dedup`, with sizes and the kept bytes' digest in place of text and spans."""

    def give(raw: np.ndarray, gone: np.ndarray) -> tuple:
        n = int(gone.sum())
        return len(raw), n, len(spans(gone)) if n else 0, sha256(raw[~gone].tobytes() if n else raw.tobytes()).hexdigest()

    return analysed(df, id, text, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", give, run, frequent, direct, {})


def op2_suffixes(spark, sf_dir: str) -> DataFrame:
    """Each document without the strings of 50 bytes that smaller ids have."""
    return digests(read(spark, sf_dir, "documents"))


#: The definition itself, over the strings at every byte.
SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - {LENGTH - 1}, 0))) AS p FROM d),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS s FROM w),
m AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s),
c AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM s JOIN m USING (s) WHERE first < doc_id),
i AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM c),
r AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM i GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM r),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last,
  string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
