"""Repeated passages by a distributed merge of front-coded, sorted suffix runs.

Documents are gathered in runs of a few megabytes. Of each 50-byte string one 32-byte part, the one
with the smallest code, is the anchor; equal strings have equal anchors at equal places. Strings
that lie side by side and share an anchor are one record: the suffix from the anchor on as far as
they reach, and what lies before it. Records, not strings, are sorted, exchanged and merged.

1. `_runs`: documents to runs, compressed, written once to the shared folder.
2. `_codes`, `_recurring`: anchors that occur in one document only cannot matter; a first exchange
   of anchor codes tells each run which of its anchors come back.
3. `_strings`, `_merge`: each run sorts its records, front-codes them (length of the prefix shared
   with the record before, then the rest) and sends them by range. The runs of a range are merged
   by code; strings that share a code with others go through loser trees, which carry
   common-prefix lengths along, so that known prefixes are not compared again. The smallest
   document of each string goes back to the runs.
4. `_verdicts`: each run marks the strings of its documents that a smaller document holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoline.llm.common import POWERS, arrow_groups, blocks, library_path, mix, window_codes
from thermoline.session import materialize

#: Bytes of a string that counts as repeated, and of its anchor.
SPAN, ANCHOR = 50, 32
WINDOW = SPAN - ANCHOR + 1

#: Bytes of text in a run; anchor codes that one task holds at a time.
RUN_BYTES, RANGE_CODES = 4 << 20, 1 << 20

#: An anchor in so many runs is common: its strings are then dealt one by one, each by its own code.
COMMON_RUNS = 64

#: In place of a null doc_id: larger than all others.
NO_ID = (1 << 63) - 1

#: Bits of an anchor's place among the 2^16 strings that are searched at once.
_PLACE = np.uint64((1 << 17) - 1)

HEAD = 10  # code of 8 bytes, place of the anchor, length
ROW = -(-(HEAD + SPAN + WINDOW - 1) // 8) * 8

#: Strings, or rows, that are worked on at once.
BLOCK = 1 << 14

COMPRESSOR = zstandard.ZstdCompressor(1)


def _runs(docs: DataFrame, run_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            body = zstandard.compress(b"".join(t for _, t in held), 1)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | seq]), pa.array([[i for i, _ in held]]),
                 pa.array([[len(t) for _, t in held]], pa.list_(pa.int64())),
                 pa.array([[hashlib.sha256(t).digest() for _, t in held]]), pa.array([body]),
                 pa.array([size])], ["run", "ids", "sizes", "digests", "body", "bytes"])

        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_pylist()
            for i, text in zip(ids, batch.column("text").cast(pa.binary()), strict=True):
                text = text.as_py() or b""
                if held and size + len(text) > run_bytes:
                    yield flush()
                    seq, held, size = seq + 1, [], 0
                held.append((i, text))
                size += len(text)
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "run long, ids array<long>, sizes array<long>, digests array<binary>, body binary, "
             "bytes long")


class Run:
    """A run's bytes and the records of its documents."""

    def __init__(self, row: dict) -> None:
        self.ids = np.array(row["ids"], np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.raw = np.frombuffer(zstandard.decompress(row["body"]), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes

    def anchors(self) -> None:
        """first, last: the strings of each record begin from `first` to `last`; at: its anchor;
        code: the anchor's code; doc: the document's place in the run."""
        raw, n = self.raw, len(self.raw) - SPAN + 1
        self.first = self.last = self.at = self.doc = np.zeros(0, np.int64)
        self.code = np.zeros(0, np.uint64)
        if n <= 0:
            return
        # A string that would begin in the last bytes of a document is none.
        short = np.zeros(len(raw), bool)
        short[np.maximum(self.ends[:, None] - np.arange(1, SPAN), 0)] = True
        first, at, codes, strings = [], [], [], []
        seen, last, anchor = 0, -1, -1
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            code = window_codes(raw[a:b + SPAN - 1], ANCHOR)
            # The smallest by its upper bits, of equal ones the first: the lower bits hold places.
            least = code & ~_PLACE | np.arange(len(code), dtype=np.uint64)
            width = 1
            while width < WINDOW:
                step = min(width, WINDOW - width)
                least = np.minimum(least[step:], least[:-step])
                width += step
            whole = np.flatnonzero(~short[a:b])
            if not len(whole):
                continue
            place = (least[whole] & _PLACE).astype(np.int64)
            new = np.empty(len(whole), bool)
            new[0] = place[0] + a != anchor or whole[0] + a != last + 1
            new[1:] = (place[1:] != place[:-1]) | (whole[1:] != whole[:-1] + 1)
            start = np.flatnonzero(new)
            first.append(whole[start] + a)
            at.append(place[start] + a)
            codes.append(code[place[start]])
            strings.append(start + seen)
            seen, last, anchor = seen + len(whole), int(whole[-1]) + a, int(place[-1]) + a
        if not first:
            return
        self.first, self.at = np.concatenate(first), np.concatenate(at)
        self.last = self.first + np.diff(np.concatenate(strings), append=seen) - 1
        # The smallest of some codes are small: mixed again, they fill all ranges alike.
        self.code = mix(np.concatenate(codes))
        self.doc = np.searchsorted(self.ends, self.first, side="right")

    def known_codes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different codes in order, whether two documents hold them, and each record's place."""
        codes, where = np.unique(self.code, return_inverse=True)
        low = np.full(len(codes), len(self.ids))
        high = np.full(len(codes), -1)
        np.minimum.at(low, where, self.doc)
        np.maximum.at(high, where, self.doc)
        return codes, low < high, where

    def records(self, returns: list[bool], common: list[bool], copies: list[int]) -> None:
        """Keeps the records whose anchors come back, outside of copies of earlier documents.
        Strings of common anchors are records of their own; route: the code that deals each."""
        _, _, where = self.known_codes()
        copied = np.zeros(len(self.ids), bool)
        copied[copies] = True
        back, often = np.array(returns, bool), np.array(common, bool)
        take = back[where] & ~copied[self.doc] if len(back) else np.zeros(len(self.code), bool)
        many = take & often[where] if len(back) else take
        one = np.flatnonzero(take & ~many)
        each = np.flatnonzero(many)
        n = (self.last - self.first + 1)[each]
        owner = np.repeat(each, n)
        begin = self.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        pick = np.concatenate([one, owner])
        self.doc, self.at = self.doc[pick], self.at[pick]
        self.route = self.code[pick]
        self.first = np.concatenate([self.first[one], begin])
        self.last = np.concatenate([self.last[one], begin])
        if len(begin):
            up = POWERS.to(SPAN)[0][:SPAN]
            for a in range(0, len(begin), 1 << 14):
                text = self.raw[begin[a:a + (1 << 14), None] + np.arange(SPAN)].astype(np.uint64)
                self.route[len(one) + a:len(one) + a + len(text)] = mix(
                    ((text + np.uint64(1)) * up).sum(1, dtype=np.uint64) ^ np.uint64(SPAN))

    def _rows(self, own: np.ndarray) -> np.ndarray:
        """Records as bytes: code, place of the anchor, length, from the anchor on, before it."""
        rows = np.zeros((len(own), ROW), np.uint8)
        rows[:, :8] = self.route[own].astype(">u8").view(np.uint8).reshape(-1, 8)
        at, first = self.at[own], self.first[own]
        left, right = at - first, self.last[own] + SPAN - at
        rows[:, 8], rows[:, 9] = left, left + right
        column = np.arange(WINDOW - 1)
        for b in np.unique(right).tolist():
            same = np.flatnonzero(right == b)
            rows[same, HEAD:HEAD + b] = sliding_window_view(self.raw, b)[at[same]]
            before = sliding_window_view(self.raw, WINDOW - 1)[first[same]]
            rows[same, HEAD + b:HEAD + b + WINDOW - 1] = before * (column < left[same, None])
        return rows

    def strings(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The different records in order, some ranges of codes at a time: range, bytes, smallest
        document. string: each record's place among all of them; low: their smallest documents."""
        order = np.argsort(self.route, kind="stable")
        self.string, lows, seen = np.empty(len(order), np.int64), [], 0
        range_ = ranges(self.route[order], bits)
        cut = np.flatnonzero(np.r_[True, range_[1:] != range_[:-1]]) if len(order) else order
        for x, y in blocks(np.diff(cut, append=len(order)).tolist(), BLOCK):
            a, b = cut[x], cut[y] if y < len(cut) else len(order)
            own = order[a:b]
            rows = self._rows(own)
            words = rows.view(">u8")
            # By code; what follows the code only where codes are equal.
            equal = words[1:, 0] == words[:-1, 0]
            tied = np.flatnonzero(np.r_[False, equal] | np.r_[equal, False])
            if len(tied):
                sorted_ = tied[np.lexsort(words[tied].astype(np.uint64).T[::-1])]
                own[tied], rows[tied] = own[sorted_], rows[sorted_]
            new = np.ones(len(own), bool)
            next_ = np.flatnonzero(equal) + 1
            new[next_] = (words[next_] != words[next_ - 1]).any(1)
            start = np.flatnonzero(new)
            self.string[own] = np.cumsum(new) - 1 + seen
            lows.append(np.minimum.reduceat(self.ids[self.doc[own]], start))
            seen += len(start)
            yield range_[a:b][start], rows[start], lows[-1]
        self.low = np.concatenate([np.zeros(0, np.int64), *lows])

    def front_coded(self, bits: int) -> Iterator[tuple]:
        """For each range of codes: shared prefix lengths, lengths of the rests, documents, rests."""
        column = np.arange(ROW)
        for range_, rows, low in self.strings(bits):
            cut = np.flatnonzero(np.r_[True, range_[1:] != range_[:-1]])
            shared = shared_lengths(rows)
            shared[cut] = 0
            total = HEAD + rows[:, 9].astype(np.int64)
            body = rows[(column >= shared[:, None]) & (column < total[:, None])].tobytes()
            ends = np.cumsum(total - shared)
            shared, rest = shared.astype(np.uint8), (total - shared).astype(np.uint8)
            offset = 0
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)], strict=True):
                end = int(ends[b - 1])
                yield (int(range_[a]), shared[a:b].tobytes(), rest[a:b].tobytes(),
                       packed(low[a:b]), COMPRESSOR.compress(body[offset:end]))
                offset = end


def shared_lengths(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before, which differs."""
    shared = np.zeros(len(rows), np.int64)
    code = rows[:, :8].copy().view(">u8")[:, 0].astype(np.uint64)
    differ = code[1:] ^ code[:-1]
    for k in range(1, 8):
        shared[1:] += differ < np.uint64(1 << (64 - 8 * k))
    equal = np.flatnonzero(differ == 0) + 1
    shared[equal] = (rows[equal] != rows[equal - 1]).argmax(1)
    return shared


def front_decoded(shared: np.ndarray, rest: np.ndarray, body: bytes) -> np.ndarray:
    """The rows of many front-coded pieces one after the other; a piece begins with nothing shared."""
    n, column = len(shared), np.arange(ROW)
    rows, data = np.zeros((n, ROW), np.uint8), np.frombuffer(body, np.uint8)
    ends = np.cumsum(rest)
    for a in range(0, n, BLOCK):
        own, many = shared[a:a + BLOCK, None], rest[a:a + BLOCK, None]
        begin, end = ends[a] - rest[a], ends[min(n, a + BLOCK) - 1]
        rows[a:a + BLOCK][(column >= own) & (column < own + many)] = data[begin:end]
    _inherit(rows, shared, range(8))
    # Few rows share more than a part of the code with the one before.
    deep = shared > 8
    chain = np.flatnonzero(deep | np.r_[deep[1:], False]) if n else np.zeros(0, np.int64)
    own = rows[chain]
    _inherit(own, shared[chain], range(8, ROW))
    rows[chain] = own
    return rows


def _inherit(rows: np.ndarray, shared: np.ndarray, columns: range) -> None:
    place = np.arange(len(rows))
    for c in columns:
        taken = np.flatnonzero(shared > c)
        if len(taken):
            source = np.maximum.accumulate(np.where(shared > c, 0, place))
            rows[taken, c] = rows[source[taken], c]


def packed(numbers: np.ndarray) -> bytes:
    """Long numbers compressed, their first bytes together, then their second ones, and so on."""
    planes = np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8).T
    return COMPRESSOR.compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i8")


def ranges(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes >> np.uint64(64 - bits)).astype(np.int64)


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _codes(runs: DataFrame, bits: int) -> DataFrame:
    """(range, run, keys, twice): the different anchor codes of each run, 32 bits below the range,
    and whether two documents of the run hold them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            own = Run(row)
            own.anchors()
            codes, twice, _ = own.known_codes()
            if not len(codes):
                continue
            range_ = ranges(codes, bits)
            keys = (codes >> np.uint64(32 - bits)).astype("<u4")
            cut = np.flatnonzero(np.r_[True, range_[1:] != range_[:-1]])
            out = [(int(range_[a]), row["run"], keys[a:b].tobytes(),
                    np.packbits(twice[a:b]).tobytes())
                   for a, b in zip(cut, np.append(cut[1:], len(codes)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*out, strict=True)],
                ["range", "run", "keys", "twice"])

    return runs.select("run", "ids", "sizes", "body").mapInArrow(
        run, "range long, run long, keys binary, twice binary")


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, range, n, returns, common): for each code of a run, in order, whether two documents
    hold it, and whether very many runs do."""
    for group in arrow_groups(batches, "range"):
        keys = [np.frombuffer(x, "<u4") for x in group["keys"]]
        n = np.array([len(x) for x in keys])
        joint = np.concatenate(keys)
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=int(k))
                                for x, k in zip(group["twice"], n, strict=True)])
        _, at, times = np.unique(joint, return_inverse=True, return_counts=True)
        back, often = (times[at] > 1) | (twice > 0), times[at] >= COMMON_RUNS
        ends = np.cumsum(n)
        rows = [(run, group["range"][0], int(k), np.packbits(back[e - k:e]).tobytes(),
                 np.packbits(often[e - k:e]).tobytes())
                for run, k, e in zip(group["run"], n, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)],
                                         ["run", "range", "n", "returns", "common"])


def _bits(parts: list | None, name: str) -> np.ndarray:
    """The flags of a run from those of its ranges, in the order of its codes."""
    return np.concatenate([np.zeros(0, bool), *(
        np.unpackbits(np.frombuffer(p[name], np.uint8), count=p["n"]).astype(bool)
        for p in sorted(parts or [], key=lambda p: p["range"]))])


def _prepared(row: dict) -> Run:
    own = Run(row)
    own.anchors()
    own.records(_bits(row["flags"], "returns"), _bits(row["flags"], "common"), row["copies"] or [])
    return own


def _strings(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            out = [(r, row["run"], *more) for r, *more in _prepared(row).front_coded(bits)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*out, strict=True)],
                    ["range", "run", "shared", "rest", "low", "body"])
    return run


class Stream:
    """Reads one front-coded run: the string at hand and the length it shares with the one before."""

    def __init__(self, shared: bytes, rest: bytes, low: bytes, body: bytes) -> None:
        self.shared, self.rest, self.body = shared, rest, zstandard.decompress(body)
        self.low = np.frombuffer(low, np.int64).tolist()
        self.at, self.offset, self.text = -1, 0, b""
        self.step()

    def step(self) -> int:
        """Moves on; the length shared with the string before. At the end `text` is None."""
        self.at += 1
        if self.at == len(self.low):
            self.text = None
            return 0
        shared, end = self.shared[self.at], self.offset + self.rest[self.at]
        self.text = self.text[:shared] + self.body[self.offset:end]
        self.offset = end
        return shared


def merged(streams: list[Stream]) -> Iterator[tuple[int, int, int, bytes]]:
    """(stream, place in it, length shared with the string before, string) in order.

    A loser tree: each inner node holds the stream that lost there, and `known` of a loser is the
    length of the prefix that its string shares with the string it lost to. A challenger that
    shares more with the last output is the smaller one; only with equal lengths are strings
    compared, and from that length on.
    """
    count = len(streams)
    size = 1 << max(0, count - 1).bit_length()
    known = [0] * size
    texts = [s.text for s in streams] + [None] * (size - count)

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = texts[a], texts[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        l = known[a]
        if l != known[b]:
            return (a, b) if l > known[b] else (b, a)
        if x[l:] == y[l:]:
            known[b] = len(x)
            return a, b
        high = min(len(x), len(y))
        while high - l > 8:
            middle = (l + high) // 2
            if x[l:middle] == y[l:middle]:
                l = middle
            else:
                high = middle
        while x[l] == y[l]:
            l += 1
        if x[l] < y[l]:
            known[b] = l
            return a, b
        known[a] = l
        return b, a

    losers, winners = [0] * size, [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while texts[best] is not None:
        stream = streams[best]
        yield best, stream.at, known[best], texts[best]
        known[best] = stream.step()
        texts[best] = stream.text
        node = (best + size) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1


class Rows(Stream):
    """The same for decoded rows."""

    def __init__(self, rows: np.ndarray) -> None:
        self.shared = shared_lengths(rows).tolist()
        ends = (HEAD + rows[:, 9].astype(np.int64)).tolist()
        self.texts = [x.tobytes()[:end] for x, end in zip(rows, ends, strict=True)]
        self.at = -1
        self.step()

    def step(self) -> int:
        self.at += 1
        if self.at == len(self.texts):
            self.text = None
            return 0
        self.text = self.texts[self.at]
        return self.shared[self.at]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, range, low, fewer): for each string of a run the smallest document that holds all of
    it, less the run's own smallest (so 0 mostly); and (string, place, document) where a smaller one
    holds a 50-byte part.

    Runs are merged by the codes, their strings' first bytes, all at once, and each string is
    compared with the first of its code. Where all are alike nothing else is to be ordered; what
    is left, still in order by run, is merged by a loser tree."""
    for group in arrow_groups(batches, "range"):
        own = [unpacked(x) for x in group["low"]]
        begins = np.cumsum([0, *map(len, own)])
        lows = np.concatenate(own)
        shared, rest = (np.frombuffer(b"".join(group[c]), np.uint8).astype(np.int64)
                        for c in ("shared", "rest"))
        rows = front_decoded(shared, rest, b"".join(map(zstandard.decompress, group["body"])))
        low, first = _alike(rows, lows)
        fewer = _compared(rows, lows, low, first, begins)
        cut = np.searchsorted(fewer[:, 0], begins)
        fewer[:, 0] -= begins[np.searchsorted(begins, fewer[:, 0], side="right") - 1]
        ends = list(zip(begins[:-1], begins[1:], cut[:-1], cut[1:], strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(group["run"]), pa.array(group["range"]),
             pa.array([packed(low[a:b] - lows[a:b]) for a, b, _, _ in ends]),
             pa.array([fewer[a:b].tobytes() for _, _, a, b in ends])],
            ["run", "range", "low", "fewer"])


def _alike(rows: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document of all strings with each string's code; and where a code has several
    strings, the place of its first one for each copy of that, their own for the others (else -1)."""
    words = rows.view(">u8")
    code = words[:, 0].astype(np.uint64)
    order = np.argsort(code, kind="stable")  # merges what is in order by run
    code = code[order]
    new = np.r_[True, code[1:] != code[:-1]]
    start, group = np.flatnonzero(new), np.cumsum(new) - 1
    low = np.empty(len(order), np.int64)
    low[order] = np.minimum.reduceat(lows[order], start)[group]
    stands = order[start][group]
    varied = np.zeros(len(start), bool)
    more = np.flatnonzero(~new)
    for a in range(0, len(more), BLOCK):
        part = more[a:a + BLOCK]
        part = part[(words[order[part]] != words[stands[part]]).any(1)]
        varied[group[part]] = True
        stands[part] = order[part]
    first = np.empty(len(order), np.int64)
    first[order] = np.where(varied[group], stands, -1)
    return low, first


def _compared(rows: np.ndarray, lows: np.ndarray, low: np.ndarray, first: np.ndarray,
              begins: np.ndarray) -> np.ndarray:
    """Merges the strings of codes that have several; writes the smallest documents of each to
    `low`. (string, place, document) in order, where a smaller document holds a part."""
    members = np.flatnonzero(first >= 0)
    if not len(members):
        return np.zeros((0, 3), np.int64)
    chosen = members[first[members] == members]
    cut = np.searchsorted(chosen, begins)
    at = [(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if a < b]
    order, new, code = [], [], []
    for stream, place, shared, text in merged([Rows(rows[chosen[a:b]]) for a, b in at]):
        order.append(at[stream][0] + place)
        new.append(not new or shared < len(text))
        code.append(len(new) == 1 or shared < 8)
    string = np.empty(len(chosen), np.int64)
    string[order] = np.cumsum(new) - 1
    string = string[np.searchsorted(chosen, first[members])]
    least = np.full(sum(new), NO_ID)
    np.minimum.at(least, string, lows[members])
    low[members] = least[string]
    found, place, document = _parts(
        rows[chosen[np.array(order)[new]]], (np.cumsum(code) - 1)[new], least)
    # All members that are such a string.
    by_string = np.argsort(string, kind="stable")
    begin = np.searchsorted(string[by_string], np.arange(len(least) + 1))
    hit, who = _each(begin[found], begin[found + 1])
    fewer = np.stack([members[by_string[who]], place[hit], document[hit]], 1)
    return fewer[np.argsort(fewer[:, 0], kind="stable")]


def _each(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each range, and the range of each."""
    n = end - begin
    range_ = np.repeat(np.arange(len(n)), n)
    return range_, begin[range_] + np.arange(len(range_)) - np.repeat(np.cumsum(n) - n, n)


def _parts(rows: np.ndarray, code: np.ndarray, least: np.ndarray) -> tuple:
    """For different strings, in order of their codes: string, place, and smallest document of those
    50-byte parts that a string of a smaller document with the same code holds too."""
    out = []
    for a, b in blocks(np.bincount(code).tolist(), BLOCK):
        x, y = np.searchsorted(code, [a, b])
        left, total = rows[x:y, 8].astype(np.int64), rows[x:y, 9].astype(np.int64)
        column = np.arange(ROW - HEAD)
        text = np.take_along_axis(rows[x:y], np.minimum(HEAD + np.where(
            column < left[:, None], column + (total - left)[:, None],
            column - left[:, None]), ROW - 1), 1)
        string, place = _each(np.zeros(y - x, np.int64), total - SPAN + 1)
        parts = np.zeros((len(string), SPAN + 6), np.uint8)
        parts[:, :SPAN] = sliding_window_view(text, SPAN, axis=1)[string, place]
        keys = np.concatenate([code[x:y][string, None].astype(np.uint64),
                               parts.view(np.uint64)], 1)
        order, new = _grouped(keys)
        start = np.flatnonzero(new)
        own = least[x:y][string]
        low = np.empty(len(order), np.int64)
        low[order] = np.minimum.reduceat(own[order], start)[np.cumsum(new) - 1]
        hit = np.flatnonzero(low < own)
        out.append((string[hit] + x, place[hit], low[hit]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _grouped(keys: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, and where the next ones begin: by a code of each
    row, and by all of the row should two different ones have the same code."""
    if codes is None:
        codes = mix((mix(keys) * POWERS.to(keys.shape[1])[0][:keys.shape[1]]).sum(
            1, dtype=np.uint64))
    order = np.argsort(codes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
    if (new[1:] & (codes[order[1:]] == codes[order[:-1]])).any():
        order = np.lexsort(keys.T)
        new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
    return order, new


def _verdicts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            own = _prepared(row)
            for _ in own.strings(bits):
                pass
            hits = sorted(row["hits"] or [], key=lambda h: h["range"])
            lows = [unpacked(h["low"]) for h in hits]
            low = np.concatenate([np.zeros(0, np.int64), *lows])
            edge = np.zeros(len(own.raw) + 1, np.int32)
            if len(low):
                ids = own.ids[own.doc]
                gone = (low + own.low)[own.string] < ids
                np.add.at(edge, own.first[gone], 1)
                np.add.at(edge, own.last[gone] + SPAN, -1)
                offsets = np.cumsum([0, *map(len, lows)])
                fewer = [np.frombuffer(h["fewer"], np.int64).reshape(-1, 3) for h in hits]
                string = np.concatenate([x[:, 0] + o for x, o in zip(fewer, offsets, strict=False)])
                place, document = np.concatenate(fewer)[:, 1:].T
                open_ = np.flatnonzero(~gone)
                open_ = open_[np.argsort(own.string[open_], kind="stable")]
                hit, who = _each(*(np.searchsorted(own.string[open_], string, side=side)
                                   for side in ("left", "right")))
                who = open_[who]
                less = document[hit] < ids[who]
                begin = (own.first[who] + place[hit])[less]
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + SPAN, -1)
            covered = np.cumsum(edge[:-1]) > 0
            for i in row["copies"] or []:
                if own.sizes[i] >= SPAN:
                    covered[own.begins[i]:own.ends[i]] = True
            yield _documents(own, covered)
    return run


def _documents(own: Run, covered: np.ndarray) -> pa.RecordBatch:
    spans, kept = [], []
    for a, b in zip(own.begins, own.ends, strict=True):
        mark = np.zeros(b - a + 2, np.int8)
        mark[1:-1] = covered[a:b]
        turn = np.diff(mark)
        spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(
            np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)])
        kept.append(own.raw[a:b][~covered[a:b]].tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array([None if i == NO_ID else i for i in own.ids.tolist()], pa.int64()),
         pa.array(own.sizes),
         pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
         pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, spans (begin and end of each maximal run of
    removed bytes) and kept, the other bytes as binary. Other columns of `docs` are left out.

    A byte is removed if a 50-byte string that covers it also starts in a document with a smaller
    doc_id; strings stay within documents, may overlap, and are judged on the input. Codes of 64
    bits choose which strings are compared; what is removed is decided on the bytes themselves, but
    for whole copies, which a SHA-256 digest finds.

    A null text is empty; texts below 50 bytes lose nothing. A null doc_id counts as larger than
    all others, and such rows don't strike one another. Rows with one doc_id are one document and
    don't strike one another. An empty table gives an empty one. `run_bytes` bounds what a task
    holds of the texts, but for a longer text, which is a run by itself; for a corpus of many
    terabytes it should be larger, so that the pieces that go from run to range don't get tiny.
    """
    library_path(docs.sparkSession)
    runs = materialize(_runs(docs, run_bytes), "runs")
    total = runs.agg(F.sum("bytes")).first()[0] or 0
    # About every tenth byte begins a record.
    bits = min(31, max(4, math.ceil(math.log2(max(1, total / 10 / RANGE_CODES)))))

    each = runs.select("run", F.posexplode(F.arrays_zip("ids", "digests")).alias("pos", "d")).select(
        "run", "pos", F.col("d.ids").alias("id"), F.col("d.digests").alias("digest"))
    firsts = materialize(
        each.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where("first < last").select("digest", "first"), "firsts")
    copies = each.join(firsts, "digest").where("id > first").groupBy("run").agg(
        F.collect_list("pos").alias("copies"))

    flags = materialize(
        _codes(runs, bits).repartition("range").sortWithinPartitions("range").mapInArrow(
            _recurring, "run long, range long, n long, returns binary, common binary"), "flags")
    by_run = flags.groupBy("run").agg(F.collect_list(
        F.struct("range", "n", "returns", "common")).alias("flags"))
    notes = materialize(
        runs.select("run").join(by_run, "run", "left").join(copies, "run", "left"), "notes")
    told = runs.select("run", "ids", "sizes", "body").join(notes, "run")
    hits = materialize(
        told.mapInArrow(_strings(bits), "range long, run long, shared binary, rest binary, "
                                        "low binary, body binary")
        .repartition("range").sortWithinPartitions("range")
        .mapInArrow(_merge, "run long, range long, low binary, fewer binary"), "hits")
    struck = hits.groupBy("run").agg(F.collect_list(
        F.struct("range", "low", "fewer")).alias("hits"))
    return told.join(struck, "run", "left").mapInArrow(
        _verdicts(bits), "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, "
                   "kept binary")
