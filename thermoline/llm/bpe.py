"""Byte-level BPE by a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from thermoline.llm.common import arrow_map, library_path, others

#: Bounds of what a worker remembers: pieces of text, and states of the transducer.
MAX_PIECES = 250_000
MAX_STATES = 150_000

#: After so many bytes without a certain token the live ways are compared for a common start.
LOOKAHEAD = 256


class Transducer:
    """Reads bytes, emits token ids: the encoding that merging by lowest rank first gives.

    Every prefix of a text has one encoding, and its last token `t` is the only token for which
    the encoding of what precedes it ends in a token that may stand before `t`. So after each byte
    the last token of the prefix follows from the live starts: positions from which a token may
    still reach further, each with its place in the trie of all tokens and the last token before
    it. The set of those pairs is the state. States and moves are made when text first needs them,
    kept, and made anew once there are more than MAX_STATES.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for i, t in self.tokens.items()}
        #: The trie of all tokens: by node and byte the child; by node the token that ends there,
        #: its depth, and whether tokens go on.
        self.child: dict[int, int] = {}
        self.ends, self.depth, self.inner = [-1], [0], [True]
        for token, rank in ranks.items():
            at = 0
            for b in token:
                self.inner[at] = True
                node = self.child.get(at << 8 | b)
                if node is None:
                    node = self.child[at << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[at] + 1)
                    self.inner.append(False)
                at = node
            self.ends[at] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.names: dict[tuple, int] = {}
        #: By state its live starts: node of the trie, and last token before the start plus one.
        self.live: list[tuple[int, ...]] = []
        #: By state and byte: the next state and the last token, each as one number.
        self.moves: dict[int, int] = {}
        #: By left and right token, as one number: whether they may stand side by side.
        self.may_follow: dict[int, bool] = {}
        self.state((0,))

    def state(self, live: tuple) -> int:
        name = self.names.get(live)
        if name is None:
            name = self.names[live] = len(self.live)
            self.live.append(live)
        return name

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens of which the last merge made `token`; None for a single byte."""
        if token not in self.halves:
            parts = [self.ranks[bytes([b])] for b in self.tokens[token]]
            while len(parts) > 2:
                pairs = [self.ranks.get(self.tokens[a] + self.tokens[b], token)
                         for a, b in zip(parts, parts[1:], strict=False)]
                best = min(pairs)
                if best >= token:
                    raise ValueError(f"no merges lead to token {token}")
                at = pairs.index(best)
                parts[at:at + 2] = [best]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def allowed(self, left: int, right: int) -> bool:
        """Whether the bytes of both together are encoded as just these two tokens.

        Undoing merges from the last, the two tokens that touch the border must at no time make a
        pair that would have been merged before. The younger merge is undone first; of equal ones
        the right one, as merging goes from the left.
        """
        get, tokens, split, limit = self.ranks.get, self.tokens, self.split, 1 << 62
        while True:
            joint = get(tokens[left] + tokens[right])
            if joint is not None and joint < limit:
                return False
            a, b = split(left), split(right)
            if b is None or (a is not None and left > right):
                if a is None:
                    return True
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def move(self, state: int, byte: int) -> int:
        child, ends, inner, known = self.child, self.ends, self.inner, self.may_follow
        last, live = -1, []
        for start in self.live[state]:
            node = child.get((start >> 20) << 8 | byte)
            if node is None:
                continue
            before, token = start & 0xFFFFF, ends[node]
            if last < 0 <= token:
                if before:
                    key = before << 20 | token
                    fits = known.get(key)
                    if fits is None:
                        fits = known[key] = self.allowed(before - 1, token)
                    if fits:
                        last = token
                else:
                    last = token
            if inner[node]:
                live.append(node << 20 | before)
        live.append(last + 1)
        return self.state(tuple(live)) << 20 | last

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece. What is certain goes out at the latest LOOKAHEAD bytes and one token
        behind the reading; `lasts` holds the last token of each prefix since then."""
        if len(self.live) > MAX_STATES:
            self.reset()
        moves, at, out, lasts = self.moves, 0, [], []
        for byte in data:
            key = at << 8 | byte
            step = moves.get(key)
            if step is None:
                step = moves[key] = self.move(at, byte)
            at = step >> 20
            lasts.append(step & 0xFFFFF)
            if len(lasts) > LOOKAHEAD:
                lasts = self.settle(at, lasts, out)
        tail, end = [], len(lasts)
        while end:
            tail.append(lasts[end - 1])
            end -= self.length[lasts[end - 1]]
        return out + tail[::-1]

    def settle(self, state: int, lasts: list[int], out: list[int]) -> list[int]:
        """Emits the tokens on which all live starts agree; returns what is open still."""
        depth = [len(lasts) - self.depth[start >> 20] for start in self.live[state]]
        chains = []
        for end in depth:
            ends = []
            while end > 0:
                ends.append(end)
                end -= self.length[lasts[end - 1]]
            chains.append(ends[::-1])
        agreed = []
        for ends in zip(*chains, strict=False):
            if len(set(ends)) > 1:
                break
            agreed.append(ends[0])
        for end in agreed:
            out.append(lasts[end - 1])
        return lasts[agreed[-1]:] if agreed else lasts


class Pieces(dict):
    """Packed ids of the pieces met so far."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode("utf-8", "replace"))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = packed
        return packed


class Utf8Stream:
    """An incremental UTF-8 state machine: text for the bytes so far, open sequences held back.

    The state is the unfinished sequence: its lead byte says how many bytes are due and, for the
    first of them, in which range. What cannot be completed becomes U+FFFD.
    """

    #: Fixed values of UTF-8: lead bytes, continuation bytes due, range of the first of these.
    LEADS = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF),
             (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF),
             (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]

    def __init__(self) -> None:
        self.held = b""

    @classmethod
    def open_sequence(cls, data: bytes) -> int:
        """How many bytes at the end of `data` begin a sequence that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            for low, high, due, first, last in cls.LEADS:
                if low <= lead <= high:
                    rest = data[len(data) - back + 1:]
                    fits = (not rest or first <= rest[0] <= last) and all(
                        0x80 <= b <= 0xBF for b in rest[1:])
                    return back if len(rest) < due and fits else 0
            if not 0x80 <= lead <= 0xBF:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = self.open_sequence(data)
        self.held = data[len(data) - n:]
        return data[:len(data) - n].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Coder:
    """Encoder and decoder of one vocabulary; the transducer is built when first needed."""

    def __init__(self, file: bytes, pattern: str) -> None:
        self.ranks = {}
        for line in file.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = ["�".encode()] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)

    @cached_property
    def pieces(self) -> Pieces:
        return Pieces(Transducer(self.ranks))

    def encode(self, text: str) -> bytes:
        if len(self.pieces) > MAX_PIECES:
            self.pieces.clear()
        get = self.pieces.__getitem__
        if len(text) < 1 << 20:
            return b"".join(map(get, self.pattern.findall(text)))
        parts, found = [], (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, 100_000)):
            parts.append(b"".join(map(get, some)))
        return b"".join(parts)

    def decode(self, packed: bytes) -> str:
        stream, ids, text = Utf8Stream(), np.frombuffer(packed, "<u4"), []
        known = len(self.tokens)
        for at in range(0, len(ids), 1 << 16):
            some = ids[at:at + (1 << 16)].tolist()
            text.append(stream.feed(b"".join(
                [self.tokens[i] if i < known else b"\xef\xbf\xbd" for i in some])))
        return "".join([*text, stream.close()])


_FILES: dict[str, bytes] = {}


@lru_cache(maxsize=2)
def _coder(digest: str, pattern: str) -> Coder:
    return Coder(_FILES[digest], pattern)


def coder(file: bytes, pattern: str) -> Coder:
    """One coder for each vocabulary and worker process; it is kept from task to task."""
    digest = hashlib.sha256(file).hexdigest()
    _FILES[digest] = file
    return _coder(digest, pattern)


def _mapped(docs: DataFrame, path: str, pattern: str, column: str, made: list[T.StructField],
            run: Callable[[Coder, list], list[pa.Array]]) -> DataFrame:
    library_path(docs.sparkSession)
    with open(path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    mine = docs.select(*others(docs, [f.name for f in made]))
    return arrow_map(mine, column, made, lambda _, values: run(
        coder(shared.value, pattern), values), portion=1 << 20)


IDS = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
DECODED = [T.StructField("decoded", T.StringType())]


def _encoded(own: Coder, texts: list) -> list[pa.Array]:
    ids = [own.encode(t) if t else b"" for t in texts]
    return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]


def _decoded(own: Coder, packed: list) -> list[pa.Array]:
    return [pa.array([own.decode(x) if x else "" for x in packed], pa.string())]


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """All columns with `ids` (binary: token ids as little-endian unsigned 32-bit integers) and
    `n_tokens`. `path` names a file of ranks in the driver's file system; its content goes to
    each executor once. `pattern` parts the text; each match is encoded by itself, as tiktoken's
    encode_ordinary does.

    Null and empty texts have no tokens. Rows are independent: nulls in other columns, repeated
    rows and empty tables make no difference. A text of any length takes memory in proportion to
    it; a single match is read byte by byte.
    """
    return _mapped(docs, path, pattern, column, IDS, _encoded)


def decode(encoded: DataFrame, path: str, pattern: str = "", column: str = "ids") -> DataFrame:
    """All columns with `decoded`, the text of `ids`. Ids without token become U+FFFD, as do bytes
    that are not UTF-8. Null ids give an empty text."""
    return _mapped(encoded, path, pattern, column, DECODED, _decoded)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """`decode` of `encode`, in one pass over the rows by the same workers."""
    def run(own: Coder, texts: list) -> list[pa.Array]:
        ids = _encoded(own, texts)
        return [*ids, *_decoded(own, ids[0].to_pylist())]

    return _mapped(docs, path, pattern, column, IDS + DECODED, run)
