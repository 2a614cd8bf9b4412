"""Byte-level BPE by corpus-level merge replay.

Texts are split into pieces by the tokenizer's pattern. The distinct pieces of a run of texts that have no ids yet form one
vocabulary, and all of it is encoded together: an inverted index maps each token that a merge makes to the positions whose
token and next token merge into it, and merges are applied in rank order over the whole vocabulary, each touching only the
positions in its own posting and their neighbours. Texts are then the concatenation of their pieces' ids.

Ids equal those of encoding each piece separately by repeatedly merging the leftmost pair of lowest rank: where a merge
makes a pair of lower rank than its own, the rest of that piece's posting waits until the lower rank has been applied.

Memory is bounded whatever a text holds. A replay takes REPLAY_BYTES of pieces at most, however many of them a text has; a
piece longer than that is replayed in windows, whose seams are mended until each two neighbouring tokens encode to
themselves, which only the ids of the whole piece do: the first merge across the border of two tokens would also be made
where these two stand alone. Of the pieces whose ids are known, those in least use are forgotten once they are too many. What
remains is the text, its pieces' numbers since the last replay, and its ids.

The rank file is read on the driver and broadcast; its size is that of the vocabulary, not of the data. Texts are
encoded whole, batch by batch, without a shuffle.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import bound_batches, give_back

#: Bytes of pieces that are replayed together, at most.
REPLAY_BYTES = 1 << 20
#: Pieces that are read before it is seen whether a replay is due.
STRIDE = 1 << 15
#: Pieces, and bytes of them, whose ids a worker remembers, at most but for those of one stride.
KNOWN_PIECES, KNOWN_BYTES = 1 << 18, 1 << 23


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """All pairs of tokens that merge, as sorted arrays, and for each token the lowest rank of a pair that holds it."""

    NONE = 1 << 30

    def __init__(self, ranks: dict[bytes, int]):
        self.span = max(ranks.values()) + 1
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        found = [(ranks[t[:k]] * self.span + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        keys, made = np.array(sorted(found), np.int64).reshape(-1, 2).T
        self.keys, self.made = np.append(keys, np.iinfo(np.int64).max), np.append(made, self.NONE).astype(np.int32)
        self.low = np.full(self.span, self.NONE)
        for part in (keys // self.span, keys % self.span):
            np.minimum.at(self.low, part, made)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair merges into, or NONE."""
        key = np.int64(self.span) * left + right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.made[at], np.int32(self.NONE))


def replay(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """All pieces' ids, one after another, and how many each has, by applying every merge to all of them in rank order."""
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array(list(map(len, pieces)), np.int64)
    token = merges.single[flat]
    if (token < 0).any():
        raise ValueError("the vocabulary lacks a single byte that occurs in the text")
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    after, before = np.arange(1, len(flat) + 1, dtype=np.int32), np.arange(-1, len(flat) - 1, dtype=np.int32)
    ends = np.cumsum(lengths)
    filled = lengths > 0
    after[ends[filled] - 1], before[(ends - lengths)[filled]] = -1, -1
    current = np.full(len(flat), merges.NONE, np.int32)  # of each position's pair with the next
    left = np.flatnonzero(after >= 0).astype(np.int32)
    current[left] = merges.rank(token[left], token[left + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def post(at: np.ndarray) -> None:
        rank = current[at]
        at, rank = at[rank < merges.NONE], rank[rank < merges.NONE]
        if len(at) > 1:
            order = rank.argsort(kind="stable")
            at, rank = at[order], rank[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
        else:
            cuts = [0, len(at)] if len(at) else []
        for r, a, b in zip(rank[cuts[:-1]].tolist(), cuts, cuts[1:]):
            if r in index:
                index[r].append(at[a:b])
            else:
                index[r] = [at[a:b]]
                heapq.heappush(heap, r)

    post(left)
    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank)
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        at = at[current[at] == rank]
        if len(at) > 1:
            at.sort()
            if merges.low[rank] < rank:  # a lower rank may come up in the piece: the first place only
                first = np.append(True, owner[at[1:]] != owner[at[:-1]])
                if not first.all():
                    index[rank] = [at[~first]]
                    heapq.heappush(heap, rank)
                    at = at[first]
            else:
                same = at[1:] == at[:-1]
                if same.any():
                    at = at[np.append(True, ~same)]
                chained = after[at[:-1]] == at[1:]
                if chained.any():  # of overlapping places, every other one
                    place = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(np.append(False, chained), 0, place))
                    at = at[(place - start) % 2 == 0]
        if not len(at):
            continue
        right = after[at]
        beyond = after[right]
        token[at], token[right] = rank, -1
        after[at] = beyond
        current[at] = current[right] = merges.NONE
        inner = beyond >= 0
        left, beyond = at[inner], beyond[inner]
        before[beyond] = left
        current[left] = merges.rank(rank, token[beyond])
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        current[ahead] = merges.rank(token[ahead], rank)
        post(np.concatenate([left, ahead]))
    live = token >= 0
    return token[live], np.bincount(owner[live], minlength=len(pieces))


class Pieces(dict):
    """Numbers pieces in the order of their first look-up; ``new`` holds those numbered since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        self.new.append(piece)
        return at


class Encoder:
    """Encodes texts, and decodes ids, one worker's tasks after another."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, replay_bytes: int = REPLAY_BYTES, stride: int = STRIDE, known: tuple[int, int] = (KNOWN_PIECES, KNOWN_BYTES)):
        self.ranks, self.merges, self.pattern = ranks, Merges(ranks), regex.compile(pattern)
        self.replay_bytes, self.stride, self.known = replay_bytes, stride, known
        self.spelling = Spelling(ranks)
        self.pieces, self.size = Pieces(), 0
        self.ids, self.counts, self.uses = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _forget(self) -> None:
        """Keeps the pieces in most use, half of what may be known."""
        most = np.argsort(-self.uses, kind="stable")[: self.known[0] // 2]
        keep = np.zeros(len(self.uses), bool)
        keep[most] = True
        names = [piece for piece, stays in zip(self.pieces, keep) if stays]
        lengths = np.array([len(x.encode()) for x in names], np.int64)
        if lengths.sum() > self.known[1] // 2:
            names, keep, lengths = [], np.zeros(len(keep), bool), lengths[:0]
        self.ids, self.counts, self.uses = self.ids[np.repeat(keep, self.counts)], self.counts[keep], self.uses[keep] // 2
        self.pieces, self.size = Pieces(), int(lengths.sum())
        self.pieces.update(zip(names, range(len(names))))

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The int32 ids of each text; none for null."""
        out: list[list[np.ndarray]] = []
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0

        def settle() -> None:
            self._learn()
            starts = np.cumsum(self.counts) - self.counts
            for k, numbers in waiting:
                self.uses += np.bincount(numbers, minlength=len(self.uses))
                n = self.counts[numbers]
                ends = np.cumsum(n)
                out[k].append(self.ids[np.repeat(starts[numbers] - ends + n, n) + np.arange(ends[-1])])
            waiting.clear()
            if len(self.pieces) > self.known[0] or self.size > self.known[1]:
                self._forget()

        for k, text in enumerate(texts):
            out.append([])
            found = iter(self.pattern.findall(text or "")) if len(text or "") <= self.stride else (m[0] for m in self.pattern.finditer(text))
            while True:
                have = len(self.pieces.new)
                numbers = np.fromiter(map(self.pieces.__getitem__, islice(found, self.stride)), np.int32)
                if not len(numbers):
                    break
                waiting.append((k, numbers))
                held += sum(map(len, self.pieces.new[have:])) + len(numbers)
                if held > self.replay_bytes:
                    settle()
                    held = 0
        settle()
        return [parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.int32), *parts]) for parts in out]

    def _learn(self) -> None:
        """Replays the new pieces, in groups of bounded size, and remembers their ids."""
        ids, counts, group, size = [self.ids], [self.counts], [], 0

        def flush() -> None:
            nonlocal size
            if group:
                for known, found in zip((ids, counts), replay(group, self.merges)):
                    known.append(found)
                group.clear()
                size = 0

        for piece in map(str.encode, self.pieces.new):
            if size + len(piece) > self.replay_bytes:
                flush()
            if len(piece) > self.replay_bytes:
                ids.append(self.long_piece(piece))
                counts.append(np.array([len(ids[-1])]))
            else:
                group.append(piece)
                size += len(piece)
            self.size += len(piece)
        flush()
        self.pieces.new.clear()
        self.ids, self.counts = np.concatenate(ids), np.concatenate(counts)
        self.uses = np.append(self.uses, np.zeros(len(self.counts) - len(self.uses), np.int64))

    def long_piece(self, piece: bytes) -> np.ndarray:
        """The ids of one piece, replayed window by window; each seam is replayed with ever more tokens on the side that
        does not hold, until both do."""
        done: list[np.ndarray] = []  # all but the last are final unless a seam reaches back to them
        for a in range(0, len(piece), self.replay_bytes):
            right = replay([piece[a : a + self.replay_bytes]], self.merges)[0]
            back, ahead = 1, 1
            while done and len(right):
                while len(done) > 1 and len(done[-1]) <= back:
                    done[-2:] = [np.concatenate(done[-2:])]
                left = done[-1]
                back, ahead = min(back, len(left)), min(ahead, len(right))
                middle = replay([self.spelling.bytes_of(np.concatenate([left[len(left) - back :], right[:ahead]]))], self.merges)[0]
                before, after = back == len(left) or self._apart(left[-back - 1], middle[0]), ahead == len(right) or self._apart(middle[-1], right[ahead])
                if before and after:
                    done[-1], right = left[: len(left) - back], np.concatenate([middle, right[ahead:]])
                    break
                back, ahead = back * (1 if before else 2), ahead * (1 if after else 2)
            done.append(right)
        return np.concatenate(done)

    def _apart(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves."""
        return replay([self.spelling.bytes_of(np.array([left, right]))], self.merges)[0].tolist() == [left, right]


class Spelling:
    """The bytes of each token, as one array."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.flat, self.lengths = np.frombuffer(b"".join(tokens), np.uint8), np.array(list(map(len, tokens)), np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def known(self, ids: np.ndarray) -> np.ndarray:
        inside = (ids >= 0) & (ids < len(self.lengths))
        return inside & (self.lengths[np.where(inside, ids, 0)] > 0)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The bytes that ids of the vocabulary stand for, spelt in portions."""
        parts = []
        for k in range(0, len(ids), STRIDE):
            n = self.lengths[part := ids[k : k + STRIDE]]
            ends = np.cumsum(n)
            parts.append(self.flat[np.repeat(self.starts[part] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)


#: A worker's encoder by (path, pattern); a worker serves many tasks.
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str, ranks: dict[bytes, int]) -> Encoder:
    found = _ENCODERS.get((path, pattern))
    if found is None or found.ranks != ranks:
        _ENCODERS.clear()
        found = _ENCODERS[path, pattern] = Encoder(ranks, pattern)
    return found


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    values = pa.array(np.concatenate([*arrays, np.empty(0, np.int32)]), kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _coded(docs: DataFrame, path: str, pattern: str, text_col: str, decoded: bool) -> Column:
    """The ids of each text, or a struct of them and of the bytes that they decode to; one worker does both."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(texts: pa.Array) -> pa.Array:
        encoder = _encoder(path, pattern, shared.value)
        ids = encoder.encode(x.as_py() for x in texts)
        out = lists(ids, pa.int32())
        if decoded:
            out = pa.StructArray.from_arrays([out, pa.array(map(encoder.spelling.bytes_of, ids), pa.binary())], ["ids", "bytes"])
        del ids, texts
        give_back()
        return out

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    kind: T.DataType = T.ArrayType(T.IntegerType())
    if decoded:
        kind = T.StructType().add("ids", kind).add("bytes", T.BinaryType())
    return F.arrow_udf(run, kind)(F.col(text_col).cast("string"))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs and a column ``out`` array<int> of token ids; an empty array for a null or empty text.

    path: a rank file on the driver. Special tokens are ordinary text. Rows and other columns stay as they are, repeated rows
    and null ids too; a column that was called ``out`` is replaced. An empty table gives no rows.
    """
    return docs.withColumn(out, _coded(docs, path, pattern, text_col, False))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "coded") -> DataFrame:
    """docs and a column ``out`` struct<ids array<int>, bytes binary>: what encode, and then decode, give, by one worker.

    Otherwise as encode.
    """
    return docs.withColumn(out, _coded(docs, path, pattern, text_col, True))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """docs and a binary column ``out`` of the bytes that the ids stand for; empty for null or no ids.

    Null where an id is null or not in the vocabulary. Rows and other columns stay as they are; a column that was called
    ``out`` is replaced. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    made: list[Spelling] = []

    def bytes_of(column: pa.Array) -> pa.Array:
        if not made:
            made.append(Spelling(shared.value))
        ids = [np.asarray(x.values.fill_null(-1)) if x.is_valid else np.empty(0, np.int32) for x in column]
        return pa.array([made[0].bytes_of(x) if made[0].known(x).all() else None for x in ids], pa.binary())

    bytes_of.__annotations__ = {"column": pa.Array, "return": pa.Array}
    # The coalesce also keeps Spark from chaining this to the UDF that made the ids, which would then run twice.
    ids = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    return docs.withColumn(out, F.arrow_udf(bytes_of, T.BinaryType())(ids))
