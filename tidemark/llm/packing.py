"""Packing tokenised documents into sequences: best fit, then swap-based local search over the underfull bins."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, claim_cache

CACHED = 600_000  # chunks of text whose ids a worker keeps; others are encoded anew
_caches: dict[str, ChunkIds] = {}
BEYOND_LATIN = re.compile(r"[^\x00-\u024f]")
MARKED = re.compile(r"([^\W\d_]+)([^\w\s]+)")


class ChunkIds:
    """Ids of texts, chunk by chunk.

    The tokenizer turns white space into token borders, so the ids of a text are those of its space-separated chunks
    one after another. Chunks recur, so they are kept with their ids (little-endian 32-bit).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Chunks of letters only are single words: many are encoded in one call and told apart by word number."""
        words = [c for c in chunks if c.isalpha()]
        out = {c: _ids(self.tokenizer.encode(c, add_special_tokens=False).ids) for c in chunks if not c.isalpha()}
        for at in range(0, len(words), 100):
            part = words[at : at + 100]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            numbers = np.array(got.word_ids, np.int64)
            if len(numbers) == 0 or numbers[-1] != len(part) - 1 or (np.diff(numbers) > 1).any() or numbers[0] != 0:
                out |= {c: _ids(self.tokenizer.encode(c, add_special_tokens=False).ids) for c in part}
                continue
            ids, cuts = np.array(got.ids, "<u4"), np.flatnonzero(np.diff(numbers)) + 1
            cuts = [0, *cuts.tolist(), len(ids)]
            flat = ids.tobytes()
            out |= {c: flat[4 * a : 4 * b] for c, a, b in zip(part, cuts[:-1], cuts[1:], strict=True)}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_folded(t).replace("\n", " ").split(" ") for t in texts]
        known = self.known
        new = set().union(*split) - known.keys()
        marked = {c: m.groups() for c in new if (m := MARKED.fullmatch(c)) and not _combining(m[2]) and m[1].lower().isalpha() and (m[1].isascii() or unicodedata.is_normalized("NFC", m[1]))}  # a word and marks are two borders apart
        need = {c for c in new if c not in marked} | {p for parts in marked.values() for p in parts if p not in known}
        fresh = self._learn(list(need))
        both = lambda p: known[p] if p in known else fresh[p]
        fresh |= {c: both(a) + both(b) for c, (a, b) in marked.items()}
        for c, b in fresh.items():
            if len(known) >= CACHED:
                break
            if len(c) <= 40:
                known[c] = b
        if all(c in known for c in fresh):
            return [b"".join(map(known.__getitem__, s)) for s in split]
        return [b"".join([known[c] if c in known else fresh[c] for c in s]) for s in split]


def _combining(marks: str) -> bool:
    """Whether some may join what stands before them when the tokenizer composes them (NFC)."""
    return not marks.isascii() and any(unicodedata.category(c)[0] == "M" for c in marks)


def _folded(text: str) -> str:
    """Latin text in lower case, as the tokenizer has it: the same ids from fewer different chunks."""
    return text if "<|" in text or BEYOND_LATIN.search(text) else text.lower()


def _ids(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def chunk_ids(path: str) -> ChunkIds:
    """One per worker process and tokenizer file."""
    if path not in _caches:
        _caches[path] = ChunkIds(path)
    return _caches[path]


def _slices(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a megabyte."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and end_id, cut at every `capacity` ids.

    A null text is empty and gives one piece that holds end_id alone. ids is little-endian 32-bit binary.
    """
    fields = [pa.field("doc_id", pa.int64()), pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64())]
    schema = pa.schema([*fields, pa.field("ids", pa.binary())] if with_ids else fields)
    end = _ids([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_ids(tokenizer)
        claim_cache(encoder.known)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = texts.to_pylist()
            for a, b in _slices(sizes):
                rows = []
                for key, flat in zip(ids.slice(a, b - a).to_pylist(), encoder.encode(sizes[a:b]), strict=True):
                    flat += end
                    for piece, at in enumerate(range(0, len(flat), 4 * capacity)):
                        part = flat[at : at + 4 * capacity]
                        rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    columns = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).mapInArrow(run, columns)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest first, each into the fullest bin that has room for it."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0  # bit r is set where a bin has room r
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            b, room, n = n, capacity, n + 1
        bins[i] = b
        room -= size
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return bins


def best_filled(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: one bin after the other gets the largest item left and the others that fill it best.

    The sums that can be reached are the bits of one number, shifted by each length in turn until the bin can be full.
    """
    count = np.bincount(lengths, minlength=capacity + 1)
    kinds = np.flatnonzero(count)[::-1].tolist()
    pools = {x: np.flatnonzero(lengths == x).tolist() for x in kinds}
    bins, b = np.empty(len(lengths), np.int64), 0
    while kinds:
        first = kinds[0]
        room, sums, steps = capacity - first, 1, []
        for x in kinds:
            if x <= room:
                for _ in range(min(len(pools[x]) - (x == first), room // x)):
                    more = (sums | (sums << x)) & ((2 << room) - 1)
                    if more == sums:
                        break
                    steps.append((x, sums))
                    sums = more
            if sums >> room & 1:
                break
        left, taken = sums.bit_length() - 1, [first]
        for x, before in reversed(steps):
            if not before >> left & 1:
                taken.append(x)
                left -= x
        for x in taken:
            bins[pools[x].pop()] = b
        kinds, b = [x for x in kinds if pools[x]] if any(not pools[x] for x in taken) else kinds, b + 1
    return bins


def packed_bins(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: the search from best fit, and, where that stays above least_bins, the better of it and the search
    from best_filled."""
    bins = local_search(lengths, best_fit(lengths, capacity), capacity)
    if len(bins) and bins.max() + 1 > least_bins(lengths, capacity):
        other = local_search(lengths, best_filled(lengths, capacity), capacity)
        bins = other if other.max() < bins.max() else bins
    return bins


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the greatest, over k, of the bins that items over capacity - k need for themselves, and
    those that the items from k up to it need beside the room that the former leave (k up to half the capacity); and, over
    j, of a bin for every j items over capacity / (j + 1)."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    n, total = np.append(np.cumsum(count[::-1])[::-1], 0), np.append(np.cumsum((count * np.arange(capacity + 1))[::-1])[::-1], 0)  # of this length or longer
    k, half = np.arange(capacity // 2 + 1), capacity // 2 + 1
    wide = n[half]  # no two of these share a bin
    big = n[capacity - k + 1]
    middle = wide - big
    rest = total[k] - total[capacity - k + 1]  # k to capacity - k
    j = np.arange(1, capacity)
    return int(max((big + np.maximum(middle, -(-rest // capacity))).max(initial=0), (-(-n[capacity // (j + 1) + 1] // j)).max(initial=0)))


class _Exchanges:
    """Underfull bins and what they hold, by length: equal lengths are one kind.

    For each length, and each sum of two lengths that share a bin, a heap has the bins that hold it, emptiest first; a bin that
    has changed is entered anew and its old entries are passed over. Two numbers have a bit for each length and each sum that is
    held, so the greatest of them up to a limit is one look.
    """

    def __init__(self, lengths: list[int], bins: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        n = max(bins, default=-1) + 1
        self.fill, self.held = [0] * n, [{} for _ in range(n)]
        for item, (size, b) in enumerate(zip(lengths, bins, strict=True)):
            self.fill[b] += size
            self.held[b].setdefault(size, []).append(item)
        self.heaps: tuple[list[list], list[list]] = [[] for _ in range(capacity + 1)], [[] for _ in range(capacity + 1)]
        self.masks = [0, 0]  # of single items, of pairs
        for b in range(n):
            self.enter(b)

    def enter(self, b: int) -> None:
        fill, held = self.fill[b], self.held[b]
        if not 0 < fill < self.capacity:  # full bins take no part, and give nothing
            return
        kinds = sorted(held)
        for i, x in enumerate(kinds):
            heappush(self.heaps[0][x], (fill, b, x))
            self.masks[0] |= 1 << x
            for y in kinds[i if len(held[x]) > 1 else i + 1 :]:
                heappush(self.heaps[1][x + y], (fill, b, x))
                self.masks[1] |= 1 << (x + y)

    def giver(self, pair: int, size: int, taker: int) -> tuple[int, tuple[int, ...]] | None:
        """The emptiest other bin that holds a length, or a pair of that sum, and the lengths."""
        heap, own, found = self.heaps[pair][size], None, None
        while heap and found is None:
            fill, b, x = heap[0]
            held = self.held[b]
            if self.fill[b] != fill or x not in held or pair and (size - x not in held or 2 * x == size and len(held[x]) < 2):
                heappop(heap)
            elif b == taker:
                own = heappop(heap)
            else:
                found = b, (x, size - x) if pair else (x,)
        if own is not None:
            heappush(heap, own)
        elif not heap:
            self.masks[pair] &= ~(1 << size)
        return found

    def best(self, a: int) -> tuple[int, tuple[int, ...], int, tuple[int, ...]] | None:
        """(gain, what a gives, the other bin, what that gives): of all exchanges that raise the squared fills, a being the
        fuller one afterwards, one of greatest gain: a move, one for one, two for one or one for two."""
        fill, held = self.fill[a], self.held[a]
        room, top = self.capacity - fill, None
        kinds = sorted(held)
        singles = [(0, ()), *((x, (x,)) for x in kinds)]
        pairs = [(x + y, (x, y)) for i, x in enumerate(kinds) for y in kinds[i if len(held[x]) > 1 else i + 1 :]]
        for mine, kind in ((singles, 0), (singles[1:], 1), (pairs, 0)):
            for given, parts in mine:
                limit = given + room
                least = given + (top[0] if top else 0)
                while limit > least:
                    size = (self.masks[kind] & ((2 << limit) - 1)).bit_length() - 1
                    if size <= least:
                        break
                    other = self.giver(kind, size, a)
                    if other and fill + size - given > self.fill[other[0]]:
                        top = size - given, parts, *other
                        if size == given + room:
                            return top
                        break
                    limit = size - 1
        return top

    def exchange(self, a: int, gain: int, out: tuple[int, ...], b: int, back: tuple[int, ...]) -> None:
        for giver, taker, sizes in ((a, b, out), (b, a, back)):
            moved = []
            for x in sizes:
                items = self.held[giver][x]
                moved.append((x, items.pop()))
                if not items:
                    del self.held[giver][x]
            for x, item in moved:
                self.held[taker].setdefault(x, []).append(item)
        self.fill[a] += gain
        self.fill[b] -= gain
        self.enter(a)
        self.enter(b)


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Empties underfull bins by exchanges that raise the sum of squared fills, between any two of them.

    An underfull bin, the fullest first, gets what fills it best from another: an item without return, a larger one for one of its
    own, two for one, or one for two. The exchange that gains it most is made, from the emptiest bin that has what it needs, as
    long as the squared fills rise. A bin that all is taken from is gone. The search ends at least_bins, or when no bin has such
    an exchange. Every exchange raises the sum of squares by 2 or more, and it is capacity * the sum of lengths at most, so
    there is an end; each costs a look at the kinds and pairs of kinds of one bin, not at the other bins.
    """
    least = least_bins(lengths, capacity)
    state = _Exchanges(lengths.tolist(), bins.tolist(), capacity)
    alive, moved = sum(f > 0 for f in state.fill), True
    while moved and alive > least:
        moved = False
        for a in sorted((b for b, f in enumerate(state.fill) if 0 < f < capacity), key=lambda b: -state.fill[b]):
            while 0 < state.fill[a] < capacity and alive > least and (found := state.best(a)):
                state.exchange(a, *found)
                alive -= state.fill[found[2]] == 0
                moved = True
    out = np.empty(len(lengths), np.int64)
    for b, held in enumerate(state.held):
        for items in held.values():
            out[items] = b
    _, out = np.unique(out, return_inverse=True)
    return out


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = 50_000, ws: Workspace | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32), which are no longer than capacity.

    Pieces are dealt by hash into groups of about group_pieces, each packed in one task by best fit and local search; a
    group has many more pieces than a sequence holds, so a few groups' last, underfull sequences cost next to nothing.
    Repeated rows are packed each for itself; null ids are a key like any other; no piece gives no sequence.
    """
    ws = ws or Workspace(pieces.sparkSession, "pack")
    pieces = ws.save(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins = packed_bins(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        starts = ends - lengths[order]
        new = np.ones(len(order), bool)
        new[1:] = bins[order][1:] != bins[order][:-1]
        offset = np.empty(len(order), np.int64)
        offset[order] = starts - starts[new][np.cumsum(new) - 1]
        rows["sequence_id"], rows["offset"] = (int(key[0]) << 32) + bins, offset
        return rows.drop(columns="pack_group")

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def packed_sequences(pieces: DataFrame, placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(sequence_id, n_ids, ids): the sequences themselves, from pieces with ids and their places."""
    placed = placed.select("doc_id", "piece", "sequence_id", "offset")
    joined = pieces.join(placed, (pieces["doc_id"].eqNullSafe(placed["doc_id"])) & (pieces["piece"] == placed["piece"]))
    parts = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_ids"))
    return parts.select("sequence_id", "n_ids", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
