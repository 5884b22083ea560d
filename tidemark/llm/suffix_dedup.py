"""Removal of passages that repeat: byte strings of a given length, sorted as suffixes by a deep-shallow sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import KeyFilter, Workspace, forget_shuffles, released, shuffle_partitions
from tidemark.llm.shingles import M3, PLACE, scrambled

GRAM = 24  # bytes of the grams whose least hash names a window
PART = 1 << 20  # bytes of text whose runs are found at once; longer texts are cut there, windows overlapping the cut
PLACE_BITS = np.uint64(21)  # places within a part
HELD = 1_000_000  # runs that a map task combines at once
HEAVY = 1000  # runs of one name beyond which they are dealt window by window
SORTED = 2_000_000  # windows that a task sorts at once
SHALLOW = 3  # 8-byte characters that multikey quicksort takes before blind tries begin
TRIE = 32  # strings in a blind trie; larger groups of ties stay with multikey quicksort
ALONE, SHARED, ASKED, FOUND = range(4)
RUNS = pa.schema([("deal", pa.int64()), ("kind", pa.int32()), ("name", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("span", pa.int64())])
JUDGED = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("span", pa.int64()), ("name", pa.int64())])
PLACED = pa.schema([("route", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("span", pa.int64()), ("body", pa.binary())])
FORM = (1 << 20) - 1


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _words(data: np.ndarray, count: int) -> np.ndarray:
    """The 8-byte words that start at each byte (little-endian)."""
    return np.ndarray((count,), "<u8", data, strides=(1,))


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes at each position; size is a multiple of 4."""
    n = len(data) - size + 1
    w, x = _words(data, len(data) - 7), np.zeros(n, np.uint64)
    for i, at in enumerate([*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]):
        x = (x ^ w[at : at + n]) * PLACE[i % 5]
        x ^= x >> np.uint64(29)
    return scrambled(x + M3)


def packed(start, count, lead=0):
    """A run as one number: its first window, the number of windows, and where its least gram lies after that start."""
    return (start << 20) | (count << 8) | lead


def runs(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, first windows, numbers of windows and leads of the runs in texts that lie one after another in data.

    A run: windows of `width` bytes, one after another, that have their least gram hash, the leftmost of equal ones, at the
    same place. Equal windows have it at the same distance from their start, so a name and that distance (the lead less the
    window's place in the run) are equal for equal windows. Windows don't cross the ends of texts.
    """
    grams = _hashes(data, GRAM)
    least, have, need = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64), 1, width - GRAM + 1
    while have < need:
        step = min(have, need - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    place = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    valid = np.ones(len(place), bool)
    for e in ends[:-1].tolist():
        valid[max(0, e - width + 1) : e] = False
    fresh = np.concatenate([[True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])])
    start = np.flatnonzero(fresh)
    count = np.diff(np.append(start, len(place)))
    mine = valid[start]
    start, count = start[mine], count[mine]
    return grams[place[start]], start, count, place[start] - start


def deep_shallow(data: np.ndarray, at: np.ndarray, width: np.ndarray, group: np.ndarray, shallow: int = SHALLOW, trie: int = TRIE) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings of `width` bytes at `at` within their groups: the order by (group, bytes), and for each place in it
    whether the string differs from the one before. Strings of a group are equally long, 8 bytes or more.

    Shallow: multikey quicksort on 8-byte characters. Every group is parted around a pivot into less, equal and greater;
    the equal part goes on with the next character, until strings tie on `shallow` of them. Deep: what still ties goes into
    blind tries, one a group (groups over `trie` strings stay with quicksort until they are smaller). All groups take each
    step together, as numpy operations.
    """
    words = _words(data, len(data) - 7)
    last, full = width - 8, -(-width // 8)

    def char(which: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return words[at[which] + np.minimum(8 * depth, last[which])].byteswap()  # big-endian: numbers compare as bytes do

    order = np.argsort(group, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = group[order][1:] != group[order][:-1]
    begin = np.flatnonzero(new)
    size, depth = np.diff(np.append(begin, len(order))), np.zeros(len(begin), np.int64)
    ties: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        more = (size > 1) & (depth < full[order[begin]]) if len(begin) else np.zeros(0, bool)
        begin, size, depth = begin[more], size[more], depth[more]
        deep = (depth >= shallow) & (size <= trie)
        if deep.any():
            ties.append((begin[deep], size[deep], depth[deep]))
            begin, size, depth = begin[~deep], size[~deep], depth[~deep]
        if not len(begin):
            break
        begin, size, depth = _part(char, order, begin, size, depth)
        new[begin] = True
    if ties:
        begin, size, depth = (np.concatenate(x) for x in zip(*ties, strict=True))
        low = 2
        while low <= trie:
            high = min(2 * low - 1 if low > 2 else 2, trie)
            mine = np.flatnonzero((size >= low) & (size <= high))
            step = max(1, 400_000 // high)
            for part in (mine[a : a + step] for a in range(0, len(mine), step)):
                cols = np.arange(high)
                places = begin[part, None] + np.minimum(cols, size[part, None] - 1)
                members = order[places]
                leaf, lcp = _tries(char, members, size[part], depth[part], full[members[:, 0]])
                real = cols < size[part, None]
                order[places[real]] = leaf[real]
                differs = real[:, 1:] & (lcp[:, : high - 1] < full[members[:, 0], None])
                new[places[:, 1:][differs]] = True
            low = high + 1
    return order, new


def _part(char, order: np.ndarray, begin: np.ndarray, size: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step of multikey quicksort in every group: the begins, sizes and depths of its three parts."""
    of = np.repeat(np.arange(len(begin)), size)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    places = begin[of] + inside
    items = order[places]
    c = char(items, depth[of])
    a, b, z = (char(order[begin + x], depth) for x in (0 * size, size // 2, size - 1))
    pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), z))[of]
    side = (c >= pivot).astype(np.int8) + (c > pivot)
    counts = np.bincount(of * 3 + side, minlength=3 * len(begin)).reshape(-1, 3)
    starts = begin[:, None] + np.cumsum(counts, 1) - counts
    for k in range(3):
        mine = np.flatnonzero(side == k)
        rank = np.arange(len(mine)) - np.repeat(np.cumsum(counts[:, k]) - counts[:, k], counts[:, k])
        order[starts[of[mine], k] + rank] = items[mine]
    some = counts > 0
    return starts[some], counts[some], (depth[:, None] + np.array([0, 1, 0]))[some]


def _tries(char, member: np.ndarray, size: np.ndarray, depth: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blind tries, one a row of `member` (its first `size` items, which tie on `depth` characters of `full`): the leaves in
    order, and the number of characters that each shares with the next.

    A trie is held as its leaves and those numbers: the leaves of a node are neighbours, and the least number between them
    is the character that the node branches on. An item goes down blindly, by the branching characters alone; it is
    compared once, with the leaf it comes to, and enters where the first difference puts it.
    """
    n, k = member.shape
    leaf, lcp = member.copy(), np.full((n, k), -1)
    cols = np.arange(k)
    for r in range(1, k):
        rows = np.flatnonzero(size > r)
        if not len(rows):
            break
        x, near, shared, whole = member[rows, r], leaf[rows, :r], lcp[rows, :r], full[rows]
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), r)
        down = np.arange(len(rows)) if r > 1 else np.empty(0, np.int64)
        while len(down):
            between = (cols[:r] >= lo[down, None]) & (cols[:r] < hi[down, None] - 1)
            branch = np.where(between, shared[down], 1 << 30).min(1)
            open_ = branch < whole[down]
            down, branch = down[open_], branch[open_]
            if not len(down):
                break
            mine = (cols[:r] >= lo[down, None]) & (cols[:r] < hi[down, None])
            same = mine & (char(near[down], branch[:, None]) == char(x[down], branch)[:, None])
            some = same.any(1)
            down, same = down[some], same[some]
            lo[down] = same.argmax(1)
            hi[down] = lo[down] + same.sum(1)
        reached = near[np.arange(len(rows)), lo]
        first, at, left = whole.copy(), depth[rows].copy(), np.arange(len(rows))
        while len(left):
            differs = char(x[left], at[left]) != char(reached[left], at[left])
            first[left[differs]] = at[left[differs]]
            left = left[~differs]
            at[left] += 1
            left = left[at[left] < whole[left]]
        low = shared < first[:, None]
        a = np.where(low & (cols[:r] < lo[:, None]), cols[:r] + 1, 0).max(1)
        b = np.where(low & (cols[:r] >= lo[:, None]) & (cols[:r] < r - 1), cols[:r] + 1, r).min(1)
        node = (cols[:r] >= a[:, None]) & (cols[:r] < b[:, None])
        depth_at = np.minimum(first, whole - 1)
        less = node & (char(near, depth_at[:, None]) < char(x, depth_at)[:, None])
        pos = np.where(first < whole, a + less.sum(1), b)[:, None]
        take = np.where(cols[: r + 1] < pos, cols[: r + 1], cols[: r + 1] - 1)
        moved = np.take_along_axis(near, np.minimum(take, r - 1), 1)
        leaf[rows, : r + 1] = np.where(cols[: r + 1] == pos, x[:, None], moved)
        old = np.take_along_axis(shared, np.clip(np.where(cols[:r] < pos, cols[:r], cols[:r] - 1), 0, r - 1), 1)
        before = np.take_along_axis(shared, np.clip(pos - 1, 0, r - 1), 1)
        old = np.where(cols[:r] == pos - 1, np.where(pos > a[:, None], first[:, None], before), old)
        lcp[rows, :r] = np.where(cols[:r] == pos, np.where(pos < b[:, None], first[:, None], before), old)
    return leaf, lcp


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """Equal rows of keys have equal numbers, from 0."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _firsts(same: np.ndarray, doc: np.ndarray, start: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items with equal numbers `same`: those at the first place (doc, start), once a tag, and those at later places."""
    many = np.flatnonzero(np.bincount(same)[same] > 1)
    order = many[np.lexsort((tag[many], start[many], doc[many], same[many]))]
    s, d, p, t = same[order], doc[order], start[order], tag[order]
    new = np.ones(len(order), bool)
    new[1:] = s[1:] != s[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
    later = (d != d[head]) | (p != p[head])
    again = np.zeros(len(order), bool)
    again[1:] = ~new[1:] & ~later[1:] & (t[1:] == t[:-1])
    keep = np.ones(len(same), bool)
    keep[order[later | again]] = False
    return np.flatnonzero(keep), order[later]


def _equal_runs(data: np.ndarray, at: np.ndarray, route: np.ndarray, span: np.ndarray, width: int) -> np.ndarray:
    """Numbers that are equal for runs with equal bytes (and route and lead), by the deep-shallow sort of the runs."""
    form = span & FORM
    order, new = deep_shallow(data, at, (form >> 8) + width - 1, _numbered(form, route))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _batches(schema: pa.Schema, *columns) -> Iterator[pa.RecordBatch]:
    n = max((len(c) for c in columns if c is not None), default=0)
    for a in range(0, n, 65_536):
        size = min(65_536, n - a)
        yield pa.RecordBatch.from_arrays([pa.nulls(size, f.type) if c is None else pa.array(c[a : a + size], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _emit_runs(width: int):
    """The runs of all texts, some at a time. Of runs with equal bytes only the first goes on; the others surely repeat it
    (FOUND). A name that several contents have here is known to be shared: its runs are ASKED for, and one SHARED row tells
    the other tasks. A name with one run is ALONE so far."""

    def flush(held: list[tuple], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        data = np.concatenate(texts)
        name, doc, tag, span, at = (np.concatenate([x[i] for x in held]) for i in range(5))
        own, met = np.unique(name, return_inverse=True)
        keep, later = np.arange(len(name)), np.empty(0, np.int64)
        often = np.flatnonzero(np.bincount(met)[met] > 1)
        if len(often):
            same = _equal_runs(data, at[often], met[often], span[often], width)
            first, found = _firsts(same, doc[often], span[often] >> 20, tag[often])
            lone = np.ones(len(name), bool)
            lone[often] = False
            keep, later = np.sort(np.concatenate([np.flatnonzero(lone), often[first]])), np.sort(often[found])
        count = np.bincount(met[keep], minlength=len(own))
        shared = count[met[keep]] > 1
        alone, asked, told = keep[~shared], keep[shared], np.flatnonzero(count > 1)
        spread = lambda i: scrambled(doc[i].view(np.uint64) * M3 + span[i].view(np.uint64)).view(np.int64)
        kind = lambda x, i: np.full(len(i), x, np.int32)
        yield from _batches(RUNS, name[alone], kind(ALONE, alone), None, doc[alone], tag[alone], span[alone])
        yield from _batches(RUNS, own[told], kind(SHARED, told), None, None, None, None)
        yield from _batches(RUNS, spread(asked), kind(ASKED, asked), name[asked], doc[asked], tag[asked], span[asked])
        yield from _batches(RUNS, spread(later), kind(FOUND, later), None, doc[later], tag[later], span[later])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        texts: list[np.ndarray] = []
        part: list[tuple] = []
        size = total = n = 0

        def take() -> None:
            nonlocal part, size, total, n
            data = np.concatenate([np.frombuffer(p[3], np.uint8) for p in part])
            lengths = np.array([len(p[3]) for p in part])
            ends = np.cumsum(lengths)
            name, start, count, lead = runs(data, ends, width)
            text = np.searchsorted(ends, start, "right")
            inside = start - (ends - lengths)[text] + np.array([p[2] for p in part])[text]
            held.append((name.view(np.int64), np.array([p[0] for p in part])[text], np.array([p[1] for p in part])[text], packed(inside, count, lead), start + total))
            texts.append(data)
            n, total, part, size = n + len(name), total + len(data), [], 0

        for batch in batches:
            for doc, tag, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                view = memoryview(body.as_buffer())
                for a in range(0, len(view) - width + 1, PART - width + 1):
                    piece = view[a : a + PART]
                    if part and size + len(piece) > PART:
                        take()
                    part.append((doc, tag, a, piece))
                    size += len(piece)
                if n >= HELD:
                    yield from flush(held, texts)
                    held, texts, n, total = [], [], 0, 0
        if part:
            take()
        if held:
            yield from flush(held, texts)

    return run


def _judge_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A run that is alone in its task is asked for where its name is met again; what is known passes through (name null:
    found)."""
    held = []
    for b in batches:
        kind = b.column(1).to_numpy()
        if (kind >= ASKED).any():
            yield b.filter(pa.array(kind >= ASKED)).select(["doc", "tag", "span", "name"])
        rest = b.filter(pa.array(kind < ASKED))
        held.append((rest.column(1).to_numpy(), rest.column(0).to_numpy(), *(pc.fill_null(rest.column(i), 0).to_numpy() for i in (3, 4, 5))))
    if held:
        kind, name, doc, tag, span = (np.concatenate(x) for x in zip(*held, strict=True))
        _, met = np.unique(name, return_inverse=True)
        asked = np.flatnonzero((kind == ALONE) & (np.bincount(met)[met] > 1)) if len(name) else np.empty(0, np.int64)
        yield from _batches(JUDGED, doc[asked], tag[asked], span[asked], name[asked])


def _emit_texts(width: int):
    """The bytes of the runs asked for. Runs of a heavy name go window by window, dealt by a hash of the bytes; of equal
    windows in this partition only the first goes on, the others are passed through as found (body null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        out: list[list] = [[] for _ in PLACED]
        before = None

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PLACED, strict=True)], schema=PLACED)
            for column in out:
                column.clear()
            return made

        def add(*row) -> None:
            for column, x in zip(out, row, strict=True):
                column.append(x)

        for batch in batches:
            docs, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            asked = batch.column(3)
            offsets, items = asked.offsets.to_numpy(), asked.values
            spans, names = items.field(0).to_numpy(zero_copy_only=False), items.field(1).to_numpy(zero_copy_only=False)
            heavy = items.field(2).to_numpy(zero_copy_only=False)
            for i, (doc, tag) in enumerate(zip(docs, tags, strict=True)):
                if (doc, tag) == before:  # a repeated row
                    continue
                before = doc, tag
                mine = slice(offsets[i], offsets[i + 1])
                body, s, route, hot = batch.column(2)[i].as_py(), spans[mine], names[mine], heavy[mine]
                plain = ~hot.astype(bool)
                start, count = (s >> 20).tolist(), (s >> 8 & 0xFFF).tolist()
                cut = [body[a : a + c + width - 1] for a, c, p in zip(start, count, plain.tolist(), strict=True) if p]
                k = len(cut)
                for column, x in zip(out, (route[plain].tolist(), [doc] * k, [tag] * k, s[plain].tolist(), cut), strict=True):
                    column.extend(x)
                if k < len(s):
                    hashes = _hashes(np.frombuffer(body, np.uint8), width).view(np.int64)
                    for j in np.flatnonzero(~plain).tolist():
                        for p in range(start[j], start[j] + count[j]):
                            window, place = body[p : p + width], (doc, p)
                            known = seen.setdefault(window, place) if len(seen) < 200_000 else seen.get(window, place)
                            if known < place:
                                add(int(hashes[p]) ^ hash(place), doc, tag, packed(p, 1), None)
                                continue
                            if known > place:
                                seen[window] = place
                            add(int(hashes[p]), doc, tag, packed(p, 1), window)
                if len(out[0]) >= 16_384:
                    yield batch_of()
        if out[0]:
            yield batch_of()

    return run


def _judge_texts(width: int):
    """Windows equal to an earlier one: of equal runs the first stays, and where a route has several left, the windows at
    the same distance from the least gram are sorted."""

    def judged(route, doc, tag, span, bodies: pa.Array) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(bodies.buffers()[2], np.uint8)
        at = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies)].astype(np.int64)
        first, later = _firsts(_equal_runs(data, at, route, span, width), doc, span >> 20, tag)
        yield from _batches(JUDGED, doc[later], tag[later], span[later], None)
        _, met = np.unique(route[first], return_inverse=True)
        first = first[np.bincount(met)[met] > 1] if len(first) else first
        if not len(first):
            return
        count, lead = span[first] >> 8 & 0xFFF, span[first] & 0xFF
        of = np.repeat(first, count)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        group = _numbered(np.repeat(lead, count) - inside, route[of])
        again = np.flatnonzero(np.bincount(group)[group] > 1)
        of, inside, group = of[again], inside[again], group[again]
        order, new = deep_shallow(data, at[of] + inside, np.full(len(of), width), group)
        same = np.empty(len(of), np.int64)
        same[order] = np.cumsum(new)
        _, found = _firsts(same, doc[of], (span[of] >> 20) + inside, tag[of])
        by = found[np.lexsort((inside[found], of[found]))]  # neighbours in a run are one span
        if len(by):
            fresh = np.concatenate([[True], (of[by][1:] != of[by][:-1]) | (inside[by][1:] != inside[by][:-1] + 1)])
            begin = np.flatnonzero(fresh)
            long = np.diff(np.append(begin, len(by)))
            head = by[begin]
            yield from _batches(JUDGED, doc[of[head]], tag[of[head]], packed((span[of[head]] >> 20) + inside[head], long), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        route, doc, tag, span = (rows.column(c).to_numpy() for c in ("route", "doc", "tag", "span"))
        bodies = rows.column("body")
        done = pc.is_null(bodies).to_numpy()
        yield from _batches(JUDGED, doc[done], tag[done], span[done], None)
        order = np.argsort(route, kind="stable")
        order = order[~done[order]]
        size = np.cumsum(span[order] >> 8 & 0xFFF)
        edges = [*(np.flatnonzero(route[order][1:] != route[order][:-1]) + 1).tolist(), len(order)] if len(order) else []
        at = taken = 0
        for e in edges:
            if e > at and (size[e - 1] - taken >= SORTED or e == len(order)):
                part = order[at:e]
                chunk = bodies.take(pa.array(part)).combine_chunks()
                yield from judged(route[part], doc[part], tag[part], span[part], chunk.chunk(0) if isinstance(chunk, pa.ChunkedArray) else chunk)
                at, taken = e, int(size[e - 1])

    return run


OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 200):
                part, rows = batch.slice(low, 200), []
                for key, body, spans in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    s = np.sort(np.array(spans or [], np.int64))
                    start = s >> 20
                    end = start + (s >> 8 & 0xFFF) + width - 1
                    reach = np.maximum.accumulate(end) if len(end) else end
                    fresh = np.concatenate([[True], start[1:] > reach[:-1]]) if len(end) else np.zeros(0, bool)
                    a, b = start[fresh], np.append(reach[:-1][fresh[1:]], reach[-1:]) if len(end) else end
                    cuts = [0, *np.stack([a, b], 1).ravel().tolist(), len(body)]
                    kept = b"".join(body[cuts[i] : cuts[i + 1]] for i in range(0, len(cuts), 2))
                    rows.append((key, len(body), len(body) - len(kept), len(a), kept, a.tolist(), b.tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)

    return run


def remove_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 32 << 20, ws: Workspace | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, starts, ends) for every row of docs; kept is what remains, as UTF-8 bytes.

    A byte goes when a string of `width` bytes (32 to 140, a multiple of 4) that covers it also starts earlier: in a
    document of smaller id, or earlier in the same document. Strings are judged on the input, may overlap, and never cross
    documents.

    Each window of `width` bytes is named by the least hash of its grams, so equal windows have equal names; neighbours
    that share a name form a run (tens of windows). A name that only one run has holds no repeat: names are shuffled first,
    and bytes only of runs whose name is met again. Tasks get these by name and sort them, deep-shallow: runs of equal bytes
    stand together, and of a name with several contents all windows are sorted to depth `width`. The order alone decides
    which strings repeat; hashes only say what might. Equal runs are sorted out in the map tasks before that, so thousands
    of copies give a row a task, and a name with over HEAVY runs is dealt window by window. Partitions hold about
    part_bytes of text, or what runs of that number of bytes have.

    A null text is empty; texts shorter than width, an empty table, give their rows with nothing removed. Null ids take no
    part. Rows that repeat an id are judged each by its own text; a string at the same start in two of them is at the same
    place in the same document, so neither is earlier, and repeated rows give equal results. Other columns of docs are not
    looked at.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "suffix")
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.xxhash64(body).alias("tag"), body.alias("body"))
    own = base.filter("doc is not null")
    least = shuffle_partitions(spark)
    parts = max(least, -(-(own.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // part_bytes))
    sent = own.mapInArrow(released(_emit_runs(width)), _ddl(RUNS))
    judged = sent.repartition(parts, "deal").mapInArrow(released(_judge_names), _ddl(JUDGED))
    first = ws.save(judged.withColumn("met", F.col("name").isNotNull()), "first", "met")
    forget_shuffles(spark)

    asked = first.filter("met")
    parts = max(least, -(-asked.count() * 2 * width // part_bytes))
    heavy = ws.save(asked.groupBy("name").count().filter(F.col("count") > HEAVY).select(F.col("name").alias("heavy_name")), "heavy")
    asked = asked.join(heavy, asked["name"] == heavy["heavy_name"], "left").select("doc", "tag", F.struct("span", "name", F.col("heavy_name").isNotNull().alias("heavy")).alias("ask"))
    asked = ws.save(asked.groupBy("doc", "tag").agg(F.collect_set("ask").alias("asked")), "asked")  # bounded by the text's length
    ws.drop("first/met=true", "heavy")
    forget_shuffles(spark)
    texts = KeyFilter(asked.select("doc"), ["doc"]).flag(own, "wanted").filter("wanted").select("doc", "tag", "body")
    placed = texts.join(asked, ["doc", "tag"]).select("doc", "tag", "body", "asked").mapInArrow(released(_emit_texts(width)), _ddl(PLACED))
    second = ws.save(placed.repartition(parts, "route").mapInArrow(released(_judge_texts(width)), _ddl(JUDGED)), "second")
    ws.drop("asked")
    forget_shuffles(spark)

    marks = first.filter("not met").select("doc", "tag", "span").unionByName(second.select("doc", "tag", "span"))
    marks = ws.save(marks.groupBy("doc", "tag").agg(F.collect_set("span").alias("spans")), "marks")
    ws.drop("first", "second")
    forget_shuffles(spark)
    flagged = KeyFilter(marks.select("doc"), ["doc"]).flag(base, "hit")
    clear = flagged.filter("not hit").select(F.col("doc").alias("id"), "body", F.lit(None).cast("array<bigint>").alias("spans"))
    hit = flagged.filter("hit").join(marks, ["doc", "tag"], "left").select(F.col("doc").alias("id"), "body", "spans")
    return clear.unionByName(hit).mapInArrow(_remove(width), _ddl(OUT))
