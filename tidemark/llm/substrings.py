"""Removal of byte strings that an earlier document also holds, over the sorted suffixes of many documents.

Suffixes are sorted column by column: every round inserts one more symbol of each string, from the last to the first,
into the Burrows-Wheeler transform of the collection and brings the common prefixes up to date (``Collection``).
Doing that over a whole corpus would take as many passes as the longest document has bytes, so it runs on groups
of short strings that hold all equal windows together. In each window of 50 bytes the 20-byte string of least hash is
its anchor; neighbouring windows with one anchor make a segment of at most 80 bytes, and equal windows have equal
anchors. Three passes over packed documents do it:

1. each pack sends the hashes of its anchors, and learns which of them another document also has,
2. it sends the segments of those, each once per pack, to the group of the anchor, where equal segments meet and
   different ones are sorted; the group answers with the smallest document of each window,
3. windows whose smallest document is smaller than their own are cut out.

Only hashes, the segments in question and compressed packs are shuffled, in blobs of many entries. Copies are one
entry per pack, so a text that a third of the documents holds is as many entries as there are packs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.registry import query, table, wider
from tidemark.session import materialize

WINDOW = 50
ANCHOR = 20
SPAN = WINDOW - ANCHOR + 1
#: Bytes in a pack; more only where one document has more.
PACK_BYTES = 1 << 20
#: Anchors per group of the exchanges: more groups for larger tables.
GROUP_HASHES = 250_000
#: Packs with an anchor from which on its windows are sent one by one, each to a group of its own: a hot anchor may
#: have any number of different segments.
HOT_PACKS = 1_024
#: Strings sorted at once; groups of one anchor stay together.
SORTED = 8_192

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOW = np.uint64((1 << 20) - 1)
NONE = np.iinfo(np.int64).max
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PACK_BYTES + 1)
        for name, b in (("up", BASE), ("down", INVERSE)):
            with np.errstate(over="ignore"):
                _powers[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]), dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes, by its start."""
    n = len(data)
    if n < size:
        return np.empty(0, np.uint64)
    up, down = powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(32)
    return h


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first window, number of windows) of each segment of joined documents that end at ``ends``.

    Covers each window that lies within one document exactly once.
    """
    found = []
    step = (1 << 20) - WINDOW
    limit = np.repeat(ends, np.diff(ends, prepend=0))
    for at in range(0, max(0, len(data) - WINDOW + 1), step):
        part = data[at:at + step + WINDOW - 1]
        h = gram_hashes(part, ANCHOR)
        best = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while 2 * reach <= SPAN:
            best, reach = np.minimum(best[:-reach], best[reach:]), 2 * reach
        if reach < SPAN:
            best = np.minimum(best[: len(best) - (SPAN - reach)], best[SPAN - reach:])
        anchor = (best & LOW).astype(np.int64)
        starts = np.arange(at, at + len(anchor))
        anchor[starts + WINDOW > limit[starts]] = -1
        first = np.flatnonzero(np.diff(anchor, prepend=-2))
        count = np.diff(first, append=len(anchor))
        inside = anchor[first] >= 0
        first, count = first[inside], count[inside]
        found.append((h[anchor[first]], first + at, count))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Collection:
    """Sorted suffixes of a collection of strings, built by inserting one symbol of each string per round.

    Holds the transform (the symbol before each suffix; 0 for whole strings, symbols are bytes plus one), the length
    of the prefix that each suffix has in common with the one before it, and the string each belongs to. A round
    reads these columns once, in order, and writes them once, longer by an entry for each string that goes on.
    """

    def __init__(self, strings: list[bytes]):
        m = self.strings = len(strings)
        size = np.array([len(s) for s in strings], np.int64)
        joined = np.frombuffer(b"".join(strings), np.uint8)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        self.before = np.zeros(m, np.uint16)
        self.common = np.zeros(m, np.int32)
        self.owner = np.arange(m, dtype=np.int32)
        self.length = np.zeros(m, np.int32)
        place = np.arange(m)
        for done in range(int(size.max(initial=0))):
            going = np.flatnonzero(size > done)
            # The next symbols stand before the suffixes inserted last.
            self.before[place[going]] = joined[start[going] + size[going] - 1 - done].astype(np.uint16) + 1
            place = self.insert(going, place, done)

    def insert(self, going: np.ndarray, place: np.ndarray, done: int) -> np.ndarray:
        """Insert the suffixes that begin with the symbols just written; returns where each string's last one is now."""
        n = len(self.before)
        order = np.argsort(self.before, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        symbol = self.before[order]
        whole = int(np.searchsorted(symbol, 1))
        # An entry with a symbol before it stands for the suffix one longer; those suffixes are sorted like this.
        new = np.zeros(n, bool)
        new[rank[place[going]]] = True
        new = new[whole:]
        ends = self.strings
        total = ends + n - whole
        at = ends + np.arange(n - whole)
        # Suffixes there already keep their order: they fill the entries that are not new.
        before = np.zeros(total, np.uint16)
        common = np.zeros(total, np.int32)
        owner = np.empty(total, np.int32)
        length = np.empty(total, np.int32)
        old = np.concatenate([np.arange(ends), at[~new]])
        before[old], common[old], owner[old], length[old] = self.before, self.common, self.owner, self.length
        fresh = at[new]
        source = order[whole:][new]
        owner[fresh], length[fresh] = self.owner[source], done + 1
        # A common prefix is one longer than the least between two entries with the same symbol before them; it
        # changes for new suffixes and for those behind one.
        touched = np.flatnonzero(new | np.concatenate([[False], new[:-1]]))
        same = touched[(touched > 0) & (symbol[whole + touched] == symbol[whole + touched - 1])]
        common[at[touched]] = 0
        if len(same):
            low, high = order[whole + same - 1] + 1, order[whole + same] + 1
            bounds = np.minimum(np.column_stack([low, high]).ravel(), n)
            least = np.minimum.reduceat(np.append(self.common, np.int32(NONE >> 32)), bounds)[::2]
            common[at[same]] = least + 1
        moved = place.copy()
        moved[owner[fresh]] = fresh
        still = np.ones(len(place), bool)
        still[going] = False
        # Strings that are whole stay where their longest suffix was, shifted by what came before it.
        moved[still] = old[place[still]]
        self.before, self.common, self.owner, self.length = before, common, owner, length
        return moved


def smallest_by_window(strings: list[bytes], docs: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each string and each of its windows, the smallest of ``docs`` among the strings that hold that window."""
    sorted_ = Collection(strings)
    starts = np.flatnonzero(sorted_.common < window)
    least = np.minimum.reduceat(docs[sorted_.owner], starts)
    value = np.repeat(least, np.diff(starts, append=len(sorted_.common)))
    inside = np.flatnonzero(sorted_.length >= window)
    # By string, longest suffix (first window) first.
    inside = inside[np.lexsort((-sorted_.length[inside], sorted_.owner[inside]))]
    counts = np.bincount(sorted_.owner[inside], minlength=len(strings))
    return np.split(value[inside], np.cumsum(counts)[:-1])


def pack(docs: DataFrame, key: str, text: str, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(pack, keys, lengths, data, rest): rows joined into packs, texts compressed, all columns but the text in ``rest``.

    Null keys rank behind all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        keys, parts, rests, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            rest = pa.Table.from_batches(rests).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as stream:
                stream.write_table(rest)
            columns = [
                pa.array([uuid.uuid4().hex]), pa.array([np.array(keys, np.int64).tobytes()], pa.binary()),
                pa.array([np.array([len(p) for p in parts], np.int64).tobytes()], pa.binary()), pa.array([press.compress(b"".join(parts))], pa.binary()),
                pa.array([press.compress(sink.getvalue().to_pybytes())], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["pack", "keys", "lengths", "data", "rest"])

        for batch in batches:
            rest, start = batch.drop_columns(["__key", "__text"]), 0
            for i, (k, t) in enumerate(zip(batch.column("__key"), batch.column("__text"), strict=True)):
                t = t.as_py() or b""
                if held and held + len(t) > pack_bytes:
                    rests.append(rest.slice(start, i - start))
                    yield out()
                    keys, parts, rests, held, start = [], [], [], 0, i
                keys.append(NONE if k.as_py() is None else k.as_py())
                parts.append(t)
                held += len(t)
            rests.append(rest.slice(start))
        if keys:
            yield out()

    rows = docs.withColumns({"__key": F.col(f"`{key}`").cast("bigint"), "__text": F.col(f"`{text}`").cast("binary")}).drop(text)
    return rows.mapInArrow(run, "pack string, keys binary, lengths binary, data binary, rest binary")


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Keys, ends and bytes of a pack."""
    data = zstandard.ZstdDecompressor().decompress(row["data"]) if row["data"] else b""
    return np.frombuffer(row["keys"], np.int64), np.cumsum(np.frombuffer(row["lengths"], np.int64)), data


def anchors_of(packs: DataFrame, bits: int) -> DataFrame:
    """(bucket, pack, low, twice): the different anchor hashes of each pack, and whether two of its rows have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("keys", "lengths", "data")}
                _, ends, data = unpack(row)
                h, first, _ = segments(np.frombuffer(data, np.uint8), ends)
                if not len(h):
                    continue
                doc = np.searchsorted(ends, first, side="right")
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.diff(h, prepend=~h[:1]) != 0
                other = np.flatnonzero(~new & (np.diff(doc, prepend=-1) != 0))
                each = h[new]
                twice = np.zeros(len(each), bool)
                twice[np.cumsum(new)[other] - 1] = True
                bucket = (each >> np.uint64(64 - bits)).astype(np.int64)
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                to = np.append(at[1:], len(each))
                low = (each & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[at]), pa.array([batch.column("pack")[i].as_py()] * len(at)),
                    pa.array([low[a:b].tobytes() for a, b in zip(at, to, strict=True)], pa.binary()),
                    pa.array([np.packbits(twice[a:b]).tobytes() for a, b in zip(at, to, strict=True)], pa.binary()),
                ], names=["bucket", "pack", "low", "twice"])

    return packs.mapInArrow(run, "bucket bigint, pack string, low binary, twice binary")


def shared_anchors(anchors: DataFrame, hot_packs: int) -> DataFrame:
    """(pack, bucket, low, hot): the anchors of each pack that more than one row of the table has."""

    def run(group: pa.Table) -> pa.Table:
        lows = [np.frombuffer(x.as_py(), np.uint32) for x in group.column("low")]
        twice = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(y)).astype(bool) for x, y in zip(group.column("twice"), lows, strict=True)]
        every, inverse, counts = np.unique(np.concatenate(lows), return_inverse=True, return_counts=True)
        shared = counts > 1
        shared[inverse[np.concatenate(twice)]] = True
        keep, hot = shared[inverse], (counts > hot_packs)[inverse]
        at, rows = 0, []
        for name, low in zip(group.column("pack").to_pylist(), lows, strict=True):
            own = keep[at:at + len(low)]
            if own.any():
                rows.append((name, low[own].tobytes(), np.packbits(hot[at:at + len(low)][own]).tobytes()))
            at += len(low)
        name, low, hot_bits = zip(*rows, strict=True) if rows else ((), (), ())
        bucket = group.column("bucket")[0].as_py()
        return pa.table({"pack": pa.array(name, pa.string()), "bucket": pa.array([bucket] * len(rows), pa.int64()), "low": pa.array(low, pa.binary()), "hot": pa.array(hot_bits, pa.binary())})

    return anchors.groupBy("bucket").applyInArrow(run, "pack string, bucket bigint, low binary, hot binary")


#: Array types of the blobs. Anchors meet in a group by half of their hash: others that share it are compared in vain.
ENTRIES = (np.int32, np.uint32, np.int64, np.int64, np.uint8)


def join_arrays(kinds: tuple, n: int, *arrays: np.ndarray, text: bytes = b"") -> bytes:
    """Arrays of ``n`` values each, and bytes, compressed; integers of eight bytes byte by byte, which packs better."""
    parts = [np.int64(n).tobytes()]
    for kind, a in zip(kinds, arrays, strict=True):
        a = np.ascontiguousarray(a, kind)
        parts.append(a.view(np.uint8).reshape(n, 8).T.tobytes() if a.itemsize == 8 else a.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*parts, text]))


def split_arrays(kinds: tuple, blob: bytes) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        raw = np.frombuffer(data, np.uint8, size, at)
        out.append(np.ascontiguousarray(raw.reshape(8, n).T).view(kind).ravel() if np.dtype(kind).itemsize == 8 else raw.view(kind))
        at += size
    return out, data[at:]


def occurrences(data: bytes, ends: np.ndarray, asked: list[dict], bits: int) -> tuple:
    """(different segments, entry, first window, number of windows, hash of the anchor) of a pack's shared anchors.

    Entries count the different segments in the order of the text, so two calls number them alike. Every window of a
    hot anchor goes by itself, under its own hash.
    """
    low = [np.frombuffer(x["low"], np.uint32) for x in asked]
    wanted = np.concatenate([(np.uint64(x["bucket"]) << np.uint64(32)) | y.astype(np.uint64) for x, y in zip(asked, low, strict=True)])
    hot = np.concatenate([np.unpackbits(np.frombuffer(x["hot"], np.uint8), count=len(y)).astype(bool) for x, y in zip(asked, low, strict=True)])
    order = np.argsort(wanted)
    wanted, hot = wanted[order], hot[order]
    h, first, count = segments(np.frombuffer(data, np.uint8), ends)
    short = (h >> np.uint64(64 - bits) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
    at = np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)
    held = wanted[at] == short
    h, first, count, hot = h[held], first[held], count[held], hot[at[held]]
    if hot.any():
        n = count[hot]
        windows = np.repeat(first[hot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        own = np.array([int.from_bytes(hashlib.blake2b(data[s:s + WINDOW], digest_size=8).digest(), "little") for s in windows.tolist()], np.uint64)
        h, first = np.concatenate([h[~hot], own]), np.concatenate([first[~hot], windows])
        count = np.concatenate([count[~hot], np.ones(len(windows), np.int64)])
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(data[s:s + c + WINDOW - 1], len(known)) for s, c in zip(first.tolist(), count.tolist(), strict=True)], np.int64)
    return list(known), ids, first, count, h


def entries_of(packs: DataFrame, asked: DataFrame, bits: int, groups: int) -> DataFrame:
    """(pack, group, blob) for each group the different segments of a pack that it asks about, as arrays joined by
    ``join_arrays``: number of the entry, hash of the anchor, smallest and largest key of the pack's rows that have
    the segment, its size and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("pack", "keys", "lengths", "data", "asked")}
                keys, ends, data = unpack(row)
                texts, ids, first, _, h = occurrences(data, ends, row["asked"], bits)
                if not texts:
                    continue
                doc = keys[np.searchsorted(ends, first, side="right")]
                lead = np.empty(len(texts), np.int64)
                lead[ids[::-1]] = np.arange(len(ids))[::-1]
                least = np.full(len(texts), NONE)
                np.minimum.at(least, ids, doc)
                most = np.full(len(texts), np.iinfo(np.int64).min)
                np.maximum.at(most, ids, doc)
                key = h[lead]
                group = (key % np.uint64(groups)).astype(np.int64)
                out = []
                order = np.argsort(group, kind="stable")
                cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
                for own in np.split(order, cuts[1:]):
                    blob = [texts[e] for e in own.tolist()]
                    sizes = np.array([len(t) for t in blob])
                    out.append((row["pack"], int(group[own[0]]), join_arrays(ENTRIES, len(own), own, key[own] >> np.uint64(32), least[own], most[own], sizes, text=b"".join(blob))))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["pack", "group", "blob"])

    return packs.join(asked, "pack").mapInArrow(run, "pack string, group bigint, blob binary")


def partners(texts: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Which of the texts have a window that, by its hash, another of them has too."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    h = gram_hashes(np.frombuffer(b"".join(texts), np.uint8), window)
    starts = np.arange(len(h))
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(h)]
    inside = starts + window <= ends[owner]
    h, owner = h[inside], owner[inside]
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    again = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] != owner[:-1]))
    found = np.zeros(len(texts), bool)
    found[owner[again]] = found[owner[again + 1]] = True
    return found


def answer(keys: np.ndarray, texts: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """The smallest key of each window of each different text; one value stands for equal ones.

    Texts of one anchor are compared with each other by sorting. A text alone with its anchor, one whose anchor only one key
    has, and one without a partner for any of its windows need none.
    """
    out = [least[i:i + 1] for i in range(len(texts))]
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    some = np.diff(cuts, append=len(order))
    differ = np.minimum.reduceat(least[order], cuts) < np.maximum.reduceat(least[order], cuts)
    several = order[np.repeat((some > 1) & differ, some)]
    if len(several):
        several = several[partners([texts[i] for i in several.tolist()])]
    edges = np.flatnonzero(np.diff(keys[several], prepend=keys[several[:1]] + np.uint32(1), append=keys[several[-1:]] + np.uint32(1)))
    at = 0
    while at < len(several):
        # Whole anchors, up to ``SORTED`` strings; more only where one anchor has more.
        fit = edges[(edges > at) & (edges <= at + SORTED)]
        to = int(fit[-1]) if len(fit) else int(edges[edges > at][0])
        batch = several[at:to]
        for i, found in zip(batch.tolist(), smallest_by_window([texts[i] for i in batch.tolist()], least[batch]), strict=True):
            out[i] = found
        at = to
    return out


def answers_of(entries: DataFrame) -> DataFrame:
    """(pack, ids, counts, values): the entries with a window that a smaller key also has, and the smallest keys."""

    def run(group: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        sent, keys, least = [], [], []
        for pack_, blob in zip(group.column("pack").to_pylist(), group.column("blob"), strict=True):
            (ids, key, low, most, sizes), data = split_arrays(ENTRIES, blob.as_py())
            at, own = 0, []
            for i, size in enumerate(sizes.tolist()):
                text, at = data[at:at + size], at + size
                e = known.setdefault(text, len(known))
                if e == len(keys):
                    keys.append(key[i])
                    least.append(low[i])
                elif low[i] < least[e]:
                    least[e] = low[i]
                own.append(e)
            sent.append((pack_, ids, own, most))
        found = answer(np.array(keys, np.uint32), list(known), np.array(least, np.int64))
        low = np.array([x.min() for x in found], np.int64)
        rows = []
        for pack_, ids, own, most in sent:
            hit = np.flatnonzero(low[own] < most)
            if len(hit):
                values = [found[own[i]] for i in hit]
                rows.append((pack_, ids[hit].tobytes(), np.array([len(v) for v in values], np.int16).tobytes(), np.concatenate(values).astype(np.int64).tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("pack", "ids", "counts", "values"), columns, kinds, strict=True)})

    return entries.groupBy("group").applyInArrow(run, "pack string, ids binary, counts binary, values binary")


def cut(keys: np.ndarray, ends: np.ndarray, size: int, occurrences: tuple, answers: list[dict]) -> np.ndarray:
    """Mask of the bytes of a pack that windows with a smaller key cover."""
    ids, first, count = occurrences
    n = int(ids.max(initial=-1)) + 1
    at, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
    values, base = [], 0
    for a in answers:
        own, counts = np.frombuffer(a["ids"], np.int32), np.frombuffer(a["counts"], np.int16).astype(np.int64)
        at[own] = base + np.concatenate([[0], np.cumsum(counts)[:-1]])
        length[own] = counts
        values.append(np.frombuffer(a["values"], np.int64))
        base += len(values[-1])
    every = np.concatenate(values) if values else np.empty(0, np.int64)
    hit = length[ids] > 0
    ids, first, count = ids[hit], first[hit], count[hit]
    doc = keys[np.searchsorted(ends, first, side="right")]
    back = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.empty(0, np.int64)
    step = np.arange(count.sum()) - np.repeat(back, count)
    low = every[np.repeat(at[ids], count) + np.where(np.repeat(length[ids], count) == 1, 0, step)]
    start = (np.repeat(first, count) + step)[low < np.repeat(doc, count)]
    edges = np.bincount(start, minlength=size + 1)[: size + 1] - np.bincount(start + WINDOW, minlength=size + 1)[: size + 1]
    return np.cumsum(edges)[:size] > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", pack_bytes: int = PACK_BYTES, hot_packs: int = HOT_PACKS) -> DataFrame:
    """``docs`` with the text that remains, and columns n_bytes, removed (spans as (start, end) of bytes) and kept (bytes).

    A byte goes if a 50-byte string that covers it also starts in a row with a smaller key (an integer); strings are
    those of the input, and never cross rows. A null text is empty. A null key ranks behind all others, so its row
    loses what any keyed row has; rows of equal keys (or with no key) do not take from each other. Repeated rows
    repeat in the result; an empty table gives an empty result. A character cut in the middle is left out of the
    text; ``kept`` has every remaining byte. Columns named n_bytes, removed or kept are replaced.
    """
    docs = docs.drop("n_bytes", "removed", "kept")
    packs = materialize(pack(docs, key, text, pack_bytes), "packs")
    size = packs.agg(F.sum(F.length("data"))).first()[0] or 0
    # About 16 bytes of text an anchor, and text packs to about a third.
    hashes = size * 3 // 16
    bits = min(24, max(8, (hashes // GROUP_HASHES).bit_length()))
    groups = max(128, hashes // (2 * GROUP_HASHES))
    shared = materialize(shared_anchors(anchors_of(packs.select("pack", "keys", "lengths", "data"), bits), hot_packs), "shared")
    asked = shared.groupBy("pack").agg(F.collect_list(F.struct("bucket", "low", "hot")).alias("asked"))
    answers = materialize(answers_of(entries_of(packs.select("pack", "keys", "lengths", "data"), asked, bits, groups)), "answers")
    found = answers.groupBy("pack").agg(F.collect_list(F.struct("ids", "counts", "values")).alias("answers"))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                keys, ends, data = unpack(row)
                raw, gone = np.frombuffer(data, np.uint8), None
                if row["answers"]:
                    # Numbered as when the segments were sent: cheaper than to keep where they occur.
                    _, ids, first, count, _ = occurrences(data, ends, row["asked"], bits)
                    gone = cut(keys, ends, len(raw), (ids, first, count), row["answers"])
                out, start = [], 0
                for end in ends.tolist():
                    kept, spans = data[start:end], []
                    if gone is not None and gone[start:end].any():
                        own = gone[start:end]
                        spans = np.flatnonzero(np.diff(own, prepend=False, append=False)).reshape(-1, 2).tolist()
                        kept = raw[start:end][~own].tobytes()
                    out.append((kept.decode("utf-8", "ignore"), end - start, spans, kept))
                    start = end
                rest = pa.ipc.open_stream(plain.decompress(row["rest"])).read_all()
                columns = list(zip(*out, strict=True))
                kinds = [pa.string(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
                made = dict(zip((text, "n_bytes", "removed", "kept"), (pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), strict=True))
                whole = pa.table({n: made[n] if n in made else rest.column(n) for n in [*names, "n_bytes", "removed", "kept"]})
                yield from whole.to_batches(max_chunksize=512)

    # Only packs with an answer need their anchors again.
    joined = packs.join(found.join(asked, "pack"), "pack", "left").select("keys", "lengths", "data", "rest", "asked", "answers")
    schema = wider(docs, "n_bytes bigint, removed array<array<bigint>>, kept binary")
    return joined.mapInArrow(run, schema)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: passages that a document with a smaller doc_id holds are cut out of the texts.

    Documents of which nothing but white space remains go; n_chars follows the text.
    """
    found = remove_repeats(docs.withColumn("__had", F.col("text").isNotNull()))
    left = found.where((F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(F.col("__had"), F.col("text"))
    columns = {"text": text, "n_chars": F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("bigint"))}
    return left.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


@query("op6_substrings")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x[1] - x[0])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
