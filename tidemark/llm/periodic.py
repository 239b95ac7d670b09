"""Maximal periodic runs of words, found with string synchronising sets.

At each dyadic scale t a hash picks positions whose choice depends on the next 2t words only, so equal stretches have equal
choices. A run of a period from 3t to 6t holds two picked positions one period apart with equal contexts of 2t words, unless
stretches of a period of at most t/3 fill it; those highly periodic regions are known from smaller scales, and two of them
that touch propose the periods that align them. Proposals are extended to both sides by hashes of dyadic
lengths, and every run is verified word by word.

Texts are worked on side by side in one array of words with a separator of its own behind each, so runs never cross texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.registry import query, table

#: A run has at least so many words, and twice its period.
LEAST = 12
#: Bytes of text worked on together; a longer text is worked on alone.
SLICE = 1 << 21
#: Hashes are kept of dyadic lengths up to 2 ** TOP; longer stretches are compared in steps of that length.
TOP = 12


class Words:
    """An array of word numbers with hashes of its stretches of 1, 2, 4, ... words."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.ids, self.n = ids, len(ids)
        self.top = min(TOP, max(1, longest).bit_length())
        self.levels = [mixed(ids.astype(np.uint64))]

    def hashes(self, level: int) -> np.ndarray:
        """Hash of the 2 ** level words from each position on; equal stretches have equal hashes."""
        while len(self.levels) <= level:
            low, half = self.levels[-1], 1 << len(self.levels) - 1
            with np.errstate(over="ignore"):
                self.levels.append(mixed(low[:-half] * np.uint64(0x9E3779B97F4A7C15) + low[half:]) if len(low) > half else low[:0])
        return self.levels[level]

    def common(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """Length of the longest common stretch from positions a < b on, or of those that end before a and b."""
        found = np.zeros(len(a), np.int64)
        open_ = np.arange(len(a))
        while len(open_):
            open_ = open_[self._step(a, b, found, open_, self.top, back)]
        for level in range(self.top - 1, -1, -1):
            self._step(a, b, found, np.arange(len(a)), level, back)
        return found

    def _step(self, a: np.ndarray, b: np.ndarray, found: np.ndarray, rows: np.ndarray, level: int, back: bool) -> np.ndarray:
        h, size = self.hashes(level), 1 << level
        x, y = (a[rows] - found[rows] - size, b[rows] - found[rows] - size) if back else (a[rows] + found[rows], b[rows] + found[rows])
        inside = (x >= 0) & (y < len(h))
        same = inside.copy()
        same[inside] = h[x[inside]] == h[y[inside]]
        found[rows[same]] += size
        return same


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def small_periods(ids: np.ndarray, period: int) -> np.ndarray:
    """Runs (start, end, period) of one period, by comparing every word with the one a period before."""
    if len(ids) < 2 * period:
        return np.empty((0, 3), np.int64)
    same = np.concatenate([[False], ids[period:] == ids[:-period], [False]])
    change = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = change[::2], change[1::2] + period
    long = ends - starts >= 2 * period
    return np.column_stack([starts[long], ends[long], np.full(long.sum(), period)])


def periodic_positions(regions: np.ndarray, scale: int, n: int) -> np.ndarray:
    """Whether the ``scale`` words from a position on have a period of at most a third of the scale."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, regions[:, 0], 1)
    np.add.at(delta, regions[:, 1] - scale + 1, -1)
    return np.cumsum(delta[:-1]) > 0


def window_least(x: np.ndarray, size: int) -> np.ndarray:
    """Least value among ``size`` from each position on, for the positions that have them."""
    width, out = 1, x
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - size + 1], out[size - width:]) if size > width else out


def synchronising(words: Words, level: int, regions: np.ndarray) -> np.ndarray:
    """Picked positions at scale t = 2 ** level: the least hash of t words among t + 1 positions is at the first or the last.

    Positions of high period do not count. Whether a position is picked depends on its next 2t words only, and every
    stretch of t positions has one, unless the 3t - 1 words from its start on have a period of at most t / 3.
    """
    scale = 1 << level
    h = words.hashes(level)
    if len(h) <= scale:
        return np.empty(0, np.int64)
    void = np.uint64(0xFFFFFFFFFFFFFFFF)
    order = mixed(h ^ np.uint64(level)) >> np.uint64(1)
    if len(regions):
        order[periodic_positions(regions, scale, len(h))] = void
    least = window_least(order, scale + 1)
    return np.flatnonzero((least != void) & ((order[:-scale] == least) | (order[scale:] == least)))


def context_pairs(words: Words, level: int, picked: np.ndarray) -> np.ndarray:
    """Proposals (position, period): picked positions with equal contexts of 2t words, from 3t to 6t - 1 apart."""
    scale = 1 << level
    context = words.hashes(level + 1)
    picked = picked[picked < len(context)]
    order = np.argsort(context[picked], kind="stable")
    at, key = picked[order], context[picked][order]
    found, step = [], 1
    rows = np.arange(len(at))
    while True:
        rows = rows[rows + step < len(at)]
        gap = at[rows + step] - at[rows]
        near = (key[rows + step] == key[rows]) & (gap < 6 * scale)
        rows, gap = rows[near], gap[near]
        if not len(rows):
            break
        wide = gap >= 3 * scale
        found.append(np.column_stack([at[rows[wide]], gap[wide]]))
        step += 1
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def region_pairs(words: Words, scale: int, regions: np.ndarray) -> np.ndarray:
    """Proposals (position, period) from highly periodic regions that touch and have one root: all periods from 3t to
    6t - 1 that put the first region's words on equal ones of the second."""
    regions = regions[regions[:, 1] - regions[:, 0] >= 3 * scale - 1]
    regions = regions[np.lexsort((regions[:, 1], regions[:, 0]))]
    out = []
    touch = np.flatnonzero((regions[1:, 0] <= regions[:-1, 1]) & (regions[1:, 2] == regions[:-1, 2]))
    for i in touch.tolist():
        (x, y, q), (x2, y2, _) = regions[i].tolist(), regions[i + 1].tolist()
        root, other = words.ids[x:x + q], words.ids[x2:x2 + 2 * q - 1]
        turns = np.flatnonzero(other[:q] == root[0])
        turn = next((t for t in turns.tolist() if np.array_equal(other[t:t + q], root)), None)
        if turn is None:
            continue
        low = max(3 * scale, x2 - y + 1)
        first = low + (x2 + turn - x - low) % q
        periods = np.arange(first, min(6 * scale, y2 - x), q)
        out.append(np.column_stack([np.maximum(x, x2 - periods), periods]))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def extended(words: Words, proposals: np.ndarray) -> np.ndarray:
    """Runs (start, end, period) that hold a proposed position and its copy one period on."""
    at, period = proposals[:, 0], proposals[:, 1]
    start = at - words.common(at, at + period, back=True)
    end = at + period + words.common(at, at + period)
    runs = np.column_stack([start, end, period])
    return np.unique(runs[end - start >= 2 * period], axis=0)


def verified(ids: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Runs whose words equal those a period on, compared word by word; a run that hashes took for longer is cut
    into the runs that it really holds."""
    out = []
    for start, end, period in runs.tolist():
        if np.array_equal(ids[start:end - period], ids[start + period:end]):
            out.append((start, end, period))
        else:
            out += [(a + start, b + start, period) for a, b, _ in small_periods(ids[start:end], period).tolist()]
    return np.array(out, np.int64).reshape(-1, 3)


def smallest_periods(runs: np.ndarray) -> np.ndarray:
    """The runs by start and end, each stretch once with its smallest period; a multiple of that gives the same stretch."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[first]


def all_runs(ids: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """All maximal runs (start, end, smallest period) of at least ``least`` words and two periods, by start and period.

    ``longest`` bounds the length of a text in ``ids``, in which every separator occurs once.
    """
    words = Words(ids, longest)
    runs = smallest_periods(np.concatenate([small_periods(ids, p) for p in (1, 2)]))
    level = 0
    while 6 << level <= longest:
        scale = 1 << level
        small = runs[(3 * runs[:, 2] <= scale) & (runs[:, 1] - runs[:, 0] >= scale)]
        proposals = context_pairs(words, level, synchronising(words, level, small))
        if len(small):
            proposals = np.concatenate([proposals, region_pairs(words, scale, small)])
        if len(proposals):
            found = verified(ids, extended(words, np.unique(proposals, axis=0)))
            runs = smallest_periods(np.concatenate([runs, found]))
        level += 1
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(least, 2 * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the periodic tail that the contract asks for in every tenth document."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[: n - a]


def documents_of(batch: pa.RecordBatch, plant: bool) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(row, words) in slices of about ``SLICE`` bytes."""
    held, size = [], 0
    for i, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
        raw = text.as_py() or b""
        words = raw.split()
        held.append((i, planted(words, key) if plant else words))
        size += len(raw)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """The runs (start, end, period) of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    numbers: dict[bytes, int] = {}
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    # None marks the end of each text, and gets a number that nothing else has.
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in (*t, None)), np.int64, int(sizes.sum()) + len(texts))
    ids[starts + sizes] = len(numbers) + np.arange(len(texts))
    runs = all_runs(ids, int(sizes.max(initial=0)), least)
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [runs[cuts[i]:cuts[i + 1]] - [starts[i], starts[i], 0] for i in range(len(texts))]


def keeps(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those that a run holds behind its first period."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, runs[:, 0] + runs[:, 2], 1)
    np.add.at(delta, runs[:, 1], -1)
    return np.cumsum(delta[:-1]) == 0


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, plant: bool = False) -> DataFrame:
    """(key, n_words, runs, collapsed) per row: the maximal periodic runs of a text's words, and the text without their repeats.

    A run is (start, length, period) in words: its words are equal to those a period on, no smaller period does, it has at least
    ``least`` words and two periods, and no neighbouring word extends it. Runs come by start, then period.
    ``collapsed`` holds the words, joined by one space, that no run holds behind its first period. A null text has no words; keys may
    be null or repeat, and each row has its own result. ``plant`` gives every tenth key a periodic tail, see ``planted``. Each
    text is worked on in one task, in memory of its length times about 100 bytes a word.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in documents_of(batch, plant):
                found = runs_of([words for _, words in part], least)
                keys = batch.column(0).take(pa.array([i for i, _ in part]))
                lists = [[{"start": a, "length": b - a, "period": p} for a, b, p in r.tolist()] for r in found]
                kept = [b" ".join(np.array(w, object)[keeps(len(w), r)]) if len(r) else b" ".join(w) for (_, w), r in zip(part, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array([len(w) for _, w in part], pa.int64()), pa.array(lists, pa.list_(run)), pa.array(kept, pa.binary())],
                    names=["key", "n_words", "runs", "collapsed"])

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(work, f"key {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


@query("op11_periodic")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), plant=True)
    line = lambda r: F.concat(*[x for c, end in (("start", ","), ("length", ","), ("period", "\n")) for x in (r[c].cast("string"), F.lit(end))])
    runs = F.array_join(F.transform("runs", line), "")
    # The longest run; of equally long ones the first.
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("top", top).select(
        F.col("key").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"), F.expr("(1000 * top.length) div -top.period").alias("exponent_milli"),
        F.sha2(runs, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
