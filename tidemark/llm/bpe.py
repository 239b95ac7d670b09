"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece the byte-pair encoding ends in one particular token, and that token is the only one
among the vocabulary entries ending there which may stand after the last token of the prefix left of it. A suffix
automaton lists the entries that end at each position; a memoized test tells whether two neighbours would stay
apart under the merges; the last tokens found that way are the back-pointers which the ids are read from. The time
is linear in the piece, however long it is.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.registry import query, table, wider

#: Fixed value: the byte-level pre-tokenizer's pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 250_000
LONGEST_CACHED = 64
#: Bytes at the head of a piece whose last tokens are remembered.
HEAD = 5
#: Bytes up to which last tokens are sought from the end, and only those that the end depends on.
SOUGHT = 256


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stay, others follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Recent:
    """Mapping of the entries used of late: two generations of at most ``size`` entries each."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and key in self.old:
            value = self.put(key, self.old[key])
        return value

    def put(self, key, value):
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


class SuffixAutomaton:
    """Reads bytes; the state after a prefix knows all vocabulary entries that are suffixes of it, longest first."""

    def __init__(self, entries: dict[bytes, int]):
        self.step: dict[int, int] = {}
        own: list[tuple[int, int] | None] = [None]
        depth: list[list[tuple[int, int, int]]] = []
        for entry, token in entries.items():
            node = 0
            for at, byte in enumerate(entry):
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(own)
                    while len(depth) <= at:
                        depth.append([])
                    depth[at].append((node, byte, len(own)))
                    own.append(None)
                node = self.step[key]
            own[node] = token, len(entry)
        #: state of the longest shorter suffix; entries that end in a state, with their lengths
        self.shorter = [0] * len(own)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        for level in depth:
            for parent, byte, node in level:
                if parent:
                    self.shorter[node] = self.follow(self.shorter[parent], byte)
                rest = self.ends[self.shorter[node]]
                self.ends[node] = rest if own[node] is None else (own[node], *rest)

    def follow(self, state: int, byte: int) -> int:
        while state and (state << 8 | byte) not in self.step:
            state = self.shorter[state]
        return self.step.get(state << 8 | byte, 0)


class ByteBpe:
    """Encoder and decoder of a byte-level BPE file, equal to the library's on every text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.chars = byte_chars()
        to_byte = {c: b for b, c in enumerate(self.chars)}
        self.bytes_of = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.size_of = [0] * (1 + max(self.bytes_of))
        for i, value in self.bytes_of.items():
            self.size_of[i] = len(value)
        #: rank and parts of the merge that makes a token; rank of the merge of two neighbours
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(pairs):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = r
            self.parts.setdefault(whole, (r, left, right))
        self.automaton = SuffixAutomaton({self.bytes_of[i]: i for t, i in vocab.items() if len(t) == 1 or i in self.parts})
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.apart, self.known, self.chunks, self.heads, self.falls = (Recent(CACHED) for _ in range(5))

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' joined bytes is just these two.

        Undoes the merges next to the boundary, the latest first, and looks for a merge across it that would have
        come before the one undone.
        """
        before = len(self.rank)
        while True:
            across = self.rank.get((a, b))
            if across is not None and across < before:
                return False
            made_a, made_b = self.parts.get(a), self.parts.get(b)
            if made_a is None and made_b is None:
                return True
            # Equal ranks can only be the same merge on both sides; the left one happens first, so the right is undone first.
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                before, a = made_a[0], made_a[2]
            else:
                # A merge across the boundary with the same rank would start further left, so it would come first.
                before, b = made_b[0] + 1, made_b[1]

    def read_on(self, data: bytes, state: int, last: list[int | None]) -> int:
        """State after ``data``, read from ``state`` on; the last tokens of the prefixes are added to ``last``.

        Behind a head whose tokens are all known, those on which the last one does not depend are left open (None).
        """
        falls, known = self.falls, len(last)
        step, follow = self.automaton.step, self.automaton.follow
        states = []
        for byte in data:
            at = state << 8 | byte
            state = step.get(at)
            if state is None:
                state = falls.new.get(at)
                if state is None:
                    state = falls.get(at)
                if state is None:
                    state = falls.put(at, follow(at >> 8, byte))
            states.append(state)
            last.append(None)
        if known > 1 and len(states) <= SOUGHT:
            if states:
                self.last_at(len(last) - 1, known, states, last)
        else:
            for end in range(known, len(last)):
                self.last_at(end, known, states, last)
        return state

    def last_at(self, end: int, known: int, states: list[int], last: list[int | None]) -> int:
        """Last token of the prefix of ``end`` bytes; ``states`` are those of the prefixes from ``known`` bytes on."""
        apart = self.apart
        remembered = apart.new
        for token, size in self.automaton.ends[states[end - known]]:
            if size != end:
                left = last[end - size]
                if left is None:
                    left = self.last_at(end - size, known, states, last)
                key = left << 32 | token
                ok = remembered.get(key)
                if ok is None:
                    ok = apart.get(key)
                if ok is None:
                    ok = apart.put(key, self.stay_apart(left, token))
                    remembered = apart.new
                if not ok:
                    continue
            last[end] = token
            return token
        raise ValueError("a byte without an entry")

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        head = data[:HEAD]
        begun = self.heads.new.get(head) or self.heads.get(head)
        if begun is None:
            last = [-1]
            begun = self.heads.put(head, (self.read_on(head, 0, last), last))
        last = begun[1].copy()
        self.read_on(data[HEAD:], begun[0], last)
        size_of = self.size_of
        ids = []
        end = len(data)
        while end:
            ids.append(last[end])
            end -= size_of[last[end]]
        ids.reverse()
        return tuple(ids)

    def encode_pieces(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for piece in self.pieces.findall(text):
            ids = known.new.get(piece)
            if ids is None:
                ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= LONGEST_CACHED:
                    known.put(piece, ids)
            out += ids
        return out

    def encode_plain(self, text: str, out: list[int]) -> None:
        """Ids of a text without special tokens.

        A single space between two other characters always starts a piece, so what lies between such spaces is
        encoded by itself and remembered. Texts with runs of white space are cut by the pattern as a whole.
        """
        first, *rest = text.split(" ")
        if first != first.strip() or not first and rest:
            out += self.encode_pieces(text)
            return
        at = len(out)
        out += self.encode_pieces(first)
        chunks = self.chunks
        for chunk in rest:
            ids = chunks.new.get(chunk)
            if ids is None:
                ids = chunks.get(chunk)
            if ids is None:
                if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                    del out[at:]
                    out += self.encode_pieces(text)
                    return
                # Letters alone are one piece with the space before them.
                ids = self.encode_piece(" " + chunk) if chunk.isascii() and chunk.isalpha() else tuple(self.encode_pieces(" " + chunk))
                if len(chunk) <= LONGEST_CACHED:
                    chunks.put(chunk, ids)
            out += ids

    def encode(self, text: str) -> list[int]:
        """Ids of the text; special tokens written out in it become their ids, as in the library."""
        out: list[int] = []
        at = 0
        for hit in self.split_special.finditer(text) if self.split_special else ():
            self.encode_plain(text[at:hit.start()], out)
            out.append(self.special[hit.group()])
            at = hit.end()
        self.encode_plain(text[at:] if at else text, out)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """One tokenizer for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def with_extra(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    for name, values in columns.items():
        batch = batch.append_column(name, values)
    return batch


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in an array column ``out``; null counts as empty. All rows and other columns stay; a column
    of that name is replaced."""
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, text):
                ids = [bpe.encode(t or "") for t in part.column(text).to_pylist()]
                yield with_extra(part, **{out: pa.array(ids, pa.list_(pa.int32()))})

    return docs.mapInArrow(run, wider(docs, f"`{out}` array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the array column ``ids`` in ``out``, which replaces a column of that name; null counts as empty."""
    df = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, ids):
                texts = [bpe.decode(x or ()) for x in part.column(ids).to_pylist()]
                yield with_extra(part, **{out: pa.array(texts, pa.string())})

    return df.mapInArrow(run, wider(df, f"`{out}` string"))


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of ``column``, one row at least; for bounded memory."""
    at, rows = 0, batch.num_rows
    step = max(1, int(rows * most / max(1, batch.column(column).nbytes)))
    while at < rows:
        yield batch.slice(at, min(step, rows - at))
        at += step


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: str | None = None) -> DataFrame:
    """Per document: key, n_tokens, hashes of the ids and of the text decoded from them, and the ids in an array column ``ids`` if named.

    A task holds one document's ids at a time, or those of a slice of a batch if they are kept. Null counts as empty; an
    empty text has no tokens; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        names = [str(i) for i in range(max(bpe.bytes_of) + 1)]
        for batch in batches:
            for part in slices(batch, "text"):
                rows, kept = [], []
                for text_ in part.column("text"):
                    found = bpe.encode(text_.as_py() or "")
                    rows.append((
                        len(found),
                        hashlib.sha256(",".join(map(names.__getitem__, found)).encode()).hexdigest(),
                        hashlib.sha256(bpe.decode(found).encode()).hexdigest(),
                    ))
                    if ids is not None:
                        kept.append(pa.array(found, pa.int32()))
                n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
                out = pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                if ids is not None:
                    ends = pa.array([0, *itertools.accumulate(n)], pa.int32())
                    out = with_extra(out, **{ids: pa.ListArray.from_arrays(ends, pa.concat_arrays(kept))})
                yield out

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (f", `{ids}` array<int>" if ids is not None else ""))


def tokenizer_path() -> str:
    """The public vocabulary file used by the registered query and the pipeline."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None, path: str | None = None) -> DataFrame:
    """Last pipeline stage: per row doc_id, source, lang, n_tokens, the hashes of ids and decoded text, and the ids."""
    keyed = docs.select(F.struct("doc_id", "source", "lang").alias("row"), "text")
    out = digests(keyed, path or tokenizer_path(), key="row", ids="ids")
    return out.select("row.*", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


@query("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_path())
