"""Operators against brute force on small tables, and odd rows: nulls, empty and long texts, repeats, clashing names."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, components, language, mixing, neighbours, paragraphs, quality, simhash, substrings, urls, warc
from tidemark.llm.queries import QUERIES, SQL
from tidemark.session import new_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, value string, h bigint, tokens bigint"
ODD = [
    (None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, "de", "b", None), (3, "word " * 30_000, "en", "a", 150_000),
    (4, "alpha beta", None, "c", 10), (5, "\n\t ", None, None, 3), (6, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "a", 66),
    (7, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "a", 66), (None, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "a", 66),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "k", "v", 1, 2) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def made_texts(n=60, seed=1):
    """Prose of a few words with copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeinorst", k=rng.randint(2, 8))) for _ in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for i in range(n):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(3, 70))) for _ in range(rng.randint(1, 5))]
        if i % 7 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        if texts and i % 5 == 0:
            lines = rng.choice(texts).split("\n")
        if texts and i % 6 == 0:
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = "édité"
            lines = " ".join(words).split("\n")
        texts.append("\n".join(lines))
    return texts


@pytest.fixture(scope="module")
def prose(spark):
    rows = [(i * 3 % 61, t, "en", "a", len(t)) for i, t in enumerate(made_texts())]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    got = [tuple(r[c] for c in names) for r in QUERIES[name](spark, sf).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))


# 7


def test_cascade_finds_failures_in_any_order(spark, prose, odd):
    rules = quality.RULES
    both = [{(r["doc_id"], r["text"]): r["failed_rule"] is None for r in prose.withColumn("failed_rule", quality.first_failure(F.col("text"), order)).collect()} for order in (rules, rules[::-1])]
    assert both[0] == both[1]
    ordered = [r.name for r, _, _ in quality.plan_cascade(prose, rules)]
    assert sorted(ordered) == sorted(r.name for r in rules)
    kept = quality.keep_clean(spark, odd).collect()
    assert len(kept) == 3 and {r["doc_id"] for r in kept} == {6, 7, None}
    assert quality.quality_cascade(odd).columns == [*odd.columns, "failed_rule"]


def test_cascade_of_an_empty_table(spark, none):
    assert quality.keep_clean(spark, none).collect() == []


# 2


def test_masks_cover_every_radius():
    rng = random.Random(5)
    for radius in (1, 3, 5):
        found = simhash.masks(radius)
        assert len(found) == 2 ** (radius + 1) - 1
        for _ in range(300):
            bits = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & bits == 0 for m in found)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        counts = [c + (h >> b & 1) for b, c in enumerate(counts)]
    return sum(1 << b for b, c in enumerate(counts) if 2 * c > len(parts))


@pytest.mark.parametrize("block", [2, simhash.BLOCK])
def test_near_duplicates(spark, prose, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = {r["doc_id"]: r["text"] for r in prose.collect()}
    prints = {i: fingerprint(t) for i, t in rows.items()}
    union = Union(rows)
    for a in rows:
        for b in rows:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                union.join(a, b)
    got = {r["key"]: (r["value"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(prose).collect()}
    assert got == {i: (prints[i], union.find(i)) for i in rows}


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["value"] == 0} == {1}
    assert simhash.near_duplicates(none).collect() == [] and simhash.drop_copies(spark, none).collect() == []
    kept = simhash.drop_copies(spark, odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 6]


def test_near_copy_stage_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeinorst", k=rng.randint(2, 8))) for _ in range(900)]
    rows = []
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.randint(300, 2000))
        edits = [words, words[:-1], [*words, "tail"], words[:100] + ["other"] + words[101:], words[: len(words) // 2]]
        rows += [(len(rows) + i, " ".join(e).upper() if i == 2 else " ".join(e)) for i, e in enumerate(edits)]
    rows += [(None, rows[1][1]), (-1, ""), (-2, None), (rows[7][0], rows[7][1]), (rows[7][0], "a word")]
    prints = [fingerprint(t) for _, t in rows]
    union = Union(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                union.join(a, b)
    groups = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        groups[union.find(i)].append(k)
    want = sorted(min(x for x in ks if x is not None) for ks in groups.values())
    kept = simhash.drop_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == want and len(want) < len(rows) - 60


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100)] + [(200, 300 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    roots = defaultdict(set)
    for r in got:
        roots[r["root"]].add(r["node"])
    assert sorted(map(sorted, roots.values())) == [list(range(101)), [200, *range(300, 350)]]


def test_few_edges_are_joined_up_in_one_round(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")

    def groups(task_edges):
        roots = defaultdict(set)
        for r in components.components(edges, task_edges).collect():
            roots[r["root"]].add(r["node"])
        return sorted(map(sorted, roots.values()))

    by_rounds, made = groups(0), []
    monkeypatch.setattr(components, "materialize", lambda df, label, keep=components.materialize: made.append(label) or keep(df, label))
    assert groups(components.TASK_EDGES) == by_rounds and made == ["edges", "pointers"]
    assert groups(70) == by_rounds


# 3


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(bpe.tokenizer_path())


def test_bpe_remembers_heads_and_moves(library, monkeypatch):
    tokenizer, falls = bpe.ByteBpe(bpe.tokenizer_path()), []
    assert tokenizer.encode_piece(" qzxjvkwqq") == tuple(library.encode(" qzxjvkwqq").ids)
    monkeypatch.setattr(tokenizer.automaton, "follow", lambda *at: falls.append(at))
    assert tokenizer.encode_piece(" qzxjvkwqq") == tuple(library.encode(" qzxjvkwqq").ids) and not falls
    read = []
    monkeypatch.setattr(tokenizer, "read_on", lambda data, state, last, on=tokenizer.read_on: read.append(data) or on(data, state, last))
    tokenizer.encode_piece(" qzxjvkwqq")
    assert read == [b" qzxjvkwqq"[bpe.HEAD:]]


def test_bpe_decides_only_what_the_ids_need(library, monkeypatch):
    tokenizer, asked = bpe.ByteBpe(bpe.tokenizer_path()), []
    word = " responsibilitiesandinternationalization"
    tokenizer.encode_piece(word[:bpe.HEAD])
    monkeypatch.setattr(tokenizer, "last_at", lambda end, *rest, on=tokenizer.last_at: asked.append(end) or on(end, *rest))
    assert list(tokenizer.encode_piece(word)) == library.encode(word, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) < (len(word) - bpe.HEAD) / 2
    # A word of letters is one piece without asking the pattern.
    cut = []
    monkeypatch.setattr(tokenizer, "encode_pieces", lambda text, on=tokenizer.encode_pieces: cut.append(text) or on(text))
    text = "Some words of letters, don't"
    assert tokenizer.encode(text) == library.encode(text, add_special_tokens=False).ids and cut == ["Some", " letters,", " don't"]


def test_bpe_equals_the_library(library):
    rng = random.Random(2)
    own = bpe.ByteBpe(bpe.tokenizer_path())
    marks = "ab's ’é\n\t\u3000\u0301中😀١²\x1c\x00\u200b"
    texts = ["", " ", "<|endoftext|>", "a <|endoftext|> b", "x" * 3000, "ab" * 2000, " " * 500, "don't I'll we've"]
    texts += ["".join(rng.choices(marks, k=80)) for _ in range(400)] + ["".join(rng.choices("etaoinsr", k=300)) for _ in range(50)] + made_texts()
    texts += [" ".join(rng.choices(["the", "", "\n", "x.\ny", "b\t", "it's"], k=6)) for _ in range(300)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want and own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_last_stage_keeps_the_ids(spark, prose, odd):
    coder = bpe.load(bpe.tokenizer_path())
    for docs in (prose, odd):
        got = bpe.encode_stage(spark, docs).collect()
        assert len(got) == docs.count()
        for r in got:
            assert len(r["ids"]) == r["n_tokens"] and hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() == r["ids_sha256"]
        assert sorted(coder.decode(r["ids"]) for r in got) == sorted(r["text"] or "" for r in docs.collect())


def test_compatibility_of_neighbours_is_exact(library):
    own = bpe.ByteBpe(bpe.tokenizer_path())
    rng = random.Random(3)
    plain = [i for i in range(256, 50_000) if own.bytes_of[i].isalpha() and own.bytes_of[i].isascii()]
    for _ in range(3000):
        a, b = rng.choice(plain), rng.choice(plain)
        joined = (own.bytes_of[a] + own.bytes_of[b]).decode()
        assert own.stay_apart(a, b) == (library.encode(joined, add_special_tokens=False).ids == [a, b])


def test_bpe_of_odd_rows(spark, odd, none):
    path = bpe.tokenizer_path()
    back = bpe.decode(bpe.encode(odd, path), path).collect()
    assert [r["decoded"] for r in back] == [r["text"] or "" for r in back] and len(back) == len(ODD)
    assert [r["n_tokens"] for r in bpe.digests(odd, path).collect()] == [len(r["ids"]) for r in back]
    assert bpe.encode_stage(spark, none).collect() == []


# 6


def brute_repeats(rows, window=50):
    first = {}
    for key, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - window + 1):
            w = data[s:s + window]
            first[w] = min(first.get(w, key), key)
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - window + 1):
            if first[data[s:s + window]] < key:
                gone[s:s + window] = True
        out.append((len(data), int(gone.sum()), np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize(("pack_bytes", "hot_packs"), [(1 << 20, 1_024), (2_000, 1_024), (500, 2)])
def test_repeats_are_removed(spark, prose, pack_bytes, hot_packs):
    got = substrings.remove_repeats(prose, pack_bytes=pack_bytes, hot_packs=hot_packs).collect()
    rows = [(r["doc_id"], r["text"]) for r in prose.collect()]
    want = {k: w for (k, _), w in zip(rows, brute_repeats(rows), strict=True)}
    assert sum(w[1] for w in want.values()) > 1000
    for r in got:
        assert (r["n_bytes"], sum(b - a for a, b in r["removed"]), bytes(r["kept"])) == want[r["doc_id"]]
    assert len(got) == len(rows)


def test_sorted_collection():
    rng = random.Random(3)
    for _ in range(100):
        strings = [bytes(rng.choices(b"ab\x00\xff", k=rng.randrange(12))) for _ in range(rng.randint(1, 8))]
        made = substrings.Collection(strings)
        got = [strings[o][len(strings[o]) - n:] for o, n in zip(made.owner, made.length, strict=True)]
        assert got == sorted(s[i:] for s in strings for i in range(len(s) + 1))


def test_repeats_of_odd_rows(spark, odd, none):
    got = substrings.remove_repeats(odd).collect()
    left = [(r["doc_id"], r["text"]) for r in got if r["text"] and r["text"].startswith("the quick")]
    assert left == [(6, ODD[7][1])] and len(got) == len(ODD)
    assert substrings.remove_repeats(none).collect() == []
    stage = substrings.drop_repeats(spark, odd)
    assert stage.columns == odd.columns and stage.count() == len(ODD) - 2


def test_long_documents_are_cut_into_slices(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefghij ", k=1_200_000))
    rows = [(1, long), (2, "x" * 30 + long[1_048_500:1_048_700] + "y" * 30)]
    got = {r["doc_id"]: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1]["removed"] == [] and got[2]["removed"] == [[30, 230]]


# 4


def test_paragraphs_equal_brute_force(spark, prose):
    got = {(r["key"], r["at"]): (r["class_id"], r["removed"]) for r in paragraphs.repeated_paragraphs(prose).collect()}
    sets = {}
    for r in prose.collect():
        for at, line in enumerate(r["text"].encode().split(b"\n")):
            words = line.lower().split()
            if len(words) >= paragraphs.MIN_WORDS:
                sets[r["doc_id"], at] = set(simhash.shingles(words, 5))
    union = Union(sets)
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                union.join(a, b)
    groups = defaultdict(list)
    for k in sets:
        groups[union.find(k)].append(k)
    want = {k: (first[0], k != first) for first, ks in groups.items() if len(ks) > 1 for k in ks}
    assert got == want and len(want) > 10


def test_short_lines_stand_apart(spark):
    """One-word lines and other short ones repeat on their own and put no document in a class of paragraphs."""
    line = [f"w{i}" for i in range(30)]
    rows = [(1, "\n".join(["Title", "one", " ".join(line)])), (2, "other\n\ntitle\nONE"), (3, "title \n" + " ".join(line[:29])), (4, "one\na b\na  B\nc")]
    found = paragraphs.repeated_parts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    short = sorted((r["key"], r["at"], r["class_id"], r["shared"]) for r in found if r["kind"] == paragraphs.SHORT_LINE and r["removed"])
    assert short == [(2, 2, 1, True), (2, 3, 1, True), (3, 0, 1, True), (4, 0, 1, True), (4, 2, 4, False)]
    assert sorted((r["key"], r["at"], r["class_id"], r["removed"]) for r in found if r["kind"] == paragraphs.PARAGRAPH) == [(1, 2, 1, False), (3, 1, 1, True)]


def test_passages_are_found_whatever_their_lines(spark):
    """Stretches against brute force over all stretches; wrapped otherwise, inside longer lines, and at most once in most texts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdeinorst", k=7))
    passage = [word() for _ in range(300)]
    wrapped = "\n".join(" ".join(passage[i:i + 9]) for i in range(0, 300, 9))
    rows = [(i, " ".join(word() for _ in range(200))) for i in range(20)]
    rows += [(20, rows[3][1] + " " + " ".join(passage).upper() + " " + word()), (21, word() + "\n" + wrapped), (22, "  ".join(passage[40:180])), (None, wrapped), (24, None)]
    found = paragraphs.repeated_parts(spark.createDataFrame(rows, "doc_id bigint, text string")).where(F.col("kind") == paragraphs.STRETCHES).collect()
    places = defaultdict(list)
    for k, t in rows:
        words = (t or "").lower().split()
        for at in paragraphs.stretches([w.encode() for w in words]):
            if k is not None:
                places[tuple(words[at:at + paragraphs.STRETCH])].append((k, at))
    want = {p: min(ps) for ps in places.values() if len(ps) > 1 for p in ps}
    assert {(r["key"], r["at"]): r["class_id"] for r in found} == {p: first[0] for p, first in want.items()}
    assert {(r["key"], r["at"]) for r in found if r["removed"]} == {p for p, first in want.items() if p != first}
    assert {r["key"] for r in found} == {3, 20, 21, 22} and all(r["shared"] for r in found)
    every = [len(paragraphs.stretches([word().encode() for _ in range(4019)])) for _ in range(20)]
    assert abs(sum(every) / 20 / 4000 * paragraphs.EVERY - 1) < 0.1


def test_bands_reach_the_recall():
    bands, rows = paragraphs.tune_bands(0.8, 0.995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995 and bands * rows <= paragraphs.MOST_HASHES


def test_paragraphs_of_odd_rows(spark, odd, none):
    line = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, line), (1, line), (None, line), (2, None), (3, f"x\n{line}\n{line}")], "doc_id bigint, text string")
    found = paragraphs.repeated_paragraphs(rows)
    assert sorted((r["key"], r["at"], r["removed"]) for r in found.collect()) == [(1, 0, False), (1, 0, False), (3, 1, True), (3, 2, True)]
    assert sorted(r["text"] or "" for r in paragraphs.remove_paragraphs(rows, found).collect()) == sorted([line, line, line, "", "x"])
    assert paragraphs.repeated_paragraphs(none).collect() == []


# 5


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(rng.integers(0, 500, 400), p, strict=True)], "tokens bigint, p array<double>")
    whole = rows.agg(F.sum("tokens")).first()[0]
    targets = [0.5 * whole, 0.3 * whole, 0.2 * whole]
    fit = mixing.fit_rates(rows, targets)
    got = fit.rows.collect()
    assert fit.converged and fit.error < 0.01 and 0 < fit.steps < mixing.STEPS
    totals = sum(r["tokens"] * r["rate"] * np.array(r["p"]) for r in got)
    assert np.allclose(totals, targets, rtol=0.01) and min(r["rate"] for r in got) >= 0
    assert all(r["rate"] == 1 for r in got if r["tokens"] == 0)
    floor = mixing.fit_rates(rows, [0.9 * whole, 0.05 * whole, 0.05 * whole], least=1.0).rows.collect()
    assert min(r["rate"] for r in floor) >= 1


def test_steps_write_no_tables_and_equal_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(2)
    p, tokens = rng.dirichlet([0.5, 0.5, 0.5], 300), rng.integers(0, 500, 300)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p, strict=True)], "tokens bigint, p array<double>").repartition(3)
    base = (tokens[:, None] * p).sum(0)
    targets = np.array([1.3, 0.6, 0.2]) * base
    rate = np.ones(300)
    for _ in range(25):
        error = ((tokens[:, None] * p * rate[:, None]).sum(0) - targets) / base
        rate = np.where(tokens == 0, rate, np.maximum(0.1, rate - p @ error))
    monkeypatch.setattr(mixing, "materialize", None)
    monkeypatch.setattr(mixing, "DONE", 0.0)
    fit = mixing.fit_rates(rows, targets.tolist(), least=0.1, steps=25)
    got = {(r["tokens"], *r["p"]): r["rate"] for r in fit.rows.collect()}
    assert fit.steps == 25 and np.allclose([got[int(n), *x.tolist()] for n, x in zip(tokens, p, strict=True)], rate, rtol=1e-9)


def test_mixing_learns_domains_and_takes_odd_rows(spark, odd, none):
    rng = random.Random(4)
    kinds = {"good": ["sun", "tree", "river"], "toxic": ["idiot", "clown", "moron"]}
    rows = [(i, " ".join(rng.choices([*kinds[d], "the", "of", "and"], k=40)), d) for i, d in enumerate(rng.choices(list(kinds), [3, 1], k=300))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, domain string")
    found, domains, _ = mixing.mix(docs, docs.where("doc_id % 3 > 0"), {"good": 0.5, "toxic": 0.5, "absent": 1.0})
    got = {r["key"]: domains.names[int(np.argmax(r["p"]))] for r in found.collect()}
    assert np.mean([got[i] == d for i, _, d in rows if i % 3 == 0]) > 0.95
    some = odd.withColumn("domain", F.when(F.col("doc_id") < 4, "a"))
    assert mixing.mix(some, some, {"a": 1.0})[0].count() == len(ODD)
    nothing = none.withColumn("domain", F.lit("a"))
    assert mixing.mix(nothing, nothing, {"a": 1.0})[0].collect() == []


def test_pipeline_mixture_meets_its_weights(spark, tmp_path):
    rng = random.Random(6)
    kinds = {"good": ["sun", "tree", "river"], "poor": ["click", "buy", "offer"], "toxic": ["idiot", "clown", "moron"]}
    of = rng.choices(list(kinds), [75, 12, 13], k=600)
    rows = [(i, " ".join(rng.choices([*kinds[d], "the", "of"], k=40))) for i, d in enumerate(of)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = [(i, int(d == "good") if d != "toxic" else None, int(d == "toxic")) for i, d in enumerate(of)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = [r["doc_id"] for r in mixing.repeat_to_targets(spark, docs, str(tmp_path)).collect()]
    for d, w in mixing.KEPT_TARGETS.items():
        assert abs(sum(of[i] == d for i in out) / len(out) - w) < 0.03
    assert abs(len(out) / len(rows) - 1.1) < 0.05 and {i for i, d in enumerate(of) if d == "good"} <= set(out)


# 1


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op1_language"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out")
    right, rows = got.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count("*")).first()
    assert right / rows > 0.97


def test_language_of_odd_rows(spark, odd, none):
    model = language.fit(odd)
    got = language.identify(odd, model)
    assert got.columns == [*odd.columns, "lang_pred", "score", "margin", "accepted"]
    for r in got.collect():
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not re.search("[a-z]", r["text"] or ""))
    assert language.identify(none, language.fit(none)).collect() == []
    assert {r["lang_pred"] for r in language.identify(odd, language.Model((), ())).collect()} == {"und"}


# 9


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 3)
    html = ["", None, "short", "short", "\r\n\r\nWARC/1.1\r\n\r\n" * 9, "é" * 5000, "é" * 5000, "z" * 99, "z" * 99, "z" * 100, "z" * 100, "z" * 100]
    rows = [(i, f"http://h/{i}\r\nx", h) for i, h in enumerate(html)] + [(None, None, "z" * 100), (5, "u", "é" * 5000)]
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path, segment_bytes=700)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows)
    whole = sorted(bytes(r["payload"]) for r in got if r["type"] == "response")
    assert whole == sorted((h or "").encode() for i, _, h in rows if (i, h) not in {(6, "é" * 5000), (10, "z" * 100), (11, "z" * 100), (None, "z" * 100)})
    # A revisit names the id of one response with its payload, and every record has an id of its own.
    named = {r["record_id"]: r for r in got if r["type"] == "response"}
    assert len({r["record_id"] for r in got}) == len(rows)
    revisits = [r for r in got if r["type"] == "revisit"]
    assert all(named[r["refers_to"]]["digest"] == r["digest"] for r in revisits)
    assert sorted(r["refers_to"].split(":")[2] for r in revisits) == ["5", "9", "9", "9"]
    empty = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), empty)
    assert warc.read_warc(spark, empty).collect() == []


def test_lost_segments_are_noticed():
    block = warc.HTTP + warc.chunked(b"abc" * 10)
    assert warc.payload_of(block) == b"abc" * 10 and warc.unchunk(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError, match="chunk"):
        warc.unchunk(b"2\r\nabc\r\n0\r\n\r\n")


# 8


def test_url_parts_and_rules(spark):
    rows = [("http://WWW.Example.COM/en/1?x", "www.example.com", "/en/1", "www.example.com/en/"), ("x://a.example.com/en/#y", "a.example.com", "/en/", "example.com/en/"),
            ("https://example.com", "example.com", "", None), ("q://badexample.com/en/", "badexample.com", "/en/", "com/"), ("h://n.net/fr/a/b", "n.net", "/fr/a/b", "net/fr/"),
            ("no scheme", "", "", None), (None, "", "", None), ("a://b?c://d/e", "b", "", None)]
    df = spark.createDataFrame(rows, "url string, h string, p string, r string")
    got = df.select("*", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    for r in got.select("*", urls.rule_of(F.col("host"), F.col("path")).alias("x")).collect():
        assert (r["host"], r["path"], r["x"] and r["x"]["rule"]) == (r["h"], r["p"], r["r"])


def test_words_and_labels_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(urls, "SUBSTRINGS", 7)
    long = "donaudampfschifffahrtsgesellschaft"
    pages = spark.createDataFrame([(f"<p>{long} {long} news",), (None,), ("",)], "html string")
    counts = urls.word_counts(pages)
    labels = spark.createDataFrame([("news" + long,), ("",), (None,), ("q" * 5000 + "news",), ("news" + long,)], "label string")
    got = {r["label"]: r["words"] for r in urls.segment(labels, counts).collect()}
    assert got == {"news" + long: ["news", long], "q" * 5000 + "news": ["q" * 5000, "news"]}
    assert urls.segment(labels, counts.where("false")).count() == 2


def test_viterbi_is_the_cheapest_split():
    rng = random.Random(6)
    for _ in range(200):
        cost = {"".join(rng.choices("ab", k=rng.randint(1, 3))): rng.random() * 5 for _ in range(6)}
        label = "".join(rng.choices("ab", k=rng.randint(1, 8)))

        def price(parts, cost=cost):
            return sum(cost.get(p, 9.0 if len(p) == 1 else 1e9) for p in parts)

        def splits(s):
            return [[s[:i], *rest] for i in range(1, len(s) + 1) for rest in (splits(s[i:]) if i < len(s) else [[]])]

        found = urls.viterbi(label, cost, 9.0)
        assert "".join(found) == label and price(found) == pytest.approx(min(map(price, splits(label))))


def test_classifier_follows_host_words(spark, none):
    rows = [(i, f"http://{h}.net/{p}/{i}") for i, (h, p) in enumerate([("badspam", "es"), ("badclick", "fr")] * 10)]
    rows += [(100 + i, f"http://{h}.com/good/{i}") for i, h in enumerate(["nicehome", "nicebook"] * 10)]
    rows += [(200, "http://badhome.org/"), (201, "http://nicenice.org/good/"), (202, None), (203, "junk"), (203, "junk")]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    words = spark.createDataFrame([(" ".join(["bad", "spam", "click", "nice", "home", "book"] * 5),)], "html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df.withColumn("host", F.lit(1)), urls.word_counts(words)).collect()}
    assert got[200] == "block" and got[201] == "allow" and got[0] == "block" and got[100] == "allow" and got[202] == got[203]
    assert urls.judge(none, urls.word_counts(none, "text"), url="text").collect() == []


# 10


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    x[700:1000] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(neighbours.search(df, df.where("vec_id % 20 = 0"), k=10).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = []
    for q in range(0, 1500, 20):
        scores = x @ x[q]
        best = [i for i in sorted(range(1500), key=lambda i: (-round(scores[i], 9), i)) if i != q][:10]
        assert len(got[q]) == 10 and all(abs(scores[i] - s) < 1e-9 for i, s in got[q])
        hits.append(len(set(best) & {i for i, _ in got[q]}) / 10)
    assert np.mean(hits) >= 0.9


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [2.0, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in neighbours.search(df, df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 6, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (20, 1, 6, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0)]
    assert neighbours.search(df.limit(0), df.limit(0)).collect() == []


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as pipe

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = pipe.run(spark, sf).collect()
    known = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [n for n, _ in pipe.STAGES] == ["quality", "near_copies", "passages", "mixture", "tokens"]
    assert out and {r["doc_id"] for r in out} <= known and hashlib.sha256(b"").hexdigest() not in {r["ids_sha256"] for r in out}
