"""Periodic runs, exact top-k search and collocations against brute force, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import periodic, phrases, topk

# 11


def brute_runs(words, least=periodic.LEAST):
    best = {}
    for p in range(len(words) // 2, 0, -1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                best[i, j + p] = p
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in best.items())


def word_texts(rng, n):
    fibonacci = "a", "ab"
    while len(fibonacci[1]) < 150:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    for i in range(n):
        block = [rng.choice("abc") for _ in range(rng.randint(1, 50))]
        root = "abc"[:rng.randint(1, 3)] * 40
        yield (list(fibonacci[1][:rng.randint(20, 150)]), [rng.choice("ab") for _ in range(rng.randint(0, 120))], block * rng.randint(2, 5) + block[:3],
               list(root[:rng.randint(9, 90)]) * 2, list(root[:rng.randint(9, 60)] + "d" + root[:rng.randint(9, 60)]) * 2)[i % 5]


@pytest.mark.parametrize("least", [2, 12])
def test_runs_equal_brute_force(least, monkeypatch):
    monkeypatch.setattr(periodic, "TOP", 4)
    rng = random.Random(least)
    texts = [[c.encode() for c in t] for t in word_texts(rng, 300)]
    got = periodic.runs_of(texts, least)
    for words, runs in zip(texts, got, strict=True):
        assert [(a, b - a, p) for a, b, p in runs.tolist()] == brute_runs(words, least)


def test_a_wrong_hash_is_noticed(monkeypatch):
    """Runs are those of the words even where all hashes are equal."""
    monkeypatch.setattr(periodic, "mixed", lambda x: x & np.uint64(1))
    words = [c.encode() for c in "abcabcabcabcaXbcabcabcabcabcab"]
    assert [(a, b - a, p) for a, b, p in periodic.runs_of([words])[0].tolist()] == brute_runs(words)


def test_periodic_runs_of_rows(spark):
    rng = random.Random(2)
    rows = [(i, " \t".join(rng.choice(["x", "y", "Z"]) for _ in range(rng.randint(0, 70)))) for i in range(60)]
    rows += [(None, "a b " * 9), (7, None), (7, ""), (61, "\n\x0b"), (62, "w " * 40_000), (63, "é è " * 8)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, runs int, key int")
    got = sorted((r["key"] if r["key"] is not None else -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs, plant=True).collect())
    want = []
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words) if n < 1000 else [(0, n, 1)]
        gone = {i for a, k, p in runs for i in range(a + p, a + k)}
        want.append((key if key is not None else -1, n, runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert got == sorted(want) and sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows) > 3
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_periodic_digests(spark, tmp_path):
    text = "one two three " * 5 + "end"
    spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in periodic.op11(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert tuple(got[1])[1:] == (1, 0, 15, 3, 5000, sha("0,15,3\n"), sha("one two three end"))
    assert tuple(got[2])[1:] == (0, None, None, None, None, sha(""), sha(""))


# 12


def test_top_k_equals_brute_force(spark, monkeypatch):
    for name, value in (("SHARD", 16), ("QUERIES", 3), ("GROUP", 2), ("FAN", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.integers(-3, 4, 5) / 512] for _ in range(150)]
    vectors[40:90] = [vectors[0]] * 50  # a third are copies, so most scores tie
    rows = [(i, v, "x", 1) for i, v in enumerate(vectors)]
    odd = [(200, None), (210, [1.0, None, 0.0, 0.0, 0.0]), (220, [float("nan")] * 5), (230, [float("inf")] * 5), (None, vectors[0]), (240, [0.0] * 5), (250, [1.0, 2.0]), (260, []), (30, vectors[1]), (30, vectors[1])]
    rows += [(*r, "x", 1) for r in odd]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, ids string, d int").repartition(7)
    got = sorted(tuple(r) for r in topk.exact_top_k(df, df.where("vec_id % 10 = 0"), 10).collect())
    usable = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in usable:
        if q % 10 == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(a) == len(b))[:10]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    assert got == sorted(want)
    assert topk.exact_top_k(df.limit(0), df).collect() == [] and topk.exact_top_k(df, df.limit(0)).collect() == []


def test_large_products_are_exact(spark):
    rows = [(0, [2.0**20 + 1, 2.0**21]), (1, [2.0**20, 2.0**21 + 1]), (2, [2.0**45, 1.0]), (3, [2.0**45, -(2.0**45)]), (4, [-(2.0**60), 2.0**60])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = {i: [min(max(int(1024 * x), -(2**63)), 2**63 - 1) for x in v] for i, v in rows}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.exact_top_k(df, df).collect()}
    exact = {(a, b): sum(x * y for x, y in zip(whole[a], whole[b], strict=True)) for a in whole for b in whole if a != b}
    assert got == {k: min(max(s, -topk.LAST), topk.LAST) for k, s in exact.items()}


# 13


def brute_phrases(rows, least, longest, most, share):
    out = []
    for lang in {r[0] or "und" for r in rows}:
        f = Counter()
        for own, text in rows:
            if (own or "und") == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
                    words = re.findall(r"[^\x20\x09]+", piece)
                    f.update(tuple(words[i:i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        held = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in held.items():
            if not any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in held.items()):
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(12)]
    fixed = [" ".join(rng.choices(common + ["X", "é"], k=rng.randint(3, 7))) for _ in range(6)]
    rows = [(rng.choice(["en", "de", None, "und"]), rng.choice([", ", ".\n", " ", "\t"]).join([*rng.choices(fixed, k=rng.randint(0, 3)), " ".join(rng.choices(common, k=rng.randint(0, 30)))])) for _ in range(120)]
    return [*rows, ("en", None), (None, ""), ("fr", " . ,"), ("en", "W1 w2  w1\tw2!" * 3000)]


@pytest.mark.parametrize("most, ahead, share, bits", [(5, 1, 100, 1 << 16), (40, 2, 60, 1 << 16), (1000, 4, 100, 64)])
def test_phrases_equal_brute_force(spark, most, ahead, share, bits):
    rows = phrase_rows(most)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(5)
    got = phrases.collocations(docs, least=4, longest=4, most=most, share=share, ahead=ahead, bits=bits).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, 4, 4, most, share) and len(got) > 12


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")).collect() == []
