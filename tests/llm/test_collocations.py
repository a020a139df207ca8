"""Phrase collocations against brute force."""

import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from rectide.llm.collocations import Partition, _batches, _prefix_hash, collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile("[.,;:!?\x0a-\x0d]")
WORD = re.compile("[^\x20\x09]+")


def brute(rows, max_words=5, min_count=100, cover=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in SPLIT.split((text or "").translate(LOWER)):
            w = WORD.findall(piece)
            n[lang] += len(w)
            for size in range(1, max_words + 1):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        held = {g: c for g, c in counts.items() if len(g) > 1 and c >= min_count}
        found = []
        for g, a in held.items():
            inside = any(
                len(q) > len(g) and 100 * b >= cover * a and any(q[i : i + len(g)] == g for i in range(len(q)))
                for q, b in held.items()
            )
            if not inside:
                score, _, l, r = min(
                    (1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]])
                    for k in range(1, len(g))
                )
                found.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def test_collocations(spark, docs, rows, no_docs):
    spread = [(("en", "fr", None)[i // 6 % 3], r[1]) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(lang, t, 1, "x") for lang, t in spread], "lang string, text string, n long, word string")
    want = brute(spread, min_count=4)
    assert len({r[0] for r in want}) == 3 and any(r[2].count(" ") == 4 for r in want)
    for options in (
        {},
        {"group_suffixes": 40},  # prefixes up to four words are above the budget
        {"dictionary_words": 3},
        {"dictionary_words": 5, "group_suffixes": 100},
    ):
        got = collocations(df.repartition(6), min_count=4, **options).collect()
        assert sorted(map(tuple, got)) == want, options
    few = collocations(df, min_count=4, top=3, cover=60, max_words=3).collect()
    assert sorted(map(tuple, few)) == brute(spread, 3, 4, 60, 3)
    assert collocations(no_docs).collect() == []
    assert collocations(docs, min_count=10**6).collect() == []


def test_pieces_overlaps_and_cuts(spark):
    text = "Go go go, go. a\tb c\nd B"
    df = spark.createDataFrame([("x", text), ("x", text), ("x", None), ("x", "")], "lang string, text string")
    got = {r.phrase: (r.a, r.l, r.r, r.n, r.score) for r in collocations(df, min_count=2, max_words=2).collect()}
    # "go go" twice a text, overlapping; "go go" across the comma and "c d" across the line are none
    assert got["go go"] == (4, 8, 8, 18, 1000 * 4 * 18 // 64)
    assert set(got) == {"go go", "a b", "b c", "d b"}


def test_extended_prefixes_stay_in_one_group():
    rng = np.random.default_rng(3)
    paths = rng.integers(0, 3, (5000, 4)).astype(np.uint64) + np.uint64(1)
    counts = np.bincount(paths[:, 0].astype(int), minlength=4)[1:]
    part = Partition(counts, len(paths), 200)
    for depth in (1, 2, 3):
        codes, n = np.unique(_prefix_hash(paths, depth), return_counts=True)
        part.hot.append((codes[n > 200], n[n > 200]))
    group, length = part.assign(paths)
    assert length.min() == 3  # every prefix of two words is above the budget
    homes = defaultdict(set)
    for row, g, k in zip(paths.tolist(), group.tolist(), length.tolist()):
        homes[tuple(row[:k])].add(g)
    assert all(len(v) == 1 for v in homes.values())
    assert np.bincount(group).max() < 5 * 200


def test_pieces_are_numbered_without_a_number_for_each_byte():
    text = ("w" * 200 + " ") * 20_000 + ". a b! c"
    tracemalloc.start()
    found = list(_batches([pa.table({"lang": ["en"], "text": [text]}).to_batches()[0]]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    (_, table, piece), = found
    assert piece.tolist() == [0] * 20_000 + [1, 1, 2] and len(table.hashes) == 20_003
    assert peak < 20 * len(text)


def test_slices_of_text_are_small():
    texts = ["ab cd, " * 20_000] * 80  # 11 MB
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 80, "text": texts})
    tables = [table for _, table, _ in _batches([batch])]
    assert sum(len(t.starts) for t in tables) == 80 * 40_000
    assert max(len(t.raw) for t in tables) <= 4 << 20
