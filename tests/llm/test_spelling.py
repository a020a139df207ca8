"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from rectide.llm.spelling import near_words, one_edit_pairs, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def counted(rows, noise=31, min_length=7, min_count=2):
    words = Counter()
    for doc_id, text in rows:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= min_count}


def brute(words, ratio=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def some_words(seed=5, n=400):
    rng = random.Random(seed)
    words = {"a" * 7, "a" * 8, "a" * 9, "a" * 3000, "a" * 3001, "ab" * 4, "ba" * 4, "éàüÿ×÷ñ", "éàüÿ×÷ñs", "xaaaaaaa", "aaaaaaax"}
    while len(words) < n:
        w = rng.choice(sorted(words)) if rng.random() < 0.6 else "".join(rng.choice("abé") for _ in range(rng.randrange(7, 12)))
        at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        w = w[:at] + (rng.choice("abcé") if kind else "") + w[at + (kind < 2) :]
        if len(w) >= 7:
            words.add(w)
    return sorted(words)


def test_search_schemes_find_every_pair():
    words = some_words()
    queries = words[::2] + ["bbbbbbbbbbbbbb", "aaaaaab"]
    want = {(q, w) for q in queries for w in words if one_edit(q, w)}
    found = {left: {(queries[q], words[w]) for q, w in zip(*one_edit_pairs(words, queries, left))} for left in (True, False)}
    assert found[True] | found[False] == want
    for left, pairs in found.items():  # the exact half is a half of the query
        for q, w in pairs:
            half = len(q) // 2
            assert w.startswith(q[:half]) if left else w.endswith(q[half:])


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 50}, {"cell_words": 6}])
def test_near_words(spark, sizes):
    words = {w: i % 7 + 1 for i, w in enumerate(some_words(8, 250))}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    got = near_words(df, **sizes).collect()
    assert sorted(map(tuple, got)) == sorted((w, v, words[v]) for w in words for v in words if one_edit(w, v))


def test_spelling_variants(spark, no_docs):
    rng = random.Random(2)
    words = some_words(9, 120)
    weight = [3.0 ** -(i % 9) for i in range(len(words))]
    rows = [
        (i, rng.choice([" ", "-", "7", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words[:-4], weight[:-4], k=60)))
        for i in range(60)
    ]
    rows += [(None, "Fortunate fortunate fortunatex"), (None, "Fortunate fortunate"), (3, None), (4, ""), (5, "short")] + [rows[0]] * 3
    rows += [(900 + i, "chainlong " * 200 + "chainlon " * 10) for i in range(3)] + [(1000, "chainlo chainlo")]
    want = brute(counted(rows))
    assert any(r[5] != r[3] and r[3] for r in want) and any(r[0] == "fortunate" for r in want)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    key = lambda r: r[0]
    assert sorted((tuple(r) for r in spelling_variants(df).collect()), key=key) == want
    assert spelling_variants(no_docs).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(df, ratio=1)
