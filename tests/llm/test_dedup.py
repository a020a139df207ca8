"""Window, suffix-array and SimHash dedup against brute force."""

import hashlib
import re

import numpy as np
import xxhash

from rectide.llm.components import components
from rectide.llm.simhash_dedup import links, simhash_dedup
from rectide.llm.suffix_dedup import SuffixFamily, _plan, suffix_dedup
from rectide.llm.window_dedup import window_dedup
from rectide.llm.words import split_parts, unpack, word_table

WORD = re.compile("[^\x20\x09-\x0d]+")


def ordered(rows):
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def removed(units, size, seen):
    gone = [False] * len(units)
    for i in range(len(units) - size + 1):
        key = units[i : i + size] if isinstance(units, bytes) else tuple(units[i : i + size])
        if key in seen:
            gone[i : i + size] = [True] * size
        seen.add(key)
    return gone


def test_window_dedup(docs, rows):
    seen, want = set(), []
    for doc_id, text in ordered(rows):
        words = WORD.findall(text or "")
        gone = removed(words, 20, seen)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        want.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert any(r[2] for r in want)
    for options in ({"block_bytes": 4000}, {"block_bytes": 1 << 20, "depth": 1, "cells_per_word": 1}):
        got = [tuple(r) for r in window_dedup(docs, **options).collect()]
        assert sorted(got) == sorted(want)


def test_suffix_dedup(docs, rows):
    seen, want = set(), []
    for doc_id, text in ordered(rows):
        data = (text or "").encode()
        gone = removed(data, 100, seen)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = [i for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1])]
        want.append((doc_id, len(data), sum(gone), len(spans), hashlib.sha256(kept).hexdigest(), kept))
    assert any(r[2] for r in want)
    for options in ({"block_bytes": 4000, "batch_suffixes": 64}, {}):
        got = suffix_dedup(docs, **options).collect()
        for r in got:
            assert all(s.begin < s.end for s in r.spans) and sum(s.end - s.begin for s in r.spans) == r.n_removed
        assert sorted((r[0], r[1], r[2], r[3], r[4], bytes(r[5])) for r in got) == sorted(want)


def test_suffix_dedup_splits_a_hot_anchor(spark):
    """One passage with other bytes around it in each document: no shard gets most of the letters."""
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = noise(150)
    data = [(i, noise(120) + passage + noise(120)) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    seen, want = set(), {}
    for doc_id, text in data:
        want[doc_id] = sum(removed(text.encode(), 100, seen))
    share = {}
    for limit in (2000, 1 << 40):
        got = {r.doc_id: r.n_removed for r in suffix_dedup(df, block_bytes=8000, anchor_bytes=limit).collect()}
        assert got == want and sum(want.values()) >= 150 * 399
        letters = _plan(df, 100, 1, 1, 1 << 16, 8000, limit)[2].collect()
        by_shard = {}
        for r in letters:
            sizes = unpack(split_parts(r.data)[0]).astype(np.int64)
            by_shard[r.shard] = by_shard.get(r.shard, 0) + int((sizes - 99).sum())
        share[limit] = max(by_shard.values()) / sum(by_shard.values())
    assert share[2000] < 0.2 < 0.4 < share[1 << 40]


def test_null_ids_come_last(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (9, text), (-4, text)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in window_dedup(df).collect()} == {-4: 0, 9: 40, None: 40}
    assert {r.doc_id: r.n_removed for r in suffix_dedup(df).collect()} == {-4: 0, 9: len(text), None: len(text)}


def test_empty_tables(no_docs):
    assert window_dedup(no_docs).collect() == []
    assert suffix_dedup(no_docs).collect() == []
    assert simhash_dedup(no_docs).collect() == []


def test_suffix_family_levels():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 3000, dtype=np.uint8)
    family, seen = SuffixFamily(8), set()
    for begin in range(0, 2900, 100):
        starts = np.arange(begin, begin + 100)
        got = family.add(text, starts)
        for s, late in zip(starts, got):
            key = text[s : s + 8].tobytes()
            assert late == (key in seen)
            seen.add(key)
    ranks = [rank for rank, _ in family.levels]
    assert ranks == sorted(set(ranks), reverse=True)
    assert sum(len(level) for _, level in family.levels) == len(seen)


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    todo = sorted(fps)
    for i, a in enumerate(todo):
        for b in todo[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_simhash_dedup(docs, rows):
    fp = [(r[0], fingerprint(r[1])) for r in rows]
    root = brute_components({f for _, f in fp}, 4)
    least = {}
    for doc_id, f in fp:
        least[root[f]] = min(least.get(root[f], doc_id), doc_id)
    want = sorted((d, f"{f:016x}", least[root[f]]) for d, f in fp)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup(docs).collect())
    assert got == want


def test_links_of_dense_balls(spark):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(6):
        center = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(40):
            f = center
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                f ^= 1 << int(bit)
            fps.add(f)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 100)} | {0, (1 << 64) - 1}
    want = brute_components(fps, 4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for options in ({"bucket": 4}, {"bucket": 64}, {"parts": 1}):
        edges = links(df, 4, **options).collect()
        for a, b in edges:
            assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
        parent = {signed(f): signed(f) for f in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        groups = {}
        for f in fps:
            groups.setdefault(find(signed(f)), set()).add(want[f])
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len(set(want.values()))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (201, 202), (5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in [*range(51), 100]}, 200: 200, 201: 200, 202: 200}
    assert components(df.limit(0)).collect() == []


def complementary_words(n=1024):
    """Two words without a common letter position whose polynomial hashes modulo 2**64 are equal."""
    one = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_window_dedup_tells_thue_morse_words_apart(spark):
    one, two = complementary_words()
    df = spark.createDataFrame([(1, " ".join([one] * 20)), (2, " ".join([two] * 20))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in window_dedup(df).collect()} == {1: 0, 2: 0}


def test_word_digests():
    one, two = complementary_words()
    texts = [one, two, "x" * 8, "x" * 9, "x" * 16, "x" * 17, "\0" * 3, "\0" * 4, "ab", "ba", "x" * 8 + "y" * 8, "y" * 8 + "x" * 8]
    words = word_table([t.encode() for t in texts])
    assert len(words.hashes) == len(texts)
    assert len(set(words.hashes.tolist() + words.digest(1).tolist())) == 2 * len(texts)
    alone = [word_table([b" " + t.encode()]) for t in texts]
    assert [w.hashes[0] for w in alone] == words.hashes.tolist()
    assert [w.digest(1)[0] for w in alone] == words.digest(1).tolist()


def test_pairs_with_equal_first_hashes():
    from rectide.llm.window_dedup import _first_of_each

    rng = np.random.default_rng(5)
    for values in (3, 1000):
        one = rng.integers(0, values, 300).astype(np.uint64)
        for two in (one * np.uint64(7), rng.integers(0, 2, 300).astype(np.uint64)):
            first, number = _first_of_each(one, two)
            pairs = list(zip(one.tolist(), two.tolist()))
            assert [pairs[i] for i in first] == sorted(set(pairs))
            assert first.tolist() == [pairs.index(p) for p in sorted(set(pairs))]
            assert [pairs[first[k]] for k in number] == pairs
