"""Decontamination, host rules, classifier, language model and license scan against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from rectide.llm.backoff_lm import backoff_lm
from rectide.llm.decontaminate import decontaminate
from rectide.llm.ftrl_quality import ftrl_quality, with_quality
from rectide.llm.host_rules import host_rules, rule_counts
from rectide.llm.license_scan import (
    LONG_TEMPLATES,
    TEMPLATES,
    license_scan,
    license_windows,
    size_bounds,
    template_bigrams,
    template_words,
)

WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def benchmark_rows(rows):
    words = rows[1][1].split()
    return [
        (1, "nothing of this occurs in any document at all ever, no word of it does"),
        (2, " ".join(words[len(words) // 2 - 9 : len(words) // 2 + 9]).upper()),
        (3, "One"),
        (30, "one"),
        (4, " , ; "),
        (5, None),
        (None, "a b"),
        (6, "word " * 12),
        (7, ""),
    ]


def brute_decontaminate(doc_rows, items):
    windows = []
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.append(("" if item is None else str(item), tuple(w[i : i + 10])))
    out = []
    for row in doc_rows:
        words = ALNUM.findall(lower(row[1]))
        hit, found = set(), set()
        for item, window in windows:
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((row[0], len(words), len(hit), len(found), sha, bool(hit)))
    return sorted(out)


def test_decontaminate(spark, docs, rows, benchmark_rows, no_docs):
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    want = brute_decontaminate(rows, benchmark_rows)
    assert len({r[3] for r in want}) > 2
    got = sorted(tuple(r) for r in decontaminate(docs, bench).drop("row_key").collect())
    assert got == want
    assert decontaminate(no_docs, bench).collect() == []
    clean = decontaminate(docs, bench.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r.contaminated or r.n_items for r in clean)


def brute_counts(text):
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(hit)


def test_host_rules(docs, rows, no_docs):
    want, hosts = [], {}
    for row in rows:
        counts = brute_counts(row[1] or "")
        assert rule_counts(row[1] or "") == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        hosts.setdefault(row[3], []).append(failed)
        want.append((row[0], *counts, failed, row[3]))
    rates = [sum(f) / len(f) for f in hosts.values()]
    m = sum(rates) / len(rates)
    noise = m * (1 - m) * sum(1 / len(f) for f in hosts.values()) / len(hosts)
    between = max(0, sum((r - m) ** 2 for r in rates) / len(rates) - noise)
    strength = max(m * (1 - m) / between - 1, 1e-6) if between else sum(map(len, hosts.values())) / len(hosts)
    shrunk = {h: (sum(f) + m * strength) / (len(f) + strength) for h, f in hosts.items()}
    limit = sorted(shrunk.values())[len(shrunk) // 2] - 1e-9
    got = host_rules(docs, max_host_rate=limit).collect()
    assert {r.kept for r in got} == {True, False}
    for r in got:
        assert math.isclose(r.host_shrunk, shrunk[r.host], rel_tol=1e-9)
    key = lambda r: str(r)
    assert sorted([(*r[:7], r.kept) for r in got], key=key) == sorted(
        [(*r[:7], not r[6] and shrunk[r[7]] <= limit) for r in want], key=key
    )
    assert host_rules(no_docs).collect() == []


def test_host_limit_comes_from_the_prior(spark):
    good, bad = "w%d " * 60, "too short"
    rows = []
    for host in range(20):
        for i in range(30):
            fails = i < 27 if host == 7 else i == 0  # one host fails nearly always, the others now and then
            rows.append((host * 100 + i, bad if fails else good % tuple(range(60)), f"h{host}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = host_rules(df).collect()
    assert all(r.kept == (not r.base_failed and r.host != "h7") for r in got)
    assert sum(not r.kept and not r.base_failed for r in got) == 3
    alike = host_rules(df.filter("source <> 'h7'")).collect()
    assert all(r.kept == (not r.base_failed) for r in alike)


def test_quality_learns_from_training_folds_only(spark):
    good = "the quiet river ran over the stones and the children read by its side".split()
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        text = " ".join(["x%d |" % (j * i % 17) for j in range(20)] if bad else good[i % 5 :] + good[: i % 7])
        rows.append((i, text, "clash"))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        # labels of the held-out fold are turned round: they must not matter
        labels.append((i, int(bad) if held else int(not bad), 0))
    labels += [(1, None, 0), (None, 1, 0), (7, 9, 0)]
    docs = spark.createDataFrame(rows + [(None, None, "c"), (1000, "", "c")], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ftrl_quality(docs, marks).collect()}
    assert len(got) == 402
    for i in range(400):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == int(i % 3 != 0) == int(got[i].score >= 0.3)
    assert 0 <= got[1000].score <= 1 and got[1000].score == got[None].score and not got[None].held_out
    wide = with_quality(docs, marks, "quality_score")
    assert wide.columns == ["doc_id", "text", "score", "quality_score"]
    assert {r.quality_score for r in with_quality(docs, marks.limit(0), "quality_score").collect()} == {0.5}
    assert ftrl_quality(docs.limit(0), marks).collect() == []


def test_quality_learns_every_sampled_id(spark):
    """An id repeated in more rows than the sample holds leaves room for the other ids."""
    from pyspark.sql import functions as F

    good = "the quiet river ran over the stones and the children read by its side".split()
    ids = spark.range(400).filter(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    hot = ids.orderBy(F.xxhash64(F.lit(42), "id")).first().id
    bad = lambda i: i % 3 == 0 and i != hot
    rows = [(i, " ".join(["x%d |" % (j * i % 17) for j in range(20)] if bad(i) else good[i % 5 :] + good[: i % 7])) for i in range(400)]
    rows += [(hot, " ".join(good) + f" again{i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(not bad(i))) for i in range(400)], "doc_id long, quality int")
    got = ftrl_quality(docs, marks, sample_rows=ids.count()).collect()
    assert len(got) == 1400
    assert all(r.predicted == int(not bad(r.doc_id)) for r in got)


def test_backoff_lm(docs, rows, no_docs):
    tokens = [(r[0], WORD.findall(lower(r[1])) + ["</s>"]) for r in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in tokens if not held(i)]
    uni = Counter(w for t in train for w in t)
    bi = Counter(p for t in train for p in zip(["<s>", *t], t))
    follow, kinds = Counter(), Counter()
    for (h, _), c in bi.items():
        follow[h] += c
        kinds[h] += 1
    n, v = sum(uni.values()), len(uni)
    want = {}
    for i, t in tokens:
        base = score = 0.0
        for h, w in zip(["<s>", *t], t):
            root = (uni[w] + 1) / (n + v + 1)
            base += math.log10(root)
            score += math.log10((bi[h, w] + kinds[h] * root) / (follow[h] + kinds[h]) if follow[h] else root)
        want[i] = (held(i), len(t), sum(uni[w] > 0 for w in t), n, base, score)
    for options in ({"block_bytes": 3000}, {}):
        got = backoff_lm(docs, **options).collect()
        assert len(got) == len(rows)
        for r in got:
            assert tuple(r)[1:5] == want[r.doc_id][:4]
            assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9)
            assert math.isclose(r.score, want[r.doc_id][5], rel_tol=1e-9)
    assert backoff_lm(no_docs).collect() == []


def test_backoff_probabilities_sum_to_one(spark):
    rows = [(i, t) for i, t in enumerate(["a b a", "b b", "c a b", "a", "b c c"])]
    follows = ["a", "b", "c", "zz"]
    probes = [(100 + i, f"a {w}") for i, w in enumerate(follows)] + [(200, "a")]
    df = spark.createDataFrame(rows + [p for p in probes], "doc_id long, text string")
    # hold all probes out: a fold rule on ids cannot, so train on everything and compare inside one model
    got = {r.doc_id: r for r in backoff_lm(df).collect()}
    assert all(r.score < 0 and r.train_tokens == got[0].train_tokens for r in got.values())


def test_license_scan(spark, docs, rows, no_docs):
    grams = [(n, set(template_bigrams(t))) for n, t in TEMPLATES]

    def brute(text):
        units = (text or "").split("\n") + [text or ""]
        found = []
        for u in units:
            g = set(template_bigrams(u))
            scores = [(2 * len(g & t) / (len(g) + len(t)), n) for n, t in grams if len(g) + len(t)]
            if max(scores)[0] >= 0.8:
                found.append(max(scores))
        return len(units), len(found), ",".join(sorted({n for _, n in found})), max(found, default=(None, None))

    more = [
        (1, "intro line\nLicensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", "x"),
        (2, "This work is licenced under the GNU General Public License, version 3!", "x"),
        (3, "Released under the MIT License", "x"),
        (4, "Released under a license", "x"),
    ]
    small = spark.createDataFrame(more, "doc_id long, text string, licenses string")
    for df, data in ((docs, rows), (small, more)):
        got = license_scan(df).collect()
        key = lambda r: str(r)
        want = []
        for r in data:
            n, k, names, (dice, best) = brute(r[1])
            want.append((r[0], n, k, names, best, dice))
        assert sorted([(r[0], r[1], r[3], r[4], r[5], r[6]) for r in got], key=key) == sorted(want, key=key)
    assert license_scan(no_docs).collect() == []
    assert all(r.n_matches == 0 for r in license_scan(docs, []).collect())


def test_license_windows(spark, docs, rows, no_docs):
    known = [(n, set(template_bigrams(t)), len(template_words(t)) - 1) for n, t in TEMPLATES + LONG_TEMPLATES]

    def brute(text):
        words = template_words(text or "")
        grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
        found = []
        for name, t, span in known:
            if len(t & set(grams)) < size_bounds(len(t), 0.8)[0]:
                continue
            windows = [set(grams[i : i + span]) for i in range(len(grams)) if grams[i] in t]
            dice = max(2 * len(w & t) / (len(w) + len(t)) for w in windows)
            if dice >= 0.8:
                found.append((dice, name))
        return len(found), ",".join(sorted({n for _, n in found})), max(found, default=(None, None))

    mit = dict(LONG_TEMPLATES[:1])["MIT"]
    gpl = dict(LONG_TEMPLATES)["GPL-3.0"]

    def wrap(text, size, lead=""):
        words = text.split()
        return "\n".join(lead + " ".join(words[i : i + size]) for i in range(0, len(words), size))

    more = [
        (1, "MIT License\n\nCopyright (c) 2020 Example\n\n" + wrap(mit, 11) + "\n", "MIT"),
        (2, "#!/bin/sh\n" + wrap(gpl, 9, "# ") + "".join(f"\necho step {i} done" for i in range(50)), "GPL-3.0"),
        (3, "Copyright 2020 Example. Licensed under the MIT License.", "MIT"),
        (4, "prose " * 5000 + "Licensed under\nthe MIT\nLicense. " + "more " * 5000, "MIT"),
        (5, "Released under a license", ""),
        (6, None, ""),
        (7, "Licensed under CC BY-SA 4.0. " * 300, "CC-BY-SA-4.0"),
    ]
    small = spark.createDataFrame(more, "doc_id long, text string, want string")
    got = {r.doc_id: r for r in license_windows(small).collect()}
    for i, _, want in more:
        assert (want in got[i].licenses.split(",")) if want else got[i].licenses == ""
    # lines alone, with the same templates, miss the wrapped and the embedded notices
    lines = {r.doc_id: r for r in license_scan(small, TEMPLATES + LONG_TEMPLATES).collect()}
    assert all(lines[i].n_matches == 0 for i in (2, 3, 4))
    for df, data in ((docs, rows), (small, more)):
        want = sorted(((r[0], *brute(r[1])) for r in data), key=str)
        found = license_windows(df).collect()
        assert sorted(((r[0], r[3], r[4], (r[6], r[5])) for r in found), key=str) == want
    assert license_windows(no_docs).collect() == []
    assert all(r.n_matches == 0 for r in license_windows(docs, []).collect())


def test_backoff_lm_tells_thue_morse_words_apart(spark):
    one = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    train = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 != 2)
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(train, one), (held, two)], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in backoff_lm(df).collect()} == {train: 2, held: 1}
