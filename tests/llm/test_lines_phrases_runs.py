"""Shared lines, collocations and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chatledger.llm import collocations, lines, periods

BLANKS = " \t\n\v\f\r"
UPPER_TO_LOWER = str.maketrans(lines.UPPER, lines.LOWER)
SCHEMA = "doc_id long, text string, lang string, key string, h1 long, d long, pos int, n long, words int, a long"


def clashing(spark, rows):
    """The rows with columns named like those that the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA).repartition(3)


def key(line: str) -> str:
    return line.strip(BLANKS).translate(UPPER_TO_LOWER)


def kept_lines(rows, min_docs, keep_first):
    """doc_id, text -> kept lines, by the definition."""
    count, first = Counter(), {}
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            count[k] += 1
    order = defaultdict(list)
    for doc_id, text in {(d, t or "") for d, t in rows}:
        for i, line in enumerate(text.split("\n")):
            order[key(line)].append(((doc_id is not None, doc_id or 0), text, i))
    for k, places in order.items():
        lowest = min(p[0] for p in places)
        first[k] = {(p[0], p[1]): p[2] for p in sorted(places, reverse=True) if p[0] == lowest}
    out = []
    for doc_id, text in rows:
        own = (text or "").split("\n")
        me = ((doc_id is not None, doc_id or 0), text or "")
        out.append((doc_id, own, [not (key(x) and count[key(x)] >= min_docs) or (keep_first and first[key(x)].get(me) == i)
                                  for i, x in enumerate(own)]))
    return out


def line_rows():
    draw = random.Random(7)
    some = [f"Line {i}" for i in range(12)] + ["", "  ", "\tLINE 3 ", "line 3"]
    rows = [(i, "\n".join(draw.choice(some) for _ in range(draw.randint(0, 9)))) for i in range(60)]
    rows += [(100 + i, "hot\n" * 40 + f"own {i}") for i in range(40)] + [(7, None), (None, "hot\nnull id"), (None, None), (200, "")]
    return rows + [rows[3]] * 6 + [(300 + i, "in nine") for i in range(9)] + [(400 + i, "in ten") for i in range(10)] + [
        (500, "\n".join(f"long {i}" for i in range(20000)) + "\nhot")]


@pytest.mark.parametrize(("min_docs", "partitions"), [(10, 2), (10, 40), (3, 200), (1, 5)])
def test_shared_lines(spark, min_docs, partitions):
    rows = line_rows()
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = lines.remove_shared(clashing(spark, [(*r, "en") for r in rows]), min_docs=min_docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = Counter()
    for doc_id, own, keep in kept_lines(rows, min_docs, False):
        left = "\n".join(x for x, k in zip(own, keep, strict=True) if k)
        want[doc_id, len(own), len(own) - sum(keep), hashlib.sha256(left.encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("batch", [7, 10000])
def test_keep_first_and_bitmaps(spark, batch):
    # One text for each id: among several documents without an id their hashes decide which is first.
    rows = [r for i, r in enumerate(line_rows()) if r[0] is not None and r not in line_rows()[:i]]
    rows = [r for r in rows if r != (7, None)] + [rows[3]] * 2
    docs = clashing(spark, [(*r, "en") for r in rows])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        bitmaps = lines.keep_bitmaps(docs, min_docs=2)
        bits = {r.doc_id: lines.kept_bits(bytes(r.keep), r.n_lines).tolist() for r in bitmaps.collect()}
        texts = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.apply_bitmaps(docs, bitmaps).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = kept_lines(rows, 2, True)
    assert bits == {d: keep for d, _, keep in want}
    assert texts == Counter((d, len(own), len(own) - sum(keep), "\n".join(x for x, k in zip(own, keep, strict=True) if k))
                            for d, own, keep in want)


def phrase_counts(rows):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER_TO_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in range(1, 5):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return counts, totals


def best_phrases(rows, least, percent, top):
    out = []
    counts, totals = phrase_counts(rows)
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        outer = Counter()
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        outer[p[i:j]] = max(outer[p[i:j]], a)
        found = []
        for p, a in often.items():
            if 100 * outer[p] >= percent * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return Counter(out)


def phrase_rows():
    draw = random.Random(9)
    vocabulary = ["the", "of", "Über", "ñandú", "a", "Zed", "x-1", "(b)", "w9"]
    rows = []
    for i in range(120):
        text = "".join(draw.choice(vocabulary) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(draw.randint(0, 40)))
        rows.append((i, text, draw.choice(["en", "de", None, "und"])))
    licence = "permission is hereby granted free of charge to any person obtaining a copy"
    rows += [(200 + i, f"{draw.choice(vocabulary)} {licence} x{i}; {licence}", "en") for i in range(25)]
    rows += [(300, "la " * 500, "en"), (301, None, "en"), (302, "", None), (None, "the of the of the of", "de")]
    return rows + [rows[5]] * 3 + [(400, " ".join(draw.choice(vocabulary) for _ in range(30000)), "xx")]


@pytest.mark.parametrize(("least", "percent", "top"), [(30, 80, 2000), (5, 80, 40), (2, 50, 2000)])
def test_collocations(spark, least, percent, top):
    rows = phrase_rows()
    got = collocations.collocations(clashing(spark, rows), min_count=least, inside_percent=percent, top=top).collect()
    assert Counter(map(tuple, got)) == best_phrases(rows, least, percent, top)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = phrase_rows()
    monkeypatch.setattr(collocations, "_bitmap", lambda counted, least: np.full(1 << (collocations.BITS - 3), 255, np.uint8))
    got = collocations.collocations(clashing(spark, rows), min_count=5).collect()
    assert Counter(map(tuple, got)) == best_phrases(rows, 5, 80, 2000)


def test_flows_and_paths(spark):
    rows = phrase_rows()
    grams, totals = collocations.edges(clashing(spark, rows), min_count=20)
    counts = collocations.flows(grams, min_count=20)
    want, want_totals = phrase_counts(rows)
    assert {(r.lang, r.phrase): r.a for r in counts.collect()} == {
        (lang, " ".join(p)): a for lang, f in want.items() for p, a in f.items() if a >= 20}
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in want_totals.items() if v}
    found = collocations.paths(counts).collect()
    long = [r for r in found if r.words == 13]
    assert [r.phrase for r in long] == ["permission is hereby granted free of charge to any person obtaining a copy"]
    assert long[0].a == 50
    # Every frequent edge lies in one path, as often as the path says.
    edges = Counter()
    for r in found:
        w = r.phrase.split(" ")
        assert len(w) == r.words
        edges.update({(r.lang, tuple(w[i : i + 4]), r.a): 1 for i in range(len(w) - 3)})
    assert edges == Counter((lang, p, a) for lang, f in want.items() for p, a in f.items() if len(p) == 4 and a >= 20)


def brute_runs(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            if len(stretch) >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.add((i, j + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def awkward(draw):
    alphabet = draw.choice(["a", "ab", "abc", "abcdefgh"])
    unit = [draw.choice(alphabet) for _ in range(draw.randint(1, 12))]
    kind = draw.randrange(4)
    if kind == 0:
        return [draw.choice(alphabet) for _ in range(draw.randint(0, 80))]
    if kind == 1:
        return (unit * draw.randint(3, 9))[: draw.randint(1, 100)]
    if kind == 2:  # a period made of short periods
        inner = ["a"] * draw.randint(1, 20) + ["b"]
        return (inner * draw.randint(1, 4) + ["c"] * draw.randint(0, 6)) * draw.randint(3, 6)
    w = [c for _ in range(draw.randint(1, 4)) for c in unit[: draw.randint(1, 7)] * draw.randint(1, 6)]
    w[draw.randrange(len(w))] = "z"
    return w


def test_find_runs():
    draw, seen = random.Random(5), 0
    for _ in range(400):
        docs = [awkward(draw) for _ in range(draw.randint(1, 5))]
        before = np.concatenate([[0], np.cumsum([len(w) for w in docs])]).astype(np.int64)
        got = list(zip(*(x.tolist() for x in periods.find_runs(np.array([ord(c) for w in docs for c in w], np.int32), before)),
                       strict=True))
        want = [(a + before[i], b + before[i], q) for i, w in enumerate(docs) for a, b, q in brute_runs(w)]
        assert got == want
        seen += len(want)
    assert seen > 800


def test_wavelet_tree():
    draw = np.random.default_rng(3)
    values = draw.permutation(97).astype(np.int32)
    tree = periods.WaveletTree(values)
    left = draw.integers(0, 97, 300)
    right = np.minimum(97, left + draw.integers(1, 60, 300))
    bound = draw.integers(0, 140, 300)
    assert tree.smaller(left, right, bound).tolist() == [
        int((values[a:b] < x).sum()) for a, b, x in zip(left, right, bound, strict=True)]
    rank = draw.integers(0, 1 << 30, 300) % (right - left)
    assert tree.ranked(left, right, rank).tolist() == [
        int(np.sort(values[a:b])[r]) for a, b, r in zip(left, right, rank, strict=True)]


def expected_runs(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(((-(e - s), s, q) for s, e, q in runs), default=None)
    head = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_runs(spark):
    draw = random.Random(6)
    rows = [(i, " ".join(awkward(draw))) for i in range(-40, 300)] + [(None, "a " * 9), (None, None), (7, "\v\f"), (7, "\v\f")]
    rows += [(1000 + i, " ".join(str(draw.randrange(999)) for _ in range(800))) for i in range(40)]  # some made periodic
    got = periods.runs(clashing(spark, [(*r, "en") for r in rows])).collect()
    assert Counter(map(tuple, got)) == Counter(expected_runs(*r) for r in rows)


def test_a_very_long_text(spark):
    text = "alpha beta gamma " * 200_000 + "end"
    row = periods.runs(clashing(spark, [(1, text, "en"), (2, "x" * 3_000_000, "en")])).orderBy("doc_id").first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 600_000, 3)
    kept = hashlib.sha256(b"alpha beta gamma end").hexdigest()
    assert row.collapsed_sha256 == kept


def test_empty_tables(empty):
    assert lines.remove_shared(empty).count() == 0
    assert lines.keep_bitmaps(empty).count() == 0
    assert collocations.collocations(empty).count() == 0
    assert periods.runs(empty).count() == 0
