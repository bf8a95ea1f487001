"""Near duplicates and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from chatledger.llm import near
from chatledger.llm.components import components


def shingles(text: str | None, size: int) -> frozenset:
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(table))
    if 0 < len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def smallest(pairs, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(documents, rows, size, percent):
    got = near.near_duplicates(documents, size=size, percent=percent).collect()
    assert len(got) == len(rows)
    sets = [(r[0], shingles(r[1], size)) for r in rows]
    named = [(i, s) for i, s in sets if i is not None]
    pairs = [(a, b) for a, x in named for b, y in named
             if a < b and x and y and 100 * len(x & y) >= percent * len(x | y)]
    label = smallest(pairs, {i for i, _ in named})
    by_set = {}
    for i, s in named:
        by_set[s] = min(i, by_set.get(s, i))
    for r in got:
        if r.doc_id is not None:
            assert (r.component_id, r.kept) == (label[r.doc_id], label[r.doc_id] == r.doc_id)
    unnamed = sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None and r.n_shingles)
    assert unnamed == [(len(s), label[by_set[s]], False) for i, s in sets if i is None and s]
    assert sorted(r.n_shingles for r in got) == sorted(len(s) for _, s in sets)


def test_crowded_band(spark, monkeypatch):
    """One family whose members mostly do not link, in blocks of a few."""
    monkeypatch.setattr(near, "BLOCK", 7)
    monkeypatch.setattr(near, "PER_COPY", 3)
    draw = random.Random(6)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(60):
        words = list(base)
        for at in draw.sample(range(120), i % 15):
            words[at] = f"e{draw.random()}"
        rows.append((i, " ".join(words)))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()
    sets = {i: shingles(t, 3) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert {r.doc_id: r.component_id for r in got} == smallest(pairs, sets)


def test_nothing(empty):
    assert near.near_duplicates(empty).count() == 0


def test_components(spark):
    draw = random.Random(1)
    pairs = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(5, 5), (100, 101)]
    pairs += [(i, i + 1) for i in range(200, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = smallest(pairs, {n for p in pairs for n in p})
    assert got == {n: label[n] for a, b in pairs if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_tell_similarity():
    draw = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    other = [w if draw.random() > 0.03 else "x" + w for w in words]
    a, b = near.shingle_sets(pa.array([" ".join(words), " ".join(other)]), 3)
    real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    differ = int(np.bitwise_count(near.odd_sketch(near.signature(a)) ^ near.odd_sketch(near.signature(b))).sum())
    share = 1 + near.SKETCH_BITS * np.log(1 - 2 * differ / near.SKETCH_BITS) / (4 * near.BANDS * near.ROWS)
    assert abs(share - real) < near.MARGIN
