"""Repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from chatledger.llm import automaton, transforms
from chatledger.llm.repeats import sliding_min


def expected(units: list[list], length: int, glue: bytes) -> Counter:
    seen = Counter(tuple(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    out = Counter()
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if seen[tuple(u[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = glue.join(x for x, g in zip(u, gone, strict=True) if not g)
        out[len(u), sum(gone), runs, hashlib.sha256(left).hexdigest(), left] += 1
    return out


@pytest.mark.parametrize("settings", [{}, {"hot": 1, "per_shard": 300}])
def test_words(documents, rows, settings):
    got = automaton.remove_repeats(documents, length=12, gram=4, **settings).collect()
    units = [(r[1] or "").encode().split() for r in rows]
    assert Counter((r.n_words, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == expected(
        units, 12, b" ")
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)


@pytest.mark.parametrize("settings", [{}, {"hot": 1, "per_shard": 3000}])
def test_bytes(documents, rows, settings):
    got = transforms.remove_repeats(documents, length=80, gram=30, **settings).collect()
    units = [[bytes([b]) for b in (r[1] or "").encode()] for r in rows]
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == expected(
        units, 80, b"")


def test_nothing(empty):
    assert automaton.remove_repeats(empty).count() == 0
    assert transforms.remove_repeats(empty).count() == 0


def test_sliding_min():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 9, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 13):
        assert sliding_min(values, width).tolist() == [min(values[i : i + width]) for i in range(51 - width)]


def test_automaton_counts():
    draw = random.Random(2)
    for _ in range(60):
        length = draw.choice([2, 3, 5])
        parts = [[draw.choice("abc") for _ in range(draw.randint(length, 20))] for _ in range(draw.randint(1, 6))]
        weights = np.array([draw.choice([1, 1, 2]) for _ in parts])
        seen = Counter()
        for part, weight in zip(parts, weights, strict=True):
            for i in range(len(part) - length + 1):
                seen[tuple(part[i : i + length])] += weight
        got = automaton.search([" ".join(p).encode() for p in parts], weights, length)
        for part, spans in zip(parts, got, strict=True):
            starts = {i for a, b in spans for i in range(a, b)}
            assert starts == {i for i in range(len(part) - length + 1) if seen[tuple(part[i : i + length])] > 1}


def test_transforms_count():
    draw = random.Random(3)
    base = bytes(draw.choice(b"abcdefgh ") for _ in range(2000))
    for _ in range(60):
        length, parts = draw.choice([60, 120]), []
        for _ in range(draw.randint(1, 9)):
            at = draw.randint(0, 1500)
            part = bytearray(base[at : at + draw.randint(length, 400)])
            for _ in range(draw.randint(0, 2)):
                part[draw.randrange(len(part))] = draw.choice(b"xyz")
            parts.append(bytes(part))
        parts.append(b"ab" * length)
        weights = np.array([draw.choice([1, 1, 2]) for _ in parts])
        seen = Counter()
        for part, weight in zip(parts, weights, strict=True):
            for i in range(len(part) - length + 1):
                seen[part[i : i + length]] += weight
        for part, spans in zip(parts, transforms.search(parts, weights, length), strict=True):
            starts = {i for a, b in spans for i in range(a, b)}
            assert starts == {i for i in range(len(part) - length + 1) if seen[part[i : i + length]] > 1}
