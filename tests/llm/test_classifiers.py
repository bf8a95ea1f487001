"""Language ID, quality rules and personal data."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from chatledger.llm import boosting, language, pii, quality
from chatledger.llm.boosting import Boosted, boost


def test_languages(spark):
    draw = random.Random(3)
    say = {"en": "the of and ing tion", "de": "der und sch keit ung", "fr": "le que eau tion ment", "xx": "qa qi qo qu"}
    rows = []
    for i in range(400):
        lang = draw.choice(list(say))
        rows.append((i, " ".join(draw.choices(say[lang].split(), k=draw.randint(4, 40))), lang))
    rows += [(1000, None, "en"), (1001, "123 !?", "de"), (1002, "a", None), (None, "der und der und", "de"), rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs, language.train(docs)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert {r.doc_id for r in got if r.held_out} == {i for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1000, 1001))
    assert all(0 <= r.score <= 1 for r in got)
    kept = language.reject(docs, language.train(docs))
    assert kept.columns == docs.columns and not {1000, 1001} & {r.doc_id for r in kept.collect()}


def test_languages_of_others_do_not_leak(spark):
    """What a held-out document says about itself changes nothing."""
    rows = [(i, "der und sch" if i % 2 else "the of and", "de" if i % 2 else "en") for i in range(80)]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    lies = [(i, t, "zz") if (i, t, x) in held else (i, t, x) for i, t, x in rows]
    schema = "doc_id long, text string, lang string"
    first, second = (language.train(spark.createDataFrame(x, schema)) for x in (rows, lies))
    assert first.languages == second.languages and np.array_equal(first.weights, second.weights)


def test_no_languages(empty, documents):
    assert language.identify(empty, language.train(empty)).count() == 0
    unlabelled = documents.drop("lang").selectExpr("*", "cast(null as string) as lang")
    got = language.identify(documents, language.train(unlabelled)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_codewords():
    for n in (2, 3, 4, 7, 12):
        code = language.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == n and (np.abs(code.sum(0)) < n).all()


def test_quality_counts(documents, rows):
    got = quality.judge(documents).collect()

    def brute(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        n = len(words)
        return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
                len(marked), n < 50 or 100 * len(marked) > 50 * n)

    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in got) == Counter((r[0], *brute(r[1])) for r in rows)
    assert all(r.kept is False for r in got if r.base_failed)


def test_quality_learns(spark, empty):
    """Broken text is told from clean text by rules that were given no weights."""
    draw = random.Random(5)

    def text(bad):
        words = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randint(2, 8))) for _ in range(150)]
        words = [w + "," if draw.random() < 0.1 else w for w in words]
        if bad == "symbols":
            words = [w + "###" for w in words]
        if bad == "shouts":
            words = [w.upper() + "!!" for w in words]
        return " ".join(words)

    kinds = [("clean", "symbols", "clean", "shouts", "clean", "clean")[i % 6] for i in range(180)]
    docs = spark.createDataFrame([(i, text(k)) for i, k in enumerate(kinds)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert [got[i].kept for i in range(180)] == [k == "clean" for k in kinds]
    assert quality.judge(empty).count() == 0


def test_quality_em_by_hand(spark):
    """EM over the patterns equals EM over the rows."""
    draw = random.Random(9)
    rows = [(draw.choice([-1, 0, 1]), draw.choice([-1, 0, 1]), draw.choice([0, 1])) for _ in range(200)]
    got = quality.estimate(spark.createDataFrame(rows, "a int, b int, c int"), ["a", "b", "c"], rounds=3)
    good = np.array([0.2 if min(r) < 0 else 0.9 for r in rows])
    for _ in range(3):
        model = {"good": (good.sum() + 1) / (len(rows) + 2)}
        for j, name in enumerate("abc"):
            for v in (-1, 0, 1):
                hit = np.array([r[j] == v for r in rows])
                model[name, v, 1] = (good[hit].sum() + 1) / (good.sum() + 3)
                model[name, v, 0] = ((1 - good)[hit].sum() + 1) / ((1 - good).sum() + 3)
        odds = [np.log(model["good"] / (1 - model["good"])) + sum(
            np.log(model[n, r[j], 1] / model[n, r[j], 0]) for j, n in enumerate("abc")) for r in rows]
        good = 1 / (1 + np.exp(-np.array(odds)))
    assert all(abs(got[k] - model[k]) < 1e-9 for k in model)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    def good(kind, body):
        digits = re.sub("[^0-9]", "", body)
        if kind == "ip":
            return all(int(x) <= 255 for x in body.split("."))
        if kind == "phone":
            return 9 <= len(digits) <= 15
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return kind == "email" or 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0

    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(PATTERNS.items())
             for m in re.finditer(p, text) if good(k, m.group())]
    return [x[2] for x in sorted(found)]


def test_personal_data(spark, documents, empty):
    draw = random.Random(2)
    texts = [None, "", "a@b.c@d.e.f", "x@@y.z", "@a.b", "a@b", "a.b@c-d.ef, é ü@x.y", "1.2.3.4.5 256.1.1.1 0001.02.3.255",
             "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (336) 555-3810 +123 +1-2-3-4-5-6-7-8-9-", "0" * 12,
             "1" * 400, "00000000000000000000000000001.1.1.1"]
    texts += ["".join(draw.choices("ab 01@.-+() 4111", k=60)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = pii.train(docs)
    got = {r.doc_id: r for r in pii.detect(docs, model).collect()}
    for i, t in enumerate(texts):
        want = plain(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i].spans.split(","))
        assert got[i].n_email == sum(x.startswith("email") for x in want)
    assert pii.detect(empty, pii.train(empty)).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert clean[0] is None and clean[1] == "" and "4111 1111 1111 1111" not in clean[8]
    assert pii.redact(documents, model).columns == documents.columns


def test_personal_data_adds_spans(spark):
    """Secrets are learned where they are named, and found where they are not."""
    draw = random.Random(7)
    hexes = lambda: "".join(draw.choices("0123456789abcdef", k=40))
    texts = [f'word number {i} token = "{hexes()}" more words' for i in range(300)] + [f'words "{hexes()}" words']
    texts += [f"call +1 (336) 555-{i:04d} or order 20-{i:06d} now" for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.detect(docs, pii.train(docs)).collect()}
    assert sum("secret" in got[i] for i in range(300)) >= 295 and got[350].count(":") == 2


def test_personal_data_rare_kinds(spark):
    """A few secrets in many documents are found as well as many are."""
    draw = random.Random(11)
    hexes = lambda: "".join(draw.choices("0123456789abcdef", k=40))
    texts = [f'word {i} token = "{hexes()}" more' if i % 1000 == 0 else f"call +1 (336) 555-{i:04d} now" for i in range(5000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    model = pii.train(docs)
    got = {r.doc_id: r.spans for r in pii.detect(docs, model).collect()}
    assert [i for i in got if "secret" in got[i]] == [i for i in got if i % 1000 == 0]
    clean = pii.redact(docs.where("doc_id % 1000 = 0"), model).collect()
    assert all("<SECRET>" in r.text for r in clean)


def test_personal_data_wider_formats(spark):
    """Every format that is proposed is taken where a word names it, and not where nothing speaks for it."""
    wide = [("phone", "call", "(336) 555-3810"), ("phone", "phone:", "336-555-3810"),
            ("email", "mail", "jo (at) mail (dot) org"), ("email", "contact", "jo[at]mail.org"),
            ("email", "write to", "jo@müller.de"), ("ip", "host", "10,0,0,17"), ("ip", "IP address", "192_168_0_1"),
            ("card", "card number", "4111.1111.1111.1111"), ("secret", "token =", "ab12cd34ef56ab78cd90ef12")]
    texts = [f"please {word} {body} today" for _, word, body in wide] + ["host 10,0,0,999 x", "card 4111.1111.1111.1112 x"]
    texts += [f"order 20-{i:06d} came, call +1 (336) 555-{i:04d} or x{i}@y.org" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.detect(docs, pii.train(docs)).collect()}
    for i, (kind, _, body) in enumerate(wide):
        start = texts[i].index(body)
        assert got[i] == f"{kind}:{start}:{start + len(body)}"
    assert got[9] == got[10] == "" and all(got[i].count(":") == 4 for i in range(11, 211))


def test_personal_data_learns_from_distinct_proposals(spark, monkeypatch):
    """Copies of one text do not fill the sample."""
    seen = []
    monkeypatch.setattr(pii, "boost", lambda x, y: seen.append(len(x)) or boost(x, y))
    monkeypatch.setattr(pii, "thresholds", lambda kinds, *a: seen.append(len(kinds)) or dict.fromkeys(pii.KINDS, 2.0))
    texts = ["call +1 (336) 555-3810 now"] * 300 + [f"order 20-{i:06d} came" for i in range(30)]
    pii.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert sum(seen) == 31


def test_personal_data_learns_from_all_proposals(spark, monkeypatch):
    """No proposal is left out, however many there are."""
    seen = []
    monkeypatch.setattr(pii, "boost", lambda x, y: seen.append(len(x)) or Boosted(0.0, []))
    monkeypatch.setattr(pii, "thresholds", lambda held, *a: seen.append(len(held)) or dict.fromkeys(pii.KINDS, 2.0))
    texts = [f"call +1 (336) 555-{i:05d} now" for i in range(6000)]
    pii.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert sum(seen) == 6000


def test_boosting_in_tasks(spark, monkeypatch):
    """Tasks, the driver and arrays add up to the same trees."""
    draw = np.random.default_rng(5)
    x = draw.integers(0, 40, (600, 3)).astype(float)
    y = (x[:, 0] > 20) ^ (x[:, 1] > 9)
    rows = spark.createDataFrame([(a.tolist(), bool(b)) for a, b in zip(x, y)], "x array<double>, y boolean").repartition(3)
    want = boost(x, y.astype(float), trees=2).chance(x).tolist()
    for most in (0, 1 << 16):
        monkeypatch.setattr(boosting, "HERE", most)
        assert boost(boosting.Stored(rows), None, trees=2).chance(x).tolist() == want


def test_boosting():
    draw = np.random.default_rng(4)
    x = draw.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = boost(x[:1500], y[:1500])
    assert (((model.chance(x[1500:]) > 0.5) == y[1500:]).mean()) > 0.95
    assert boost(x[:0], y[:0]).chance(x[:3]).tolist() == [0.5] * 3


@pytest.mark.parametrize("text", [
    "aB3/x9kQ+" * 110_000, "1" * 1_000_000, "a@" * 50_000, "x[at]" * 100_000, "a.b-" * 250_000, "1." * 100_000,
    "jo@ex.org 10.0.0.256 call (336) 555-3810 " * 5_000,
])
def test_long_texts_without_blanks(text):
    """The work follows the length: quadratic patterns would take hours."""
    model = pii.Model(Boosted(0.0, []), dict.fromkeys(pii.KINDS, 2.0))
    start = time.time()
    found, every = pii.spans(text, model)
    pii.known(text, ("email", 0, 9), pii.Taken(found))
    assert time.time() - start < 20 and set(found) <= set(every)


def test_addresses_as_the_plain_patterns_say():
    draw = random.Random(3)
    parts = [*"ab@.[](-) 12_+,", "[at]", "(AT)", " (dot) ", "@x.org", "foo"]
    plain = [re.compile(r"[^\s@]+@[^\s@]+"), re.compile(
        r"[\w.+-]+ ?[\[(]at[\])] ?[\w-]+(?: ?(?:[\[(]dot[\])]|\.) ?[\w-]+)+", re.I)]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 30)))
        want = [("email", *m.span()) for p in plain for m in p.finditer(text)]
        assert sorted(pii.addresses(text)) == sorted(want), text
        spans = [("ip", i, i + draw.randint(1, 5)) for i in sorted(draw.sample(range(60), 8))]
        taken, probe = pii.Taken(spans), sorted(draw.sample(range(70), 2))
        assert taken.meets(*probe) == any(probe[0] < e and s < probe[1] for _, s, e in spans)
