"""Packing, mixing, chat formatting, nearest neighbours and the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from chatledger.llm import chat, language, mixing, neighbours, packing, pii
from chatledger.llm.common import row_key
from chatledger.llm.queries import ORACLE, REGISTERED
from chatledger.llm.tokens import Encoder
from tests.compare import connect, mismatch

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def test_encoder(tokenizer, rows):
    draw = random.Random(1)
    texts = [r[1] or "" for r in rows] + [" a", "a ", "a  b", " ", "  ", "\n a", "a \nb", "it's 's a", "a  b 　c", "<|endoftext|> x"]
    texts += ["".join(draw.choices("ab 'st\n\t1é., \x1c", k=40)) for _ in range(500)]
    encode = Encoder()
    for text in texts * 2:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_asks_once(tokenizer):
    """New words of many texts, nulls and odd white space among them, take one call, and a text of its own only where it must."""
    texts = ["", None, " a", "b ", "x  y", *(f"w{i} new{i} w{i + 1}, é{i} é{i}" for i in range(200))]
    encode = Encoder()
    calls, whole = [], encode._encode
    encode._encode = lambda text: calls.append(len(text)) or whole(text)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encode.every(pa.array([*texts, "cut"])[:-1])] == want
    heads = len(texts) - 2
    assert len(calls) == heads + 2 + 1 and max(calls) < sum(len(t or "") for t in texts)


@pytest.mark.parametrize("per_shard", [packing.PER_SHARD, 4000])
def test_packing(documents, rows, tokenizer, per_shard):
    got = packing.pack(documents, window=64, per_shard=per_shard, with_ids=True).collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r.ids), np.uint16)
        assert len(ids) == r.length > 0 and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.doc_tokens, ids.tolist()))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc, own in texts.items():
        assert sum(len(p[2]) for p in pieces[doc]) == sum(map(len, own))
        if len(own) == 1:
            assert sum((p[2] for p in sorted(pieces[doc])), []) == own[0] and {p[1] for p in pieces[doc]} == {len(own[0])}
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
        short += at < 64
    assert short <= len({s >> 32 for s in sequences})


def test_packing_prefers_neighbours(spark):
    """Documents of one subject end up side by side."""
    draw = random.Random(3)
    topics = [[f"{t}{i}" for i in range(40)] for t in ("alpha", "beta", "gamma", "delta")]
    docs = [(i, " ".join(draw.choices(topics[i % 4], k=30))) for i in range(80)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), window=512).collect()
    order = [r.doc_id % 4 for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))]
    assert sum(a == b for a, b in zip(order, order[1:], strict=False)) > 0.8 * len(order)


def test_packing_prefers_neighbours_of_all_shards(spark):
    """The same where a shard holds far fewer documents than there are subjects; one subject is a third of the rows,
    half of it copies of one text, and no shard gets much more than its bytes."""
    draw = random.Random(4)
    subject = [0 if i % 3 == 0 else 1 + i % 40 for i in range(2400)]
    copied = " ".join(draw.choices([f"t0w{i}" for i in range(40)], k=30))
    texts = [copied if t == 0 and i % 2 else " ".join(draw.choices([f"t{t}w{i}" for i in range(40)], k=30))
             for i, t in enumerate(subject)]
    size = sum(map(len, texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = packing.pack(docs, window=512, per_shard=size // 100).collect()
    assert sorted({r.doc_id for r in got}) == list(range(2400))
    order = [subject[r.doc_id] for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))]
    assert sum(a == b for a, b in zip(order, order[1:], strict=False)) > 0.8 * len(order)
    held = Counter()
    for r in got:
        held[r.sequence_id >> 32] += len(texts[r.doc_id]) if r.start == 0 else 0
    assert len(held) > 80 and max(held.values()) < 4 * size / 100


def test_packing_nothing(empty):
    assert packing.pack(empty).count() == 0


def test_mixing_sql(spark):
    for name in ORACLE:
        assert mismatch(REGISTERED[name](spark, SMALL), connect(SMALL), ORACLE[name]) is None


def test_budget_by_hand(spark):
    """Shortages go to siblings first: the budget of a domain only moves once all of it is full."""
    draw = random.Random(2)

    def fill(nodes, given):
        share, left = {}, dict(nodes)
        while left:
            weight = sum(w for w, _ in left.values())
            full = [n for n, (w, room) in left.items() if room * weight <= given * w]
            if not full:
                return share | {n: given * w // weight for n, (w, _) in left.items()}
            for n in full:
                share[n] = left.pop(n)[1]
                given -= share[n]
        return share

    for _ in range(3):
        sizes = {(d, x, s): draw.randint(0, 60) for d in ("d0", "d1", "d2") for x in ("en", "de") for s in ("s1", "s2")
                 if draw.random() < 0.8}
        rows = [(*k, v) for k, v in sizes.items()]
        leaves = spark.createDataFrame(rows, "domain string, language string, source string, size long")
        total = sum(sizes.values()) * 3
        got = {(r.domain, r.language, r.source): r.target for r in mixing.budget(leaves, total, 4, mixing.WEIGHTS).collect()}
        given = {(): total}
        for depth, level in enumerate(mixing.LEVELS):
            below = {}
            for parent, amount in given.items():
                nodes = {k[: depth + 1] for k in sizes if k[:depth] == parent}
                weighed = {n: (mixing.WEIGHTS[level].get(n[-1], 1), 4 * sum(v for k, v in sizes.items() if k[: depth + 1] == n))
                           for n in nodes}
                below |= fill(weighed, amount)
            given = below
        assert got == given


def test_mixing_edges(documents, empty, rows):
    got = mixing.mix(documents, digits=1)
    assert got.count() == len(rows) and mixing.mix(empty).count() == 0
    again = mixing.mix(documents, digits=3)
    key = ["doc_id", "tokens", "copies"]
    assert Counter(map(tuple, got.select(key).collect())) == Counter(map(tuple, again.select(key).collect()))
    assert mixing.repeat(documents).columns == documents.columns


def test_chat(spark):
    draw = random.Random(5)
    marks = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE", "[/ROLE]", "\\", " ", "x", "\n", '"', "]", "é"]
    rows = []
    for conv in range(60):
        for turn in range(draw.randint(1, 6)):
            text = None if draw.random() < 0.1 else "".join(draw.choices(marks, k=draw.randint(0, 8)))
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", None, 'to"ol] ']), text, 1))
    rows += [(None, 0, "user", "x", 1), rows[3], (7, None, "assistant", "first", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    formatted = chat.format_turns(chat.with_trap(frame))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    turns = defaultdict(list)
    for conv, turn, role, text, _ in [*rows, (-1, 0, "user", chat.TRAP, 0), (-1, 1, "assistant", chat.TRAP, 0)]:
        turns[conv].append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    size = Counter()
    for r in formatted.collect():
        size[r.conv_id] += len(r.piece)
        if r.loss_start is not None:
            assert chat.unescape(r.piece[r.loss_start : r.loss_end]) in {t[2][1] for t in turns[r.conv_id]}
    assert set(got) == set(turns)
    for conv, own in turns.items():
        own.sort()
        said = "".join(f"{r[1]}\n{t[1]}\n" for _, r, t in own)
        loss = "".join(t[1] for _, r, t in own if r[1] == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256,
                got[conv].formatted_chars) == (len(own), digest(said), len(loss), digest(loss), size[conv])
    assert chat.format_turns(frame.limit(0)).count() == 0


def test_neighbours(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(400, 8)).round(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(50, rows[50][1]), (2000, None), (2001, [0.0] * 8), (2050, [1.0] * 3),
             (2100, [float("nan")] * 8), (2150, [None] * 8), (2200, [float("inf")] + [1.0] * 7), (None, rows[1][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = neighbours.nearest(frame, frame.where("vec_id % 50 = 0"), candidates=10_000).collect()
    usable = {i: np.array(np.array(v, np.float32), float) for i, v in rows
              if i is not None and (i < 2000) and v}
    ids = np.array(sorted(usable))
    matrix = np.stack([usable[i] for i in ids])
    norm = np.sqrt((matrix * matrix).sum(1))
    asked = [i for i in ids.tolist() if i % 50 == 0]
    assert {r.query_id for r in got} == set(asked) and len(got) == 5 * len(asked)
    for q in asked:
        score = (matrix * usable[q]).sum(1) / (norm * np.sqrt((usable[q] * usable[q]).sum()))
        want = sorted((-s, i) for i, s in zip(ids.tolist(), score.tolist(), strict=True) if i != q)[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        assert [r[1] for r in own] == [i for _, i in want]
        assert np.allclose([r[2] for r in own], [-s for s, _ in want], atol=1e-12)


def test_walk_in_order():
    draw = np.random.default_rng(6)
    first, second, held = draw.random(12), draw.random(12), draw.integers(0, 3, (12, 12))
    cells = list(neighbours.walk(first, second, held, 10**6))
    assert cells == sorted(((i, j) for i, j in np.argwhere(held).tolist()), key=lambda c: first[c[0]] + second[c[1]])
    some = list(neighbours.walk(first, second, held, 40))
    assert some == cells[: len(some)] and sum(held[c] for c in some) >= 40 > sum(held[c] for c in some[:-1])


def test_neighbours_recall(spark):
    """With the production settings."""
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in frame.collect()}
    got = defaultdict(set)
    for r in neighbours.nearest(frame, frame.where("vec_id % 50 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    ids = np.array(sorted(rows))
    matrix = np.stack([rows[i] for i in ids])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    hit = sum(len(got[q] & set(ids[np.argsort(-np.where(ids == q, -2, matrix @ matrix[ids == q][0]))[:5]].tolist()))
              for q in ids.tolist() if q % 50 == 0)
    assert hit >= 0.9 * 5 * sum(ids % 50 == 0)


def test_neighbours_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(frame, frame).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest(one, one).count() == 0


def test_pipeline(spark, tmp_path, documents):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() > 0
    near = spark.read.parquet(f"{tmp_path}/near")
    named = near.where("doc_id is not null")
    assert named.count() == named.select("doc_id").distinct().count()


def test_pipeline_near_thresholds(spark):
    """The stage decides on five words and 80 percent: a copy with a block of words more goes, one with words changed
    all over stays."""
    words = [f"a{i}" for i in range(200)]
    other = [f"b{i}" for i in range(200)]
    changed = [f"c{i}" if i % 40 == 20 else w for i, w in enumerate(other)]
    texts = [words, words + [f"d{i}" for i in range(40)], other, changed]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()} == {0, 2, 3}


def test_pipeline_rows_without_own_id(spark):
    """Null and reused ids: one row of each group of copies stays, and no clean one goes."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(None, text("a"), s) for s in ("x", "x", "y")] + [(7, text("b"), "x"), (7, text("c"), "x")]
    rows += [(9, text("d"), "x"), (8, text("d"), "y"), (None, text("d"), "z"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, (r.text or " ")[0]) for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    assert got == Counter([(None, "a"), (7, "b"), (7, "c"), (8, "d"), (None, " ")])


def test_mixing_repeats_rows_without_id(spark):
    """Rows without id, or equal, are given as often as the mix says, and no leaf exceeds its target."""
    rows = [(None, f"w{i} x y z", "en", "src1") for i in range(100)] + [(5, "a b", "en", "src1")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    copies = mixing.mix(docs).agg({"copies": "sum"}).first()[0]
    got = mixing.repeat(docs).collect()
    assert 0 < copies < 120 and len(got) == copies


def test_stages_keep_columns_of_any_name(spark):
    """Input columns called like the stages' own, and maps, come out unchanged; rows that differ in a map alone differ."""
    schema = ("doc_id long, text string, lang string, source string, row_ long, place_ string, id_ string, n_ int, "
              "copy_ int, tags map<string,int>")
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, text("a"), "en", "src1", 7, "p", "i", 3, 4, {"x": 1, "y": 2}),
            (1, text("a"), "en", "src1", 7, "p", "i", 3, 4, {"y": 2, "x": 1}),
            (2, text("b"), "en", "src1", 8, "q", "j", 5, 6, {"x": 1}), (3, text("c"), "de", "src2", 9, "r", "k", 7, 8, None)]
    docs = spark.createDataFrame(rows, schema)
    seen = lambda frame: sorted((r.doc_id, r.text, r.row_, r.place_, r.id_, r.n_, r.copy_) for r in frame.collect())
    wanted = [(r[0], r[1], *r[4:9]) for r in rows[1:]]
    one = corpus_pipeline.one_of_each(spark, docs, "")
    assert one.columns == docs.columns and seen(one) == wanted
    mixed = mixing.repeat(docs, share=100)
    assert mixed.columns == docs.columns and set(seen(mixed)) <= set(wanted) and mixed.count() > 0


def test_reject_and_redact_brute_force(spark, documents):
    """The two filtering stages, row by row: what is left out, and what a text becomes."""
    model = language.train(documents)
    texts = documents.select("doc_id", "text").where("doc_id is not null").distinct()
    said = {r.text: (r.lang_pred, r.score, r.ambiguous)
            for r in language.identify(texts, model).join(texts, "doc_id").collect()}
    kept = Counter(r.text for r in language.reject(documents, model).collect())
    every = Counter(r.text for r in documents.collect())
    for text, (lang, score, ambiguous) in said.items():
        good = lang != "und" and not (ambiguous and score < 0.5)
        assert kept[text] == (every[text] if good else 0)
    texts = ["write to jo@mail.com or +44 20 7946 0958 now", "", None, "nothing here", "x" * 50_000]
    frame = spark.createDataFrame(
        [(i, t, len(t or ""), "z") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, extra string")
    trained = pii.train(frame)
    for row in pii.redact(frame, trained).collect():
        text = texts[row.doc_id]
        want, at = "", 0
        for kind, start, end in pii.spans(text, trained)[1] if text else []:
            if start >= at:
                want += f"{text[at:start]}<{kind.upper()}>"
            at = max(at, end)
        assert row.text == (None if text is None else want + text[at:]) and row.extra == "z"
        assert row.n_chars == (None if text is None else len(row.text))


def test_row_key_tells_nulls_apart(spark):
    rows = [("a", None), (None, "a"), (None, None), ("a", "a"), ("a", None)]
    frame = spark.createDataFrame(rows, "lang string, source string")
    assert frame.select(row_key(frame).alias("k")).distinct().count() == 4
