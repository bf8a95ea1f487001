"""Personal data: fixed patterns, and spans that boosted trees add to them.

Generous generators propose overlapping spans. Boosted trees judge each by its format and its surroundings; they learn
from all distinct proposals of all documents, which are what the fixed patterns or a naming
word ("token = ...") confirm, without seeing those checks. A proposal is taken when a naming word confirms it, or when
its chance is over a threshold that a held-out part of them shows to be precise enough. Spans of the fixed patterns
always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger.llm.boosting import Boosted, Stored, boost
from chatledger.llm.common import cut_lineage

#: Kinds in their order; the last one is proposed by the trees only.
KINDS = ("email", "ip", "card", "phone", "secret")

AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match never begins inside a run of digits; saying so keeps the search linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A text without any of these has no span of any kind.
ANY = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)

#: Addresses are looked for around their at signs: what may stand for one, what belongs to the part before it, whether a
#: blank may stand between, and what must follow.
ADDRESSES = (
    (re.compile("@"), re.compile(r"[^\s@]"), False, re.compile(r"@[^\s@]+")),
    (re.compile(r"[\[(]at[\])]", re.I), re.compile(r"[\w.+-]"), True,
     re.compile(r"[\[(]at[\])] ?[\w-]+(?: ?(?:[\[(]dot[\])]|\.) ?[\w-]+)+", re.I)),
)
PROPOSALS = (
    ("ip", re.compile(r"[0-9]{1,3}(?:[.,_][0-9]{1,3}){3}")),
    ("number", re.compile(r"[+(]{0,2}[0-9](?:[ ().-]{0,2}[0-9]){6,}")),
    ("secret", re.compile(r"[A-Za-z0-9_+/=-]{20,}")),
)
#: What may stand between a naming word and what it names.
_THEN = r")\b(?:\s|[:=.,]|\b(?:me|us|him|her|them|at|to|on|under|via|is|no|nr|number|address)\b){1,8}$"
#: Words right before a span that confirm its kind.
NAMED = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|correo|courriel" + _THEN, re.I),
    "ip": re.compile(r"\b(?:ip|host|server" + _THEN, re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|karte|carte|tarjeta" + _THEN, re.I),
    "phone": re.compile(
        r"\b(?:call|phone|telephone|tel|mobile|cell|fax|whatsapp|dial|contact|reach|telefon|handy|téléphone|teléfono" + _THEN,
        re.I),
    "secret": re.compile(r"(?:token|secret|password|passwd|api[_ -]?key)\s*[=:]\s*[\"']?$", re.I),
}

#: Chances are told apart by this many steps where thresholds are set.
STEPS = 10_000

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches of the email pattern. Every match runs from the first local character before
    an at sign, so it is enough to look around the at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = AFTER_AT.match(text, at) if start < at else None
        if match:
            done = match.end()
            yield "email", start, done
        at = text.find("@", max(done, at + 1))


def base(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and then kind; each kind for itself, without overlaps."""
    out = list(emails(text)) if "@" in text else []
    for m in IP.finditer(text):
        if all(int(x.lstrip("0")[:4] or 0) < 256 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def addresses(text: str) -> Iterator[Span]:
    """Anything like an address. Each at sign is looked around, so that the work follows the length of the text also
    where it has no blanks; the parts before two at signs never overlap."""
    for sign, local, blank, rest in ADDRESSES:
        done = 0
        for at in sign.finditer(text):
            start = at.start() - (blank and text[at.start() - 1 : at.start()] == " " and at.start() > done)
            end = start
            while start > done and local.match(text, start - 1):
                start -= 1
            match = rest.match(text, at.start()) if done <= start < end else None
            if match:
                done = match.end()
                yield "email", start, done


def proposals(text: str) -> list[Span]:
    """Spans worth a look; they may overlap."""
    out = list(addresses(text))
    for kind, pattern in PROPOSALS:
        for m in pattern.finditer(text):
            start, end = m.span()
            body = m.group()
            digits = sum(map(str.isdigit, body))
            if kind == "secret" and not 3 <= digits < len(body):
                continue
            name = kind
            if kind == "number":
                name = "phone" if body[0] in "+(" or digits < 12 else "card"
                if digits > 19:
                    continue
            out.append((name, start, end))
    return out


def features(text: str, span: Span) -> list[float]:
    """Numbers on the format of a span and on its surroundings; not what the fixed patterns ask for (a leading plus,
    values under 256)."""
    kind, start, end = span
    body = text[start:end].lstrip("+") or text[start:end]
    size, digits, letters = len(body), sum(map(str.isdigit, body)), sum(map(str.isalpha, body))
    groups = re.findall("[0-9]+", body)
    parts = [len(g) for g in groups] or [0]
    left, right = text[max(0, start - 24) : start], text[end : end + 24]
    edge = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4
    values = [
        KINDS.index(kind), size, digits, digits / size, letters / size, len(groups), max(parts), min(parts),
        len(set(body)) / size, sum(c in "abcdefABCDEF0123456789" for c in body) / size, body.count("."),
        body.count("-"), body.count(" "), body.count("("), int(groups[0][0]) if groups else -1, sum(map(str.isupper, body)) / size,
        sum(a.isdigit() != b.isdigit() for a, b in pairwise(body)) / size,
        edge(left[-1:]), edge(right[:1]), sum(map(str.isdigit, left)), sum(map(str.isdigit, right)),
        "=" in left or ":" in left, '"' in left[-1:],
    ]
    # Three digits each, so that a feature has few distinct values.
    return [float(f"{v:.3g}") if v % 1 or v > 999 else float(v) for v in values]


def named(text: str, span: Span) -> bool:
    """Whether a naming word confirms a proposal whose values are possible for its kind."""
    kind, start, end = span
    if not NAMED[kind].search(text[max(0, start - 40) : start]):
        return False
    numbers = re.findall("[0-9]+", text[start:end])
    if kind == "ip":
        return all(int(n) < 256 for n in numbers)
    return kind != "card" or luhn("".join(numbers))


class Taken:
    """Spans by start, for each kind and merged over all, so that what one meets is found without looking at the rest."""

    def __init__(self, found: list[Span]) -> None:
        self.kinds: dict[str, list[tuple[int, int]]] = {}
        self.merged: list[tuple[int, int]] = []
        for kind, start, end in found:
            self.kinds.setdefault(kind, []).append((start, end))
            if self.merged and start < self.merged[-1][1]:
                self.merged[-1] = self.merged[-1][0], max(end, self.merged[-1][1])
            else:
                self.merged.append((start, end))

    def meets(self, start: int, end: int) -> bool:
        """Whether some span overlaps [start, end)."""
        i = bisect_left(self.merged, (end,))
        return i > 0 and self.merged[i - 1][1] > start

    def add(self, start: int, end: int) -> None:
        """One more span, which must not meet any."""
        insort(self.merged, (start, end))

    def shared(self, kind: str, start: int, end: int) -> int:
        """The most that one span of the kind, which do not overlap each other, shares with [start, end)."""
        own, most = self.kinds.get(kind, []), 0
        i = bisect_left(own, (end,)) - 1
        while i >= 0 and own[i][1] > start:
            most, i = max(most, min(end, own[i][1]) - max(start, own[i][0])), i - 1
        return most


def known(text: str, span: Span, found: Taken) -> bool:
    """Whether the fixed patterns or a naming word confirm a proposal."""
    if named(text, span):
        return True
    return found.shared(*span) * 10 >= 8 * (span[2] - span[1])


@dataclass(frozen=True)
class Model:
    """The trees and, per kind, the least chance at which a proposal is taken (over 1: never)."""

    trees: Boosted
    least: dict[str, float]


def thresholds(held: Stored, trees: Boosted, precision: float, enough: int) -> dict[str, float]:
    """Per kind, the smallest chance, of the multiples of 1 / ``STEPS``, from which on at least ``precision`` of the held-out
    proposals are right; with fewer than ``enough`` of them, ``precision``."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            step = (trees.chance(x) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[:, 0].astype(np.int64)), pa.array(step), batch.column("y")], ["kind", "step", "y"])

    judged = held.rows.select("x", "y").mapInArrow(judge, "kind long, step long, y boolean")
    counts = judged.groupBy("kind", "step").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("right")).collect()
    out = {}
    for k, kind in enumerate(KINDS):
        own = sorted((r for r in counts if r.kind == k), key=lambda r: -r.step)
        n, right = np.cumsum([r.n for r in own]), np.cumsum([r.right for r in own])
        if not own or n[-1] < enough:
            out[kind] = precision
        else:
            good = np.flatnonzero(right >= precision * n)
            out[kind] = own[good[-1]].step / STEPS if len(good) else 2.0
    return out


def train(documents: DataFrame, *, precision: float = 0.98, enough: int = 20) -> Model:
    """Fit on all distinct proposals of all documents. A quarter, chosen by hash, is held out to set the thresholds. A kind
    with fewer than ``enough`` rows there, too few to show a precision, is taken where its chance is at least
    ``precision`` itself."""
    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, tuple] = {}
            for text in batch.column("text").to_pylist():
                if not text or not ANY.search(text):
                    continue
                found = None
                for span in proposals(text):
                    kind, start, end = span
                    body = f"{kind}:{text[start:end]}:{text[max(0, start - 30):end + 30]}"
                    found = Taken(base(text)) if found is None else found
                    y, key = known(text, span, found), hashlib.md5(body.encode()).digest()
                    if key not in seen or y > seen[key][0]:
                        seen[key] = y, features(text, span)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array([y for y, _ in seen.values()], pa.bool_()),
                 pa.array([x for _, x in seen.values()], pa.list_(pa.float64()))], ["key", "y", "x"])

    given = documents.select("text").mapInArrow(propose, "key binary, y boolean, x array<double>")
    # Places with one key can differ in what lies further off: a confirmed one stays.
    distinct = given.groupBy("key").agg(F.max(F.struct("y", "x")).alias("v"))
    rows = cut_lineage(distinct.select("v.y", "v.x", (F.conv(F.substring(F.hex("key"), -1, 1), 16, 10) % 4 == 0).alias("held")))
    trees = boost(Stored(rows.where("not held")), None)
    return Model(trees, thresholds(Stored(rows.where("held")), trees, precision, enough))


def spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and all its spans: those, and the best proposals that overlap none taken before. What a
    naming word confirms is taken first, whatever its chance."""
    if not ANY.search(text):
        return [], []
    found = base(text)
    met = Taken(found)
    new = [p for p in proposals(text) if not met.meets(*p[1:])]
    if not new:
        return found, found
    chance = model.trees.chance(np.array([features(text, p) for p in new], float))
    sure = [named(text, p) for p in new]
    taken, added = list(found), Taken([])
    for i in sorted(range(len(new)), key=lambda i: (not sure[i], -chance[i], new[i])):
        if (sure[i] or chance[i] >= model.least[new[i][0]]) and not added.meets(*new[i][1:]):
            taken.append(new[i])
            added.add(*new[i][1:])
    return found, sorted(taken, key=_order)


def _joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def detect(documents: DataFrame, model: Model) -> DataFrame:
    """Counts per kind, a digest of the base spans, and all spans, for every row.

    Null and empty texts have none, an empty table gives an empty result. Positions are code points, the end is
    exclusive. Equal spans of two kinds are both base spans. Repeated rows give repeated results; other columns are not
    read. Very long texts are taken whole, in time that follows their length, blanks or not.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [spans(text or "", model) for text in batch.column("text").to_pylist()]
            n = [[sum(k == kind for k, _, _ in found) for found, _ in out] for kind in KINDS[:4]]
            digests = [hashlib.sha256(_joined(found).encode()).hexdigest() for found, _ in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in n], pa.array(digests, pa.string()),
                 pa.array([_joined(every) for _, every in out], pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become one, named after
    the first. Null texts stay null; ``n_chars``, where there is such a column, follows the text."""
    columns = documents.columns

    def clean(text: str | None) -> str | None:
        parts, at = [], 0
        for kind, start, end in spans(text, model)[1] if text else []:
            if start >= at:
                parts.append(f"{text[at:start]}<{kind.upper()}>")
            at = max(at, end)
        return "".join(parts) + text[at:] if parts else text

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array([clean(t) for t in texts.to_pylist()], pa.string())

    out = documents.withColumn("text", cleaned("text"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType)).select(*columns)
    return out
