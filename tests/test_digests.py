"""Digests of tables: equal only for equal rows, and only differing buckets are looked into."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from chatledger.streaming import digests

SCHEMA = "id long, name string, flag boolean, at timestamp_ntz, tags array<string>, marks map<string,int>"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(count: int) -> list[tuple]:
    draw = random.Random(9)
    return [(i, draw.choice([None, "", "a", "n", "1:a", "é" * 5]), draw.choice([None, True, False]), None,
             draw.choice([None, [], ["x", None], [None, "x"]]), draw.choice([None, {}, {"p": 1, "q": 2}]))
            for i in range(count)]


def whole(table):
    return digests.table_digest(table).first()


def test_order_and_layout_do_not_matter(spark):
    rows = rows_of(500) + rows_of(20)
    shuffled = random.Random(1).sample(rows, len(rows))
    a, b = frame(spark, rows).repartition(7), frame(spark, shuffled).coalesce(1)
    assert whole(a) == whole(b.select(*reversed(b.columns))) and whole(a).rows == 520
    assert digests.differing(a, b, ["id"]) is None and digests.changed_rows(a, b, ["id"]).count() == 0


@pytest.mark.parametrize("pair", [
    ((1, None, None, None, None, None), (1, "n", None, None, None, None)),
    ((1, None, None, None, None, None), (1, "", None, None, None, None)),
    ((1, "a", None, None, ["x", None], None), (1, "a", None, None, [None, "x"], None)),
    ((1, "a", None, None, [], None), (1, "a", None, None, None, None)),
    ((1, "a", None, None, None, {}), (1, "a", None, None, None, None)),
    ((11, "a", None, None, None, None), (1, "1a", None, None, None, None)),
])
def test_rows_that_look_alike(spark, pair):
    assert whole(frame(spark, pair[:1])).digest != whole(frame(spark, pair[1:])).digest


def test_repeated_rows_count(spark):
    """Two of one row are neither none nor two of another."""
    a, b = (1, "a", None, None, None, None), (1, "b", None, None, None, None)
    seen = {whole(frame(spark, rows)).digest for rows in ([], [a], [b], [a, a], [b, b], [a, b], [a] * 4)}
    assert len(seen) == 7 and whole(frame(spark, [])).digest == "0" * 32


def test_changes_against_counting(spark):
    """Changed, missing, extra and repeated rows, among equal ones, as counting finds them."""
    left = rows_of(400) + rows_of(3)
    right = list(left)
    right[17] = (17, "other", True, None, None, None)
    del right[50:53]
    right += [left[5], left[5], (None, None, None, None, None, None), (900, "new", None, None, ["z"], {"k": 1})]
    key = lambda r: (r[0], r[1], r[2], str(r[4]), str(r[5]))
    a, b = Counter(map(key, left)), Counter(map(key, right))
    got = Counter((r.side, *key(r)) for r in digests.changed_rows(frame(spark, left), frame(spark, right), ["id"]).collect())
    wanted = Counter({("left", *k): n for k, n in (a - b).items()}) + Counter({("right", *k): n for k, n in (b - a).items()})
    assert got == wanted
    bits, buckets = digests.differing(frame(spark, left), frame(spark, right), ["id"])
    assert bits == digests.LEVELS[-1] and buckets.count() <= 7


def test_only_digests_are_shuffled(spark):
    a = frame(spark, rows_of(50))
    counted = digests._sided(a, a, ["id"], None).groupBy("digest").count()
    plan = spark._jvm.PythonSQLUtils.explainString(counted._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert inputs and all(re.fullmatch(r"digest#\d+, count#\d+L?", i) for i in inputs)


def test_clashing_names(spark):
    with pytest.raises(ValueError, match="side"):
        digests.changed_rows(*[spark.range(1).withColumnRenamed("id", "Side")] * 2, ["Side"])
