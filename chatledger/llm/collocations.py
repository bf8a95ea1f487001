"""Collocations from a weighted de Bruijn graph of word sequences.

Texts are cut into pieces and words. Every word occurrence begins one gram: the longest, of four words at most, that its
piece allows. Distinct grams with their counts are the edges of the graph; an edge of four words joins the node of its
first three to the node of its last three, and shorter grams are the corrections for pieces that end at a node. How often
a node of three words occurs is the sum of the edges that leave it and its own piece ends; two words and one follow in
the same way from three and two. Nothing but the longest grams is ever counted in the texts.

Most grams are too rare to matter. Two passes before count word pairs, then triples of such pairs, by 64-bit hash, with
which bitmaps of fixed size (16 MB each, broadcast) say of a pair or triple whether it may be frequent. A gram is cut
before one that can't be: that is one more kind of piece end, so the sums stay exact for everything the bitmaps admit, and
hash collisions only admit more. Vocabularies that fill a bitmap get more admitted; the result is the same, only the
shuffle grows.

Nodes through which all that enters leaves by one edge are compacted: ``paths`` joins frequent edges to phrases of any
length by pointer doubling.

Null texts are empty, null languages are ``und``; rows equal in all columns each count; texts are handled whole, a
very long one by itself; an empty table gives an empty result; columns other than lang and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatledger.llm.common import cut_lineage, flat_text, slices, stored
from chatledger.llm.hashing import lower, mix, word_codes

#: Words of the longest gram.
LONGEST = 4

#: A bitmap has 2**BITS bits: 16 MB at every size of the corpus.
BITS = 27

#: Bytes of text handled at a time; a longer text is handled by itself.
SLICE = 1 << 18

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_PARTS = _ENDS.copy()
_PARTS[[9, 32]] = True
_PAIR = np.uint64(0x9DDFEA08EB382D69)


class Words:
    """The words of texts that lie one after the other: ``ids`` into ``names`` (and the hashes of these), the language of
    each, and how many words its piece still has from it on."""

    def __init__(self, part: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> None:
        part = lower(part)
        inside = ~_PARTS[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
        ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        packed = part[inside]
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
        self.ids, self.names = np.asarray(coded.indices), coded.dictionary
        flat, at = flat_text(self.names)
        self.hashes = word_codes(flat, at[:-1], at[1:]) if len(self.names) else np.zeros(0, np.uint64)
        text = np.searchsorted(offsets, starts, "right") - 1
        self.langs = langs[text]
        stops = np.cumsum(_ENDS[part])
        piece = stops[starts] if len(starts) else starts
        new = np.ones(len(starts), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        self.left = np.repeat(np.append(first[1:], len(starts)), np.diff(np.append(first, len(starts)))) - np.arange(len(starts))

    def hashes_from(self, lang_hashes: np.ndarray) -> list[np.ndarray]:
        """Hashes of each word, of it with the next one, and of it with the next two (where its piece has them)."""
        one = mix(self.hashes[self.ids] + lang_hashes[self.langs])
        later = np.concatenate([self.hashes[self.ids], np.zeros(2, np.uint64)])
        two = mix(one * _PAIR + later[1 : len(one) + 1])
        return [one, two, mix(two * _PAIR + later[2 : len(one) + 2])]


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    for batch in batches:
        coded = batch.column("lang").dictionary_encode()
        flat, offsets = flat_text(batch.column("text"))
        codes, langs = np.asarray(coded.indices), coded.dictionary.to_pylist()
        data, at = flat_text(coded.dictionary)
        hashes = mix(word_codes(data, at[:-1], at[1:])) if langs else np.zeros(0, np.uint64)
        for first, last in slices(offsets, SLICE):
            part = flat[offsets[first] : offsets[last]]
            yield Words(part, offsets[first : last + 1] - offsets[first], codes[first:last]), langs, hashes


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, n: counts of words and pairs by hash; and lang, n: the words of a language."""
    for words, langs, hashes in _slices(batches):
        one, two, _ = words.hashes_from(hashes)
        h, n = np.unique(np.concatenate([one, two[words.left > 1]]), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.nulls(len(h), pa.string()), pa.array(n)], ["h", "lang", "n"])
        total = np.bincount(words.langs, minlength=len(langs))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(langs), pa.int64()), pa.array(langs, pa.string()), pa.array(total)], ["h", "lang", "n"])


def _count_triples(pairs):
    """h, n: counts by hash of triples both of whose pairs are admitted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _, hashes in _slices(batches):
            _, two, three = words.hashes_from(hashes)
            follows = (words.left > 1) & _admitted(pairs.value, two)
            h, n = np.unique(three[: len(two) - 1][follows[:-1] & follows[1:] & (words.left[:-1] > 2)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return run


def _bitmap(counted: DataFrame, min_count: int) -> np.ndarray:
    """One bit for every top of a hash that a frequent word or pair has. At most 2**BITS bits come to the driver, in
    blocks of 4 KB."""
    place = F.shiftrightunsigned("h", 64 - BITS)
    some = counted.where((F.col("n") >= min_count) & F.col("h").isNotNull()).select(place.alias("p"))
    blocks = some.groupBy(F.shiftright("p", 15).alias("b")).agg(
        F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("bits")).collect()
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    for block in blocks:
        bitmap[block.b * 4096 : (block.b + 1) * 4096] = np.frombuffer(block.bits, np.uint8)
    return bitmap


def _admitted(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _grams(pairs, triples):
    """lang, gram, n: the longest admitted gram from every word on, counted within a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs, hashes in _slices(batches):
            one, two, three = words.hashes_from(hashes)
            size = len(one)
            # May the word after the next so many follow? A pair for the first step, then triples.
            steps = [(words.left > 1) & _admitted(pairs.value, two), (words.left > 2) & _admitted(triples.value, three)]
            length = np.ones(size, np.int64)
            for k in range(1, LONGEST):
                more = np.flatnonzero(length == k)
                if k > 1:  # the triple's own pairs are admitted, too
                    more = more[steps[0][more + k - 1]]
                length[more[steps[min(k, 2) - 1][more + max(k - 2, 0)]]] += 1
            at = np.flatnonzero((length > 1) | _admitted(pairs.value, one))
            length, ids = length[at], words.ids.astype(np.int64) + 1
            word = [np.where(length > k, ids[np.minimum(at + k, size - 1)], 0) for k in range(LONGEST)]
            front, back = word[0] << 32 | word[1], word[2] << 32 | word[3]
            lang = words.langs[at]
            rank = np.lexsort((back, front, lang))
            front, back, lang = front[rank], back[rank], lang[rank]
            new = np.ones(len(rank), bool)
            new[1:] = (front[1:] != front[:-1]) | (back[1:] != back[:-1]) | (lang[1:] != lang[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(rank)))
            keep = rank[first]
            names = words.names.cast(pa.large_string())
            parts = [names.take(pa.array(w[keep] - 1, mask=w[keep] == 0)) for w in word]
            gram = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()), null_handling="skip")
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()).take(pa.array(lang[first])), gram.cast(pa.string()),
                 pa.array(n)], ["lang", "gram", "n"])

    return run


def edges(documents: DataFrame, *, min_count: int) -> tuple[DataFrame, DataFrame]:
    """lang, gram, words, n of all grams; and lang, n: the words of each language. Counts of phrases follow from the
    grams exactly for all phrases that occur ``min_count`` times or more."""
    texts, context = _texts(documents), documents.sparkSession.sparkContext
    counted = texts.mapInArrow(_count_pairs, "h long, lang string, n long").groupBy("h", "lang").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted.where((F.col("n") >= min_count) | F.col("lang").isNotNull()))
    pairs = context.broadcast(_bitmap(counted, min_count))
    threes = texts.mapInArrow(_count_triples(pairs), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    triples = context.broadcast(_bitmap(threes, min_count))
    grams = texts.mapInArrow(_grams(pairs, triples), "lang string, gram string, n long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    words = F.char_length("gram") - F.char_length(F.replace("gram", F.lit(" "), F.lit(""))) + 1
    grams = stored(grams.withColumn("words", words), "grams")
    for bitmap in (pairs, triples):  # the grams are written; nothing asks for the bitmaps again
        bitmap.destroy()
    return grams, counted.where("lang is not null and n > 0").select("lang", "n")


def first_words(phrase: str | Column, k: int) -> Column:
    """The first ``k`` words of a phrase."""
    return F.substring_index(phrase, " ", k)


def flows(grams: DataFrame, *, min_count: int) -> DataFrame:
    """lang, phrase, words, a: every phrase of up to four words that occurs ``min_count`` times or more. A node's count is
    what leaves it along longer grams and the grams that end at it."""
    level = grams.where(F.col("words") == LONGEST).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"))
    out = level.withColumn("words", F.lit(LONGEST))
    for k in range(LONGEST - 1, 0, -1):
        leaving = level.select("lang", first_words("phrase", k).alias("phrase"), "a")
        ending = grams.where(F.col("words") == k).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"))
        level = leaving.union(ending).groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
        out = out.union(level.withColumn("words", F.lit(k)).select("lang", "phrase", "a", "words"))
    return cut_lineage(out.where(F.col("a") >= min_count).select("lang", "phrase", "words", "a"))


def score_cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every candidate: of its lowest-scoring cut."""
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = candidates.withColumn("k", cut).withColumns({
        "first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    one = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    cuts = cuts.join(one("first", "l"), ["lang", "first"]).join(one("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0))) div (cast(l as decimal(20, 0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(lowest).select(
        "lang", "phrase", "words", "a", "low.l", "low.r", "low.score")


def paths(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a: the compacted graph. Frequent edges of four words are joined through the nodes of three words
    that all of one edge enters and all of one edge leaves, to phrases of any length, each in one piece, that occur
    ``a`` times as a whole. Such nodes can't form a circle: every occurrence would go on for ever."""
    edge = counts.where(F.col("words") == LONGEST).select(
        "lang", "phrase", "a", first_words("phrase", LONGEST - 1).alias("tail"),
        F.substring_index("phrase", " ", 1 - LONGEST).alias("head"))
    node = counts.where(F.col("words") == LONGEST - 1).select("lang", F.col("phrase").alias("node"), F.col("a").alias("f"))
    whole = F.col("a") == F.col("f")  # an edge as frequent as the node is the only one on its side
    entering = edge.join(node.withColumnRenamed("node", "head"), ["lang", "head"]).where(whole)
    leaving = edge.join(node.withColumnRenamed("node", "tail"), ["lang", "tail"]).where(whole)
    before = leaving.select("lang", F.col("tail").alias("head"), "phrase").join(
        entering.select("lang", "head", F.col("phrase").alias("root")), ["lang", "head"]).select("lang", "phrase", "root")
    # Pointer doubling towards the first edge of each path.
    state = cut_lineage(edge.select("lang", "phrase", "a").join(before, ["lang", "phrase"], "left").select(
        "lang", "phrase", "a", F.coalesce("root", "phrase").alias("root"), F.when(F.col("root").isNull(), 0).otherwise(1).alias("far"),
        F.lit(True).alias("moved")))
    while not state.where("moved and far > 0").isEmpty():
        ahead = state.select("lang", F.col("phrase").alias("root"), F.col("root").alias("then"), F.col("far").alias("more"))
        state = cut_lineage(state.join(ahead, ["lang", "root"]).select(
            "lang", "phrase", "a", F.col("then").alias("root"), (F.col("far") + F.col("more")).alias("far"),
            (F.col("more") > 0).alias("moved")))
    last = F.struct("far", F.substring_index("phrase", " ", -1).alias("word"))
    joined = state.groupBy("lang", "root").agg(F.array_sort(F.collect_list(last)).alias("l"), F.max("a").alias("a"))
    words = F.concat_ws(" ", F.col("root"), F.concat_ws(" ", F.slice("l.word", 2, F.size("l"))))
    phrase = F.when(F.size("l") > 1, words).otherwise(F.col("root"))
    return joined.select("lang", phrase.alias("phrase"), (F.size("l") + LONGEST - 1).alias("words"), "a")


def outer_phrases(counts: DataFrame) -> DataFrame:
    """lang, phrase, longest: for phrases of two words or more that lie in a longer one of up to four, the most that any
    such longer one occurs. All edges of a compacted path are equally frequent, so each place of a path is listed once."""
    longer = paths(counts).withColumn("upto", F.lit(LONGEST - 1)).union(
        counts.where(F.col("words") == LONGEST - 1).select("lang", "phrase", "words", "a", F.lit(LONGEST - 2)))
    longer = longer.withColumn("w", F.split("phrase", " "))
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("upto")), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.concat_ws(" ", F.slice("w", i, m)))))
    return longer.select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longest"))


def collocations(documents: DataFrame, *, min_count: int = 30, inside_percent: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language. A phrase that lies in a longer one is
    left out if that one occurs ``inside_percent`` of its times or more."""
    grams, totals = edges(documents, min_count=min_count)
    counts = flows(grams, min_count=min_count)
    outer = F.expr(f"cast(longest as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {inside_percent}")
    candidates = counts.where("words > 1").join(outer_phrases(counts), ["lang", "phrase"], "left")
    candidates = candidates.where(F.col("longest").isNull() | ~outer).drop("longest")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = score_cuts(candidates, counts).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= top).join(F.broadcast(totals), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(min_count: int = 30, inside_percent: int = 80, top: int = 2000) -> str:
    """SQL for ``collocations``."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{low}'), '[.,;:!?\n-\r]')) AS piece
            FROM documents
        ), parts AS (
            SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces
        ), grams AS (
            SELECT lang, m AS words, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
            FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM parts), range(1, 5) AS t(m)
            WHERE i + m - 1 <= len(w)
        ), counts AS (
            SELECT lang, words, phrase, count(*) AS a FROM grams GROUP BY lang, words, phrase
        ), totals AS (
            SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang
        ), often AS (
            SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE a >= {min_count}
        ), cuts AS (
            SELECT c.lang, c.words, c.phrase, c.a, k, l.a AS l, r.a AS r,
                   ((c.a::HUGEINT * 2000000) // (l.a::HUGEINT + r.a))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, words)) AS k FROM often WHERE words > 1) c
            JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
            JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, k + 1, c.words), ' ')
        ), scored AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), inner_parts AS (
            SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS longest
            FROM (SELECT *, unnest(range(1, words + 1)) AS i FROM often WHERE words > 2), range(2, 4) AS t(m)
            WHERE m < words AND i + m - 1 <= words GROUP BY ALL
        ), kept AS (
            SELECT s.* FROM scored s LEFT JOIN inner_parts p ON p.lang = s.lang AND p.phrase = s.phrase
            WHERE p.longest IS NULL OR 100 * p.longest::HUGEINT < {inside_percent} * s.a::HUGEINT
        )
        SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n, score
        FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= {top}"""
