"""Phrase collocations from an FM-index over word numbers for each shard of text.

A shard is some megabytes of text of one language, as a sequence of word numbers with a break between
pieces. Its index is the Burrows-Wheeler transform of the sequence and that of its reverse, with suffixes in
order by their first ``DEPTH`` words, which is all that phrases of that length ask for. An interval of
the order stands for a phrase; extending it by a word to the left reads the words of the transform within it, and
tells the interval of the longer phrase in both indexes at once, so that it can then be extended to the right.
All intervals of a length are extended together.

Flow. (1) Texts become shards, each with its own vocabulary. (2) Vocabularies are added up to counts of
words; frequent ones get numbers, which go back to the shards. (3) Shards enumerate pairs of frequent words
with counts, which are added up. (4) Shards extend pairs that may be frequent to triples. A filter of fixed size
tells which pairs can't be: beyond some ten millions of frequent pairs it lets more triples through, which are
then found rare by their sums, so results are the same. (5) Counts are joined to scores.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, slices, stored
from loomgraph.llm.words import BREAK, byte_table, word_codes
from loomgraph.operators.order import in_order
from loomgraph.shared import scratch

DEPTH = 3  # words of the longest phrase
SHARD_BYTES = 4 << 20
FILTER_BITS = 26  # a filter of 2**26 bits, or 8 MB
TABLE = byte_table([9], b".,;:!?\n\x0b\x0c\r", lower=True)
SPLIT = 64  # parts of a language that are ranked before the whole


class Index:
    """One direction of an FM-index whose suffixes are in order by their first ``depth`` symbols; symbol 0 is a break."""

    def __init__(self, seq: np.ndarray, sigma: int, depth: int):
        n, bits = len(seq), int(sigma).bit_length()
        padded = np.concatenate([seq, np.zeros(depth, seq.dtype)])
        if bits * depth < 64:
            key = np.zeros(n, np.int64)
            for k in range(depth):
                key = key << bits | padded[k : k + n]
            order = np.argsort(key, kind="stable")
        else:
            order = np.lexsort([padded[k : k + n] for k in reversed(range(depth))])
        self.bwt = seq[order - 1]
        self.n, self.sigma = n, sigma
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.occurrences = np.sort(self.bwt * n + np.arange(n))

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often a symbol stands in the transform before a row."""
        return np.searchsorted(self.occurrences, symbol * self.n + row) - self.first[symbol]

    def extensions(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(interval, symbol, count, smaller): the symbols before each interval's rows, and how many rows have a smaller one."""
        of = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(of)) + np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        pair, count = np.unique(of * self.sigma + self.bwt[rows], return_counts=True)
        interval = pair // self.sigma
        before = np.cumsum(count) - count
        start = np.searchsorted(interval, np.arange(len(low)))
        return interval, pair % self.sigma, count, before - before[start[interval]]


class BidirectionalIndex:
    """Phrases of a sequence as intervals of two indexes, extended on either side. The sequence starts and ends with a break."""

    def __init__(self, seq: np.ndarray, sigma: int, depth: int = DEPTH):
        self.left = Index(seq, sigma, depth)
        self.args = seq, sigma, depth

    @functools.cached_property
    def right(self) -> Index:
        """The reverse's index, for those that extend to the right at all."""
        seq, sigma, depth = self.args
        return Index(seq[::-1].copy(), sigma, depth)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, low, low in the reverse, count) of each symbol but the break."""
        first = self.left.first
        symbol = np.arange(1, self.left.sigma)
        low, size = first[symbol], np.diff(first)[symbol]
        return symbol, low, low, size

    def extend(self, low: np.ndarray, other: np.ndarray, size: np.ndarray, right: bool = False) -> tuple[np.ndarray, ...]:
        """(interval, symbol, low, other, count): each interval's phrase with one more symbol before it, or after it with ``right``.

        ``low`` is the interval's start in the index that is asked (the reverse one for ``right``) and ``other`` that in the other one.
        """
        side = self.right if right else self.left
        interval, symbol, count, smaller = side.extensions(low, size)
        keep = symbol > 0
        interval, symbol, count, smaller = interval[keep], symbol[keep], count[keep], smaller[keep]
        return interval, symbol, side.first[symbol] + side.rank(symbol, low[interval]), other[interval] + smaller, count


def cut(text: bytes, most: int) -> Iterator[bytes]:
    """A long text in parts of about ``most`` bytes, cut where phrases can't cross."""
    breaks = np.flatnonzero(np.frombuffer(text.translate(TABLE), np.uint8) == BREAK) if len(text) > most else np.zeros(0, np.int64)
    at = 0
    while len(text) - at > most and len(breaks) and breaks[-1] >= at + most:
        end = int(breaks[np.searchsorted(breaks, at + most)])
        yield text[at:end]
        at = end
    yield text[at:]


def shards(df: DataFrame, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, lang, words, counts, stream): texts of a language put together, their distinct words and counts, and all words in order as numbers from 1, with 0 for breaks, as 32-bit integers."""
    schema = "lang string, words array<binary>, counts array<long>, stream binary"

    def shard(lang, texts):
        codes, words, _, piece = word_codes(texts, TABLE)
        new = np.cumsum(np.diff(piece, prepend=-1) > 0)
        stream = np.zeros(len(codes) + int(new[-1]) + 1, np.int32) if len(codes) else np.zeros(0, np.int32)
        if len(codes):
            stream[np.arange(len(codes)) + new] = codes + 1
        counts = np.bincount(codes, minlength=len(words))
        columns = [pa.array([lang]), pa.ListArray.from_arrays([0, len(words)], words.cast(pa.binary())), pa.ListArray.from_arrays([0, len(words)], pa.array(counts, pa.int64())), pa.array([stream.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "counts", "stream"])

    def run(batches):
        held, sizes, total = defaultdict(list), defaultdict(int), 0
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for t in cut(text, shard_bytes):
                        held[lang].append(t)
                        sizes[lang] += len(t)
                        total += len(t)
                        if total >= shard_bytes:
                            largest = max(sizes, key=sizes.get)
                            total -= sizes.pop(largest)
                            yield shard(largest, held.pop(largest))
        for lang, texts in held.items():
            yield shard(lang, texts)

    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, schema).withColumn("shard", F.monotonically_increasing_id())


def numbered(cut_up: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of shards: (lang, word, f, number) of words that occur ``least`` times or more, (lang, n) of all words, and (stream) of shards with those numbers, 0 for other words and breaks."""
    own = cut_up.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("shard", "lang", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
    total = stored(own.groupBy("lang").agg(F.sum("count").alias("n")), "totals", keep=True)
    often = own.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    words = stored(in_order(often, F.desc("f"), "lang", "word").select("lang", "word", "f", "number"), "words", keep=True)
    told = own.select("shard", "lang", "at", "word").join(words.select("lang", "word", "number"), ["lang", "word"]).groupBy("shard").agg(F.collect_list("at").alias("at"), F.collect_list("number").alias("number"))

    def renumber(batches):
        for batch in batches:
            for part in slices(batch, "stream"):
                out = []
                for k in range(part.num_rows):
                    stream = np.frombuffer(part.column("stream")[k].as_py(), np.int32)
                    at, number = (part.column(c)[k].values.to_numpy() for c in ("at", "number"))
                    table = np.zeros(max(int(stream.max(initial=0)), int(at.max(initial=-1)) + 1) + 1, np.int64)
                    table[at + 1] = number
                    out.append(table[stream].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["stream"])

    renamed = cut_up.select("shard", "stream").join(told, "shard").select("stream", "at", "number").mapInArrow(renumber, "stream binary")
    return words, total, stored(renamed, "streams", keep=True)


def indexes(stream: bytes) -> tuple[np.ndarray, BidirectionalIndex]:
    """The numbers of a shard's words in order, and the index of the sequence; runs of breaks count as one."""
    seq = np.frombuffer(stream, np.uint32)
    seq = seq[(seq > 0) | np.append(seq[1:] > 0, False)] if len(seq) else seq
    numbers, codes = np.unique(np.concatenate([[0], seq, [0]]).astype(np.int64), return_inverse=True)
    return numbers, BidirectionalIndex(codes.astype(np.int64), len(numbers))


def spread(numbers: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """Three places of a filter for each 64-bit number."""
    x = numbers.astype(np.uint64)
    with np.errstate(over="ignore"):
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(c)
    return tuple((x >> np.uint64(s) & np.uint64((1 << bits) - 1)).astype(np.int64) for s in (0, 19, 37))


def pair_filter(pairs: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of the keys in ``pair``: 2**bits bits whatever their number, ORed together by Spark in words of 64."""

    def run(batches):
        for batch in batches:
            places = np.unique(np.concatenate(spread(batch.column("pair").to_numpy(), bits)))
            word, start = np.unique(places >> 6, return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), start) if len(word) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    rows = pairs.select("pair").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return out.view(np.uint8)


def may_hold(bloom: np.ndarray, pair: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    held = np.ones(len(pair), bool)
    for place in spread(pair, bits):
        held &= (bloom[place >> 3] >> (place & 7).astype(np.uint8) & 1) > 0
    return held


def pair_counts(streams: DataFrame) -> DataFrame:
    """(pair, count) for each shard: two numbers of 32 bits in one."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                numbers, index = indexes(batch.column("stream")[k].as_py())
                symbol, low, other, size = index.words()
                second, first, _, _, count = index.extend(low, other, size)
                pair = numbers[first] << 32 | numbers[symbol[second]]
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count, pa.int64())], names=["pair", "count"])

    return streams.mapInArrow(run, "pair long, count long")


def triple_counts(streams: DataFrame, bloom: np.ndarray) -> DataFrame:
    """(pair, third, count) for each shard, of triples both of whose pairs the filter lets pass."""
    sent = streams.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        held = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                numbers, index = indexes(batch.column("stream")[k].as_py())
                symbol, low, other, size = index.words()
                second, first, low, other, count = index.extend(low, other, size)
                pair = numbers[first] << 32 | numbers[symbol[second]]
                often = may_hold(held, pair)
                pair, middle, low, other, count = pair[often], numbers[symbol[second]][often], low[often], other[often], count[often]
                of, third, _, _, count = index.extend(other, low, count, right=True)
                third = numbers[third]
                often = may_hold(held, middle[of] << 32 | third)
                yield pa.RecordBatch.from_arrays([pa.array(pair[of][often]), pa.array(third[often]), pa.array(count[often], pa.int64())], names=["pair", "third", "count"])

    return streams.mapInArrow(run, "pair long, third long, count long")


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits."""
    d = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (d(a) * d(a)).cast("decimal(30,0)"), d(left) * d(right))


def scored_phrases(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, cover: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of two or three words that occur ``least`` times or more in a language and aren't mostly part of a longer one.

    A phrase goes if a longer one that holds it has ``cover`` percent or more of its occurrences. A null
    language is ``und``, a null text empty; repeated rows count each time; an empty table gives an empty one. A text
    is in one shard up to ``shard_bytes``, longer ones are cut where phrases end; a longer piece without any such end stays whole.
    """
    with scratch(df.sparkSession):
        words, total, streams = numbered(stored(shards(df, lang_col, text_col, shard_bytes), "shards"), least)
    pairs = stored(pair_counts(streams).groupBy("pair").agg(F.sum("count").alias("a")).where(F.col("a") >= least), "pairs")
    triples = triple_counts(streams, pair_filter(pairs)).groupBy("pair", "third").agg(F.sum("count").alias("a")).where(F.col("a") >= least)
    triples = stored(triples, "triples")

    number = F.lit((1 << 32) - 1)
    parts = [F.shiftright("pair", 32).alias("x"), F.col("pair").bitwiseAND(number).alias("y")]
    named = lambda at, as_: words.select(F.col("number").alias(at), F.col("word").alias(f"w{at}"), F.col("f").alias(as_))
    later = F.shiftleft("y", 32).bitwiseOR(F.col("third"))
    held = triples.select("pair", "third", "a", *parts).withColumn("later", later)
    longest = held.select(F.explode(F.array("pair", "later")).alias("pair"), "a").groupBy("pair").agg(F.max("a").alias("most"))
    two = pairs.join(longest, "pair", "left").where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a"))).select("a", *parts)
    two = two.join(named("x", "l"), "x").join(named("y", "r"), "y").select(F.col("x").alias("number"), F.concat_ws(" ", *(F.col(c).cast("string") for c in ("wx", "wy"))).alias("phrase"), "a", "l", "r")
    three = held.join(pairs.select("pair", F.col("a").alias("l2")), "pair").join(pairs.select(F.col("pair").alias("later"), F.col("a").alias("r1")), "later")
    three = three.join(named("x", "l1"), "x").join(named("y", "_f"), "y").join(named("third", "r2"), "third")
    s1, s2 = exact_score(F.col("a"), F.col("l1"), F.col("r1")), exact_score(F.col("a"), F.col("l2"), F.col("r2"))
    first = s1 <= s2
    three = three.select(F.col("x").alias("number"), F.concat_ws(" ", *(F.col(c).cast("string") for c in ("wx", "wy", "wthird"))).alias("phrase"), "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"))
    of = words.select("number", "lang").join(total, "lang")
    return two.unionByName(three).join(of, "number").select("lang", "phrase", "a", "l", "r", "n", exact_score(F.col("a"), F.col("l"), F.col("r")).alias("score"))


def collocations(df: DataFrame, top: int = 2000, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of ``scored_phrases`` in each language, by score, occurrences and phrase.

    Each language is ranked in parts first, so that its last step holds ``SPLIT`` times ``top`` rows at most.
    """
    order = [F.desc("score"), F.desc("a"), "phrase"]
    at = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    parts = scored_phrases(df, **options).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SPLIT)))
    best = parts.withColumn("rank", at("lang", "part")).where(F.col("rank") <= top).drop("part")
    return best.withColumn("rank", at("lang")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir):
    return collocations(documents(spark, sf_dir))


QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {
    "op11_collocations": r"""
        WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang,
                          unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
             g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
                   UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
                   UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
             f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
             n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
             c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
             cut AS (SELECT lang, k, phrase, a, 1 AS k1, w[1] AS one, array_to_string(w[2:], ' ') AS two FROM c
                     UNION ALL SELECT lang, k, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
             s AS (SELECT cut.*, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
                   FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = one JOIN f y ON y.lang = cut.lang AND y.phrase = two),
             low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k1) = 1),
             longer AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM c WHERE k = 3) GROUP BY ALL),
             kept AS (SELECT low.* FROM low LEFT JOIN longer ON longer.lang = low.lang AND part = phrase AND k = 2 WHERE most IS NULL OR 100 * most < 50 * a),
             ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}
