"""Periodic runs of words, by internal pattern matching.

A run of period q is looked for through aligned blocks of 2**k words with 2**k <= q < 2**(k+1): as a run
has four periods or more, the first aligned block in it stands there again q words on. Blocks ask where
they next occur in the window that follows them, as range successors in a wavelet matrix over the suffix array: the interval of a
block holds its occurrences, and the least of them from some word on is one walk down the matrix. Occurrences
in such a window form an arithmetic progression. One or two of them are candidates as they stand; more mean that the block
itself has the progression's difference as period, and then the ends of those two inner runs are q apart. Candidates are
extended to both sides by the tables of ranks from which the suffix array was built, and stay if long enough.

Only texts in which some block may repeat so soon are put in order: each word of such a block must stand again within
2**(k+1) words, which most texts' blocks of no size meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, slices, whole_texts
from loomgraph.llm.words import byte_table, word_codes

BLANKS = bytes([32, *range(9, 14)])  # what bytes.split() takes as blanks, too
TABLE = byte_table(BLANKS)
EXPONENT, LEAST = 4, 6  # a run's length in periods, and in words


class WaveletMatrix:
    """Range successors over an array of numbers below 2**bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, v = bits, [], values
        for b in reversed(range(bits)):
            bit = (v >> b & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~bit)]))
            v = np.concatenate([v[~bit], v[bit]])

    def smaller(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in each range are below x."""
        count = np.zeros(len(low), np.int64)
        for b, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            one = (x >> b & 1).astype(bool)
            l0, h0 = zeros[low], zeros[high]
            count += np.where(one, h0 - l0, 0)
            low, high = np.where(one, zeros[-1] + low - l0, l0), np.where(one, zeros[-1] + high - h0, h0)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value of each range, from 0."""
        value = np.zeros(len(low), np.int64)
        for b, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            l0, h0 = zeros[low], zeros[high]
            one = k >= h0 - l0
            k = np.where(one, k - (h0 - l0), k)
            value |= one.astype(np.int64) << b
            low, high = np.where(one, zeros[-1] + low - l0, l0), np.where(one, zeros[-1] + high - h0, h0)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value from x on in each range, or 2**bits."""
        k = self.smaller(low, high, x)
        found = k < high - low
        out = np.full(len(low), 1 << self.bits, np.int64)
        out[found] = self.smallest(low[found], high[found], k[found])
        return out


class Suffixes:
    """Of a sequence of numbers whose texts each end in a number of its own: the suffix array, and for each k the first row of the suffixes that share their first 2**k numbers."""

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        self.ranks: list[np.ndarray] = []
        key = seq
        while True:
            order = np.argsort(key, kind="stable")
            new = np.diff(key[order], prepend=-1) != 0
            first = np.flatnonzero(new)
            rank = np.empty(n, np.int64)
            rank[order] = first[np.cumsum(new) - 1]
            self.ranks.append(rank)
            if len(first) == n:
                break
            step = 1 << (len(self.ranks) - 1)
            key = rank * (n + 1) + np.concatenate([rank[step:] + 1, np.zeros(min(step, n), np.int64)])
        self.array = order
        self.n = n

    def interval(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that share 2**k numbers with those at ``at``."""
        rank = self.ranks[k]
        return rank[at], rank[at] + np.bincount(rank, minlength=self.n)[rank[at]]

    def common(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many numbers from a and from b on are the same, or before them with ``back``."""
        total = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.ranks))):
            x, y = (a - total - (1 << k), b - total - (1 << k)) if back else (a + total, b + total)
            held = (x >= 0) & (x < self.n) & (y >= 0) & (y < self.n)
            same = self.ranks[k][np.where(held, x, 0)] == self.ranks[k][np.where(held, y, 0)]
            total += (held & same).astype(np.int64) << k
        return total


def blocks(seq: np.ndarray) -> list[np.ndarray]:
    """For each k, starts of aligned blocks of 2**k all of whose numbers stand again within 2**(k+1)."""
    order = np.argsort(seq, kind="stable")
    far = np.iinfo(np.int64).max
    gap = np.full(len(seq), far, np.int64)
    again = seq[order[1:]] == seq[order[:-1]]
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    out = []
    while len(gap):
        size = 1 << len(out)
        out.append(np.flatnonzero(gap < 2 * size) * size)
        gap = np.maximum(gap[0 : len(gap) // 2 * 2 : 2], gap[1::2])
        if not (gap < far).any():
            break
    return out


def find_runs(seq: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs with at least ``exponent`` periods and ``least`` numbers, by start and end. ``exponent`` is 4 or more."""
    none = np.zeros((0, 3), np.int64)
    levels = blocks(seq)
    if not any(map(len, levels)):
        return none
    suffixes = Suffixes(seq)
    matrix = WaveletMatrix(suffixes.array, int(len(seq)).bit_length())
    found = [none]
    for k, at in enumerate(levels[: len(suffixes.ranks)]):
        size = 1 << k
        low, high = suffixes.interval(k, at)
        held = high - low > 1
        at, low, high = at[held], low[held], high[held]
        hits = [at + size - 1]
        for _ in range(3):
            x = np.minimum(hits[-1] + 1, len(seq))
            hit = matrix.successor(low, high, x)
            hits.append(np.where((hits[-1] < len(seq)) & (hit < at + 2 * size), hit, len(seq)))
        one, two, three = (h < len(seq) for h in hits[1:])
        many = one & two & three
        s, p, d = at[many], hits[1][many], (hits[2] - hits[1])[many]
        ends = p + suffixes.common(p, p + d) - s - suffixes.common(s, s + d)
        starts = np.concatenate([at[one & ~many], at[two & ~many], s])
        periods = np.concatenate([(hits[1] - at)[one & ~many], (hits[2] - at)[two & ~many], ends])
        fits = (periods >= size) & (periods < 2 * size)
        s, q = starts[fits], periods[fits]
        begin, end = s - suffixes.common(s, s + q, back=True), s + q + suffixes.common(s, s + q)
        long = end - begin >= np.maximum(least, exponent * q)
        found.append(np.stack([begin[long], end[long], q[long]], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])] if len(rows) else rows


def runs_of_texts(codes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For each text, of ``counts`` numbers each, its runs as rows (start, length, period)."""
    n = len(counts)
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(n), counts)
    own = int(codes.max(initial=0)) + 1
    seq = np.insert(codes, ends, own + np.arange(n))  # each text ends in a number of its own
    text = np.insert(of, ends, np.arange(n))
    some = np.zeros(n, bool)
    for at in blocks(seq):
        some[text[at]] = True
    out = [np.zeros((0, 3), np.int64)] * n
    if some.any():
        kept = some[text]
        seq, text = seq[kept], text[kept]
        rows = find_runs(seq)
        first = np.searchsorted(text, np.arange(n))
        owner = text[rows[:, 0]]
        rows = np.stack([rows[:, 0] - first[owner], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)
        for t in np.unique(owner).tolist():
            mine = rows[np.searchsorted(owner, t) : np.searchsorted(owner, t, side="right")]
            out[t] = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
    return out


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrange: Callable[[list, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row: runs as structs (start, length, period) by start and period, and the words outside of later periods, joined by one space.

    A run is a stretch of words with smallest period q that no neighbouring word extends, of six words and four periods
    or more. ``arrange`` gives, for ids and numbers of words, which of all texts' words stands at each place (by default each its own).
    A null or blank text has no words and no runs, rows that repeat an id are each looked at, an empty
    table gives an empty one. A text is in one task: some hundred bytes of memory for each of its words if it has runs.
    """
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                codes, _, of, _ = word_codes(texts, TABLE)
                counts = np.bincount(of, minlength=len(texts))
                places = None if arrange is None else arrange(ids, counts)
                found = runs_of_texts(codes if places is None else codes[places], counts)
                first = np.cumsum(counts) - counts
                collapsed = []
                for k, (text, runs) in enumerate(zip(texts, found, strict=True)):
                    words = text.split()
                    if len(runs) or places is not None:
                        own = np.arange(len(words)) if places is None else places[first[k] : first[k] + counts[k]] - first[k]
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
                        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
                        words = [words[i] for i in own[np.cumsum(edge[:-1]) == 0].tolist()]
                    collapsed.append(b" ".join(words))
                rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                edges = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(edges), structs, type=kind), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return whole_texts(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def repeated_tails(ids: list, counts: np.ndarray) -> np.ndarray:
    """Places of words: where crc32 of the id as text leaves 0 modulo 10, words repeat from some word on with some period, both by that number; a null id changes nothing."""
    places = np.arange(int(counts.sum()))
    for i, n, first in zip(ids, counts.tolist(), (np.cumsum(counts) - counts).tolist(), strict=True):
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            places[first + a : first + n] = first + a + np.arange(n - a) % p
    return places


def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs(documents(spark, sf_dir), arrange=repeated_tails)
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), better)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), digest(listed).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES = {
    "op12_periodic_runs": r"""
        WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             h AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, xor(CAST(4294967295 AS BIGINT), list_reduce(
                       list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(s) + 1), lambda i: list_concat([CAST(ascii(substr(s, i, 1)) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
                       lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS h FROM d),
             p AS (SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS changed, CASE WHEN n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM h),
             q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM p),
             m AS (SELECT doc_id, n, CASE WHEN changed THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM q),
             t AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM m),
             e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
             s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
             c AS (SELECT doc_id, q, min(i) AS b, count(*) + q AS len FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
             r AS (SELECT doc_id, b, len, min(q) AS q FROM c GROUP BY ALL),
             lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(b || ',' || len || ',' || q || chr(10), '' ORDER BY b, q) AS lines,
                              first(b ORDER BY len / q DESC, b, q) AS b, first(len ORDER BY len / q DESC, b, q) AS len, first(q ORDER BY len / q DESC, b, q) AS q FROM r GROUP BY doc_id),
             gone AS (SELECT DISTINCT doc_id, unnest(range(b + q, b + len)) AS i FROM r),
             kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN gone ON gone.doc_id = t.doc_id AND gone.i = t.i GROUP BY t.doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
