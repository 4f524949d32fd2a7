"""SimHash near-dedup by covering locality-sensitive hashing."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, map_bytes, slices, stored, whole_texts
from loomgraph.operators.components import connected_components

BITS, RADIUS, SEED = 64, 2, 42
LONG = 1 << 20  # bytes of a text whose words are read one by one
#: Distinct fingerprints that a table's bucket may hold to be joined with itself; larger ones go by midpoints.
BUCKET = 256


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2**(radius + 1) - 1 bit masks so that any ``radius`` bit positions are all left out by some mask.

    Position i gets a non-zero vector of radius + 1 bits; mask v keeps the positions whose vector has
    an odd inner product with v. Any radius vectors have a common non-zero v to which all are even.
    """
    n = radius + 1
    vectors = [1 + i % (2**n - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, 2**n)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(hashes: Sequence[int] | np.ndarray) -> int:
    """Bits that are set in over half of the hashes. Lanes of eight counters in a word add up to 255 hashes at once."""
    h = np.asarray(hashes, np.uint64)
    starts = np.arange(0, len(h), 255)
    ones = np.zeros(BITS, np.int64)
    lanes = np.uint64(0x0101010101010101)
    for j in range(8):
        sums = np.add.reduceat((h >> np.uint64(j)) & lanes, starts)
        ones[j::8] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def grams_of(text: bytes, words: int) -> Iterator[bytes]:
    """The shingles of a long text one after the other, without a list of its words."""
    held: deque[bytes] = deque(maxlen=words)
    count = 0
    for m in re.finditer(rb"[^ \t-\r]+", text):
        held.append(m.group().lower())
        count += 1
        if count >= words:
            yield b" ".join(held)
    if 0 < count < words:
        yield b" ".join(held)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The hash of each shingle, repeats included; none of a text without words."""
    from itertools import islice, repeat

    import xxhash

    if len(text) > LONG:
        return np.fromiter(map(xxhash.xxh64_intdigest, grams_of(text, words), repeat(SEED)), np.uint64)
    w = text.lower().split()  # of bytes: A-Z only, and blanks are space and 09 to 0d
    if not w:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(islice(w, k, None) for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(shingles(text, words))


def fingerprint(text: bytes, words: int) -> int:
    h = shingles(text, words)
    return simhash(h) if len(h) else 0


def fingerprints(texts: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long."""

    def make():
        return lambda ids, t: [ids, [signed(fingerprint(x, words)) for x in t]]

    return map_bytes(texts, make, "doc_id long, fp long", [pa.int64(), pa.int64()])


def near(a: str, b: str, radius: int = RADIUS) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(src, dst) of nodes whose fingerprints differ in at most two bits; ``prints`` holds distinct (fp, node).

    Every such pair shares a bucket of some masked table. Buckets of up to ``bucket`` fingerprints are
    joined with themselves, and a pair is given by the first table in which it meets. Fingerprints that
    fall in a larger bucket are linked exactly through midpoints: two of them are within two bits if and
    only if both are within one bit of some common value, of which each has 65, so a value has at most
    65 fingerprints and no large group is ever paired.
    """
    masks = [signed(m) for m in covering_masks()]
    tables = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)))
    keyed = prints.select("fp", "node", F.explode(tables).alias("t")).select("fp", "node", "t.k", "t.key")
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, ["k", "key"]), "buckets")
    small = shared.where(F.col("n") <= bucket)
    left = small.select("k", "key", F.col("fp").alias("fa"), F.col("node").alias("src"))
    right = small.select("k", "key", F.col("fp").alias("fb"), F.col("node").alias("dst"))
    differ = F.col("fa").bitwiseXOR(F.col("fb"))
    met = F.lit(True)
    for k, m in enumerate(masks[:-1]):
        met = met & ((F.col("k") <= k) | (differ.bitwiseAND(F.lit(m)) != 0))
    pairs = left.join(right, ["k", "key"]).where((F.col("fa") < F.col("fb")) & near("fa", "fb") & met).select("src", "dst")
    crowded = shared.where(F.col("n") > bucket).select("fp", "node").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << i)) for i in range(BITS)))
    middles = crowded.select("node", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("middle"))
    met_at = middles.groupBy("middle").agg(F.sort_array(F.collect_list("node")).alias("nodes")).where(F.size("nodes") > 1)
    stars = met_at.select(F.col("nodes")[0].alias("src"), F.explode(F.slice("nodes", 2, BITS + 1)).alias("dst"))
    return pairs.unionByName(stars)


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: documents whose fingerprints are linked, directly or through others.

    Equal fingerprints are always linked. A null or blank text has fingerprint zero, a text of fewer
    words than a shingle one shingle. Rows that repeat an id repeat its result; a null id has no say in
    the smallest id. An empty table gives an empty one.
    """
    prints = stored(fingerprints(whole_texts(df, id_col, text_col), words), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    found = connected_components(links(distinct.where("node is not null"), bucket))
    labelled = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(labelled, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Documents in a block of those that share a prefix's shingle; copies of a shingle in a slice of texts that count as common, and shingles of the order's list.
BLOCK, COMMON, MOST_COMMON = 512, 4, 1 << 17
#: Keys of a document by least hashes, and hashes in each; documents of different components that may share a prefix's shingle before hubs are looked for in rounds.
BANDS, ROWS, CROWD = 8, 8, 64
PAYS = 0.8  # another round follows one after which at most this share of the components in crowds is left; pairs of the others are all compared


def sketch(h: np.ndarray) -> bytes:
    """A set's size, and how many of its hashes fall in each of 16 to 2048 equal ranges (2 to 4 hashes in each, or more): what tells most unlike sets apart."""
    bits = min(11, max(4, int(np.ceil(np.log2(max(1, len(h)) / 4)))))
    counts = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.uint32(len(h)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()


def may_be_alike(a: bytes, b: bytes, similarity: float) -> bool:
    """False only of sets below the similarity: their counts differ by no more than the sets do."""
    sizes = int.from_bytes(a[:4], "little") + int.from_bytes(b[:4], "little")
    x, y = (np.frombuffer(s, np.uint8, offset=4).astype(np.int64) for s in (a, b))
    n = min(len(x), len(y))
    x, y = (np.minimum(v.reshape(n, -1).sum(1), 255) for v in (x, y))
    return int(np.abs(x - y).sum()) <= (1 - similarity) / (1 + similarity) * sizes + 1e-9


def band_keys(h: np.ndarray, seed: int) -> np.ndarray:
    """``BANDS`` keys of a set of hashes, each of the least of them under ``ROWS`` multiplications; two sets share a key with the power ROWS of their similarity. None of an empty set."""
    odd = np.random.default_rng(seed).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(h), 4096):
        least = np.minimum(least, (h[k : k + 4096, None] * odd[0]).min(axis=0))
    keys = ((least ^ (least >> np.uint64(29))) * odd[1]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)[: BANDS if len(h) else 0]


def marks(texts: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, n, sketch, bands): each text's fingerprint, sketch and band keys, with n = 0; and without an id, n texts of a slice that share a shingle, the key."""

    def make():
        def rows(ids, t):
            lists = [shingles(x, words) for x in t]
            sets = [np.unique(h) for h in lists]
            prints = [simhash(h) if len(h) else 0 for h in lists]
            common, n = np.unique(np.concatenate(sets), return_counts=True)
            common, n = common[n >= COMMON], n[n >= COMMON]
            keys = np.concatenate([np.array(prints, np.uint64), common]).view(np.int64)
            none = [None] * len(common)
            return [ids + none, keys, np.concatenate([np.zeros(len(prints), np.int64), n]), [*map(sketch, sets), *none], [*(band_keys(x, 0) for x in sets), *none]]

        return rows

    return map_bytes(texts, make, "doc_id long, key long, n long, sketch binary, bands array<long>", [*[pa.int64()] * 3, pa.binary(), pa.list_(pa.int64())])


def text_bands(texts: DataFrame, words: int, seed: int) -> DataFrame:
    """(doc_id, bands) with other multiplications."""
    return map_bytes(texts, lambda: lambda ids, t: [ids, [band_keys(shingle_hashes(x, words), seed) for x in t]], "doc_id long, bands array<long>", [pa.int64(), pa.list_(pa.int64())])


def hub_links(banded: DataFrame) -> DataFrame:
    """(src, dst) of each document of (doc_id, bands, component) and one of another component for each of its keys, the hub: of those that share the key, the one that a hash of both picks."""
    keyed = banded.select("doc_id", "component", F.posexplode("bands").alias("band", "key"))
    hub = F.min(F.struct(F.xxhash64("doc_id", "key").alias("h"), F.col("doc_id").alias("b"), F.col("component").alias("cb")))
    hubs = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), hub.alias("hub")).where("n > 1").select("band", "key", "hub.b", "hub.cb")
    return keyed.join(hubs, ["band", "key"]).where("component <> cb").select(*ordered("doc_id", "b")).distinct()


def most_common(counted: DataFrame, most: int = MOST_COMMON) -> np.ndarray:
    """Up to ``most`` of the most frequent keys of (key, n), in order: all from some frequency on, found by counting keys by frequency.

    They only put the shingles of all sets in one order, in which any list gives the same pairs in the end.
    """
    n = stored(counted.groupBy("key").agg(F.floor(16 * F.log2(F.sum("n"))).alias("band")), "common")
    least, held = None, 0
    for row in sorted(n.groupBy("band").count().collect(), reverse=True):
        held += row["count"]
        if held > most:
            break
        least = row["band"]
    keys = [] if least is None else n.where(F.col("band") >= least).select("key").toPandas()["key"]
    return np.sort(np.array(keys, np.int64).view(np.uint64))


def prefixes(texts: DataFrame, words: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(key, doc_id, size, rest, often): the shingles of each text's prefix, how many its set has, how many of them are left from this one on, and whether it is of ``common``.

    All sets are put in one order, by hash with ``common`` shingles last. Two sets with a similarity of
    at least ``similarity`` share so many shingles that they share one among the first of either, even if
    all others of those differ. Any order gives every such pair; with common shingles last few others meet.
    """

    def make():
        def rows(ids, t):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, x in zip(ids, t, strict=True):
                h = shingle_hashes(x, words)
                if not len(h):
                    continue
                at = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
                last = common[at] == h if len(common) else np.zeros(len(h), bool)
                n = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
                first = np.concatenate([h[~last], h[last]])[:n]
                often = np.arange(len(first)) >= len(h) - last.sum()
                for column, values in zip(out, (first.view(np.int64), np.full(len(first), i), np.full(len(first), len(h)), len(h) - np.arange(len(first)), often), strict=True):
                    column.append(values)
            return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out[:4]] + [np.concatenate(out[4]) if out[4] else np.zeros(0, bool)]

        return rows

    return map_bytes(texts, make, "key long, doc_id long, size int, rest int, often boolean", [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()])


def enough(similarity: float) -> Column:
    """Whether documents a and b that first share a shingle with ra and rb left of sa and sb may have the similarity: what is left must hold all they share, and what comes before is not shared."""
    both = F.col("sa") + F.col("sb")
    return (F.least("ra", "rb") >= F.lit(similarity / (1 + similarity)) * both - 1e-9) & (both - F.col("ra") - F.col("rb") <= F.lit((1 - similarity) / (1 + similarity)) * both + 1e-9)


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def star_links(shared: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) of each document and one of about its size that shares a shingle of its prefix: the one with the fewest shingles before it.

    Among edited copies of a text that is the text itself or the least edited copy: rare shingles, which
    edits make, come first. All copies that are alike to it are joined by it.
    """
    band = F.floor(F.log("size") / np.log(1 / similarity))
    rows = shared.select("key", band.alias("band"), F.col("doc_id").alias("a"), F.col("size").alias("sa"), F.col("rest").alias("ra"))
    first = F.struct((F.col("sa") - F.col("ra")).alias("p"), F.xxhash64("a").alias("h"), F.col("a").alias("b"), F.col("sa").alias("sb"), F.col("ra").alias("rb"))
    one = rows.groupBy("key", "band").agg(F.count("*").alias("n"), F.min(first).alias("one"))
    met = rows.join(one.where("n > 1").select("key", "band", "one.b", "one.sb", "one.rb"), ["key", "band"])
    return met.where((F.col("a") != F.col("b")) & enough(similarity)).select(*ordered("a", "b")).distinct()


def shared_prefixes(keyed: DataFrame) -> DataFrame:
    """(key, doc_id, size, rest): the rows of ``prefixes`` whose shingle stands in another document's prefix too; common ones all stay.

    Most shingles stand in one text only, so all rows are shuffled once, and read in order: a row stays if
    the one before or after has its key. Common shingles need no neighbour, and are spread over tasks.
    """

    def run(batches):
        held = None  # the last row so far, if it has not been given out
        before = None  # the last row's key
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            key = table.column("key").to_numpy()
            same = key[1:] == key[:-1]
            stay = np.concatenate([[key[0] == before and held is None], same]) | np.concatenate([same, [False]]) | table.column("often").to_numpy()
            before = key[-1]
            held = None if stay[-1] else batch.slice(batch.num_rows - 1)
            yield from table.select(["key", "doc_id", "size", "rest"]).filter(pa.array(stay)).to_batches()

    salt = F.when(F.col("often"), F.pmod(F.xxhash64("doc_id"), F.lit(1024))).otherwise(F.lit(0))
    return keyed.repartition("key", salt).sortWithinPartitions("key").mapInArrow(run, "key long, doc_id long, size int, rest int")


def plausible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The (src, dst) that their sketches don't rule out."""

    def run(batches):
        for batch in batches:
            keep = [may_be_alike(a, b, similarity) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    left = sketches.select(F.col("doc_id").alias("src"), F.col("sketch").alias("a"))
    right = sketches.select(F.col("doc_id").alias("dst"), F.col("sketch").alias("b"))
    return pairs.join(left, "src").join(right, "dst").select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def still_apart(shared: DataFrame, components: DataFrame) -> DataFrame:
    """(key, doc_id, size, rest, component, n): the rows of ``shared_prefixes`` whose shingle stands in prefixes of n documents of different components."""
    labels = components.select(F.col("node").alias("doc_id"), "component")
    named = shared.select("key", "doc_id", "size", "rest").join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    named = stored(named, "named")
    groups = named.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return stored(named.join(groups.select("key", "n"), "key"), "apart")


def prefix_links(apart: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(src, dst) of all documents of different components that may have the similarity; ``apart`` is from ``still_apart``.

    A pair's first common shingle leaves each at most ``rest`` shared shingles, which must be enough.
    Documents that share a shingle are dealt to blocks, and each pair of blocks is compared by itself, so
    a shingle of very many documents is spread over tasks.
    """
    dealt = apart.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    left = dealt.select("key", F.col("own").alias("x"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("y"), F.col("doc_id").alias("a"), F.col("component").alias("ca"), F.col("size").alias("sa"), F.col("rest").alias("ra"))
    right = dealt.select("key", F.explode(F.sequence(F.lit(0), "own")).alias("x"), F.col("own").alias("y"), F.col("doc_id").alias("b"), F.col("component").alias("cb"), F.col("size").alias("sb"), F.col("rest").alias("rb"))
    met = left.join(right, ["key", "x", "y"]).where((F.col("ca") != F.col("cb")) & enough(similarity) & ((F.col("x") < F.col("y")) | (F.col("a") < F.col("b"))))
    return met.select(*ordered("a", "b")).distinct()


def verified(texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The (src, dst) whose shingle sets have a Jaccard similarity of at least ``similarity``; two texts without words have 1.

    Only texts of some pair are moved; they are smaller than their sets, which are made where a pair meets.
    """
    named = stored(pairs.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct(), "named")
    held = texts.join(named, "doc_id", "left_semi").select("doc_id", F.col("text").cast("binary").alias("t"))
    held = stored(held.dropDuplicates(["doc_id"]), "texts")

    def alike(batches):
        of: dict[str, tuple[int | None, np.ndarray]] = dict.fromkeys("ab", (None, np.zeros(0, np.uint64)))
        for batch in batches:
            for part in slices(batch, "b"):
                keep = []
                for row in part.to_pylist():
                    for side, name in (("a", "src"), ("b", "dst")):
                        if of[side][0] != row[name]:
                            of[side] = (row[name], shingle_hashes(row[side], words))
                    x, y = of["a"][1], of["b"][1]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= similarity * max(1, len(x) + len(y) - both) - 1e-9 or not (len(x) or len(y)))
                yield part.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    left = held.select(F.col("doc_id").alias("src"), F.col("t").alias("a"))
    right = held.select(F.col("doc_id").alias("dst"), F.col("t").alias("b"))
    return pairs.join(left, "src").join(right, "dst").select("src", "dst", "a", "b").mapInArrow(alike, "src long, dst long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, component_id) for each row: documents joined by pairs whose shingles have a Jaccard similarity of ``similarity`` or more.

    Exact at every size of text and group, in three steps. First candidates are the documents that meet in
    the covering tables by their whole fingerprints, and, as two bits of 64 are far stricter than a
    similarity of 0.8 (at which fingerprints differ in six to thirteen), each document with one of about its
    size that shares a shingle of its prefix, and with one for each of its band keys. These join most copies, so that a
    crowd of copies costs some comparisons for each. Where more than ``CROWD`` documents of different components still share a prefix's shingle, band
    keys are made anew and each document meets their hubs, in rounds that end when one joins less than a fifth of the components there. Then every pair of different
    components that shares a shingle of its prefixes is a candidate, which none of the similarity can miss. Every candidate is compared exactly, first by
    sketches, which rule out most of those that are unlike, then as a whole. Nulls, blanks, repeated and missing ids are as in ``simhash_components``.
    """
    texts = whole_texts(df, id_col, text_col).where("doc_id is not null")
    marked = stored(marks(texts, words), "marks")
    prints = marked.where("n = 0").select("doc_id", F.col("key").alias("fp"))
    sketches = marked.where("n = 0").groupBy("doc_id").agg(F.first("sketch").alias("sketch"))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    equal = prints.join(distinct, "fp").where("doc_id <> node").select(F.col("node").alias("src"), F.col("doc_id").alias("dst"))
    whole = links(distinct, bucket).select(*ordered("src", "dst"))
    hubs = hub_links(marked.where("n = 0").select("doc_id", "bands", F.col("doc_id").alias("component")))
    shared = stored(shared_prefixes(prefixes(texts, words, similarity, most_common(marked.where("n > 0")))), "shared")
    pairs = equal.unionByName(whole).unionByName(star_links(shared, similarity)).unionByName(hubs).distinct()
    joined = connected_components(verified(texts, stored(plausible(pairs, sketches, similarity), "candidates"), words, similarity))
    grown = lambda found: connected_components(found.unionByName(joined.select(F.col("component").alias("src"), F.col("node").alias("dst"))))
    apart, seed, before = still_apart(shared, joined), 0, 0
    while True:
        crowded, seed = stored(apart.where(F.col("n") > CROWD).select("doc_id", "component").distinct(), "crowded"), seed + 1
        left = crowded.agg(F.count_distinct("component")).first()[0]
        if not left or before and left > PAYS * before:
            break
        before = left
        own = texts.join(crowded.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        banded = text_bands(own, words, seed).join(crowded, "doc_id").select("doc_id", "bands", "component")
        joined = grown(verified(texts, stored(plausible(hub_links(banded), sketches, similarity), "candidates"), words, similarity))
        apart = still_apart(apart, joined)
    more = verified(texts, stored(plausible(prefix_links(apart, similarity), sketches, similarity), "candidates"), words, similarity)
    last = grown(more)
    return prints.select("doc_id").join(last, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def op9_simhash(spark, sf_dir):
    return simhash_components(documents(spark, sf_dir))


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
