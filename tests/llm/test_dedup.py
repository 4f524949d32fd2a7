import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from loomgraph.llm import exact, simhash


def groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[(t or "").translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r")))].append((-len(t or ""), i))
    return {i: (min(m)[1], len(m), hashlib.sha256(k.encode()).hexdigest()) for k, m in by.items() for _, i in m}


@pytest.mark.parametrize("piece, compare", [(1 << 20, 1 << 16), (100, 30)])
def test_exact(docs, rows, nothing, piece, compare):
    want = groups(rows)
    found = exact.exact_groups(docs, piece_chars=piece, compare_chars=compare).collect()
    assert len(found) == len(rows)
    assert all((r.keep_id, r.group_size, r.text_sha256) == want[r.doc_id] and r.kept == (r.doc_id == r.keep_id) for r in found)
    assert exact.exact_groups(nothing).count() == 0


def test_equal_fingerprints_of_different_texts_are_told_apart(docs, rows, monkeypatch):
    monkeypatch.setattr(exact, "text_fingerprints", lambda texts, chars: texts.selectExpr("monotonically_increasing_id() as row_id", "doc_id", "cast(length(text) as long) as n_chars", "sha2(cast(translate(text, ' \t\n\u000b\f\r', '') as binary), 256) as text_sha256", "0L as n_norm", "'same' as fp"))
    want = groups(rows)
    found = exact.exact_groups(docs).collect()
    assert all((r.keep_id, r.group_size) == want[r.doc_id][:2] for r in found) and len(found) == len(rows)


def test_repeated_rows(spark, monkeypatch):
    some = [(5, "a b")] * 700 + [(5, "a  b")] * 2 + [(5, "other")] * 3 + [(None, "ab")] * 2 + [(None, "alone")] * 2 + [(4, "a b"), (7, None), (7, "")]
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)

    def check():
        found = exact.exact_groups(df).collect()
        kept = sorted((r.keep_id is None, r.doc_id or 0, r.group_size) for r in found if r.kept)
        assert len(found) == len(some) and kept == [(False, 5, 3), (False, 5, 705), (False, 7, 2), (True, 0, 2)]

    check()
    real = exact.text_fingerprints
    monkeypatch.setattr(exact, "text_fingerprints", lambda texts, chars: real(texts, chars).selectExpr("row_id", "doc_id", "n_chars", "text_sha256", "0L as n_norm", "'same' as fp"))
    check()


def test_fingerprints_compose():
    powers, rng = exact.chunk_powers(), random.Random(2)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        data = bytes(rng.randrange(256) for _ in range(n))
        whole = exact.fingerprints([data], powers)[0]
        expected = tuple(sum((b + 1) * pow(base, n - 1 - k, p) for k, b in enumerate(data)) % p for p, base in zip(exact.PRIMES, exact.BASES, strict=True))
        assert whole == expected
        cut = n // 3
        a, b = exact.fingerprints([data[:cut], data[cut:]], powers)
        assert exact.combine(a, b, n - cut) == whole


def print_of(text, words=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints):
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("bucket", [256, 1])
def test_simhash(docs, rows, nothing, bucket):
    prints = {i: print_of(t) for i, t in rows}
    want = linked(prints)
    found = simhash.simhash_components(docs, bucket=bucket).collect()
    assert len(found) == len(rows)
    assert all((r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id]) for r in found)
    assert simhash.simhash_components(nothing).count() == 0


@pytest.mark.parametrize("bucket", [256, 3])
def test_links_of_dense_fingerprints(spark, bucket):
    rng = random.Random(9)
    values = {0, (1 << 64) - 1}
    while len(values) < 250:
        v = rng.choice(sorted(values))
        for _ in range(rng.randint(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    prints = dict(enumerate(sorted(values)))
    df = spark.createDataFrame([(simhash.signed(v), i) for i, v in prints.items()], "fp long, node long")
    from loomgraph.operators.components import connected_components

    found = {r.node: r.component for r in connected_components(simhash.links(df, bucket)).collect()}
    assert {i: found.get(i, i) for i in prints} == linked(prints)


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for a in range(64):
        for b in range(a, 64):
            assert any(not (m >> a & 1) and not (m >> b & 1) for m in masks)
    assert min(bin(m).count("1") for m in masks) >= 36


def test_near_duplicates(spark, docs, rows, nothing):
    sets = {i: set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in rows}
    parent = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if a < b and (len(x & y) >= 0.8 * len(x | y) if x | y else True):
                low, high = sorted((parent[a], parent[b]))
                parent = {k: low if v == high else v for k, v in parent.items()}
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert found == parent
    assert simhash.near_duplicates(nothing).count() == 0


def brute_force(rows, words=5):
    """Each id's component by comparing all pairs of shingle sets."""
    sets = {i: set(simhash.shingle_hashes(t.encode(), words).tolist()) for i, t in rows}
    parent, ids = {i: i for i in sets}, sorted(sets)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_crowd_of_variants_is_compared_whole(spark, monkeypatch):
    """Pages of one template in pairs: each is unlike the representatives of the strata that it shares, but alike to its twin."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    template, out = [word() for _ in range(100)], []
    for _ in range(200):
        page = template + [word() for _ in range(26)]
        out += [" ".join(page), " ".join(template + [word() for _ in range(8)] + page[108:])]
    rng.shuffle(out)
    rows = list(enumerate(out))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_force(rows)
    assert len(set(want.values())) == 200
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want
    monkeypatch.setattr(simhash, "star_links", lambda shared, similarity: shared.selectExpr("doc_id as src", "doc_id as dst").limit(0))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want


def test_crowd_of_edited_copies(spark):
    """Copies of one text with ever more edits: most are unlike each other, and alike to those with few."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(10**9)}"
    text, rows = [word() for _ in range(150)], []
    for k in range(120):
        copy = list(text)
        for _ in range(k // 8):
            copy[rng.randrange(150)] = word()
        rows.append((k * 7 % 120, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_force(rows)
    assert 2 < len(set(want.values())) < 100
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want


@pytest.mark.parametrize("n, exact_check", [(400, True), (4000, False)])
def test_crowd_of_edits_without_their_base(spark, monkeypatch, n, exact_check):
    """One-word edits of a text that isn't there: only those at about the same place are alike, which joins all of them in the end."""
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(10**9)}"
    base, rows = [word() for _ in range(60)], []
    for k in range(n):
        copy = list(base)
        copy[rng.randrange(60)] = word()
        rows.append((k, " ".join(copy)))
    compared, real = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda texts, pairs, *a: compared.append(pairs.count()) or real(texts, pairs, *a))
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found == (brute_force(rows) if exact_check else dict.fromkeys(range(n), 0))
    assert sum(compared) < 20 * n


def test_band_keys():
    h = np.random.default_rng(2).integers(0, 2**64, 9000, dtype=np.uint64)
    assert (simhash.band_keys(h, 1) == simhash.band_keys(h[::-1], 1)).all() and len(simhash.band_keys(h, 1)) == simhash.BANDS
    assert not (simhash.band_keys(h, 1) == simhash.band_keys(h, 2)).any() and len(simhash.band_keys(h[:0], 1)) == 0
    near = [(simhash.band_keys(x, 3) == simhash.band_keys(np.append(x[:96], h[-4:]), 3)).sum() for x in h[:8900].reshape(-1, 100)]
    assert 0.4 < np.mean(near) / simhash.BANDS < 0.65  # at a similarity of 0.92


@pytest.mark.parametrize("count, at", [(5, None), (13, 12), (25, 24)])
def test_short_near_copies_are_all_found(spark, count, at):
    """Pairs of texts of ``count`` words, one word replaced: J is 0.8 at 13 words; the shortest are copies in other letters."""
    rng, out = random.Random(5), []
    word = lambda: f"w{rng.randrange(10**9)}"
    for _ in range(100):
        text = [word() for _ in range(count)]
        out += [" ".join(text), " ".join(text).upper() if at is None else " ".join([*text[:at], word(), *text[at + 1 :]])]
    rows = list(enumerate(out))
    want = brute_force(rows)
    assert len(set(want.values())) == 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want


def test_long_texts_are_read_word_by_word(rows, monkeypatch):
    texts = [(t or "").encode() for _, t in rows] + [b"\x1c a\x0bb \xc2\xa0 c", b"A b"]
    plain = [simhash.shingles(t, 3).tolist() for t in texts]
    monkeypatch.setattr(simhash, "LONG", -1)
    assert [simhash.shingles(t, 3).tolist() for t in texts] == plain


def test_sketches_rule_out_no_pair():
    rng = np.random.default_rng(4)
    unlike = 0
    for k in range(400):
        n = int(rng.integers(1, 3000 if k % 2 else 60))
        a = rng.integers(0, 2**64, n, dtype=np.uint64) >> np.uint64(0 if k % 5 else 57)  # some all in one range
        b = np.unique(np.concatenate([a[int(n * rng.random() * 0.3) :], rng.integers(0, 2**64, int(n * rng.random() * 0.3), dtype=np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        alike = both >= 0.8 * (len(a) + len(b) - both)
        unlike += not simhash.may_be_alike(simhash.sketch(a), simhash.sketch(b), 0.8)
        assert simhash.may_be_alike(simhash.sketch(a), simhash.sketch(b), 0.8) or not alike
    assert unlike > 50


def test_shared_prefixes_across_batches(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(400), i, 9, 9, False) for i in range(600)] + [(1000 + i, i, 9, 9, i % 2 == 0) for i in range(6)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = simhash.shared_prefixes(spark.createDataFrame(rows, "key long, doc_id long, size int, rest int, often boolean")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    keys = [r[0] for r in rows]
    assert sorted((r.key, r.doc_id) for r in found) == sorted((k, i) for k, i, _, _, often in rows if often or keys.count(k) > 1)


def test_blocks_of_a_shared_shingle_meet_in_every_pair(spark):
    keyed = spark.createDataFrame([(5, i, 10, 10) for i in range(40)] + [(6, 1, 10, 3), (6, 2, 10, 3)], "key long, doc_id long, size int, rest int")
    joined = spark.createDataFrame([(i, i % 4) for i in range(12)], "node long, component long")
    found = [(r.src, r.dst) for r in simhash.prefix_links(simhash.still_apart(keyed, joined), 0.8, block=7).collect()]
    label = {i: i % 4 if i < 12 else i for i in range(40)}
    assert sorted(found) == [(a, b) for a in range(40) for b in range(a + 1, 40) if label[a] != label[b]]


def test_simhash_lanes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 254, 255, 256, 1000):
        h = rng.integers(0, 2**64, n, dtype=np.uint64).tolist()
        assert simhash.simhash(h) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)
