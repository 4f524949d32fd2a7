import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from loomgraph.llm import runs as R


def brute(seq):
    found = {}
    for q in range(1, len(seq) // 4 + 1):
        i = 0
        while i < len(seq) - q:
            j = i
            while j < len(seq) - q and seq[j] == seq[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((b, n, q) for (b, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng):
    out = []
    for _ in range(rng.randint(0, 4)):
        letters = rng.choice([1, 2, 2, 3, 5, 30])
        unit = [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.4:
            unit = unit * rng.randint(1, 5) + [rng.randrange(letters)]
        out += (unit * rng.randint(1, 9))[: rng.randint(1, 120)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = [periodic(rng) for _ in range(rng.randint(0, 5))]
        codes, counts = np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts], np.int64)
        assert [list(map(tuple, r.tolist())) for r in R.runs_of_texts(codes, counts)] == list(map(brute, texts))


def test_range_successors():
    rng = np.random.default_rng(3)
    values = rng.permutation(200)
    m = R.WaveletMatrix(values, 8)
    low = rng.integers(0, 200, 500)
    high, x = np.minimum(200, low + rng.integers(0, 60, 500)), rng.integers(0, 201, 500)
    want = [min((v for v in values[a:b] if v >= k), default=256) for a, b, k in zip(low, high, x, strict=True)]
    assert m.successor(low, high, x).tolist() == want


def expected(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if i is None else zlib.crc32(str(i).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = brute(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {k for b, n, q in found for k in range(b + q, b + n)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{b},{n},{q}\n" for b, n, q in found)), digest(kept))


def test_query_on_texts(spark, tmp_path, rows):
    rng = random.Random(9)
    extra = [(1000 + k, " ".join(map(str, periodic(rng)))) for k in range(200)]
    some = [*rows, *extra, (1000, extra[0][1]), (None, "a b " * 20), (-30, "x " * 9 + "y " * 7)]
    spark.createDataFrame([(i, t, 1, "x") for i, t in some], "doc_id long, text string, n_words int, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = R.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(expected(i, t)) for i, t in some)


def test_spans_and_texts(spark):
    df = spark.createDataFrame([(1, "go a b a b a b a b a b end"), (2, None)], "doc_id long, text string")
    one, two = sorted(R.periodic_runs(df).collect())
    assert [tuple(r) for r in one.runs] == [(1, 10, 2)] and one.collapsed == "go a b end" and one.n_words == 12
    assert (two.n_words, two.runs, two.collapsed) == (0, [], "")
    assert R.periodic_runs(df.where("false")).count() == 0
