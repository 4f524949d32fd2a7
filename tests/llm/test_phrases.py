import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.llm import collocations as C


def brute(rows, least=10, top=2000, cover=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in found.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    most[part] = max(most[part], a)
        scored = []
        for p, a in found.items():
            if len(p) == 2 and most[p] and 100 * most[p] >= cover * a:
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def some_texts(seed, n=120):
    rng = random.Random(seed)
    words = ["red", "Green", "blue", "éa", "x\x00y", "q\x1cr", "the", "of", "zoo", "日本"]
    gap = lambda: rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r", "\x0b", "!"])
    text = lambda: "".join(rng.choice(words) + gap() for _ in range(rng.randint(0, 60)))
    return [(rng.choice(["en", "de", None, "fr"]), rng.choice([text(), text(), None, "", " .. ", "rare" + str(rng.random())])) for _ in range(n)]


@pytest.mark.parametrize("shard, cover", [(1 << 22, 50), (500, 50), (90, 20)])
def test_collocations(spark, shard, cover):
    rows = some_texts(3) + [("en", "new york city " * 40), ("en", "new york " * 15), ("en", "a b. " * 300)]
    df = spark.createDataFrame([(lang, t, "x", 1) for lang, t in rows], "lang string, text string, phrase string, pair int").repartition(3)
    assert sorted(map(tuple, C.collocations(df, shard_bytes=shard, cover=cover).collect())) == brute(rows, cover=cover)


def test_first_of_each_language_and_nothing(spark):
    rows = some_texts(4, 300)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, C.collocations(df, top=5).collect())) == brute(rows, top=5)
    assert C.collocations(df.where("false")).count() == 0


def test_products_past_64_bits(spark):
    big = 3 * 10**12
    df = spark.sql(f"SELECT {big}L AS a, {big + 7}L AS l, {big + 10**6}L AS r")
    assert df.select(C.exact_score(df.a, df.l, df.r).alias("s")).first().s == 10**6 * big * big // ((big + 7) * (big + 10**6))


@pytest.mark.parametrize("wide", [False, True])
def test_intervals_hold_counts_of_phrases(wide):
    rng = random.Random(1)
    for _ in range(30):
        sigma = rng.choice([2, 4, 9])
        seq = np.array([0, *(rng.randrange(sigma) for _ in range(rng.randint(0, 80))), 0], np.int64)
        scale = (1 << 22) if wide else 1  # symbols too wide for one key
        index = C.BidirectionalIndex(seq * scale, sigma * scale)
        symbol, low, other, size = index.words()
        symbol, low, other, size = (x[size > 0] for x in (symbol, low, other, size))
        count = lambda *p: sum(tuple(seq[i : i + len(p)] * scale) == p for i in range(len(seq)))
        assert all(n == count(s) for s, n in zip(symbol, size, strict=True))
        of, first, low, other, size = index.extend(low, other, size)
        pairs = dict(zip(zip(first.tolist(), symbol[of].tolist(), strict=True), size.tolist(), strict=True))
        assert pairs == {p: c for p in itertools.product(range(scale, sigma * scale, scale), repeat=2) if (c := count(*p))}
        of3, third, _, _, size = index.extend(other, low, size, right=True)
        triples = {(int(first[k]), int(symbol[of[k]]), int(c)): int(n) for k, c, n in zip(of3, third, size, strict=True)}
        assert triples == {p: c for p in itertools.product(range(scale, sigma * scale, scale), repeat=3) if (c := count(*p))}


def test_filter_never_loses_a_pair(spark):
    pairs = [(i * 7919 << 32) | i for i in range(5000)]
    bloom = C.pair_filter(spark.createDataFrame([(p,) for p in pairs], "pair long").repartition(3), bits=16)
    assert C.may_hold(bloom, np.array(pairs), bits=16).all()
    assert C.may_hold(bloom, np.arange(10**6, 10**6 + 1000) << 33, bits=16).mean() < 0.9


def test_long_texts_are_cut_at_breaks():
    text = b"one two. three four " * 50
    assert b"".join(C.cut(text, 100)) == text and all(p[:1] == b"." for p in list(C.cut(text, 100))[1:])
    assert list(C.cut(b"a b " * 100, 50)) == [b"a b " * 100]
