import random
import re

from loomgraph.llm import licenses as L


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for t in L.TEMPLATES:
        for s in range(-len(t.words), len(w)):
            same = [0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(t.words)]
            if all(same[j] for j in t.mandatory) and 100 * sum(same) >= L.COVERED * len(same):
                places.append((t.label, t.base, s, len(same), sum(same)))
    return len(w), sorted(places, key=lambda p: (p[2], p[0], p[3]))


def some_texts():
    rng = random.Random(2)
    filler = ["the", "of", "license", "public", "version", "mit", "by", "cc", "all", "rights", "über", "x9", "general", "2", "0"]
    noise = lambda n: [rng.choice(filler) for _ in range(rng.randint(0, n))]
    out = [None, "", " \n", "All rights reserved.", "ALL RIGHTS RESERVED, all-rights/reserved", "all rights", "CC BY-NC 4.0", "cc\x00by", "general public license", "cc by " * 2000]
    for _ in range(150):
        words = noise(30)
        for _ in range(rng.randint(0, 3)):
            passage = list(rng.choice(L.TEMPLATES).words)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(passage))
                passage[k : k + rng.choice([0, 1, 1])] = [rng.choice(filler)]
            words += passage[rng.choice([0, 0, 2]) :] + noise(12)
        out.append(rng.choice([" ", "-", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in words))
    return out


def test_places_against_brute_force(spark):
    texts = some_texts()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, places string, n_words int").repartition(3)
    found = {r.doc_id: (r.n_words, [tuple(p) for p in r.places]) for r in L.license_places(df).collect()}
    assert found == {i: brute(t) for i, t in enumerate(texts)}
    assert sum(len(p) for _, p in found.values()) > 300


def test_query_columns(spark, tmp_path):
    some = [(1, "Licensed under CC BY-NC 4.0. All rights reserved."), (2, None), (2, "no license"), (None, "GNU General Public License")]
    spark.createDataFrame(some, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, L.op13_license_scan(spark, str(tmp_path)).collect()), key=repr)
    assert found == sorted([
        (1, 10, 2, 2, 7, "cc-by,reserved", "cc-by,cc-by-nc-4.0,reserved", 1.0), (2, 0, 0, None, None, "", "", 0.0), (2, 2, 0, None, None, "", "", 0.0),
        (None, 4, 1, 1, 1, "gpl", "gpl", 1.0),
    ], key=repr)
    assert L.license_places(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_document_frequencies(spark):
    df = spark.createDataFrame([("mit MIT public",), ("mit",), (None,), ("",)], "text string").repartition(2)
    assert L.document_frequencies(df.fillna(""), ["by", "mit", "public"]) == {"by": 0, "mit": 2, "public": 1}
