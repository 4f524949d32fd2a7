import zlib

import numpy as np

from loomgraph.llm import language, quality

SF = "/root/testdata/sf0.01"


def held(i, parts, rest):
    return zlib.crc32(str(i).encode()) % parts == rest


def test_quality_of_held_out_documents(spark):
    found = {r.doc_id: r for r in quality.op3_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == held(i, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in found.items())
    judged = [(found[i].predicted, q) for i, q in labels.items() if held(i, 5, 0)]
    assert np.mean([p == q for p, q in judged]) >= 0.9
    assert np.mean([p == 1 for p, q in judged if q == 1]) >= 0.95


def test_quality_edges(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(i, int(k % 3 > 0), 0) for k, (i, _) in enumerate(rows)] + [(None, 1, 0), (rows[0][0], None, 0)], "doc_id long, quality int, toxic int")
    vectors, net = quality.fit_quality(docs, labels)
    scores = quality.score_quality(docs, vectors, net).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    assert quality.score_quality(nothing, vectors, net).count() == 0
    kept = quality.keep_quality(docs, vectors, net)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.3 for r in scores)
    vectors, net = quality.fit_quality(nothing, labels.where("quality = 1"))
    assert quality.score_quality(docs, vectors, net).count() == len(rows)


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 5))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(4000) < p).astype(int)
    net = quality.fit_network(x[:3000], y[:3000])
    s = net.scores(x[3000:])
    for lo in np.arange(0, 1, 0.25):
        at = (s >= lo) & (s < lo + 0.25)
        assert abs(s[at].mean() - y[3000:][at].mean()) < 0.12


def test_word_vectors_do_not_depend_on_partitions(spark, docs):
    a, b = quality.word_vectors(docs.coalesce(1)), quality.word_vectors(docs.repartition(5))
    assert np.array_equal(a, b)


def test_language_of_held_out_documents(spark):
    found = {r.doc_id: r for r in language.op4_language(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    judged = [found[i].lang_pred == lang for i, lang in truth.items() if held(i, 4, 2)]
    assert np.mean(judged) >= 0.97
    assert all(r.held_out == held(i, 4, 2) for i, r in found.items())


def test_language_edges(spark, rows, nothing):
    docs = spark.createDataFrame([(i, t, [None, "en", "de"][k % 3]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string")
    net = language.fit_language(docs)
    found = {r.doc_id: r for r in language.predict_language(docs, net).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        letters = any(c.isalpha() for c in t or "")
        assert (found[i].lang_pred == "und") == (not letters) and 0 <= found[i].score <= 1
    assert language.predict_language(docs.where("doc_id < 0"), net).count() == 0
    none = language.fit_language(docs.where("lang = 'xx'"))
    assert {r.lang_pred for r in language.predict_language(docs, none).collect()} == {"und"}


def test_gradient_of_the_network():
    """One step of training lowers the loss on what it saw."""
    rng = np.random.default_rng(0)
    windows = np.where(rng.random((64, language.WINDOW)) < 0.5, 97, 98).astype(np.uint8)
    windows[::2, ::7] = 120
    labels = ["x" if k % 2 == 0 else "y" for k in range(64)]
    net = language.fit_bytenet(windows, labels, epochs=15)
    p = net.probabilities(windows)
    assert np.mean([net.classes[k] == t for k, t in zip(p.argmax(1), labels, strict=True)]) > 0.95


def slopes(loss, params, grads, rng, step=1e-5):
    """Gradients against differences of the loss, at some places of each parameter."""
    for p, g in zip(params, grads, strict=True):
        flat = p.reshape(-1)
        for k in rng.choice(flat.size, min(12, flat.size), replace=False):
            was = flat[k]
            flat[k] = was + step
            up = loss()
            flat[k] = was - step
            down = loss()
            flat[k] = was
            assert abs((up - down) / (2 * step) - g.reshape(-1)[k]) < 1e-5


def test_gradients_are_differences_of_the_loss():
    rng = np.random.default_rng(2)
    z, t = rng.standard_normal((30, 5)), (rng.random(30) < 0.4).astype(float)
    params = [rng.standard_normal((5, 4)), rng.standard_normal(4), rng.standard_normal(4), rng.standard_normal(1)]

    def quality_loss():
        o = np.tanh(z @ params[0] + params[1]) @ params[2] + params[3]
        return np.logaddexp(0, np.where(t == 1, -o, o)).mean() + 0.5e-4 * ((params[0] ** 2).sum() + (params[2] ** 2).sum())

    slopes(quality_loss, params, quality.gradients(params, z, t), rng)
    windows, y = rng.integers(97, 105, (6, 20), dtype=np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net = language.fit_bytenet(windows, list("abcabc"), epochs=0)
    for name in ("embed", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(float))
    net.filters = [f.astype(float) for f in net.filters]
    net.bias += rng.standard_normal(len(net.bias)) * 0.1
    weight = rng.random(6) + 0.5

    def language_loss():
        o = net.embed[np.pad(windows, ((0, 0), (0, 3)))]
        tops = []
        for f, width in zip(net.filters, language.WIDTHS, strict=True):
            spans = np.stack([o[:, i : i + width].reshape(6, -1) for i in range(20)], axis=1)
            tops.append((spans @ f).max(1))
        out = np.maximum(np.concatenate(tops, axis=1) + net.bias, 0) @ net.out + net.out_bias
        cost = np.log(np.exp(out).sum(1)) - out[np.arange(6), y]
        return (cost * weight).mean() + 0.5e-4 * (net.out**2).sum()

    slopes(language_loss, [net.embed, *net.filters, net.bias, net.out, net.out_bias], language.gradients(net, windows, y, weight), rng, 1e-6)


def test_network_of_bytes_against_loops():
    rng = np.random.default_rng(3)
    windows = rng.integers(0, 256, (5, language.WINDOW), dtype=np.uint8)
    net = language.fit_bytenet(windows, ["a", "b", "a", "b", "c"], epochs=1)
    for w, p in zip(windows, net.probabilities(windows, batch=2), strict=True):
        tops = []
        padded = np.concatenate([net.embed[w], np.zeros((max(language.WIDTHS) - 1, language.EMBED))])
        for f, width in zip(net.filters, language.WIDTHS, strict=True):
            tops += [max(float(padded[i : i + width].reshape(-1) @ f[:, k]) for i in range(len(w))) for k in range(language.FILTERS)]
        z = np.maximum(np.array(tops) + net.bias, 0) @ net.out + net.out_bias
        assert np.allclose(p, np.exp(z) / np.exp(z).sum(), atol=1e-4)


def test_long_texts_give_the_same_rows(rows, monkeypatch):
    plain = [quality.token_ids((t or "").encode()).tolist() for _, t in rows]
    monkeypatch.setattr(quality, "LONG", -1)
    assert [quality.token_ids((t or "").encode()).tolist() for _, t in rows] == plain


def test_pooled_vectors_against_loops(rows):
    texts = [(t or "").encode()[:3000] for _, t in rows[::4]]
    rows_, dims = 64, 8
    places = quality.index_positions(rows_, dims)
    sums = np.zeros((rows_, dims), np.int64)
    quality.context_sums(texts, places, sums)
    expected = np.zeros((rows_, dims), np.int64)
    for t in texts:
        ids = [zlib.crc32(w) % rows_ for w in quality.TOKEN.findall(t)]
        for i, word in enumerate(ids):
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                if i != j:
                    expected[word, places[0][ids[j]]] += 1
                    expected[word, places[1][ids[j]]] -= 1
    assert np.array_equal(sums, expected)
    vectors = np.random.default_rng(1).standard_normal((rows_, dims)).astype(np.float32)
    for t, x in zip(texts, quality.pooled(texts, vectors), strict=True):
        v = np.array([vectors[zlib.crc32(w) % rows_] for w in quality.TOKEN.findall(t)], float).reshape(-1, dims)
        if not len(v):
            assert not x.any()
            continue
        pairs = (v[:-1] * v[1:]).sum(0) / max(1, len(v) - 1)
        want = [*v.mean(0), *v.std(0), *pairs, pairs.sum(), np.sqrt((v.mean(0) ** 2).sum())]
        assert np.allclose(x, want, atol=2e-3)
