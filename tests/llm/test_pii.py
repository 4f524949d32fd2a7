import hashlib
import re

from loomgraph.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum((d - 9 if d > 9 else d) for d in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m.group())]


def test_base_spans(docs, rows, nothing):
    found = {r.doc_id: r for r in pii.span_digest(pii.personal_data(docs)).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        want = spans(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert found[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and found[i].spans.startswith(text)
        assert [found[i][f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
    assert pii.personal_data(nothing).count() == 0


def corpus(spark):
    rows = [(k, f"plain words number {k} about nothing else here at all") for k in range(400)]
    rows += [(1000 + k, f"story{'abcdefgh'[k]} of Zarathon the wizard writes from a.b@x.com about matter{'abcdefgh'[k]}") for k in range(4)]
    rows += [(2000, "Zarathon appears alone"), (2001, "someone else: c.d@y.org with plain words")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_disclose(spark):
    found = {r.doc_id: r for r in pii.span_digest(pii.personal_data(corpus(spark))).collect()}
    for k in range(4):
        text = f"story{'abcdefgh'[k]} of Zarathon the wizard writes from"
        assert found[1000 + k].spans.endswith(f",term:{text.index('Zarathon')}:{text.index('Zarathon') + 8}") and found[1000 + k].n_terms == 1
    assert found[2000].spans == "term:0:8" and found[2001].n_terms == 0 and found[5].spans == ""


def brute_terms(docs, rule):
    """{entity: {term}} of {doc_id: text}, by loops."""
    import math

    word, n = re.compile(r"[^\W_][^\W_]+"), len(docs)
    name = lambda w: bool(re.search("^[A-Z].*[a-z]", w) or (re.search("[0-9]", w) and re.search("[^0-9]", w)))
    have = lambda term: sum(term in word.findall(t.lower()) for t in docs.values())
    near = {}
    for i, t in docs.items():
        for _, a, b in spans(t):
            before, after = t[max(0, a - rule.context) : a], t[b : b + rule.context]
            before = re.sub(r"^\S+", "", before) if a > rule.context else before
            after = re.sub(r"\S+$", "", after) if b + rule.context < len(t) else after
            near.setdefault(t[a:b].lower(), []).append((i, before, after))
    told = {}
    for entity, hits in near.items():
        own, contexts = len({h[0] for h in hits}), len({h[1:] for h in hits})
        if math.log2(n / own) < rule.least_bits:
            continue
        terms = {}
        for i, before, after in hits:
            w = [*word.findall(before), "@", *word.findall(after)]
            for k, x in enumerate(w):
                if x != "@":
                    terms.setdefault(x.lower(), []).append((i, (before, after), name(x), ["", *w][k].lower(), [*w, ""][k + 1].lower()))
        tried = {}
        for term, at in terms.items():
            sides = min(len({x[3] for x in at}), len({x[4] for x in at}))
            if len({x[1] for x in at}) < min(rule.evidence, contexts):
                continue
            if all(x[2] for x in at) or (contexts >= rule.evidence and sides >= rule.evidence):
                tried[term] = (len({x[0] for x in at}), rule.share if contexts >= rule.evidence else rule.remove)
        for term in re.findall(r"[^\W\d_]{4,}", entity):
            tried[term] = (max(own, tried.get(term, (0,))[0]), rule.share)
        for term, (both, least) in tried.items():
            if have(term) and math.log2(both * n / (own * have(term))) / math.log2(n / own) >= least:
                told.setdefault(entity, set()).add(term)
    return told


def notes(spark):
    """Three notes of one form on an address, one with the name alone, one with a rare address beside a rare name, free notes, and others."""
    rows = [(k, f"plain words number {k} about nothing else here at all") for k in range(400)]
    rows += [(500 + k, f"{'abc'[k]}{'abc'[k]} patient Quillfeather writes regarding {'xyz'[k]}{'xyz'[k]} things to q.f@clinic.org today") for k in range(3)]
    rows += [(600, "a note of Quillfeather alone"), (601, "Ottoline Vane rings ottoline.9@vane.net about words"), (602, "words of ottoline again")]
    rows += [(700 + k, t) for k, t in enumerate(("she has haemo today 10.1.2.3 plain", "his haemo hurts 10.1.2.3 here", "that haemo of 10.1.2.3 nothing", "about her haemo more 10.1.2.3 else"))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_forms_stay_and_rare_entities_are_protected(spark):
    texts = {r.doc_id: r.text for r in pii.sanitised(notes(spark)).collect()}
    for k in range(3):
        assert texts[500 + k] == f"{'abc'[k]}{'abc'[k]} patient <TERM> writes regarding {'xyz'[k]}{'xyz'[k]} things to <EMAIL> today"
    assert texts[600] == "a note of <TERM> alone"
    assert texts[601] == "Ottoline  rings <EMAIL> about words" and texts[602] == "words of ottoline again"
    assert [texts[700 + k] for k in range(4)] == ["she has  today <IP> plain", "his  hurts <IP> here", "that  of <IP> nothing", "about her  more <IP> else"]
    assert texts[5] == "plain words number 5 about nothing else here at all"
    wider = {r.doc_id: r.text for r in pii.sanitised(notes(spark), rule=pii.Disclosure(share=0.85)).collect()}
    assert wider[601] == "<TERM>  rings <EMAIL> about words" and wider[602] == "words of <TERM> again"


def test_disclosure_against_brute_force(spark):
    from pyspark.sql import functions as F

    from loomgraph.llm.common import stored, whole_texts

    for df, rule in ((corpus(spark), pii.Disclosure()), (notes(spark), pii.Disclosure()), (notes(spark), pii.Disclosure(share=0.7, evidence=2, context=30))):
        docs = {r.doc_id: r.text for r in df.collect()}
        found = stored(whole_texts(df).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", pii.base_spans(F.col("text")).alias("base"), "text"), "test")
        told = {}
        for r in pii.disclosing_terms(found, len(docs), rule).collect():
            told.setdefault(r.entity, set()).add(r.term)
        assert told == brute_terms(docs, rule) and told


def test_sanitised(docs, rows, spark):
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert len(clean) == len(rows)
    for i, t in rows:
        want = sorted((a, b, k) for k, a, b in spans(t or ""))
        if not want:
            assert clean[i] == (t or "")
            continue
        out, at, merged = "", 0, []
        for a, b, k in want:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b, k])
        for a, b, k in merged:
            out, at = out + t[at:a] + f"<{k.upper()}>", b
        assert clean[i] == out + t[at:]
    told = {r.doc_id: r.text for r in pii.sanitised(corpus(spark)).collect()}
    assert "Zarathon" not in told[1001] and "wizard" in told[1001] and "<EMAIL>" in told[1001] and told[2000] == "<TERM> appears alone"


def test_no_python_in_the_plan(docs):
    plan = pii.span_digest(pii.personal_data(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_oracle_with_terms(spark):
    import duckdb

    for df, marked in ((corpus(spark), 5), (notes(spark), 9)):
        con = duckdb.connect()
        con.register("documents", df.toPandas())
        expected = con.sql(pii.ORACLES["op8_pii"])
        found = pii.span_digest(pii.personal_data(df)).select(expected.columns)
        assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())
        assert found.where("n_terms > 0").count() == marked
