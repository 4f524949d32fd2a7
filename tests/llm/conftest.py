import random

import pytest

LANG = {"en": "the of and to in that is was he for it with as his on be at by had", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein"}


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): prose, copies, near copies, shared passages, personal data, and edge cases."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re", "st", "ou", "ing", "é"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(40)
    out = [prose(rng.randint(5, 200)) for _ in range(60)]
    out += [out[3], out[3] + " ", out[3].replace(" ", "  "), out[4], out[4], "x " + out[5], out[5] + " more"]
    out += [prose(30) + " " + passage + " " + prose(20) for _ in range(8)]
    near = out[10].split()
    for k in (2, 9, 15):
        out.append(" ".join(near[:k] + ["changed"] + near[k + 1 :]))
    out += [None, "", " ", "\n\t", "a", "a", "A", "b c", "z" * 5000, "ab" * 1500, "abab" * 900, "x\u0000y" * 40, "日本語のテキスト" * 30, "😀 emoji " * 20, "1234 " * 300, prose(9000), "<|endoftext|> end <|endoftext|>" * 3, "it's we'll " * 50, "   lots   of    space \n\n\n" * 40]
    out += ["mail a.b@x.com, 10.0.0.1 and +1 (555) 123-4567 card 4111 1111 1111 1111.", "999.1.1.1 1.2.3.4.5.6.7.8 a@b c@d.e_f@g.h +12 4111111111111112", "@" * 200 + "a" * 3000 + "@b", "1" * 3000, "a@b.c" * 50]
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as a table with columns of clashing names, over several partitions."""
    clash = ["n_bytes", "media", "piece", "fp", "node", "key", "curve", "ids", "score", "base", "terms", "block_id", "row_id", "component_id", "row"]
    kinds = ", ".join(f"{c} string" for c in clash)
    return spark.createDataFrame([(i, t, *[str(i)] * len(clash)) for i, t in rows], f"doc_id long, text string, {kinds}").repartition(3, "doc_id")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("doc_id < 0")
