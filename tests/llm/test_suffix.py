import hashlib
from collections import Counter

import pytest

from loomgraph.llm import suffix


def brute(rows, n=50):
    order = {}
    key = lambda i: float("inf") if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            order[b[p : p + n]] = min(order.get(b[p : p + n], float("inf")), key(i))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if order[b[p : p + n]] < key(i):
                gone[p : p + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block, hot", [(1 << 20, 256), (4000, 1), (1500, 10_000)])
def test_removed_bytes(docs, rows, block, hot):
    found = suffix.remove_repeats(docs, block_bytes=block, hot=hot)
    assert Counter(map(tuple, found.collect())) == brute(rows)


def test_repeated_and_missing_ids(spark, rows):
    some = [(5, rows[3][1]), (5, rows[3][1]), (None, rows[3][1]), (7, rows[3][1] + "tail"), (None, None)]
    found = suffix.remove_repeats(spark.createDataFrame(some, "doc_id long, text string"), block_bytes=300, hot=1)
    assert Counter(map(tuple, found.collect())) == brute(some)


def test_kept_text_and_nothing(docs, nothing):
    kept = suffix.remove_repeats(docs, with_kept=True)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in kept.collect())
    assert suffix.remove_repeats(nothing).count() == 0
