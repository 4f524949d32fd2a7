import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from loomgraph.llm import bpe, packing


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.tokenizer_path(), bpe.tokenizer_path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("leaf", [1 << 15, 700])
def test_encode_and_decode(docs, rows, nothing, tok, leaf):
    found = {r.doc_id: r for r in bpe.bpe_digest(bpe.bpe_encode(docs, leaf_chars=leaf)).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.bpe_digest(bpe.bpe_encode(nothing)).count() == 0


def test_tree_on_random_text(tok, codec):
    rng = random.Random(3)
    alphabets = ["ab", "abcdefg ", "é日a ", "0123 ", "!?'s ", " \n\t a", "'st re", "ab<|endoftext|>"]
    for k in range(160):
        a = rng.choice(alphabets)
        text = "".join(rng.choice(a) for _ in range(rng.randint(1, 1500)))
        if k % 5 == 0:
            text = text[:200] + "<|endoftext|>" + text[200:]
        got = bpe.encode_tree(codec, text, leaf=rng.choice([7, 40, 200]), window=rng.choice([4, 16, 64]))
        assert got.tolist() == tok.encode(text, add_special_tokens=False).ids


def test_long_unsplit_text_is_joined_within_its_run(tok, codec):
    text = "".join(random.Random(5).choice("abcdeft") for _ in range(20_000))
    left, right = (bpe.Part(a, b, np.array(codec.encode(text[a:b]), np.uint32)) for a, b in ((0, 10_000), (10_000, 20_000)))
    inside = bpe.join_in_run(codec, text, left, right)
    assert inside is not None and inside.tolist() == tok.encode(text, add_special_tokens=False).ids


def test_fast_path_agrees_on_every_character_it_takes(tok, codec):
    for c in range(bpe.PLAIN_BELOW):
        for text in (chr(c), f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)}"):
            assert codec.encode(text) == tok.encode(text, add_special_tokens=False).ids


def test_packing(docs, rows, nothing, tok):
    found = packing.pack_pieces(docs, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            part = ids[at : at + r.length].tobytes()
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part) and r.ids == part
            at += r.length
        assert at == len(ids)
    padding = 0
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    assert packing.pack_pieces(nothing).count() == 0


def test_hilbert_curve_visits_neighbours():
    order = 3
    side = 1 << order
    for dims in (2, 3):
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_key(cells, order)
        assert sorted(keys.tolist()) == list(range(side**dims))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
