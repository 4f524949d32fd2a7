"""Suffix-array dedup by prefix-free parsing: remove bytes of 50-byte strings that also start in a document with a smaller id.

Triggers. A position is a trigger if the rolling hash of the ``K`` bytes there is the least of some
``GRAM`` - ``K`` + 1 neighbouring ones; each 50-byte string holds the trigger that is least among its own
positions, so which one it is depends on the string alone. Consecutive strings with the same trigger make
a phrase: at most ``LEFT`` bytes before the trigger, and up to 50 from it on. Equal strings have equal
triggers at equal places, so only phrases that share a trigger need to meet.

Order. Of the phrases that meet, the parts from the trigger on (how the parse goes on) and the reversed
parts before it (the phrases' insides) are sorted, each with its array of longest common prefixes. A
string with ``o`` bytes before the trigger is a pair (class of the left part at depth o, class of the right
part at depth 50 - o), so both arrays together give the order of all strings, and equal pairs are equal
strings.

Flow. Documents are packed into blocks of about a megabyte. (1) Blocks send hashes of their triggers to
buckets, once each; buckets answer which occur in more than one document. (2) Blocks send hashes of the
distinct phrases of those triggers, which is the dictionary; a phrase in a larger document than its first
goes whole, and where a trigger has several phrases, the first document of each is asked for its text.
(3) Blocks send those texts, each once in all; buckets sort them as above and answer which strings start in
a smaller document. (4) Blocks mark bytes. What a block sends of one trigger or phrase it sends once, so
copies and common lines cost a row for each block; a trigger in more than ``HOT`` blocks has its phrases
split into single strings, spread over buckets by their content. Whole phrases count as the same by 128 bits of
three hashes; that a string is part of two different phrases is compared byte by byte.

Bounds. A block sends a row for each bucket in which it has triggers. Buckets grow with the data and blocks
don't, so from some hundred gigabytes on these rows hold few triggers each, up to one row for each trigger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, whole_texts

GRAM, K = 50, 20
LEFT = GRAM - K  # most bytes of a string before its trigger
WIDE = LEFT + GRAM  # bytes of a phrase, set around its trigger
BLOCK_BYTES = 1 << 20
SEGMENT = 1 << 20  # positions that are hashed at once
BUCKET_BYTES = 10 << 20  # bytes of text for each bucket
HOT = 1 << 14  # blocks: up to this, what they send of one trigger fits a task many times over
NO_ID = np.iinfo(np.int64).max  # a null id: after all others
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
PHRASE, ALIAS, SEND, MASK = range(4)  # kinds of rows between blocks and buckets


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def byte_values() -> np.ndarray:
    return np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def rolling(buf: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each position: a polynomial in MULTIPLIER modulo 2**64, by doubling over shifted views (2, 4, 8 and 16 bytes, then 16 and 4)."""
    v = values[buf]
    n = len(v) - K + 1
    p1 = MULTIPLIER
    with np.errstate(over="ignore"):
        p2, p4, p8 = p1 * p1, p1**4, p1**8
        h2 = v[:-1] * p1 + v[1:]
        h4 = h2[:-2] * p2 + h2[2:]
        h8 = h4[:-4] * p4 + h4[4:]
        h16 = h8[:-8] * p8 + h8[8:]
        return mixed(h16[:n] * p4 + h4[16 : 16 + n])


def triggers(buf: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts set end to end: for each phrase its first and last string's start, trigger, trigger's hash, and text number."""
    empty = np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, ...]] = []
    ends = np.cumsum(lengths)
    edges = np.zeros(len(buf) + 1, np.int32)  # no string starts in a text's last bytes
    np.add.at(edges, np.maximum(ends - GRAM + 1, ends - lengths), 1)
    np.add.at(edges, ends, -1)
    starts_here = np.cumsum(edges[:-1]) == 0
    reach = LEFT + 1  # hashes that a string covers
    for lo in range(0, max(0, len(buf) - GRAM + 1), SEGMENT):
        part = buf[lo : lo + SEGMENT + GRAM - 1]
        h = rolling(part, values)
        m = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        n = len(h) - reach + 1
        least = np.minimum(m[:n], m[reach - 16 : reach - 16 + n])
        inside = starts_here[lo : lo + n]
        changes = least[1:] != least[:-1]
        first = np.nonzero(inside & np.concatenate([[True], changes | ~inside[:-1]]))[0]
        last = np.nonzero(inside & np.concatenate([changes | ~inside[1:], [True]]))[0]
        t = (least[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
        out.append((first + lo, last + lo, t + lo, h[t], np.searchsorted(ends, first + lo, side="right")))
    if not out:
        return empty, empty, empty, empty.astype(np.uint64), empty
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def narrow(x: np.ndarray, size: int) -> np.ndarray:
    """The low ``size`` bytes of unsigned integers, as rows of bytes."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size]


def widened(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.reshape(-1).view("<u8")


def spread(x: np.ndarray, size: int) -> np.ndarray:
    """Differences of integers (their sign in the lowest bit) as planes of bytes: all lowest bytes, then all next ones. For slowly rising numbers most planes are zeros and compress away."""
    d = np.diff(x.astype(np.int64), prepend=np.int64(0))
    return np.ascontiguousarray(narrow(((d << 1) ^ (d >> 63)).view(np.uint64), size).T)


def gathered(planes: np.ndarray) -> np.ndarray:
    z = widened(np.ascontiguousarray(planes.T))
    return np.cumsum((z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64))


def squeezed(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def opened(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


BLOCK_SCHEMA = "block_id long, n_docs int, n_bytes long, ids binary, lengths binary, data binary"


def pack_blocks(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of (doc_id, text) rows: ids, lengths and compressed text. A longer text is a block of its own."""

    def run(batches):
        base, number, ids, held, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def block():
            data = np.frombuffer(b"".join(held), np.uint8)
            cells = [base + number, len(ids), size, np.array(ids, np.int64).tobytes(), np.array([len(t) for t in held], np.int64).tobytes(), squeezed(data)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                i, t = doc.as_py(), text.as_py()
                if held and size + len(t) > block_bytes:
                    yield block()
                    number, ids, held, size = number + 1, [], [], 0
                ids.append(NO_ID if i is None else i)
                held.append(t)
                size += len(t)
        if held:
            yield block()

    return texts.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, BLOCK_SCHEMA)


class Block:
    def __init__(self, ids: bytes, lengths: bytes, data: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.lengths = np.frombuffer(lengths, np.int64)
        self.buf = np.frombuffer(opened(data), np.uint8)

    def triggers(self, values: np.ndarray):
        first, last, at, h, doc = triggers(self.buf, self.lengths, values)
        return first, last, at, h, self.ids[doc] if len(doc) else doc


def grouped_rows(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket that has rows, their places (in order)."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.nonzero(np.diff(edges))[0].tolist():
        yield b, order[edges[b] : edges[b + 1]]


def distinct_triggers(h: np.ndarray, doc: np.ndarray, buckets: int):
    """(place of each trigger's hash among the distinct ones, their codes, rows of places by bucket); a code is the hash's upper 47 bits and a bit that is set if two documents have it."""
    order = np.argsort(h, kind="stable")
    if not len(order):
        return order, h, []
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    starts = np.nonzero(new)[0]
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    several = np.minimum.reduceat(doc[order], starts) < np.maximum.reduceat(doc[order], starts)
    distinct = h[order][starts]
    return place, distinct >> np.uint64(17) << np.uint64(1) | several.astype(np.uint64), list(grouped_rows(bucket_of(distinct, buckets), buckets))


def seen_triggers(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block_id, data): each block's trigger codes, once each."""

    def run(batches):
        values = byte_values()
        for batch in batches:
            for block_id, ids, lengths, data in zip(*(batch.column(c).to_pylist() for c in ("block_id", "ids", "lengths", "data")), strict=True):
                *_, h, doc = Block(ids, lengths, data).triggers(values)
                _, code, by_bucket = distinct_triggers(h, doc, buckets)
                rows = [(b, block_id, squeezed(spread(code[at], 7))) for b, at in by_bucket]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32(), pa.int64(), pa.binary()])], names=["bucket", "block_id", "data"])

    return blocks.mapInArrow(run, "bucket int, block_id long, data binary")


def shared_triggers(seen: DataFrame, hot: int) -> DataFrame:
    """(block_id, bucket, data): for each row of codes two bits a code, in the same order: whether another document has it too, and whether more than ``hot`` blocks do."""

    def run(table: pa.Table) -> pa.Table:
        parts = [columns_of(opened(x), "d7")[0].view(np.uint64) for x in table.column("data").to_pylist()]
        code = np.concatenate(parts)
        h = code >> np.uint64(1)
        order = np.argsort(h, kind="stable")
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        starts = np.nonzero(new)[0]
        group = np.cumsum(new) - 1
        counts = np.diff(np.append(starts, len(h)))
        several = np.maximum.reduceat(code[order] & np.uint64(1), starts) > 0
        shared, many = np.empty(len(h), bool), np.empty(len(h), bool)
        shared[order], many[order] = ((counts > 1) | several)[group], (counts > hot)[group]
        edges = np.cumsum([len(p) for p in parts])[:-1]
        data = [np.packbits(a).tobytes() + np.packbits(b).tobytes() for a, b in zip(np.split(shared, edges), np.split(many, edges), strict=True)]
        return pa.table({"block_id": table.column("block_id"), "bucket": table.column("bucket"), "data": pa.array(data, pa.binary())})

    return seen.groupBy("bucket").applyInArrow(run, "block_id long, bucket int, data binary")


def phrase_rows(buf: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Phrases set around their triggers, (n, WIDE); bytes outside [first, last + GRAM) are zero."""
    columns = np.arange(-LEFT, GRAM)
    place = at[:, None] + columns
    rows = buf[np.clip(place, 0, len(buf) - 1)]
    rows[(place < first[:, None]) | (place >= last[:, None] + GRAM)] = 0
    return rows


def phrase_hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each phrase's bytes and of where its trigger stands in it."""
    weights = np.random.default_rng(23).integers(1, 2**63, (2, WIDE), dtype=np.uint64) | np.uint64(1)
    values = np.random.default_rng(29).integers(1, 2**63, (2, 256), dtype=np.uint64)
    out = np.empty((2, len(at)), np.uint64)
    for s in range(0, len(at), 1 << 14):
        part = slice(s, s + (1 << 14))
        rows = phrase_rows(buf, first[part], last[part], at[part])
        for k in range(2):
            out[k, part] = (values[k][rows] * weights[k]).sum(1, dtype=np.uint64)
    place = mixed((at - first + WIDE * (at - last)).astype(np.uint64) * MULTIPLIER)
    return mixed(out[0] ^ place), mixed(out[1] + place)


def mask_of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bits ``low`` to ``high``: a string's bit is the number of its bytes before the trigger."""
    one = np.uint64(1)
    return ((one << (high.astype(np.uint64) + one)) - (one << low.astype(np.uint64))).astype(np.uint32)


def range_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.log2((mask & (~mask + np.uint32(1))).astype(np.float64)).astype(np.int64)
    return low, np.log2(mask.astype(np.float64)).astype(np.int64)


def dictionary_rows(block: Block, answers: dict[int, bytes], values: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """What a block sends of its shared phrases: (bucket, kind, data). PHRASE rows hold hashes, ALIAS rows what the block itself knows; a mask of zero stands for all of a phrase's strings."""
    first, last, at, h, doc = block.triggers(values)
    place, code, by_bucket = distinct_triggers(h, doc, buckets)
    shared, hot = np.zeros(len(code), bool), np.zeros(len(code), bool)
    for b, k in by_bucket:
        bits = np.frombuffer(answers[b], np.uint8)
        shared[k] = np.unpackbits(bits[: len(bits) // 2], count=len(k))
        hot[k] = np.unpackbits(bits[len(bits) // 2 :], count=len(k))
    number = np.nonzero(shared[place])[0]
    if not len(number):
        return []
    single = hot[place[number]]
    # phrases of hot triggers: a row for each string
    few, many = number[~single], number[single]
    sizes = (last - first + 1)[many]
    begin = np.repeat(first[many], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    number = np.concatenate([few, np.repeat(many, sizes)])
    lo, hi = np.concatenate([first[few], begin]), np.concatenate([last[few], begin])
    is_single = np.arange(len(number)) >= len(few)
    mask = np.where(is_single, mask_of(at[number] - hi, at[number] - lo), np.uint32(0)).astype(np.uint32)
    content, check = phrase_hashes(block.buf, lo, hi, at[number])
    docs = doc[number]
    order = np.lexsort((number, docs, check, content))
    heads = np.nonzero(np.concatenate([[True], (content[order][1:] != content[order][:-1]) | (check[order][1:] != check[order][:-1])]))[0] if len(order) else order
    head = np.repeat(order[heads], np.diff(np.append(heads, len(order))))  # for each row, in order: the first occurrence in the smallest document
    other = order != head
    later = docs[order] > docs[head]
    out: list[tuple[int, int, bytes]] = []
    if other.any():
        like = np.where(later, -1, number[head])[other]
        out.append((int(number[order[0]]) % buckets, ALIAS, squeezed(number[order][other].astype(np.uint32), like.astype(np.int64), mask[order][other])))
    heads = np.sort(order[heads])
    key = np.where(is_single, content, h[number])
    for b, k in grouped_rows(bucket_of(key[heads], buckets), buckets):
        k = heads[k]
        k = k[np.argsort(number[k], kind="stable")]
        out.append((b, PHRASE, squeezed(narrow(key[k] >> np.uint64(40), 3), narrow(content[k], 8), narrow(check[k], 5), spread(number[k], 4), mask[k], spread(docs[k], 8))))
    return out


SENT = {"bucket": pa.int32(), "block_id": pa.int64(), "kind": pa.int32(), "data": pa.binary()}
TOLD = {"block_id": pa.int64(), "kind": pa.int32(), "data": pa.binary()}


def table_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds.items())})


def columns_of(raw: bytes, *kinds: str) -> list[np.ndarray]:
    """Columns set end to end, of equal length. A kind is numpy's, "b" and a size for rows of bytes, or "d" and a size for ``spread`` differences."""
    sizes = [int(k[1:]) if k[0] in "bd" else np.dtype(k).itemsize for k in kinds]
    n = len(raw) // sum(sizes)
    out, at = [], 0
    for k, size in zip(kinds, sizes, strict=True):
        part = np.frombuffer(raw, np.uint8, n * size, at)
        at += n * size
        out.append(gathered(part.reshape(size, n)) if k[0] == "d" else part.reshape(n, size) if k[0] == "b" else part.view(k))
    return out


def send_dictionary(blocks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        values, rows = byte_values(), []
        told = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=True))
        if told:
            for block_id, ids, lengths, data in zip(*(left.column(c).to_pylist() for c in ("block_id", "ids", "lengths", "data")), strict=True):
                rows += [(b, block_id, kind, x) for b, kind, x in dictionary_rows(Block(ids, lengths, data), told, values, buckets)]
        return table_of(rows, SENT)

    return blocks.groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInArrow(run, "bucket int, block_id long, kind int, data binary")


def answer_dictionary(sent: DataFrame) -> DataFrame:
    """For each block: MASK rows of phrases that start whole in a smaller document, SEND rows of those whose text must be compared."""

    def run(table: pa.Table) -> pa.Table:
        rows, blocks, parts = [], [], []
        for block_id, kind, data in zip(*(table.column(c).to_pylist() for c in ("block_id", "kind", "data")), strict=True):
            if kind != PHRASE:
                rows.append((block_id, kind, data))
                continue
            key, content, check, number, mask, docs = columns_of(opened(data), "b3", "b8", "b5", "d4", "<u4", "d8")
            parts.append((widened(key), widened(content), widened(check), number, mask, docs))
            blocks.append(np.full(len(number), block_id, np.int64))
        if parts:
            key, content, check, number, mask, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
            block = np.concatenate(blocks)
            order = np.lexsort((check, content, key))
            new_key = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            new = new_key.copy()
            for x in (content, check):
                new[1:] |= x[order][1:] != x[order][:-1]
            starts = np.nonzero(new)[0]
            group = np.cumsum(new) - 1
            least = np.minimum.reduceat(docs[order], starts)[group]
            phrases = np.add.reduceat(new.astype(np.int64), np.nonzero(new_key)[0])[np.cumsum(new_key) - 1]
            kind = np.where(docs[order] > least, MASK, np.where(phrases > 1, SEND, -1))
            for k in (MASK, SEND):
                at = order[kind == k]
                at = at[np.lexsort((number[at], block[at]))]
                edges = np.nonzero(np.concatenate([[True], block[at][1:] != block[at][:-1]]))[0] if len(at) else at
                rows += [(int(block[x[0]]), k, squeezed(spread(number[x], 4), mask[x])) for x in np.split(at, edges[1:]) if len(x)]
        return table_of(rows, TOLD)

    return sent.groupBy("bucket").applyInArrow(run, "block_id long, kind int, data binary")


def send_texts(blocks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        values, rows = byte_values(), []
        told = list(zip(right.column("kind").to_pylist(), right.column("data").to_pylist(), strict=True))
        for block_id, ids, lengths, data in zip(*(left.column(c).to_pylist() for c in ("block_id", "ids", "lengths", "data")), strict=True):
            asked = [columns_of(opened(x), "d4", "<u4") for kind, x in told if kind == SEND]
            if not asked:
                continue
            number, mask = (np.concatenate(x) for x in zip(*asked, strict=True))
            block = Block(ids, lengths, data)
            first, last, at, h, doc = block.triggers(values)
            low, high = range_of(np.where(mask, mask, mask_of((at - last)[number], (at - first)[number])))
            for b, k in grouped_rows(bucket_of(h[number], buckets), buckets):
                k = k[np.argsort(number[k], kind="stable")]
                t = at[number[k]]
                text = phrase_rows(block.buf, t - high[k], t - low[k], t)
                rows.append((b, block_id, PHRASE, squeezed(spread(number[k], 4), low[k].astype(np.uint8), high[k].astype(np.uint8), spread(doc[number[k]], 8), text)))
        return table_of(rows, SENT)

    return blocks.groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInArrow(run, "bucket int, block_id long, kind int, data binary")


def sorted_with_lcp(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of fixed-length rows: their order, and each one's longest common prefix with the one before."""
    wide = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8").astype(np.uint64)
    order = np.lexsort(wide.T[::-1])
    ordered = rows[order]
    differ = ordered[1:] != ordered[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.concatenate([[0], lcp])


def earlier_strings(rows: np.ndarray, low: np.ndarray, high: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each phrase a mask of the strings (bit o: with o bytes before the trigger) that also start in a document smaller than its own."""
    right_order, right_lcp = sorted_with_lcp(rows[:, LEFT:])
    left_order, left_lcp = sorted_with_lcp(rows[:, LEFT - 1 :: -1])
    mask = np.zeros(len(rows), np.uint32)
    right, left = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for o in range(LEFT + 1):
        has = np.nonzero((low <= o) & (o <= high))[0]
        if len(has) < 2:
            continue
        right[right_order] = np.cumsum(right_lcp < GRAM - o)
        left[left_order] = np.cumsum(left_lcp < o)
        pair = left[has] * (len(rows) + 1) + right[has]
        order = np.argsort(pair, kind="stable")
        pair, d = pair[order], docs[has][order]
        starts = np.nonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))[0]
        least = np.repeat(np.minimum.reduceat(d, starts), np.diff(np.append(starts, len(d))))
        mask[has[order[least < d]]] |= np.uint32(1 << o)
    return mask


def answer_texts(sent: DataFrame) -> DataFrame:
    """For each block: MASK rows of strings that start in a smaller document; what is not text is handed through."""

    def run(table: pa.Table) -> pa.Table:
        rows, blocks, parts = [], [], []
        for block_id, kind, data in zip(*(table.column(c).to_pylist() for c in ("block_id", "kind", "data")), strict=True):
            if kind != PHRASE:
                rows.append((block_id, kind, data))
                continue
            parts.append(columns_of(opened(data), "d4", "u1", "u1", "d8", f"b{WIDE}"))
            blocks.append(block_id)
        if parts:
            number, low, high, docs, text = (np.concatenate(x) for x in zip(*parts, strict=True))
            mask, at = earlier_strings(text, low, high, docs), 0
            for block_id, part in zip(blocks, parts, strict=True):
                m, k = mask[at : at + len(part[0])], part[0]
                at += len(k)
                if m.any():
                    rows.append((block_id, MASK, squeezed(spread(k[m > 0], 4), m[m > 0])))
        return table_of(rows, TOLD)

    return sent.groupBy("bucket").applyInArrow(run, "block_id long, kind int, data binary")


def marked_starts(block: Block, answers: list[tuple[int, bytes]], values: np.ndarray) -> np.ndarray:
    """Where strings to remove start, as positions in the block."""
    first, last, at, *_ = block.triggers(values)
    every = mask_of(at - last, at - first)
    mask = np.zeros(len(at), np.uint32)
    copies = []
    for kind, data in answers:
        if kind == MASK:
            number, bits = columns_of(opened(data), "d4", "<u4")
            np.bitwise_or.at(mask, number, np.where(bits, bits, every[number]))
        else:
            number, like, bits = columns_of(opened(data), "<u4", "<i8", "<u4")
            copies.append((number, like, np.where(bits, bits, every[number])))
    for number, like, bits in copies:  # within a document the same phrase again: as its first occurrence, for these strings
        again = like >= 0
        np.bitwise_or.at(mask, number[again], mask[like[again]] & bits[again])
    for number, like, bits in copies:  # in a larger document of the block: all of these strings
        np.bitwise_or.at(mask, number[like < 0], bits[like < 0])
    return np.concatenate([at[mask >> np.uint32(o) & np.uint32(1) > 0] - o for o in range(LEFT + 1)])


def removed_bytes(block: Block, starts: np.ndarray) -> np.ndarray:
    edge = np.zeros(len(block.buf) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + GRAM, -1)
    return np.cumsum(edge[:-1]) > 0


def mark_blocks(blocks: DataFrame, answers: DataFrame, with_kept: bool) -> DataFrame:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, values = [], byte_values()
        told = list(zip(right.column("kind").to_pylist(), right.column("data").to_pylist(), strict=True))
        for ids, lengths, data in zip(*(left.column(c).to_pylist() for c in ("ids", "lengths", "data")), strict=True):
            block = Block(ids, lengths, data)
            gone = removed_bytes(block, marked_starts(block, told, values)) if told else np.zeros(len(block.buf), bool)
            at = 0
            for i, n in zip(block.ids.tolist(), block.lengths.tolist(), strict=True):
                g, text = gone[at : at + n], block.buf[at : at + n]
                at += n
                kept = text[~g].tobytes()
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                rows.append((None if i == NO_ID else i, n, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_kept]
        return pa.table({x.split()[0]: pa.array([r[k] for r in rows], t) for k, (x, t) in enumerate(zip(schema.split(", "), kinds, strict=True))})

    return blocks.groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInArrow(run, schema)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hot: int = HOT, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row.

    A byte goes if a 50-byte string over it also starts in a row with a smaller id; strings are those of
    the input. A null or empty text has no strings. Rows that repeat an id don't remove from each other;
    a null id comes after all others. An empty table gives an empty one.
    """
    texts = whole_texts(df, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    blocks = pack_blocks(texts, block_bytes).repartition(buckets, "block_id")  # one shuffle, used by all four steps
    shared = shared_triggers(seen_triggers(blocks, buckets), hot)
    told = answer_dictionary(send_dictionary(blocks, shared, buckets))
    asked, known = told.where(F.col("kind") == SEND), told.where(F.col("kind") != SEND)
    return mark_blocks(blocks, known.unionByName(answer_texts(send_texts(blocks, asked, buckets))), with_kept)


def op2_suffix_dedup(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLES = {
    "op2_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
             s AS (SELECT doc_id, unnest(range(0, length(x) // 2 - 49)) AS p,
                          unnest(list_transform(range(0, length(x) // 2 - 49), lambda i: substr(x, 2 * i + 1, 100))) AS s FROM d WHERE length(x) >= 100),
             f AS (SELECT s, min(doc_id) AS first_doc FROM s GROUP BY s HAVING count(*) > 1),
             r AS (SELECT doc_id, p FROM s JOIN f USING (s) WHERE first_doc < doc_id),
             m AS (SELECT *, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 AS joined FROM r),
             i AS (SELECT *, count(*) FILTER (NOT coalesce(joined, false)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
             u AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY 1, 2),
             g AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM u),
             k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS done,
                          string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM g JOIN d USING (doc_id) GROUP BY 1)
        SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(done, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
}
