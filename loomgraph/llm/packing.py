"""Packing documents into sequences along a space-filling curve."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bpe import LEAF_CHARS, Codec, codec, encode_tree, tokenizer_path
from loomgraph.llm.common import documents, map_bytes, stored, whole_texts

LENGTH = 2048  # tokens in a sequence
END = 1  # id after each document
RANGE_TOKENS = 1 << 26  # tokens of a range of the curve, which one task packs
HASHED, DIMS, ORDER = 256, 4, 10  # buckets of the hashed vectors, dimensions they are projected to, bits in each
SPREAD = 0.5  # mean projected coordinates within this of zero fall in cells of their own; the rest in the outermost


def projection(vocabulary: int, hashed: int = HASHED, dims: int = DIMS) -> np.ndarray:
    """For each id the projected vector of its bucket: the product of hashing (with a sign) and a fixed random projection."""
    ids = np.arange(vocabulary, dtype=np.uint64)
    h = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    sign = np.where(h >> np.uint64(23) & np.uint64(1), 1.0, -1.0)
    base = np.random.default_rng(11).standard_normal((hashed, dims))
    return (base[(h % np.uint64(hashed)).astype(int)] * sign[:, None]).astype(np.float32)


def hilbert_key(cells: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Distance along the Hilbert curve of points with integer coordinates below 2**order (rows of ``cells``).

    Works from the most significant bit: each dimension's bit decides whether the lower bits of the
    first coordinate are inverted or exchanged, then a Gray code is undone and the bits interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (order - 1)
    while bit > 1:
        low = bit - 1
        for d in range(dims):
            on = (x[d] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (order - 1)
    while bit > 1:
        flip ^= np.where(x[dims - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(order - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def cells_of(sums: np.ndarray, counts: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Grid cells of documents from the sums of their ids' projections: their means, cut evenly."""
    unit = sums / np.maximum(counts, 1)[:, None]
    return np.clip(((unit / SPREAD + 1) / 2 * (1 << order)).astype(np.int64), 0, (1 << order) - 1)


def id_type(c: Codec) -> str:
    return "<u2" if c.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def token_rows(df: DataFrame, path: str | None = None, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, curve, n_tokens, ids): each whole text's ids and the end id, as unsigned integers of 16 bits (32 for larger vocabularies), with its place on the curve. Long texts are encoded by leaves."""
    path, ranks = path or tokenizer_path(), ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")

    def make():
        c = codec(path, ranks)
        table, kind = projection(c.tokenizer.get_vocab_size()), id_type(c)

        def rows(ids, texts):
            encoded = []
            for t in map(bytes.decode, texts):
                found = encode_tree(c, t) if len(t) > LEAF_CHARS else c.encode(t)
                encoded.append(np.append(np.asarray(found, kind), np.array([END], kind)))
            counts = np.array([len(x) for x in encoded])
            flat = np.concatenate(encoded)
            sums = np.add.reduceat(table[flat], np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
            return [ids, hilbert_key(cells_of(sums, counts)), counts, [x.tobytes() for x in encoded]]

        return rows

    return map_bytes(whole_texts(df, id_col, text_col), make, "doc_id long, curve long, n_tokens long, ids binary", [pa.int64(), pa.int64(), pa.int64(), pa.binary()])


def tail_sequences(n: int) -> list[int]:
    """Lengths into which a rest below LENGTH is cut so that none needs padding: powers of two."""
    return [1 << b for b in range(LENGTH.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_pieces(df: DataFrame, path: str | None = None, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve), and each piece's ids if asked for.

    Documents are dealt by ranges of (place on the curve, id), so that neighbours meet and copies of one
    text, which share a place, still spread over tasks; there are as many ranges as the tokens need. Each is laid end to end and cut every 2048
    tokens; its rest becomes sequences whose lengths are powers of two, so that nothing is padded. A null
    or empty text is its end id alone. Repeated rows are packed each; an empty table gives no pieces.
    """
    tokens = stored(token_rows(df, path, ranks_path, id_col, text_col), "tokens")  # finding the ranges reads the rows once more
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_TOKENS))
    dealt = tokens.repartitionByRange(ranges, F.col("curve"), F.col("doc_id"), F.xxhash64("ids")).sortWithinPartitions("curve", "doc_id")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long" + ", ids binary" * with_ids
    kinds = [*[pa.int64()] * 8, *[pa.binary()] * with_ids]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        base, sequence, waiting, held = TaskContext.get().partitionId() << 36, 0, [], 0

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        def laid(pieces, lengths):
            nonlocal sequence
            out, at, room, offset = [], iter(lengths), 0, 0
            for doc, start, ids, total, curve in pieces:
                while len(ids):
                    if not room:
                        room, offset, sequence = next(at), 0, sequence + 1
                    now, ids = ids[:room], ids[room:]
                    wide = now.astype("<u4").tobytes()
                    out.append((doc, start, len(now), zlib.crc32(wide), total, base + sequence - 1, offset, curve, *[wide] * with_ids))
                    start, offset, room = start + len(now), offset + len(now), room - len(now)
            return out

        for batch in batches:
            rows = []
            for doc, curve, n, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ids, start = np.frombuffer(raw, f"<u{len(raw) // n}"), 0
                while len(ids):
                    take = min(len(ids), LENGTH - held)
                    waiting.append((doc, start, ids[:take], n, curve))
                    ids, start, held = ids[take:], start + take, held + take
                    if held == LENGTH:
                        rows += laid(waiting, [LENGTH])
                        waiting, held = [], 0
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of(laid(waiting, tail_sequences(held)))

    return dealt.mapInArrow(run, schema)


def op7_packing(spark, sf_dir):
    return pack_pieces(documents(spark, sf_dir))


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
