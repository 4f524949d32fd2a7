"""Exact dedup by composable polynomial fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, slices, stored, whole_texts

#: The four largest primes below 2**31, and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1000003, 805306457, 402653189, 201326611)
CHUNK = 1024  # bytes whose hash one row of the matrix product gives; 1024 * 256 * 2**31 is exact in a double
PIECE_CHARS = 1 << 20  # longer texts are cut, hashed in parallel and combined
COMPARE_CHARS = 1 << 16  # characters compared at once
BLANK = " \t\n\x0b\x0c\r"


def chunk_powers() -> np.ndarray:
    """A column for each prime, of the base's powers from CHUNK - 1 down to 0."""
    out = np.empty((CHUNK, len(PRIMES)))
    for k, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
        x = 1
        for j in range(CHUNK - 1, -1, -1):
            out[j, k] = x
            x = x * b % p
    return out


def combine(left: tuple[int, ...], right: tuple[int, ...], right_bytes: int) -> tuple[int, ...]:
    """The fingerprint of two byte strings set end to end: the left one shifted by the right one's length, plus the right one."""
    return tuple((h * pow(b, right_bytes, p) + g) % p for h, g, p, b in zip(left, right, PRIMES, BASES, strict=True))


def fingerprints(texts: list[bytes], powers: np.ndarray) -> list[tuple[int, ...]]:
    """Of each byte string: chunk hashes by one matrix product for all, combined from left to right. Bytes count from 1, so zero bytes matter."""
    counts = [-(-len(t) // CHUNK) for t in texts]
    rows = np.zeros(sum(counts) * CHUNK, np.uint16)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        at += n * CHUNK
        rows[at - len(t) : at] = np.frombuffer(t, np.uint8)  # the short chunk comes first, filled on the left
        rows[at - len(t) : at] += 1
    primes = np.array(PRIMES, np.int64)
    hashed = [tuple(map(int, h)) for s in range(0, sum(counts), 4096) for h in (rows[s * CHUNK : (s + 4096) * CHUNK].reshape(-1, CHUNK).astype(np.float64) @ powers).astype(np.int64) % primes]
    out, at = [], 0
    for n in counts:
        value: tuple[int, ...] = (0,) * len(PRIMES)
        for h in hashed[at : at + n]:
            value = combine(value, h, CHUNK)
        at += n
        out.append(value)
    return out


def normalised(text: Column) -> Column:
    return F.translate(text, BLANK, "")


def pieces(text: Column, chars: int) -> Column:
    """An array of a text's pieces of ``chars`` characters, cut in one pass; one empty piece of an empty text."""
    return F.when(F.length(text) <= chars, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0)))


def text_fingerprints(texts: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(row_id, doc_id, n_chars, text_sha256, n_norm, fp): a number of the row's own, and length in bytes and fingerprint of each text without blanks.

    Pieces of long texts are rows of their own, so tasks share them; their fingerprints meet by
    row and are combined in order. Each row of the input keeps a row of its own.
    """
    own = ["row_id", "doc_id", "n_chars", "text_sha256"]
    schema = "row_id long, doc_id long, n_chars long, text_sha256 string, n_pieces int, piece_no int, n_norm long, fp string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        powers = chunk_powers()
        for batch in batches:
            for part in slices(batch, "piece", 1 << 20):
                clean = [t.translate(None, BLANK.encode()) for t in part.column("piece").to_pylist()]
                marks = ["".join(f"{x:08x}" for x in v) for v in fingerprints(clean, powers)]
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array([len(t) for t in clean], pa.int64()), pa.array(marks, pa.string())], names=names)

    def joined(key, group):
        group = group.sort_values("piece_no")
        value, total = (0,) * len(PRIMES), 0
        for n, fp in zip(group.n_norm, group.fp, strict=True):
            value = combine(value, tuple(int(fp[i : i + 8], 16) for i in range(0, 32, 8)), int(n))
            total += int(n)
        return group.iloc[:1][own].assign(n_norm=total, fp="".join(f"{x:08x}" for x in value))

    cut = texts.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.length("text").cast("long").alias("n_chars"),
        normal_sha256(F.col("text")).alias("text_sha256"), pieces(F.col("text"), piece_chars).alias("p"),
    )
    cut = cut.select(*own, F.size("p").alias("n_pieces"), F.posexplode("p").alias("piece_no", "piece")).withColumn("piece", F.col("piece").cast("binary"))
    hashed = stored(cut.mapInArrow(run, schema), "pieces")
    whole = hashed.where("n_pieces = 1").select(*own, "n_norm", "fp")
    return whole.unionByName(hashed.where("n_pieces > 1").groupBy("row_id").applyInPandas(joined, "row_id long, doc_id long, n_chars long, text_sha256 string, n_norm long, fp string"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = PIECE_CHARS, compare_chars: int = COMPARE_CHARS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row.

    Texts are equal when the same without blanks (a null text is empty); of a group the row with the
    most code points, then the smallest id, stays. Groups come from equal fingerprints; then every
    member's text is compared with its group's first, piece by piece, and a group with any difference
    is split by SHA-256. Of rows that repeat an id each is counted, and of such that would stay in a group, one
    is marked kept. A null id never stays before a row that has one. An empty table gives an empty one.
    """
    texts = whole_texts(df, id_col, text_col)
    prints = text_fingerprints(texts, piece_chars)
    first = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg"), (-F.col("row_id")).alias("row"))).alias("first")
    chosen = [F.count("*").alias("group_size"), first]
    stays = [(-F.col("first.neg")).alias("keep_id"), (-F.col("first.row")).alias("keep_row")]
    groups = stored(prints.groupBy("fp", "n_norm").agg(*chosen).select("fp", "n_norm", "group_size", *stays), "groups")
    wrong = differing_groups(texts, prints.join(groups.where("group_size > 1").select("fp", "n_norm", "keep_row"), ["fp", "n_norm"]), compare_chars)
    marked = groups.join(wrong.withColumn("split", F.lit(True)), ["fp", "n_norm"], "left")
    row = [F.col("doc_id"), F.col("keep_id"), F.col("group_size"), (F.col("row_id") == F.col("keep_row")).alias("kept"), F.col("text_sha256")]
    same = prints.join(marked.where("split is null"), ["fp", "n_norm"]).select(*row)
    apart = prints.join(marked.where("split").select("fp", "n_norm"), ["fp", "n_norm"])
    parts = apart.groupBy("fp", "n_norm", "text_sha256").agg(*chosen).select("fp", "n_norm", "text_sha256", "group_size", *stays)
    return same.unionByName(apart.join(parts, ["fp", "n_norm", "text_sha256"]).select(*row))


def normal_sha256(text: Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def differing_groups(texts: DataFrame, members: DataFrame, chars: int = COMPARE_CHARS) -> DataFrame:
    """(fp, n_norm) of groups with a member whose text differs from that of the row that stays, compared in pieces that are rows of their own.

    Members that repeat id and text count as one, so each row of ``texts`` is compared once with one text.
    """
    named = members.groupBy("doc_id", "text_sha256").agg(F.first("fp").alias("fp"), F.first("n_norm").alias("n_norm"), F.max(F.col("row_id") == F.col("keep_row")).alias("stays"))
    named = named.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "fp", "n_norm", "stays")
    own = normal_sha256(F.col("text"))
    met = texts.join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (own >= F.col("sha")) & (own <= F.col("sha")))  # not as a key, so only members' texts are hashed
    cut = stored(met.select("fp", "n_norm", "stays", F.posexplode(pieces(normalised(F.col("text")), chars)).alias("piece_no", "piece")), "compared")
    expected = cut.where("stays").groupBy("fp", "n_norm", "piece_no").agg(F.first("piece").alias("expected"))
    return cut.join(expected, ["fp", "n_norm", "piece_no"], "left").where(~F.col("piece").eqNullSafe(F.col("expected"))).select("fp", "n_norm").distinct()


def op10_exact_dedup(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir))


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS kept,
               sha256(norm) AS text_sha256
        FROM t""",
}
