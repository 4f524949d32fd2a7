"""BPE encoding and decoding by tree concatenation.

Long text is cut into leaves that are encoded in parallel; neighbours are joined level by level.
Around each join a growing window is encoded anew until both sides agree exactly:

* Within one long pre-token (a run of one character class), the window's first and last ids must be
  those that the halves have there. A sequence of ids is what the merges give if and only if each
  neighbouring pair is, so one shared id at either end makes the spliced whole right.
* Elsewhere, the window runs from the left half's last sure start of a pre-token into the right half.
  The tokenizer's pattern starts afresh at each pre-token, so from a start that window and right half
  share, both go on alike.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, slices, stored, whole_texts

LEAF_CHARS = 1 << 15  # longer texts are cut into leaves of about this size
WINDOW = 256  # characters beyond a join that are encoded anew at first
#: Fixed value: what the byte-level tokenizer takes as one pre-token, with possessive repeats.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
PLAIN_BELOW = 0x250  # texts of characters below this take the fast path (the libraries' character tables agree there)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Ids exactly as the tokenizers library gives them for ``path``.

    Texts of common characters take the same vocabulary through a faster merge loop; texts with other
    characters or a special token's string, and all decoding, go through the library itself.
    """

    def __init__(self, path: str, ranks_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = {v: k for k, v in ranks.items()}

    def plain(self, text: str) -> bool:
        return (text.isascii() or max(text) < chr(PLAIN_BELOW)) and not any(s in text for s in self.specials)

    def encode(self, text: str) -> list[int]:
        if self.plain(text):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def boundaries(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and where pre-tokens begin as (character, index of the first id)."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        starts, last = [], None
        for k, (w, (a, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if w != last or w is None:
                starts.append((a, k))
                last = w
        return e.ids, starts

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


@functools.lru_cache(maxsize=2)
def codec(path: str, ranks_path: str) -> Codec:
    return Codec(path, ranks_path)


def cuts(text: str, leaf: int, specials: list[str]) -> list[int]:
    """Where to cut a text into leaves: the tree's halves down to ``leaf`` characters, never within a special token's string."""
    out: list[int] = []

    def halve(a: int, b: int) -> None:
        if b - a <= leaf:
            return
        m = (a + b) // 2
        moved = True
        while moved:
            moved = False
            for s in specials:
                at = text.find(s, max(0, m - len(s) + 1), m + len(s) - 1)
                if 0 <= at < m:
                    m, moved = at + len(s), True
        if m >= b:
            return
        halve(a, m)
        out.append(m)
        halve(m, b)

    halve(0, len(text))
    return out


class Part:
    """An encoded stretch of a text: ids in order, and all characters where its own pre-tokens begin near its ends are found on demand."""

    def __init__(self, start: int, end: int, ids: np.ndarray):
        self.start, self.end, self.ids = start, end, ids


def join(c: Codec, text: str, left: Part, right: Part, window: int = WINDOW) -> Part:
    """The ids of two neighbouring stretches' whole, given those of each alone.

    Windows grow until both sides agree; at worst they reach the halves' far ends, and the whole is encoded.
    """
    inside = join_in_run(c, text, left, right)
    if inside is not None:
        return Part(left.start, right.end, inside)
    m, back, ahead = left.end, window, window
    while True:  # the left half: its own last ids, told apart into pre-tokens
        a = max(left.start, m - back)
        ids, starts = c.boundaries(text[a:m])
        # a window may begin within a pre-token, so its first ones are not sure: the ids after a boundary must be the left half's last
        sure = [(a + p, k) for p, k in starts if (a == left.start or p > 0) and len(ids) - k <= len(left.ids) and ids[k:] == left.ids[len(left.ids) - (len(ids) - k) :].tolist()]
        good = [x for x in sure if x[0] < m and _starts_alone(c, text, left, x[0], m, ids[x[1] :])]
        if good or a == left.start:
            break
        back *= 2
    if good:
        at, kept = good[0][0], len(left.ids) - (len(ids) - good[0][1])
    else:
        at, kept = left.start, 0
    while True:  # the right half
        b = min(right.end, m + ahead)
        inner, starts = c.boundaries(text[at:b])
        own, right_starts = c.boundaries(text[m:b])
        agree = {m + p: k for p, k in right_starts if own[:k] == right.ids[:k].tolist()}
        shared = next(((k, agree[at + p]) for p, k in starts if at + p > m and at + p in agree), None)
        if shared:
            return Part(left.start, right.end, np.concatenate([left.ids[:kept], np.array(inner[: shared[0]], left.ids.dtype), right.ids[shared[1] :]]))
        if b == right.end:
            return Part(left.start, right.end, np.concatenate([left.ids[:kept], np.array(inner, left.ids.dtype)]))
        ahead *= 2


def join_in_run(c: Codec, text: str, left: Part, right: Part, ids: int = 16) -> np.ndarray | None:
    """The joined ids where the cut lies within a long run of one character class, else nothing."""
    import regex

    m = left.end
    while ids <= len(left.ids) and ids <= len(right.ids):
        a, b = left.ids[-ids:].tolist(), right.ids[:ids].tolist()
        if any(x not in c.pieces for x in (*a, *b)):
            return None
        before, after = b"".join(c.pieces[x] for x in a), b"".join(c.pieces[x] for x in b)
        lo, hi = m - len(before) - 4, m + len(after)  # at least as many characters as the ids cover
        if lo < left.start or hi > right.end or not regex.fullmatch(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+", text[lo:hi]):
            return None
        anew = c.fast._encode_single_piece(before + after)
        if anew[0] == a[0] and anew[-1] == b[-1]:
            return np.concatenate([left.ids[:-ids], np.array(anew, left.ids.dtype), right.ids[ids:]])
        ids *= 2
    return None


def _starts_alone(c: Codec, text: str, left: Part, at: int, m: int, tail: list[int]) -> bool:
    """Whether the left half has a pre-token's start at ``at``: the blank or class change there forces one, whatever comes before."""
    if at == left.start:
        return True
    before, here = text[at - 1], text[at]
    return not before.isspace() and here == " " and at + 1 < len(text) and not text[at + 1].isspace() and not any(s[0] == " " for s in c.specials)


def encode_tree(c: Codec, text: str, leaf: int = LEAF_CHARS, parts: list[np.ndarray] | None = None, window: int = WINDOW) -> np.ndarray:
    """A whole text's ids from its leaves' (given, or encoded here)."""
    at = [0, *cuts(text, leaf, c.specials), len(text)]
    ids = parts if parts is not None else [np.array(c.encode(text[a:b]), np.uint32) for a, b in zip(at, at[1:], strict=False)]
    level = [Part(a, b, np.asarray(x, np.uint32)) for a, b, x in zip(at, at[1:], ids, strict=False)]
    while len(level) > 1:
        level = [join(c, text, level[i], level[i + 1], window) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].ids


def _encode_batches(path: str, ranks: str, leaf: int, make_row):
    def run(batches):
        c = codec(path, ranks)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield make_row(c, part)

    return run


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ranks_path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids): every whole text's ids, as little-endian unsigned 32-bit integers in a binary column.

    A null or empty text has none; each row of the input gives one row; an empty table an empty one.
    Texts over ``leaf_chars`` are cut into leaves that are rows of their own, spread over all tasks;
    a document's leaves then meet and are joined.
    """
    path, ranks = path or tokenizer_path(), ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")
    texts = whole_texts(df, id_col, text_col)
    long = F.length("text") > leaf_chars

    def short_rows(c, part):
        ids = [np.array(c.encode(t), "<u4") for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    def leaf_rows(c, part):
        rows = []
        for row, text in zip(part.column("row_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            at = [0, *cuts(text, leaf_chars, c.specials), len(text)]
            rows += [(row, k, text[a:b]) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["row_id", "leaf", "text"])

    def leaf_ids(c, part):
        ids = [np.array(c.encode(t), "<u4").tobytes() for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("row_id"), part.column("leaf"), part.column("text"), pa.array(ids, pa.binary())], names=["row_id", "leaf", "text", "ids"])

    def joined(key, table):
        table = table.sort_by("leaf")
        text = "".join(table.column("text").to_pylist())
        parts = [np.frombuffer(x, "<u4") for x in table.column("ids").to_pylist()]
        ids = encode_tree(codec(path, ranks), text, leaf_chars, parts)
        return pa.table({"row_id": [key[0].as_py()], "n_tokens": pa.array([len(ids)], pa.int64()), "ids": pa.array([ids.astype("<u4").tobytes()], pa.binary())})

    short = texts.where(~long).mapInArrow(_encode_batches(path, ranks, leaf_chars, short_rows), "doc_id long, n_tokens long, ids binary")
    wide = stored(texts.where(long).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text"), "long")  # a stored number is a row's own
    leaves = wide.select("row_id", "text").mapInArrow(_encode_batches(path, ranks, leaf_chars, leaf_rows), "row_id long, leaf int, text string").repartition("row_id", "leaf")
    encoded = leaves.mapInArrow(_encode_batches(path, ranks, leaf_chars, leaf_ids), "row_id long, leaf int, text string, ids binary")
    whole = encoded.groupBy("row_id").applyInArrow(joined, "row_id long, n_tokens long, ids binary")
    return short.unionByName(wide.select("doc_id", "row_id").join(whole, "row_id").select("doc_id", "n_tokens", "ids"))


def bpe_decode(encoded: DataFrame, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): bytes of the ids set end to end, where that is what the library's decoder gives, or the decoder itself."""
    path, ranks = path or tokenizer_path(), ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(batches):
        c = codec(path, ranks)
        for batch in batches:
            for part in slices(batch, "ids", 1 << 20):
                texts = [decode_ids(c, np.frombuffer(x or b"", "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def decode_ids(c: Codec, ids: np.ndarray) -> str:
    try:
        return b"".join(map(c.pieces.__getitem__, ids.tolist())).decode()
    except (KeyError, UnicodeDecodeError):  # a special token, or ids that cut a character
        return c.decode(ids.tolist())


def bpe_digest(encoded: DataFrame, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, n_tokens, ids); null ids count as none."""
    path, ranks = path or tokenizer_path(), ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(batches):
        c = codec(path, ranks)
        for batch in batches:
            for part in slices(batch, "ids", 1 << 20):
                raw = [x or b"" for x in part.column("ids").to_pylist()]
                texts = [decode_ids(c, np.frombuffer(x, "<u4")) for x in raw]
                hashes = [[hashlib.sha256(x).hexdigest() for x in raw], [hashlib.sha256(t.encode()).hexdigest() for t in texts]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_tokens"), *(pa.array(h, pa.string()) for h in hashes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir):
    return bpe_digest(bpe_encode(documents(spark, sf_dir)))


QUERIES = {"op6_bpe": op6_bpe}
ORACLES: dict[str, str] = {}
