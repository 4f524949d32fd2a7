"""Rename detection: candidates, scores, and one-to-one matching."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import similarity as S
from loomgraph.shared import stored

#: What is put before and after names, abbreviations, words of clarity, and naming conventions.
PREFIXES = ("get", "set", "is", "has", "can", "should", "will", "new", "old", "temp", "tmp")
SUFFIXES = ("er", "ed", "ing", "ly", "tion", "sion", "ness", "ment", "able", "ible", "old", "new", "temp", "copy")
ABBREVIATIONS = {"information": "info", "configuration": "config", "initialize": "init", "parameter": "param", "temporary": "temp", "maximum": "max", "minimum": "min", "calculate": "calc", "generate": "gen", "process": "proc", "execute": "exec", "document": "doc", "reference": "ref", "example": "ex", "number": "num", "string": "str", "boolean": "bool"}
CLARITY = ("clear", "clean", "readable", "understandable", "explicit", "descriptive", "meaningful", "better", "improved")
CONVENTIONS = (r"^[a-z][a-zA-Z0-9]*$", r"^[A-Z][a-zA-Z0-9]*$", r"^[a-z]+(_[a-z0-9]+)*$", r"^[A-Z]+(_[A-Z0-9]+)*$")


def camel_heuristic(a: Column, b: Column) -> Column:
    x, y = S.camel_parts(a), S.camel_parts(b)
    common, short = F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))
    same = S.camel_similarity(a, b)
    return F.when((common > 0.7 * short) & (F.size(x) != F.size(y)), 0.8).when((short > 0) & (common >= 0.5 * short) & (same < 1), 0.7).when((F.size(x) == F.size(y)) & (same > 0.6), same).otherwise(0.0)


def affix_heuristic(a: Column, b: Column) -> Column:
    """.9 for a known prefix or suffix added or taken away, .7 if the longer name merely begins or ends with the shorter."""
    x, y = F.lower(a), F.lower(b)
    known = F.lit(False)
    for p in PREFIXES:
        known = known | (x == F.concat(F.lit(p), y)) | (y == F.concat(F.lit(p), x))
    for s in SUFFIXES:
        known = known | (x == F.concat(y, F.lit(s))) | (y == F.concat(x, F.lit(s)))
    custom = (x != y) & (F.startswith(x, y) | F.startswith(y, x) | F.endswith(x, y) | F.endswith(y, x))
    return F.when(known, 0.9).when(custom & (F.length(a) > 0) & (F.length(b) > 0), 0.7).otherwise(0.0)


def abbreviation_heuristic(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    known = F.lit(False)
    for long, short in ABBREVIATIONS.items():
        known = known | (F.replace(x, F.lit(long), F.lit(short)) == y) & F.contains(x, F.lit(long)) | (F.replace(y, F.lit(long), F.lit(short)) == x) & F.contains(y, F.lit(long))
    held = lambda p, q: F.size(F.array_intersect(S.characters(p), S.characters(q))) > 0.6 * F.size(S.characters(p))
    shorter = (F.length(y) >= 2) & (F.length(y) < 0.6 * F.length(x)) & held(x, y)
    longer = (F.length(x) >= 2) & (F.length(y) > 1.5 * F.length(x)) & held(x, y)
    return F.when(known, 0.9).when(shorter | longer, 0.7).otherwise(0.0)


def refactoring_heuristic(a: Column, b: Column) -> Column:
    clarity = F.lower(b).rlike("|".join(map(re.escape, CLARITY)))
    capitals = lambda c: F.length(F.regexp_replace(c, "[^A-Z]", ""))
    descriptive = (F.length(b) > 1.3 * F.length(a)) & (capitals(b) > capitals(a))
    convention = F.lit(False)
    for c in CONVENTIONS:
        convention = convention | (b.rlike(c) & ~a.rlike(c))
    return F.greatest(F.when(clarity, 0.6).otherwise(0.0), F.when(descriptive, 0.7).otherwise(0.0), F.when(convention, 0.8).otherwise(0.0))


def contextual_heuristic(line_a: Column, line_b: Column, path_a: Column, path_b: Column) -> Column:
    return F.when(path_a == path_b, F.lit(0.3) * S.location_similarity(line_a, line_b)).otherwise(0.0)


def score_candidates(pairs: DataFrame) -> DataFrame:
    """Add the similarities, heuristics, ``score`` and ``confidence`` to pairs with old_ and new_ name, signature, kind, visibility, size, line, doc and path.

    Score: .6 of the weighted mean of six similarities (the sixth, of meaning, is a constant .5) and .4 of
    that of five heuristics. Confidence: 1 less the population variance of the eleven.
    """
    o, n = (lambda c: F.col(f"old_{c}")), (lambda c: F.col(f"new_{c}"))
    scores = {
        "s_name": (S.name_similarity(o("name"), n("name")), 1.0),
        "s_signature": (S.signature_similarity(o("signature"), n("signature")), 1.2),
        "s_structure": (S.structural_similarity(o("kind"), n("kind"), o("visibility"), n("visibility"), o("size"), n("size")), 0.8),
        "s_location": (S.location_similarity(o("line"), n("line")), 0.5),
        "s_doc": (S.doc_similarity(o("doc"), n("doc")), 0.6),
        "s_meaning": (F.lit(0.5), 0.9),
    }
    rules = {
        "h_camel": (camel_heuristic(o("name"), n("name")), 0.8),
        "h_affix": (affix_heuristic(o("name"), n("name")), 0.7),
        "h_abbreviation": (abbreviation_heuristic(o("name"), n("name")), 0.8),
        "h_refactoring": (refactoring_heuristic(o("name"), n("name")), 0.9),
        "h_context": (contextual_heuristic(o("line"), n("line"), o("path"), n("path")), 0.6),
    }
    out = pairs.withColumns({k: v for k, (v, _) in {**scores, **rules}.items()})
    mean = lambda parts: sum((F.col(k) * w for k, (_, w) in parts.items()), F.lit(0.0)) / sum(w for _, w in parts.values())
    every = [F.col(k) for k in (*scores, *rules)]
    average = sum(every, F.lit(0.0)) / len(every)
    variance = sum(((c - average) * (c - average) for c in every), F.lit(0.0)) / len(every)
    return out.withColumn("score", 0.6 * mean(scores) + 0.4 * mean(rules)).withColumn("confidence", 1 - F.least(variance, F.lit(1.0)))


def candidates(old: DataFrame, new: DataFrame, within: Sequence[str] = ("path", "kind")) -> DataFrame:
    """Pairs of deleted and added symbols of one file and of equal kind; both in are (id, name, signature, kind, visibility, size, line, doc, path).

    A rename is looked for between two versions of a file, so their number grows with the files, not with their square.
    """
    a = old.select(*(F.col(c).alias(f"old_{c}") for c in old.columns), *(F.col(c).alias(f"k{i}") for i, c in enumerate(within)))
    b = new.select(*(F.col(c).alias(f"new_{c}") for c in new.columns), *(F.col(c).alias(f"k{i}") for i, c in enumerate(within)))
    keys = [f"k{i}" for i in range(len(within))]
    return a.join(b, keys).drop(*keys)


def one_to_one(pairs: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Pairs (old_id, new_id, score) that a greedy pass by score keeps, each id once; ties go by the ids.

    A round keeps the pairs that rank first for both their ids, and drops all others of those ids. Ids
    that tie as wholes (each of some old ids is best with each of the same new ids, and the other way
    round) are matched by rank at once, which is what the pass makes of them, however many they are. Rounds go on until none is
    left, and each keeps the first pair of all at least; with ``max_rounds`` it is an error if that many are not enough.
    """
    left = stored(pairs.select("old_id", "new_id", "score"), "pairs")
    order = [F.desc("score"), F.col("old_id"), F.col("new_id")]
    own = {c: Window.partitionBy(c) for c in ("old_id", "new_id")}
    kept, rounds = left.where("false"), 0
    while left.limit(1).count():
        if rounds == max_rounds:
            raise RuntimeError(f"still unmatched after {max_rounds} rounds")
        rounds += 1
        best = left.withColumns({f"top_{c}": F.max("score").over(w) for c, w in own.items()})
        best = best.withColumns({f"tops_{c}": F.count(F.when(F.col("score") == F.col(f"top_{c}"), 1)).over(w) for c, w in own.items()})
        ranked = best.withColumns({f"rank_{c}": F.row_number().over(w.orderBy(*order)) for c, w in own.items()})
        ranked = ranked.withColumn("both", (F.col("score") == F.col("top_old_id")) & (F.col("score") == F.col("top_new_id")))
        # equal ids: those with the same partners at their best score, told by their number and hash
        tied = ranked.where("both")
        olds = tied.groupBy("old_id").agg(F.count("*").alias("n_new"), F.bit_xor(F.xxhash64("new_id")).alias("news"), F.min("new_id").alias("first_new"))
        news = tied.groupBy("new_id").agg(F.count("*").alias("n_old"), F.bit_xor(F.xxhash64("old_id")).alias("olds"), F.min("old_id").alias("first_old"))
        same_old, same_new = ["news", "n_new", "first_new"], ["olds", "n_old", "first_old"]
        olds = olds.withColumns({"like_old": F.count("*").over(Window.partitionBy(*same_old)), "at_old": F.row_number().over(Window.partitionBy(*same_old).orderBy("old_id"))})
        news = news.withColumns({"like_new": F.count("*").over(Window.partitionBy(*same_new)), "at_new": F.row_number().over(Window.partitionBy(*same_new).orderBy("new_id"))})
        whole = tied.join(olds, "old_id").join(news, "new_id")
        whole = whole.withColumn("ok", (F.col("n_old") == F.col("like_old")) & (F.col("n_new") == F.col("like_new")) & (F.col("n_new") == F.col("tops_old_id")) & (F.col("n_old") == F.col("tops_new_id")))
        whole = whole.withColumns({"ok_old": F.min("ok").over(own["old_id"]), "ok_new": F.min("ok").over(own["new_id"])})
        by_rank = whole.where("ok_old and ok_new and at_old = at_new").select("old_id", "new_id", "score")
        first = ranked.where("rank_old_id = 1 and rank_new_id = 1").select("old_id", "new_id", "score")
        now = stored(by_rank.unionByName(first).distinct(), "matched")
        kept = kept.unionByName(now) if rounds % 16 else stored(kept.unionByName(now), "kept")  # so that plans stay small
        left = stored(left.join(now.select("old_id"), "old_id", "left_anti").join(now.select("new_id"), "new_id", "left_anti"), "pairs")
    return kept


def rename_type() -> Column:
    o, n = (lambda c: F.col(f"old_{c}")), (lambda c: F.col(f"new_{c}"))
    return (
        F.when(o("signature") != n("signature"), "signature")
        .when(F.abs(o("line") - n("line")) > 10, "move")
        .when(F.abs(o("size") - n("size")) > 5, "refactoring")
        .when((o("doc") != n("doc")) & (o("visibility") != n("visibility")), "complex")
        .otherwise("simple")
    )


def rename_risk(score: Column, confidence: Column) -> Column:
    return F.when((confidence < 0.6) | (score < 0.7), "high").when((confidence < 0.8) | (score < 0.85), "medium").otherwise("low")


def detect_renames(old: DataFrame, new: DataFrame, min_score: float = 0.8, min_confidence: float = 0.5) -> DataFrame:
    scored = score_candidates(candidates(old, new)).where((F.col("score") >= min_score) & (F.col("confidence") >= min_confidence))
    scored = scored.withColumns({"type": rename_type(), "risk": rename_risk(F.col("score"), F.col("confidence"))})
    return scored.join(one_to_one(scored).select("old_id", "new_id"), ["old_id", "new_id"])
