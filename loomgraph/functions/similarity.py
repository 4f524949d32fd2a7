"""Similarities of names, signatures, places and texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _longest(a: Column, b: Column) -> Column:
    return F.greatest(F.length(a), F.length(b))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty strings have 1."""
    return F.when(_longest(a, b) == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / _longest(a, b).cast("double"))


def set_jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / union.cast("double"))


def characters(a: Column) -> Column:
    return F.filter(F.array_distinct(F.split(a, "")), lambda c: c != "")


def char_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(characters(a), characters(b), 1.0)


def common_substring(a: Column, b: Column) -> Column:
    """Length of the longest common substring: the longest of a's substrings that b holds. For names, whose lengths are small."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a)))
    longest_from = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - i + 1)), F.lit(0), lambda best, n: F.when((n == best + 1) & (F.length(F.substring(a, i, n)) == n) & F.contains(b, F.substring(a, i, n)), n).otherwise(best))
    return F.array_max(F.transform(starts, longest_from))


def substring_score(a: Column, b: Column) -> Column:
    return F.when(_longest(a, b) == 0, 1.0).otherwise(common_substring(a, b) / _longest(a, b).cast("double"))


def camel_parts(a: Column) -> Column:
    """Components of a camelCase, snake_case or spaced name, in lower case."""
    spaced = F.regexp_replace(F.regexp_replace(a, "([^A-Z _])([A-Z])", "$1 $2"), "_", " ")
    return F.filter(F.split(F.lower(spaced), " +"), lambda x: x != "")


def camel_similarity(a: Column, b: Column) -> Column:
    """Share of places at which the components are the same."""
    x, y = camel_parts(a), camel_parts(b)
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    n = F.greatest(F.size(x), F.size(y))
    return F.when(n == 0, 0.0).otherwise(same / n.cast("double"))


def name_similarity(a: Column, b: Column) -> Column:
    return 0.3 * edit_similarity(a, b) + 0.3 * char_jaccard(a, b) + 0.2 * substring_score(a, b) + 0.2 * camel_similarity(a, b)


def parameters(signature: Column) -> Column:
    """Parameters between the first brackets, trimmed."""
    inner = F.regexp_extract(signature, r"\(([^)]*)\)", 1)
    return F.filter(F.transform(F.split(inner, ","), F.trim), lambda p: p != "")


def first_words(params: Column) -> Column:
    return F.transform(params, lambda p: F.regexp_extract(p, r"^(\S+)", 1))


def parameter_similarity(a: Column, b: Column) -> Column:
    """1 if both are empty; for different counts half of min / max; else the share of equal first words."""
    x, y = first_words(parameters(a)), first_words(parameters(b))
    nx, ny = F.size(x), F.size(y)
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    return F.when((nx == 0) & (ny == 0), 1.0).when(nx != ny, 0.5 * F.least(nx, ny) / F.greatest(nx, ny)).otherwise(same / F.greatest(nx, F.lit(1)).cast("double"))


def return_type(signature: Column) -> Column:
    return F.trim(F.regexp_extract(signature, r"\)\s*:\s*([^{]*)", 1))


def return_similarity(a: Column, b: Column) -> Column:
    x, y = return_type(a), return_type(b)
    return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.5).otherwise(0.0)


def signature_similarity(a: Column, b: Column) -> Column:
    """Two empty signatures have 1, one empty 0; else .7 parameters + .3 return type."""
    both, one = (a == "") & (b == ""), (a == "") | (b == "")
    return F.when(both, 1.0).when(one, 0.0).otherwise(0.7 * parameter_similarity(a, b) + 0.3 * return_similarity(a, b))


def kind_similarity(a: Column, b: Column) -> Column:
    pair = F.array_sort(F.array(a, b))
    near = (pair == F.array(F.lit("function"), F.lit("method"))) | (pair == F.array(F.lit("class"), F.lit("interface")))
    return F.when(a == b, 1.0).when(near, 0.8).otherwise(0.0)


def visibility_level(a: Column) -> Column:
    return F.when(a == "private", 0).when(a == "protected", 1).when(a == "public", 2)


def visibility_similarity(a: Column, b: Column) -> Column:
    x, y = visibility_level(a), visibility_level(b)
    return F.when(a == b, 1.0).when(x.isNull() | y.isNull(), 0.5).otherwise(1 - F.abs(x - y) / F.lit(2.0))


def size_similarity(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) == 0, 1.0).otherwise(F.least(a, b) / F.greatest(a, b).cast("double"))


def structural_similarity(kind_a, kind_b, vis_a, vis_b, size_a, size_b) -> Column:
    return 0.4 * kind_similarity(kind_a, kind_b) + 0.3 * visibility_similarity(vis_a, vis_b) + 0.3 * size_similarity(size_a, size_b)


def location_similarity(a: Column, b: Column) -> Column:
    return F.exp(-F.abs(a - b) / F.lit(20.0))


def words(a: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(a), r"\s+")), lambda w: w != "")


def word_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(words(a), words(b))


#: Fixed values.
STOP_WORDS = ("this", "that", "with", "from", "they", "have", "been", "will")


def concepts(a: Column) -> Column:
    return F.filter(words(a), lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS))


def doc_similarity(a: Column, b: Column) -> Column:
    """Two empty texts have .5, one empty 0; else the mean of word and concept overlap."""
    both, one = (a == "") & (b == ""), (a == "") | (b == "")
    return F.when(both, 0.5).when(one, 0.0).otherwise(0.5 * word_jaccard(a, b) + 0.5 * set_jaccard(concepts(a), concepts(b)))


def doc_quality(a: Column) -> Column:
    n = F.size(words(a))
    return F.when(n == 0, "none").when(n < 5, "minimal").when(n < 20, "basic").otherwise("comprehensive")
