"""Personal data: base patterns, and information-theoretic sanitisation of terms that reveal protected entities.

DataFrame functions only. The protected entities are the values that the base patterns find. How
strongly a term reveals an entity is their pointwise mutual information over the corpus, as a share of
the entity's own information content: 1 means that the term occurs only with the entity. Terms are
words near a value, and those that spell a part of it.

One witness is not enough. A term must stand in ``evidence`` different contexts of the entity; names
(capitals, letters with digits, scripts without case) need no more, while other words must also have as
many different neighbours on either side, as the words of a form or template have not. An entity with
fewer contexts is protected too: by names that stand in all of them and, in the whole corpus, hardly
anywhere else, and by the parts of its own spelling. What discloses is marked in every text that holds
it, with the entity or without.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, stored, whole_texts

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
#: The kinds in order, with their patterns. Written so that a long run is scanned once:
#: a match begins at the start of its run or where the last match ended, and repeats are possessive.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Words of two characters or more; what tells a name; parts of a value that can stand alone.
WORD = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]+"
NAME = r"^\p{Lu}.*\p{Ll}|\p{L}\p{N}|\p{N}\p{L}|^[\p{Lo}\p{M}]+$"
SPELLED = r"\p{L}{4,}"
#: Numbers that are put together one by one; characters of a piece of text.
SCAN, PIECE = 256, 1024


@dataclass(frozen=True)
class Disclosure:
    context: int = 80  # characters on either side of an entity that count as occurring with it
    evidence: int = 3  # different contexts in which a term must occur with an entity, if it has as many
    share: float = 0.9  # of the entity's information that a term must reveal to be generalised
    remove: float = 0.98  # and to be removed; also what names must reveal of an entity with fewer contexts
    least_bits: float = 6.0  # information content below which an entity is too common to be revealed


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(at, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def counted(value: Column, low: int, high: int) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(low, high)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(counted(value, 16, 19), luhn(F.regexp_replace(value, "[^0-9]", ""))).otherwise(False)
    if kind == "phone":
        return counted(value, 8, 15)
    return F.lit(True)


def worth(kind: str, text: Column) -> Column:
    """A cheap condition that any text with a match meets."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"(?:[0-9][\x20-]?){16}"), "phone": text.contains("+")}[kind]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each long of an array, what those before it combine to. Arrays grow by copies, so it goes by blocks and then within each, which keeps the work in proportion."""
    none, empty = F.lit(zero).cast("long"), F.array().cast("array<bigint>")

    def few(xs: Column) -> Column:
        start = F.struct(none.alias("now"), empty.alias("out"))
        return F.aggregate(xs, start, lambda s, x: F.struct(combine(s["now"], x).alias("now"), F.concat(s["out"], F.array(s["now"])).alias("out")), lambda s: s["out"])

    def many(xs: Column) -> Column:
        block = lambda at: F.slice(xs, at + 1, F.lit(SCAN))
        starts = F.sequence(F.lit(0), F.size(xs) - 1, F.lit(SCAN))
        before = few(F.transform(starts, lambda at: F.aggregate(block(at), none, lambda x, y: combine(x, y))))
        return F.flatten(F.zip_with(starts, before, lambda at, b: F.transform(few(block(at)), lambda x: combine(b, x))))

    return bound(values, lambda xs: F.when(F.size(xs) == 0, empty).when(F.size(xs) <= SCAN, few(xs)).otherwise(many(xs)))


def pieces_of(text: Column) -> Column:
    """A text in pieces of ``PIECE`` characters, so that a part of it is found without reading all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part_of(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end``, exclusive."""
    first = F.floor(start / PIECE).cast("int")
    count = F.floor((end - 1) / PIECE).cast("int") - first + 1
    return F.when(end > start, F.substring(F.array_join(F.slice(pieces, first + 1, count), ""), (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def spans_of(text: Column, pattern: Column, kind: str, keep=None) -> Column:
    """Leftmost matches as spans in code points: the gaps that split() leaves and the matches follow each other in turn."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    hit_size = lambda p: F.coalesce(F.length(p["hit"]), F.lit(0))

    def spans(pairs: Column) -> Column:
        at = running(F.transform(pairs, lambda p: (F.length(p["gap"]) + hit_size(p)).cast("long")), lambda x, y: x + y, 0)
        begin = lambda p, a: (a + F.length(p["gap"])).cast("int")
        named = F.zip_with(pairs, at, lambda p, a: F.struct(F.lit(kind).alias("kind"), begin(p, a).alias("start"), (begin(p, a) + hit_size(p)).alias("end"), p["hit"].alias("value")))
        return F.filter(named, lambda s: s["value"].isNotNull() & (keep(s["value"]) if keep else F.lit(True)))

    return bound(pairs, spans)


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``, by start."""
    mark = lambda array, own: F.transform(array, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), s["kind"].alias("kind"), s["value"].alias("value")))
    far = (1 << 62) - 1

    def clear(all_: Column) -> Column:
        latest = running(F.transform(all_, lambda s: F.when(s["own"], -1).otherwise(s["end"]).cast("long")), F.greatest, -1)
        nearest = F.reverse(running(F.reverse(F.transform(all_, lambda s: F.when(s["own"], F.lit(far)).otherwise(s["start"]).cast("long"))), F.least, far))
        zipped = F.arrays_zip(all_.alias("s"), latest.alias("before"), nearest.alias("after"))
        kept = F.filter(zipped, lambda z: z["s"]["own"] & (z["before"] <= z["s"]["start"]) & (z["after"] >= z["s"]["end"]))
        return F.transform(kept, lambda z: F.struct(z["s"]["kind"].alias("kind"), z["s"]["start"].alias("start"), z["s"]["end"].alias("end"), z["s"]["value"].alias("value")))

    return bound(F.sort_array(F.concat(mark(spans, True), mark(others, False))), clear)


def base_spans(text: Column) -> Column:
    """All base spans: by kind as listed, then start."""
    none = F.array().cast(SPAN)
    return F.concat(*(F.when(worth(k, text), spans_of(text, F.lit(p), k, lambda v, k=k: valid(k, v))).otherwise(none) for k, p in PATTERNS.items()))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def disclosing_terms(found: DataFrame, rows: int, rule: Disclosure) -> DataFrame:
    """(entity, term, share, wide): terms that reveal an entity, from documents' counts over the whole corpus; wide if the term also stands in documents that don't show it beside the entity.

    Counts are of documents, and copies of one passage are one context.
    """
    far = F.lit(rule.context)

    def window(pieces: Column, s: Column) -> Column:
        before, after = part_of(pieces, F.greatest(F.lit(0), s["start"] - far), s["start"]), part_of(pieces, s["end"], F.least(s["end"] + far, F.col("n_chars")))
        before = F.when(s["start"] > far, F.regexp_replace(before, r"^\S+", "")).otherwise(before)  # a word that the window cuts
        after = F.when(s["end"] + far < F.col("n_chars"), F.regexp_replace(after, r"\S+$", "")).otherwise(after)
        return F.struct(F.lower(s["value"]).alias("entity"), before.alias("before"), after.alias("after"))

    hits = found.where(F.size("base") > 0).withColumn("n_chars", F.length("text"))
    near = hits.select("row_id", F.explode(bound(pieces_of(F.col("text")), lambda p: F.transform("base", lambda s: window(p, s)))).alias("near")).select("row_id", "near.*")
    words = lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    near = near.select("row_id", "entity", F.md5(F.concat_ws(" ", "before", "after")).alias("witness"), F.concat(words("before"), F.array(F.lit("@")), words("after")).alias("w"))
    entities = near.groupBy("entity").agg(F.count_distinct("row_id").alias("with_entity"), F.count_distinct("witness").alias("contexts"))
    entities = entities.withColumn("bits", F.log2(F.lit(float(max(1, rows))) / F.col("with_entity"))).where(F.col("bits") >= rule.least_bits)
    beside = lambda k: F.coalesce(F.lower(F.get("w", F.col("at") + k)), F.lit(""))
    seen = near.select("row_id", "entity", "witness", "w", F.posexplode("w").alias("at", "word")).where("word <> '@'")
    seen = seen.select("row_id", "entity", "witness", F.lower("word").alias("term"), F.col("word").rlike(NAME).alias("name"), beside(-1).alias("left"), beside(1).alias("right"))
    distinct = [F.count_distinct(c).alias(f"n_{c}") for c in ("row_id", "witness", "left", "right")]
    pairs = seen.groupBy("entity", "term").agg(*distinct, F.min("name").alias("name")).join(entities, "entity")
    free = F.col("name") | (F.least("n_left", "n_right") >= rule.evidence)
    pairs = pairs.where((F.col("n_witness") >= F.least(F.lit(rule.evidence), F.col("contexts"))) & free & (F.col("name") | (F.col("contexts") >= rule.evidence)))
    pairs = pairs.select("entity", "term", F.col("n_row_id").alias("both"), "with_entity", "bits", F.when(F.col("contexts") < rule.evidence, rule.remove).otherwise(rule.share).alias("least"))
    spelled = entities.select("entity", F.explode(F.array_distinct(F.regexp_extract_all("entity", F.lit(SPELLED), F.lit(0)))).alias("term"), F.col("with_entity").alias("both"), "with_entity", "bits", F.lit(rule.share).alias("least"))
    tried = pairs.unionByName(spelled).groupBy("entity", "term", "with_entity", "bits").agg(F.max("both").alias("both"), F.min("least").alias("least"))
    tried = stored(tried, "tried")  # few beside all words, so only words of texts that are tried are moved
    terms = found.select(F.explode(words_of(F.col("text"))).alias("term")).join(stored(tried.select("term").distinct(), "terms"), "term", "left_semi")
    told = tried.join(terms.groupBy("term").agg(F.count("*").alias("with_term")), "term")
    mutual = F.log2(F.col("both") * F.lit(float(max(1, rows))) / (F.col("with_entity") * F.col("with_term")))
    return told.withColumn("share", mutual / F.col("bits")).where(F.col("share") >= F.col("least")).select("entity", "term", "share", (F.col("with_term") > F.col("both")).alias("wide"))


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Disclosure | None = None, with_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(row_id, doc_id, base, terms[, text][, carried: a struct of the columns ``carry``]) for each row: base spans, and spans of terms that reveal an entity of this document or another.

    Terms overlapping a base span are part of it and left out. A null text is empty and has none;
    repeated rows keep a row each; an empty table gives an empty one. In a table of fewer than
    2 ** ``rule.least_bits`` rows no term discloses anything.
    """
    rule = rule or Disclosure()
    more = ["carried"] * bool(carry)
    held = whole_texts(df, id_col, text_col, carry)
    found = stored(held.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", base_spans(F.col("text")).alias("base"), "text", *more), "personal", dense=True)
    told = stored(disclosing_terms(found, found.count(), rule), "disclosing")
    own = found.where(F.size("base") > 0).select("row_id", F.explode(F.array_distinct(F.transform("base", lambda s: F.lower(s["value"])))).alias("entity"))
    own = own.join(told, "entity").select("row_id", "term", "share")
    wide = stored(told.where("wide").groupBy("term").agg(F.max("share").alias("share")), "wide")
    others = found.select("row_id", F.explode(words_of(F.col("text"))).alias("term")).join(wide, "term").select("row_id", "term", "share")
    wanted = own.unionByName(others).groupBy("row_id", "term").agg(F.max("share").alias("share")).groupBy("row_id")
    wanted = stored(wanted.agg(F.sort_array(F.collect_list("term")).alias("words"), F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares")), "wanted")
    some = stored(wanted.select("row_id"), "some")  # a few bytes a row, so mostly small enough to leave the other texts where they are
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join("words", "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    spans = apart(spans_of(F.col("text"), pattern, "term"), F.col("base"))
    marked = stored(found.join(some, "row_id", "left_semi").join(wanted, "row_id").select("row_id", spans.alias("terms"), "shares"), "terms")
    out = found.join(marked, "row_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast(SPAN)))
    return out.select("row_id", "doc_id", "base", "terms", "shares", *["text"] * with_text, *more)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms) of what ``personal_data`` finds."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, F.lit(k)))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(F.encode(listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"), listed(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def sanitised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Disclosure | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(row_id, doc_id, text[, carried]) with base spans replaced by their kind's tag, and terms by a general tag or, where they reveal nearly all, by nothing. Spans that overlap are replaced together, by the first one's tag."""
    rule = rule or Disclosure()
    found = personal_data(df, id_col, text_col, rule, with_text=True, carry=carry)
    gone = lambda s: (s["kind"] == "term") & (F.coalesce(F.element_at("shares", F.lower(s["value"])), F.lit(0.0)) >= rule.remove)
    tagged = F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(gone(s), "").otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).alias("tag")))
    none = F.array().cast("array<struct<start:int,end:int,tag:string>>")

    def merged(spans: Column) -> Column:
        """Spans by start: of those that overlap, the first one's start and tag, and the last end."""
        reach = running(F.transform(spans, lambda s: s["end"].cast("long")), F.greatest, -1)
        first = F.filter(F.arrays_zip(spans.alias("s"), reach.alias("reach")), lambda z: z["s"]["start"] >= z["reach"])
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return bound(first, lambda f: F.transform(f, lambda z, i: F.struct(z["s"]["start"].alias("start"), F.coalesce(F.get(f, i + 1)["reach"].cast("int"), last).alias("end"), z["s"]["tag"].alias("tag"))))

    cut = found.withColumn("m", F.when(F.size("base") + F.size("terms") > 0, bound(F.sort_array(tagged), merged)).otherwise(none))

    def replaced(pieces: Column) -> Column:
        parts = F.transform("m", lambda s, i: F.concat(part_of(pieces, F.coalesce(F.get("m", i - 1)["end"], F.lit(0)), s["start"]), s["tag"]))
        return F.concat(F.array_join(parts, ""), part_of(pieces, F.element_at("m", -1)["end"], F.length("text")))

    return cut.select("row_id", "doc_id", F.when(F.size("m") == 0, F.col("text")).otherwise(bound(pieces_of(F.col("text")), replaced)).alias("text"), *["carried"] * bool(carry))


def op8_pii(spark, sf_dir):
    return span_digest(personal_data(documents(spark, sf_dir)))


QUERIES = {"op8_pii": op8_pii}


def _kind_sql(kind: str, order: int, pattern: str, keep: str) -> str:
    return rf"""{kind}_h AS (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS h FROM t),
             {kind}_i AS (SELECT doc_id, unnest(range(1, len(h) + 1)) AS i, g, h FROM {kind}_h WHERE len(h) > 0),
             {kind}_s AS (SELECT doc_id, '{kind}' AS kind, {order} AS ord, h[i] AS value,
                 (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a FROM {kind}_i),
             {kind} AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM {kind}_s WHERE {keep.format(d="regexp_replace(value, '[^0-9]', '', 'g')")})"""


_LUHN = "length({d}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({d}) + 1), lambda k: CASE WHEN (length({d}) - k) % 2 = 1 THEN CASE WHEN substr({d}, k, 1)::INT > 4 THEN 2 * substr({d}, k, 1)::INT - 9 ELSE 2 * substr({d}, k, 1)::INT END ELSE substr({d}, k, 1)::INT END)) % 10 = 0"
_KINDS = [
    _kind_sql("email", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _kind_sql("ip", 2, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_full_match(value, '{BYTE}(?:\.{BYTE}){{{{3}}}}')"),
    _kind_sql("card", 3, r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
    _kind_sql("phone", 4, r"\+[0-9][\x20().0-9-]+[0-9]", "length({d}) BETWEEN 8 AND 15"),
]
ORACLES = {
    "op8_pii": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(_KINDS)},
             base AS (SELECT doc_id, kind, ord, value, a, a + length(value) AS b FROM (SELECT * FROM email UNION ALL SELECT * FROM ip UNION ALL SELECT * FROM card UNION ALL SELECT * FROM phone)),
             n AS (SELECT count(*)::DOUBLE AS n FROM t),
             win AS (SELECT base.doc_id, lower(value) AS entity, a, b, text, substr(text, greatest(1, a + 1 - 80), least(80, a)) AS pre, substr(text, b + 1, 80) AS post FROM base JOIN t ON t.doc_id = base.doc_id),
             near AS (SELECT doc_id, entity, CASE WHEN a > 80 THEN regexp_replace(pre, '^\S+', '') ELSE pre END AS before, CASE WHEN b + 80 < length(text) THEN regexp_replace(post, '\S+$', '') ELSE post END AS after FROM win),
             tok AS (SELECT doc_id, entity, md5(before || ' ' || after) AS witness, list_concat(regexp_extract_all(before, '{WORD}'), ['@'], regexp_extract_all(after, '{WORD}')) AS w FROM near),
             seen AS (SELECT doc_id, entity, witness, lower(w[i]) AS term, regexp_matches(w[i], '{NAME}') AS name, coalesce(lower(w[i - 1]), '') AS l, coalesce(lower(w[i + 1]), '') AS r
                 FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM tok) WHERE w[i] <> '@'),
             ent AS (SELECT entity, count(DISTINCT doc_id) AS with_entity, count(DISTINCT witness) AS contexts FROM tok GROUP BY 1 HAVING log2((SELECT n FROM n) / count(DISTINCT doc_id)) >= 6),
             pairs AS (SELECT entity, term, count(DISTINCT doc_id) AS both_n, count(DISTINCT witness) AS witnesses, least(count(DISTINCT l), count(DISTINCT r)) AS free, bool_and(name) AS name FROM seen GROUP BY 1, 2),
             tried AS (SELECT entity, term, max(both_n) AS both_n, min(least_share) AS least_share FROM (
                 SELECT entity, term, both_n, CASE WHEN contexts < 3 THEN 0.98::DOUBLE ELSE 0.9::DOUBLE END AS least_share FROM pairs JOIN ent USING (entity)
                     WHERE witnesses >= least(3, contexts) AND (name OR free >= 3) AND (name OR contexts >= 3)
                 UNION ALL SELECT entity, unnest(list_distinct(regexp_extract_all(entity, '{SPELLED}'))), with_entity, 0.9::DOUBLE FROM ent) GROUP BY 1, 2),
             df AS (SELECT term, count(*) AS with_term FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) AS term FROM t) GROUP BY 1),
             told AS (SELECT entity, term, with_term > both_n AS wide FROM tried JOIN ent USING (entity) JOIN df USING (term), n
                 WHERE log2(both_n * n / (with_entity * with_term)) / log2(n / with_entity) >= least_share),
             own AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, lower(value) AS entity FROM base) JOIN told USING (entity)
                 UNION SELECT doc_id, term FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) AS term FROM t) WHERE term IN (SELECT term FROM told WHERE wide)),
             runs AS (SELECT doc_id, regexp_split_to_array(text, '[\p{{L}}\p{{M}}\p{{N}}]+') AS g, regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}]+') AS h FROM t WHERE doc_id IN (SELECT doc_id FROM own)),
             run AS (SELECT doc_id, h[i] AS value, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a
                 FROM (SELECT doc_id, g, h, unnest(range(1, len(h) + 1)) AS i FROM runs)),
             term AS (SELECT run.doc_id, a, a + length(value) AS b FROM run JOIN own ON own.doc_id = run.doc_id AND own.term = lower(value)
                 WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = run.doc_id AND base.a < run.a + length(run.value) AND run.a < base.b)),
             listed AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY ord, a) AS spans, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
                 count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone FROM base GROUP BY 1),
             terms AS (SELECT doc_id, string_agg('term:' || a || ':' || b, ',' ORDER BY a) AS spans, count(*) AS n FROM term GROUP BY 1)
        SELECT t.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
               sha256(coalesce(listed.spans, '')) AS base_sha256, concat_ws(',', listed.spans, terms.spans) AS spans, coalesce(terms.n, 0) AS n_terms
        FROM t LEFT JOIN listed ON listed.doc_id = t.doc_id LEFT JOIN terms ON terms.doc_id = t.doc_id""",
}
