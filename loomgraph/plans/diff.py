"""Queries of diffs and renames: parts as symbols, in two versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import similarity as S
from loomgraph.operators import diff as D
from loomgraph.operators import rename as R
from loomgraph.plans.relations import RETURN_SQL, return_edges, table
from loomgraph.shared import stored

SCORE = 0.45


def version(spark, d, new: bool):
    """Parts as symbols, fifty keys a file. The old version lacks keys divisible by 10, the new one those divisible by 7; keys divisible by 5 change."""
    p = table(spark, d, "part")
    changed = F.lit(new) & (F.col("p_partkey") % 5 == 0)
    args = F.when(changed & (F.col("p_partkey") % 15 == 0), "item: Item, size: number, note: string").when(changed, "item: Item").otherwise("item: Item, size: number")
    visibility = F.when(changed & (F.col("p_size") % 3 == 0), "private").when(F.col("p_size") % 4 == 0, "protected").otherwise("public")
    return p.where(F.col("p_partkey") % (7 if new else 10) != 0).select(
        F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.concat(F.lit("make("), args, F.lit("): "), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("signature"),
        F.element_at(F.split("p_name", " "), 2).alias("kind"), visibility.alias("visibility"), (F.col("p_size") + F.when(changed, 3).otherwise(0)).cast("long").alias("size"),
        (F.col("p_partkey") % 50).alias("line"), F.when(changed, F.concat("p_type", F.lit(" changed"))).otherwise(F.col("p_type")).alias("doc"), F.floor(F.col("p_partkey") / 50).alias("path"),
    )


COMPARED = ["signature", "visibility", "doc", "size"]


def the_diff(spark, d):
    return D.snapshot_diff(version(spark, d, False), version(spark, d, True), "id", COMPARED)


def snapshot_diff(spark, d):
    return the_diff(spark, d).groupBy("change").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def property_changes(spark, d):
    return D.property_changes(the_diff(spark, d), "id", COMPARED)


def semantic_changes(spark, d):
    return D.semantic_changes(the_diff(spark, d), "id")


def breaking_changes(spark, d):
    return semantic_changes(spark, d).where("breaking").groupBy("kind", "impact").agg(F.count("*").alias("n"))


def complexity_metrics(spark, d):
    paths = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"))
    return D.complexity_metrics(semantic_changes(spark, d).join(paths, "id"), "path").withColumn("complexity", F.round("complexity", 6))


def structural_changes(spark, d):
    """Changes of size and complexity of modified symbols, and of counts by kind."""
    a = version(spark, d, False).select("id", F.col("size").alias("old_size"), D.complexity(F.col("signature"), F.col("size")).alias("old_complexity"))
    b = version(spark, d, True).select("id", F.col("size").alias("new_size"), D.complexity(F.col("signature"), F.col("size")).alias("new_complexity"))
    both = a.join(b, "id")
    return both.select("id", (F.col("new_size") - F.col("old_size")).alias("size_delta"), (F.col("new_complexity") - F.col("old_complexity")).alias("complexity_delta")).where("size_delta <> 0 or complexity_delta <> 0").select("*", D.size_impact(F.col("size_delta") * 10).alias("size_impact"), D.complexity_impact(F.col("complexity_delta") * 6).alias("complexity_impact"))


def impact_levels(spark, d):
    a = version(spark, d, False).groupBy("kind").agg(F.count("*").alias("was"))
    b = version(spark, d, True).groupBy("kind").agg(F.count("*").alias("now"))
    joined = a.join(b, "kind")
    delta = F.col("now") - F.col("was")
    return joined.select("kind", "was", "now", D.count_impact(F.when(F.col("kind").isin("gear", "widget"), "class").otherwise("function"), delta).alias("impact"))


def name_pairs(spark, d):
    """Pairs of distinct part names of one kind (their second word)."""
    n = table(spark, d, "part").select(F.col("p_name").alias("name"), F.element_at(F.split("p_name", " "), 2).alias("kind")).distinct()
    return n.select(F.col("name").alias("a"), "kind").join(n.select(F.col("name").alias("b"), "kind"), "kind").where("a < b").select("a", "b")


def edit_sim(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(S.edit_similarity(F.col("a"), F.col("b")), 6).alias("edit"))


def char_jaccard(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(S.char_jaccard(F.col("a"), F.col("b")), 6).alias("chars"))


def common_substring(spark, d):
    return name_pairs(spark, d).select("a", "b", S.common_substring(F.col("a"), F.col("b")).alias("common"), F.round(S.substring_score(F.col("a"), F.col("b")), 6).alias("score"))


def camel_similarity(spark, d):
    camel = lambda c: F.concat(F.lower(F.substring(F.initcap(c), 1, 1)), F.substring(F.replace(F.initcap(c), F.lit(" "), F.lit("")), 2, 100))
    return name_pairs(spark, d).select("a", "b", F.round(S.camel_similarity(camel("a"), camel("b")), 6).alias("camel"))


def name_similarity(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(S.name_similarity(F.col("a"), F.col("b")), 5).alias("similarity"))


def signature_similarity(spark, d):
    a = version(spark, d, False).select("id", F.col("signature").alias("a"))
    b = version(spark, d, True).select("id", F.col("signature").alias("b"))
    return a.join(b, "id").select("id", F.round(S.signature_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def location_similarity(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("other")).agg(F.count("*").alias("n")).select("line", "other", "n", F.round(S.location_similarity(F.col("line"), F.col("other")), 6).alias("similarity"))


def doc_similarity(spark, d):
    """Neighbouring turns of conversations: overlap of their words, and how well each is worded."""
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return c.select("conv_id", "turn", F.col("text").alias("a")).join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(S.word_jaccard(F.col("a"), F.col("b")), 6).alias("overlap"), S.doc_quality(F.col("a")).alias("quality"))


def symbol_versions(spark, d):
    """Deleted and added symbols: those of one version only, the new ones with a word of their name changed."""
    old, new = version(spark, d, False), version(spark, d, True)
    gone = old.join(new, "id", "left_anti")
    come = new.join(old, "id", "left_anti").withColumn("name", F.replace("name", F.lit("d_"), F.lit("dNew_")))
    return gone, come


def rename_candidates(spark, d):
    gone, come = symbol_versions(spark, d)
    scored = R.score_candidates(R.candidates(gone, come)).where(F.col("score") >= SCORE)
    return scored.groupBy("old_kind").agg(F.count("*").alias("pairs"), F.round(F.avg("score"), 4).alias("score"), F.round(F.avg("confidence"), 4).alias("confidence"), F.round(F.avg("h_affix"), 4).alias("affix"), F.round(F.avg("h_refactoring"), 4).alias("refactoring"))


def rename_match(spark, d):
    gone, come = symbol_versions(spark, d)
    return R.detect_renames(gone, come, SCORE).select("old_id", "new_id", F.round("score", 6).alias("score"), "type", "risk")


def rename_pairs(spark, d):
    """One-to-one matching of deleted and added symbols of a file by the edit similarity of their names."""
    gone, come = symbol_versions(spark, d)
    pairs = R.candidates(gone, come).select("old_id", "new_id", F.round(S.edit_similarity(F.col("old_name"), F.col("new_name")), 6).alias("score")).where("score >= 0.8")
    return R.one_to_one(pairs)


def dependency_changes(spark, d):
    """Links of pages of even ids against those of odd ids, by host of the page."""
    links = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    rows = lambda r: links.where(F.col("page_id") % 2 == r).select("source", "target", (~F.col("target").startswith("/")).alias("external"))
    return D.dependency_changes(rows(0), rows(1))


def lines_of_orders(spark, d, new: bool):
    """Orders as files that import their lines' brands in order; the new version ranks lines of odd orders by quantity. Returned lines are imported for their side effects."""
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    place = F.when(F.lit(new) & (F.col("l_orderkey") % 2 == 1), F.col("l_quantity")).otherwise(F.col("l_linenumber"))
    return table(spark, d, "lineitem").join(brands, "l_partkey").select(F.col("l_orderkey").alias("source"), F.col("p_brand").alias("target"), place.cast("double").alias("position"), (F.col("l_returnflag") == "R").alias("side_effect"))


def import_order_changes(spark, d):
    found = D.import_order_changes(lines_of_orders(spark, d, False), lines_of_orders(spark, d, True))
    return found.select("source", F.array_join("old_order", ",").alias("old_order"), F.array_join("new_order", ",").alias("new_order"), "impact")


def cycle_risks(spark, d):
    """Cycles of parts that a version brings which has all dependencies, over one that lacks those of ids summing to a multiple of four."""
    edges = stored(return_edges(spark, d).select(F.col("src").alias("source"), F.col("dst").alias("target")), "edges")
    return D.cycle_risks(edges.where("(source + target) % 4 <> 0"), edges)


QUERIES = {f.__name__: f for f in (snapshot_diff, property_changes, semantic_changes, breaking_changes, complexity_metrics, structural_changes, impact_levels, edit_sim, char_jaccard, common_substring, camel_similarity, name_similarity, signature_similarity, location_similarity, doc_similarity, rename_candidates, rename_match, rename_pairs, dependency_changes, import_order_changes, cycle_risks)}


def _version_sql(name: str, new: bool) -> str:
    changed = "p_partkey % 5 = 0" if new else "false"
    return f"""{name} AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, 'make(' || CASE WHEN {changed} AND p_partkey % 15 = 0 THEN 'item: Item, size: number, note: string' WHEN {changed} THEN 'item: Item' ELSE 'item: Item, size: number' END || '): ' || replace(p_brand, '#', '') AS signature,
        string_split(p_name, ' ')[2] AS kind, CASE WHEN {changed} AND p_size % 3 = 0 THEN 'private' WHEN p_size % 4 = 0 THEN 'protected' ELSE 'public' END AS visibility, (p_size + CASE WHEN {changed} THEN 3 ELSE 0 END)::BIGINT AS size,
        p_type || CASE WHEN {changed} THEN ' changed' ELSE '' END AS doc, p_brand AS brand, p_partkey // 50 AS path FROM part WHERE p_partkey % {7 if new else 10} <> 0)"""


VERSIONS = f"{_version_sql('o', False)}, {_version_sql('n', True)}"
CHANGES = f"""{VERSIONS}, j AS (SELECT coalesce(o.id, n.id) AS id, o.id AS oid, n.id AS nid, o.signature AS os, n.signature AS ns, o.visibility AS ov, n.visibility AS nv, o.doc AS od, n.doc AS nd, o.size AS oz, n.size AS nz FROM o FULL JOIN n ON o.id = n.id),
    rank AS (SELECT * FROM (VALUES ('private', 0), ('protected', 1), ('public', 2)) t(v, k)),
    args AS (SELECT *, length(os) - length(replace(os, ',', '')) AS oc, length(ns) - length(replace(ns, ',', '')) AS nc FROM j),
    sem AS (SELECT id, 'addition' AS kind, CASE WHEN nv = 'public' THEN 'medium' ELSE 'low' END AS impact, false AS breaking FROM args WHERE oid IS NULL
        UNION ALL SELECT id, 'deletion', CASE ov WHEN 'public' THEN 'high' WHEN 'protected' THEN 'medium' ELSE 'low' END, ov = 'public' FROM args WHERE nid IS NULL
        UNION ALL SELECT id, 'signature', 'high', true FROM args WHERE os <> ns
        UNION ALL SELECT id, 'visibility', CASE WHEN b.k < a.k THEN 'high' ELSE 'low' END, b.k < a.k FROM args JOIN rank a ON a.v = ov JOIN rank b ON b.v = nv WHERE ov <> nv
        UNION ALL SELECT id, 'documentation', 'low', false FROM args WHERE od <> nd)"""
NAMES = """nm AS (SELECT DISTINCT p_name AS name, string_split(p_name, ' ')[2] AS kind FROM part), np AS (SELECT x.name AS a, y.name AS b FROM nm x JOIN nm y ON x.kind = y.kind AND x.name < y.name),
    longest AS (SELECT a, b, list_max(list_transform(range(1, length(a)::BIGINT + 1), lambda i: list_max(list_transform(range(0, length(a)::BIGINT - i + 2), lambda n: CASE WHEN contains(b, substr(a, i, n)) THEN n ELSE 0 END)))) AS common FROM np),
    sims AS (SELECT a, b, common, 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) AS edit,
        length(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, ''))))::DOUBLE / length(list_distinct(list_concat(string_split(a, ''), string_split(b, '')))) AS chars,
        common::DOUBLE / greatest(length(a), length(b)) AS sub, (CASE WHEN string_split(a, ' ')[1] = string_split(b, ' ')[1] THEN 1 ELSE 0 END + 1) / 2.0::DOUBLE AS camel FROM longest)"""
def _quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PARTS = "list_filter(regexp_split_to_array(lower(replace(regexp_replace({0}, '([^A-Z _])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), ' +'), lambda w: w <> '')"
_CHARS = "list_distinct(list_filter(string_split({0}, ''), lambda c: c <> ''))"
_WORDS = "list_filter(list_distinct(regexp_split_to_array(lower({0}), '\\s+')), lambda w: w <> '')"
_JACCARD = "CASE WHEN length(list_distinct(list_concat({0}, {1}))) = 0 THEN 0 ELSE length(list_intersect({0}, {1}))::DOUBLE / length(list_distinct(list_concat({0}, {1}))) END"
_KNOWN = " OR ".join(f"(contains(x, '{long}') AND replace(x, '{long}', '{short}') = y) OR (contains(y, '{long}') AND replace(y, '{long}', '{short}') = x)" for long, short in R.ABBREVIATIONS.items())
_CONVENTION = " OR ".join(f"(regexp_matches(b, '{c}') AND NOT regexp_matches(a, '{c}'))" for c in R.CONVENTIONS)
RENAMES = f"""{VERSIONS}, lines AS (SELECT p_partkey AS id, p_partkey % 50 AS line FROM part), gone AS (SELECT o.*, line FROM o JOIN lines USING (id) WHERE id NOT IN (SELECT id FROM n)),
    come AS (SELECT n.* REPLACE (replace(name, 'd_', 'dNew_') AS name), line FROM n JOIN lines USING (id) WHERE id NOT IN (SELECT id FROM o)),
    nn AS (SELECT DISTINCT g.name AS a, c.name AS b, lower(g.name) AS x, lower(c.name) AS y FROM gone g JOIN come c USING (kind, path)),
    np1 AS (SELECT *, {_PARTS.format('a')} AS pa, {_PARTS.format('b')} AS pb, {_CHARS.format('a')} AS ca, {_CHARS.format('b')} AS cb, {_CHARS.format('x')} AS cx, {_CHARS.format('y')} AS cy,
        coalesce(list_max(list_transform(range(1, length(a)::BIGINT + 1), lambda i: list_max(list_transform(range(0, length(a)::BIGINT - i + 2), lambda k: CASE WHEN contains(b, substr(a, i, k)) THEN k ELSE 0 END)))), 0) AS common FROM nn),
    np2 AS (SELECT *, list_sum(list_transform(range(1, greatest(length(pa), length(pb))::BIGINT + 1), lambda i: CASE WHEN pa[i] = pb[i] THEN 1 ELSE 0 END))::DOUBLE / greatest(length(pa), length(pb)) AS camel, length(list_intersect(pa, pb)) AS shared, least(length(pa), length(pb)) AS short FROM np1),
    names2 AS (SELECT a, b, 0.3::DOUBLE * (1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))) + 0.3::DOUBLE * ({_JACCARD.format('ca', 'cb')}) + 0.2::DOUBLE * common / greatest(length(a), length(b)) + 0.2::DOUBLE * camel AS s_name,
        CASE WHEN shared > 0.7 * short AND length(pa) <> length(pb) THEN 0.8 WHEN short > 0 AND shared >= 0.5 * short AND camel < 1 THEN 0.7 WHEN length(pa) = length(pb) AND camel > 0.6 THEN camel ELSE 0 END AS h_camel,
        CASE WHEN list_contains(list_transform({_quoted(R.PREFIXES)}, lambda p: p || y), x) OR list_contains(list_transform({_quoted(R.PREFIXES)}, lambda p: p || x), y)
            OR list_contains(list_transform({_quoted(R.SUFFIXES)}, lambda p: y || p), x) OR list_contains(list_transform({_quoted(R.SUFFIXES)}, lambda p: x || p), y) THEN 0.9
            WHEN x <> y AND (starts_with(x, y) OR starts_with(y, x) OR ends_with(x, y) OR ends_with(y, x)) THEN 0.7 ELSE 0 END AS h_affix,
        CASE WHEN {_KNOWN} THEN 0.9 WHEN (length(y) >= 2 AND length(y) < 0.6 * length(x) AND length(list_intersect(cx, cy)) > 0.6 * length(cx)) OR (length(x) >= 2 AND length(y) > 1.5 * length(x) AND length(list_intersect(cx, cy)) > 0.6 * length(cx)) THEN 0.7 ELSE 0 END AS h_abbreviation,
        greatest(CASE WHEN regexp_matches(y, '{"|".join(R.CLARITY)}') THEN 0.6 ELSE 0 END, CASE WHEN length(b) > 1.3 * length(a) AND length(regexp_replace(b, '[^A-Z]', '', 'g')) > length(regexp_replace(a, '[^A-Z]', '', 'g')) THEN 0.7 ELSE 0 END, CASE WHEN {_CONVENTION} THEN 0.8 ELSE 0 END) AS h_refactoring FROM np2),
    lvl AS (SELECT * FROM (VALUES ('private', 0), ('protected', 1), ('public', 2)) t(v, k)),
    pr AS (SELECT g.id AS old_id, c.id AS new_id, g.kind AS old_kind, names2.* EXCLUDE (a, b), 0.7::DOUBLE * CASE WHEN length(replace(g.signature, ',', '')) - length(g.signature) = length(replace(c.signature, ',', '')) - length(c.signature) THEN 1
            ELSE 0.5::DOUBLE * least(length(string_split(g.signature, ',')), length(string_split(c.signature, ','))) / greatest(length(string_split(g.signature, ',')), length(string_split(c.signature, ','))) END + 0.3::DOUBLE * (g.brand = c.brand)::INT AS s_signature,
        0.4::DOUBLE + 0.3::DOUBLE * (1 - abs(lg.k - lc.k) / 2.0::DOUBLE) + 0.3::DOUBLE * CASE WHEN greatest(g.size, c.size) = 0 THEN 1 ELSE least(g.size, c.size)::DOUBLE / greatest(g.size, c.size) END AS s_structure,
        exp(-abs(g.line - c.line) / 20.0::DOUBLE) AS s_location, {_WORDS.format('g.doc')} AS wa, {_WORDS.format('c.doc')} AS wb,
        CASE WHEN g.signature <> c.signature THEN 'signature' WHEN abs(g.line - c.line) > 10 THEN 'move' WHEN abs(g.size - c.size) > 5 THEN 'refactoring' WHEN g.doc <> c.doc AND g.visibility <> c.visibility THEN 'complex' ELSE 'simple' END AS type
        FROM gone g JOIN come c USING (kind, path) JOIN names2 ON a = g.name AND b = c.name JOIN lvl lg ON lg.v = g.visibility JOIN lvl lc ON lc.v = c.visibility),
    sc1 AS (SELECT *, list_filter(wa, lambda w: length(w) > 3 AND NOT list_contains({_quoted(S.STOP_WORDS)}, w)) AS ka, list_filter(wb, lambda w: length(w) > 3 AND NOT list_contains({_quoted(S.STOP_WORDS)}, w)) AS kb FROM pr),
    sc2 AS (SELECT *, 0.5::DOUBLE * ({_JACCARD.format('wa', 'wb')}) + 0.5::DOUBLE * ({_JACCARD.format('ka', 'kb')}) AS s_doc, 0.3::DOUBLE * s_location AS h_context FROM sc1),
    sc3 AS (SELECT *, [s_name, s_signature, s_structure, s_location, s_doc, 0.5::DOUBLE, h_camel, h_affix, h_abbreviation, h_refactoring, h_context] AS every FROM sc2),
    scored AS (SELECT *, 0.6::DOUBLE * (s_name + s_signature * 1.2::DOUBLE + s_structure * 0.8::DOUBLE + s_location * 0.5::DOUBLE + s_doc * 0.6::DOUBLE + 0.5::DOUBLE * 0.9::DOUBLE) / 5.0::DOUBLE
        + 0.4::DOUBLE * (h_camel * 0.8::DOUBLE + h_affix * 0.7::DOUBLE + h_abbreviation * 0.8::DOUBLE + h_refactoring * 0.9::DOUBLE + h_context * 0.6::DOUBLE) / 3.8::DOUBLE AS score, 1 - least(list_var_pop(every), 1) AS confidence FROM sc3)"""
ORACLES = {
    "rename_candidates": f"""WITH {RENAMES} SELECT old_kind, count(*) AS pairs, round(avg(score), 4) AS score, round(avg(confidence), 4) AS confidence, round(avg(h_affix), 4)::DOUBLE AS affix, round(avg(h_refactoring), 4)::DOUBLE AS refactoring
        FROM scored WHERE score >= {SCORE} GROUP BY 1""",
    "rename_match": f"""WITH RECURSIVE {RENAMES}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, old_id, new_id) AS k FROM scored WHERE score >= {SCORE} AND confidence >= 0.5),
        g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS olds, []::BIGINT[] AS news, []::BIGINT[] AS ks UNION ALL
            SELECT r.k, CASE WHEN list_contains(olds, old_id) OR list_contains(news, new_id) THEN olds ELSE list_append(olds, old_id) END, CASE WHEN list_contains(olds, old_id) OR list_contains(news, new_id) THEN news ELSE list_append(news, new_id) END,
                CASE WHEN list_contains(olds, old_id) OR list_contains(news, new_id) THEN ks ELSE list_append(ks, r.k) END FROM g JOIN r ON r.k = g.k + 1)
        SELECT old_id, new_id, round(score, 6) AS score, type, CASE WHEN confidence < 0.6 OR score < 0.7 THEN 'high' WHEN confidence < 0.8 OR score < 0.85 THEN 'medium' ELSE 'low' END AS risk
        FROM r WHERE k IN (SELECT unnest(ks) FROM (SELECT * FROM g ORDER BY k DESC LIMIT 1))""",
    "snapshot_diff": f"WITH {CHANGES}, c AS (SELECT id, CASE WHEN oid IS NULL THEN 'added' WHEN nid IS NULL THEN 'removed' WHEN os <> ns OR ov <> nv OR od <> nd OR oz <> nz THEN 'modified' END AS change FROM j) SELECT change, count(*) AS n, sum(id)::BIGINT AS ids FROM c WHERE change IS NOT NULL GROUP BY 1",
    "property_changes": f"""WITH {CHANGES}, p AS (SELECT id, 'signature' AS property, os AS old, ns AS new FROM j WHERE oid IS NOT NULL AND nid IS NOT NULL UNION ALL SELECT id, 'visibility', ov, nv FROM j WHERE oid IS NOT NULL AND nid IS NOT NULL
        UNION ALL SELECT id, 'doc', od, nd FROM j WHERE oid IS NOT NULL AND nid IS NOT NULL UNION ALL SELECT id, 'size', oz::VARCHAR, nz::VARCHAR FROM j WHERE oid IS NOT NULL AND nid IS NOT NULL) SELECT * FROM p WHERE old <> new""",
    "semantic_changes": f"WITH {CHANGES} SELECT * FROM sem",
    "breaking_changes": f"WITH {CHANGES} SELECT kind, impact, count(*) AS n FROM sem WHERE breaking GROUP BY 1, 2",
    "complexity_metrics": f"""WITH {CHANGES} SELECT p_brand AS path, count(*) FILTER (kind = 'addition') AS additions, count(*) FILTER (kind = 'deletion') AS deletions, count(*) FILTER (kind NOT IN ('addition', 'deletion')) AS modifications,
        round(avg(CASE impact WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END), 6) AS complexity FROM sem JOIN part ON p_partkey = id GROUP BY 1""",
    "structural_changes": f"""WITH {CHANGES}, k AS (SELECT id, nz - oz AS size_delta, ((1 + nc + floor(nz / 10.0)) - (1 + oc + floor(oz / 10.0)))::BIGINT AS complexity_delta FROM args WHERE oid IS NOT NULL AND nid IS NOT NULL)
        SELECT *, CASE WHEN abs(size_delta * 10) > 100 THEN 'high' WHEN abs(size_delta * 10) > 20 THEN 'medium' ELSE 'low' END AS size_impact, CASE WHEN complexity_delta * 6 > 10 THEN 'high' WHEN complexity_delta * 6 > 5 THEN 'medium' ELSE 'low' END AS complexity_impact FROM k WHERE size_delta <> 0 OR complexity_delta <> 0""",
    "impact_levels": f"""WITH {VERSIONS}, a AS (SELECT kind, count(*) AS was FROM o GROUP BY 1), b AS (SELECT kind, count(*) AS now FROM n GROUP BY 1)
        SELECT kind, was, now, CASE WHEN kind IN ('gear', 'widget') AND now <> was THEN 'medium' WHEN kind NOT IN ('gear', 'widget') AND abs(now - was) > 5 THEN 'medium' ELSE 'low' END AS impact FROM a JOIN b USING (kind)""",
    "edit_sim": f"WITH {NAMES} SELECT a, b, round(edit, 6) AS edit FROM sims",
    "char_jaccard": f"WITH {NAMES} SELECT a, b, round(chars, 6) AS chars FROM sims",
    "common_substring": f"WITH {NAMES} SELECT a, b, common::INTEGER AS common, round(sub, 6) AS score FROM sims",
    "camel_similarity": f"WITH {NAMES} SELECT a, b, round(camel, 6) AS camel FROM sims",
    "name_similarity": f"WITH {NAMES} SELECT a, b, round(0.3::DOUBLE * edit + 0.3::DOUBLE * chars + 0.2::DOUBLE * sub + 0.2::DOUBLE * camel, 5) AS similarity FROM sims",
    "signature_similarity": f"""WITH {CHANGES} SELECT id, round(0.7::DOUBLE * CASE WHEN oc = nc THEN 1 ELSE 0.5::DOUBLE * (least(oc, nc) + 1) / (greatest(oc, nc) + 1) END + 0.3::DOUBLE, 6) AS similarity FROM args WHERE oid IS NOT NULL AND nid IS NOT NULL""",
    "location_similarity": "SELECT l_linenumber AS line, l_quantity AS other, count(*) AS n, round(exp(-abs(l_linenumber - l_quantity) / 20.0::DOUBLE), 6) AS similarity FROM lineitem GROUP BY 1, 2",
    "doc_similarity": r"""WITH w AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda x: x <> '') AS w FROM conversations)
        SELECT a.conv_id, a.turn, round(CASE WHEN length(list_distinct(list_concat(a.w, b.w))) = 0 THEN 0 ELSE length(list_intersect(a.w, b.w))::DOUBLE / length(list_distinct(list_concat(a.w, b.w))) END, 6) AS overlap,
        CASE WHEN length(a.w) = 0 THEN 'none' WHEN length(a.w) < 5 THEN 'minimal' WHEN length(a.w) < 20 THEN 'basic' ELSE 'comprehensive' END AS quality FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "dependency_changes": """WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
        o AS (SELECT DISTINCT source, target FROM l WHERE page_id % 2 = 0), n AS (SELECT DISTINCT source, target FROM l WHERE page_id % 2 = 1),
        c AS (SELECT coalesce(o.source, n.source) AS source, coalesce(o.target, n.target) AS target, CASE WHEN o.source IS NULL THEN 'added' WHEN n.source IS NULL THEN 'removed' END AS change FROM o FULL JOIN n ON o.source = n.source AND o.target = n.target)
        SELECT source, target, change, CASE WHEN change = 'added' THEN CASE WHEN starts_with(target, '/') THEN 'low' ELSE 'medium' END ELSE CASE WHEN starts_with(target, '/') THEN 'medium' ELSE 'high' END END AS impact FROM c WHERE change IS NOT NULL""",
    "import_order_changes": """WITH l AS (SELECT l_orderkey AS source, p_brand AS target, l_linenumber::DOUBLE AS was, CASE WHEN l_orderkey % 2 = 1 THEN l_quantity ELSE l_linenumber END::DOUBLE AS now, l_returnflag = 'R' AS side FROM lineitem JOIN part ON p_partkey = l_partkey),
        o AS (SELECT source, string_agg(target, ',' ORDER BY was, target) AS old_order, string_agg(target, ',' ORDER BY now, target) AS new_order, bool_or(side) AS matters FROM l GROUP BY 1)
        SELECT source, old_order, new_order, 'low' AS impact FROM o WHERE matters AND old_order <> new_order""",
    "cycle_risks": f"""WITH RECURSIVE {RETURN_SQL}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
        scc AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
        added AS (SELECT x.component, count(*) AS added FROM edges JOIN scc x ON x.node = src JOIN scc y ON y.node = dst WHERE x.component = y.component AND (src + dst) % 4 = 0 GROUP BY 1)
        SELECT component, files, added, 'high' AS impact FROM (SELECT component, count(*) AS files FROM scc GROUP BY 1) JOIN added USING (component)""",
    "rename_pairs": f"""WITH RECURSIVE {VERSIONS}, gone AS (SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)), come AS (SELECT *, replace(name, 'd_', 'dNew_') AS renamed FROM n WHERE id NOT IN (SELECT id FROM o)),
        p AS (SELECT gone.id AS old_id, come.id AS new_id, round(1 - levenshtein(gone.name, renamed)::DOUBLE / greatest(length(gone.name), length(renamed)), 6) AS score FROM gone JOIN come USING (kind, path)),
        r AS (SELECT *, row_number() OVER (ORDER BY score DESC, old_id, new_id) AS k FROM p WHERE score >= 0.8),
        g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS olds, []::BIGINT[] AS news, []::DOUBLE[] AS scores UNION ALL
            SELECT r.k, CASE WHEN list_contains(olds, old_id) OR list_contains(news, new_id) THEN olds ELSE list_append(olds, old_id) END,
                CASE WHEN list_contains(olds, old_id) OR list_contains(news, new_id) THEN news ELSE list_append(news, new_id) END,
                CASE WHEN list_contains(olds, old_id) OR list_contains(news, new_id) THEN scores ELSE list_append(scores, score) END FROM g JOIN r ON r.k = g.k + 1)
        SELECT unnest(olds) AS old_id, unnest(news) AS new_id, unnest(scores) AS score FROM (SELECT * FROM g ORDER BY k DESC LIMIT 1)""",
}
