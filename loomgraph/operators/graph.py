"""The code graph: edges, cycles, hotspots and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import paths as P
from loomgraph.operators.order import in_order
from loomgraph.shared import stored


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, import_path, target): the first candidate of each relative import that is a file; target is null for others."""
    tried = imports.select("path", "import_path").distinct().select("path", "import_path", F.posexplode_outer(P.import_candidates(F.col("path"), F.col("import_path"))).alias("prio", "candidate"))
    known = files.select(F.col("path").alias("candidate"), F.lit(True).alias("known")).distinct()
    return tried.join(known, "candidate", "left").groupBy("path", "import_path").agg(F.min_by("candidate", F.when(F.col("known"), F.col("prio"))).alias("hit"), F.max("known").alias("any")).select("path", "import_path", F.when(F.col("any"), F.col("hit")).alias("target"))


def import_edges(resolved: DataFrame) -> DataFrame:
    """(src, dst, type, weight): files that resolved imports join (weight 1), and external modules (weight 0.5), each once."""
    inner = resolved.where("target is not null").select(F.col("path").alias("src"), F.col("target").alias("dst"), F.lit("imports").alias("type"), F.lit(1.0).alias("weight"))
    outer = resolved.where("target is null").select(F.col("path").alias("src"), F.col("import_path").alias("dst"), F.lit("external").alias("type"), F.lit(0.5).alias("weight"))
    return inner.unionByName(outer).distinct()


def reference_edges(symbols: DataFrame) -> DataFrame:
    """(src, dst, ref): symbols whose signature names a type, to the symbol of that name with the smallest id; (symbol_id, name, signature) in."""
    refs = symbols.select(F.col("symbol_id").alias("src"), F.explode(P.type_references(F.col("signature"))).alias("ref"))
    named = symbols.groupBy("name").agg(F.min("symbol_id").alias("dst")).withColumnRenamed("name", "ref")
    return refs.join(named, "ref").where("src <> dst").select("src", "dst", "ref").distinct()


SCOPES = ("file", "import", "folder", "anywhere")


def resolve_references(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, path, name, dst, scope): each reference's symbol, the nearest of its name: in the same file, in a file that this one imports, in the same folder, or anywhere; of several the smallest id.

    ``refs`` has (src, path, name), ``symbols`` (symbol_id, name, path), ``imports`` (path, target); a reference to itself is none. For each scope, symbols come
    down to the two smallest ids of a name and place before any reference meets them, so names that stand in very many files cost
    no more than others. References without a symbol of their name have null for both; repeated ones count once.
    """
    folder = lambda c: F.regexp_extract(c, "^(.*/)?", 0)
    by_file = smallest_two(symbols.select("name", F.col("path").alias("place"), "symbol_id"), ["name", "place"])
    by_folder = smallest_two(symbols.select("name", folder("path").alias("place"), "symbol_id"), ["name", "place"])
    by_name = smallest_two(symbols.select("name", "symbol_id"), ["name"])
    r = refs.select("src", "path", "name").distinct()
    other = lambda c: F.filter(c, lambda x: ~x.eqNullSafe(F.col("src")))
    offer = lambda met, k: met.select("src", "path", "name", F.lit(k).alias("scope"), F.explode(other("ids")).alias("dst"))
    in_file = offer(r.withColumn("place", F.col("path")).join(by_file, ["name", "place"]), 0)
    reached = imports.select("path", F.col("target").alias("place")).where("path is not null and target is not null and path <> target").distinct()
    named = by_file.join(reached, "place").select("name", "path", F.explode("ids").alias("symbol_id"))  # symbols as each importing file sees them
    in_import = offer(r.join(smallest_two(named, ["name", "path"]), ["name", "path"]), 1)
    in_folder = offer(r.withColumn("place", folder("path")).join(by_folder, ["name", "place"]), 2)
    anywhere = offer(r.join(by_name, "name"), 3)
    best = in_file.unionByName(in_import).unionByName(in_folder).unionByName(anywhere).groupBy("src", "path", "name").agg(F.min(F.struct("scope", "dst")).alias("best"))
    key = F.col("r.src").eqNullSafe(F.col("b.src")) & F.col("r.path").eqNullSafe(F.col("b.path")) & (F.col("r.name") == F.col("b.name"))
    names = F.array(*map(F.lit, SCOPES))
    return r.alias("r").join(best.alias("b"), key, "left").select("r.src", "r.path", "r.name", F.col("b.best.dst").alias("dst"), F.get(names, F.col("b.best.scope")).alias("scope"))


def smallest_two(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ids): the two smallest ids of each key, for a reference may be the smallest itself; tasks leave out others before rows are moved."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("symbol_id"))
    return rows.distinct().withColumn("nth", nth).where("nth <= 2").groupBy(*keys).agg(F.sort_array(F.collect_list("symbol_id")).alias("ids"))


def call_count(symbols: DataFrame) -> DataFrame:
    is_call = F.col("type").isin("function", "method") & (F.col("signature").contains("=>") | F.col("signature").contains("return"))
    return symbols.agg(F.count_if(is_call).alias("calls"))


def hotspots(edges: DataFrame, least: float = 2.0) -> DataFrame:
    """(node, imports, references, score): outgoing edges plus twice the incoming; one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("inn")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("inn")))).alias("e"))
    sums = ends.groupBy("e.node").agg(F.sum("e.out").alias("imports"), F.sum("e.inn").alias("references"))
    return sums.withColumn("score", (F.col("imports") + 2 * F.col("references")).cast("double")).where(F.col("score") >= least)


def isolated(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Nodes at neither end of an edge."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias(node)).distinct()
    return nodes.join(touched, node, "left_anti")


def orphan_edges_removed(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    a, b = nodes.select(F.col(node).alias("src")), nodes.select(F.col(node).alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def contracted(edges: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (src, dst, chain, size) with chains as one edge each, the chains' nodes (chain, node, place), and rings (node, component).

    A chain is a longest row of nodes with one edge in and one out; ``size`` nodes stand between its edge's ends, in order of
    ``place``. Rows of such nodes that close on themselves are rings. Nodes in ``keep`` (node) are never put into a chain. Pointers are followed by
    doubling, so rounds grow with the logarithm of the longest chain. ``edges`` are distinct and without loops.
    """
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.min("dst").alias("succ"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.min("src").alias("pred"))
    middle = out.join(into, "node").where("n_out = 1 and n_in = 1").select("node", "pred", "succ")
    middle = stored(middle if keep is None else middle.join(keep.select("node").distinct(), "node", "left_anti"), "chains")
    inner = middle.select(F.col("node").alias("succ"), F.lit(True).alias("inner"))
    one = F.when(F.col("inner"), 1).otherwise(0)
    jumps = middle.join(inner, "succ", "left").select("node", F.when(F.col("inner"), F.col("succ")).otherwise(F.col("node")).alias("next"), one.cast("long").alias("hops"), F.col("inner").isNull().alias("ends"), F.least("node", F.when(F.col("inner"), F.col("succ"))).alias("low"))
    jumps = stored(jumps, "jumps")
    reach, n, before = 1, jumps.where("not ends").count(), -1
    while n and not (n == before and reach >= n):  # a chain that goes on has fewer left each round, so then all left are rings, and seen all round
        further = jumps.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("hops").alias("hops2"), F.col("ends").alias("ends2"), F.col("low").alias("low2"))
        jumps = stored(jumps.join(further, "next").select("node", F.col("next2").alias("next"), F.when(F.col("ends"), F.col("hops")).otherwise(F.col("hops") + F.col("hops2")).alias("hops"), (F.col("ends") | F.col("ends2")).alias("ends"), F.least("low", "low2").alias("low")), "jumps")
        reach, n, before = 2 * reach, jumps.where("not ends").count(), n
    rings = jumps.where("not ends").select("node", F.col("low").alias("component"))
    done = jumps.where("ends").select(F.col("next").alias("chain"), "node", "hops")
    sizes = done.groupBy("chain").agg((F.max("hops") + 1).alias("size"), F.max_by("node", "hops").alias("head"))
    members = done.join(sizes.select("chain", "size"), "chain").select("chain", "node", (F.col("size") - 1 - F.col("hops")).alias("place"))
    begins = sizes.join(middle.select(F.col("node").alias("head"), F.col("pred").alias("src")), "head")
    whole = begins.join(middle.select(F.col("node").alias("chain"), F.col("succ").alias("dst")), "chain").select("src", "dst", "chain", "size")
    rest = edges.join(middle.select(F.col("node").alias("src")), "src", "left_anti").join(middle.select(F.col("node").alias("dst")), "dst", "left_anti")
    none = F.lit(None).cast(edges.schema["src"].dataType)
    return stored(rest.select("src", "dst", none.alias("chain"), F.lit(0).cast("long").alias("size")).unionByName(whole), "contracted"), stored(members, "members"), rings


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges in and out, as a stored table; passes go on while each drops a twentieth of the edges, as labels part the rest."""
    left, n = edges, None
    while True:
        ends = left.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(False).alias("out")))))
        both = ends.groupBy("node").agg(F.max("out").alias("a"), F.min("out").alias("b")).where("a and not b").select("node")
        left = stored(left.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "scc-edges")
        before, n = n, left.count()
        if not n or before is not None and n > before * 0.95:
            return left


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt and sorted by ``keys`` and kept there, so that the joins of many rounds move only the other side; the caller lets go of them with ``unpersist``."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).persist()


def strongly_connected(edges: DataFrame, steps: int = 1) -> DataFrame:
    """(node, component) of nodes on cycles: components of more than one node, and self loops; the label is the smallest member.

    Nodes without edges in or out leave first, then chains are contracted, in rounds that grow with the logarithm of their length. Then labels spread from
    some nodes, the pivots, both ways in one loop: each node takes the greatest pivot that reaches it and the greatest that it reaches. Where both
    are the same, the node is in that pivot's component. These leave the graph, and so do edges between nodes that
    differ in either label, which no component can hold. Pivots are at first the thousandth of nodes with most ways through them, which mostly lie in the
    large components, then all nodes. Both directions are rows of one table that stays dealt by node, and only labels that changed in one step
    are sent on in the next; tables are written every ``steps`` steps. ``edges`` are worked out once. Null ends are left out.
    """
    known = stored(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "scc-known")
    loops = known.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    short, members, rings = contracted(trimmed(known.where("src <> dst")))
    found = _components(short.where("src <> dst").select("src", "dst").distinct(), steps)
    of = found.select(F.col("node").alias("at"), F.col("component").alias("c"))
    held = short.where("chain is not null").select("src", "dst", "chain")
    held = held.join(of.select(F.col("at").alias("src"), F.col("c").alias("c1")), "src", "left").join(of.select(F.col("at").alias("dst"), F.col("c").alias("c2")), "dst", "left")
    held = stored(held.where("src = dst or c1 = c2").select("chain", "src", F.coalesce("c1", "src").alias("component")), "scc-held")
    inner = members.join(held.select("chain", "component"), "chain").select("node", "component")
    alone = held.select(F.col("src").alias("node"), "component")  # a node whose chain leads back to it
    all_ = stored(found.unionByName(inner).unionByName(alone).unionByName(rings).distinct(), "scc-found")
    named = all_.join(all_.groupBy("component").agg(F.min("node").alias("least")), "component").select("node", F.col("least").alias("component"))
    return named.unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


#: Of so many nodes one is a pivot in the first round.
FEW = 1000
#: A label is a pivot's number, and in its lowest bits this less the step in which it came, so of equal numbers the earliest is the greatest.
LAST = (1 << 24) - 1


def _components(edges: DataFrame, steps: int) -> DataFrame:
    found = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    left, few = stored(edges, "scc-edges"), FEW
    while left.limit(1).count():
        ways = left.select(F.inline(F.array(F.struct(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(0).alias("way")), F.struct(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(1).alias("way")))))
        ways = spread_by(ways, "at", "way")
        try:
            both = stored(_labels(ways, few, steps), "scc-both")
        finally:
            ways.unpersist()
        done, few = both.where("above = below"), 1
        names = done.groupBy("above").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(done.join(names, "above").select("node", "component"))
        ends = [both.select(F.col("node").alias(c), F.struct("above", "below").alias(f"of_{c}")) for c in ("src", "dst")]
        apart = left.join(ends[0], "src", "left").join(ends[1], "dst", "left").where("of_src <=> of_dst and not coalesce(of_src.above = of_src.below, false)")
        left = trimmed(apart.select("src", "dst"))
    return stored(found, "scc-components")


def _labels(ways: DataFrame, few: int, steps: int) -> DataFrame:
    """(node, above, below): the greatest pivot that reaches each node and the greatest that it reaches, null where there is none; nodes with neither are left out."""
    through = ways.groupBy(F.col("at").alias("node")).agg((F.count_if(F.col("way") == 0) * F.count_if(F.col("way") == 1)).alias("through"))
    nodes = in_order(through, "through", "node")
    n = nodes.count()
    pivots = nodes.where(F.col("number") > n - -(-n // few))
    now, step = pivots.select("node", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), F.shiftleft("number", 24).bitwiseOR(F.lit(LAST)).alias("label")), 0
    new = lambda: now.where(F.col("label").bitwiseAND(F.lit(LAST)) == LAST - step)
    while step == 0 or new().limit(1).count():
        for _ in range(steps):
            offers = ways.join(new().withColumnRenamed("node", "at"), ["at", "way"]).select(F.col("to").alias("node"), "way", (F.col("label") - 1).alias("label"))
            now, step = now.unionByName(offers).groupBy("node", "way").agg(F.max("label").alias("label")), step + 1
        now = stored(now, "scc-labels")
    number = F.shiftright("label", 24)
    return now.groupBy("node").agg(F.max(F.when(F.col("way") == 0, number)).alias("above"), F.max(F.when(F.col("way") == 1, number)).alias("below"))


def cycle_paths(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, place, node): for each component one shortest cycle through its smallest node, from that node (place 0) on; its last node leads back to the first.

    ``components`` is what ``strongly_connected`` gives. Chains inside components are one edge each with their length. From each component's
    smallest node, distances spread along edges until none gets shorter, sent on only by nodes that got nearer; of equal ones the smallest predecessor counts. Then
    all cycles are followed back together, and chains are filled in. Rounds grow with the edges of such a cycle, chains counted as one.
    """
    label = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    inside = stored(edges.select("src", "dst").distinct().join(label("src"), "src").join(label("dst"), "dst").where("of_src = of_dst"), "inside")
    looped = stored(inside.where("src = dst and src = of_src").select(F.col("of_src").alias("component")), "looped")
    simple = stored(inside.where("src <> dst").join(looped.withColumnRenamed("component", "of_src"), "of_src", "left_anti").select("src", "dst"), "cycle-edges")
    starts = components.where("node = component").select("node")
    short, members, _ = contracted(simple, keep=starts)
    size = F.col("size") + 1
    hops = short.groupBy("src", "dst").agg(F.min(F.struct(size.alias("length"), "chain")).alias("best")).select("src", "dst", "best.length", "best.chain").join(label("src"), "src").withColumnRenamed("of_src", "component")
    hops = spread_by(stored(hops, "hops"), "src")
    try:
        known = stored(_distances(hops), "known")
    finally:
        hops.unpersist()
    at = stored(known.where("node = component"), "back")
    path = at
    while at.where("before <> component").limit(1).count():
        at = stored(known.join(at.where("before <> component").select("component", F.col("before").alias("node")), ["component", "node"]).select(*known.columns), "back")
        path = path.unionByName(at)
    path = stored(path.select("component", F.col("before").alias("node"), (F.col("distance") - F.col("length")).alias("place"), "chain"), "paths")
    inner = path.select("component", "chain", F.col("place").alias("from")).join(members, "chain").select("component", (F.col("from") + 1 + F.col("place")).alias("place"), "node")
    return path.select("component", "place", "node").unionByName(inner).unionByName(looped.select("component", F.lit(0).cast("long").alias("place"), F.col("component").alias("node")))


def _distances(hops: DataFrame) -> DataFrame:
    """(node, component, distance, before, length, chain): how far nodes are from their component's smallest, and the last hop of that way; what is farther than its cycle need not be there."""
    way = ["distance", "before", "length", "chain"]
    # the start itself is left out, so what comes back to it is the cycle
    known = stored(hops.where("src = component").select(F.col("dst").alias("node"), "component", F.col("length").alias("distance"), F.col("src").alias("before"), "length", "chain", F.lit(None).cast("long").alias("old")), "distances")
    while True:
        # only what got nearer is sent on; a start that is reached bounds its component: what is as far can't shorten its cycle
        reached = known.where("node = component").select("component", F.col("distance").alias("most"))
        nearer = known.where("node <> component and (old is null or distance < old)").join(reached, "component", "left").where("most is null or distance < most").select(F.col("node").alias("src"), "distance")
        if not nearer.limit(1).count():
            return known.drop("old")
        further = hops.join(nearer, "src").select(F.col("dst").alias("node"), "component", (F.col("distance") + F.col("length")).alias("distance"), F.col("src").alias("before"), "length", "chain", F.lit(None).cast("long").alias("old"))
        all_ = known.withColumn("old", F.col("distance")).unionByName(further)
        known = stored(all_.groupBy("node", "component").agg(F.min(F.struct(*way)).alias("best"), F.max("old").alias("old")).select("node", "component", "best.*", "old"), "distances")


def containing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, point, name): the innermost range of the same file that holds each point, ties by name; (path, point) and (path, name, start, end) in.

    Both sides are dealt by bins as wide as the mean range, so a file of very many points and ranges is spread over tasks, and ranges make
    three rows each on average. Points that no range holds are left out, as are ranges with a null or reversed end.
    """
    held = ranges.where("start <= end").select("path", "name", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    width = held.agg(F.coalesce(F.nullif(F.avg(F.col("end") - F.col("start")), F.lit(0.0)), F.lit(1.0)).alias("width"))
    bin_of = lambda c: F.floor(F.col(c) / F.col("width"))
    left = points.select("path", "point").distinct().crossJoin(F.broadcast(width)).withColumn("bin", bin_of("point"))
    right = held.crossJoin(F.broadcast(width)).select("path", "name", "start", "end", F.explode(F.sequence(bin_of("start"), bin_of("end"))).alias("bin"))
    found = left.join(right, ["path", "bin"]).where("point between start and end")
    return found.groupBy("path", "point").agg(F.min_by("name", F.struct(F.col("end") - F.col("start"), "name")).alias("name"))


def search(symbols: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Symbols whose name holds a text, whatever its case, in order of name and id."""
    return symbols.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("name", "symbol_id").limit(limit)


def symbol_info(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name)


def dependencies(edges: DataFrame, node, direction: str = "both") -> DataFrame:
    """(direction, other): what a node imports, what depends on it, or both."""
    out = edges.where(F.col("src") == node).select(F.lit("imports").alias("direction"), F.col("dst").alias("other"))
    back = edges.where(F.col("dst") == node).select(F.lit("dependents").alias("direction"), F.col("src").alias("other"))
    return {"imports": out, "dependents": back}.get(direction, out.unionByName(back))


def by_share(df: DataFrame, key: str | Column, count: str = "n") -> DataFrame:
    """Counts by a key with their percentage; the total is that of the counts, one row a key."""
    counts = df.groupBy(key).agg(F.count("*").alias(count))
    return counts.withColumn("percent", F.col(count) * 100.0 / F.sum(count).over(Window.partitionBy(F.lit(1))))
