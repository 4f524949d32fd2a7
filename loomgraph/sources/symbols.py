"""Symbols and imports of source files: a scan for comments and strings, then rules on declarations' heads.

A scan puts blanks in place of comments and of what strings hold, each of its length, so that neither is
taken for code and places stay. A head is a line with those that its brackets, or the words that the next line begins with, add to it,
however many; braces, or indents in Python, tell where a declaration ends. Lines are rows, and depths of brackets are running sums
over them: where a head or a declaration ends is the next line whose depth is at most that at its start, which is looked
up for all at once. So the work is in proportion to the lines, times how deep they nest. Paths are taken to be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import paths as P
from loomgraph.shared import stored

NAME = r"([A-Za-z_$][A-Za-z0-9_$]*)"
_TEXT = r""""[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"""
#: What a scan takes as one piece: comments, strings, and what lies between.
SCAN = r"//[^\n]*+|/\*(?s:.*?)\*/|`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`|" + _TEXT + r"""|[^/"'`]++|."""
SCANS = {
    "python": r"#[^\n]*+|" + r'"{3}(?s:.*?)"{3}|' + r"'{3}(?s:.*?)'{3}|" + _TEXT + r"""|[^#"']++|.""",
    "rust": r"""//[^\n]*+|/\*(?s:.*?)\*/|"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"|'(?:\\.[^'\n]*+|[^'\\\n])'|[^/"']++|.""",
}
COMMENT, STRING = r"^(?://|/\*|#)", r"""^(["'`])(?s:.*)\1$"""
#: What a line begins with that goes on with the head before it, and what shows that a brace within parentheses opens a body.
GOES_ON = r"^\s*(?:\{|extends\b|implements\b|throws\b|where\b|:|=>|->)"
BODY = r"(?:\)|=>)\s*$"
#: For each language what a line declares, in order of preference; group 1 is the name.
SCRIPT_RULES = [
    ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{NAME}"),
    ("interface", rf"^\s*(?:export\s+)?(?:default\s+)?interface\s+{NAME}"),
    ("type", rf"^\s*(?:export\s+)?type\s+{NAME}\s*(?:<[^=]*>)?="),
    ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{NAME}"),
    ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+{NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"),
    ("variable", rf"^\s*(?:export\s+)?(?:const|let|var)\s+{NAME}"),
    ("namespace", rf"^\s*export\s+(?:declare\s+)?(?:namespace|module)\s+{NAME}"),
    ("method", rf"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|return\b|catch\b){NAME}\s*\("),  # and a body after its brackets, see METHOD
]
METHOD = r"(?s)\)\s*(?::.*)?$"
RULES = {
    "typescript": SCRIPT_RULES,
    "javascript": SCRIPT_RULES,
    "python": [("class", rf"^\s*class\s+{NAME}"), ("function", rf"^\s*(?:async\s+)?def\s+{NAME}"), ("variable", rf"^{NAME}\s*(?::[^=]+)?=[^=]")],
    "java": [("class", rf"^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*class\s+{NAME}"), ("interface", rf"^\s*(?:public\s+)?interface\s+{NAME}"), ("method", rf"^\s+(?:public|private|protected)\s+(?:static\s+|final\s+)*[\w<>\[\], ]+\s+{NAME}\s*\("), ("variable", rf"^\s+(?:public|private|protected)\s+(?:static\s+|final\s+)*[\w<>\[\]]+\s+{NAME}\s*[=;]")],
    "go": [("method", rf"^func\s+\([^)]*\)\s*{NAME}"), ("function", rf"^func\s+{NAME}"), ("type", rf"^type\s+{NAME}"), ("variable", rf"^var\s+{NAME}")],
    "rust": [("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+{NAME}"), ("class", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{NAME}"), ("class", rf"^\s*impl(?:<[^>]*>)?\s+{NAME}"), ("type", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{NAME}"), ("interface", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{NAME}")],
}
IMPORTS = {
    "typescript": r"""^\s*import\s+(?:(?:[^'"]+)\s+from\s+)?['"]([^'"]+)['"]""",
    "javascript": r"""^\s*(?:import\s+(?:(?:[^'"]+)\s+from\s+)?|(?:const|let|var)\s+[^=]+=\s*require\()['"]([^'"]+)['"]""",
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+[\w.]+)",
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;",
    "go": r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"\s*$""",
    "rust": r"^\s*use\s+([\w:]+)",
}


def pieces(language: Column, content: Column) -> Column:
    """A text's pieces in order: comments, strings, and what lies between; set end to end they are the text."""
    out = F.regexp_extract_all(content, F.lit(SCAN), F.lit(0))
    for lang, pattern in SCANS.items():
        out = F.when(language == lang, F.regexp_extract_all(content, F.lit(pattern), F.lit(0))).otherwise(out)
    return out


def kind_of(piece: Column, language: Column) -> Column:
    """comment, string or code; a # begins a comment in Python only."""
    comment = piece.rlike(COMMENT) & ((F.substring(piece, 1, 1) == "#") == (language == "python"))
    return F.when(comment, "comment").when(piece.rlike(STRING) & (F.length(piece) > 1), "string").otherwise("code")


def blanked(language: Column, content: Column) -> Column:
    """The text with blanks for comments and for what strings hold; lines and lengths stay."""
    blank = lambda c: F.regexp_replace(c, r"[^\n]", " ")

    def clean(piece: Column) -> Column:
        kind = kind_of(piece, language)
        inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
        some = F.substring(piece, 1, 1).isin("/", "#", '"', "'", "`")  # others are code
        return F.when(~some, piece).when(kind == "comment", blank(piece)).when(kind == "string", F.concat(F.substring(piece, 1, 1), blank(inner), F.substring(piece, -1, 1))).otherwise(piece)

    return F.array_join(F.transform(pieces(language, content), clean), "")


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a costly column that is worked out once a row: as a generator's output, neither filters nor later columns repeat its expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _count(text: Column, some: str) -> Column:
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in some), F.lit(0))


def lines_of(files: DataFrame) -> DataFrame:
    """(path, language, line_no from 1, line, clean, before, after, low, p_before, p_after): a file's lines as they are and without comments and strings; how deep in braces each begins, ends, and is at its lowest; and how deep in parentheses, in Python in any brackets, it begins and ends."""
    lang = P.language(F.col("path"))
    # dealt by path before the scan, for small files lie in few partitions; running sums and what follows then need no further shuffle
    text = once(files.select("path", lang.alias("language"), "content").repartition("path"), blanked(F.col("language"), F.col("content")), "clean")
    rows = text.select("path", "language", F.posexplode(F.arrays_zip(F.split("content", "\n").alias("line"), F.split("clean", "\n").alias("clean"))).alias("n", "l"))
    rows = rows.select("path", "language", (F.col("n") + 1).alias("line_no"), "l.line", "l.clean")
    step = lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("low"))
    falls = F.aggregate(F.split(F.regexp_replace("clean", r"[^{}]", ""), ""), start, lambda s, c: F.struct((s["at"] + step(c)).alias("at"), F.least(s["low"], s["at"] + step(c)).alias("low")), lambda s: s["low"])
    drop = F.when(F.contains("clean", F.lit("}")), falls).otherwise(0)
    braces = _count(F.col("clean"), "{") - _count(F.col("clean"), "}")
    parens = F.when(F.col("language") == "python", _count(F.col("clean"), "([{") - _count(F.col("clean"), ")]}")).otherwise(_count(F.col("clean"), "(") - _count(F.col("clean"), ")"))
    order = Window.partitionBy("path").orderBy("line_no")
    rows = rows.withColumn("after", F.sum(braces).over(order)).withColumn("p_after", F.sum(parens).over(order))
    rows = rows.withColumn("before", F.col("after") - braces).withColumn("p_before", F.col("p_after") - parens)
    return rows.withColumn("low", F.col("before") + drop)


def next_at_most(starts: DataFrame, lines: DataFrame, value: Column) -> DataFrame:
    """(path, line_no, most, next): for each of ``starts`` (path, line_no, most) the first later line whose ``value`` is ``most`` or less; none is left out.

    Each start is asked for at each value up to its own that the file has, and in order from the end each of those meets the nearest line.
    """
    known = lines.select("path", "line_no", value.alias("value")).join(starts.select("path").distinct(), "path", "left_semi")  # of files that ask
    asked = starts.join(known.select("path", "value").distinct(), "path").where("value <= most")
    rows = known.select("path", "value", "line_no", F.lit(None).cast("int").alias("most"), F.col("line_no").alias("hit")).unionByName(asked.select("path", "value", "line_no", "most", F.lit(None).cast("int").alias("hit")))
    backward = Window.partitionBy("path", "value").orderBy(F.desc("line_no"), F.col("hit").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("next", F.last("hit", ignorenulls=True).over(backward)).where("hit is null and next is not null")
    return near.groupBy("path", "line_no", "most").agg(F.min("next").alias("next"))


def heads(lines: DataFrame) -> DataFrame:
    """``lines`` with ``until``, the last line of the head that begins there: where its parentheses close or a body opens in them, and lines that go on with it."""
    python = F.col("language") == "python"
    backward = Window.partitionBy("path").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    goes_on = F.col("clean").rlike(GOES_ON) & ~python
    seen = lines.withColumn("goes_on", goes_on).withColumn("other", F.last(F.when(~F.col("goes_on"), F.col("line_no")), ignorenulls=True).over(backward))
    seen = seen.withColumn("body", F.last(F.when(F.col("clean").rlike(BODY[:-1] + r"\{") & ~python, F.col("line_no")), ignorenulls=True).over(backward)).withColumn("lines", F.max("line_no").over(Window.partitionBy("path")))
    closed = next_at_most(lines.where("p_after > p_before").select("path", "line_no", F.col("p_before").cast("int").alias("most")), lines, F.col("p_after").cast("int"))
    seen = seen.join(closed.select("path", "line_no", "next"), ["path", "line_no"], "left")
    own = F.when(F.col("p_after") <= F.col("p_before"), F.col("line_no")).otherwise(F.least(F.coalesce("next", "lines"), F.coalesce("body", "lines")))
    seen = stored(seen.withColumn("own", own).drop("next", "body"), "heads")
    after = seen.where("goes_on").select("path", (F.col("line_no") - 1).alias("own"), F.coalesce(F.col("other") - 1, F.col("lines")).alias("run"))
    last = seen.where("goes_on").select("path", F.col("line_no").alias("run"), F.col("own").alias("run_own"))
    joined = seen.join(after, ["path", "own"], "left").join(last, ["path", "run"], "left")
    return joined.withColumn("until", F.coalesce("run_own", "run", "own")).drop("goes_on", "other", "own", "run", "run_own", "lines")


def _by_rule(language: Column, head: Column) -> Column:
    out = F.lit(None).cast("struct<type:string,name:string>")
    for lang, some in RULES.items():
        for kind, pattern in reversed(some):
            out = F.when((language == lang) & head.rlike(pattern), F.struct(F.lit(kind).alias("type"), F.regexp_extract(head, pattern, 1).alias("name"))).otherwise(out)
    return out


def signature_size(head: Column, python: Column) -> Column:
    """How many characters of a head come before its body, a semicolon, or in Python the colon, outside brackets; or before its last line's end."""
    tokens = F.regexp_extract_all(head, F.lit(r"(?s)[^(){};:\[\]]*(?:[(){};:\[\]]|$)"), F.lit(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(False).alias("done"), F.lit("").alias("mark"))

    def step(s: Column, t: Column) -> Column:
        mark = F.substring(t, -1, 1)
        inside, body = s["depth"] > 0, F.concat(s["mark"], F.substring(t, F.lit(1), F.length(t) - 1)).rlike(BODY)
        ends = F.when(python, ~inside & (mark == ":")).otherwise((~inside & mark.isin("{", ";")) | ((mark == "{") & body))
        up = (mark == "(") | ((python | inside) & mark.isin("{", "[")) | (python & (mark == "["))
        down = (mark == ")") | (inside & mark.isin("}", "]"))
        depth = F.greatest(F.lit(0), s["depth"] + F.when(up, 1).when(down, -1).otherwise(0))
        here = F.struct(depth.alias("depth"), (s["at"] + F.length(t) - F.when(ends, 1).otherwise(0)).alias("at"), ends.alias("done"), mark.alias("mark"))
        return F.when(s["done"], s).otherwise(here)

    return F.aggregate(tokens, state, step, lambda s: s["at"])


def brace_at(clean: Column, start: Column, most: Column) -> Column:
    """How many characters of a line come up to and with the brace after which its depth, ``start`` at first, is ``most`` or less; null if none."""
    tokens = F.regexp_extract_all(clean, F.lit(r"[^{}]*[{}]"), F.lit(0))
    state = F.struct(start.cast("int").alias("depth"), F.lit(0).alias("at"), F.lit(False).alias("done"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(F.substring(t, -1, 1) == "{", 1).otherwise(-1)
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), (s["at"] + F.length(t)).alias("at"), (depth <= most).alias("done")))

    return F.aggregate(tokens, state, step, lambda s: F.when(s["done"], s["at"]))


def extract_symbols(files: DataFrame) -> DataFrame:
    """(symbol_id, path, language, name, type, start_line, start_column, end_line, end_column, signature): a symbol for each declaration.

    A declaration begins a line. Columns count from 1, and the end's is that after the last character. The signature is the head up to
    its body, with single blanks. A body that never closes ends with the file.
    """
    lines = stored(lines_of(files.where(P.language(F.col("path")).isin(*RULES))), "lines")
    seen = heads(lines).where(F.col("clean").rlike(r"[A-Za-z_$]"))
    one = seen.where("until = line_no").withColumn("head", F.col("clean")).withColumn("raw", F.col("line"))
    several = seen.where("until > line_no").select("path", "line_no", F.explode(F.sequence("line_no", "until")).alias("n"))
    parts = several.join(lines.select("path", F.col("line_no").alias("n"), "line", "clean"), ["path", "n"]).groupBy("path", "line_no").agg(F.sort_array(F.collect_list(F.struct("n", "clean", "line"))).alias("ls"))
    text = lambda c: F.array_join(F.transform("ls", lambda r: r[c]), "\n")
    many = seen.join(parts, ["path", "line_no"]).withColumn("head", text("clean")).withColumn("raw", text("line")).drop("ls")
    python = F.col("language") == "python"
    found = once(one.unionByName(many), _by_rule(F.col("language"), F.col("head")), "rule").where("rule is not null")
    found = once(found, signature_size(F.col("head"), python), "size")
    signed, body = F.substring(F.col("head"), F.lit(1), F.col("size")), F.substring(F.col("head"), F.col("size") + 1, F.lit(1)) == "{"
    whole = body & signed.rlike(METHOD) & (_count(signed, "(") == _count(signed, ")"))
    found = found.where(whole | (F.col("rule.type") != "method") | ~F.col("language").isin("typescript", "javascript"))
    lead = F.length(F.regexp_extract("clean", r"^\s*", 0))
    found = found.select(
        "path", "language", "line_no", "rule.type", "rule.name", lead.alias("indent"), F.col("before").cast("int").alias("before"),
        F.trim(F.regexp_replace(F.substring(F.col("raw"), F.lit(1), F.col("size")), r"\s+", " ")).alias("signature"),
        (F.col("line_no") + _count(signed, "\n")).alias("opens"), body.alias("body"), F.length(F.substring_index(signed, "\n", -1)).alias("shift"),
    )
    found = stored(found, "declared")
    last = lines.groupBy("path").agg(F.max("line_no").alias("line_no"))
    at = lambda df, name: df.select("path", F.col("line_no").alias(name), F.length("line").alias(f"{name}_length"), F.col("clean").alias(f"{name}_clean"), F.col("before").cast("int").alias(f"{name}_before"))
    filled = F.col("clean").rlike(r"\S")

    braced = found.where("language <> 'python'").join(at(lines, "opens"), ["path", "opens"])
    behind = F.substring(F.col("opens_clean"), F.col("shift") + 1, F.col("opens_length"))  # from the body's brace on
    inner = F.col("before") + _count(F.substring(F.col("opens_clean"), F.lit(1), F.col("shift")), "{") - _count(F.substring(F.col("opens_clean"), F.lit(1), F.col("shift")), "}")
    depth = F.when(F.col("opens") > F.col("line_no"), F.col("opens_before") + inner - F.col("before")).otherwise(inner)  # before the body's brace
    braced = once(braced.withColumn("depth", depth).withColumn("behind", behind), F.when(F.col("body"), brace_at(F.col("behind"), F.col("depth"), F.col("depth"))), "here")
    braced = stored(braced.drop("opens_clean", "behind"), "braced")
    further = braced.where("body and here is null")
    closing = next_at_most(further.select("path", F.col("opens").alias("line_no"), F.col("depth").alias("most")).distinct(), lines, F.col("low").cast("int"))
    closing = closing.select("path", F.col("line_no").alias("opens"), F.col("most").alias("depth"), F.col("next").alias("end"))
    ends = further.join(closing, ["path", "opens", "depth"], "left").join(last.withColumnRenamed("line_no", "final"), "path").withColumn("closes", F.col("end").isNotNull()).withColumn("end", F.coalesce("end", "final"))
    ends = ends.join(at(lines, "end"), ["path", "end"])
    column = F.when(F.col("closes"), brace_at(F.col("end_clean"), F.col("end_before"), F.col("depth"))).otherwise(F.col("end_length"))
    own = ["path", "language", "name", "type", "line_no", "indent", "signature"]
    later = ends.select(*own, "end", column.alias("column"))
    same = braced.where("not body or here is not null").select(*own, F.col("opens").alias("end"), F.when(F.col("here").isNotNull(), F.col("shift") + F.col("here")).otherwise(F.col("opens_length")).alias("column"))

    indents = lines.where(F.col("language") == "python").where(filled).withColumn("indent", F.length(F.regexp_extract("clean", r"^\s*", 0))).withColumn("earlier", F.lag("line_no").over(Window.partitionBy("path").orderBy("line_no")))
    blocks = found.where("language = 'python' and type <> 'variable'")
    below = next_at_most(blocks.select("path", F.col("opens").alias("line_no"), F.col("indent").alias("most")).distinct(), indents, F.col("indent"))
    below = below.join(indents.select("path", F.col("line_no").alias("next"), "earlier"), ["path", "next"]).select("path", F.col("line_no").alias("opens"), F.col("most").alias("indent"), "earlier")
    final = indents.groupBy("path").agg(F.max("line_no").alias("final"))
    blocks = blocks.join(below, ["path", "opens", "indent"], "left").join(final, "path").withColumn("end", F.greatest("opens", F.coalesce("earlier", "final")))
    plain = found.where("language = 'python' and type = 'variable'").withColumn("end", F.col("opens"))
    indented = blocks.select(*own, "end").unionByName(plain.select(*own, "end")).join(at(lines, "end"), ["path", "end"]).select(*own, "end", F.col("end_length").alias("column"))

    long = lambda c: c.cast("long")
    return same.unionByName(later).unionByName(indented).select(
        F.concat_ws("-", "type", "path", F.col("line_no").cast("string")).alias("symbol_id"), "path", "language", "name", "type", long(F.col("line_no")).alias("start_line"),
        long(F.col("indent") + 1).alias("start_column"), long(F.col("end")).alias("end_line"), long(F.col("column") + 1).alias("end_column"), "signature",
    )


def nodes(files: DataFrame) -> DataFrame:
    """(path, node_id, kind, name, start_line, end_line, parent): a file's declarations, comments and strings as nodes; a parent is the innermost declaration around a node."""
    lang = P.language(F.col("path"))
    some = files.where(lang.isin(*RULES)).repartition("path").select("path", lang.alias("language"), F.posexplode(pieces(lang, F.col("content"))).alias("n", "piece"))
    feeds = F.length(F.regexp_replace("piece", r"[^\n]", ""))
    end = (F.sum(feeds).over(Window.partitionBy("path").orderBy("n")) + 1).cast("long")
    held = some.select("path", "n", end.alias("end_line"), feeds.alias("feeds"), kind_of(F.col("piece"), F.col("language")).alias("kind")).where("kind <> 'code'")
    marks = held.select("path", F.concat_ws("-", "kind", "path", F.col("n").cast("string")).alias("node_id"), "kind", F.lit(None).cast("string").alias("name"), (F.col("end_line") - F.col("feeds")).alias("start_line"), "end_line")
    symbols = extract_symbols(files).select("path", F.col("symbol_id").alias("node_id"), F.col("type").alias("kind"), "name", "start_line", "end_line")
    around = symbols.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "node_id"))).alias("around"))
    holds = lambda d: (d["start_line"] <= F.col("start_line")) & (d["end_line"] >= F.col("end_line")) & ~((d["start_line"] == F.col("start_line")) & (d["end_line"] == F.col("end_line")))
    return symbols.unionByName(marks).join(around, "path", "left").select("path", "node_id", "kind", "name", "start_line", "end_line", F.try_element_at(F.filter("around", holds), F.lit(-1))["node_id"].alias("parent"))


def extract_imports(files: DataFrame) -> DataFrame:
    """(path, line_no, import_path, specifiers[], is_default); a script's import may run over several lines, and comments hold none."""
    lines = lines_of(files).where(F.col("clean").rlike(r"\S"))
    script = F.col("language").isin("typescript", "javascript")
    opens = script & F.col("clean").rlike(r"^\s*import\s*[^'\";]*$")
    backward = Window.partitionBy("path").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    quoted = F.last(F.when(F.col("clean").rlike("['\"]"), F.col("line_no")), ignorenulls=True).over(backward)  # the next line with a string
    lines = stored(lines.withColumn("until", F.when(opens, quoted)).select("path", "language", "line_no", "line", "until"), "lines")
    parts = lines.where("until is not null").select("path", "line_no", F.explode(F.sequence("line_no", "until")).alias("n")).join(lines.select("path", F.col("line_no").alias("n"), "line"), ["path", "n"])
    joined = parts.groupBy("path", "line_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda r: r["line"]), "\n").alias("whole"))
    lines = lines.join(joined, ["path", "line_no"], "left").withColumn("line", F.coalesce("whole", "line"))
    target = F.lit("")
    for lang, pattern in IMPORTS.items():
        one = F.coalesce(F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")), F.regexp_extract("line", r"^\s*import\s+([\w.]+)", 1)) if lang == "python" else F.regexp_extract("line", pattern, 1)
        target = F.when(F.col("language") == lang, one).otherwise(target)
    named = F.regexp_extract("line", r"^(?:[^'\";])*", 0)
    braces = F.regexp_extract(named, r"\{([^}]*)\}", 1)
    names = F.transform(F.filter(F.split(braces, ","), lambda x: F.trim(x).rlike(r"\S")), lambda x: F.regexp_extract(x, r"^\s*(?:type\s+)?(\S+)", 1))
    default = F.col("line").rlike(r"^\s*import\s+[A-Za-z_$][\w$]*\s*(?:,|from)")
    # without names or a default, what the last part of the path is called
    last = F.regexp_extract(target, r"([^/.:*]+)[^/]*$", 1)
    return lines.select("path", F.col("line_no").cast("long").alias("line_no"), target.alias("import_path"), names.alias("specifiers"), default.alias("is_default"), F.coalesce(F.get(names, 0), last).alias("name")).where("import_path <> ''")


def bodies(files: DataFrame) -> DataFrame:
    """(path, start_line, type, name, body, content): each symbol with its text."""
    text = extract_symbols(files).select("path", "start_line", "end_line", "type", "name").join(files.select("path", "content"), "path")
    own = F.slice(F.split("content", "\n"), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int"))
    return text.select("path", "start_line", "type", "name", F.array_join(own, "\n").alias("body"), "content")


def _has(text: Column, *some: str) -> Column:
    out = F.lit(False)
    for t in some:
        out = out | F.contains(text, F.lit(t))
    return out


def framework_symbols(files: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(path, start_line, name, framework, type): what a declaration means in its file's framework; declarations that mean nothing there are left out.

    ``frameworks`` is (path, framework). The first rule that holds counts, as listed.
    """
    d = bodies(files).join(frameworks.where("framework is not null"), "path")
    f, body, content, path = F.col("framework"), F.col("body"), F.col("content"), F.col("path")
    function, cls, variable = F.col("type").isin("function", "method"), F.col("type") == "class", F.col("type").isin("variable", "function")
    export = F.col("body").rlike(r"^\s*export\b")
    jsx = (_has(body, "return") & _has(body, "<") & _has(body, "/>")) | (_has(body, "<") & _has(body, "</"))
    api, page = _has(path, "/pages/api/", "/app/api/"), _has(path, "/pages/", "/app/")
    rules = [
        ("React", function & F.col("name").rlike("^use[A-Z]"), "hook"),
        ("React", (function & jsx) | (cls & _has(content, "React.Component")), "component"),
        ("Vue", variable & _has(body, "computed("), "computed"),
        ("Vue", variable & _has(body, "watch(", "watchEffect("), "watcher"),
        ("Vue", function & _has(content, "defineComponent"), "component"),
        ("Angular", cls & _has(content, "@Component") & _has(content, "templateUrl:", "template:"), "component"),
        ("Angular", cls & _has(content, "@Injectable"), "service"),
        ("Angular", cls & _has(content, "@Directive"), "directive"),
        ("Svelte", variable & _has(body, "writable(", "readable(", "derived("), "store"),
        ("Svelte", function & _has(body, "destroy") & _has(body, "node", "element"), "action"),
        ("Next.js", api & ((export & _has(body, "GET", "POST", "PUT", "DELETE")) | (function & _has(body, "req") & _has(body, "res"))), "route"),
        ("Next.js", page & ~api & function & _has(content, "export default"), "component"),
        ("Next.js", _has(path, "middleware.") & ((export & _has(body, "middleware")) | (function & _has(body, "NextRequest"))), "middleware"),
    ]
    kind = None
    for name, condition, what in rules:
        kind = F.when((f == name) & condition, what) if kind is None else kind.when((f == name) & condition, what)
    declared = d.select("path", "start_line", "name", "framework", kind.alias("type")).where("type is not null")
    whole = files.join(frameworks.where("framework in ('Svelte', 'Astro')"), "path").where(P.extension(F.col("path")).isin(".svelte", ".astro"))
    script = files.join(frameworks.where("framework = 'Vue'"), "path").where(F.contains("content", F.lit("<script setup>")))
    named = lambda df: df.select("path", F.lit(1).cast("long").alias("start_line"), F.regexp_replace(P.basename(F.col("path")), r"\.[^.]*$", "").alias("name"), "framework", F.lit("component").alias("type"))
    return declared.unionByName(named(whole)).unionByName(named(script))
