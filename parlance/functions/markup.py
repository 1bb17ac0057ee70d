"""Markup as Column expressions: a subset of Markdown, tiles of a page, identifiers in help texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as a browser sees it.
BLANK = r"[\t\n\x0B\f\r \x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BULLET = f"^{BLANK}*[-*+]{BLANK}+"
NUMBER = rf"^{BLANK}*[0-9]+[.)]{BLANK}+"
#: Code comes first: marks inside it are text.
MARKS = r"`[^`]+`|\*\*[^*]+\*\*|__[^_]+__|\*[^*]+\*|_[^_]+_"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def runs(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep, kind, lines): the lines of a text in runs of one kind: ul, ol or p, without blank ones.

    A blank line ends a run; so does a line of another kind. Runs are found within the row.
    """
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)
    kind = lambda line: F.when(_trimmed(line) == "", "").when(line.rlike(BULLET), "ul").when(line.rlike(NUMBER), "ol").otherwise("p")
    known = rows.select(*keep, F.transform(lines, lambda x: F.struct(kind(x).alias("kind"), x.alias("line"))).alias("_l"))
    # Both arrays are used twice, so that they are made once a row.
    starts = known.select(*keep, "_l", F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: (i == 0) | (F.get("_l", i)["kind"] != F.get("_l", i - 1)["kind"])).alias("_s"))
    made = F.transform("_s", lambda i, k: F.struct(F.get("_l", i)["kind"].alias("kind"), F.slice(F.col("_l"), i + 1, F.coalesce(F.get("_s", k + 1), F.size("_l")) - i).alias("lines")))
    return starts.select(*keep, F.filter(made, lambda r: r["kind"] != "").alias("runs"))


def inline(text: Column) -> Column:
    """The text as nodes (mark, text): '' for plain text, code, strong or em. Everything else is literal."""
    between, found = F.split(text, MARKS, -1), F.regexp_extract_all(text, F.lit(MARKS), F.lit(0))
    inner = lambda m, n: F.substring(m, F.lit(n + 1), F.char_length(m) - 2 * n)
    node = lambda mark, x: F.struct(F.lit(mark).alias("mark"), x.alias("text"))
    marked = lambda m: F.when(m.startswith("`"), node("code", inner(m, 1))).when(m.startswith("**") | m.startswith("__"), node("strong", inner(m, 2))).otherwise(node("em", inner(m, 1)))
    pairs = F.arrays_zip(between.alias("t"), F.transform(found, marked).alias("m"))
    nodes = F.flatten(F.transform(pairs, lambda p: F.array(node("", p["t"]), p["m"])))
    return F.filter(nodes, lambda n: n.isNotNull() & (n["text"] != ""))


def items(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep, block, kind, item, nodes): the items of each block of a text; see inline() for nodes.

    A list (ul, ol) has an item for each line; a paragraph (p) has one, its lines trimmed and joined by
    spaces. Texts are cut within their rows; nothing is shuffled.
    """
    # Outer generators: Spark would put a filter on what an inner one takes below, and make that anew for it.
    found = runs(rows, text, *keep).select(*keep, F.posexplode_outer("runs").alias("block", "r")).filter("block IS NOT NULL").select(*keep, "block", "r.kind", F.transform("r.lines", lambda x: x["line"]).alias("lines"))
    bare = F.transform("lines", lambda x: F.regexp_replace(x, F.when(F.col("kind") == "ul", BULLET).otherwise(NUMBER), F.lit("")))
    texts = F.when(F.col("kind") == "p", F.array(F.array_join(F.transform("lines", _trimmed), " "))).otherwise(bare)
    return found.select(*keep, "block", "kind", F.posexplode_outer(texts).alias("item", "text")).select(*keep, "block", "kind", "item", inline(F.col("text")).alias("nodes"))


def blocks(rows: DataFrame, text: Column, key: str) -> DataFrame:
    """(key, blocks): each text as a nested array of (kind, items), items being arrays of nodes. Keys are unique; texts without blocks have no row."""
    of_block = items(rows, text, key).groupBy(key, "block", "kind").agg(F.sort_array(F.collect_list(F.struct("item", "nodes"))).alias("items"))
    whole = of_block.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("block", "kind", F.transform("items", lambda x: x["nodes"]).alias("items")))).alias("b"))
    return whole.select(key, F.transform("b", lambda x: F.struct(x["kind"].alias("kind"), x["items"].alias("items"))).alias("blocks"))


def tiles(html: Column, attribute: str) -> Column:
    """(id, name) of the tags of a page with an attribute: the first of each id; comments and scripts don't count.

    The id is the attribute's value, the name the text that follows the tag, both without white space
    around; a tile without a name is called Participante, one without an id is none.
    """
    clean = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")
    tag = rf"""(?i)<[a-z][^\s>/]*\s(?:[^>]*\s)?{attribute}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*>([^<]*)"""
    part = lambda n: F.regexp_extract_all(clean, F.lit(tag), F.lit(n))
    found = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("n"))
    named = F.transform(found, lambda f: F.struct(F.trim(F.concat(F.coalesce(f["a"], F.lit("")), F.coalesce(f["b"], F.lit("")), F.coalesce(f["c"], F.lit("")))).alias("id"), F.coalesce(F.nullif(F.trim(f["n"]), F.lit("")), F.lit("Participante")).alias("name")))
    return F.filter(named, lambda t: t["id"] != "")


def first_tiles(rows: DataFrame, html: str, attribute: str, *keep: str) -> DataFrame:
    """(keep, place, id, name): the first tile of each id, with its place among the page's tiles, from 0."""
    found = rows.select(*keep, F.posexplode(tiles(F.col(html), attribute)).alias("place", "tile")).select(*keep, "place", "tile.id", "tile.name")
    return found.groupBy(*keep, "id").agg(F.min(F.struct("place", "name")).alias("first")).select(*keep, "first.place", "id", "first.name")


#: What an identifier looks like.
IDENTIFIER = r"^[a-z0-9][-a-z0-9._:\[\]]{1,63}$"


def model_aliases(help_text: Column) -> Column:
    """The quoted identifiers in what a help text says of its option --model, each once, in order.

    An option's lines begin with white space and a dash; what it says ends where the next option begins.
    """
    option = lambda x: x.rlike(r"^\s+-")
    names = lambda x: x.rlike(r"(^|[\s,])--model([\s,]|$|=)")
    # Until the option begins nothing is held; then lines up to the next option; then nothing more.
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("block"))

    def step(s: Column, x: Column) -> Column:
        held = F.concat(s["block"], x, F.lit(" "))
        begins = F.struct(F.lit(1).alias("at"), F.concat(x, F.lit(" ")).alias("block"))
        return F.when((s["at"] == 0) & option(x) & names(x), begins).when((s["at"] == 1) & option(x), F.struct(F.lit(2).alias("at"), s["block"].alias("block"))).when(s["at"] == 1, F.struct(F.lit(1).alias("at"), held.alias("block"))).otherwise(s)

    block = F.aggregate(F.split(F.coalesce(help_text, F.lit("")), "\r?\n"), start, step)["block"]
    quoted = F.filter(F.split(block, "'", -1), lambda x, i: i % 2 == 1)
    return F.array_distinct(F.filter(quoted, lambda x: x.rlike(IDENTIFIER)))
