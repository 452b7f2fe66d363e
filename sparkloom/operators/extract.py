"""Facts from JavaScript and TypeScript sources: imports, exports, components, hooks, contexts, routes, symbols, errors.

The sources become a relation of tokens (`tokens`): one pattern cuts a text into comments, strings, templates, regular expressions, words,
white space and single signs, running sums over a file give place, line and depth in brackets. What comes next, where a bracket closes and
where a body ends are window functions over the file or over one depth of it (`looking_ahead`), and facts are filters on tokens.
Parameters, clauses and bodies are cut from the text once for each file, and told by expressions. No compiler is used, so unusual
layouts may be missed; the tests say what is covered, and hold the facts against a plain reader of one text.

`export default <expression>` gives no export, as it carries no name, unless `expression_exports` asks for one (`default`, anonymous where
it is a function). Ids of files are unique; null text has no facts but a module of one line; a null id has none.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import key
from ..functions.session import shipped, stored
from . import ahead

_W = r"[\p{L}\p{N}_$]"
# classes of single characters are looked up in a table of bits, ranges and properties one after another
_ASCII, _SIGNS = f"{ascii_letters}{digits}_$", r"(){}\[\];,.:<>!?&|+*%@#~^\\-"
# comments, strings, templates, regular expressions (only at a / is looked behind)
_MARKED = (
    r"//[^\n]*+", r"/\*(?s:.*?)(?:\*/|\z)", r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'", r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"', r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+(?:`|\z)",
    r"(?=/)(?<=[=(,:\[!&|?{};]\s{0,99})/(?![*/])(?:\\[\s\S]|\[(?:\\[\s\S]|[^\]\\\n])*+\]|[^/\\\n\[])++/[a-z]*",
)
#: A text is a row of these: words, white space, single signs, arrows, what is marked; what is most frequent is tried first.
_PIECE = "|".join((rf"[{_ASCII}]+{_W}*+", r"\s+", rf"[{_SIGNS}]", "=>", *_MARKED, rf"{_W}++", r"[\s\S]"))
#: The same, but that what stands between two marked pieces is one.
_STRETCH = "|".join((r"[^/'\"`]++", *_MARKED, r"[\s\S]"))
_TAG = r"</?[A-Za-z][\w.$]*(?:\s(?:[^<>{}]++|\{(?:[^{}]++|\{[^{}]*\})*+\})*+)?/?>|</?>"
_OPEN, _CLOSE = ("(", "{", "["), (")", "}", "]")
#: Bytes of text whose tokens one task holds.
TASK_TEXT = 8 << 20
#: Bytes of a text whose tokens are rows; those of shorter ones are looked at in lists.
LONG = 32 << 10
#: Texts that go to a Python worker at once, unless the session says otherwise than Spark's default.
BATCH_ROWS = 2000
#: How many tokens after one are kept with it, as words and signs between blanks.
NEXT = 7
_HOOK = rf"^(?:use{_W}*|createContext)$"
ROUTE_HANDLER = r"(?:^|/)app/(?:.*/)?route\.[^.]+$"


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", " ")


def blanked(text: Column) -> Column:
    """The text with comments, regular expressions and what stands in quotes as blanks; quotes, line ends and every place stay."""

    def blank(p: Column) -> Column:
        first, n = F.substring(p, 1, 1), F.length(p)
        inner = F.concat(first, _blank(F.substr(p, F.lit(2), n - 2)), F.substring(p, -1, 1))
        return F.when((n > 1) & first.isin("'", '"', "`"), inner).when((n > 1) & (first == "/"), _blank(p)).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_STRETCH), F.lit(0)), blank), "")


def tokens(sources: DataFrame) -> DataFrame:
    """sources: file_id, text. file_id, i, at (from 0), line, column, sym, raw, braces, level: the tokens but white space and comments.

    sym: the word or sign; a quote for a string, ` for a template, / for a regular expression. raw: what stands in a string's quotes.
    braces: how many { are open before the token. level: how many brackets are, the token's own included; null for other tokens.
    """
    p = F.col("piece")
    first, n = F.substring(p, 1, 1), F.length(p)
    comment = p.startswith("//") | p.startswith("/*")
    sym = F.when(comment | p.rlike(r"^\s"), None).when((n > 1) & first.isin("'", '"'), '"').when((n > 1) & first.isin("`", "/"), first).otherwise(p)
    feeds = n - F.length(F.replace(p, F.lit("\n"), F.lit("")))
    rows = sources.select("file_id", F.posexplode(_pieces(F.col("text"))).alias("i", "piece")).select(
        "file_id", "i", sym.alias("sym"), F.when(sym == '"', F.substr(p, F.lit(2), n - 2)).alias("raw"), n.alias("n"), feeds.alias("feeds"),
        F.when(feeds > 0, n - F.length(F.substring_index(p, "\n", -1))).alias("to_line"),
    )
    before = Window.partitionBy("file_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    change = lambda o, c: F.when(F.col("sym").isin(*o), 1).when(F.col("sym").isin(*c), -1).otherwise(0)
    placed = rows.select("*", so_far(F.col("n")).alias("at"), so_far(F.col("feeds")).alias("fed"), so_far(change("{", "}")).alias("braces"), so_far(change(_OPEN, _CLOSE)).alias("depth"))
    start = F.coalesce(F.max(F.col("at") + F.col("to_line")).over(before), F.lit(0))
    level = F.when(F.col("sym").isin(*_OPEN), F.col("depth") + 1).when(F.col("sym").isin(*_CLOSE), F.col("depth"))
    done = placed.select("file_id", "i", "at", (F.col("fed") + 1).alias("line"), (F.col("at") - start + 1).alias("column"), "sym", "raw", "braces", level.alias("level"))
    return done.where("sym IS NOT NULL")


def looking_ahead(found: DataFrame, components: bool = True) -> DataFrame:
    """tokens with what stands before and after them, where brackets close, and (for components) where a body ends that begins after them.

    A place that isn't found is null, and stands for the end of the text.
    """
    order = Window.partitionBy("file_id").orderBy("i")
    level = Window.partitionBy("file_id", "level").orderBy("i")
    back = Window.partitionBy("file_id").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sym, opens, closes = F.col("sym"), F.col("sym").isin(*_OPEN), F.col("sym").isin(*_CLOSE)
    ahead = lambda of, value: F.last(F.when(of, value), ignorenulls=True).over(back)
    lead = lambda c, k: F.lead(c, k).over(order)
    t = found.select(
        "*", F.concat_ws(" ", *(lead("sym", k) for k in range(1, NEXT + 1))).alias("then"), *(lead("raw", k).alias(f"raw{k}") for k in (1, 2, 3)),
        *(F.lag("sym", k).over(order).alias(f"was{k}") for k in (1, 2)), F.lag(F.struct("at", "line", "column")).over(order).alias("was"),
    )
    # from here on only tokens that tell something, each with what is asked of it
    binds = sym.isin("const", "let", "var")
    heads = binds | sym.isin("import", "export", "function", "class", "interface", "enum", "type", "Route", "path") | sym.rlike(_HOOK)
    asked = heads | opens | closes | sym.isin("=", "=>")
    t = t.where(asked | sym.isin(";", '"', ">"))
    t = t.withColumns({"then": F.when(asked, F.col("then")), **{f"raw{k}": F.when(sym.isin("import", "path", "}"), F.col(f"raw{k}")) for k in (1, 2, 3)}})
    partner = F.when(opens, F.lead("at").over(level) + 1)
    t = t.select("*", partner.alias("end"), F.when(sym == "{", F.lead(F.struct("then", "raw2")).over(level)).alias("after"), F.when(closes, F.lag("sym").over(level)).alias("opened"))
    t = t.withColumn("next_end", F.when(sym == "=>", lead("end", 1)))  # a bracket right after an arrow is the next token here too
    t = t.select(
        "*", F.when(closes | sym.isin("=", "export", "class"), ahead(sym == "{", F.struct("at", "end", "after"))).alias("brace"), F.when(closes | sym.isin("=", "export"), ahead(sym == "=>", F.struct("at", "next_end", F.col("then").rlike(r"^[({]").alias("block")))).alias("arrow"),
        F.when(closes | binds | sym.isin("=", "export", "class"), ahead(sym == ";", F.col("at"))).alias("stop"), F.when(sym == "(", ahead(sym.isin("(", ")"), F.struct("sym", "at", "end"))).alias("inner"),
        F.when(sym == "export", ahead(sym == '"', F.struct("raw"))).alias("quoted"), F.when(sym == "import", ahead(sym.isin('"', ";", ">", "(", ")", "[", "]", "=", "=>"), F.struct("sym", "raw", "was1", "was"))).alias("outside"),
        F.when(sym == "Route", ahead(sym.isin(">", "=>"), F.col("at"))).alias("tag_end"), F.when(closes, ahead(sym.isin("=", "=>"), sym)).alias("equals"),
        F.when(sym == "Route", ahead((sym == "path") & F.col("then").rlike(r'^= (?:\{ )?"'), F.struct("at", F.when(F.col("then").startswith('= "'), F.col("raw2")).otherwise(F.col("raw3")).alias("raw")))).alias("path_said"),
    )
    arrow, brace = F.col("arrow"), F.col("brace")
    expression = F.when(arrow["block"], arrow["next_end"]).otherwise(F.col("stop"))
    t = t.withColumn("body_end", F.when(closes | (sym == "="), F.when(arrow.isNotNull() & (brace.isNull() | (arrow["at"] < brace["at"])), expression).otherwise(brace["end"])))
    t = t.withColumn("closed", F.when(sym == "(", F.lead(F.struct("then", "equals", "body_end")).over(level)))
    # a struct's fields are all computed, so those that only components ask for are left out without them
    paren = F.struct("sym", "at", "end", "was1", *(("then", "closed", "inner") if components else ()))
    t = t.withColumn("paren", F.when((sym == "=") | (sym == "function") | sym.rlike(_HOOK), ahead(sym.isin("(", ")"), paren)))
    t = t.where(heads | opens | closes | sym.isin("=", "=>"))
    return t.withColumn("assigned", F.when(binds, ahead(sym.isin("=", "=>"), F.struct("sym", "at", "then", "paren", "body_end"))))


#: The columns of a token by name, be it a row or a struct in a list.
Token = Callable[[str], Column]


def _named(t: Token, *names: str) -> list[Column]:
    return [t(n).alias(n) for n in names]


def _import(t: Token) -> Column:
    """at, line, source, dynamic, only, begin, end (of the clause): where the token begins an import."""
    then, stop = t("then"), t("outside")
    only = then.rlike("^type (?!from |, )")
    row = lambda source, dynamic, only, begin, end: F.struct(*_named(t, "at", "line"), source.alias("source"), F.lit(dynamic).alias("dynamic"), only.alias("only"), begin.alias("begin"), end.alias("end"))
    none, no = F.lit(None).cast("int"), F.lit(False)
    static = (stop["sym"] == '"') & (stop["was1"] == "from") & ~then.startswith("from ")
    told = F.when(then.startswith('( "'), row(t("raw2"), True, no, none, none)).when(then.startswith('"'), row(t("raw1"), False, no, none, none)).when(static, row(stop["raw"], False, only, t("at") + 6, stop["was"]["at"]))
    return F.when((t("sym") == "import") & ~F.coalesce(t("was1") == ".", F.lit(False)), told)


def _export(t: Token, expressions: bool) -> Column:
    """at, line, name, default, anonymous, only, source, begin, end (of a list in braces): where the token begins an export."""
    then, braces = t("then"), t("brace")
    row = lambda name, source=F.lit(None), default=F.lit(False), anonymous=F.lit(False), begin=F.lit(None), end=F.lit(None): F.struct(
        *_named(t, "at", "line"), name.cast("string").alias("name"), default.alias("default"), anonymous.alias("anonymous"), then.rlike(r"^type [*{]").alias("only"), source.cast("string").alias("source"), begin.cast("int").alias("begin"), end.cast("int").alias("end"))
    star, function, kind, variable = r"^(?:type )?\* (?:as (\S+) )?from ", rf"^(default )?(?:async )?function (?:\* )?({_W}*)", rf"^(default )?(?:abstract )?class(?: (?!extends |implements )({_W}+))?", rf"^(?:declare )?(?:const|let|var) ({_W}+)"
    at = lambda p, g: F.regexp_extract(then, p, g)
    whole = F.concat(F.lit("*"), F.when(at(star, 1) != "", F.concat(F.lit(" as "), at(star, 1))).otherwise(""))
    listed = row(F.lit(None), source=F.when(braces["after"]["then"].startswith('from "'), braces["after"]["raw2"]), begin=braces["at"] + 1, end=braces["end"] - 1)
    declared = lambda p: F.when((at(p, 1) != "") | (at(p, 2) != ""), row(F.when(at(p, 2) != "", at(p, 2)).otherwise("default"), default=at(p, 1) != "", anonymous=at(p, 2) == ""))
    told = F.when(then.rlike(star + '"'), row(whole, source=t("quoted")["raw"])).when(then.rlike(r"^(?:type )?\{"), listed).when(then.rlike(function), declared(function)).when(then.rlike(kind), declared(kind)).when(then.rlike(variable), row(at(variable, 1)))
    if expressions:
        arrow = then.rlike(rf"^default (?:async )?(?:\(|{_W}+ =>)") & (t("arrow")["at"] < F.coalesce(t("stop"), F.lit(2**31 - 1)))
        told = told.when(then.startswith("default ") & ~then.rlike("^default (?:interface|enum|type) "), row(F.lit("default"), default=F.lit(True), anonymous=F.coalesce(arrow, F.lit(False))))
    return F.when((t("sym") == "export") & (t("braces") == 0) & ~F.coalesce(t("was1") == ".", F.lit(False)), told)


_FUNCTION = rf"^(?:\* )?((?!\p{{N}}){_W}+) [(<]"


def _function(t: Token) -> Column:
    """Its place: where the token declares a function by name."""
    return F.when((t("sym") == "function") & t("then").rlike(_FUNCTION) & (t("paren")["sym"] == "("), t("at"))


def _component(t: Token) -> Column:
    """at, name, type, begin, to (of the parameters), end (of the body), function: where the token declares what may be a component."""
    then, sym, paren, given = t("then"), t("sym"), t("paren"), t("assigned")
    row = lambda name, kind, begin, to, end: F.struct(*_named(t, "at"), name.alias("name"), F.lit(kind).alias("type"), begin.cast("int").alias("begin"), to.cast("int").alias("to"), end.cast("int").alias("end"))
    kind, variable = rf"^((?!\p{{N}}){_W}+)", rf"^([A-Z]{_W}*) [=:]"
    at = lambda p: F.regexp_extract(then, p, 1)
    same = F.coalesce(given["at"] < t("stop"), F.lit(True)) & (given["sym"] == "=")
    none = F.lit(None)
    opened, value = given["paren"], given["then"]
    arrow = value.rlike(r"^(?:async )?\(") & (opened["closed"]["then"].startswith("=>") | (opened["closed"]["then"].startswith(":") & (opened["closed"]["equals"] == "=>")))
    wrapped = value.rlike(r"^(?:React \. )?(?:memo|forwardRef|lazy) [(<]") & (opened["sym"] == "(")
    inner = opened["then"].rlike(rf"^(?:async )?(?:function (?:{_W}+ )?)?\(")
    return (
        F.when(_function(t).isNotNull(), row(at(_FUNCTION), "function", paren["at"] + 1, F.coalesce(paren["end"] - 1, F.lit(-1)), paren["closed"]["body_end"]))
        .when((sym == "class") & then.rlike(kind) & F.coalesce(t("brace")["at"] < t("stop"), t("brace").isNotNull()), row(at(kind), "class", none, none, t("brace")["end"]))
        .when(sym.isin("const", "let", "var") & then.rlike(variable) & same & arrow, row(at(variable), "arrow", opened["at"] + 1, F.coalesce(opened["end"] - 1, F.lit(-1)), opened["closed"]["body_end"]))
        .when(sym.isin("const", "let", "var") & then.rlike(variable) & same & value.rlike(rf"^(?:async )?{_W}+ =>"), row(at(variable), "arrow", none, none, given["body_end"]))
        .when(sym.isin("const", "let", "var") & then.rlike(variable) & same & wrapped, row(at(variable), "arrow", F.when(inner, opened["inner"]["at"] + 1), F.coalesce(opened["inner"]["end"] - 1, F.lit(-1)), opened["end"]))
    )


def _hook(t: Token) -> Column:
    """at, line, column, name, begin, to (of the arguments): where the token is the name of a hook that is called."""
    paren, then = t("paren"), t("then")
    called = then.startswith("(") | (then.startswith("<") & (paren["sym"] == "(") & (paren["was1"] == ">"))
    declared = (t("was1") == "function") | ((t("was1") == "*") & (t("was2") == "function"))
    row = F.struct(*_named(t, "at", "line", "column"), t("sym").alias("name"), (paren["at"] + 1).alias("begin"), F.coalesce(paren["end"] - 1, F.lit(-1)).alias("to"))
    return F.when(t("sym").rlike(_HOOK) & called & ~F.coalesce(declared, F.lit(False)), row)


def _route(t: Token) -> Column:
    said = (t("sym") == "Route") & (t("was1") == "<") & (t("path_said")["at"] < F.coalesce(t("tag_end"), F.lit(2**31 - 1)))
    return F.when(said, F.struct(t("was")["at"].alias("position"), t("path_said")["raw"].alias("path"), F.lit("react-router").alias("kind"), t("was")["line"].alias("line"), t("was")["column"].alias("column")))


def _symbol(t: Token) -> Column:
    sym, then = t("sym"), t("then")
    kind = F.when(sym.isin("const", "let", "var"), "variable").otherwise(sym)
    real = lambda name: (name != "") & ~((sym == "class") & name.isin("extends", "implements")) & ~(name == "enum") & ((sym != "type") | then.rlike(rf"^{_W}+ [=<]"))
    told = lambda name: F.when(real(name), F.struct(t("at").alias("position"), name.alias("name"), kind.alias("type"), *_named(t, "line")))
    # in a list of one, so that the name is cut once
    return F.when(sym.isin("function", "class", "interface", "enum", "type", "const", "let", "var"), F.transform(F.array(F.regexp_extract(then, rf"^(?:\* )?((?!\p{{N}}){_W}+)", 1)), told)[0])


def _error(t: Token) -> tuple[Column, Column]:
    """at, line, column, message: of brackets that close what isn't open, and of those that aren't closed."""
    sym = t("sym")
    row = lambda message: F.struct(*_named(t, "at", "line", "column"), message.alias("message"))
    pair = F.create_map(*(F.lit(x) for p in zip(_OPEN, _CLOSE, strict=True) for x in p))
    odd = sym.isin(*_CLOSE) & ~F.coalesce(F.element_at(pair, t("opened")) == sym, F.lit(False))
    return F.when(odd, row(F.concat(F.lit("unexpected "), sym))), F.when(sym.isin(*_OPEN) & t("end").isNull(), row(F.concat(sym, F.lit(" isn't closed"))))


def split_arguments(text: Column) -> Column:
    """What stands between commas outside brackets, trimmed; nothing for what is empty."""
    parts = F.regexp_extract_all(text, F.lit(r"=>|[(){}\[\]<>,]|[^(){}\[\]<>,=]++|="), F.lit(0))
    seed = F.struct(F.lit(0).alias("depth"), F.lit("").alias("said"))

    def step(a: Column, p: Column) -> Column:
        depth = a["depth"] + F.when(p.isin("(", "{", "[", "<"), 1).when(p.isin(")", "}", "]", ">"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.concat(a["said"], F.when((p == ",") & (depth <= 0), F.lit("\x00")).otherwise(p)).alias("said"))

    done = F.split(F.aggregate(parts, seed, step)["said"], "\x00", -1)
    return F.filter(F.transform(done, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def markup_nesting(code: Column) -> Column:
    """The deepest nesting of markup in blanked code."""
    seed = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, t: Column) -> Column:
        closes, alone = t.startswith("</"), t.endswith("/>")
        return F.struct((a["now"] + F.when(closes, -1).when(alone, 0).otherwise(1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(closes, 0).otherwise(1)).alias("most"))

    return F.aggregate(F.regexp_extract_all(code, F.lit(_TAG), F.lit(0)), seed, step)["most"]


def _local_name(said: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(said, r"^\s+|\s+$", ""), r"^type\s+(?!as\s)", "")
    return F.regexp_replace(bare, r"(?s)^.*\sas\s+", "")


def _names(clause: Column) -> Column:
    """The local names in a list."""
    return F.filter(F.transform(F.split(clause, ",", -1), _local_name), lambda x: x != "")


def _bindings(clause: Column) -> Column:
    """The local names that an import's clause binds; a namespace as `* as name`."""
    parts = F.regexp_extract_all(clause, F.lit(rf"\{{[^}}]*\}}|\*\s+as\s+{_W}+|{_W}+"), F.lit(0))
    inner = lambda x: F.substr(x, F.lit(2), F.length(x) - 2)
    return F.flatten(F.transform(parts, lambda x: F.when(x.startswith("{"), _names(inner(x))).otherwise(F.array(F.regexp_replace(x, r"\s+", " ")))))


# Spark types by kind of fact
KINDS = {
    "imports": "is_dynamic boolean, is_type_only boolean, line int, source string, specifiers array<string>, type string",
    "exports": "is_anonymous boolean, is_default boolean, is_type_only boolean, line int, name string, source string",
    "components": "name string, type string, position int, line_count int, jsx_depth int, exports array<string>, hooks array<string>, props array<string>",
    "hooks": "name string, line int, column int, position int, arguments array<string>",
    "contexts": "name string, line int, column int, position int, kind string",
    "routes": "path string, kind string, line int, column int, position int",
    "symbols": "name string, type string, line int, position int",
    "errors": "line int, column int, message string, severity string",
    "module": "function_count int, line_count int",
}


def _as_kind(rows: Column, kind: str, /, **columns: object) -> Column:
    """rows as an array of the kind's columns; a column that isn't given has the row's own value."""
    wanted = [c.split() for c in KINDS[kind].split(", ")]
    return F.coalesce(F.transform(rows, lambda x: F.struct(*((columns[n](x) if n in columns else x[n]).cast(t).alias(n) for n, t in wanted))), F.array().cast(_type_of(kind)))


def _type_of(kind: str) -> str:
    return f"array<struct<{KINDS[kind].replace(' ', ':').replace(',:', ',')}>>"


def _held(sources: DataFrame) -> DataFrame:
    """The sources with their bytes, and whether their tokens are looked at in lists: written once, so that either side reads its own row groups alone."""
    own = sources.select("file_id", "path", F.coalesce("text", F.lit("")).alias("text")).withColumn("size", F.octet_length("text"))
    return stored(own.withColumn("listed", (F.col("size") <= LONG) & ~F.col("text").contains(ahead.END)), "sources")


def _texts(files: DataFrame) -> DataFrame:
    """Files by their id, as many partitions as TASK_TEXT asks for: texts move once, as tokens are many times their size, and every window, the grouping and the join keep this partitioning."""
    size = files.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    parts = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_TEXT))
    return files.repartition(parts, "file_id")


#: What the facts of a kind are made from.
_NEEDS = {"imports": ("imports",), "exports": ("exports",), "components": ("components", "exports", "hooks"), "hooks": ("hooks",), "contexts": ("hooks",), "routes": ("routes",), "symbols": ("symbols",), "errors": ("odd", "unclosed"), "module": ("functions",)}


#: The kinds that are told by more than tokens: what they are made from cuts the text.
_CUTS = {"imports", "exports", "components", "hooks", "module"}
_FACTS = ("imports", "exports", "components", "hooks", "routes", "symbols", "functions", "odd", "unclosed")


def _facts_of(t: Token, needed: Collection[str], expressions: bool) -> dict[str, Column]:
    """What a token tells, by what is needed; null where it tells nothing."""
    odd, unclosed = _error(t)
    told = {"imports": lambda: _import(t), "exports": lambda: _export(t, expressions), "components": lambda: _component(t), "hooks": lambda: _hook(t), "routes": lambda: _route(t), "symbols": lambda: _symbol(t), "functions": lambda: _function(t), "odd": lambda: odd, "unclosed": lambda: unclosed}
    return {c: f() for c, f in told.items() if c in needed}


def _of_rows(files: DataFrame, needed: Collection[str], expressions: bool) -> DataFrame:
    """file_id, path, text and the facts (_imports and so on) of long texts: their tokens are rows, which Spark's windows can spill."""
    listed = lambda c: F.sort_array(F.collect_list(c))
    seen = looking_ahead(tokens(files.select("file_id", "text").sortWithinPartitions("file_id")), components="components" in needed)
    own = _facts_of(F.col, needed, expressions)
    heads = seen.select("file_id", *(x.alias(c) for c, x in own.items())).where(" OR ".join(f"{c} IS NOT NULL" for c in own))
    gathered = lambda c: F.min(c) if c == "odd" else F.max(c) if c == "unclosed" else listed(c)
    found = heads.groupBy(F.col("file_id").alias("_file")).agg(*(gathered(c).alias(f"_{c}") for c in own))
    return files.join(found, F.col("file_id") == F.col("_file"), "left").select("file_id", "path", "text", *(f"_{c}" for c in own))


def _of_lists(files: DataFrame, needed: Collection[str], expressions: bool, text: bool) -> DataFrame:
    """The same of other texts (these themselves only where they are asked), whose tasks look at the tokens of many texts at once (ahead.py): the tokens that can begin a fact are a list, its facts are told as those of rows."""
    spark, asked = files.sparkSession, ahead.columns({*needed})
    shipped(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    # one string, each piece with an end: it is made and moved in less time than a list of strings, and the text is told by it
    ended = lambda pattern: F.regexp_replace("text", F.lit(pattern), F.lit(f"$0{ahead.END}"))
    # between marked pieces the tasks tell words from signs, many texts at once, but not which letters there are beyond ASCII
    pieces = files.select("file_id", "path", F.when(F.octet_length("text") == F.length("text"), ended(_STRETCH)).otherwise(ended(_PIECE)).alias("pieces"))
    own = ["file_id", "path", *(["text"] if text else [])]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.select(*own).schema)
    seen = pieces.mapInArrow(ahead.runner({*needed}, asked, text), f"{schema}, heads {ahead.shape({*needed})}")

    def facts(name: str) -> Column:
        begins = ahead.BEGINS.get(name)
        mine = F.col("heads") if begins is None or name == "hooks" else F.filter(F.col("heads"), lambda x: x["sym"].isin(*begins))
        told = F.filter(F.transform(mine, lambda x: _facts_of(lambda c: x[c], {name}, expressions)[name]), lambda x: x.isNotNull())
        return F.array_min(told) if name == "odd" else F.array_max(told) if name == "unclosed" else told

    return seen.select(*own, *(facts(c).alias(f"_{c}") for c in _FACTS if c in needed))


def extract(sources: DataFrame, expression_exports: bool = False, kinds: Collection[str] = tuple(KINDS)) -> DataFrame:
    """sources: file_id, path, text. file_id, path, and for each of these kinds of fact an array in the text's order; one row for each file.

    Windows that no asked kind needs are not computed.
    """
    whole = _held(sources)
    needed = {n for k in kinds for n in _NEEDS[k]}
    cuts = bool(_CUTS & {*kinds})
    short, long = _of_lists(whole.where("listed"), needed, expression_exports, cuts), _of_rows(_texts(whole.where("NOT listed")), needed, expression_exports)
    t = short.unionByName(long if cuts else long.drop("text"))
    text, size = F.col("text"), F.length("text")
    cut = lambda begin, end: F.substr(text, begin + 1, F.greatest(end - begin, F.lit(0)))
    # begins and ends stand between tokens, so what is cut has the same tokens as within the text; a list is cut with its brace, behind which a regular expression can stand
    code = lambda begin, end: blanked(cut(begin, end))
    listed = lambda begin, end: F.substr(code(begin - 1, end), F.lit(2), F.length(text))
    to = lambda x: F.when(x["to"] < 0, size - 1).otherwise(x["to"])
    imports = lambda: _as_kind(
        F.col("_imports"), "imports", is_dynamic=lambda x: x["dynamic"], is_type_only=lambda x: x["only"],
        specifiers=lambda x: F.when(x["begin"].isNull(), F.array().cast("array<string>")).otherwise(_bindings(F.when(x["only"], F.regexp_replace(code(x["begin"], x["end"]), r"^\s*type\s", "")).otherwise(code(x["begin"], x["end"])))),
        type=lambda x: F.when(x["dynamic"], "dynamic").when(x["source"].startswith("."), "relative").otherwise("package"),
    )
    named = lambda x: F.when(x["begin"].isNull(), F.array(x["name"])).otherwise(_names(listed(x["begin"], F.coalesce(x["end"], size))))
    each = lambda: F.flatten(F.transform(F.col("_exports"), lambda x: F.transform(named(x), lambda n: F.struct(
        x["anonymous"].alias("is_anonymous"), (x["default"] | (x["begin"].isNotNull() & (n == "default"))).alias("is_default"), x["only"].alias("is_type_only"), x["line"].alias("line"), n.alias("name"), x["source"].alias("source")))))
    inside = lambda hooks, x: F.array_sort(F.array_distinct(F.transform(F.filter(hooks, lambda h: (h["at"] >= x["at"]) & (h["at"] < F.coalesce(x["end"], size)) & h["name"].startswith("use")), lambda h: h["name"])))
    may_be = lambda: F.filter(F.col("_components"), lambda x: x["name"].rlike(r"^\p{Lu}") & ~F.coalesce(F.col("path").rlike(ROUTE_HANDLER), F.lit(False)))
    logical = lambda x: F.size(F.filter(F.split(x, "\r?\n", -1), lambda y: y.rlike(r"\S") & ~y.rlike(r"^\s*(?://|/\*|\*)")))
    # hooks and exports in a list of one, so that they are made once for a text, and not for each of its components
    components = lambda: F.transform(F.array(F.struct(F.col("_hooks").alias("hooks"), F.col("exports").alias("exports"))), lambda own: _as_kind(
        may_be(), "components", position=lambda x: x["at"], line_count=lambda x: logical(cut(x["at"], F.coalesce(x["end"], size))), jsx_depth=lambda x: markup_nesting(code(x["at"], F.coalesce(x["end"], size))),
        exports=lambda x: F.filter(F.array(x["name"]), lambda n: F.exists(own["exports"], lambda e: e["name"] == n)), hooks=lambda x: inside(own["hooks"], x),
        props=lambda x: F.when(x["begin"].isNull(), F.array().cast("array<string>")).otherwise(split_arguments(cut(x["begin"], to(x)))),
    ))[0]
    hooks = lambda: _as_kind(F.filter(F.col("_hooks"), lambda x: x["name"].startswith("use")), "hooks", position=lambda x: x["at"], arguments=lambda x: split_arguments(cut(x["begin"], to(x))))
    contexts = lambda: _as_kind(F.filter(F.col("_hooks"), lambda x: x["name"].isin("createContext", "useContext")), "contexts", position=lambda x: x["at"], kind=lambda x: F.when(x["name"] == "createContext", "create").otherwise("use"))
    worst = lambda: F.filter(F.array(F.coalesce("_odd", "_unclosed")), lambda x: x.isNotNull())
    module = lambda: F.array(F.struct(F.coalesce(F.greatest(F.size("_functions"), F.lit(0)), F.lit(0)).alias("function_count"), F.size(F.split("text", "\n", -1)).alias("line_count"))).cast(_type_of("module"))
    if "exports" in needed:
        t = t.withColumn("exports", _as_kind(each(), "exports"))
    made = {
        "imports": imports, "exports": lambda: F.col("exports"), "components": components, "hooks": hooks, "contexts": contexts, "routes": lambda: _as_kind(F.col("_routes"), "routes"),
        "symbols": lambda: _as_kind(F.col("_symbols"), "symbols"), "errors": lambda: _as_kind(worst(), "errors", severity=lambda x: F.lit("error")), "module": module,
    }
    return t.select("file_id", "path", *(f().alias(k) for k, f in made.items() if k in kinds))


def kind_of(extracted: DataFrame, kind: str) -> DataFrame:
    """The facts of one kind: file_id and their columns; with an id where facts have a position."""
    # explode would have Spark ask first whether there are any, and make the facts again for that
    rows = extracted.select("file_id", F.explode_outer(kind).alias("x")).where("x IS NOT NULL").select("file_id", "x.*")
    names = {"components": "component", "hooks": "hook", "contexts": "context", "routes": "route"}
    if kind in names:
        return rows.withColumn("id", key(F.col("file_id"), names[kind], F.col("path" if kind == "routes" else "name"), F.col("position")))
    if kind == "symbols":
        return rows.withColumn("id", key(F.col("file_id"), "symbol", F.col("type"), F.col("name"), F.col("position")))
    return rows


def modules(extracted: DataFrame) -> DataFrame:
    """id, file_id, path, function_count, line_count (physical), n_imports, n_exports."""
    own = extracted.select("file_id", "path", F.size("imports").alias("n_imports"), F.size("exports").alias("n_exports"), F.explode_outer("module").alias("x"))
    return own.select("file_id", "path", "n_imports", "n_exports", "x.*").withColumn("id", key(F.col("file_id"), "module"))


def file_routes(files: DataFrame, framework: str) -> DataFrame:
    """The routes that paths of a Next project stand for: app/.../page or route, and pages/..."""
    if framework != "next":
        return files.select(F.col("id").alias("file_id"), F.lit("").alias("path"), F.lit("").alias("kind"), F.lit(1).alias("line"), F.lit(1).alias("column")).limit(0)
    app = F.regexp_extract("path", r"^(?:.*/)?app(/.*)?/(?:page|route)\.[^./]+$", 1)
    pages = F.regexp_replace(F.regexp_extract("path", r"^(?:.*/)?pages/(.*)\.[^./]+$", 1), "(^|/)index$", "")
    kind = F.when(F.col("path").rlike(r"(^|/)app/(?:.*/)?(?:page|route)\.[^./]+$"), "next-app").when(F.col("path").rlike(r"(^|/)pages/.+\.[^./]+$"), "next-pages")
    rows = files.withColumn("kind", kind).where(F.col("kind").isNotNull())
    path = F.when(F.col("kind") == "next-app", F.when(app == "", F.lit("/")).otherwise(app)).otherwise(F.concat(F.lit("/"), pages))
    return rows.select(F.col("id").alias("file_id"), path.alias("path"), "kind", F.lit(1).alias("line"), F.lit(1).alias("column")).withColumn("id", key(F.col("file_id"), "route", F.col("path")))
