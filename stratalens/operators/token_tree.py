"""Rust sources as rows of tokens: brackets, items, complexity and unread error arms.

A source is cut into tokens by one expression (strings, raw strings, characters, lifetimes, nested
comments), so that what follows sees code only. Everything else is windows over the rows of a file:
running sums give a token's depth; brackets of one level alternate, so a bracket's partner is its
neighbour among them; the last opening of a level is what encloses a token. Sources are dealt by
path before they are cut, so their tokens do not shuffle, and no window holds more than one file.

What a macro invocation or an attribute holds is not code yet, and is left out.

``source_items``, ``source_complexity``, ``source_arms``, ``broken`` and ``unread_findings`` take sources
and read each alone (``rust_scan``): the same facts without rows of tokens, at a small part of the time.
``items``, ``complexity`` and ``unread_arms`` are for callers that have a ``tree``.

Defined cases: null and empty texts have no tokens; sources whose brackets do not match, with open
strings or comments, a byte order mark after the start, or a few forms that no grammar has, are
``broken`` and have no facts; a path stands for one source; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import by_path
from . import rust_scan as R
from .rust_scan import ITEM_WORDS, KINDS, OPENING_WORDS, SCOPES


NAME = R.name_pattern(r"\p{L}", r"\p{N}")
TOKEN = R.token_pattern(r"\p{L}", r"\p{N}")
CORE = R.core_pattern(r"\p{L}")
ROWS_OUT = 20_000  # facts of a batch that Python hands over at once


def _token() -> Column:
    return F.col("token")


def _file():
    return W.partitionBy("path").orderBy("pos")


def _before():
    return _file().rowsBetween(W.unboundedPreceding, -1)


def _so_far():
    return _file().rowsBetween(W.unboundedPreceding, 0)


def _is_name(c: Column) -> Column:
    return c.rlike(rf"^{NAME}$")


def _operand_ends(c: Column) -> Column:
    """Whether an operand may end with this token."""
    return F.coalesce(c.rlike(r"""^[\p{L}_0-9)\]?]|["']$""") & ~c.isin(OPENING_WORDS), F.lit(False))


def _running(flag: Column, window) -> Column:
    return F.coalesce(F.sum(flag.cast("int")).over(window), F.lit(0))


def tokens(sources: DataFrame, text: str = "text") -> DataFrame:
    """(path, pos, line, token) of all code, in order."""
    dealt = by_path(sources.select("path", F.coalesce(F.col(text), F.lit("")).alias("text")), "text")
    cut = dealt.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    ends = F.length("token") - F.length(F.replace(_token(), F.lit("\n"), F.lit("")))
    numbered = cut.withColumn("line", 1 + F.coalesce(F.sum(ends).over(_before()), F.lit(0)))
    silent = (_token() == "\n") | _token().startswith("//") | (_token().startswith("/*") & (_token() != "/*")) | ((F.col("pos") == 0) & (_token() == "﻿"))
    return numbered.filter(~silent)


def _bracketed(found: DataFrame) -> DataFrame:
    """Adds depth, the group's level, partners, and what is wrong with a token."""
    opens, closes = _token().isin("(", "[", "{"), _token().isin(")", "]", "}")
    d = found.withColumn("opens", opens).withColumn("closes", closes)
    d = d.withColumn("depth", (_running(F.col("opens"), _before()) - _running(F.col("closes"), _before())).cast("int"))
    d = d.withColumn("level", F.when(F.col("opens"), F.col("depth")).when(F.col("closes"), F.col("depth") - 1))
    pairs = W.partitionBy("path", "level").orderBy("pos")
    d = d.withColumn("partner", F.when(F.col("opens"), F.lead("pos").over(pairs)).when(F.col("closes"), F.lag("pos").over(pairs)))
    opener = F.when(F.col("closes"), F.lag("token").over(pairs))
    matching = F.concat(opener, _token()).isin("()", "[]", "{}")
    d = d.withColumn("p1", F.lag("token").over(_file())).withColumn("p2", F.lag("token", 2).over(_file())).withColumn("p3", F.lag("token", 3).over(_file()))
    wrong = (F.col("opens") & F.col("partner").isNull()) | (F.col("closes") & ~F.coalesce(matching, F.lit(False))) | (F.col("level") < 0) | _token().isin('"', "'", "/*", "﻿")
    bang = (F.col("p1") == "!") & _is_name(F.col("p2")) & ~F.col("p2").isin(OPENING_WORDS)
    rules = (F.col("p2") == "!") & (F.col("p3") == "macro_rules")
    macro = F.coalesce(F.col("opens") & (bang | rules), F.lit(False))
    attribute = F.coalesce((_token() == "[") & ((F.col("p1") == "#") | ((F.col("p1") == "!") & (F.col("p2") == "#"))), F.lit(False))
    d = d.withColumn("wrong", wrong).withColumn("macro", macro).withColumn("opaque", macro | attribute)
    shut = F.col("closes") & F.coalesce(F.lag("opaque").over(pairs), F.lit(False))
    d = d.withColumn("inside", _running(F.col("opaque"), _so_far()) - _running(shut, _so_far()) - F.col("opaque").cast("int"))
    return d


def _read(sources: DataFrame, text: str) -> DataFrame:
    """Visible tokens with their neighbours, and the first line that is wrong in their file."""
    d = _bracketed(tokens(sources, text))
    derives = F.when(F.col("opaque") & ~F.col("macro"), F.lead("token").over(_file()) == "derive").when(F.col("macro"), True)
    d = d.withColumn("unexpanded", F.coalesce(derives, F.lit(False))).filter((F.col("inside") <= 0) | F.col("wrong"))
    d = d.select("path", "pos", "line", "token", "depth", "level", "opens", "closes", "partner", "wrong", "macro", "unexpanded")
    for k in (1, 2, 3, 4):
        d = d.withColumn(f"p{k}", F.lag("token", k).over(_file())).withColumn(f"n{k}", F.lead("token", k).over(_file()))
    dangling = ((_token() == ":") & F.col("n1").isin("}", ")", ",")) | ((_token() == "=") & F.col("n1").isin(";", "}", ")", ","))
    begins = (F.col("depth") == 0) & (F.col("p1").isNull() | F.col("p1").isin(";", "}", "]"))
    stray = begins & _is_name(_token()) & ~_token().isin(ITEM_WORDS) & ~F.coalesce(F.col("n1").isin("!", "::"), F.lit(False))
    wrong = F.col("wrong") | F.coalesce(dangling, F.lit(False)) | F.coalesce(stray, F.lit(False))
    return d.withColumn("bad_line", F.min(F.when(wrong, F.col("line"))).over(W.partitionBy("path")))


def tree(sources: DataFrame, text: str = "text") -> DataFrame:
    """Tokens of sources that are not broken, with the item head and the function each is under."""
    return _tree(_read(sources, text).filter("bad_line is null").drop("bad_line", "wrong"))


def _tree(d: DataFrame) -> DataFrame:
    """Adds the item head and the function that each token is under."""
    p1, n1, n2 = F.col("p1"), F.col("n1"), F.col("n2")
    starts = p1.isNull() | p1.isin(";", "}", "{", "]")
    named = F.coalesce(_is_name(n1) & ~n1.isin(OPENING_WORDS), F.lit(False))
    kind = (
        F.when((_token() == "fn") & named, "Function")
        .when(_token().isin("struct", "enum", "trait", "mod", "type") & named, F.create_map(*[F.lit(x) for k in ("struct", "enum", "trait", "mod", "type") for x in (k, KINDS[k])])[_token()])
        .when((_token() == "union") & named & n2.isin("{", "<", "where"), "Union")
        .when((_token() == "const") & named & (n2 == ":") & ~F.coalesce(p1.isin("<", ",", "*"), F.lit(False)), "Constant")
        .when((_token() == "static") & ((named & (n2 == ":")) | (n1 == "mut")), "Static")
        .when((_token() == "impl") & (starts | p1.isin("unsafe", "default")), "Implementation")
        .when((_token() == "extern") & (n1 == "crate"), "ExternCrate")
        .when((_token() == "extern") & ((n1 == "{") | (n2 == "{")), "ForeignModule")
        .when((_token() == "use") & n1.isNotNull(), "Use")
        .when((_token() == "macro_rules") & (n1 == "!"), "MacroDefinition")
        .when(_is_name(_token()) & (n1 == "!") & n2.isin("(", "[", "{") & (starts | (p1 == "::")) & ~_token().isin(OPENING_WORDS), "Invocation")
    )
    d = d.withColumn("kind", kind)
    d = d.withColumn("head", F.last(F.when(F.col("kind").isNotNull(), F.col("pos")), ignorenulls=True).over(_so_far()))
    d = d.withColumn("head_depth", F.last(F.when(F.col("kind").isNotNull(), F.col("depth")), ignorenulls=True).over(_so_far()))
    own = W.partitionBy("path", "head").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("angle", F.coalesce(F.sum(F.when(_token() == "<", 1).when(_token() == ">", -1)).over(own), F.lit(0)))
    d = d.withColumn("head_kind", F.last(F.when(F.col("kind").isNotNull(), F.col("kind")), ignorenulls=True).over(_so_far()))
    stop = ((_token() == ";") | ((_token() == "{") & (F.col("head_kind") != "Use"))) & (F.col("depth") == F.col("head_depth")) & (F.col("angle") == 0) & (F.col("pos") > F.col("head"))
    d = d.withColumn("head_end", F.min(F.when(stop, F.col("pos"))).over(W.partitionBy("path", "head")))
    # the innermost function: the last one begun at the number of functions that are open
    begins = F.coalesce(F.col("kind") == "Function", F.lit(False))
    d = d.withColumn("body", F.coalesce((F.col("pos") == F.col("head_end")) & (F.col("head_kind") == "Function"), F.lit(False)))
    pairs = W.partitionBy("path", "level").orderBy("pos")
    ends = (F.col("body") & (_token() == ";")) | (F.col("closes") & F.coalesce(F.lag("body").over(pairs), F.lit(False)))
    d = d.withColumn("ends", ends)
    d = d.withColumn("open_functions", _running(begins, _so_far()) - _running(F.col("ends"), _before()))
    level = W.partitionBy("path", "open_functions").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("function", F.when(F.col("open_functions") > 0, F.last(F.when(begins, F.col("pos")), ignorenulls=True).over(level)))
    # what encloses a token that opens nothing: the last opening one level up, and whether a match
    arms = W.partitionBy("path", "depth", _token().isin("match", "{")).orderBy("pos")
    d = d.withColumn("match_body", (_token() == "{") & F.coalesce(F.lag("token").over(arms) == "match", F.lit(False)))
    group = W.partitionBy("path", F.when(F.col("opens"), F.col("depth")).otherwise(F.col("depth") - 1)).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("within", F.last(F.when(F.col("opens"), F.col("pos")), ignorenulls=True).over(group))
    d = d.withColumn("in_match", F.coalesce(F.last(F.when(F.col("opens"), F.col("match_body")), ignorenulls=True).over(group), F.lit(False)))
    return d


def _heads(t: DataFrame) -> DataFrame:
    """One row for each item head: its name, end, parameters and the header's own tokens."""
    own = W.partitionBy("path", "head")
    depth, angle = F.col("depth") - F.col("head_depth"), F.col("angle")
    within = t.filter("head is not null and pos <= coalesce(head_end, pos)")
    first = (_token() == "(") & (depth == 0) & (angle == 0) & (F.col("pos") > F.col("head"))
    within = within.withColumn("params", F.min(F.when(first, F.struct("pos", "partner"))).over(own))
    in_params = (F.col("pos") > F.col("params.pos")) & (F.col("pos") < F.col("params.partner"))
    comma = in_params & (_token() == ",") & (depth == 1) & (angle == 0)
    commas = F.count_if(comma)
    last = F.max(F.when(in_params, F.struct("pos", "token")))["token"]
    me = F.min(F.when(in_params & (_token() == "self") & (depth == 1) & F.coalesce(F.col("n1").isin(",", ")", ":"), F.lit(False)), F.col("pos")))
    is_head = F.col("kind").isNotNull()
    one = lambda c: F.max(F.when(is_head, F.col(c)))
    header = F.array_sort(F.collect_list(F.when((F.col("pos") > F.col("head")) & (F.col("pos") < F.col("head_end")), F.struct("pos", "token", "angle", depth.alias("depth"), "n1"))))
    out = within.groupBy("path", F.col("head").alias("pos")).agg(
        *[one(c).alias(c) for c in ("kind", "token", "n1", "n2", "n3", "p1", "p2", "p3", "line", "depth")],
        F.min(F.when((F.col("p1") == "fn") & (F.col("pos") > F.col("head")), F.col("line"))).alias("name_line"),
        F.first("head_end").alias("head_end"),
        F.max(F.when((F.col("pos") == F.col("head_end")) & (_token() == "{"), F.col("partner"))).alias("close"),
        F.when(one("kind") == "Function", F.when(last.isNull(), 0).otherwise(commas + F.when(last == ",", 0).otherwise(1))).cast("long").alias("inputs"),
        F.when(one("kind") == "Function", F.coalesce(me < F.coalesce(F.min(F.when(comma, F.col("pos"))), F.lit(1 << 30)), F.lit(False))).alias("receiver"),
        F.when(one("kind") == "Implementation", header).alias("header"),
    )
    return out.withColumn("end", F.coalesce("close", "head_end"))


def _impl_names(h: DataFrame) -> DataFrame:
    """Adds the head of an impl block's own type, and whether it serves a trait."""
    x = lambda name: lambda s: s[name]
    flat = F.filter("header", lambda s: (s["angle"] == 0) & (s["token"] != ">"))
    serves = F.array_max(F.transform(F.filter(flat, lambda s: (s["token"] == "for") & (s["depth"] == 0) & (s["n1"] != "<")), x("pos")))
    where = F.array_min(F.transform(F.filter(flat, lambda s: (s["token"] == "where") & (s["depth"] == 0)), x("pos")))
    h = h.withColumn("serves", serves).withColumn("where", where)
    after = F.filter(flat, lambda s: (s["pos"] > F.coalesce("serves", F.lit(-1))) & (s["pos"] < F.coalesce("where", F.lit(1 << 30))))
    plain = F.array_join(F.transform(after, x("token")), " ")
    bare = F.regexp_replace(plain, r"^(?:(?:&&?|\*|mut|const|'\S+|\(|\[) )+", "")
    head = F.regexp_replace(F.regexp_extract(bare, r"^((?::: )?[\p{L}_][\p{L}\p{N}_]*(?: :: [\p{L}_][\p{L}\p{N}_]*)*)", 1), " ", "")
    none = (head == "") | head.isin("dyn", "impl", "fn", "unsafe", "extern") | (plain.startswith("(") & F.contains(plain, F.lit(" , ")))
    return h.withColumn("impl_type", F.when(none, "_").otherwise(head)).withColumn("impl_path", F.when(none | ~plain.rlike(r"^(?::: )?[\p{L}_]"), "impl").otherwise(F.element_at(F.split(head, "::"), -1)))


def _enclosing(h: DataFrame, kinds: list[str], name: str) -> DataFrame:
    """(path, pos, scope, above) of each head inside scopes: names from outside, and the innermost kind.

    Scopes nest, so a file's pairs are as many as its heads times their depth.
    """
    scopes = h.filter(F.col("kind").isin([*kinds, "Function", "ForeignModule"]) & F.col("close").isNotNull())
    scopes = scopes.select("path", F.col("pos").alias("s_pos"), F.col("close").alias("s_close"), F.col("kind").alias("s_kind"), F.col(name).alias("s_name"), F.col("head_end").alias("s_open"))
    met = h.select("path", "pos").join(scopes, "path").filter("pos > s_open and pos < s_close")
    chain = F.array_sort(F.collect_list(F.struct("s_pos", "s_kind", "s_name")))
    got = met.groupBy("path", "pos").agg(chain.alias("chain"))
    names = F.transform(F.filter("chain", lambda s: s["s_kind"].isin(kinds)), lambda s: s["s_name"])
    return got.select("path", "pos", F.array_join(names, "::").alias("scope"), F.element_at("chain", -1)["s_kind"].alias("above"))


def _named(t: DataFrame) -> DataFrame:
    h = _impl_names(_heads(t))
    by_kind = F.when(F.col("kind") == "Implementation", F.col("impl_type")).when(F.col("kind") == "ExternCrate", F.col("n2")).when((F.col("kind") == "Static") & (F.col("n1") == "mut"), F.col("n2"))
    by_kind = by_kind.when((F.col("kind") == "ForeignModule"), F.when(F.col("n1") == "{", "extern").otherwise(F.regexp_replace("n1", '"', "")))
    by_kind = by_kind.when(F.col("kind") == "MacroDefinition", F.col("n2")).when(F.col("kind") == "Invocation", F.concat(F.when(F.col("p1") == "::", F.concat("p2", F.lit("::"))).otherwise(""), "token"))
    return h.withColumn("name", by_kind.otherwise(F.regexp_replace("n1", "^r#", "")))


def _visibilities(t: DataFrame) -> DataFrame:
    """(path, pos, visibility) of heads that have one."""
    boundary = _token().isin(";", "{", "}", "]")
    d = t.withColumn("cut", F.coalesce(F.last(F.when(boundary, F.col("pos")), ignorenulls=True).over(_before()), F.lit(-1)))
    d = d.withColumn("pub", F.last(F.when(_token() == "pub", F.struct("pos", "n1")), ignorenulls=True).over(_before()))
    d = d.withColumn("scope_of", F.last(F.when((_token() == "(") & (F.col("p1") == "pub"), F.struct("pos", "partner")), ignorenulls=True).over(_so_far()))
    inner = d.filter((F.col("pos") > F.col("scope_of.pos")) & (F.col("pos") < F.col("scope_of.partner")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"])
    inner = inner.groupBy("path", F.col("scope_of.pos").alias("scope_pos")).agg(F.regexp_replace(F.regexp_replace(F.array_join(texts, " "), "^in ", "in\u0001"), " ", "").alias("inner"))
    heads = d.filter((F.col("kind").isNotNull()) & (F.col("pub.pos") > F.col("cut")))
    restricted = F.col("pub.n1") == "("
    heads = heads.select("path", "pos", F.when(restricted, F.col("scope_of.pos")).alias("scope_pos"))
    label = F.when(F.col("scope_pos").isNull(), "Public").otherwise(F.concat(F.lit("Restricted("), F.replace("inner", F.lit("\u0001"), F.lit(" ")), F.lit(")")))
    return heads.join(inner, ["path", "scope_pos"], "left").select("path", "pos", label.alias("visibility"))


def items(t: DataFrame) -> DataFrame:
    """(path, ordinal, line, kind, name, qualified, visibility, inputs) of every declaration of ``tree``.

    Imports declare the names they bind. A trait's members, impl blocks, foreign modules and macros
    have no visibility of their own; ``inputs`` counts a function's parameters, its receiver too.
    """
    h = _named(t)
    scope = _enclosing(h, SCOPES, "name")
    found = h.join(scope, ["path", "pos"], "left").join(_visibilities(t), ["path", "pos"], "left")
    found = found.filter((F.col("kind") != "Invocation") | F.col("above").isNull() | (F.col("above") == "Module"))
    found = found.filter((F.col("kind") != "Invocation") | (F.col("depth") == 0) | F.col("above").isNotNull())
    leaves = t.filter((F.col("pos") > F.col("head")) & (F.col("pos") <= F.col("head_end")) & F.col("n1").isin(",", "}", ";") & ~_token().isin("{", "}", ","))
    leaves = leaves.select("path", F.col("head").alias("pos"), F.col("pos").alias("leaf"), F.col("token").alias("leaf_name"))
    uses = found.filter("kind = 'Use'").join(leaves, ["path", "pos"])
    others = found.filter("kind <> 'Use'").withColumn("leaf", F.col("pos")).withColumn("leaf_name", F.col("name"))
    both = others.unionByName(uses)
    kind = F.when(F.col("kind") == "Invocation", "MacroDefinition").otherwise(F.col("kind"))
    without = kind.isin("Implementation", "ForeignModule", "MacroDefinition") | ((F.col("above") == "Trait") & kind.isin("Function", "Constant", "TypeAlias"))
    both = both.select("path", "leaf", F.col("line").cast("long").alias("line"), kind.alias("kind"), F.col("leaf_name").alias("name"), F.concat_ws("::", F.nullif("scope", F.lit("")), "leaf_name").alias("qualified"), F.when(without, "NotApplicable").otherwise(F.coalesce("visibility", F.lit("Private"))).alias("visibility"), "inputs", "receiver")
    ordinal = F.row_number().over(W.partitionBy("path").orderBy("leaf")) - 1
    return both.select("path", ordinal.cast("long").alias("ordinal"), "line", "kind", "name", "qualified", "visibility", "inputs", "receiver")


def unexpanded(t: DataFrame) -> DataFrame:
    """(path, n): macro invocations and derives, whose items no reading of the file can know."""
    return t.groupBy("path").agg(F.count_if("unexpanded").alias("n"))


def complexity(t: DataFrame) -> DataFrame:
    """(path, function, line, complexity) of every function with a body.

    One more than its decisions: if, while, for, a match's arms but one, guards, lazy and and or,
    the question mark, let-else. Closures count into their function, inner functions for themselves.
    """
    h = _named(t)
    h = h.withColumn("segment", F.when(F.col("kind") == "Implementation", F.col("impl_path")).otherwise(F.col("name")))
    p1, n1 = F.col("p1"), F.col("n1")
    ends = _operand_ends(p1)
    later = F.row_number().over(W.partitionBy("path", "within", _token() == "=>").orderBy("pos")) > 1
    loops = (_token() == "for") & (n1 != "<") & ~F.coalesce(p1.rlike(r"^[\p{L}_]") & ~p1.isin(OPENING_WORDS) | p1.isin(">", "]", ")"), F.lit(False))
    decides = _token().isin("if", "while") | loops | ((_token() == "=>") & F.col("in_match") & later) | (_token().isin("&&", "||", "?") & ends) | ((_token() == "?") & (p1 == "}")) | ((_token() == "else") & (p1 != "}"))
    d = t.withColumn("decides", F.coalesce(decides, F.lit(False))).filter("decides and function is not null")
    counted = d.groupBy("path", F.col("function").alias("pos")).agg(F.count("*").alias("decisions"))
    scope = _enclosing(h, [*SCOPES, "Function"], "segment").select("path", "pos", "scope")
    functions = h.filter("kind = 'Function' and close is not null").join(scope, ["path", "pos"], "left").join(counted, ["path", "pos"], "left")
    full = F.concat_ws("::", F.nullif("scope", F.lit("")), "segment")
    return functions.select("path", full.alias("function"), F.col("name_line").cast("long").alias("line"), (1 + F.coalesce("decisions", F.lit(0))).cast("long").alias("complexity"))


# ---- arms that take an unread fact and say nothing -----------------------------------------------


def unread_arms(t: DataFrame, binding: str = "applicability") -> DataFrame:
    """(path, function, line, binding, shape) of match arms ``Err(binding) => body`` whose body is empty,
    only goes on, only returns, or ends in Ok."""
    n1, n2, n3, n4 = (F.col(f"n{k}") for k in (1, 2, 3, 4))
    p1, p2, p3, p4 = (F.col(f"p{k}") for k in (1, 2, 3, 4))
    bound = ((n1 == binding) & n2.isin(")", "@")) | (n1.isin("ref", "mut") & (n2 == binding) & n3.isin(")", "@")) | ((n1 == "ref") & (n2 == "mut") & (n3 == binding) & (n4 == ")"))
    starts = lambda c: c.isin("{", ",", "}", "]")
    alone = starts(p2) | ((p2 == "::") & ((_is_name(p3) & (starts(p4) | (p4 == "::"))) | starts(p3)))
    here = W.partitionBy("path", "depth").orderBy("pos")
    ahead = W.partitionBy("path", "depth").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    nearest = lambda test, *what: F.last(F.when(test, F.struct(*what)), ignorenulls=True).over(ahead)
    arrow = (_token() == "=>") & F.col("in_match")
    d = t.withColumn("next_here", F.lead(F.struct("pos", "token", "partner")).over(here))
    # an arm without braces ends at the last comma before the next arrow, for generics have commas too
    comma = F.last(F.when(_token() == ",", F.col("pos")), ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("comma", F.when((_token() == "=>") | (p1 == ","), comma).otherwise(F.col("pos")))
    d = d.withColumn("next_arrow", nearest(_token() == "=>", "pos", "in_match")).withColumn("stop", nearest((_token() == "=>") | F.col("closes"), "comma"))
    patterns = d.filter((_token() == "(") & (p1 == "Err") & bound & alone & F.col("next_here.token").isin("=>", "if") & F.col("next_arrow.in_match") & F.col("function").isNotNull())
    patterns = patterns.select("path", "function", F.col("next_arrow.pos").alias("arm"))
    # the body: to its own brace's partner, or up to what ends the arm
    end = F.when(F.col("next_here.token") == "{", F.col("next_here.partner") + 1).otherwise(F.col("stop.comma"))
    arms = d.filter(arrow).select("path", F.col("pos").alias("arm"), F.col("line").cast("long").alias("line"), end.alias("end"))
    arms = patterns.join(arms, ["path", "arm"])
    body = t.select("path", "pos", "token").join(arms.select("path", "arm", "end"), "path").filter("pos > arm and pos < end")
    depth = F.sum(F.when(_token().isin("(", "["), 1).when(_token().isin(")", "]"), -1).otherwise(0)).over(W.partitionBy("path", "arm").orderBy("pos"))
    outer = body.withColumn("depth", depth).filter((F.col("depth") == 0) | ((F.col("depth") == 1) & _token().isin("(", "[")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ")
    texts = outer.groupBy("path", "arm").agg(text.alias("body"))
    core = F.regexp_extract("body", CORE, 1)
    shape = F.when(F.col("body") == "{ }", "empty").when(core.startswith("continue"), "bare-continue").when(core == "return", "bare-return").when(core != "", "tail-ok")
    names = t.filter("kind = 'Function'").select("path", F.col("pos").alias("function"), F.regexp_replace("n1", "^r#", "").alias("name"))
    found = arms.join(texts, ["path", "arm"]).withColumn("shape", shape).filter("shape is not null").join(names, ["path", "function"])
    return found.select("path", F.col("name").alias("function"), "line", F.lit(binding).alias("binding"), "shape")


# ---- the same facts, each source read alone ------------------------------------------------------


def _facts(sources: DataFrame, text: str, columns: str, read) -> DataFrame:
    """``path`` and the rows that ``read`` makes of each source, which is read alone: nothing shuffles."""
    path = sources.schema["path"].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                new = read(R.Source(batch.column(1)[i].as_py()))
                at += [i] * len(new)
                rows += new
                if len(rows) >= ROWS_OUT or (rows and i + 1 == batch.num_rows):
                    made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *made], names=["path", *names])
                    at, rows = [], []

    return sources.select("path", F.col(text).alias("text")).mapInArrow(run, f"path {path}, {columns}")


def broken(sources: DataFrame, text: str = "text") -> DataFrame:
    """(path, line) of sources that no reader can take, with the first line that is wrong."""
    return _facts(sources, text, "line long", lambda s: [] if s.bad_line is None else [(s.bad_line,)])


def source_items(sources: DataFrame, text: str = "text") -> DataFrame:
    """``items`` of sources."""
    columns = "ordinal long, line long, kind string, name string, qualified string, visibility string, inputs long, receiver boolean"
    return _facts(sources, text, columns, lambda s: s.items() if s.bad_line is None else [])


def source_complexity(sources: DataFrame, text: str = "text") -> DataFrame:
    """``complexity`` of sources."""
    return _facts(sources, text, "function string, line long, complexity long", lambda s: s.complexity() if s.bad_line is None else [])


def source_arms(sources: DataFrame, binding: str = "applicability", text: str = "text") -> DataFrame:
    """``unread_arms`` of sources."""
    return _facts(sources, text, "function string, line long, binding string, shape string", lambda s: s.unread_arms(binding) if s.bad_line is None else [])


def unread_findings(sources: DataFrame, text: str = "text", binding: str = "applicability") -> DataFrame:
    """(rule, path, site): one finding an unread arm, and one for each source that is broken."""
    sites = lambda s: [("unparseable",)] if s.bad_line is not None else [(f"{a[0]}: {a[3]}",) for a in s.unread_arms(binding)]
    return _facts(sources, text, "site string", sites).select(F.lit("unread-reaches-finding").alias("rule"), "path", "site")
