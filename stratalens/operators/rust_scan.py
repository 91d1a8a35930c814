"""What a Rust source declares, read from its text in a few passes over its tokens.

The readings of ``token_tree`` without its rows: a text is cut by the same expression, brackets are
paired on the way, hidden groups (macro invocations, attributes) go, and items, functions and arms
follow from the heads that are left. A source is held alone, so memory is one text and its tokens;
time is linear in them.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

# words that no operand ends with
OPENING_WORDS = ["if", "while", "match", "return", "in", "else", "let", "mut", "ref", "move", "for", "loop", "break", "continue", "as", "where", "impl", "dyn", "unsafe", "async", "static", "const", "fn", "pub", "use", "mod", "struct", "enum", "trait", "type", "extern"]
# words that begin an item, or go on after a closing bracket
ITEM_WORDS = ["pub", "fn", "struct", "enum", "union", "trait", "type", "const", "static", "mod", "impl", "use", "extern", "unsafe", "async", "auto", "default", "macro_rules", "else", "where", "for", "as"]
KINDS = {"fn": "Function", "struct": "Struct", "enum": "Enum", "union": "Union", "trait": "Trait", "type": "TypeAlias", "const": "Constant", "static": "Static", "mod": "Module", "impl": "Implementation"}
SCOPES = ["Module", "Implementation", "Trait"]


def _comment(depth: int) -> str:
    inner = rf"|{_comment(depth - 1)}" if depth else ""
    return rf"/\*[^*/]*+(?:(?:\*(?!/)|/(?!\*){inner})[^*/]*+)*+\*/"


def name_pattern(letter: str, number: str) -> str:
    return rf"(?:r#)?[{letter}_][{letter}{number}_]*+"


def token_pattern(letter: str, number: str, space: str = r"\s", group: int = 1) -> str:
    """The expression of a token; letters and numbers are written as the engine has them.

    ``group`` is the number that its one group has where it stands."""
    return "|".join(
        [
            r"//[^\n]*+",
            _comment(6),
            r"/\*",
            rf'(?:br|cr|r)(#*)"[\s\S]*?"\{group}',
            r'(?:b|c)?"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"',
            r"b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]*\}|[\s\S])|[^'\\\n])'",
            rf"'[{letter}_][{letter}{number}_]*+",
            name_pattern(letter, number),
            rf"[0-9][{letter}{number}_]*+(?:\.[0-9][{letter}{number}_]*+)?",
            r"->|=>|::|\.\.[.=]?|&&|\|\||[<>=!]=|[-+*/%^&|]=",
            r"\n",
            rf"[^{space}]",
        ]
    )


def core_pattern(letter: str) -> str:
    """A body that only goes on, only returns, or ends in Ok: its core is group 1."""
    generic = r"(?: :: < [^{};]* >)?"
    core = rf"(continue(?: '\S+)?|return|(?:[{letter}_]\S*{generic} :: )*Ok{generic} \( \))"
    return rf"^(?:\{{ )*{core}(?: ;)?(?: \}}(?: ;)?)*$"


_IMPL_LEAD = r"^(?:(?:&&?|\*|mut|const|'\S+|\(|\[) )+"
_SPACES = r" \t\n\x0b\f\r"
_PAIRS = {"()", "[]", "{}"}
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")
_BRACKETS = _OPEN | _CLOSE
_STRANGE = frozenset(['"', "'", "/*", "\ufeff"])
_AFTER_COLON, _AFTER_EQUALS = frozenset("}),"), frozenset(";}),")
_OPENING, _ITEM = frozenset(OPENING_WORDS), frozenset(ITEM_WORDS)
_HEADS = frozenset([*KINDS, "extern", "use", "macro_rules"])
_TURNS = _BRACKETS | {"match", "if", "while", "for", "=>", "&&", "||", "?", "else"}
_BOUNDARY = frozenset(";{}]")
_UNNAMED = frozenset(["", "dyn", "impl", "fn", "unsafe", "extern"])


@cache
def _class(major: str, least: int, top: int) -> str:
    """The inside of a character class: all characters of one general category from ``least`` to ``top``."""
    out, start = [], None
    for c in range(least, top + 2):
        held = c <= top and unicodedata.category(chr(c))[0] == major
        if held and start is None:
            start = c
        elif not held and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class _Patterns:
    """The expressions for texts whose characters go up to ``top``."""

    def __init__(self, top: int):
        letter = "a-zA-Z" + (_class("L", 128, top) if top > 127 else "")
        number = "0-9" + (_class("N", 128, top) if top > 127 else "")
        # names and signs that nothing else begins like stand first, and spaces are skipped at once
        plain = rf"[ad-qs-zA-Z_][{letter}{number}_]*+|[()\[\]{{}};,\n]"
        self.tokens = re.compile(rf"[ \t\x0b\f\r]*+({plain}|{token_pattern(letter, number, _SPACES, 2)})").finditer
        self.name = re.compile(name_pattern(letter, number)).fullmatch
        self.operand = re.compile(rf"""^[{letter}_0-9)\]?]|["']$""").search
        self.letter = re.compile(rf"[{letter}_]").match
        self.impl_head = re.compile(rf"((?::: )?[{letter}_][{letter}{number}_]*(?: :: [{letter}_][{letter}{number}_]*)*)").match
        self.impl_named = re.compile(rf"(?::: )?[{letter}_]").match
        self.core = re.compile(core_pattern(letter), re.ASCII).match
        self.impl_lead = re.compile(_IMPL_LEAD, re.ASCII).sub


_patterns = cache(_Patterns)
_wide = re.compile("[\U00010000-\U0010ffff]").search


class Source:
    """One text's visible tokens, and ``bad_line``, the first line that is wrong in it, or None.

    ``words`` has four Nones before and after the tokens, so neighbours need no checks: token k is
    ``words[k + 4]``.
    """

    def __init__(self, text: str | None):
        text = text or ""
        self.p = _patterns(127 if text.isascii() else sys.maxunicode if _wide(text) else 0xFFFF)
        self._pair(*self._cut(text))
        self._judge()

    def is_name(self, t: str | None) -> bool:
        return t is not None and self.p.name(t) is not None

    def _cut(self, text: str) -> tuple[list, list]:
        """All code, in order, and its lines."""
        tokens, lines, line = [], [], 1
        for m in self.p.tokens(text):
            t = m[1]
            if t == "\n":
                line += 1
                continue
            if t[0] != "/" or not (t.startswith("//") or (t.startswith("/*") and t != "/*")):
                tokens.append(t)
                lines.append(line)
            if "\n" in t:
                line += t.count("\n")
        if tokens and tokens[0] == "\ufeff" and text.lstrip(" \t\x0b\f\r").startswith("\ufeff"):
            return tokens[1:], lines[1:]
        return tokens, lines

    def _pair(self, tokens: list, lines: list) -> None:
        depth = hidden = 0
        depths, seen, partner, last, opaque, wrong = [], [], {}, {}, set(), set()
        for i, t in enumerate(tokens):
            depths.append(depth)
            if t in _OPEN:
                last[depth] = i
                if depth < 0:
                    wrong.add(i)
                if hidden <= 0:
                    seen.append(i)
                depth += 1
                p3, p2, p1 = ([None] * 3 + tokens[max(i - 3, 0) : i])[-3:]
                macro = (p1 == "!" and p2 not in _OPENING and self.is_name(p2)) or (p2 == "!" and p3 == "macro_rules")
                if macro or (t == "[" and (p1 == "#" or (p1 == "!" and p2 == "#"))):
                    opaque.add(i)
                    hidden += 1
            elif t in _CLOSE:
                depth -= 1
                o = last.get(depth)
                if o is None or tokens[o] + t not in _PAIRS or depth < 0:
                    wrong.add(i)
                if o is not None:
                    partner[i], partner[o] = o, i
                    if o in opaque:
                        hidden -= 1
                last[depth] = i
                if hidden <= 0:
                    seen.append(i)
            else:
                if hidden <= 0:
                    seen.append(i)
                if t in _STRANGE:
                    wrong.add(i)
        wrong.update(i for i in last.values() if tokens[i] in _OPEN and i not in partner)
        if wrong:
            seen = sorted(wrong.union(seen))
        if len(seen) == len(tokens):
            self.lines, self.depth, self.partner, self.wrong = lines, depths, partner, wrong
        else:
            place = {i: k for k, i in enumerate(seen)}
            tokens, self.lines, self.depth = [tokens[i] for i in seen], [lines[i] for i in seen], [depths[i] for i in seen]
            self.partner = {place[i]: place[o] for i, o in partner.items() if i in place and o in place}
            self.wrong = {place[i] for i in wrong}
        self.n = len(tokens)
        self.words = [None] * 4 + tokens + [None] * 4

    def _judge(self) -> None:
        w, wrong = self.words, self.wrong
        for k, (t, d) in enumerate(zip(w[4:], self.depth)):
            if t == ":":
                if w[k + 5] in _AFTER_COLON:
                    wrong.add(k)
            elif t == "=":
                if w[k + 5] in _AFTER_EQUALS:
                    wrong.add(k)
            elif d == 0 and t not in _ITEM and w[k + 3] in (None, ";", "}", "]") and w[k + 5] not in ("!", "::") and self.is_name(t):
                wrong.add(k)
        self.bad_line = min((self.lines[k] for k in wrong), default=None)

    # ---- heads -----------------------------------------------------------------------------------

    def _kind(self, k: int) -> str | None:
        w = self.words
        t, p1, n1, n2 = w[k + 4], w[k + 3], w[k + 5], w[k + 6]
        starts = p1 is None or p1 in (";", "}", "{", "]")
        named = n1 not in _OPENING and self.is_name(n1)
        if t in ("fn", "struct", "enum", "trait", "mod", "type") and named:
            return KINDS[t]
        if t == "union" and named and n2 in ("{", "<", "where"):
            return "Union"
        if t == "const" and named and n2 == ":" and p1 not in ("<", ",", "*"):
            return "Constant"
        if t == "static" and ((named and n2 == ":") or n1 == "mut"):
            return "Static"
        if t == "impl" and (starts or p1 in ("unsafe", "default")):
            return "Implementation"
        if t == "extern":
            return "ExternCrate" if n1 == "crate" else "ForeignModule" if n1 == "{" or n2 == "{" else None
        if t == "use" and n1 is not None:
            return "Use"
        if t == "macro_rules" and n1 == "!":
            return "MacroDefinition"
        if n1 == "!" and n2 in ("(", "[", "{") and (starts or p1 == "::") and t not in _OPENING and self.is_name(t):
            return "Invocation"
        return None

    def _heads(self) -> list[dict]:
        """The item heads in order, each with its kind, end, body's close and name."""
        w, out = self.words, []
        for k, (t, n1) in enumerate(zip(w[4:-4], w[5:])):
            if t in _HEADS or n1 == "!":
                kind = self._kind(k)
                if kind is not None:
                    out.append({"at": k, "kind": kind})
        for h, after in zip(out, [x["at"] for x in out[1:]] + [self.n]):
            k, kind = h["at"], h["kind"]
            h["angles"], h["end"] = self._header(k, after, kind)
            end = h["end"]
            h["close"] = self.partner[end] if end is not None and w[end + 4] == "{" else None
            h["stop"] = after if end is None else end + 1  # where its own tokens are over
            n1, n2 = w[k + 5], w[k + 6]
            h["segment"] = None
            if kind == "Implementation":
                h["name"], h["segment"] = self._impl_names(h)
            elif kind in ("ExternCrate", "MacroDefinition") or (kind == "Static" and n1 == "mut"):
                h["name"] = n2
            elif kind == "ForeignModule":
                h["name"] = "extern" if n1 == "{" else n1.replace('"', "")
            elif kind == "Invocation":
                p2 = w[k + 2]
                h["name"] = w[k + 4] if w[k + 3] != "::" else None if p2 is None else f"{p2}::{w[k + 4]}"
            else:
                h["name"] = n1.removeprefix("r#")
            h["segment"] = h["segment"] or h["name"]
        return out

    def _header(self, k: int, after: int, kind: str) -> tuple[list, int | None]:
        """The open angle brackets at each of a head's tokens, and where the head ends."""
        w, depth, angle, angles = self.words, self.depth, 0, []
        for j in range(k, after):
            t = w[j + 4]
            if t == "<":
                angle += 1
            elif t == ">":
                angle -= 1
            angles.append(angle)
            if angle == 0 and j > k and (t == ";" or (t == "{" and kind != "Use")) and depth[j] == depth[k]:
                return angles, j
        return angles, None

    def _impl_names(self, h: dict) -> tuple[str, str]:
        """An impl block's own type, and the name it gives to paths: ``impl`` if it has none."""
        w, k, own = self.words, h["at"], self.depth[h["at"]]
        flat = [j for j in range(k + 1, h["end"]) if h["angles"][j - k] == 0 and w[j + 4] != ">"] if h["end"] is not None else []
        outer = [j for j in flat if self.depth[j] == own]
        serves = max((j for j in outer if w[j + 4] == "for" and w[j + 5] != "<"), default=-1)
        where = min((j for j in outer if w[j + 4] == "where"), default=self.n)
        plain = " ".join(w[j + 4] for j in flat if serves < j < where)
        found = self.p.impl_head(self.p.impl_lead("", plain))
        head = found[1].replace(" ", "") if found else ""
        none = head in _UNNAMED or (plain.startswith("(") and " , " in plain)
        return "_" if none else head, "impl" if none or not self.p.impl_named(plain) else head.split("::")[-1]

    def _parameters(self, h: dict) -> tuple[int, bool]:
        """How many parameters a function has, its receiver too, and whether it has one."""
        w, k, own, angles = self.words, h["at"], self.depth[h["at"]], h["angles"]
        start = next((j for j in range(k + 1, h["stop"]) if w[j + 4] == "(" and self.depth[j] == own and angles[j - k] == 0), None)
        if start is None:
            return 0, False
        inner = range(start + 1, min(self.partner[start], h["stop"]))
        commas = [j for j in inner if w[j + 4] == "," and self.depth[j] == own + 1 and angles[j - k] == 0]
        me = next((j for j in inner if w[j + 4] == "self" and self.depth[j] == own + 1 and w[j + 5] in (",", ")", ":")), None)
        count = len(commas) + (w[inner[-1] + 4] != ",") if len(inner) else 0
        return count, me is not None and (not commas or me < commas[0])

    def _scopes(self, heads: list[dict]):
        """Each head with the heads whose bodies hold it, outermost first."""
        held = []
        for h in heads:
            while held and held[-1]["close"] < h["at"]:
                held.pop()
            yield h, held
            if h["close"] is not None and (h["kind"] in SCOPES or h["kind"] in ("Function", "ForeignModule")):
                held.append(h)

    def _restriction(self, at: int) -> str | None:
        """What stands in the brackets after ``pub``; None if nothing does."""
        w, inner = self.words, []
        for j in range(at + 1, self.partner[at]):
            if w[j + 4] == "(" and w[j + 3] == "pub":
                break
            inner.append(w[j + 4])
        if not inner:
            return None
        rest = "".join(inner[1:]).replace(" ", "")
        return f"in {rest}" if inner[0] == "in" and len(inner) > 1 else inner[0].replace(" ", "") + rest

    # ---- facts -----------------------------------------------------------------------------------

    def items(self) -> list[tuple]:
        """(ordinal, line, kind, name, qualified, visibility, inputs, receiver) of ``token_tree.items``."""
        w, out, before, pub = self.words, [], 0, None
        for h, held in self._scopes(self._heads()):
            k, kind = h["at"], h["kind"]
            for j in range(before, k):
                if w[j + 4] in _BOUNDARY:
                    pub = None
                elif w[j + 4] == "pub":
                    pub = j
            before = k
            above = held[-1]["kind"] if held else None
            if kind == "Invocation" and (above not in (None, "Module") or (above is None and self.depth[k])):
                continue
            visibility = "Private"
            if kind in ("Implementation", "ForeignModule", "MacroDefinition", "Invocation") or (above == "Trait" and kind in ("Function", "Constant", "TypeAlias")):
                visibility = "NotApplicable"
            elif pub is not None and w[pub + 5] != "(":
                visibility = "Public"
            elif pub is not None:
                inner = self._restriction(pub + 1)
                visibility = "Private" if inner is None else f"Restricted({inner})"
            inputs, receiver = self._parameters(h) if kind == "Function" else (None, None)
            scope = "::".join(s["name"] for s in held if s["kind"] in SCOPES and s["name"] is not None)
            if kind == "Use":
                names = [w[j + 4] for j in range(k + 1, h["stop"]) if w[j + 5] in (",", "}", ";") and w[j + 4] not in ("{", "}", ",")] if h["end"] is not None else []
            else:
                names = [h["name"]]
            for name in names:
                qualified = "::".join(x for x in (scope or None, name) if x is not None)
                out.append((len(out), self.lines[k], "MacroDefinition" if kind == "Invocation" else kind, name, qualified, visibility, inputs, receiver))
        return out

    def _turns(self, heads: list[dict]):
        """(place, token, its function's head or None, the bracket it is in, whether that is a match's)
        of brackets and of words and signs that may decide."""
        w, depth = self.words, self.depth
        begins, ends = {h["at"] for h in heads if h["kind"] == "Function"}, set()
        for h in heads:
            if h["kind"] == "Function" and h["end"] is not None:
                ends.add(h["end"] if h["close"] is None else h["close"])
        opened, open_functions, begun, matches, groups = 0, 0, {}, {}, {}
        for k, t in enumerate(w[4:-4]):
            turns = t in _TURNS
            if not turns and k not in begins and k not in ends:
                continue
            if k in begins:
                open_functions += 1
                begun[open_functions] = k
            if turns:
                d = depth[k]
                if t == "match" or t == "{":
                    body = t == "{" and matches.get(d) == "match"
                    matches[d] = t
                if t in _OPEN:
                    groups[d] = (k, t == "{" and body)
                opened, in_match = groups.get(d if t in _OPEN else d - 1, (None, False))
                yield k, t, begun.get(open_functions) if open_functions > 0 else None, opened, in_match
            if k in ends:
                open_functions -= 1

    def complexity(self) -> list[tuple]:
        """(function, line, complexity) of ``token_tree.complexity``."""
        w, heads, decisions, arrows = self.words, self._heads(), {}, set()
        for k, t, function, opened, in_match in self._turns(heads):
            if t in _BRACKETS or t == "match":
                continue
            p1, n1 = w[k + 3], w[k + 5]
            if t == "=>":
                decides = in_match and opened in arrows
                arrows.add(opened)
            elif t == "for":
                typed = p1 is not None and ((self.p.letter(p1) and p1 not in _OPENING) or p1 in (">", "]", ")"))
                decides = n1 is not None and n1 != "<" and not typed
            elif t == "else":
                decides = p1 is not None and p1 != "}"
            elif t in ("if", "while"):
                decides = True
            else:
                decides = p1 is not None and ((self.p.operand(p1) and p1 not in _OPENING) or (t == "?" and p1 == "}"))
            if decides and function is not None:
                decisions[function] = decisions.get(function, 0) + 1
        out = []
        for h, held in self._scopes(heads):
            if h["kind"] == "Function" and h["close"] is not None:
                scope = "::".join(s["segment"] for s in held if s["kind"] != "ForeignModule" and s["segment"] is not None)
                out.append(("::".join(x for x in (scope, h["name"]) if x), self.lines[h["at"] + 1], 1 + decisions.get(h["at"], 0)))
        return out

    def _binds(self, k: int, binding: str) -> bool:
        """Whether an arm's whole pattern is Err of the binding, by its opening bracket."""
        w = self.words
        if w[k + 4] != "(" or w[k + 3] != "Err":
            return False
        n1, n2, n3, n4 = w[k + 5 : k + 9]
        p2, p3, p4 = w[k + 2], w[k + 1], w[k]
        bound = (n1 == binding and n2 in (")", "@")) or (n1 in ("ref", "mut") and n2 == binding and n3 in (")", "@")) or (n1 == "ref" and n2 == "mut" and n3 == binding and n4 == ")")
        starts = ("{", ",", "}", "]")
        return bound and (p2 in starts or (p2 == "::" and (p3 in starts or (self.is_name(p3) and (p4 in starts or p4 == "::")))))

    def unread_arms(self, binding: str) -> list[tuple]:
        """(function, line, binding, shape) of ``token_tree.unread_arms``."""
        w, depth = self.words, self.depth
        patterns = {k: None for k, t in enumerate(w[3:-5]) if t == "Err" and self._binds(k, binding)}
        if not patterns:
            return []
        arrows, stops, commas = {}, {}, {}  # whether an arrow is an arm's; the comma before what may end an arm
        for k, t, function, _, in_match in self._turns(self._heads()):
            if k in patterns:
                patterns[k] = function
            elif t == "=>":
                arrows[k] = in_match
        for k, t in enumerate(w[4:-4]):
            if t == "=>" or t in _CLOSE:
                stops[k] = commas.get(depth[k]) if t == "=>" or w[k + 3] == "," else k
            elif t == ",":
                commas[depth[k]] = k
        following, next_arrow, next_stop, ends, arms = {}, {}, {}, {}, {}
        for k in range(self.n - 1, -1, -1):
            d = depth[k]
            here = following.get(d)
            if arrows.get(k):
                if here is not None and w[here + 4] == "{":
                    ends[k] = self.partner[here] + 1
                elif d in next_stop:
                    ends[k] = stops[next_stop[d]]
            elif patterns.get(k) is not None and here is not None and w[here + 4] in ("=>", "if"):
                arm = next_arrow.get(d)
                if arm is not None and arrows[arm]:
                    arms[arm] = patterns[k]
            following[d] = k
            if k in arrows:
                next_arrow[d] = k
            if k in stops:
                next_stop[d] = k
        found = []
        for arm in sorted(arms):
            shape = self._shape(arm, ends[arm]) if ends.get(arm) is not None else None
            if shape:
                found.append((w[arms[arm] + 5].removeprefix("r#"), self.lines[arm], binding, shape))
        return found

    def _shape(self, arm: int, end: int) -> str | None:
        """How an arm's body says nothing, or None if it may say something."""
        outer, level = [], 0
        for t in self.words[arm + 5 : end + 4]:
            level += (t in ("(", "[")) - (t in (")", "]"))
            if level == 0 or (level == 1 and t in ("(", "[")):
                outer.append(t)
        body = " ".join(outer)
        if body == "{ }":
            return "empty"
        found = self.p.core(body)
        if not found:
            return None
        return "bare-continue" if found[1].startswith("continue") else "bare-return" if found[1] == "return" else "tail-ok"
