"""A scanner of Rust source: tokens, items at every depth, what they call and name. No Spark here.

It reads tokens, not a grammar. Known gaps: calls inside macro invocations are not seen, a tuple pattern
looks like a call, types are recognised by position and capital letter.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

# Words of the language that are never names.
KEYWORDS = frozenset("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual yield try".split())
# Words that are read as primitive types.
PRIMITIVES = frozenset("u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 bool str char".split())

_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<comment>//[^\n]*)
    |(?P<block>/\*)
    |(?P<raw>b?r(?P<hashes>\#*)".*?"(?P=hashes))
    |(?P<string>b?"(?:[^"\\]|\\.)*"?)
    |(?P<char>b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))')
    |(?P<lifetime>'[A-Za-z_]\w*)
    |(?P<ident>(?:r\#)?[^\W\d]\w*)
    |(?P<number>\d[\w]*(?:\.\d[\w]*)?)
    |(?P<sign>::|->|=>|\.\.=?|[-+*/%^&|<>=!]=|&&|\|\||.)""",
    re.X | re.S,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


def lex(source: str) -> list[Token]:
    """All tokens but white space; nested block comments are one."""
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        kind, end = m.lastgroup, m.end()
        if kind == "hashes":
            kind = "raw"
        if kind == "block":
            depth, end = 1, m.end()
            while depth and end < len(source):
                step = re.compile(r"/\*|\*/").search(source, end)
                if not step:
                    end = len(source)
                    break
                depth += 1 if step[0] == "/*" else -1
                end = step.end()
            kind = "comment"
        if kind != "space":
            out.append(Token("string" if kind == "raw" else kind, source[at:end], at, end))
        at = end
    return out


@dataclass
class Item:
    kind: str  #: as in the grammar: fn, struct, enum, union, trait, type, const, static, macro, impl, mod, variant, signature
    name: str
    start: int
    end: int
    body: tuple[int, int] | None = None
    children: list[Item] = field(default_factory=list)
    trait: str | None = None
    header: tuple[int, int] = (0, 0)  #: token range
    inner: tuple[int, int] | None = None  #: token range within the body's braces


class Scanner:
    """Items of one source text."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.tokens = [t for t in lex(source) if t.kind != "comment"]
        self.close = self._pairs()
        self.items = self._items(0, len(self.tokens))

    def _pairs(self) -> dict[int, int]:
        stack, close = [], {}
        for i, t in enumerate(self.tokens):
            if t.kind == "sign" and t.text in _OPEN:
                stack.append(i)
            elif t.kind == "sign" and t.text in _CLOSE:
                while stack and _OPEN[self.tokens[stack[-1]].text] != t.text:
                    close[stack.pop()] = i
                if stack:
                    close[stack.pop()] = i
        for i in stack:
            close[i] = len(self.tokens) - 1
        return close

    def _is(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].text in texts and self.tokens[i].kind in ("ident", "sign")

    def _skip(self, i: int) -> int:
        """Behind a bracketed group that begins at i, else behind the token."""
        return self.close[i] + 1 if i in self.close else i + 1

    def _angles(self, i: int, hi: int) -> int:
        """Behind the generics that begin at i."""
        depth = 0
        while i < hi:
            text = self.tokens[i].text
            if text == "<":
                depth += 1
            elif text == ">":
                depth -= 1
                if depth == 0:
                    return i + 1
            elif text in _OPEN:
                i = self._skip(i)
                continue
            elif text in (";", "}") or text == ">=" and depth == 1:
                return i
            i += 1
        return i

    def _until(self, i: int, hi: int, stops: tuple[str, ...]) -> int:
        """The first of ``stops`` from i outside of brackets."""
        while i < hi and self.tokens[i].text not in stops:
            i = self._skip(i) if self.tokens[i].text in _OPEN else i + 1
        return i

    def _item_at(self, i: int, hi: int, inside: str) -> tuple[Item, int] | None:
        first = i
        if self._is(i, "pub"):
            i += 1
            if self._is(i, "("):
                i = self._skip(i)
        while self._is(i, "default", "async", "unsafe", "extern", "const") or i < hi and self.tokens[i].kind == "string" and self._is(i - 1, "extern"):
            if self._is(i, "const") and not self._is(i + 1, "fn", "async", "unsafe", "extern"):
                break
            if self._is(i, "extern") and self._is(i + 1, "crate"):
                break
            i += 1
        if i >= hi or self.tokens[i].kind != "ident":
            return None
        word, name = self.tokens[i].text, self.tokens[i + 1].text if i + 1 < hi else ""
        named = i + 1 < hi and self.tokens[i + 1].kind == "ident"
        start = self.tokens[first].start

        def done(kind: str, title: str, last: int, open_: int | None = None, trait: str | None = None) -> tuple[Item, int]:
            last = min(last, hi - 1, len(self.tokens) - 1)
            item = Item(kind, title, start, self.tokens[last].end, trait=trait, header=(first, open_ if open_ is not None else last + 1))
            if open_ is not None:
                shut = self.close.get(open_, last)
                item.body = (self.tokens[open_].start, self.tokens[shut].end)
                item.inner = (open_ + 1, shut)
            return item, last + 1

        if word == "fn" and named:
            stop = self._until(i, hi, ("{", ";"))
            if self._is(stop, "{"):
                return done("fn", name, self.close.get(stop, hi - 1), stop)
            return done("signature", name, stop)
        if word in ("struct", "union", "enum", "trait", "mod") and named and not (word == "union" and not self._is(i + 2, "{", "<")):
            stop = self._until(i, hi, ("{", ";"))
            if self._is(stop, "{"):
                return done(word, name, self.close.get(stop, hi - 1), stop)
            return done(word, name, stop)
        if word in ("type", "static", "const") and (named or self._is(i + 1, "mut", "_")):
            title = self.tokens[i + 2].text if self._is(i + 1, "mut") else name
            return done(word, title, self._until(i, hi, (";",)))
        if word == "impl" and inside != "type":
            at = self._angles(i + 1, hi) if self._is(i + 1, "<") else i + 1
            stop = self._until(at, hi, ("{", ";"))
            if not self._is(stop, "{"):
                return None
            where, split, depth = stop, None, 0
            for j in range(at, stop):
                text = self.tokens[j].text
                depth += (text == "<") - (text == ">")
                if text == "for" and depth == 0 and not self._is(j + 1, "<"):
                    split = j
                if text == "where" and depth == 0:
                    where = j
                    break
            def raw(a: int, b: int) -> str:
                return self.source[self.tokens[a].start : self.tokens[b - 1].end] if b > a else ""
            owner = raw((split + 1) if split is not None else at, where)
            trait = raw(at, split) if split is not None else None
            return done("impl", f"{trait}_for_{owner}" if trait else f"for_{owner}", self.close.get(stop, hi - 1), stop, trait)
        if word == "macro_rules" and self._is(i + 1, "!") and i + 2 < hi:
            return done("macro", self.tokens[i + 2].text, self._skip(i + 3) - 1)
        if word == "use" or word == "extern" and self._is(i + 1, "crate"):
            return done("use", "", self._until(i, hi, (";",)))
        return None

    def _items(self, lo: int, hi: int, inside: str = "file") -> list[Item]:
        """Items between two tokens; in bodies they may stand between statements."""
        out, i, fresh = [], lo, True
        while i < hi:
            if self._is(i, "#") and (self._is(i + 1, "[") or self._is(i + 1, "!") and self._is(i + 2, "[")):
                i = self._skip(i + (1 if self._is(i + 1, "[") else 2))
                continue
            found = self._item_at(i, hi, inside) if fresh else None
            if found:
                item, i = found
                self._fill(item)
                out.append(item)
                continue
            text = self.tokens[i].text
            if text in _OPEN and inside == "body":
                shut = self.close.get(i, hi)
                out += self._items(i + 1, min(shut, hi), "body")
                i, fresh = shut + 1, True
                continue
            fresh = text in (";", "{", "}")
            i = self._skip(i) if text in _OPEN else i + 1
        return out

    def _fill(self, item: Item) -> None:
        if item.inner is None:
            return
        lo, hi = item.inner
        if item.kind in ("impl", "mod", "trait"):
            item.children = self._items(lo, hi, item.kind)
        elif item.kind == "fn":
            item.children = self._items(lo, hi, "body")
        elif item.kind == "enum":
            item.children = self._variants(lo, hi)

    def _variants(self, lo: int, hi: int) -> list[Item]:
        out, i = [], lo
        while i < hi:
            if self._is(i, "#"):
                i = self._skip(i + 1)
                continue
            stop = self._until(i, hi, (",",))
            if self.tokens[i].kind == "ident":
                out.append(Item("variant", self.tokens[i].text, self.tokens[i].start, self.tokens[stop - 1].end, header=(i, stop)))
            i = stop + 1
        return out

    # --- what items say --------------------------------------------------------------------------

    def own_tokens(self, item: Item, nested: tuple[str, ...]) -> list[int]:
        """Numbers of the item's tokens that no nested item of the given kinds owns."""
        lo = item.header[0]
        hi = item.inner[1] + 1 if item.inner else item.header[1]
        inner = sorted((c.start, c.end) for c in item.children if c.kind in nested)
        starts = [a for a, _ in inner]
        out = []
        for i in range(lo, min(hi, len(self.tokens))):
            at = bisect_right(starts, self.tokens[i].start) - 1
            if at < 0 or self.tokens[i].start >= inner[at][1]:
                out.append(i)
        return out

    def calls_and_types(self, item: Item) -> tuple[list[str], list[str]]:
        """Last names of called functions and methods, and names of types, in order of appearance."""
        nested = ("fn", "struct", "enum", "trait", "impl", "type", "const", "static", "macro", "mod")
        calls, types, skip_to = [], [], -1
        for i in self.own_tokens(item, nested):
            if i < skip_to:
                continue
            t = self.tokens[i]
            if t.kind != "ident":
                continue
            if self._is(i + 1, "!") and self._is(i + 2, *_OPEN):
                skip_to = self._skip(i + 2)
                continue
            if t.text in KEYWORDS and t.text != "Self" or t.text in PRIMITIVES:
                continue
            if self._is(i + 1, "(") and not self._is(i - 1, "fn"):
                calls.append(t.text)
            elif self._type_at(i, item):
                types.append(t.text)
        return calls, types

    def _type_at(self, i: int, item: Item) -> bool:
        t = self.tokens[i]
        if not t.text[:1].isupper() or self._is(i + 1, "::", "(") and not self._is(i + 1, "("):
            return False
        if t.text == item.name and self._is(i - 1, "struct", "enum", "trait", "union", "type", "const", "static", "mod"):
            return False
        before = i - 1
        while self._is(before, "::") and before > 0 and self.tokens[before - 1].kind == "ident":
            before -= 2
        while self._is(before, "&", "mut", "dyn", "impl", "*", "const", "?") or before >= 0 and self.tokens[before].kind == "lifetime":
            before -= 1
        if self._is(before, ":", "->", "<", ",", "impl", "for", "as", "+", "(", "[", "=") and (not self._is(before, ",", "(", "=", "[") or self._in_types(i, item)):
            return True
        return self._is(i + 1, "{") and not self._is(before, "match", "if", "while", "in", ".")

    def _in_types(self, i: int, item: Item) -> bool:
        """Within generics, or in the header of an item or a tuple of types."""
        if item.kind in ("struct", "enum", "variant", "type", "impl", "trait", "union"):
            return item.inner is None or i < item.inner[0] or item.kind in ("struct", "enum", "union")
        depth = 0
        for j in range(i - 1, max(item.header[0], i - 40), -1):
            text = self.tokens[j].text
            depth += (text == ">") - (text == "<")
            if depth < 0:
                return self.tokens[j - 1].kind == "ident" or self._is(j - 1, "::")
            if text in (";", "{", "}"):
                return False
        return False

    def weighted_names(self, item: Item) -> list[tuple[str, float, int]]:
        """(lower-case name, weight by role, line from the item's first) of every identifier of the item."""
        lines = [m.start() for m in re.finditer("\n", self.source)]
        first = bisect_right(lines, item.start - 1) if item.start else 0
        first = bisect_right([p + 1 for p in lines], item.start)
        heavy = item.kind in ("fn", "signature", "struct", "enum", "trait", "impl", "type")
        bodies = [c for c in self._all(item) if c.kind == "fn" and c.inner]
        out = []
        lo, hi = item.header[0], item.inner[1] + 1 if item.inner else item.header[1]
        for i in range(lo, min(hi, len(self.tokens))):
            t = self.tokens[i]
            if t.kind != "ident" or t.text in PRIMITIVES or t.text in KEYWORDS and t.text != "Self":
                continue
            inside = any(b.inner[0] <= i < b.inner[1] and not any(c.header[0] <= i < c.header[1] for c in b.children) for b in bodies)
            weight = (2.0 if self._type_at(i, item) else 1.0) if inside or not heavy else 3.0
            out.append((t.text.lower(), weight, bisect_right([p + 1 for p in lines], t.start) - first))
        return out

    def _all(self, item: Item) -> list[Item]:
        out = [item]
        for child in item.children:
            out += self._all(child)
        return out


def walk(items: list[Item], parents: tuple[Item, ...] = ()):
    for item in items:
        yield item, parents
        yield from walk(item.children, (*parents, item))


# --- rewriting ----------------------------------------------------------------------------------------


def signatures(source: str) -> str:
    """Bodies of functions cut off, data definitions kept whole; the source itself when nothing is left."""
    scanner = Scanner(source)

    def shown(items: list[Item]) -> str:
        out = ""
        for item in items:
            text = source[item.start : item.end]
            if item.kind == "fn" and item.body:
                out += source[item.start : item.body[0]].rstrip() + ";\n"
            elif item.kind in ("impl", "trait") and item.body:
                out += source[item.start : item.body[0]].rstrip() + " {\n" + shown(item.children) + "}\n"
            else:
                out += text + "\n"
        return out

    result = shown(scanner.items)
    return result if result.strip() else source


HIDDEN_NOTE = "// [body hidden to save tokens]\n"


def hidden_bodies(source: str, active: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """Bodies of functions at any depth outside of the active range, in order of their begin."""
    bodies = [item.body for item, _ in walk(Scanner(source).items) if item.kind == "fn" and item.body]
    return sorted(b for b in bodies if active is None or not (b[0] >= active[0] and b[1] <= active[1]))


def skeleton(source: str, active: tuple[int, int] | None = None) -> str:
    out, at = "", 0
    for start, end in hidden_bodies(source, active):
        if start < at:
            continue
        line = source[source.rfind("\n", 0, start) + 1 : start]
        out += source[at:start] + line[: len(line) - len(line.lstrip(" \t"))] + HIDDEN_NOTE
        at = end
    return out + source[at:]


def alias_name(number: int) -> str:
    """_a .. _z, _aa ..: letters counted without a zero."""
    out = ""
    number += 1
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(97 + rest) + out
    return "_" + out


def alias_identifiers(source: str, least: int = 6) -> str:
    """Long identifiers outside of literals and comments under short names with a legend, if that is shorter."""
    tokens = lex(source)
    names = {t.text for t in tokens if t.kind == "ident" and t.text.isascii() and len(t.text) >= least and t.text not in KEYWORDS}
    if not names:
        return source
    aliases = {name: alias_name(i) for i, name in enumerate(sorted(names, key=lambda n: (-len(n), n)))}
    if set(aliases.values()) & {t.text for t in tokens}:
        return source
    out, at = [], 0
    for t in tokens:
        out += [source[at : t.start], aliases.get(t.text, t.text) if t.kind == "ident" else t.text]
        at = t.end
    legend = ",".join(f"{a}={n}" for n, a in sorted(aliases.items(), key=lambda x: x[1]))
    result = f"// aliases: {legend}\n{''.join(out)}{source[at:]}"
    return result if len(result.encode()) < len(source.encode()) else source


def keep_methods(source: str, names: set[str]) -> str:
    """An impl block with only the named functions; without any the header and an empty body."""
    items = Scanner(source).items
    block = next((i for i in items if i.kind == "impl" and i.body), None)
    if block is None:
        return source
    kept = [c for c in block.children if c.kind != "fn" or c.name in names]
    if not any(c.kind == "fn" for c in kept):
        return source[block.start : block.body[0]].rstrip() + " {}"
    return source[block.start : block.body[0] + 1] + "\n" + "".join("    " + source[c.start : c.end] + "\n" for c in kept) + "}"
