"""Facts of one source file: its declarations as a tree of scopes, its imports, and what its members refer to.

A lexer blanks strings and comments of a language out, so that braces in them don't count, and keeps every place. One pass over what
is left keeps a stack of scopes and of open parentheses. What stands between two boundaries (a brace, a semicolon, a blank line)
and before a brace or a semicolon is a head, and a head that declares something opens a scope. The time is linear in the text.

Names aren't resolved here: operators.source_graph does that by joins. Python goes by its own syntax tree. Known limits: expressions
inside of interpolated strings and macros count as text, and functions in functions belong to the outer one.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Declared:
    kind: str  # namespace, class, interface, struct, record, enum, trait, impl, method, constructor, function, property, field, event
    name: str
    start: int
    end: int
    scope: str  # full name of what it is declared in
    signature: str = ""
    modifiers: str = ""
    takes: list[str] = field(default_factory=list)  # types of its parameters, or their names
    bases: list[str] = field(default_factory=list)
    of: str | None = None  # the type of a field or property, as written
    parent: str | None = None  # name of the nearest type around it
    doc: str = ""
    least: int = 0  # arguments that a call must give

    @property
    def qualified(self) -> str:
        return f"{self.scope}.{self.name}" if self.scope else self.name

    @property
    def full_name(self) -> str:
        return f"{self.qualified}({', '.join(self.takes)})" if self.kind in CALLABLE else self.qualified


@dataclass
class Reference:
    relation: str  # call, new, base
    source: int  # which declaration it is in
    target: str | None  # a type as written; for calls the receiver's, none for calls without one
    name: str | None = None
    own: bool = False  # a call on the object itself
    args: int = 0
    at: int = 0


@dataclass
class Imported:
    name: str | None  # the name that it has here; none for all names of the target
    target: str


@dataclass
class Facts:
    declared: list[Declared]
    references: list[Reference]
    imports: list[Imported]
    head: tuple[int, int] | None  # where the imports stand


CALLABLE = ("method", "constructor", "function")
TYPES = ("class", "interface", "struct", "record", "enum", "trait", "impl")

_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_STRING, _CHAR = r'"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)', r"(?<![0-9A-Fa-f])'(?:[^'\\\n]|\\.)*'"
_DIRECTIVE = r"(?m:^[ \t]*#(?:[^\n\\]|\\.)*)"
_LEXES = {
    "csharp": [r'"{3,}.*?"{3,}', r'\$?@\$?"(?:[^"]|"")*"', _DIRECTIVE],
    "java": [r'""".*?"""'],
    "go": ["`[^`]*`"],
    "rust": [r'\bb?r(?P<n>#*)".*?"(?P=n)'],
    "c": [_DIRECTIVE],
    "cpp": [r'R"(?P<n>[^(\s]*)\(.*?\)(?P=n)"', _DIRECTIVE],
    "typescript": [r"`(?:[^`\\]|\\.)*`"],
}
_RUST_CHAR = r"'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'"  # else the sign begins a lifetime
_BLANKS = {k: re.compile("|".join([_LINE, _BLOCK, *own, _STRING, _RUST_CHAR if k == "rust" else _CHAR]), re.S) for k, own in _LEXES.items()}
_NEST = re.compile(r"/\*|\*/")


_LABEL = re.compile(r"\b(?:public|private|protected)\s*:(?!:)")


def blanked(text: str, language: str) -> str:
    """The text with strings and comments as blanks, of the same length and lines."""
    out, at = [], 0
    while m := _BLANKS[language].search(text, at):
        end = m.end()
        if language == "rust" and m[0].startswith("/*"):  # where comments nest
            depth, end = 0, len(text)
            for k in _NEST.finditer(text, m.start()):
                depth += 1 if k[0] == "/*" else -1
                if depth == 0:
                    end = k.end()
                    break
        out += [text[at : m.start()], re.sub(r"[^\n]", " ", text[m.start() : end])]
        at = max(end, m.start() + 1)
    code = "".join(out) + text[at:]
    return _LABEL.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code) if language in ("c", "cpp") else code


def _without_parentheses(head: str) -> str:
    """A head without what stands in parentheses."""
    depth, out = 0, []
    for part in re.split(r"([()])", head):
        depth += (part == "(") - (part == ")")
        if depth == 0 and part not in "()":
            out.append(part)
    return "".join(out)


_WORDS = "public private protected internal static sealed abstract partial final readonly ref unsafe file new strictfp virtual override async extern const volatile required synchronized native default transient export declare pub inline constexpr explicit friend typedef template open".split()
_MODIFIERS = re.compile(rf"(?:(?:{'|'.join(_WORDS)})\b(?:\([^)]*\))?\s*)+")
_NOT_CALLS = frozenset("if for foreach while switch catch lock using fixed return throw new sizeof typeof nameof default await do else try match loop when where select in is as and or not func fn function super base this delegate checked unchecked synchronized assert defer yield case let var const".split())
_ATTRIBUTES = re.compile(r"(?:\s|\[[^\]]*\](?=\s*[\w\[@#])|#!?\[[^\]]*\]|@\w[\w.]*(?!\w)(?:\((?:[^()]|\([^()]*\))*\))?|template\s*<[^{};]*?>(?=\s*[\w]))*")
_TYPE = re.compile(r"(class|interface|struct|enum\s+class|enum\s+struct|enum|record\s+class|record\s+struct|record|@interface|union|trait)\s+(\w+)\s*(?:<[^{};:()]*>)?\s*(?:\([^{}]*?\))?\s*(.*)", re.S)
_NAMESPACE = re.compile(r"(?:namespace|package|mod|module)\s+([\w.:]+)\s*$")
_IMPL = re.compile(r"impl\b\s*(?:<[^{}]*?>)?\s*(?:([\w:]+)(?:<[^{}]*?>)?\s+for\s+)?([\w:]+)", re.S)
_GO_TYPE = re.compile(r"type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface|[\w.*\[\]]+)")
_GO_FUNC = re.compile(r"func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\s*(?=\()")
_NAMED = re.compile(r"(operator\s*\S+|~?[\w:.$#]+)\s*(?:<[^()]*>)?\s*$")
_ARROW = re.compile(r"(?:const|let|var)\s+(\w+)[^=]*=\s*(?:async\s*)?(?:\(.*\)|\w+)\s*(?::[^=]+)?=>\s*$", re.S)
_VARIABLE = re.compile(r"(\w+)\s*(?=[=,]|$)")
_IMPORTS = {
    "csharp": re.compile(r"(?m)^[ \t]*(?:global\s+)?using\s+(?!var\b|\()(?P<all>static\s+)?(?:(?P<name>\w+)\s*=\s*)?(?P<target>[\w.]+)\s*;"),
    "java": re.compile(r"(?m)^[ \t]*import\s+(?:static\s+)?(?P<target>[\w.]+?)(?P<all>\.\*)?\s*;"),
    "go": re.compile(r'(?m)^[ \t]*(?:import\s+)?(?:(?P<name>\w+)[ \t]+)?"(?P<target>[^"\n]+)"[ \t]*\r?$'),
    "rust": re.compile(r"(?m)^[ \t]*(?:pub\s+)?use\s+(?P<target>[\w:]+)(?:::(?P<group>\{[^}]*\}|\*))?(?:\s+as\s+(?P<name>\w+))?\s*;"),
    "c": re.compile(r'(?m)^[ \t]*#\s*include\s+[<"](?P<target>[^>"\n]+)[>"]'),
    "typescript": re.compile(r"""(?m)^[ \t]*import\s+(?:[\w*{},\s$]+?\s+from\s+)?['"](?P<target>[^'"\n]+)['"]"""),
}
_IMPORTS["cpp"] = _IMPORTS["c"]


def listed(text: str) -> list[str]:
    """Parts between the commas outside of all brackets."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "(<[{") - (c in ")>]}")
        if c == "," and depth == 0:
            out.append(text[at:k])
            at = k + 1
    return [p for p in (x.strip() for x in [*out, text[at:]]) if p]


def _bare(name: str) -> str:
    """A type as written, without what it takes, signs and the marks of a path."""
    return re.sub(r"^(?:crate|self)\.", "", re.sub(r"::|->", ".", re.sub(r"<.*|[?&*\[\]\s]|\(.*", "", name, flags=re.S)).strip("."))


def _parameters(text: str, language: str) -> tuple[list[str], int, dict[str, str]]:
    """(types, how many a call must give, types by name) of a list of parameters."""
    types, least, by = [], 0, {}
    for p in listed(text):
        head, _, default = p.partition("=")
        head = re.sub(r"^\s*(?:\[[^\]]*\]|@\w+(?:\([^)]*\))?)\s*", "", head).strip()
        if language in ("go", "rust", "typescript"):
            m = re.match(r"(?:\.\.\.|mut\s+)?([\w$]+)\s*\??\s*(?::\s*|\s)\s*(.+)", head, re.S)
            name, of = (m[1], m[2]) if m else (head, head)
        else:
            words = re.sub(r"\b(?:this|ref|out|in|params|final|const|struct)\s+", "", head)
            m = re.match(r"(.+?[\s*&>\]])(\w+)\s*(?:\[\s*\])?$", words, re.S)
            of, name = (m[1], m[2]) if m else (words, words)
        if head in ("self", "&self", "&mut self", "mut self", "void"):
            continue
        types.append(" ".join(of.split()))
        by[name] = _bare(of)
        least += not (default or head.startswith(("params ", "...")) or "?" in head.split(":")[0] and language == "typescript")
    return types, least, by


class _Pass:
    """One pass over a file of a language with braces."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.code = blanked(text, language)
        self.ends = [m.start() for m in re.finditer("\n", text)]
        self.declared: list[Declared] = []
        self.stack: list[tuple] = []  # (declaration or none, parentheses open around, whether its head goes on, what was near around)
        self.near: tuple[int | None, int | None, int | None] = (None, None, None)  # the nearest declaration, type, and type or callable around
        self.args: dict[int, int] = {}  # arguments by the place of an open parenthesis
        self.variables: dict[int, dict[str, str]] = {}  # types by name, of a callable's parameters and of a type's fields
        self.prefix = ""  # of a namespace without braces

    def open(self, k: int | None, parens: int, goes_on: bool) -> None:
        self.stack.append((k, parens, goes_on, self.near))
        if k is not None:
            kind = self.declared[k].kind
            self.near = (k, k if kind in TYPES else self.near[1], k if kind in (*TYPES, *CALLABLE) else self.near[2])

    def scope(self) -> str:
        return self.declared[self.near[0]].qualified if self.near[0] is not None else self.prefix

    def add(self, kind: str, name: str, start: int, **more) -> int:  # noqa: ANN003
        outer = self.near[1]
        parent = self.declared[outer].name if outer is not None else None
        self.declared.append(Declared(kind, name, start, start, more.pop("scope", None) or self.scope(), parent=more.pop("parent", None) or parent, **more))
        return len(self.declared) - 1

    def head(self, start: int, end: int, body: bool) -> int | None:
        """The declaration that code[start:end] makes, if any. With a body a brace follows, else a semicolon."""
        lead = _ATTRIBUTES.match(self.code, start, end).end()
        words = self.code[lead:end]
        signature = " ".join(self.text[lead:end].split())
        found = _MODIFIERS.match(words)
        modifiers, own = (found[0].split(), words[found.end() :]) if found else ([], words)
        first = start + len(self.code[start:end]) - len(self.code[start:end].lstrip())
        known = {"signature": signature, "modifiers": " ".join(modifiers)}
        inside = self.declared[self.near[2]].kind if self.near[2] is not None else None
        if inside in CALLABLE:
            return None
        if m := _NAMESPACE.match(own):
            name = _bare(m[1])
            if body:
                return self.add("namespace", name, first, **known)
            if self.language in ("csharp", "java"):
                self.add("namespace", name, first, **known)
                self.prefix = name
            return None
        if self.language == "go":
            if m := _GO_TYPE.match(own):
                return self.add({"interface": "interface", "struct": "struct"}.get(m[2], "type"), m[1], first, **known)
            if m := _GO_FUNC.match(own):
                takes, least, by = _parameters(self._inside(own, m.end()), "go")
                k = self.add("method" if m[1] else "function", m[2], first, takes=takes, least=least, parent=m[1], scope=".".join(x for x in (self.prefix, m[1]) if x), **known)
                self.variables[k] = by
                return k
            return None
        if m := _TYPE.match(own):
            return self._type(m, first, known) if body or self.language in ("csharp", "java") and m[1].startswith("record") else None
        if self.language == "rust" and (m := _IMPL.match(own)):
            return self.add("impl", _bare(m[2]), first, bases=[_bare(m[1])] if m[1] else [], **known)
        if self.language == "typescript" and body and (m := _ARROW.search(words)):
            return self.add("function", m[1], first, **known)
        if m := re.match(r"(?:unsafe\s+|extern\s+)*(?:fn|function\*?)\s+([\w$]+)", own):
            return self._callable(m[1], own, own.find("(", m.end()), first, known, inside)
        return self._member(own, first, known, inside, body)

    @staticmethod
    def goes_on(head: str) -> bool:
        """Whether a brace after this head is part of a value, so that the statement goes on after it."""
        return bool(re.search(r"(?<![=<>!])=(?![=>])", _without_parentheses(head))) and not _ARROW.search(head)

    @staticmethod
    def _inside(own: str, opening: int) -> str:
        depth = 0
        for k in range(opening, len(own)):
            depth += (own[k] == "(") - (own[k] == ")")
            if depth == 0:
                return own[opening + 1 : k]
        return own[opening + 1 :]

    def _type(self, m: re.Match, first: int, known: dict) -> int:
        rest = re.split(r"\bwhere\b|\bpermits\b", m[3])[0]
        if self.language in ("java", "typescript"):
            bases = [b for part in re.findall(r"(?:extends|implements)\s+(.*?)(?=\bextends\b|\bimplements\b|$)", rest, re.S) for b in listed(part)]
        else:
            bases = [re.sub(r"^(?:(?:public|private|protected|virtual)\s+)+", "", b) for b in listed(rest.partition(":")[2])]
        kind = {"@interface": "interface", "union": "struct"}.get(m[1], m[1].split()[0])
        return self.add(kind, m[2], first, bases=[b for b in map(_bare, bases) if b], **known)

    def _callable(self, name: str, own: str, opening: int, first: int, known: dict, inside: str | None) -> int:
        takes, least, by = _parameters(self._inside(own, opening), self.language) if opening >= 0 else ([], 0, {})
        scope = None
        if self.language in ("c", "cpp") and "::" in name:
            scope, name = _bare(name).rsplit(".", 1)
        outer = self.near[1]
        owner = self.declared[outer].name if outer is not None else scope
        kind = "function" if owner is None else "constructor" if name in (owner, "constructor") else "method"
        k = self.add(kind, name, first, takes=takes, least=least, scope=scope, parent=scope, **known)
        self.variables[k] = by
        return k

    def _member(self, own: str, first: int, known: dict, inside: str | None, body: bool) -> int | None:
        """A callable, property, event or field."""
        cut = re.search(r"=>|(?<![=<>!])=(?!=)", own)
        head, arrow = (own[: cut.start()], cut[0] == "=>") if cut else (own, False)
        opening = head.find("(")
        if opening >= 0 and (m := _NAMED.search(head[:opening])) and m[1] not in _NOT_CALLS:
            before = head[: m.start()].strip()
            outer = self.near[1]
            constructs = outer is not None and m[1].lstrip("~") == self.declared[outer].name
            # A call is no declaration: that has a type before its name, or is a constructor, or a method of TypeScript.
            if constructs or before and (body or arrow or inside in TYPES) and not re.search(r"[=.]|\b(?:return|new|else|throw|await)\b", before) or self.language == "typescript" and inside in TYPES and body:
                if body or inside in TYPES or arrow:
                    return self._callable(m[1], own, opening, first, known, inside)
            return None
        if inside not in TYPES or opening >= 0 or self.language in ("rust", "c", "cpp", "go"):
            return None
        words = head.split()
        if self.language == "typescript" or self.declared[self.near[1]].kind == "enum" or len(words) < 2 or words[0] in ("return", "throw", "else"):
            return None
        of = re.sub(r"^event\s+", "", head).strip().rsplit(None, 1)[0]
        outer = self.near[1]
        if words[0] == "event":
            kinds, names = "event", [re.split(r"[,=]", words[-1])[0]]
        elif (body or arrow) and (m := re.search(r"(\w+)\s*$", head)):
            kinds, names = "property", [m[1]]
        else:
            kinds = "field"
            flat = [re.split(r"=", x)[0].strip() for x in listed(own)]
            names = [m[1] for x in flat if (m := re.search(r"(\w+)\s*$", x))]
            of = flat[0].rsplit(None, 1)[0] if " " in flat[0] else of
        last = None
        for name in names:
            last = self.add(kinds, name, first, of=_bare(of), **known)
            self.variables.setdefault(outer, {})[name] = _bare(of)
        return last

    def run(self) -> None:
        code, boundary, parens = self.code, 0, 0
        opened: list[list[int]] = []  # (place, commas) of open parentheses
        for m in re.finditer(r"[{}();,]|\n[ \t\r]*(?=\n)|\n", code):
            at, c = m.start(), m[0]
            if c == "(":
                parens += 1
                opened.append([at, 0])
            elif c == ")":
                parens = max(0, parens - 1)
                if opened:
                    place, commas = opened.pop()
                    self.args[place] = commas + (not self.text[place + 1 : at].isspace() and at > place + 1)
            elif c == ",":
                if opened:
                    opened[-1][1] += 1
            elif c == "{":
                goes_on = parens > 0 or bool(self.stack and self.stack[-1][2]) or self.goes_on(code[boundary:at])
                k = None if goes_on else self.head(boundary, at, True)
                self.open(k, parens, goes_on)
                parens = 0
                if not goes_on:
                    boundary = m.end()
                opened.append([at, 0])  # commas between braces aren't those of the call around
            elif c == "}":
                while opened and code[opened[-1][0]] == "(":
                    opened.pop()
                if opened:
                    opened.pop()
                if self.stack:
                    k, parens, goes_on, self.near = self.stack.pop()
                    if k is not None:
                        self.declared[k].end = m.end()
                        if (name := re.match(r"\s*(\w+)\s*;", code[m.end() : m.end() + 200])) and "typedef" in self.declared[k].modifiers and not self.declared[k].name:
                            self.declared[k].name = name[1]
                    if not goes_on:
                        boundary = m.end()
            elif c == ";":
                if parens == 0:
                    had = len(self.declared)
                    if code[boundary:at].strip():
                        self.head(boundary, at, False)
                    for d in self.declared[had:]:
                        d.end = m.end()
                    boundary = m.end()
            elif parens == 0 and (self.language == "go" or self.language == "typescript" or len(c) > 1):
                line = code[boundary:at].strip()
                if self.language == "go" and line and not self.stack:
                    if n := _NAMESPACE.match(line):
                        self.prefix = n[1]
                    elif _GO_TYPE.match(line) and not line.endswith("{"):
                        self.declared[self.head(boundary, at, False)].end = at
                if len(c) > 1 or self.language == "go" or line and not re.search(r"[,(=&|+*.:<]$|\b(?:extends|implements)$", line) and not re.match(r"\s*(?:extends|implements|\{)", code[at : at + 200]):
                    boundary = m.end()
        for k, *_ in self.stack:
            if k is not None:
                self.declared[k].end = len(code)

    def references(self) -> list[Reference]:
        out = [Reference("base", k, b, at=d.start) for k, d in enumerate(self.declared) for b in d.bases]
        callables = sorted((d.start, d.end, k) for k, d in enumerate(self.declared) if d.kind in CALLABLE)
        for start, end, k in callables:
            fields = next((self.variables.get(j, {}) for j in range(k, -1, -1) if self.declared[j].kind in TYPES and self.declared[j].start <= start and self.declared[j].end >= end), {})
            known = fields | self.variables.get(k, {})
            body = self.code[start:end]
            at = re.search(r"\{|=>", body)
            if not at:
                continue
            for m in _LOCAL.finditer(body, at.end()):
                known[m[2] or m[3]] = _bare(m[1] or m[4])
            for m in _CALL.finditer(body, at.end()):
                before = body[max(0, m.start() - 64) : m.start()].rstrip()
                name, path, args = m[2], _bare(m[1]), self.args.get(start + m.end() - 1, 0)
                place = start + m.start()
                if re.search(r"\bnew$", before):
                    out.append(Reference("new", k, f"{path}.{name}" if path else name, at=place))
                elif name in _NOT_CALLS or before.endswith((".", "::", "->", "?.", "fn", "func", "function")):
                    continue
                elif path in ("this", "self", "base", "super", "Self"):
                    out.append(Reference("call", k, None, name, True, args, place))
                else:
                    root, _, rest = path.partition(".")
                    if root in ("this", "self") and rest in fields:
                        path = fields[rest]
                    elif root in known and not rest:
                        path = known[root]
                    elif root in known:
                        continue  # of a member's type nothing is known here
                    out.append(Reference("call", k, path or None, name, False, args, place))
        return out

    def imports(self) -> tuple[list[Imported], tuple[int, int] | None]:
        out, spans = [], []
        first = next((d.start for d in self.declared if d.kind != "namespace"), len(self.text))
        # Strings are blank in the code, and the targets of some languages are strings.
        text = self.text if self.language in ("go", "c", "cpp", "typescript") else self.code
        for m in _IMPORTS[self.language].finditer(text, 0, first):
            g, target = m.groupdict(), _bare(m["target"]) if self.language in ("csharp", "java", "rust") else m["target"]
            spans.append(m.span())
            if self.language == "go":
                out.append(Imported(g["name"] or target.rsplit("/", 1)[-1], target.rsplit("/", 1)[-1]))
            elif group := g.get("group"):
                out += [Imported(None, target)] if group == "*" else [Imported(x, f"{target}.{x}") for x in listed(group[1:-1])]
            elif self.language == "csharp" and not g["name"] or g.get("all"):
                out.append(Imported(None, target))
            else:
                out.append(Imported(g.get("name") or target.rsplit(".", 1)[-1], target))
        return out, (spans[0][0], spans[-1][1]) if spans else None


#: A local variable with a type that is written, or that `new` tells.
_LOCAL = re.compile(r"\b([A-Z][\w.]*)(?:<[^;(){}]*?>)?(?:\[\])?\s+(\w+)\s*(?=[=;,):]|\bin\b)|\b(?:var|let|const|auto)\s+(\w+)\s*=\s*new\s+([\w.]+)")
_CALL = re.compile(r"((?:\b\w+\s*(?:\?\.|\.|::|->)\s*)*)\b([A-Za-z_]\w*)\s*(?:<[\w\s,.?\[\]]*>)?\s*\(")


def _python(text: str, module: str) -> Facts:
    """By the syntax tree; a text that isn't valid raises what the parser does."""
    tree = ast.parse(text)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    lines = text.split("\n")
    out = Facts([], [], [], None)

    def at(line: int, column: int = 0) -> int:
        return starts[line - 1] + len(lines[line - 1].encode()[:column].decode(errors="replace"))

    def dotted(n: ast.AST) -> str | None:
        if isinstance(n, ast.Name):
            return n.id
        inner = dotted(n.value) if isinstance(n, ast.Attribute) else None
        return f"{inner}.{n.attr}" if inner else None

    def of(n: ast.AST | None) -> str | None:
        """The type that an annotation or a construction tells."""
        if isinstance(n, ast.Constant) and isinstance(n.value, str):
            return n.value
        return dotted(n.value if isinstance(n, ast.Subscript) else n) if n is not None else None

    def body(k: int, node: ast.AST, fields: dict[str, str]) -> None:
        a = node.args
        known = {x.arg: t for x in [*a.posonlyargs, *a.args, *a.kwonlyargs] if (t := of(x.annotation))}
        for n in ast.walk(node):
            value = getattr(n, "value", None)
            if isinstance(n, ast.Assign) and isinstance(value, ast.Call) and (t := dotted(value.func)) and t.rsplit(".", 1)[-1][:1].isupper():
                known |= {x.id: t for x in n.targets if isinstance(x, ast.Name)}
            elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and (t := of(n.annotation)):
                known[n.target.id] = t
        for n in ast.walk(node):
            if not isinstance(n, ast.Call):
                continue
            name, args, place = dotted(n.func), len(n.args) + len(n.keywords), at(n.lineno, n.col_offset)
            if isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Call) and dotted(n.func.value.func) == "super":
                out.references.append(Reference("call", k, None, n.func.attr, True, args, place))
            elif name and name != "super":
                path, _, last = name.rpartition(".")
                root, _, rest = path.partition(".")
                if path in ("self", "cls"):
                    out.references.append(Reference("call", k, None, last, True, args, place))
                elif root == "self" and rest in fields:
                    out.references.append(Reference("call", k, fields[rest], last, False, args, place))
                elif root not in ("self", "cls"):
                    out.references.append(Reference("call", k, (known.get(root) if not rest else path) or path or None, last, False, args, place))

    def visit(node: ast.AST, scope: str, parent: str | None, fields: dict[str, str]) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.Import):
                out.imports += [Imported(x.asname or x.name.split(".")[0], x.name if x.asname else x.name.split(".")[0]) for x in n.names]
            elif isinstance(n, ast.ImportFrom):
                up = module.split(".")[: -n.level] if n.level else []
                base = ".".join([*up, *([n.module] if n.module else [])])
                out.imports += [Imported(None if x.name == "*" else x.asname or x.name, base if x.name == "*" else f"{base}.{x.name}") for x in n.names]
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "function" if parent is None else "constructor" if n.name == "__init__" else "method"
                known = {"signature": lines[n.lineno - 1].strip(), "doc": ast.get_docstring(n) or "", "parent": parent}
                d = Declared(kind, n.name, at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset), scope, **known)
                out.declared.append(d)
                k = len(out.declared) - 1
                if kind == "class":
                    d.bases = [b for x in n.bases if (b := of(x))]
                    out.references += [Reference("base", k, b, at=d.start) for b in d.bases]
                    own = {x.target.id: t for x in n.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name) and (t := of(x.annotation))}
                    out.declared += [Declared("field", name, at(x.lineno, x.col_offset), at(x.end_lineno, x.end_col_offset), d.qualified, lines[x.lineno - 1].strip(), of=own.get(name), parent=n.name) for x in n.body if (name := _field(x))]
                    for x in ast.walk(n):
                        if isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and (t := dotted(x.value.func)) and t.rsplit(".", 1)[-1][:1].isupper():
                            own |= {y.attr: t for y in x.targets if isinstance(y, ast.Attribute) and dotted(y) == f"self.{y.attr}"}
                    visit(n, d.qualified, n.name, own)
                else:
                    names = [x.arg for x in [*n.args.posonlyargs, *n.args.args]][1 if parent and not any(dotted(x) == "staticmethod" for x in n.decorator_list) else 0 :]
                    d.takes, d.least = names, max(0, len(names) - len(n.args.defaults))
                    body(k, n, fields)
            else:
                visit(n, scope, parent, fields)

    def _field(x: ast.AST) -> str | None:
        target = x.target if isinstance(x, ast.AnnAssign) else x.targets[0] if isinstance(x, ast.Assign) else None
        return target.id if isinstance(target, ast.Name) else None

    visit(tree, module, None, {})
    heads = [n for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))]
    out.head = (at(heads[0].lineno), at(heads[-1].end_lineno, heads[-1].end_col_offset)) if heads else None
    return out


#: Languages of file extensions that have scopes.
SCOPED = {"cs": "csharp", "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "py": "python", "pyw": "python"}


def module_of(path: str, root: str = "") -> str:
    """The dotted name of a file below a root, without its extension; a package's for its own file."""
    rest = path[len(root) :] if path.startswith(root) else path
    return re.sub(r"(?:^|\.)__init__$", "", rest.rsplit(".", 1)[0].strip("/").replace("/", "."))


def facts(text: str, language: str, module: str = "") -> Facts:
    if language == "python":
        return _python(text, module)
    run = _Pass(text, language)
    if language == "rust":
        run.prefix = re.sub(r"(?:^|\.)(?:mod|lib|main)$", "", module)
    run.run()
    imports, head = run.imports()
    return Facts(run.declared, run.references(), imports, head)


def line_of(text: str) -> Callable[[int], int]:
    """The line of a place; line ends are looked for once."""
    ends = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect_left(ends, at) + 1
