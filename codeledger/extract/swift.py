"""Declarations, bodies and rule detections of one source file.

A brace-aware scanner over the lexer's tokens.  It doesn't claim to be a full parser: it reads
declarations, statements and closures as far as the facts need them, and any unbalanced bracket
is an error diagnostic, which leaves the file without facts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from .lexer import LexError, Token, tokens

# --- fixed values ---------------------------------------------------------------------------
TYPE_KINDS = ("class", "struct", "enum", "actor", "protocol", "extension")
ACCESS = ("open", "public", "package", "internal", "fileprivate", "private")
MUTATING_CALLS = ("append", "insert", "remove", "removeAll", "removeLast", "popLast", "sort", "reverse")
COMPOSITIONS = ("map", "compactMap", "filter", "reduce", "flatMap", "sorted")
UNSAFE_TYPES = ("UnsafePointer", "UnsafeMutablePointer", "UnsafeRawPointer", "UnsafeMutableRawPointer", "UnsafeBufferPointer", "UnsafeMutableBufferPointer", "Unmanaged", "OpaquePointer")
KEYWORDS = ("return", "in", "let", "var", "case", "break", "continue", "fallthrough", "default", "try", "await", "throw", "throws", "as", "is", "nil", "true", "false", "self", "Self", "super", "where", "inout", "async")
LONG_FUNCTION, LONG_PARAMETERS, LARGE_CLASS = 20, 6, 20
# --- end of fixed values --------------------------------------------------------------------
_BLOCK_WORDS = ("if", "guard", "for", "while", "repeat", "do", "catch", "else", "switch", "defer")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_MODIFIERS = (*ACCESS, "static", "final", "override", "mutating", "nonmutating", "lazy", "weak", "unowned", "required", "convenience", "indirect", "dynamic", "nonisolated", "isolated", "async", "distributed")


@dataclass
class Facts:
    """Everything that is known of a file; rows are plain dictionaries."""

    fragments: list[dict] = field(default_factory=list)
    functions: list[dict] = field(default_factory=list)
    closures: list[dict] = field(default_factory=list)
    effects: list[dict] = field(default_factory=list)
    risks: list[dict] = field(default_factory=list)
    compositions: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    detections: list[dict] = field(default_factory=list)
    clumps: list[dict] = field(default_factory=list)
    switches: list[dict] = field(default_factory=list)
    lines: list[dict] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    top_level_variables: int = 0


class Scanner:
    """Reads one file."""

    def __init__(self, path: str, module: str, text: str):
        self.path, self.module, self.facts = path, module, Facts()
        try:
            self.t = tokens(text)
            self.match = self._brackets()
        except LexError as e:
            self.facts.diagnostics.append({"severity": "error", "message": str(e), "line": e.line, "column": e.column})
            self.t = []
            return
        for line, group in self._by_line().items():
            self.facts.lines.append({"number": line, "signature": "|".join(f"{len(x.text)}:{x.text}" for x in group)})
        self.conditional = self._conditional()
        self.declarations(0, len(self.t), [], None)
        self.forced()

    def _brackets(self) -> dict[int, int]:
        found, stack = {}, []
        for i, x in enumerate(self.t):
            if x.kind != "op":
                continue
            if x.text in _OPEN:
                stack.append(i)
            elif x.text in _CLOSE:
                if not stack or _OPEN[self.t[stack[-1]].text] != x.text:
                    raise LexError(f"unbalanced {x.text!r}", x.line, x.column)
                found[stack.pop()] = i
        if stack:
            x = self.t[stack[-1]]
            raise LexError(f"unclosed {x.text!r}", x.line, x.column)
        return found

    def _by_line(self) -> dict[int, list[Token]]:
        out: dict[int, list[Token]] = {}
        for x in self.t:
            out.setdefault(x.line, []).append(x)
        return out

    def _conditional(self) -> list[bool]:
        out, depth = [], 0
        for x in self.t:
            if x.kind == "directive":
                depth += {"if": 1, "endif": -1}.get(x.text, 0)
            out.append(depth > 0)
        return out

    def code_lines(self, a: int, b: int) -> int:
        """Lines that hold a token of [a, b)."""
        return len({x.line for x in self.t[a:b]})

    def place(self, i: int) -> int:
        """Where a token stands, as one number."""
        return self.t[i].line << 20 | self.t[i].column

    def detect(self, rule: str, i: int, message: str) -> None:
        self.facts.detections.append({"rule": rule, "line": self.t[i].line, "column": self.t[i].column, "message": message, "subject": self.subject(i)})

    def subject(self, i: int) -> list[str]:
        """The tokens of what is detected at ``i``: up to the end of its line, a separator, or the bracket
        around it; a bracket in it is taken whole, but for the body of a declaration."""
        k, out = i, []
        while k < len(self.t) and self.t[k].line == self.t[i].line and self.t[k].text not in (";", ",", "{", "}", ")", "]"):
            close = self.match.get(k, k)
            out += [x.text for x in self.t[k : close + 1]]
            k = max(close, k) + 1
        return out or [self.t[i].text]

    def forced(self) -> None:
        """Forced tries and casts, wherever they stand."""
        for k in range(len(self.t) - 1):
            word = self.t[k]
            if word.kind == "word" and word.text in ("try", "as") and self.t[k + 1].text == "!":
                rule = "codeledger.force-try" if word.text == "try" else "codeledger.code-smell.force-cast"
                self.detect(rule, k + 1, "A forced try can crash." if word.text == "try" else "A forced cast can crash.")

    def skip_attribute(self, i: int) -> int:
        i += 2  # the at sign and the name
        while i < len(self.t) and self.t[i].text == "." and self.t[i + 1 : i + 2]:
            i += 2
        return self.match[i] + 1 if i < len(self.t) and self.t[i].text == "(" and not self.t[i].spaced else i

    # --- declarations ---

    def declarations(self, i: int, end: int, scope: list[str], owner: dict | None) -> int:
        """Members of [i, end); returns how many there are."""
        members = 0
        start, access, flags = i, None, set()
        while i < end:
            x = self.t[i]
            word = x.text
            if x.kind == "directive" or word == ";":
                i += 1
                start, access, flags = i, None, set()
                continue
            if word == "@":
                name = self.t[i + 1].text if i + 1 < end else ""
                if name == "MainActor" or name.endswith("Actor"):
                    self.risk("globalActorIsolation", i, name, None)
                i = self.skip_attribute(i)
                continue
            if word in _MODIFIERS and x.kind == "word":
                if word in ACCESS:
                    access = word
                flags.add(word)
                if word == "nonisolated":
                    self.risk("nonisolatedDeclaration", i, word, None)
                i += 1
                if i < end and self.t[i].text == "(":
                    inner = {y.text for y in self.t[i : self.match[i]]}
                    if word == "nonisolated" and "unsafe" in inner:
                        flags.add("nonisolated(unsafe)")
                        if owner and owner["kind"] == "actor":
                            self.detect("codeledger.concurrency.actor-nonisolated-unsafe", i - 1, "An actor member is nonisolated(unsafe).")
                    i = self.match[i] + 1
                continue
            if word == "import" and x.kind == "word":
                if i + 1 < end:
                    self.facts.imports.append(self.t[i + 1].text)
                i = self.line_end(i, end)
            elif word in TYPE_KINDS and x.kind == "word" and not (word == "class" and i + 1 < end and self.t[i + 1].text in ("func", "var", "let", "subscript")):
                members += 1
                i = self.type_declaration(i, end, scope, start)
            elif word in ("func", "init", "deinit", "subscript") and x.kind == "word":
                members += 1
                i = self.callable(i, end, scope, owner, access, start)
            elif word in ("var", "let") and x.kind == "word":
                members += 1
                i = self.variable(i, end, scope, owner, flags, access)
            elif word in ("case", "typealias", "associatedtype"):
                members += 1
                i = self.line_end(i, end)
            elif word in _OPEN:
                if word == "{" and owner is None:
                    self.body(i, self.match[i], None, [])
                i = self.match[i] + 1
            elif word == "class":
                flags.add("static")
                i += 1
                continue
            else:
                i += 1
            start, access, flags = i, None, set()
        return members

    def line_end(self, i: int, end: int) -> int:
        line = self.t[i].line
        while i < end and self.t[i].line == line and self.t[i].text != ";":
            i = self.match.get(i, i) + 1
        return i

    def dotted(self, i: int) -> tuple[str, int]:
        name = self.t[i].text.strip("`")
        while i + 2 < len(self.t) and self.t[i + 1].text == "." and self.t[i + 2].kind == "word":
            i += 2
            name += "." + self.t[i].text.strip("`")
        return name, i + 1

    def type_declaration(self, i: int, end: int, scope: list[str], start: int) -> int:
        kind, at = self.t[i].text, i
        if i + 1 >= end or self.t[i + 1].kind != "word":
            return i + 1
        name, j = self.dotted(i + 1)
        while j < end and self.t[j].text != "{":
            j = self.match.get(j, j) + 1
        if j >= end:
            return end
        close = self.match[j]
        head = self.t[i:j]
        for k, y in enumerate(head):
            if y.text == "Sendable":
                unchecked = k > 1 and head[k - 1].text == "unchecked"
                self.risk("uncheckedSendable" if unchecked else "sendableConformance", i + k, "Sendable", None)
                if unchecked:
                    self.detect("codeledger.concurrency.unchecked-sendable", i + k, "Sendable conformance isn't checked.")
        if kind == "actor":
            self.risk("actorIsolation", at, name, None)
        me = {
            "module": self.module, "name": ".".join([*scope, name]), "kind": kind, "is_extension": kind == "extension", "line": self.t[at].line, "column": self.t[at].column, "begin": self.place(at) + 1, "end": self.place(close),
            "code_lines": self.code_lines(start, close + 1), "property_names": [], "referenced_types": sorted(self.references(at + 1, close, name)), "imported_modules": sorted(set(self.facts.imports)), "head": " ".join(x.text for x in self.t[start:j]),
        }
        self.facts.fragments.append(me)
        mine: list[dict] = []
        me["_properties"] = mine
        members = self.declarations(j + 1, close, [*scope, name], me)
        del me["_properties"]
        if len(mine) > 1:
            self.facts.clumps.append({"kind": "properties", "display_name": me["name"], "line": me["line"], "column": me["column"], "elements": mine})
        if kind == "class" and members >= LARGE_CLASS:
            self.detect("codeledger.refactoring.large-class", at, f"{name} has {members} direct members.")
        return close + 1

    def references(self, a: int, b: int, own: str) -> set[str]:
        found = set()
        for k in range(a, b):
            x = self.t[k]
            if x.kind == "word" and x.text[:1].isupper() and x.text != own and (k == 0 or self.t[k - 1].text != "."):
                found.add(self.dotted(k)[0].split(".")[0] if k + 1 < len(self.t) else x.text)
        return found

    def variable(self, i: int, end: int, scope: list[str], owner: dict | None, flags: set[str], access: str | None) -> int:
        mutable = self.t[i].text == "var"
        j = i + 1
        names = []
        if j < end and self.t[j].kind == "word":
            names.append((self.t[j].text.strip("`"), j))
            j += 1
        elif j < end and self.t[j].text == "(":
            names += [(y.text, k) for k, y in enumerate(self.t[j : self.match[j]], j) if y.kind == "word"]
            j = self.match[j] + 1
        kind_text = []
        if j < end and self.t[j].text == ":":
            j += 1
            line = self.t[j].line if j < end else 0
            while j < end and self.t[j].text not in ("=", "{", ";") and self.t[j].line == line:
                stop = self.match.get(j, j) + 1
                kind_text += [y.text for y in self.t[j:stop]]
                j = stop
        if owner is not None:
            owner["property_names"] += [n for n, _ in names]
            if "_properties" in owner and (j >= end or self.t[j].text != "{"):
                owner["_properties"] += [{"name": n, "type": " ".join(kind_text)} for n, _ in names]
        elif not scope:
            self.facts.top_level_variables += len(names)
            if mutable and not self.conditional[i]:
                self.detect("codeledger.refactoring.global-data", i, "A top-level variable is global data.")
        if mutable and ("static" in flags or (owner is None and not scope)):
            self.risk("mutableSharedState", i, names[0][0] if names else "", None)
        if j < end and self.t[j].text == "=":
            j += 1
            line = self.t[j].line if j < end else 0
            while j < end and self.t[j].line == line and self.t[j].text != ";":
                if self.t[j].text == "{" and self.accessors(j):
                    break
                if self.t[j].text == "{":
                    self.closure(j, owner)
                j = self.match.get(j, j) + 1
                line = self.t[j - 1].line
        if j < end and self.t[j].text == "{" and names:
            close = self.match[j]
            full = ".".join([self.module, *scope, names[0][0]])
            parts = self.accessors(j)
            if not parts:
                parts = [("get", j)]
            for accessor, at in parts:
                self.function(f"{full}.{accessor}", "accessor", at, self.match[at], at, owner, scope, access, ["newValue", "oldValue"] if accessor in ("set", "willSet", "didSet") else [], 0)
            j = close + 1
        return max(j, i + 1)

    def accessors(self, i: int) -> list[tuple[str, int]]:
        """Accessor blocks directly inside the braces at ``i``."""
        out, k = [], i + 1
        while k < self.match[i]:
            if self.t[k].text in ("get", "set", "willSet", "didSet", "_read", "_modify"):
                name, k = self.t[k].text, k + 1
                while k < self.match[i] and self.t[k].text != "{":
                    k = self.match.get(k, k) + 1
                if k < self.match[i]:
                    out.append((name, k))
                    k = self.match[k] + 1
                continue
            if self.t[k].kind == "op" and self.t[k].text == "@":
                k = self.skip_attribute(k)
                continue
            if self.t[k].text in _MODIFIERS:
                k += 1
                continue
            return out
        return out

    def parameters(self, i: int) -> tuple[list[str], list[dict]]:
        """Labels and elements of the parameter list in brackets at ``i``."""
        labels, elements, k, close = [], [], i + 1, self.match[i]
        while k < close:
            while k < close and self.t[k].text == "@":
                k = self.skip_attribute(k)
            if k >= close:
                break
            label = name = self.t[k].text.strip("`")
            k += 1
            if k < close and self.t[k].kind == "word":
                name = self.t[k].text.strip("`")
                k += 1
            labels.append(label)
            kind = []
            if k < close and self.t[k].text == ":":
                k += 1
            while k < close and self.t[k].text not in (",", "="):
                stop = self.match.get(k, k) + 1
                kind += [y.text for y in self.t[k:stop]]
                k = stop
            while k < close and self.t[k].text != ",":
                k = self.match.get(k, k) + 1
            k += 1
            elements.append({"name": name, "type": " ".join(kind)})
        return labels, elements

    def callable(self, i: int, end: int, scope: list[str], owner: dict | None, access: str | None, start: int) -> int:
        word, at = self.t[i].text, i
        j = i + 1
        name = word
        if word == "func" and j < end:
            name = self.t[j].text.strip("`")
            j += 1
        while j < end and self.t[j].text in ("?", "!"):
            j += 1
        depth = 0
        while j < end and (self.t[j].text in ("<",) or depth):
            depth += {"<": 1, ">": -1}.get(self.t[j].text, 0)
            j += 1
        labels: list[str] = []
        elements: list[dict] = []
        if j < end and self.t[j].text == "(":
            labels, elements = self.parameters(j)
            j = self.match[j] + 1
        full = ".".join([self.module, *scope, name]) + ("" if word == "deinit" else "(" + "".join(f"{x}:" for x in labels) + ")")
        if word in ("func", "init", "subscript") and len(elements) > 1:
            self.facts.clumps.append({"kind": "parameters", "display_name": full, "line": self.t[at].line, "column": self.t[at].column, "elements": elements})
        if word in ("func", "init") and len(elements) >= LONG_PARAMETERS:
            self.detect("codeledger.refactoring.long-parameter-list", at, f"{name} has {len(elements)} parameters.")
        line = self.t[j - 1].line
        while j < end and self.t[j].text not in ("{", "}", ";"):
            if self.t[j].line > line and self.t[j].text in ("func", "var", "let", "init", "deinit", "subscript", "case", "@", "#", *TYPE_KINDS, *_MODIFIERS):
                break
            line = self.t[j].line
            j = self.match.get(j, j) + 1
        if j >= end or self.t[j].text != "{":
            return max(j, i + 1)
        close = self.match[j]
        locals_ = [e["name"] for e in elements]
        if word == "subscript":
            for accessor, k in self.accessors(j) or [("get", j)]:
                self.function(full.replace("subscript(", f"subscript.{accessor}(", 1), "accessor", k, self.match[k], k, owner, scope, access, [*locals_, "newValue"], len(elements))
        else:
            statements = self.function(full, "method", j, close, start, owner, scope, access, locals_, len(elements))
            if word == "func" and statements >= LONG_FUNCTION:
                self.detect("codeledger.refactoring.long-function", at, f"{name} has {statements} statements.")
        return close + 1

    # --- bodies ---

    def function(self, name: str, kind: str, a: int, b: int, start: int, owner: dict | None, scope: list[str], access: str | None, shadow: list[str], parameters: int) -> int:
        at = next((k for k in range(start, a) if self.t[k].text in ("func", "init", "deinit", "subscript")), start)
        row = {
            "name": name, "kind": kind, "owner": owner["name"] if owner else None, "module": self.module, "line": self.t[start].line, "column": self.t[start].column, "begin": self.place(at) + 1, "end": self.place(b), "parameters": parameters, "access_level": access,
            "code_lines": self.code_lines(start, b + 1), "complexity": 1, "cognitive": 0, "max_nesting": 0, "bare_refs": [], "self_refs": [], "shadowed": sorted(set(shadow)), "head": " ".join(x.text for x in self.t[start:a]),
        }
        self.facts.functions.append(row)
        statements = self.body(a, b, row, shadow)
        if owner and owner["kind"] == "actor":
            self.across_await(a, b, owner)
        return statements

    def risk(self, category: str, i: int, detail: str, row: dict | None) -> None:
        row = row if row is not None and "name" in row else {}
        self.facts.risks.append({"category": category, "detail": detail, "line": self.t[i].line, "column": self.t[i].column, "function": row.get("name"), "of_line": row.get("line"), "of_column": row.get("column")})

    def statements(self, a: int, b: int) -> list[tuple[int, int]]:
        """Top-level statements between the braces at ``a`` and ``b``: token ranges."""
        out, k, first = [], a + 1, a + 1
        while k < b:
            nxt = self.match.get(k, k) + 1
            joined = nxt < b and (self.t[nxt].text in ("else", "catch", ".", "??", "&&", "||", "?", ":", "+", "-", "*", "/", "=", "==", "{", "while") or self.t[nxt - 1].text in ("=", ",", "&&", "||", "+", "-", "*", "/", "??", "return", "."))
            if self.t[k].text == ";" or nxt >= b or (self.t[nxt].line > self.t[nxt - 1].line and not joined) or self.t[nxt].text == ";":
                if k + 1 > first and self.t[first].text != ";":
                    out.append((first, nxt))
                first = nxt
            k = nxt
        return out

    def across_await(self, a: int, b: int, owner: dict) -> None:
        """A property used by a statement before and one after an awaiting statement."""
        names = set(owner["property_names"])
        parts = self.statements(a, b)
        used = [{x.text for x in self.t[s:e]} & names for s, e in parts]
        for n, (s, e) in enumerate(parts):
            if any(x.text == "await" for x in self.t[s:e]):
                before = set().union(*used[:n]) if n else set()
                after = set().union(*used[n + 1 :]) if n + 1 < len(parts) else set()
                if before & after:
                    at = next(k for k in range(s, e) if self.t[k].text == "await")
                    self.detect("codeledger.concurrency.actor-state-across-await", at, f"{min(before & after)} is used before and after a suspension.")

    def closure(self, i: int, owner: dict | None) -> None:
        close = self.match[i]
        head, k = 0, i + 1
        line = self.t[i].line
        while k < close and self.t[k].line == line and self.t[k].text != "in":
            k = self.match.get(k, k) + 1
        if k < close and self.t[k].text == "in" and self.t[k].line == line:
            names = [x for x in self.t[i + 1 : k] if x.kind == "word"]
            head = len(names) if self.t[i + 1].text != "(" else len(self.parameters(i + 1)[0])
        row = {"owner": owner["name"] if owner and "name" in owner else None, "line": self.t[i].line, "column": self.t[i].column, "code_lines": self.code_lines(i, close + 1), "complexity": 1, "cognitive": 0, "max_nesting": 0, "parameters": head}
        self.facts.closures.append(row)
        self.body(i, close, row, [], closure=True)

    def effect(self, row: dict | None, category: str, i: int, detail: str, closure: bool) -> None:
        if row is not None and "name" in row:
            self.facts.effects.append({"function": row["name"], "category": category, "detail": detail, "line": self.t[i].line, "column": self.t[i].column, "in_closure": closure, "of_line": row["line"], "of_column": row["column"]})

    def body(self, a: int, b: int, row: dict | None, shadow: list[str], closure: bool = False) -> int:
        """Counts of the braces at ``a``..``b``; closures and local functions have their own."""
        block_at: dict[int, str] = {}
        nest: list[int] = []  # ends of nesting blocks
        scopes: list[tuple[int, set[str]]] = [(b, set(shadow))]
        k = a + 1
        while k < b:
            while nest and k >= nest[-1]:
                nest.pop()
            while len(scopes) > 1 and k >= scopes[-1][0]:
                scopes.pop()
            x = self.t[k]
            word = x.text
            before, after = self.t[k - 1].text, self.t[k + 1].text if k + 1 < b else ""
            if x.kind == "directive":
                line = x.line
                while k < b and self.t[k].line == line:
                    k += 1
                continue
            if x.kind == "word" and word in ("func", *[t for t in TYPE_KINDS if t not in ("protocol", "extension")]) and before != ".":
                j = k + 1
                while j < b and self.t[j].text != "{":
                    j = self.match.get(j, j) + 1
                if word == "func" and j < b:
                    k = self.match[j] + 1
                    continue
                if j < b and self.t[k + 1].kind == "word":
                    self.type_declaration(k, b, [f"<local@{x.line}:{x.column}>"], k)
                    k = self.match[j] + 1
                    continue
            if x.kind == "word" and word in _BLOCK_WORDS and before != ".":
                looped_tail = word == "while" and before == "}" and block_at.get(-2) == "repeat-end"
                if not (word == "else" and after == "if"):
                    j = k + 1
                    while j < b and self.t[j].text != "{" and self.t[j].text not in ("}", ";"):
                        j = self.match.get(j, j) + 1
                    tail = word == "while" and self._repeat_tail(k, a)
                    if j < b and self.t[j].text == "{" and not tail:
                        block_at[j] = word
                    looped_tail = tail
                flow = word in ("if", "guard", "for", "repeat", "catch") or (word == "while" and not looped_tail)
                if flow and row is not None:
                    row["complexity"] += 1
                    row["cognitive"] += 1 + len(nest)
                if word == "catch":
                    j = next((j for j in block_at if block_at[j] == "catch" and j > k), None)
                    if j is not None and self.match[j] == j + 1:
                        self.detect("codeledger.code-smell.empty-catch", k, "An empty catch hides an error.")
                if word == "switch":
                    self.switch(k, b, row)
            elif x.kind == "word" and word == "case" and before != "." and self._in_switch(k, a, b) and row is not None:
                row["complexity"] += 1
                row["cognitive"] += 1 + len(nest)
            elif word in ("&&", "||") and row is not None:
                row["complexity"] += 1
            elif word == "?" and x.spaced and x.kind == "op" and row is not None:
                row["complexity"] += 1
                row["cognitive"] += 1 + len(nest)
            elif word == "{":
                if k in block_at:
                    if block_at[k] in ("if", "for", "while", "repeat", "catch"):
                        nest.append(self.match[k])
                    elif block_at[k] == "switch":
                        nest.append(self.match[k])
                    scopes.append((self.match[k], set()))
                    if row is not None:
                        row["max_nesting"] = max(row["max_nesting"], len(nest))
                else:
                    impure = self._impure(k, self.match[k])
                    call = self._call_before(k)
                    if call in COMPOSITIONS and row is not None and "name" in row:
                        self.facts.compositions.append({"function": row["name"], "operation": call, "line": x.line, "column": x.column, "impure": impure, "of_line": row["line"], "of_column": row["column"]})
                    if impure:
                        self.effect(row, "closureEffect", k, call or "", closure)
                    self.closure(k, row)
                    k = self.match[k] + 1
                    continue
            if word == "try" or word == "throw":
                self.effect(row, "throwingEffect", k, word, closure)
            elif word == "await":
                self.effect(row, "asyncEffect", k, word, closure)
                self.risk("isolationCrossing", k, word, row)
            elif word in ("=", "+=", "-=", "*=", "/=", "%=") and x.kind == "op" and not self._binds(k, a):
                target = self._target(k)
                self.effect(row, "propertyWrite" if target.startswith("self.") or "." in target else "mutation", k, target, closure)
            elif word == "&" and before in ("(", ",", ":") and self.t[k + 1].kind == "word":
                self.effect(row, "inoutMutation", k, after, closure)
            elif x.kind == "word" and before == "." and word in MUTATING_CALLS and after == "(":
                self.effect(row, "mutation", k, word, closure)
            elif x.kind == "word" and word == "Task" and (after in ("{", ".") or after == "("):
                self.risk("unstructuredTask", k, word, row)
            elif x.kind == "word" and word in UNSAFE_TYPES:
                self.risk("unsafeEscapeHatch", k, word, row)
            if x.kind == "word" and word in ("let", "var") and k + 1 < b and self.t[k + 1].kind == "word":
                scopes[-1][1].add(self.t[k + 1].text)
            if row is not None and "bare_refs" in row and x.kind == "word":
                if before == "." and k >= 2 and self.t[k - 2].text == "self":
                    if word not in row["self_refs"]:
                        row["self_refs"].append(word)
                elif before != "." and after != ":" and word.isidentifier() and not any(word in s for _, s in scopes) and word not in row["bare_refs"] and word not in _BLOCK_WORDS and word not in KEYWORDS:
                    row["bare_refs"].append(word)
            if row is not None and "name" in row and x.kind == "word" and after == "(" and not self.t[k + 1].spaced and word not in _BLOCK_WORDS:
                labels = []
                for n in range(k + 2, self.match[k + 1]):
                    if n == k + 2 or self.t[n - 1].text == "," and self._depth_one(k + 1, n):
                        labels.append(self.t[n].text + ":" if n + 1 < self.match[k + 1] and self.t[n + 1].text == ":" and self.t[n].kind == "word" else "_:")
                callee = word
                j = k
                while j >= 2 and self.t[j - 1].text == "." and self.t[j - 2].kind == "word":
                    j -= 2
                    callee = self.t[j].text + "." + callee
                self.facts.calls.append({"function": row["name"], "callee": callee, "labels": "".join(labels), "line": x.line, "column": x.column, "of_line": row["line"], "of_column": row["column"]})
            k += 1
        return len(self.statements(a, b)) if row is not None and not closure else 0

    def _depth_one(self, open_: int, n: int) -> bool:
        k = open_ + 1
        while k < n:
            k = self.match.get(k, k) + 1
        return k == n

    def _repeat_tail(self, k: int, a: int) -> bool:
        if self.t[k - 1].text != "}":
            return False
        start = next((s for s, e in self.match.items() if e == k - 1), None)
        return start is not None and self.t[start - 1].text == "repeat"

    def _in_switch(self, k: int, a: int, b: int) -> bool:
        """Whether ``case`` at ``k`` labels a switch case, not an if-case pattern."""
        return self.t[k - 1].text not in ("if", "guard", "while", "for", ",") and not (self.t[k - 1].text == "," and self.t[k - 1].line == self.t[k].line)

    def _call_before(self, k: int) -> str | None:
        j = k - 1
        if self.t[j].text == ")":
            j = next(s for s, e in self.match.items() if e == j) - 1
        if self.t[j].text == "(":
            j -= 1
        return self.t[j].text if self.t[j].kind == "word" else None

    def _impure(self, a: int, b: int) -> bool:
        for k in range(a + 1, b):
            if self.t[k].text in ("=", "+=", "-=", "*=", "/=") and not self._binds(k, a):
                return True
            if self.t[k].text in MUTATING_CALLS and self.t[k - 1].text == "." and self.t[k + 1].text == "(":
                return True
        return False

    def _binds(self, k: int, a: int) -> bool:
        """Whether the equals sign at ``k`` belongs to a let or var."""
        j, line = k - 1, self.t[k].line
        while j > a and self.t[j].line == line and self.t[j].text not in ("{", "}", ";"):
            if self.t[j].text in ("let", "var"):
                return True
            j -= 1
        return False

    def _target(self, k: int) -> str:
        j, parts = k - 1, []
        while j >= 0 and (self.t[j].kind == "word" or self.t[j].text in (".", "?", "!")) and self.t[j].line == self.t[k].line:
            parts.append(self.t[j].text)
            j -= 1
        return "".join(reversed(parts))

    def switch(self, k: int, b: int, row: dict | None) -> None:
        """A switch on a simple discriminator with two cases or more."""
        j = k + 1
        words = []
        while j < b and self.t[j].text != "{":
            words.append(self.t[j].text)
            j = self.match.get(j, j) + 1
        if j >= b or not all(w.isidentifier() or w in (".", "(", ")") for w in words):
            return
        close, labels, n, conditional = self.match[j], [], j + 1, False
        while n < close:
            x = self.t[n]
            if x.text == "case" and self.t[n - 1].text not in ("if", "guard", "while", "for", ","):
                parts = []
                conditional = conditional or self.conditional[n]
                n += 1
                while n < close and self.t[n].text != ":":
                    stop = self.match.get(n, n) + 1
                    parts += [y.text for y in self.t[n:stop]]
                    n = stop
                labels.append(" ".join(parts))
            else:
                n = self.match.get(n, n) + 1
        if len(labels) >= 2:
            scope = row["name"].rsplit(".", 1)[0] if row and "name" in row and "." in row["name"] else self.module
            self.facts.switches.append({"scope": scope, "discriminator": "".join(words), "case_shape": labels, "line": self.t[k].line, "column": self.t[k].column, "conditional": conditional})


def parse(path: str, module: str, text: str) -> Facts:
    """The facts of one file; none but the diagnostics if it has an error."""
    return Scanner(path, module, text).facts


def rule_counts(facts: Facts) -> Counter:
    return Counter(d["rule"] for d in facts.detections)
