"""A plain reader of one source, to compare the extraction with: facts from JavaScript and TypeScript sources: imports, exports, components, hooks, contexts, routes, symbols, errors.

No compiler is at hand: comments, strings, templates and regular expressions are blanked first, keeping every position, and the
facts are read from what is left by patterns and bracket matching. So unusual layouts may be missed; the tests say what is covered.
An `export default` of an expression gives no export, as it carries no name.
"""

from __future__ import annotations

import re

_SKIP = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*(?:`|\Z)|(?<=[=(,:\[!&|?{};])\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*""", re.S)
_IMPORT = re.compile(r"""\bimport\s+(type\s+)?(?:([\w$*\s{},]+?)\s*from\s*)?(["'])([^"'\n]*)\3""")
_DYNAMIC = re.compile(r"""\bimport\s*\(\s*(["'])([^"'\n]*)\1""")
_EXPORT = re.compile(r"""\bexport\s+(?:(type\s+)?(\*)(?:\s+as\s+([\w$]+))?\s*from\s*(["'])([^"'\n]*)\4|(type\s+)?\{([^}]*)\}(?:\s*from\s*(["'])([^"'\n]*)\8)?|(default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]*)|(default\s+)?(?:abstract\s+)?class\b\s*((?!extends\b|implements\b)[\w$]*)|(?:declare\s+)?(?:const|let|var)\s+([\w$]+))""")
_FUNCTION = re.compile(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^()]*>)?\s*\(")
_CLASS = re.compile(r"\bclass\s+([A-Za-z_$][\w$]*)[^{;]*\{")
_VARIABLE = re.compile(r"\b(?:const|let|var)\s+([A-Z][\w$]*)\s*(?::[^=\n]+)?=\s*(?:(?:async\s*)?(\()|(?:async\s+)?[\w$]+\s*=>|(?:React\s*\.\s*)?(?:memo|forwardRef|lazy)\b\s*(?:<[^()]*>)?\s*(\())")
_HOOK = re.compile(r"(?<![\w$])(use[\w$]*|createContext)\s*(?:<[^()]*>)?\s*\(")
_ROUTE = re.compile(r"""<Route\b[^>]*?\bpath\s*=\s*\{?\s*(["'])([^"'\n]*)\1""")
_SYMBOL = re.compile(r"\b(function|class|interface|enum|type(?=\s+[\w$]+\s*[=<])|const|let|var)\b\s*\*?\s*((?!(?:extends|implements)\b)[A-Za-z_$][\w$]*)")
_TAG = re.compile(r"<(/?)([A-Za-z][\w.$]*)?(?:\s(?:[^<>{}]|\{[^{}]*\})*)?(/?)>|</>|<>")
_PAIR = {"(": ")", "{": "}", "[": "]"}


def blanked(text: str, strings: bool = True) -> str:
    """The text with comments (and what stands in quotes) as blanks; quotes and line ends stay."""

    def blank(m: re.Match) -> str:
        s = m[0]
        if s[0] in "'\"`":
            return s if not strings else s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + (s[-1] if len(s) > 1 else "")
        return re.sub(r"[^\n]", " ", s)

    return _SKIP.sub(blank, text)


def _closing(text: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`, or the end."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] in "({[":
            depth += 1
        elif text[i] in ")}]":
            depth -= 1
            if depth == 0:
                return i + 1
    return len(text)


def _split(text: str) -> list[str]:
    """At commas outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "({[<") - (c in ")}]") - (c == ">" and text[i - 1 : i] != "=")
        if c == "," and depth <= 0:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in [*out, text[last:]] if x.strip()]


def _bindings(clause: str) -> list[str]:
    """The local names that an import clause binds; a namespace as `* as name`."""
    out = []
    for part in re.findall(r"\{[^}]*\}|\*\s+as\s+[\w$]+|[\w$]+", clause):
        if part[0] == "{":
            out += [re.sub(r"^type\s+", "", x).split(" as ")[-1].strip() for x in _split(part[1:-1])]
        else:
            out.append(re.sub(r"\s+", " ", part))
    return out


def _logical(text: str) -> int:
    return sum(bool(x.strip()) and not x.strip().startswith(("//", "/*", "*")) for x in re.split(r"\r?\n", text))


def _jsx_depth(text: str) -> int:
    now = most = 0
    for m in _TAG.finditer(text):
        if m[0].startswith("</"):
            now -= 1
        else:
            most = max(most, now + 1)
            now += not m[3]
    return most


def _body(code: str, at: int) -> int:
    """Where a function ends whose parameters close at `at`: at the end of its block, or of its expression."""
    brace, arrow, stop = code.find("{", at), code.find("=>", at), code.find(";", at)
    if arrow >= 0 and (brace < 0 or arrow < brace):
        after = arrow + 2 + len(code[arrow + 2 :]) - len(code[arrow + 2 :].lstrip())
        return _closing(code, after) if after < len(code) and code[after] in "({" else (stop if stop >= 0 else len(code))
    return _closing(code, brace) if brace >= 0 else len(code)


def facts(text: str, route_handler: bool = False) -> dict[str, list[dict]]:
    """All facts of one source, by kind."""
    code, plain = blanked(text), blanked(text, strings=False)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    import bisect

    line = lambda at: bisect.bisect_right(starts, at)
    column = lambda at: at - starts[line(at) - 1] + 1
    out: dict[str, list[dict]] = {k: [] for k in ("imports", "exports", "components", "hooks", "contexts", "routes", "symbols", "errors")}
    for m in _IMPORT.finditer(code):
        source = text[m.start(4) : m.end(4)]
        out["imports"].append({"is_dynamic": False, "is_type_only": bool(m[1]), "line": line(m.start()), "source": source, "specifiers": _bindings(m[2] or ""), "type": "relative" if source.startswith(".") else "package"})
    for m in _DYNAMIC.finditer(code):
        out["imports"].append({"is_dynamic": True, "is_type_only": False, "line": line(m.start()), "source": text[m.start(2) : m.end(2)], "specifiers": [], "type": "dynamic"})
    depth, at = 0, 0
    for m in _EXPORT.finditer(code):
        depth += code.count("{", at, m.start()) - code.count("}", at, m.start())
        at = m.start()
        if depth:
            continue
        row = lambda name, default=False, anonymous=False, source=None, only=False, m=m: out["exports"].append({"is_anonymous": anonymous, "is_default": default, "is_type_only": only, "line": line(m.start()), "name": name, "source": source})
        if m[2]:
            row(f"* as {m[3]}" if m[3] else "*", source=text[m.start(5) : m.end(5)], only=bool(m[1]))
        elif m[7] is not None:
            for x in _split(m[7]):
                name = re.sub(r"^type\s+", "", x).split(" as ")[-1].strip()
                row(name, default=name == "default", source=text[m.start(9) : m.end(9)] if m[8] else None, only=bool(m[6]))
        elif m[14]:
            row(m[14])
        else:
            name, default = (m[11], m[10]) if m[11] is not None else (m[13], m[12])
            if name or default:
                row(name or "default", default=bool(default), anonymous=not name)
    exported = {e["name"] for e in out["exports"]}
    hooks = [(m.start(), m[1]) for m in _HOOK.finditer(code) if not re.search(r"\bfunction\s*\*?\s*$", code[: m.start()][-40:])]

    def component(name: str, kind: str, begin: int, end: int, params: str) -> None:
        if name[0].isupper() and not route_handler:
            used = sorted({h for at, h in hooks if begin <= at < end and h.startswith("use")})
            out["components"].append({"name": name, "type": kind, "position": begin, "line_count": _logical(text[begin:end]), "jsx_depth": _jsx_depth(code[begin:end]), "exports": [name] if name in exported else [], "hooks": used, "props": _split(params)})

    n_functions = 0
    for m in _FUNCTION.finditer(code):
        n_functions += 1
        close = _closing(code, m.end() - 1)
        component(m[1], "function", m.start(), _body(code, close), text[m.end() : close - 1])
    for m in _CLASS.finditer(code):
        component(m[1], "class", m.start(), _closing(code, m.end() - 1), "")
    for m in _VARIABLE.finditer(code):
        opened = m.start(2) if m[2] else m.start(3) if m[3] else m.end()
        close = _closing(code, opened) if m[2] or m[3] else m.end()
        if m[2] and not re.match(r"\s*(?::[^=]+)?=>", code[close:]):
            continue
        inner = re.match(r"\(\s*(?:async\s*)?(?:function\s*[\w$]*\s*)?\(", code[opened:]) if m[3] else None
        first = opened + inner.end() - 1 if inner else opened
        params = text[first + 1 : _closing(code, first) - 1] if m[2] or inner else ""
        component(m[1], "arrow", m.start(), close if m[3] else _body(code, m.end() - 2 if not m[2] else close), params)
    for at, name in hooks:
        if name.startswith("use"):
            close = _closing(code, code.index("(", at))
            out["hooks"].append({"name": name, "line": line(at), "column": column(at), "position": at, "arguments": _split(text[code.index("(", at) + 1 : close - 1])})
        if name in ("createContext", "useContext"):
            out["contexts"].append({"name": name, "line": line(at), "column": column(at), "position": at, "kind": "create" if name == "createContext" else "use"})
    for m in _ROUTE.finditer(plain):
        out["routes"].append({"path": m[2], "kind": "react-router", "line": line(m.start()), "column": column(m.start()), "position": m.start()})
    for m in _SYMBOL.finditer(code):
        kind = "variable" if m[1] in ("const", "let", "var") else m[1]
        out["symbols"].append({"name": m[2], "type": kind, "line": line(m.start()), "position": m.start()})
    stack = []
    for i, c in enumerate(code):
        if c in "({[":
            stack.append((c, i))
        elif c in ")}]" and (not stack or _PAIR[stack.pop()[0]] != c):
            out["errors"].append({"line": line(i), "column": column(i), "message": f"unexpected {c}", "severity": "error"})
            break
    else:
        if stack:
            c, i = stack[-1]
            out["errors"].append({"line": line(i), "column": column(i), "message": f"{c} isn't closed", "severity": "error"})
    out["module"] = [{"function_count": n_functions, "line_count": text.count("\n") + 1}]
    return out


