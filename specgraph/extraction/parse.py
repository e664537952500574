"""Languages, and what a file declares, imports and calls. Python by its own parser; other languages by their declarations' shape.

No grammar library is at hand: declarations are found by patterns over code whose comments and strings are blanked, blocks by their braces. What no
pattern knows (overloads by type, nested generics in declarations) is missed, never made up.
"""

from __future__ import annotations

import ast
import re
from functools import lru_cache

from specgraph.extraction.source import Source

# Languages by extension; the longest extension decides.
EXTENSIONS = {
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "jsx", ".java": "java", ".py": "python", ".go": "go",
    ".vue": "vue", ".md": "markdown", ".mdx": "markdown", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".properties": "properties", ".proto": "proto", ".graphql": "graphql", ".gql": "graphql",
    ".xml": "xml", ".json": "json", ".cs": "csharp", ".csproj": "xml", ".gradle": "gradle", ".mod": "gomod", ".txt": "text",
}
SCRIPT = ("typescript", "tsx", "javascript", "jsx", "vue")
_N = r"[A-Za-z_$][\w$]*"


def language(path: str, overrides: dict[str, str] | None = None) -> str | None:
    """A path's language: by the longest extension that fits, a repository's overrides first."""
    name = path.rsplit("/", 1)[-1].lower()
    for table in (overrides or {}, EXTENSIONS):
        fits = [e for e in table if name.endswith(e)]
        if fits:
            return table[max(fits, key=len)]
    return None


def vue_script(text: str) -> str:
    """The script blocks of a single-file component, everything else blanked, so that lines keep their numbers."""
    out, at = [], 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    for m in re.finditer(r"(?is)<script\b[^>]*>(.*?)</script\s*>", text):
        out += [blank(text[at : m.start(1)]), m[1]]
        at = m.end(1)
    return "".join([*out, blank(text[at:])])


@lru_cache(maxsize=64)
def source_of(text: str, lang: str) -> Source:
    """The text to read code from; kept, for several readers ask for the same file."""
    return Source(vue_script(text) if lang == "vue" else text)


def _symbol(s: Source, kind: str, name: str, qualified: str, start: int, end: int, summary: str = "") -> dict:
    first, last = s.line(start), s.line(max(start, end - 1))
    signature = " ".join(s.text[start : s.text.find("\n", start) if "\n" in s.text[start:] else len(s.text)].split())
    return {"kind": kind, "name": name, "qualified_name": qualified, "start_line": first, "end_line": last, "signature": signature, "summary": summary}


def _doc(s: Source, at: int) -> str:
    """The doc comment right in front of a declaration."""
    m = re.search(r"/\*\*((?:(?!\*/)[\s\S])*)\*/\s*(?:@[\w.]+(?:\([^)]*\))?\s*|export\s+|default\s+|public\s+|abstract\s+|final\s+)*$", s.text[:at])
    return " ".join(re.sub(r"(?m)^\s*\*+ ?", "", m[1]).split()) if m else ""


def _script(s: Source) -> dict:
    code, bare = s.code, s.bare
    imports, symbols = [], []

    def bound(text: str) -> list[dict]:
        out = []
        text = text.strip()
        m = re.match(rf"(?:type\s+)?({_N})\s*(?:,|$)", text)
        if m and not text.startswith("{"):
            out.append({"local": m[1], "imported": "default", "kind": "default"})
        if m := re.search(rf"\*\s*as\s+({_N})", text):
            out.append({"local": m[1], "imported": "*", "kind": "namespace"})
        if m := re.search(r"\{([^}]*)\}", text):
            for part in m[1].split(","):
                words = re.findall(_N, re.sub(r"^\s*type\s+", "", part))
                if words:
                    out.append({"local": words[-1], "imported": words[0], "kind": "named"})
        return out

    def add(m: re.Match, module: str, bindings: list[dict]) -> None:
        imports.append({"module": module, "raw": m[0].strip(), "line": s.line(m.start()), "bindings": bindings})

    for m in re.finditer(r"""(?m)^[ \t]*import\s+(?:([\w$\s{},*]+?)\s+from\s+)?(["'])([^"'\n]+)\2""", bare):
        add(m, m[3], bound(m[1]) if m[1] else [{"local": "", "imported": "", "kind": "side-effect"}])
    for m in re.finditer(r"""(?m)^[ \t]*export\s+(?:type\s+)?(\*(?:\s*as\s+[\w$]+)?|\{[^}]*\})\s*from\s+(["'])([^"'\n]+)\2""", bare):
        add(m, m[3], [{"local": "*", "imported": "*", "kind": "namespace"}] if m[1].startswith("*") else bound(m[1]))
    for m in re.finditer(rf"""\b(?:const|let|var)\s+({_N}|\{{[^}}]*\}})\s*=\s*(?:await\s+)?(?:require|import)\s*\(\s*(["'])([^"'\n]+)\2\s*\)""", bare):
        add(m, m[3], bound(m[1]) if m[1].startswith("{") else [{"local": m[1], "imported": "default", "kind": "default"}])

    spans = []
    for m, a, z in s.blocks(rf"\b(class|interface|enum)\s+({_N})[^{{;()]*(?=\{{)"):
        symbols.append(_symbol(s, m[1], m[2], m[2], m.start(), z + 1, _doc(s, m.start())))
        if m[1] == "class":
            spans.append((m[2], a, z))
            for k, _, y in methods(s, a, z):
                symbols.append(_symbol(s, "method", k[1].lstrip("#"), f"{m[2]}.{k[1].lstrip('#')}", k.start(), y + 1, _doc(s, k.start())))
    for m, _, z in s.blocks(rf"\b(?:async\s+)?function\s*\*?\s*({_N})\s*(?:<[^>(]*>)?\("):
        symbols.append(_symbol(s, "function", m[1], m[1], m.start(), z + 1, _doc(s, m.start())))
    for m in re.finditer(rf"(?m)\b(?:const|let|var)\s+({_N})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b[^(]*)?(?:<[^>(]*>)?(\(|{_N}\s*=>)", code):
        shut = s.shut(m.start(2)) if m[2] == "(" else m.end()
        arrow = re.match(r"\s*(?::[^=>{]+)?(?:=>)?\s*", code[shut:])
        is_function = "function" in m[0] or "=>" in m[2] or "=>" in arrow[0]
        if is_function:
            body = shut + arrow.end()
            end = s.shut(body) if code[body : body + 1] in ("{", "(") else (code.find("\n", body) if "\n" in code[body:] else len(code))
            symbols.append(_symbol(s, "function", m[1], m[1], m.start(), end, _doc(s, m.start())))
    for m in re.finditer(rf"(?m)^[ \t]*(?:export\s+)?type\s+({_N})\s*(?:<[^=]*>)?=", code):
        body = m.end() + len(code[m.end() :]) - len(code[m.end() :].lstrip())
        end = s.shut(body) if code[body : body + 1] == "{" else (code.find(";", body) + 1 or len(code))
        symbols.append(_symbol(s, "type", m[1], m[1], m.start() + len(m[0]) - len(m[0].lstrip()), end, _doc(s, m.start())))
    return {"imports": imports, "symbols": symbols}


def methods(s: Source, a: int, z: int):
    """Methods at the top level of a class body: name, then parentheses, then a brace."""
    at, depth = a, 0
    name = re.compile(rf"(#?{_N})\s*(?:<[^>(]*>)?\(")
    while at < z:
        c = s.code[at]
        if c in "{[":
            at = s.shut(at)
            continue
        m = name.match(s.code, at) if (c.isalpha() or c in "_$#") and not (s.code[at - 1].isalnum() or s.code[at - 1] in "_$.#") else None
        if m:
            shut = s.shut(m.end() - 1)
            tail = re.match(r"\s*(?::[^{;=]+|throws\s+[\w.,\s]+)?\{", s.code[shut:z])
            if tail and m[1] not in ("if", "for", "while", "switch", "catch", "return", "super", "new", "synchronized"):
                brace = shut + tail.end() - 1
                end = s.shut(brace)
                yield m, brace + 1, end - 1
                at = end
                continue
            at = shut
            continue
        at += 1


def _annotations(s: Source) -> list[dict]:
    """Annotations with their arguments, and the place of the declaration behind them."""
    out = []
    for m in re.finditer(r"@([A-Za-z_][\w.]*)\s*(\()?", s.code):
        if m[1] == "interface":
            continue
        end = s.shut(m.end() - 1) if m[2] else m.end()
        args = {}
        if m[2]:
            for a, y in s.split(m.end(), end - 1):
                k = re.match(r"\s*(\w+)\s*=(?!=)\s*", s.bare[a:y])
                args[k[1] if k else ""] = s.bare[a + (k.end() if k else 0) : y].strip()
        out.append({"name": m[1].split(".")[-1], "args": args, "at": m.start(), "end": end, "line": s.line(m.start()), "raw": s.bare[m.start() : end].strip()})
    return out


def _java(s: Source) -> dict:
    imports, symbols = [], []
    package = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", s.code)
    for m in re.finditer(r"(?m)^[ \t]*import\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;", s.code):
        imports.append({"module": m[2], "raw": m[0].strip(), "line": s.line(m.start()), "bindings": [{"local": m[2].split(".")[-1], "imported": m[2].split(".")[-1], "kind": "named"}]})
    head = f"{package[1]}." if package else ""
    for m, a, z in s.blocks(rf"\b(class|interface|enum|record)\s+({_N})[^;{{]*(?=\{{)"):
        symbols.append(_symbol(s, m[1], m[2], head + m[2], m.start(), z + 1, _doc(s, m.start())))
        for k, _, y in methods(s, a, z):
            symbols.append(_symbol(s, "method", k[1], f"{head}{m[2]}.{k[1]}", k.start(), y + 1, _doc(s, k.start())))
    return {"imports": imports, "symbols": symbols, "package": package[1] if package else None}


def _go(s: Source) -> dict:
    imports, symbols = [], []
    package = re.search(r"(?m)^\s*package\s+(\w+)", s.code)

    def add(alias: str | None, module: str, at: int) -> None:
        imports.append({"module": module, "raw": f'import "{module}"', "line": s.line(at), "bindings": [{"local": alias or module.split("/")[-1], "imported": "*", "kind": "namespace"}]})

    for m in re.finditer(r"(?m)^\s*import\s*\(", s.code):
        end = s.shut(m.end() - 1)
        for k in re.finditer(r'(?m)^\s*([\w.]+\s+)?"([^"\n]+)"', s.bare[m.end() : end]):
            add((k[1] or "").strip() or None, k[2], m.end() + k.start(2))
    for m in re.finditer(r'(?m)^\s*import\s+([\w.]+\s+)?"([^"\n]+)"', s.bare):
        add((m[1] or "").strip() or None, m[2], m.start())
    for m, _, z in s.blocks(r"(?m)^func\s+(?:\(\s*\w*\s*\*?\s*(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\([^{]*(?=\{)"):
        symbols.append(_symbol(s, "method" if m[1] else "function", m[2], f"{m[1]}.{m[2]}" if m[1] else m[2], m.start(), z + 1))
    for m, _, z in s.blocks(r"(?m)^\s*type\s+(\w+)\s+(struct|interface)\s*(?=\{)"):
        symbols.append(_symbol(s, m[2], m[1], m[1], m.start(1) - 5, z + 1))
    return {"imports": imports, "symbols": symbols, "package": package[1] if package else None}


def _python(text: str, path: str) -> dict:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return {"imports": [], "symbols": [], "calls": [], "decorators": []}
    lines, imports, symbols, calls, decorators = text.split("\n"), [], [], [], []
    folder = path.split("/")[:-1]

    def raw(node: ast.AST) -> str:
        return ast.get_source_segment(text, node) or ""

    def visit(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                qualified = f"{owner}.{child.name}" if owner else child.name
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                symbols.append({"kind": kind, "name": child.name, "qualified_name": qualified, "start_line": first, "end_line": child.end_lineno, "signature": lines[child.lineno - 1].strip(), "summary": " ".join((ast.get_docstring(child) or "").split())})
                for d in child.decorator_list:
                    decorators.append({"node": d, "owner": child.name, "line": d.lineno, "raw": f"@{raw(d)}"})
                visit(child, qualified)
                continue
            if isinstance(child, ast.Import):
                for a in child.names:
                    imports.append({"module": a.name, "raw": raw(child), "line": child.lineno, "bindings": [{"local": a.asname or a.name.split(".")[0], "imported": "*", "kind": "namespace"}]})
            elif isinstance(child, ast.ImportFrom):
                base = ".".join(folder[: len(folder) - child.level + 1]) if child.level else ""
                module = ".".join(x for x in (base, child.module) if x)
                imports.append({"module": module, "raw": raw(child), "line": child.lineno, "bindings": [{"local": a.asname or a.name, "imported": a.name, "kind": "named"} for a in child.names]})
            elif isinstance(child, ast.Call):
                calls.append(child)
            visit(child, owner)

    visit(tree, "")
    found = []
    for c in calls:
        name = c.func.attr if isinstance(c.func, ast.Attribute) else c.func.id if isinstance(c.func, ast.Name) else None
        if name:
            found.append({"callee": name, "receiver": raw(c.func.value) if isinstance(c.func, ast.Attribute) else None, "args": len(c.args) + len(c.keywords), "line": c.lineno, "raw": raw(c)})
    return {"imports": imports, "symbols": symbols, "calls": found, "decorators": decorators, "tree": tree, "nodes": calls}


@lru_cache(maxsize=64)
def parse(text: str, lang: str, path: str) -> dict:
    """imports, symbols, calls, and what else the language's readers use (annotations, decorators, package). Unknown languages have none."""
    if lang == "python":
        return {"annotations": [], "package": None, **_python(text, path)}
    reader = _script if lang in SCRIPT else {"java": _java, "go": _go}.get(lang)
    if not reader:
        return {"imports": [], "symbols": [], "calls": [], "annotations": []}
    s = source_of(text, lang)
    got = {"package": None, "decorators": [], **reader(s)}
    got["calls"] = [{"callee": c.name, "receiver": c.receiver, "args": len(c.args), "line": c.line, "raw": c.raw} for c in s.calls]
    got["annotations"] = _annotations(s) if lang in ("java", "typescript", "tsx") else []
    return got


def containing(symbols: list[dict], line: int) -> dict | None:
    """The symbol of fewest lines around a line."""
    inside = [x for x in symbols if x["start_line"] <= line <= x["end_line"]]
    return min(inside, key=lambda x: x["end_line"] - x["start_line"], default=None)
