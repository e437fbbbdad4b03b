"""Source text to entities, by Arrow batches; a parser for each suffix."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CHARS = 500_000
FIELD = "struct<name:string,type:string,default:string>"
METHOD = f"struct<name:string,inputs:array<{FIELD}>,returns:string,decorators:array<string>,docstring:string>"
ENTITY = f"struct<name:string,kind:string,purpose:string,fields:array<{FIELD}>,methods:array<{METHOD}>,inputs:array<{FIELD}>,outputs:string,parent_classes:array<string>,decorators:array<string>,called_entities:array<string>>"
SCHEMA = f"file_path string, exports array<string>, imports array<string>, entities array<{ENTITY}>, error string"


def is_binary(head: bytes) -> bool:
    """A NUL in the first KB, unless it is UTF-16: a byte order mark, or over 30 % printable ASCII."""
    head = head[:1024]
    if b"\0" not in head or head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return False
    return sum(32 <= c < 127 for c in head) <= 0.3 * len(head)


def decoded(raw: bytes) -> str | None:
    """Text of a file, None for binaries."""
    if is_binary(raw):
        return None
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        codes = ("utf-16",)
    elif b"\0" in raw[:1024]:
        codes = ("utf-16-le", "utf-16-be")
    else:
        codes = ("utf-8-sig", *_likely(raw), "cp1252", "latin-1")
    for code in codes:
        try:
            text = raw.decode(code)
        except UnicodeError:
            continue
        if code == "utf-8-sig" or code not in ("cp1252", "latin-1", "utf-16", "utf-16-le", "utf-16-be") or coherent(text):
            return text
    return None


#: Charsets that are guessed, besides Western ones: the range of their own letters, the share of other letters than ASCII that must lie in it, and, for Chinese ones, the range of first
#: bytes that common characters have.
_CHARSETS = [("shift_jis", ("぀", "ヿ"), 0.25, None), ("euc_jp", ("぀", "ヿ"), 0.25, None), ("cp949", ("가", "힣"), 0.9, None), ("gb18030", ("一", "鿿"), 0.9, (0xB0, 0xD7)), ("big5", ("一", "鿿"), 0.9, (0xA4, 0xC6)), ("cp1251", ("Ѐ", "ӿ"), 0.9, None), ("koi8_r", ("Ѐ", "ӿ"), 0.9, None)]


def _likely(raw: bytes) -> list[str]:
    """Charsets in which a text that isn't UTF-8 reads as what they are for, the likeliest first."""
    found = []
    for code, (low, high), least, common in _CHARSETS:
        try:
            letters = [c for c in raw.decode(code) if not c.isascii() and c.isalpha()]
        except UnicodeError:
            continue
        if not letters or len(letters) < 0.1 * sum(b > 127 for b in raw):
            continue
        share = sum(low <= c <= high for c in letters) / len(letters)
        if common:  # the pairs' first bytes
            firsts = [c.encode(code)[0] for c in letters if low <= c <= high]
            share *= sum(common[0] <= b <= common[1] for b in firsts) / max(len(firsts), 1)
        elif code in ("cp1251", "koi8_r"):  # each reads the other's small letters as capitals; words begin with a capital at most, and most letters follow one another
            share *= sum(c.islower() for c in letters) / len(letters) * (sum(b > 127 for b in raw) >= 0.4 * sum(chr(b).isalpha() or b > 127 for b in raw))
        least = 0.7 if common or code in ("cp1251", "koi8_r") else least
        if share >= least:
            found.append((least == 0.7, -share, code))  # kana and Hangul are hardly met by chance
    return [code for *_, code in sorted(found)]


def coherent(text: str) -> bool:
    """Whether a text whose charset is guessed reads like one: hardly a control character, and letters, digits, signs and blanks of the usual kind for the most part."""
    head = text[:4096]
    odd = sum((c < " " and c not in "\t\n\r\f") or "\x7f" <= c <= "\x9f" or not (c.isprintable() or c.isspace()) for c in head)
    usual = sum(c.isascii() or c.isalpha() and ord(c) < 0x2000 for c in head)
    return odd <= 0.02 * len(head) and usual >= 0.5 * len(head)


def _arguments(a: ast.arguments) -> list[dict]:
    every = [*a.posonlyargs, *a.args, *a.kwonlyargs]
    tail = [None] * (len(a.posonlyargs) + len(a.args) - len(a.defaults)) + a.defaults + a.kw_defaults
    out = [{"name": x.arg, "type": ast.unparse(x.annotation) if x.annotation else None, "default": ast.unparse(d) if d else None} for x, d in zip(every, tail, strict=True) if x.arg not in ("self", "cls")]
    return out


def _called(node: ast.AST) -> list[str]:
    """Dotted texts of what a node calls, each once."""
    out: dict[str, None] = {}
    for n in ast.walk(node):
        if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
            text = ast.unparse(n.func)
            if re.fullmatch(r"[\w.]+", text):
                out[text] = None
    return list(out)


def parse_python(path: str, text: str) -> dict:
    tree = ast.parse(text)
    exports, listed, imports, entities = [], None, {}, []
    folder = path.split("/")[:-1]
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports |= dict.fromkeys(a.name for a in n.names)
        elif isinstance(n, ast.ImportFrom):
            if n.level:
                base = folder[: len(folder) - n.level + 1]
                imports["/".join([*base, *(n.module or "").split(".")]).strip("/")] = None
                if not n.module:
                    imports |= dict.fromkeys("/".join([*base, a.name]) for a in n.names)
            elif n.module:
                imports[n.module] = None
    for n in tree.body:
        names = []
        if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            names = [n.name]
            e = {"name": n.name, "purpose": ast.get_docstring(n), "decorators": [ast.unparse(d) for d in n.decorator_list], "called_entities": _called(n), "fields": [], "methods": [], "inputs": [], "outputs": None, "parent_classes": []}
            if isinstance(n, ast.ClassDef):
                e["kind"] = "CLASS"
                e["parent_classes"] = [ast.unparse(b) for b in n.bases]
                for m in n.body:
                    if isinstance(m, ast.AnnAssign) and isinstance(m.target, ast.Name):
                        e["fields"].append({"name": m.target.id, "type": ast.unparse(m.annotation), "default": ast.unparse(m.value) if m.value else None})
                    elif isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        e["methods"].append({"name": m.name, "inputs": _arguments(m.args), "returns": ast.unparse(m.returns) if m.returns else None, "decorators": [ast.unparse(d) for d in m.decorator_list], "docstring": ast.get_docstring(m)})
            else:
                e |= {"kind": "FUNCTION", "inputs": _arguments(n.args), "outputs": ast.unparse(n.returns) if n.returns else None}
            entities.append(e)
        elif isinstance(n, ast.Assign):
            names = [t.id for t in n.targets if isinstance(t, ast.Name)]
            if "__all__" in names and isinstance(n.value, (ast.List, ast.Tuple)):
                listed = [c.value for c in n.value.elts if isinstance(c, ast.Constant) and isinstance(c.value, str)]
        elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
            names = [n.target.id]
        exports += [x for x in names if not x.startswith("_")]
    return {"exports": list(dict.fromkeys(exports)) if listed is None else listed, "imports": list(imports), "entities": entities}


_IMPORT = re.compile(r"""^\s*import\s+(?:type\s+)?(?:[^'";]*?\s+from\s+)?['"]([^'"]+)['"]""", re.M)
_DECLARED = re.compile(r"^[ \t]*(export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(class|interface|type|function)\s*\*?\s+([A-Za-z_$][\w$]*)(?:<[^>{]*>)?([^{=;]*)", re.M)
_EXPORTED = re.compile(r"^\s*export\s+(?:default\s+)?(?:const|let|var|enum)\s+([A-Za-z_$][\w$]*)|^\s*export\s*\{([^}]*)\}(?!\s*from)", re.M)
_CALL = re.compile(r"\b([A-Za-z_$][\w$.]*)\s*\(")
_NO_CALL = frozenset("if for while switch catch return function typeof super await new".split())


def _braces(text: str, start: int) -> str:
    """From the first brace at or after start to the one that closes it."""
    i = text.find("{", start)
    if i < 0:
        return ""
    depth = 0
    for j in range(i, len(text)):
        depth += (text[j] == "{") - (text[j] == "}")
        if not depth:
            return text[i : j + 1]
    return text[i:]


def _split(text: str, at: str = ",") -> list[str]:
    """The parts of text between `at` outside of brackets and quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and text[i - 1] != "=":
            depth -= 1
        elif c in at and depth <= 0:
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in [*out, text[start:]] if x.strip()]


def _parameters(text: str) -> list[dict]:
    out = []
    for p in _split(text):
        m = re.match(r"(?:(?:public|private|protected|readonly)\s+)*(?:\.\.\.)?([\w$]+|[{\[].*[}\]])\??\s*(?::\s*(.*?))?(?:=(?!>)\s*(.*))?$", p, re.S)
        if m:
            out.append({"name": m[1], "type": m[2].strip() if m[2] else None, "default": m[3].strip() if m[3] else None})
    return out


_MODIFIERS = r"(?:(?:public|private|protected|static|readonly|abstract|override|async|declare|get|set)\s+)*"
_METHOD = re.compile(rf"{_MODIFIERS}([A-Za-z_$#][\w$]*)\??\s*(?:<[^(]*>)?\s*\((.*)\)\s*(?::\s*(.*))?$", re.S)
_PROPERTY = re.compile(rf"{_MODIFIERS}([A-Za-z_$#][\w$]*)[?!]?\s*(?::\s*(.*?))?(?:=(?!>)\s*(.*))?$", re.S)


def _members(body: str) -> tuple[list[dict], list[dict]]:
    """(fields, methods) of a class or interface from its braces: what is declared one level in, bodies left out."""
    inner, flat, depth, kept = body[1:-1], [], 0, True
    for i, c in enumerate(inner):
        if c == "{":
            # A brace after a closing bracket or a type opens a body; after `:`, `=`, `<`, `,`, `(` or `|` it belongs to a type or value.
            if depth == 0:
                kept = bool(re.search(r"[:=<,(|&]\s*$", inner[max(i - 200, 0) : i]))
            depth += 1
        if depth == 0:
            flat.append(c)
        elif kept:
            flat.append({";": ",", "\n": " "}.get(c, c))
        if c == "}":
            depth -= 1
            if depth == 0:
                flat.append("" if kept else ";")
    fields, methods = [], []
    for part in _split(re.sub(r"@\w+(?:\([^)]*\))?", "", "".join(flat)), ";\n"):
        if part.startswith(("{", "}", "*", "[")):
            continue
        if (m := _METHOD.match(part)) and m[1] not in _NO_CALL:
            methods.append({"name": m[1], "inputs": _parameters(m[2]), "returns": m[3].strip() if m[3] else None, "decorators": [], "docstring": None})
        elif m := _PROPERTY.match(part):
            fields.append({"name": m[1], "type": m[2].strip() if m[2] else None, "default": m[3].strip() if m[3] else None})
    return fields, methods


#: Signs that mean something outside of strings only; inside they are moved by HIDDEN while a text is looked at.
_SIGNS, HIDDEN = "{}()[]<>;,=:@|&\n\"'`", 0xE000
_NEXT, _STRING, _REGEX = re.compile(r"[/'\"`{}]"), re.compile(r"""'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*\"""", re.S), re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/")
_SHOWN = {HIDDEN + ord(c): c for c in _SIGNS}


def _hidden(text: str) -> str:
    """The text, as long as it is, without comments, and with the signs inside strings, templates and regular expressions moved; what stands in a template's `${}` is code."""
    out, depths, i = list(text), [], 0

    def hide(a: int, b: int) -> None:
        for j in range(a, min(b, len(out))):
            if out[j] in _SIGNS:
                out[j] = chr(HIDDEN + ord(out[j]))

    def template(a: int) -> int:
        """Past a template's text from a on: behind its end, or inside an expression."""
        j = a
        while j < len(text) and text[j] != "`" and not text.startswith("${", j):
            j += 2 if text[j] == "\\" else 1
        if text.startswith("${", j):
            hide(a, j + 2)
            depths.append(0)
            return j + 2
        hide(a, j)
        return j + 1

    while m := _NEXT.search(text, i):
        i, c = m.start(), m[0]
        end = i + 1
        if c == "/" and text[i + 1 : i + 2] in ("/", "*"):
            stop = text.find("\n" if text[i + 1] == "/" else "*/", i + 2)
            end = len(text) if stop < 0 else stop if text[i + 1] == "/" else stop + 2
            out[i:end] = [x if x == "\n" else " " for x in text[i:end]]
        elif c == "/":
            before = text[max(i - 20, 0) : i].rstrip()
            if (not before or before[-1] in "(,=:[!&|?{};+" or re.search(r"\b(?:return|typeof|case)$", before)) and (r := _REGEX.match(text, i)):
                hide(i, end := r.end())
        elif c in "'\"":
            if r := _STRING.match(text, i):
                hide(i + 1, r.end() - 1)
                end = r.end()
        elif c == "`":
            end = template(i + 1)
        elif depths and c == "{":
            depths[-1] += 1
        elif depths and depths[-1]:
            depths[-1] -= 1
        elif depths:
            depths.pop()
            hide(i, i + 1)
            end = template(i + 1)
        i = end
    return "".join(out)


def _shown(x):
    """A value with the signs of its strings back in their place."""
    return x.translate(_SHOWN) if isinstance(x, str) else [_shown(y) for y in x] if isinstance(x, list) else {k: _shown(v) for k, v in x.items()} if isinstance(x, dict) else x


def parse_typescript(path: str, text: str) -> dict:
    """A subset by regular expressions: imports, exported names, classes, interfaces, types and functions at line starts, their heritage, members and calls. Strings, templates,
    regular expressions and comments are known for what they are."""
    code = _hidden(text)
    exports, entities = [], []
    for m in _DECLARED.finditer(code):
        name, rest = m[3], m[4]
        if m[1]:
            exports.append(name)
        kind = {"class": "CLASS", "function": "FUNCTION"}.get(m[2], "INTERFACE")
        body = _braces(code, m.end()) if m[2] != "type" else ""
        e = {"name": name, "kind": kind, "purpose": None, "fields": [], "methods": [], "inputs": [], "outputs": None, "decorators": [], "parent_classes": [], "called_entities": list(dict.fromkeys(c for c in _CALL.findall(body) if c.split(".")[0] not in _NO_CALL))}
        if m[2] in ("class", "interface"):
            if body:
                e["fields"], e["methods"] = _members(body)
            e["parent_classes"] = [x.strip().split("<")[0] for h in re.findall(r"\b(?:extends|implements)\s+((?:(?!\bimplements\b)[^{])*)", rest) for x in h.split(",") if x.strip()]
        elif m[2] == "function":
            p = re.match(r"\s*\((.*?)\)\s*(?::\s*([^{]+))?", code[m.end(3) :], re.S)
            if p:
                e["inputs"] = [{"name": a.split(":")[0].split("=")[0].strip(" ?."), "type": a.split(":", 1)[1].split("=")[0].strip() if ":" in a else None, "default": None} for a in p[1].split(",") if a.strip()]
                e["outputs"] = p[2].strip() if p[2] else None
        entities.append(e)
    for m in _EXPORTED.finditer(code):
        exports += [m[1]] if m[1] else [x.split(" as ")[-1].strip() for x in m[2].split(",") if x.strip()]
    return _shown({"exports": list(dict.fromkeys(exports)), "imports": list(dict.fromkeys(_IMPORT.findall(code))), "entities": entities})


#: Parsers by suffix; register more here.
PARSERS: dict[str, Callable[[str, str], dict]] = {".py": parse_python, ".pyw": parse_python} | dict.fromkeys((".ts", ".tsx", ".js", ".jsx"), parse_typescript)


def parsed(files: DataFrame, parsers: dict[str, Callable[[str, str], dict]] | None = None) -> DataFrame:
    """Rows of SCHEMA for files (path, content) with a parser's suffix. What can't be parsed gives a row with an error."""
    own = PARSERS if parsers is None else parsers
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    arrow = pa.schema([("file_path", pa.string()), ("dto", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, out = b.column("path").to_pylist(), []
            for path, raw in zip(paths, b.column("content").to_pylist(), strict=True):
                dto: dict = {"exports": [], "imports": [], "entities": [], "error": None}
                text = decoded(raw or b"")
                if text is None or len(text) > MOST_CHARS:
                    dto["error"] = "binary" if text is None else f"over {MOST_CHARS} characters"
                else:
                    try:
                        dto |= own["." + path.rsplit(".", 1)[-1].lower()](path, text)
                    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                        dto["error"] = f"{type(e).__name__}: {e}"
                out.append(json.dumps(dto))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(out, pa.string())], schema=arrow)

    rows = files.where(suffix.isin(*own)).select("path", "content").mapInArrow(run, "file_path string, dto string")
    fields = T.StructType([f for f in T._parse_datatype_string(SCHEMA) if f.name != "file_path"])
    return rows.select("file_path", F.from_json("dto", fields).alias("d")).select("file_path", "d.*")


class _Bodies(ast.NodeTransformer):
    def _strip(self, n):
        keep = n.body[:1] if ast.get_docstring(n) is not None else []
        n.body = [*keep, ast.Expr(ast.Constant(...))]
        return n

    visit_FunctionDef = visit_AsyncFunctionDef = _strip


def without_bodies(text: str) -> str:
    """Python source whose functions keep signature and docstring; other text as it is."""
    try:
        return ast.unparse(_Bodies().visit(ast.parse(text)))
    except (SyntaxError, ValueError):
        return text


def tsconfig_aliases(text: str) -> list[tuple[str, str, int]]:
    """(prefix, first target, ordinal) of compilerOptions.paths, comments and trailing commas allowed."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|/\*.*?\*/|//[^\n]*', lambda m: m[1] or "", text, flags=re.S)
    bare = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)
    try:
        paths = json.loads(bare).get("compilerOptions", {}).get("paths", {})
    except (ValueError, AttributeError):
        return []
    return [(k.rstrip("*"), v[0].rstrip("*").removeprefix("./"), i) for i, (k, v) in enumerate(paths.items()) if v]
