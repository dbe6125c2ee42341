"""Symbols and edges out of source texts: one pluggable extractor per language, run over Arrow batches.

Python is parsed with its own grammar; other languages by line patterns for definitions, imports and calls. Files that
do not parse fall back to the patterns.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame

from codeloom.sources.grammars import ALIASES, DASH_COMMENTS, DEFINITIONS, FRAMEWORKS, HASH_COMMENTS, HEADS, INDENTED

OUT = "repo_id string, path string, row string, id string, kind string, name string, line_start int, line_end int, signature string, parent_id string, src_id string, dst_id string, confidence double"

IMPORTS = re.compile(r"^\s*(?:(?:export|import)\s+(?:type\s+)?(?:[\w*{}$\s,]+\s+from\s+)?[\"']([^\"']+)[\"']|import\s+([\w.]+)|from\s+([\w.]+)\s+import|use\s+([\w:\\]+)|using\s+([\w.]+)\s*;|#include\s+[<\"]([^>\"]+)[>\"]|require(?:_relative)?\s*\(?\s*[\"']([^\"']+)[\"']|.*\brequire\([\"']([^\"']+)[\"']\))")
CALL = re.compile(r"(?:\b([A-Z][\w$]*)(?:\.|::|->))?\b([A-Za-z_$][\w$]*[!?]?)\s*\(")
WORD = re.compile(r"[A-Za-z_$][\w$]*")
STRING = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`")
# Words before a parenthesis that are no calls.
WORDS = set("if for while switch return catch function func def class fn sizeof typeof new await yield super elif match with assert not and or in is lambda print using foreach when unless".split())

EXTRACTORS: dict = {}


def register(language: str):
    """Decorator: extractor(repo, path, text) -> rows like those of ``by_patterns`` for a language."""

    def add(f):
        EXTRACTORS[language] = f
        return f

    return add


def sym_id(repo: str, path: str, line: int, name: str) -> str:
    return f"sym:{repo}:{path}:{line}:{name}"


def _symbol(repo, path, kind, name, a, b, signature, parent):
    return ("symbol", sym_id(repo, path, a, name), kind, name, a, b, signature, parent, None, None, None)


def _edge(repo, kind, src, dst, confidence):
    return ("edge", f"e:{repo}:{src}:{kind}:{dst}", kind, None, None, None, None, None, src, dst, confidence)


def bare_lines(text: str, language: str) -> list[str]:
    """Lines with texts and comments blanked, so that words in them are neither calls nor braces."""
    kind = ALIASES.get(language, language)
    mark = "#" if kind in HASH_COMMENTS else "--" if kind in DASH_COMMENTS else "%" if kind == "erlang" else ";" if kind == "clojure" else "//"
    out, inside = [], False
    for line in text.splitlines():
        if inside:
            line, inside = (line.split("*/", 1)[1], False) if "*/" in line else ("", True)
        line = STRING.sub('""', line).split(mark, 1)[0]
        if mark == "//" and "/*" in line:
            head, rest = line.split("/*", 1)
            inside = "*/" not in rest
            line = head + ("" if inside else rest.split("*/", 1)[1])
        out.append(line)
    return out


def block_end(bare: list[str], at: int, indented: bool) -> int:
    """Number of the last line of what starts at line ``at`` (both from 1)."""
    if not indented:
        depth, opened, open_parens = 0, False, 0
        for n in range(at - 1, len(bare)):
            open_parens += bare[n].count("(") - bare[n].count(")")
            for c in bare[n]:
                if c == "{":
                    depth, opened = depth + 1, True
                elif c == "}":
                    depth -= 1
            if opened and depth <= 0:
                return n + 1
            follows = n + 1 < len(bare) and bare[n + 1].lstrip().startswith("{")
            if not opened and open_parens <= 0 and not follows and not bare[n].rstrip().endswith((",", "=", ":", ">", "|")):
                return at
        return len(bare) if opened else at
    indent = len(bare[at - 1]) - len(bare[at - 1].lstrip())
    last = at
    for n in range(at, len(bare)):
        if bare[n].strip():
            own = len(bare[n]) - len(bare[n].lstrip())
            if own < indent or own == indent and not re.match(r"\s*(end|\)|\]|\})", bare[n]):
                break
            last = n + 1
            if own == indent:
                break
    return last


def by_patterns(repo: str, path: str, text: str, language: str) -> list[tuple]:
    """Rows by line patterns: definitions with their blocks and owners, imports, supertypes, calls (with the type that
    they are called on, where it is one) and reads of the file's own variables."""
    kind_of = ALIASES.get(language, language)
    rules = [(k, re.compile(p)) for k, p in DEFINITIONS.get(kind_of, ())]
    lines, bare = text.splitlines(), bare_lines(text, language)
    rows, file_id = [], f"file:{repo}:{path}"
    found = []
    for n, line in enumerate(lines, 1):
        for kind, rx in rules:
            if (m := rx.match(line)) and m.group(1) not in WORDS:
                found.append((n, block_end(bare, n, kind_of in INDENTED), kind, m.group(1)))
                break
        if m := IMPORTS.match(line):
            rows.append(_edge(repo, "imports", file_id, f"mod:{repo}:{next(g for g in m.groups() if g)}", 1.0))
    types = [x for x in found if x[2] in ("class", "interface", "module", "enum", "namespace")]
    variables = {name: sym_id(repo, path, n, name) for n, _, kind, name in found if kind == "variable"}
    for n, end, kind, name in found:
        around = [t for t in types if t[0] < n <= t[1] and t[2] != "namespace" and kind_of != "yaml"]
        parent = around[-1][3] if around else None
        if kind == "method" and kind_of == "go":
            parent = (re.match(r"func\s+\(\s*\w*\s*\*?\s*([A-Za-z_]\w*)", lines[n - 1]) or [None, None])[1]
        own = sym_id(repo, path, n, name)
        rows.append(_symbol(repo, path, "method" if kind == "function" and parent else kind, name, n, end, lines[n - 1].strip(), parent))
        rows.append(_edge(repo, "contains", file_id, own, 1.0))
        if kind in ("class", "interface", "enum"):
            for edge, p in HEADS:
                if m := re.search(p, bare[n - 1]):
                    bases = {re.split(r"[.\\:]", b.split("<")[0].strip())[-1] for b in re.split(r"[,+]", m.group(1))} - {"", name}
                    rows += [_edge(repo, edge, own, f"symref:{repo}:{path}:{b}", 0.5) for b in sorted(bases)]
        if kind in ("function", "method"):
            body = bare[n:end] + ([bare[n - 1].split("{", 1)[1]] if "{" in bare[n - 1] else [])
            called = {(f"{m.group(1)}.{m.group(2)}" if m.group(1) else m.group(2)) for x in body for m in CALL.finditer(x) if m.group(2) not in WORDS}
            rows += [_edge(repo, "calls", own, f"symref:{repo}:{path}:{c}", 0.5) for c in sorted(called)]
            read = {w for x in body for w in WORD.findall(x)} & variables.keys()
            rows += [_edge(repo, "reads", own, variables[v], 1.0) for v in sorted(read)]
    return list(dict.fromkeys(rows))


def framework_marks(repo: str, path: str, text: str, language: str) -> list[tuple[str, str, int, str]]:
    """(framework, role, line, what) of the marks that frameworks' rules find in a text."""
    kind = ALIASES.get(language, language)
    rules = [(f, role, re.compile(p)) for f, of, role, p in FRAMEWORKS if of == kind or (of == "php" and language == "blade")]
    return [(f, role, n, next((g for g in m.groups() if g), "")) for n, line in enumerate(text.splitlines(), 1) for f, role, rx in rules if (m := rx.search(line))]


def script_parts(path: str, text: str, language: str) -> list[tuple[str, str]]:
    """Scripts and styles of a component file as (language, text) with the lines around them blank, so that numbers stay."""
    if language not in ("vue", "svelte", "astro", "html"):
        return [(language, text)]
    out = []
    blank = lambda a, b: re.sub(r"[^\n]", "", text[:a]) + text[a:b]
    if language == "astro" and (m := re.match(r"\s*---\n(.*?)\n---", text, re.S)):
        out.append(("typescript", blank(m.start(1), m.end(1))))
    for m in re.finditer(r"<(script|style)\b([^>]*)>(.*?)</\1>", text, re.S | re.I):
        kind = "css" if m[1].lower() == "style" else "typescript" if re.search(r"lang=[\"']ts", m[2]) else "javascript"
        out.append((kind, blank(m.start(3), m.end(3))))
    return out + ([("html", text)] if language == "html" else [])


@register("python")
def by_grammar(repo: str, path: str, text: str) -> list[tuple]:
    tree = ast.parse(text)
    rows, file_id = [], f"file:{repo}:{path}"

    def called(node):
        f = node.func
        return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None

    def visit(body, owner):
        for x in body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                own = sym_id(repo, path, x.lineno, x.name)
                rows.append(_symbol(repo, path, "method" if owner else "function", x.name, x.lineno, x.end_lineno, f"def {x.name}({ast.unparse(x.args)})", owner))
                rows.append(_edge(repo, "contains", file_id, own, 1.0))
                names = {c for n in ast.walk(x) if isinstance(n, ast.Call) and (c := called(n))}
                rows.extend(_edge(repo, "calls", own, f"symref:{repo}:{path}:{c}", 0.5) for c in sorted(names))
                visit(x.body, None)
            elif isinstance(x, ast.ClassDef):
                own = sym_id(repo, path, x.lineno, x.name)
                rows.append(_symbol(repo, path, "class", x.name, x.lineno, x.end_lineno, f"class {x.name}", owner))
                rows.append(_edge(repo, "contains", file_id, own, 1.0))
                rows.extend(_edge(repo, "inherits", own, f"symref:{repo}:{path}:{ast.unparse(b).split('.')[-1]}", 0.5) for b in x.bases if isinstance(b, (ast.Name, ast.Attribute)))
                visit(x.body, x.name)

    visit(tree.body, None)
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            rows.extend(_edge(repo, "imports", file_id, f"mod:{repo}:{a.name}", 1.0) for a in x.names)
        elif isinstance(x, ast.ImportFrom):
            rows.append(_edge(repo, "imports", file_id, f"mod:{repo}:{'.' * x.level}{x.module or ''}", 1.0))
    return rows


def extract(files: DataFrame) -> DataFrame:
    """files(repo_id, path, language, content) -> symbol and edge rows; null texts give none."""
    plugged = dict(EXTRACTORS)

    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in OUT.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int32()] * 2 + [pa.string()] * 4 + [pa.float64()]
        for b in batches:
            rows = []
            for repo, path, language, text in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if not text:
                    continue
                for kind, part in script_parts(path, text, language):
                    try:
                        found = plugged[kind](repo, path, part) if kind in plugged else by_patterns(repo, path, part, kind)
                    except (SyntaxError, ValueError, RecursionError):
                        found = by_patterns(repo, path, part, kind)
                    rows += [(repo, path, *r) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.select("repo_id", "path", "language", "content").mapInArrow(run, OUT)


def frameworks(files: DataFrame) -> DataFrame:
    """files(repo_id, path, language, content) -> (repo_id, path, framework, role, line, what) of frameworks' marks."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(repo, path, *m) for repo, path, language, text in zip(*[b.column(i).to_pylist() for i in range(4)]) if text for m in framework_marks(repo, path, text, language)]
            kinds = [pa.string()] * 4 + [pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["repo_id", "path", "framework", "role", "line", "what"])

    return files.select("repo_id", "path", "language", "content").mapInArrow(run, "repo_id string, path string, framework string, role string, line int, what string")


def framework_packs(marks: DataFrame, least: int = 1) -> DataFrame:
    """(repo_id, framework, n_marks, n_files) of the frameworks that a repository shows signs of."""
    from pyspark.sql import functions as F

    n = marks.groupBy("repo_id", "framework", "path").agg(F.count("*").alias("n"))
    return n.groupBy("repo_id", "framework").agg(F.sum("n").alias("n_marks"), F.count("*").alias("n_files")).where(F.col("n_marks") >= least)


def as_graph(files: DataFrame, rows: DataFrame):
    """The extracted rows as a graph with the columns of the graph tables."""
    from pyspark.sql import functions as F

    from codeloom.operators.graph import Graph

    f = files.select("repo_id", F.concat_ws(":", F.lit("file"), "repo_id", "path").alias("id"), "path", "language")
    s = rows.where("row = 'symbol'").join(files.select("repo_id", "path", "language"), ["repo_id", "path"]).select("repo_id", "id", "name", "kind", "path", "line_start", "line_end", "language", "signature", "parent_id")
    e = rows.where("row = 'edge'").groupBy("id").agg(F.first("repo_id").alias("repo_id"), F.first("kind").alias("kind"), F.first("src_id").alias("src_id"), F.first("dst_id").alias("dst_id"), F.max("confidence").alias("confidence"))
    return Graph(f, s, e)


def structural(rows: DataFrame, kinds: list[str], name: str = "", parent: str = "") -> DataFrame:
    """Extracted symbols of some kinds whose name and owner match patterns (an empty one matches all)."""
    from pyspark.sql import functions as F

    d = rows.where(F.col("row") == "symbol").where(F.col("kind").isin(kinds))
    if name:
        d = d.where(F.col("name").rlike(name))
    return d.where(F.coalesce("parent_id", F.lit("")).rlike(parent)) if parent else d
