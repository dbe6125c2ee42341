"""Files that nobody in the project wrote by hand: generated, minified, third-party and data files.

Each stored text is lexed whole and emitted again in canonical layout: one statement a line, indented by its depth, one
space between tokens. The original layout is compared with it. A text that expands many times over is minified; one whose
canonical lines all have one shape, but for names and numbers, was printed by a tool; one that consists almost wholly of
literals is data saved as code. What layout leaves open the leading comments settle, as the lexer finds them (does a
sentence say that a tool wrote this file; does a licence name a holder outside the project), then the path (lock files,
tools' output names, third-party folders) and, for copies of a recognised third-party file, the content hash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Canonical lines per original line from which a text is minified; share of literal characters from which it is data;
#: lines of one shape, out of all lines, from which it is generated, and how many there must be.
EXPANSION, LITERAL, UNIFORM, UNIFORM_LINES = 8.0, 0.7, 0.9, 5
#: Longest line from which a text that expands counts, and a literal one of few lines (a short one-liner is no bundle).
LONG_LINE = 500

# Names of package tools' lock files, of tools' output and of folders for third-party code.
LOCK_NAMES = ["package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "cargo.lock", "poetry.lock", "pipfile.lock", "uv.lock", "pdm.lock", "go.sum", "gemfile.lock", "composer.lock", "podfile.lock", "pubspec.lock", "mix.lock", "packages.lock.json", "gradle.lockfile", "package.resolved", "flake.lock"]
OUTPUT_NAMES = r"(\.pb\.(go|cc|h|swift|dart)|_pb2(_grpc)?\.pyi?|_pb\.(js|ts|rb)|\.pb\.rs|\.g\.(dart|cs|i\.cs|ts|kt|go)|\.(freezed|gr|mocks)\.dart|\.designer\.(cs|vb)|\.generated\.[a-z]+|\.gen\.[a-z]+|_generated\.[a-z]+|\.g4\.[a-z]+|(^|/)zz_generated[^/]*)$"
OUTPUT_FOLDERS = r"(^|/)(__generated__|generated|generated-sources|generated-src|generated_sources|autogen|__snapshots__)/"
BUNDLE_NAMES = r"(\.min\.(js|css|mjs)|[.-]bundle\.(js|css)|\.chunk\.(js|css)|[.-](?=[0-9a-f]*[0-9])[0-9a-f]{8,20}\.(js|css|mjs))$"
THIRD_PARTY_FOLDERS = r"(^|/)(vendor|vendored|_vendor|third_party|third-party|thirdparty|3rdparty|node_modules|bower_components|jspm_packages|site-packages|dist-packages|pods|carthage|deps|extern|external|externals|godeps|\.venv|venv)/"

# Words by which a comment says that a tool wrote the file it stands in.
MADE = set("generated autogenerated autocreated produced emitted compiled rendered printed".split())
BY_ANYONE = set("written created built made".split())  # people do so too, unless it says automatically
AUTO = set("auto automatic automatically machine mechanically programmatically".split())
ITSELF = set("file code module source class header document output bindings stub stubs script".split())
LINKS = set("this the these was is are were has have been being".split())
BY = set("by from with using via".split())
CHANGE = set("edit modify change touch alter".split())
CHANGES = set("change changes edit edits modification modifications".split())
LOST = set("lost overwritten discarded clobbered".split())
ORIGIN = set("template templates schema generator spec specification definition definitions idl grammar".split())
AGAIN = set("regenerate refresh recreate rebuild".split())
RUN = set("run make invoke execute call".split())
LICENCE = re.compile(r"SPDX-License-Identifier|\bdistributed under\b|\blicen[sc]ed? (under|at|:)|\(c\)\s|©|\b(MIT|ISC|BSD-\d-Clause|Apache-2\.0|MPL-2\.0|A?L?GPL-[\d.]+|Unlicense|Zlib)\b( licen[cs]e)?", re.I)
OWN = re.compile(r"\bcopyright\s+(?:\(c\)\s*)?(?:\d{4}\S*\s+)?(?:the\s+)?([\w.-]+)|\bpart of\s+([\w.-]+)|\(c\)\s*(?:\d{4}\S*\s+)?(?:the\s+)?([\w.-]+)|^\W*([\w.-]+?) v?\d+\.\d+", re.I)

# Words that start an import, whose literals are no data.
IMPORTS = {"import", "from", "require", "require_relative", "include", "use", "using", "export"}

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|\#(?!include|define|if|endif|pragma)[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z))
    |(?P<string>"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)|`(?:\\.|[^`\\])*(?:`|\Z))
    |(?P<number>\b0[xX][0-9a-fA-F]+\b|\b\d[\d_.]*(?:[eE][+-]?\d+)?\w*)
    |(?P<word>[^\W\d][\w$]*|\$[\w$]+)
    |(?P<newline>\r\n?|\n)
    |(?P<space>[^\S\r\n]+)
    |(?P<punct>.)""",
    re.X | re.S,
)


@dataclass
class Layout:
    """A text next to its canonical form."""

    canonical: list  # its lines
    lines: int  # of the original, without blank ones
    longest: int
    literal: float  # share of literal characters
    uniform: float  # share of canonical lines with the commonest shape
    alike: int  # and their number
    comments: str  # before any code

    @property
    def expansion(self) -> float:
        return len(self.canonical) / max(1, self.lines)

    def verdict(self) -> str:
        if self.literal >= LITERAL and (self.longest >= LONG_LINE or self.lines >= UNIFORM_LINES):
            return "data"
        if self.expansion >= EXPANSION and self.longest >= LONG_LINE:
            return "minified"
        return "generated" if self.uniform >= UNIFORM and self.alike >= UNIFORM_LINES else ""


def layout(text: str) -> Layout:
    """Lex a text and emit it canonically: a statement ends at a brace, at a semicolon or line end outside brackets."""
    out: list[str] = []
    line: list[str] = []
    shape: list[str] = []
    shapes: dict[str, int] = {}
    head: list[str] = []
    lines = indent = depth = literal = solid = 0
    leading, importing, used = True, False, False

    def end():
        nonlocal line, shape
        if line:
            out.append("  " * indent + " ".join(line))
            s = "".join(shape)
            shapes[s] = shapes.get(s, 0) + 1
            line, shape = [], []

    for m in TOKEN.finditer(text):
        kind, t = m.lastgroup, m.group()
        if kind == "newline":
            lines, used = lines + used, False
            if depth <= 0:
                end()
            continue
        if kind == "space":
            continue
        used = True
        if kind == "comment":
            lines += t.count("\n")
            if leading:
                head.append(t)
            if depth <= 0:
                end()
            line.append(t), shape.append("c")
            if depth <= 0:
                end()
            continue
        if leading and (kind != "punct" or t not in "!;"):
            leading = False
        solid += len(t)
        if not line:
            importing = t in IMPORTS
        line.append(t)
        if kind in ("string", "number"):
            literal += 0 if importing else len(t)
            shape.append("s" if kind == "string" else "n")
        elif kind == "word":
            shape.append("w" if any(c.isdigit() for c in t) else t)
        else:
            shape.append(t)
            if t in "([":
                depth += 1
            elif t in ")]":
                depth = max(0, depth - 1)
            elif literal * 2 > solid and t in ",;":
                literal += 1  # what parts two literals belongs to the data
            if t == "{":
                end()
                indent += 1
            elif t == "}":
                indent = max(0, indent - 1)
                end()
            elif t == ";" and depth <= 0:
                end()
    lines += used
    end()
    top = max(shapes.values(), default=0)
    return Layout(out, lines, max(map(len, text.splitlines()), default=0), literal / max(1, solid), top / max(1, len(out)), top, "\n".join(head))


SENTENCE = re.compile(r"[.;:](?=\s|$)|\s--?\s|\n|[<>()|]")
PLAIN = re.compile(r"[^\W_]+(?:['\u2019][a-z]+)?")


def tool_wrote(comments: str) -> bool:
    """Whether a sentence of the comments says that a tool wrote this file. It must speak of the file itself, not of what
    its code makes or of what its users do."""
    for sentence in SENTENCE.split(comments):
        w = [x for x in PLAIN.findall(sentence.lower().replace("don't", "do not").replace("don\u2019t", "do not")) if x not in ("please", "warning", "note")]
        have = set(w)
        for k, x in enumerate(w):
            if (x in MADE or x in BY_ANYONE) and all(y in ITSELF or y in AUTO or y in LINKS for y in w[:k]):
                after = w[k + 1 : k + 3]
                if x.startswith("auto") or AUTO & set(w[: k + 3]):
                    return True
                if x in MADE and (len(w) == 1 or set(after) & BY or after and after[0] in ITSELF):
                    return True
        if w[:2] == ["do", "not"] and CHANGE & set(w[2:5]) or w[:1] == ["never"] and CHANGE & set(w[1:4]):
            return True
        if w[:1] and w[0] in CHANGE and have & ORIGIN and have & {"not", "instead"}:
            return True
        if have & CHANGES and have & LOST and have & {"will", "are", "be", "get"}:
            return True
        if have & AGAIN and (have & RUN and "to" in have or w[0] in AGAIN and w[1:2] and w[1] in BY):
            return True
    return False


def header_verdict(comments: str, repo: str) -> str:
    """``generated`` or ``third_party`` by the leading comments, else empty; a licence in the project's own name is its own."""
    if not comments:
        return ""
    lines = [re.sub(r"^[\s/*#<!;-]+", "", x) for x in comments.splitlines()]
    if tool_wrote("\n".join(lines)):
        return "generated"
    for x in lines:
        if LICENCE.search(x):
            holder = next((g for m in OWN.finditer(x) for g in m.groups() if g and g.lower() not in ("c", "the")), "")
            if not holder or holder.lower() not in (repo or "").lower():
                return "third_party"
    return ""


def _read(batches):
    import pyarrow as pa

    for b in batches:
        verdicts, grounds = [], []
        for repo, text, longest in zip(*[b.column(i).to_pylist() for i in range(1, 4)]):
            x = layout(text)
            x.longest = max(x.longest, longest or 0)
            found = x.verdict()
            ground = "layout" if found else "comment"
            found = found or header_verdict(x.comments, repo)
            verdicts.append(found or None), grounds.append(ground if found else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(verdicts, pa.string()), pa.array(grounds, pa.string())], ["id", "verdict", "ground"])


def judge_files(files: DataFrame, samples: DataFrame) -> DataFrame:
    """(repo_id, file_id, verdict, ground) of each distinct file: verdict lock, generated, minified, third_party, data or
    hand_written; ground layout, comment, path or copy (null for hand-written ones), the first of them that decides.

    Current rows by indexed_at count; a file without a sample is judged by path and hash. Null ids are no files; null
    paths, sizes and texts give no evidence, an empty text is hand-written unless its path says otherwise.
    """
    from codeloom.operators.current import latest

    cur = latest(files, ["id"], "indexed_at", ["repo_id", "path", "hash"])
    s = samples.where("file_id IS NOT NULL").groupBy(F.col("file_id").alias("id")).agg(F.max(F.struct("head", "n_lines", "max_line_chars")).alias("s")).select("id", "s.*")
    both = cur.join(s, "id", "left")
    path = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce("path", F.lit("")), r"\\", "/"), r"^(\./)+", ""))
    name = F.substring_index(path, "/", -1)
    by_path = (
        F.when(name.isin(LOCK_NAMES), "lock").when(path.rlike(THIRD_PARTY_FOLDERS), "third_party")
        .when(path.rlike(OUTPUT_NAMES) | path.rlike(OUTPUT_FOLDERS), "generated").when(name.rlike(BUNDLE_NAMES), "minified")
    )
    read = both.select("id", "repo_id", F.col("head"), F.col("max_line_chars").cast("bigint")).where("head <> ''").mapInArrow(_read, "id string, verdict string, ground string")
    d = both.select("id", "repo_id", "hash", by_path.alias("by_path")).join(read, "id", "left")
    d = d.select("id", "repo_id", "hash", F.coalesce("verdict", "by_path").alias("verdict"), F.coalesce("ground", F.when(F.col("by_path").isNotNull(), "path")).alias("ground"))
    known = d.where("verdict = 'third_party' AND hash IS NOT NULL").select("hash").distinct().withColumn("copy", F.lit(True))
    copy = F.col("copy") & F.col("verdict").isNull()
    d = d.join(known, "hash", "left")
    return d.select("repo_id", F.col("id").alias("file_id"), F.coalesce("verdict", F.when(copy, "third_party"), F.lit("hand_written")).alias("verdict"), F.coalesce("ground", F.when(copy, "copy")).alias("ground"))


def not_hand_written(files: DataFrame, samples: DataFrame) -> DataFrame:
    """(repo_id, file_id) of the files that nobody in the project wrote."""
    return judge_files(files, samples).where("verdict <> 'hand_written'").select("repo_id", "file_id")


def grounds(files: DataFrame, samples: DataFrame) -> DataFrame:
    """Number of files by verdict and ground."""
    return judge_files(files, samples).groupBy("verdict", "ground").agg(F.count("*").alias("n_files"))
