"""Predicates over paths, names and kinds as Columns. Each pattern is one regular expression that Java and RE2 read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segments(*names: str) -> str:
    return "(^|/)(" + "|".join(names) + ")/"


# Folders and names that tell what a path is for. All are matched on the lower-cased path.
VENDOR = _segments("vendor", "node_modules", "third_party", "bower_components", "site-packages", "dist", "build", "generated", "__generated__") + r"|\.min\.js$|\.pb\.go$"
TEST = _segments("test", "tests", "__tests__", "spec", "specs", "testing") + r"|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*$|_spec\.rb$|tests?\.(java|cs|kt|php)$"
DEMO = _segments("demo", "demos", "example", "examples", "sample", "samples", "playground", "docs_src")
FIXTURE = _segments("fixture", "fixtures", "testdata", "factories", "seeders", "mocks", "__mocks__", "stubs") + "|" + TEST
STYLE = r"\.(css|scss|sass|less|styl)$|" + _segments("styles", "css")
SCAFFOLD = _segments("seeders", "factories", "migrations", "mocks", "demos") + r"|(seeder|factory|migration|mock)\.[a-z]+$"
CONFIG = r"\.(ya?ml|toml|ini|json|env|cfg|conf|properties)$"
DEPENDENCY = r"(^|/)(package(-lock)?\.json|go\.(mod|sum)|cargo\.(toml|lock)|requirements[^/]*\.txt|pyproject\.toml|pom\.xml|gemfile(\.lock)?|composer\.(json|lock)|[a-z]+\.lock)$"
ENTRY = r"(^|/)(main|index|app|server|cli|manage|__main__)\.[a-z]+$|(^|/)cmd/"
CODE = r"\.(go|py|pyi|js|jsx|ts|tsx|mjs|cjs|java|kt|kts|scala|rb|rs|php|cs|cc|cpp|cxx|c|h|hpp|swift|dart|lua|ex|exs|erl|hs|ml|clj|sol|zig|r|pl|sh|sql|vue|svelte)$"
ADDON = _segments("addons", "plugins", "library")
ROUTE = r"(^|/)(routes?|routing|router)[^/]*/|route"
MONEY = r"billing|payment|invoice|ledger|pricing|refund"
AUTH = r"auth|login|session|permission|password|token"
# Churn here is no sign of a hot path: dependencies, scripts, tools, benchmarks, tests and schema history.
HOTSPOT_NOISE = _segments("deps", "scripts?", "tools", "benchmarks", "bench", "generators") + "|/(vendor|third_party|node_modules|lua|hiredis|jemalloc|tooling|fixtures|tests?|__tests__|testdata|testing|migrations)/" + r"|(^|/)(test_|generate_)[^/]*$|_test\.(c|py|go|rb)$|_spec\.rb$|\.(sh|ps1|bat)$"
SECONDARY = _segments("docs_src", "samples?", "examples?", "integration", "fixtures?", "testdata", "benchmarking", "playgrounds?", "acceptance", r"\.github") + r"|/_expected/|(^|/)(expected\.[^/]*|[^/]*_expected[^/]*)$"

FLAGS = {"vendor": VENDOR, "test": TEST, "demo": DEMO, "fixture": FIXTURE, "style": STYLE, "scaffold": SCAFFOLD, "config": CONFIG, "dependency": DEPENDENCY, "entrypoint": ENTRY, "addon": ADDON, "hotspot_noise": HOTSPOT_NOISE, "secondary": SECONDARY}

# Language labels by extension.
LANGUAGES = {
    "go": "go", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "rb": "ruby", "rs": "rust", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp",
    "cxx": "cpp", "hpp": "cpp", "swift": "swift", "dart": "dart", "lua": "lua", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hs": "haskell", "ml": "ocaml", "clj": "clojure",
    "sol": "solidity", "zig": "zig", "r": "r", "pl": "perl", "sh": "bash", "ps1": "powershell", "sql": "sql", "vue": "vue", "svelte": "svelte", "astro": "astro", "html": "html",
    "css": "css", "scss": "css", "md": "markdown", "mdx": "mdx", "proto": "protobuf", "graphql": "graphql", "tf": "hcl", "yaml": "yaml", "yml": "yaml", "json": "json",
    "fs": "fsharp", "fsx": "fsharp", "gd": "gdscript", "prisma": "prisma", "glsl": "shader", "vert": "shader", "frag": "shader", "hlsl": "shader", "wgsl": "shader", "less": "css", "sass": "css",
    "cljs": "clojure", "cljc": "clojure", "mli": "ocaml", "pm": "perl", "hrl": "erlang", "gql": "graphql", "bash": "bash", "psm1": "powershell", "htm": "html",
}


def path_flag(name: str, path: Column) -> Column:
    return F.lower(F.coalesce(path, F.lit(""))).rlike(FLAGS[name])


def language_of(path: Column) -> Column:
    """Language by file extension, 'text' where it is unknown, 'docker' and 'make' by name."""
    name = F.lower(F.substring_index(path, "/", -1))
    ext = F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(name.startswith("dockerfile"), "docker").when(name == "makefile", "make").otherwise(F.coalesce(F.try_element_at(table, ext), F.lit("text")))


def dirname(path: Column) -> Column:
    """Text before the last slash, '.' without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def subtree_root(path: Column) -> Column:
    """The two leading segments of paths in monorepo folders, else empty."""
    return F.regexp_extract(path, r"^((?:packages|apps|services|sample|samples|libs|modules)/[^/]+)/", 1)


def id_path(node_id: Column) -> Column:
    """Path part of a sym:, file: or mod: id."""
    return F.regexp_extract(node_id, r"^[a-z]+:[^:]*:([^:]*)", 1)


def ref_name(dst: Column) -> Column:
    """Name of an unresolved reference: the text after its last colon."""
    return F.substring_index(dst, ":", -1)


def context_kind(path: Column) -> Column:
    p = F.lower(F.coalesce(path, F.lit("")))
    return F.when(p.rlike(TEST), "test").when(p.rlike(ENTRY), "entrypoint").when(p.rlike(DEPENDENCY), "dependency").when(p.rlike(CONFIG), "config").otherwise("implementation")


def is_exported(name: Column, language: Column) -> Column:
    """A leading underscore hides; Go exports upper-case initials; else everything is exported."""
    return F.when(name.startswith("_"), False).when(language == "go", name.rlike(r"^\p{Lu}")).otherwise(True)


def plausible_name(name: Column) -> Column:
    return (name != "") & ~name.rlike(r"[, \t\n($]")


def behavioural(kind: Column) -> Column:
    return kind.isin("function", "method")


def test_risk(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike(MONEY), "money").when(p.rlike(AUTH), "auth").otherwise("behaviour")


def arch_role(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike("controller|handler|routes?/"), "controller").when(p.rlike("view|template|component|render"), "view").when(p.rlike("model|schema|entity"), "model").otherwise("internal")


# Fixed value: names that an indexer makes up for routes.
SYNTHETIC_ROUTE = r"^(route|fastapi|express|flask|fiber|gin|nest|axum|ktor|sinatra)_(get|post|put|patch|delete|head|options|any|use|match)_[0-9]+$"
# Layer, pattern of the lower-case path, pattern of the lower-case name.
LAYER_RULES = (
    ("route", r"/(routes?|routing)/|(routes|router)\.go$|routes\.(php|ts|js)$", r"^(servehttp2?|handle|handlefunc)$|" + SYNTHETIC_ROUTE),
    ("controller", r"/controllers?/|controller\.(php|ts|go)$", r"controller$"),
    ("service", r"/(services?|usecases|use_cases|interactors|handlers?)/", r"(service|interactor|usecase|handler)$"),
    ("query", r"/(repositor(ies|y)|quer(ies|y)|models|dao|persistence|stores?)/", r"(repository|repo|query|store|dao|mapper|model)$"),
)


def flow_layer(name: Column, path: Column, signature: Column | None = None, rules=LAYER_RULES) -> Column:
    """Layer of a request flow; the first rule that matches path or name wins, entry points by signature are routes."""
    n, p = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    layer = F.lit("other")
    for label, of_path, of_name in reversed(rules):
        hit = p.rlike(of_path) | n.rlike(of_name)
        if label == "route" and signature is not None:
            hit = hit | F.contains(F.lower(F.coalesce(signature, F.lit(""))), F.lit("role=entrypoint"))
        layer = F.when(hit, label).otherwise(layer)
    return layer


def layer_cohesion(layer: Column, members: Column) -> Column:
    """How close the members of a layer's cluster belong together; large clusters less."""
    base = F.when(layer == "route", 0.6).when(layer == "controller", 0.7).when(layer == "service", 0.75).when(layer == "query", 0.65).otherwise(0.55)
    return F.round(base - F.when(members > 20, 0.1).otherwise(0.0), 6)


def layer_score(layer: Column) -> Column:
    return F.when(layer == "query", 5).when(layer == "route", 4).when(layer == "controller", 3).when(layer == "service", 2).otherwise(0)


RUNTIME = r"^(main|init|setup|teardown|__init__|__main__|run|handle|configure)$|^(test|bench|fuzz|on)[_A-Z]|(handler|listener|hook|callback|middleware)$"
SUSPECT = r"(handler|callback|hook|listener|plugin|factory|provider|adapter)"


def runtime_invoked(name: Column, path: Column) -> Column:
    return F.lower(name).rlike(RUNTIME.lower()) | path_flag("test", path)


def dispatch_suspect(name: Column) -> Column:
    return F.lower(name).rlike(SUSPECT)
