"""What the pattern extractors know of each language, and the rules of frameworks. Fixed values throughout: languages'
keywords and frameworks' names, one plain table each."""

from __future__ import annotations

NAME = r"([A-Za-z_]\w*)"
_MODS = r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|data|open|export|default|async|override|virtual|inline|suspend|pub|unsafe|const|readonly|external|factory)\s+)*"

#: language -> (kind, pattern on a line with the name as its group); the first that matches counts.
DEFINITIONS = {
    "go": (("function", r"^func\s+([A-Za-z_]\w*)\s*[(\[]"), ("method", r"^func\s+\([^)]*\)\s*([A-Za-z_]\w*)\s*\("), ("class", r"^type\s+([A-Za-z_]\w*)\s+struct\b"), ("interface", r"^type\s+([A-Za-z_]\w*)\s+interface\b"), ("type_alias", r"^type\s+([A-Za-z_]\w*)\s+[=A-Za-z*\[]"), ("variable", r"^(?:const|var)\s+([A-Za-z_]\w*)\b")),
    "javascript": (("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"), ("function", r"^\s*(?:export\s+)?(?:const|let)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"), ("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"), ("type_alias", r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*="), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"), ("namespace", r"^\s*(?:export\s+)?namespace\s+([A-Za-z_$][\w$.]*)"), ("variable", r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*="), ("method", r"^\s+(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*(?::[^{]+)?\{\s*$")),
    "java": (("class", _MODS + r"(?:class|record|struct|object|actor|extension)\s+" + NAME), ("interface", _MODS + r"(?:interface|protocol|trait)\s+" + NAME), ("enum", _MODS + r"enum\s+(?:class\s+)?" + NAME), ("function", _MODS + r"(?:fun|func)\s+(?:<[^>]*>\s*)?(?:\w+\.)?" + NAME), ("namespace", r"^\s*namespace\s+([\w.]+)"), ("method", r"^\s*(?:(?:public|private|protected|internal|static|final|async|override|virtual|abstract|synchronized)\s+)+[\w<>\[\],.? ]+\s+([A-Za-z_]\w*)\s*\([^;]*$"), ("variable", r"^\s*(?:(?:public|private|static|final|const)\s+)+[\w<>\[\]]+\s+([A-Za-z_]\w*)\s*=")),
    "scala": (("class", r"^\s*(?:(?:sealed|abstract|final|case|implicit)\s+)*(?:class|object)\s+" + NAME), ("interface", r"^\s*(?:sealed\s+)?trait\s+" + NAME), ("function", r"^\s*(?:(?:override|private|protected|implicit|final)\s+)*def\s+" + NAME), ("type_alias", r"^\s*type\s+" + NAME)),
    "dart": (("class", r"^\s*(?:abstract\s+)?(?:class|mixin|extension)\s+" + NAME), ("enum", r"^\s*enum\s+" + NAME), ("function", r"^\s*(?:static\s+)?[\w<>?\[\], ]+\s+([a-z_]\w*)\s*\([^;]*\)\s*(?:async\s*)?\{\s*$"), ("type_alias", r"^\s*typedef\s+" + NAME)),
    "rust": (("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+" + NAME), ("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+" + NAME), ("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+" + NAME), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+" + NAME), ("module", r"^\s*(?:pub\s+)?mod\s+" + NAME), ("type_alias", r"^\s*(?:pub\s+)?type\s+" + NAME), ("variable", r"^\s*(?:pub\s+)?(?:const|static)\s+" + NAME)),
    "zig": (("function", r"^\s*(?:pub\s+)?(?:export\s+|inline\s+)?fn\s+" + NAME), ("class", r"^\s*(?:pub\s+)?const\s+([A-Za-z_]\w*)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|union)"), ("enum", r"^\s*(?:pub\s+)?const\s+([A-Za-z_]\w*)\s*=\s*enum"), ("variable", r"^\s*(?:pub\s+)?(?:const|var)\s+" + NAME)),
    "ruby": (("method", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)"), ("class", r"^\s*class\s+([A-Z][\w:]*)"), ("module", r"^\s*module\s+([A-Z][\w:]*)"), ("variable", r"^\s*([A-Z][A-Z_0-9]+)\s*=")),
    "php": (("function", r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?" + NAME), ("class", r"^\s*(?:abstract\s+|final\s+|readonly\s+)*class\s+" + NAME), ("interface", r"^\s*interface\s+" + NAME), ("interface", r"^\s*trait\s+" + NAME), ("enum", r"^\s*enum\s+" + NAME), ("namespace", r"^\s*namespace\s+([\w\\]+)"), ("variable", r"^\s*(?:public\s+|private\s+)?const\s+" + NAME)),
    "c": (("class", r"^\s*(?:typedef\s+)?(?:class|struct|union)\s+([A-Za-z_]\w*)\s*(?:final\s*)?(?::[^{]*)?\{"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?([A-Za-z_]\w*)\s*[:{]"), ("namespace", r"^\s*namespace\s+([\w:]+)\s*\{"), ("variable", r"^#define\s+([A-Z_][A-Z0-9_]*)\s+\S"), ("function", r"^[A-Za-z_][\w\s*&:<>,~]*?\b([A-Za-z_~]\w*)\s*\([^;]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{?\s*$")),
    "python": (("function", r"^\s*(?:async\s+)?def\s+" + NAME), ("class", r"^\s*class\s+" + NAME), ("variable", r"^([A-Z][A-Z_0-9]+)\s*=")),
    "gdscript": (("function", r"^\s*(?:static\s+)?func\s+" + NAME), ("class", r"^\s*class(?:_name)?\s+" + NAME), ("enum", r"^\s*enum\s+" + NAME), ("variable", r"^(?:@export\S*\s+)?(?:const|var)\s+" + NAME), ("function", r"^\s*signal\s+" + NAME)),
    "sql": (("class", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp\s+|temporary\s+|materialized\s+)*(?:table|view)\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)"), ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure|trigger)\s+([\w.]+)"), ("variable", r"(?i)^\s*create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?([\w.]+)")),
    "lua": (("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)"), ("function", r"^\s*(?:local\s+)?([\w.]+)\s*=\s*function\b"), ("variable", r"^local\s+" + NAME)),
    "bash": (("function", r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{?"), ("function", r"^\s*function\s+([A-Za-z_][\w-]*)"), ("variable", r"^(?:export\s+|readonly\s+)?([A-Z_][A-Z0-9_]*)=")),
    "powershell": (("function", r"(?i)^\s*(?:function|filter)\s+(?:\w+:)?([\w-]+)"), ("class", r"(?i)^\s*class\s+" + NAME), ("enum", r"(?i)^\s*enum\s+" + NAME)),
    "protobuf": (("class", r"^\s*message\s+(\w+)"), ("interface", r"^\s*service\s+(\w+)"), ("method", r"^\s*rpc\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)")),
    "hcl": (("class", r"^\s*(?:resource|data)\s+\"[^\"]+\"\s+\"([^\"]+)\""), ("module", r"^\s*module\s+\"([^\"]+)\""), ("variable", r"^\s*(?:variable|output)\s+\"([^\"]+)\"")),
    "elixir": (("module", r"^\s*defmodule\s+([\w.]+)"), ("interface", r"^\s*defprotocol\s+([\w.]+)"), ("function", r"^\s*def(?:p|macro|macrop)?\s+([a-z_]\w*[?!]?)")),
    "erlang": (("module", r"^-module\((\w+)\)"), ("class", r"^-record\((\w+)"), ("variable", r"^-define\((\w+)"), ("function", r"^([a-z]\w*)\s*\([^)]*\)\s*(?:when\b.*)?->")),
    "clojure": (("namespace", r"^\s*\(ns\s+([\w.\-]+)"), ("function", r"^\s*\(defn-?\s+(?:\^\S+\s+)*([\w\-!?*<>=+]+)"), ("function", r"^\s*\(defmacro\s+([\w\-!?]+)"), ("interface", r"^\s*\(defprotocol\s+([\w\-]+)"), ("class", r"^\s*\(def(?:record|type)\s+([\w\-]+)"), ("variable", r"^\s*\(def(?:once)?\s+(?:\^\S+\s+)*([\w\-*]+)")),
    "haskell": (("module", r"^module\s+([\w.]+)"), ("function", r"^([a-z][\w']*)\s*::"), ("class", r"^(?:data|newtype)\s+([A-Z]\w*)"), ("interface", r"^class\s+(?:\([^)]*\)\s*=>\s*)?([A-Z]\w*)"), ("type_alias", r"^type\s+([A-Z]\w*)")),
    "ocaml": (("module", r"^\s*module\s+(?:type\s+)?([A-Z]\w*)"), ("class", r"^\s*(?:type|class)\s+(?:'\w+\s+)?([a-z_]\w*)"), ("function", r"^\s*let\s+(?:rec\s+)?([a-z_][\w']*)\s+[^=\s]"), ("variable", r"^\s*let\s+([a-z_][\w']*)\s*="), ("function", r"^\s*val\s+([a-z_][\w']*)\s*:")),
    "fsharp": (("module", r"^\s*(?:module|namespace)\s+(?:rec\s+)?([\w.]+)"), ("class", r"^\s*type\s+(?:private\s+|internal\s+)?([A-Z]\w*)"), ("method", r"^\s*(?:static\s+)?(?:member|override|abstract)\s+(?:\w+\.)?([A-Za-z_]\w*)"), ("function", r"^\s*let\s+(?:rec\s+|inline\s+|private\s+)*([a-z_]\w*)\s+[^=\s]"), ("variable", r"^\s*let\s+(?:mutable\s+)?([a-z_]\w*)\s*=")),
    "perl": (("namespace", r"^\s*package\s+([\w:]+)"), ("function", r"^\s*sub\s+" + NAME), ("variable", r"^\s*our\s+[$@%]" + NAME)),
    "r": (("function", r"^\s*([\w.]+)\s*(?:<-|=)\s*function\s*\("), ("class", r"^\s*set(?:Class|RefClass)\(\s*[\"']([\w.]+)"), ("function", r"^\s*set(?:Generic|Method)\(\s*[\"']([\w.]+)"), ("variable", r"^([A-Z][A-Z_.0-9]+)\s*<-")),
    "shader": (("function", r"^(?:\[\w+\]\s*)?[a-z]\w*\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?::\s*\w+\s*)?\{?\s*$"), ("class", r"^\s*(?:struct|cbuffer)\s+" + NAME), ("function", r"^\s*(?:@\w+(?:\([^)]*\))?\s*)*fn\s+" + NAME), ("variable", r"^\s*(?:layout\s*\([^)]*\)\s*)?(?:uniform|in|out|varying|attribute)\s+\w+\s+" + NAME)),
    "solidity": (("class", r"^\s*(?:abstract\s+)?(?:contract|library)\s+" + NAME), ("interface", r"^\s*interface\s+" + NAME), ("class", r"^\s*struct\s+" + NAME), ("enum", r"^\s*enum\s+" + NAME), ("method", r"^\s*function\s+" + NAME), ("method", r"^\s*modifier\s+" + NAME), ("variable", r"^\s*event\s+" + NAME)),
    "prisma": (("class", r"^\s*model\s+" + NAME), ("enum", r"^\s*enum\s+" + NAME), ("module", r"^\s*(?:datasource|generator)\s+" + NAME)),
    "graphql": (("class", r"^\s*(?:extend\s+)?(?:type|input)\s+" + NAME), ("interface", r"^\s*interface\s+" + NAME), ("enum", r"^\s*enum\s+" + NAME), ("type_alias", r"^\s*(?:union|scalar)\s+" + NAME)),
    "css": (("class", r"^\s*\.([A-Za-z_][\w-]*)\s*[,{:]"), ("variable", r"^\s*(--[\w-]+)\s*:"), ("function", r"^\s*@(?:keyframes|mixin)\s+([\w-]+)")),
    "html": (("module", r"(?i)<(?:section|main|form|template|article|div)\b[^>]*\bid=[\"']([^\"']+)"), ("function", r"(?i)<script\b[^>]*\bsrc=[\"']([^\"']+)")),
    "markdown": (("module", r"^#{1,3}\s+(.+?)\s*#*$"),),
    "docker": (("module", r"(?i)^\s*from\s+\S+\s+as\s+([\w.-]+)"), ("module", r"(?i)^\s*from\s+([\w./:@-]+)"), ("variable", r"(?i)^\s*(?:arg|env)\s+([A-Za-z_]\w*)"), ("function", r"(?i)^\s*(?:entrypoint|cmd)\s+(.+)$")),
    "make": (("function", r"^([A-Za-z_][\w.-]*)\s*:(?:[^=]|$)"), ("variable", r"^([A-Z_][A-Z0-9_]*)\s*[:?+]?=")),
    "yaml": (("class", r"^kind:\s*([A-Za-z]\w*)"), ("variable", r"^\s{0,2}name:\s*[\"']?([\w.-]+)"), ("function", r"^\s*-\s+name:\s*[\"']?(.+?)[\"']?\s*$"), ("module", r"^([A-Za-z_][\w-]*):\s*$")),
    "text": (("module", r"^\s*([A-Z][A-Z0-9 ]{3,40})\s*$"),),
}
#: languages that are read by the patterns of another one.
ALIASES = {
    "typescript": "javascript", "vue": "javascript", "svelte": "javascript", "astro": "javascript", "mdx": "markdown", "kotlin": "java", "csharp": "java", "swift": "java", "cpp": "c", "blade": "php",
    "scss": "css", "less": "css", "glsl": "shader", "hlsl": "shader", "wgsl": "shader", "kubernetes": "yaml", "ansible": "yaml", "terraform": "hcl",
}
#: languages whose blocks follow indentation or an ``end``; those of all others braces.
INDENTED = {"python", "ruby", "lua", "elixir", "gdscript", "haskell", "ocaml", "fsharp", "yaml", "markdown", "erlang", "clojure", "r", "docker", "make", "text", "html", "sql"}
#: comments to the line's end.
HASH_COMMENTS = {"python", "ruby", "bash", "perl", "r", "elixir", "yaml", "docker", "make", "powershell", "gdscript", "hcl", "graphql"}
DASH_COMMENTS = {"sql", "lua", "haskell"}
#: what a type's head says it extends and implements: (edge, pattern with the list as its group).
HEADS = (
    ("inherits", r"\bextends\s+([\w.\\<>, ]+?)(?:\s+implements\b|\s+with\b|\s*\{|$)"), ("implements", r"\bimplements\s+([\w.\\<>, ]+?)(?:\s*\{|$)"), ("inherits", r"\bclass\s+\w+\s*(?:\([^)]*\))?\s*:\s*(?:public\s+|private\s+|protected\s+)?([\w.:<>, ]+?)\s*(?:\([^)]*\)\s*)?(?:\{|$)"),
    ("inherits", r"^\s*class\s+[A-Z][\w:]*\s*<\s*([\w:]+)"), ("implements", r"^\s*impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\b"), ("inherits", r"\b(?:contract|interface)\s+\w+\s+is\s+([\w, ]+?)\s*(?:\{|$)"), ("inherits", r"^\s*(?:trait|protocol)\s+\w+\s*:\s*([\w, +]+?)\s*(?:\{|$)"),
)

#: (framework, languages read with these patterns, role, pattern): a role and, where it has a group, what it names.
FRAMEWORKS = (
    ("express", "javascript", "route", r"\b(?:app|router)\.(?:get|post|put|patch|delete|all|use)\(\s*[\"'`](/[^\"'`]*)"),
    ("nest", "javascript", "route", r"@(?:Get|Post|Put|Patch|Delete|All)\(\s*[\"'`]?([^\"'`)]*)"), ("nest", "javascript", "controller", r"@Controller\(\s*[\"'`]?([^\"'`)]*)"), ("nest", "javascript", "injectable", r"@(Injectable|Module)\("),
    ("nextjs", "javascript", "route", r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|getServerSideProps|getStaticProps|generateMetadata)\b"),
    ("nuxt", "javascript", "route", r"\b(defineEventHandler|definePageMeta|useFetch|useAsyncData)\("),
    ("angular", "javascript", "component", r"@(Component|NgModule|Directive|Pipe)\("), ("angular", "javascript", "injection", r"\binject\(\s*([A-Z]\w*)"),
    ("astro", "javascript", "component", r"\bAstro\.(props|request|params)\b"),
    ("drizzle", "javascript", "table", r"\b(?:pgTable|mysqlTable|sqliteTable)\(\s*[\"'`](\w+)"), ("prisma", "javascript", "table", r"\bprisma\.(\w+)\.(?:find|create|update|delete|upsert)"),
    ("spring", "java", "route", r"@(?:Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*)?\"?([^\")]*)"), ("spring", "java", "controller", r"@(RestController|Controller)\b"), ("spring", "java", "injectable", r"@(Service|Repository|Component|Bean|Autowired)\b"),
    ("jpa", "java", "table", r"@Table\(\s*name\s*=\s*\"(\w+)"), ("jpa", "java", "entity", r"@(Entity|MappedSuperclass|Embeddable)\b"),
    ("aspnet", "java", "route", r"\[(?:Http(?:Get|Post|Put|Patch|Delete)|Route)(?:\(\"([^\"]*)\"\))?\]"), ("aspnet", "java", "route", r"\.Map(?:Get|Post|Put|Patch|Delete)\(\s*\"([^\"]*)"),
    ("ktor", "java", "route", r"^\s*(?:get|post|put|delete|route)\(\s*\"(/[^\"]*)"),
    ("laravel", "php", "route", r"\bRoute::(?:get|post|put|patch|delete|any|resource)\(\s*[\"']([^\"']+)"), ("laravel", "php", "entity", r"\bextends\s+(Model|Authenticatable)\b"), ("laravel", "php", "injection", r"\bapp\(\)?->(?:make|bind|singleton)\(\s*([\w\\:]+)"),
    ("wordpress", "php", "hook", r"\badd_(?:action|filter)\(\s*[\"']([^\"']+)"), ("wordpress", "php", "route", r"\bregister_rest_route\(\s*[\"'][^\"']*[\"']\s*,\s*[\"']([^\"']+)"), ("wordpress", "php", "hook", r"\badd_shortcode\(\s*[\"']([^\"']+)"),
    ("blade", "php", "view", r"@(?:extends|include|component)\(\s*[\"']([^\"']+)"),
    ("phoenix", "elixir", "route", r"^\s*(?:get|post|put|patch|delete|live|resources)\s+\"(/[^\"]*)"), ("phoenix", "elixir", "plug", r"^\s*(?:plug|pipe_through)\s+:?([\w.\[\]:]+)"),
    ("flask", "python", "route", r"@\w+\.route\(\s*[\"']([^\"']+)"), ("fastapi", "python", "route", r"@\w+\.(?:get|post|put|patch|delete)\(\s*[\"']([^\"']+)"), ("django", "python", "route", r"\b(?:path|re_path)\(\s*r?[\"']([^\"']*)"), ("django", "python", "entity", r"\bclass\s+\w+\((?:models\.)(Model)\)"), ("sqlalchemy", "python", "table", r"__tablename__\s*=\s*[\"'](\w+)"),
    ("rails", "ruby", "route", r"^\s*(?:get|post|put|patch|delete|resources?)\s+[\"':]([\w/:#]+)"), ("rails", "ruby", "entity", r"<\s*(ApplicationRecord|ActiveRecord::Base)\b"),
    ("gin", "go", "route", r"\.(?:GET|POST|PUT|PATCH|DELETE|Any)\(\s*\"([^\"]+)"), ("net/http", "go", "route", r"\bHandle(?:Func)?\(\s*\"([^\"]+)"), ("gorm", "go", "entity", r"\b(gorm\.Model)\b"),
    ("axum", "rust", "route", r"\.route\(\s*\"([^\"]+)"), ("actix", "rust", "route", r"#\[(?:get|post|put|patch|delete)\(\"([^\"]+)"),
)
