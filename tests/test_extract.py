import pytest

from codeloom.sources import extract as E


def names(text, language):
    return {(r[2], r[3]) for r in E.by_patterns("r", "p", text, language) if r[0] == "symbol"}


def edges(text, language, kind):
    return {(r[8].split(":")[-1], r[9].split(":")[-1]) for r in E.by_patterns("r", "p", text, language) if r[0] == "edge" and r[2] == kind}


CASES = {
    "go": ("type Ledger struct {\n\tn int\n}\n\nfunc (l *Ledger) Flush(n int) error {\n\treturn write(l)\n}\n\nconst Limit = 3\nfunc run() { x := Limit }\n", {("class", "Ledger"), ("method", "Flush"), ("variable", "Limit"), ("function", "run")}),
    "typescript": ("export interface Shape { area(): number }\nexport enum Kind { A }\nexport class Ring extends Base implements Shape {\n  area(): number {\n    return Math.pow(2)\n  }\n}\nexport const make = (x) => new Ring(x)\ntype Id = string\n", {("interface", "Shape"), ("enum", "Kind"), ("class", "Ring"), ("method", "area"), ("function", "make"), ("type_alias", "Id")}),
    "java": ("public class Ledger extends Book implements Store, Open {\n  private static final int LIMIT = 3;\n  public int flush(int n) {\n    return write(n);\n  }\n}\n", {("class", "Ledger"), ("variable", "LIMIT"), ("method", "flush")}),
    "kotlin": ("data class Pair(val a: Int)\nfun main() {\n}\n", {("class", "Pair"), ("function", "main")}),
    "csharp": ("namespace App.Core {\n  public interface IStore { }\n  public class Store : Base {\n    public void Put(int x) {\n    }\n  }\n}\n", {("namespace", "App.Core"), ("interface", "IStore"), ("class", "Store"), ("method", "Put")}),
    "swift": ("protocol Open {}\nstruct Box {\n  func area() -> Int { return 1 }\n}\n", {("interface", "Open"), ("class", "Box"), ("method", "area")}),
    "scala": ("sealed trait Shape\ncase class Ring(r: Int) extends Shape {\n  def area = 1\n}\n", {("interface", "Shape"), ("class", "Ring"), ("method", "area")}),
    "dart": ("class Box extends Base {\n  int area(int x) {\n    return x;\n  }\n}\n", {("class", "Box"), ("method", "area")}),
    "rust": ("pub struct Ledger {}\npub trait Store {}\nimpl Store for Ledger {}\npub(crate) async fn flush() {\n    write();\n}\nconst MAX: u8 = 1;\n", {("class", "Ledger"), ("interface", "Store"), ("function", "flush"), ("variable", "MAX")}),
    "zig": ("pub const Box = struct {\n    n: u8,\n};\npub fn area() void {\n}\n", {("class", "Box"), ("function", "area")}),
    "ruby": ("module App\n  class Box < Base\n    def area?\n      run\n    end\n  end\nend\n", {("module", "App"), ("class", "Box"), ("method", "area?")}),
    "php": ("namespace App\\Core;\nfinal class Box extends Base {\n  public function area() {\n    return Math::pow(2);\n  }\n}\ntrait Opens {}\n", {("namespace", "App\\Core"), ("class", "Box"), ("method", "area"), ("interface", "Opens")}),
    "cpp": ("#define LIMIT 3\nnamespace app {\nclass Box : public Base {\n};\n}\nint area(int x) {\n  return x;\n}\n", {("variable", "LIMIT"), ("namespace", "app"), ("class", "Box"), ("function", "area")}),
    "gdscript": ("class_name Player\nconst SPEED = 3\nfunc move():\n\tgo(SPEED)\n", {("class", "Player"), ("variable", "SPEED"), ("function", "move")}),
    "sql": ("CREATE TABLE IF NOT EXISTS app.users (id int);\ncreate unique index u on users(id);\ncreate function f() returns int as 'x';\n", {("class", "app.users"), ("variable", "u"), ("function", "f")}),
    "lua": ("local M = {}\nfunction M.run(x)\n  go(x)\nend\nM.stop = function() end\n", {("variable", "M"), ("function", "M.run"), ("function", "M.stop")}),
    "bash": ("LIMIT=3\nrun() {\n  echo $LIMIT\n}\nfunction stop\n{\n}\n", {("variable", "LIMIT"), ("function", "run"), ("function", "stop")}),
    "powershell": ("function Get-Item2 {\n}\nclass Box {\n}\n", {("function", "Get-Item2"), ("class", "Box")}),
    "protobuf": ("message User {\n}\nservice Users {\n  rpc Get(User) returns (User);\n}\n", {("class", "User"), ("interface", "Users"), ("method", "Get")}),
    "hcl": ('resource "aws_s3" "logs" {\n}\nvariable "region" {}\nmodule "net" {\n}\n', {("class", "logs"), ("variable", "region"), ("module", "net")}),
    "elixir": ("defmodule App.Box do\n  def area(x) do\n    run(x)\n  end\nend\n", {("module", "App.Box"), ("method", "area")}),
    "erlang": ("-module(box).\n-record(user, {id}).\narea(X) -> run(X).\n", {("module", "box"), ("class", "user"), ("function", "area")}),
    "clojure": ("(ns app.core)\n(def limit 3)\n(defn area [x]\n  (run x))\n(defrecord Box [a])\n", {("namespace", "app.core"), ("variable", "limit"), ("function", "area"), ("class", "Box")}),
    "haskell": ("module App where\ndata Box = Box Int\nclass Shape a where\narea :: Box -> Int\n", {("module", "App"), ("class", "Box"), ("interface", "Shape"), ("function", "area")}),
    "ocaml": ("module Box = struct\nend\nlet area x = run x\nlet limit = 3\n", {("module", "Box"), ("function", "area"), ("variable", "limit")}),
    "fsharp": ("module App\ntype Box = { A: int }\nlet area x = run x\n", {("module", "App"), ("class", "Box"), ("function", "area")}),
    "perl": ("package App::Box;\nour $LIMIT = 3;\nsub area {\n  return run();\n}\n", {("namespace", "App::Box"), ("variable", "LIMIT"), ("function", "area")}),
    "r": ('area <- function(x) {\n  run(x)\n}\nsetClass("Box")\n', {("function", "area"), ("class", "Box")}),
    "glsl": ("uniform vec3 light;\nvec3 shade(vec3 n) {\n  return n;\n}\n", {("variable", "light"), ("function", "shade")}),
    "solidity": ("contract Box is Base {\n  function area() public {\n  }\n  event Done(uint x);\n}\n", {("class", "Box"), ("method", "area"), ("variable", "Done")}),
    "prisma": ("datasource db {\n}\nmodel User {\n}\nenum Role {\n}\n", {("module", "db"), ("class", "User"), ("enum", "Role")}),
    "graphql": ("type Query {\n}\ninterface Node {\n}\nunion Any = A | B\n", {("class", "Query"), ("interface", "Node"), ("type_alias", "Any")}),
    "css": (".box { }\n:root {\n  --gap: 3px;\n}\n@keyframes spin {\n}\n", {("class", "box"), ("variable", "--gap"), ("function", "spin")}),
    "docker": ("FROM node:20 AS build\nENV MODE=prod\nENTRYPOINT run.sh\n", {("module", "build"), ("variable", "MODE"), ("function", "run.sh")}),
    "make": ("MODE := prod\nbuild: deps\n\tgo build\n", {("variable", "MODE"), ("function", "build")}),
    "kubernetes": ("kind: Deployment\nmetadata:\n  name: web\n", {("class", "Deployment"), ("module", "metadata"), ("variable", "web")}),
    "markdown": ("# Title\ntext\n## Part two ##\n", {("module", "Title"), ("module", "Part two")}),
    "unknown": ("anything (at) all", set()),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_definitions(language):
    text, want = CASES[language]
    assert names(text, language) == want
    assert names("", language) == set() and names("\x00{{{((('\"`", language) == set()


def test_edges():
    ts = CASES["typescript"][0]
    assert edges(ts, "typescript", "inherits") == {("Ring", "Base")} and edges(ts, "typescript", "implements") == {("Ring", "Shape")} and ("area", "Math.pow") in edges(ts, "typescript", "calls")
    assert edges(CASES["java"][0], "java", "implements") == {("Ledger", "Store"), ("Ledger", "Open")} and edges(CASES["java"][0], "java", "calls") == {("flush", "write")}
    assert edges(CASES["go"][0], "go", "reads") == {("run", "Limit")} and edges(CASES["gdscript"][0], "gdscript", "calls") == {("move", "go")}
    assert edges('import { a } from "./x";\nimport y\nconst z = require("q");\n', "javascript", "imports") == {("p", "./x"), ("p", "y"), ("p", "q")}
    assert edges('func run() {\n\t// stop()\n\ts := "halt()"\n\tgo2()\n}\nfunc other() { far() }\n', "go", "calls") == {("run", "go2"), ("other", "far")}
    assert edges(CASES["ruby"][0], "ruby", "inherits") == {("Box", "Base")} and edges(CASES["solidity"][0], "solidity", "inherits") == {("Box", "Base")}


def test_blocks_and_owners():
    rows = {r[3]: r for r in E.by_patterns("r", "p", CASES["java"][0], "java") if r[0] == "symbol"}
    assert (rows["Ledger"][4], rows["Ledger"][5]) == (1, 6) and (rows["flush"][4], rows["flush"][5], rows["flush"][7]) == (3, 5, "Ledger")
    rows = {r[3]: r for r in E.by_patterns("r", "p", CASES["ruby"][0], "ruby") if r[0] == "symbol"}
    assert rows["App"][5] == 7 and (rows["area?"][5], rows["area?"][7]) == (5, "Box")
    rows = {r[3]: r for r in E.by_patterns("r", "p", CASES["go"][0], "go") if r[0] == "symbol"}
    assert rows["Flush"][7] == "Ledger" and rows["run"][7] is None


MARKS = {
    "express": ("javascript", "app.get('/users', list)", ("route", "/users")), "nest": ("typescript", '@Get("users")', ("route", "users")), "nextjs": ("typescript", "export async function GET(r) {", ("route", "GET")), "angular": ("typescript", "@Component({", ("component", "Component")), "nuxt": ("typescript", "export default defineEventHandler(x)", ("route", "defineEventHandler")),
    "spring": ("java", '@GetMapping("/users")', ("route", "/users")), "jpa": ("java", "@Entity", ("entity", "Entity")), "aspnet": ("csharp", '[HttpGet("users")]', ("route", "users")), "laravel": ("php", "Route::get('/users', 'x');", ("route", "/users")), "wordpress": ("php", "add_action('init', 'x');", ("hook", "init")),
    "phoenix": ("elixir", '  get "/users", UserController', ("route", "/users")), "flask": ("python", '@app.route("/users")', ("route", "/users")), "fastapi": ("python", '@app.get("/users")', ("route", "/users")), "rails": ("ruby", "  resources :users", ("route", "users")), "gin": ("go", 'r.GET("/users", list)', ("route", "/users")),
    "axum": ("rust", '    .route("/users", get(list))', ("route", "/users")), "drizzle": ("typescript", 'export const users = pgTable("users", {', ("table", "users")), "astro": ("astro", "const { x } = Astro.props", ("component", "props")), "blade": ("blade", "@extends('layout')", ("view", "layout")),
}


@pytest.mark.parametrize("framework", sorted(MARKS))
def test_framework_marks(framework):
    language, line, (role, what) = MARKS[framework]
    found = E.framework_marks("r", "p", f"\n{line}\n", language)
    assert (framework, role, 2, what) in found and E.framework_marks("r", "p", "nothing here", language) == []


def test_component_files_and_packs(spark, rows):
    vue = "<template>\n<p/>\n</template>\n<script lang=\"ts\">\nexport function setup() {\n}\n</script>\n<style>\n.box {}\n</style>\n"
    astro = "---\nconst title = 1\n---\n<h1/>\n"
    d = spark.createDataFrame([("r", "a.vue", "vue", vue), ("r", "b.astro", "astro", astro), ("r", "c.js", "javascript", "app.get('/x', y)"), ("r", "d.js", "javascript", None)], "repo_id string, path string, language string, content string")
    s = E.extract(d).where("row = 'symbol'").select("path", "kind", "name", "line_start")
    assert rows(s) == [("a.vue", "class", "box", 9), ("a.vue", "function", "setup", 5), ("b.astro", "variable", "title", 2)]
    assert rows(E.framework_packs(E.frameworks(d))) == [("r", "express", 1, 1)]
