import pytest
from pyspark.sql import functions as F

from codeloom.llm import handwritten as H

CODE = "import x\n\nfunc run(a int) error {\n\tif a > 1 {\n\t\treturn stop(a)\n\t}\n\treturn nil\n}\n"


@pytest.mark.parametrize(
    ("comment", "repo", "verdict"),
    [
        ("// Code generated by tool v1. DO NOT EDIT.", "r", "generated"), ("# This file was produced automatically by gen; manual changes will be lost.", "r", "generated"), ("// <auto-generated> tool </auto-generated>", "r", "generated"),
        ("// Ids are generated by the server; callers do not edit them.", "r", ""), ("// Generates invoice numbers. Edit the prefix in settings.", "r", ""), ("// Reads the auto generated report and groups its lines.", "r", ""),
        ("// Copyright harbor team. All rights reserved.", "harbor", ""), ("// Copyright (c) other contributors. SPDX-License-Identifier: MIT", "harbor", "third_party"), ("// Part of zap 1.2.3, distributed under the ISC licence.", "harbor", "third_party"),
        ("/* ! kob 6.1.2 - kob.example - MPL-2.0 */", "harbor", "third_party"), ("// Copyright (c) harbor contributors. SPDX-License-Identifier: MIT", "harbor", ""), ("", "r", ""), ("// Talks to each vendor over the partner gateway.", "r", ""),
    ],
)
def test_headers(comment, repo, verdict):
    assert H.header_verdict(comment, repo) == verdict


@pytest.mark.parametrize(
    ("comment", "wrote"),
    [
        ("// Generated by the protocol buffer compiler.  DO NOT EDIT!", True), ("# -*- coding: utf-8 -*-\n# Generated by Django 4.2 on 2024-01-01 10:00", True), ("/* A Bison parser, made by hand */", False), ("/* This file is automatically generated by sqlc. */", True),
        ("// Code compiled from grammar.peg", True), ("# Please do not modify this file by hand", True), ("// Never edit this header", True), ("// Your changes will be overwritten on the next run", True), ("# To regenerate, run make stubs", True), ("// regenerate with tools/gen.sh", True),
        ("// Edit the schema instead", True), ("// Auto-generated", True), ("// machine generated header", True), ("// Renders pages generated by the editor", False), ("// Users do not change their names", False), ("// Run the tests to see changes", False), ("// Written by Jane Doe, 2021", False), ("// Created automatically from a.idl", True), ("// Edits are kept, changes can be undone", False),
    ],
)
def test_comments_of_tools_never_seen(comment, wrote):
    """Headers of generators that the test tables do not have, and comments about what the code makes."""
    assert H.tool_wrote("\n".join(x.strip("/*# ") for x in comment.splitlines())) == wrote


def test_canonical_text():
    x = H.layout("if (a) { b( 1,\n 2 ); c() }\n\n\nd = {x: 1}\n")
    assert x.canonical == ["if ( a ) {", "  b ( 1 , 2 ) ;", "c ( ) }", "d = {", "x : 1 }"] and x.lines == 3
    assert H.layout("a;b;c").canonical == ["a ;", "b ;", "c"] and H.layout("for(i=0;i<3;i++)e()").canonical == ["for ( i = 0 ; i < 3 ; i + + ) e ( )"]
    assert H.layout("// x\n").canonical == ["// x"] and H.layout("\n\n").lines == 0


def test_layouts():
    x = H.layout("// top\n" + CODE)
    assert x.expansion < 3 and x.literal < 0.3 and x.uniform < 0.6 and x.comments == "// top" and not x.verdict()
    x = H.layout("!function(e,t){" + "function a(x){return x.y||1}var b=c[2];" * 14)
    assert x.expansion > H.EXPANSION and x.verdict() == "minified"
    assert H.layout('BLOB = "' + "QUJD+/" * 90).verdict() == "data" and H.layout("static t = {" + "0xfb, 0x7c, " * 50).verdict() == "data"
    uniform = "".join(f'public aField{i:04d} = wire.slot({i}, "a_{i:04d}", 8);\n' for i in range(9))
    assert H.layout(uniform).uniform > H.UNIFORM and H.layout(uniform).verdict() == "generated"
    x = H.layout("")
    assert (x.expansion, x.literal, x.uniform, x.alike, x.verdict()) == (0, 0, 0, 0, "")
    rows = "".join(f"{i * 917};{i}.77;12{i}.9;lata\n" for i in range(9))
    assert H.layout(rows).literal > H.LITERAL > H.layout('import "a/long/path/of/a/module"\n' * 9).literal


def test_verdicts(spark):
    mini = "!function(e,t){" + "function a(x){return x.y||1}var b=c[2];" * 14
    files = [
        ("r", "f1", "src\\A.go", "h1"), ("r", "f2", "lib/package-lock.json", None), ("r", "f3", "./vendor/x/a.go", "hv"), ("r2", "f4", "core/copy.go", "hv"), ("r", "f5", "web/app.js", None), ("r", "f6", "web/thirdparty_billing/a.go", None),
        ("r", "f7", "x/a.pb.go", None), ("r", "f8", None, None), ("r", None, "vendor/y.go", None), ("r", "f9", "gen/a.go", None), ("r", "f10", "vendor/old.go", None), ("r", "f10", "own/new.go", None), ("r", "f11", "a/one.js", None),
    ]
    d = spark.createDataFrame([(*f, i, 1) for i, f in enumerate(files)], "repo_id string, id string, path string, hash string, n int, verdict int").withColumn("indexed_at", F.timestamp_micros(F.col("n").cast("long")))
    s = spark.createDataFrame([("f1", 9, 30, CODE), ("f1", 9, 30, CODE), ("f5", 1, 90000, mini), ("f6", None, None, CODE), ("f9", 3, 10, ""), ("f11", 1, 60, "function a(x){return 1}var b=2;"), (None, 1, 1, mini), ("zz", 1, 1, mini)], "file_id string, n_lines long, max_line_chars long, head string")
    got = {r["file_id"]: r["verdict"] for r in H.judge_files(d, s).collect()}
    assert got == {"f1": "hand_written", "f2": "lock", "f3": "third_party", "f4": "third_party", "f5": "minified", "f6": "hand_written", "f7": "generated", "f8": "hand_written", "f9": "hand_written", "f10": "hand_written", "f11": "hand_written"}
    why = {r["file_id"]: r["ground"] for r in H.judge_files(d, s).collect()}
    assert (why["f5"], why["f3"], why["f4"], why["f1"]) == ("layout", "path", "copy", None)
    assert H.grounds(d, s).where("ground = 'path'").groupBy().sum("n_files").first()[0] == 3
    assert H.judge_files(d.where("false"), s.where("false")).count() == 0


def test_very_long_text(spark):
    d = spark.createDataFrame([("r", "f", "a.js", None)], "repo_id string, id string, path string, hash string").withColumn("indexed_at", F.current_timestamp())
    s = spark.createDataFrame([("f", 1, None, "x = [" + "12345, " * 60_000 + "]")], "file_id string, n_lines long, max_line_chars long, head string")
    assert H.judge_files(d, s).first()["verdict"] == "data"
