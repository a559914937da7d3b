import pytest

from lexloom.llm import authored as a

HAND = "import os\n\n\ndef area(width, height):\n    # both in metres\n    return width * height\n\n\nprint(area(2, 3))\n"


@pytest.mark.parametrize(
    ("path", "text", "kind"),
    [
        ("a.py", "# Code generated by toolx v1.2. DO NOT EDIT.\n" + HAND, "generated"),
        ("a.py", HAND + "# Code generated by toolx v1.2. DO NOT EDIT.\n", "generated"),
        (None, "/* Diese Datei wurde von x automatisch erzeugt. Nicht von Hand ändern! */\r\nint a;\r\n", "generated"),
        ("a.c", "// This file was automatically generated by x from y.idl;\n// changes will be lost.\nint a;\n", "generated"),
        ("a.py", 'banner = "Code generated by the tool. DO NOT EDIT."\n' + HAND, None),
        ("a.py", '# writes the "DO NOT EDIT" banner into each output file\n' + HAND, None),
        ("a.py", "# ids are generated by the server\n" + HAND, None),
        ("generators/a.py", HAND, None),
        ("vendors/a.py", "# third-party vendors are billed monthly\n" + HAND, None),
        ("package-lock.json", '{\n "lockfileVersion": 3\n}', "generated"),
        ("node_modules/x/lib/x.py", HAND, "vendored"),
        ("src/x.py", "# Imported from the x source tree (tag v3.0.1)\n" + HAND, "vendored"),
        ("src/x.py", "# This file is part of the x toolkit, under the X Licence, version 2.0\n" + HAND, None),
        ("src/x.js", "!function(e,t){if(a>1)return b;for(var i=0;i<9;i++)c[i]=d;x.y=function(z){return z(w,1)}};" * 10, "minified"),
        ("src/x.min.js", HAND, None),
        ("data/x.py", "id,name,score\n" + "\n".join(f"{k},Name{k},{k}.5" for k in range(40)), "data"),
        ("res/x.h", "const unsigned char x[] = {\n" + "  0x0c, 0x7c, 0x26, 0x9e,\n" * 20 + "};\n", "data"),
        ("fonts/x.js", "module.exports = '" + "aB3+" * 300 + "';", "data"),
        ("config/x.env", "\n".join(f"KEY_{k}=value{k}" for k in range(40)), None),
        ("gen/x.py", None, None), ("gen/x.py", "", None), ("gen/x.py", " \n", None), (None, HAND, None),
    ],
)
def test_kinds(path, text, kind):
    assert a.file_kind(path, text) == kind


@pytest.mark.parametrize(
    "notice",
    [
        "// AUTO-GENERATED FILE. DO NOT MODIFY.", "/* DO NOT EDIT THIS FILE - it is machine generated */", "# Generated by Toolx 4.2 on 2023-01-01 12:00", "/* Automatically generated by Toolx */", "// This code was generated by a tool.", "// <auto-generated/>",
        "// Fichier généré automatiquement par X, ne pas modifier", "# WARNING! All changes made in this file will be lost!", "// Este código fue generado por una herramienta. No modificar.", "# Automatically created by X; manual edits are lost",
    ],
)
def test_generation_notices(notice):
    assert a.file_kind("a.py", notice + "\n" + HAND) == "generated"


@pytest.mark.parametrize(
    "comment",
    [
        "# utility to generate reports", "# the token is generated by auth", "# Script that writes auto-generated headers", "# Copyright 2020 Example Corp, licensed under Apache 2.0", "# requires library version 2.3.1 or newer", "# see release notes 1.2.3 for changes",
        "# This module was created by the data team in 2019", "# tested with release 2.4.1 of the server", "// do not edit the config by hand, use the UI",
    ],
)
def test_comments_of_people(comment):
    assert a.file_kind("a.py", comment + "\n" + HAND) is None


@pytest.mark.parametrize("notice", ["/*! lodashx 4.17.21 | MIT */", "// underx 1.13.6 - https://underx.example - distributed under MIT", "# vendored copy of six 1.16.0"])
def test_release_notices(notice):
    assert a.file_kind("a.js", notice + "\n" + HAND) == "vendored"


LICENCE = [f"Line {k} of the terms, with all rights and duties." for k in range(40)]
CODE = "".join(f"area_{k} = width * height\n" for k in range(40))


@pytest.mark.parametrize("lead", ["", "<?php\n", "#!/bin/sh\n"])
@pytest.mark.parametrize(("first", "each", "last"), [("", "# ", ""), ("/*\n", " * ", " */\n"), ("/*\n", "", "*/\n"), ("<!--\n", "", "-->\n")])
@pytest.mark.parametrize(("notice", "kind"), [("Code generated by toolx v1.2. DO NOT EDIT.", "generated"), ("Imported from the x source tree (tag v3.0.1)", "vendored"), ("ids are generated by the server", None)])
def test_notices_in_long_comments(lead, first, each, last, notice, kind):
    said = lambda ls: first + "".join(each + x + "\n" for x in ls) + last
    assert a.file_kind("a.x", lead + said([*LICENCE, notice]) + CODE) == kind
    assert a.file_kind("a.x", lead + CODE + said([notice, *LICENCE])) == kind
    assert a.file_kind("a.x", lead + CODE + said([notice]) + CODE) is None


def test_mark_and_line_ends_do_not_matter():
    text = "# @generated by x\n" + HAND
    assert a.file_kind("a.py", "﻿" + text.replace("\n", "\r\n")) == "generated"


def test_judge_gives_one_row_per_file(spark):
    rows = [(1, "a.py", HAND, "u"), (2, "yarn.lock", "x", "u"), (2, "yarn.lock", "x", "u"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "file_id long, path string, content string, kind string")
    assert {tuple(r) for r in a.judge(df).collect()} == {(1, None, None), (2, "generated", "lockfile"), (3, None, None)}
    assert a.judge(df.limit(0)).count() == 0


PINNED = '{\n  "lockfileVersion": 1,\n  "a": {\n    "integrity": "abc",\n    "resolved": "d"\n  }\n}\n'


@pytest.mark.parametrize(
    ("path", "text", "rule"),
    [
        ("src/write.lock", HAND, None), ("db/row-lock.json", '{"table": "row", "lock": true}', None), ("deps.lock.json", PINNED, "lockfile"), ("x/Cargo.lock", "x", "lockfile"), ("a.lock", PINNED, "lockfile"),
        ("api-1.0/handlers.py", HAND, None), ("externals/a.py", HAND, None), ("vendor/x/a.py", HAND, None), ("third_party/a.py", "# Copyright 2011 The x authors\n" + HAND, "path and origin"),
        ("lib-1.2.3/a.py", "# under the X Licence, see https://x.example/licence v1.2\n" + HAND, "path and origin"), ("node_modules/x/a.py", HAND, "path"),
        ("a.py", "\n".join(f"# line {k} of a licence" for k in range(24)) + "\n# Code generated by toolx. DO NOT EDIT.\n" + HAND, "notice"),
    ],
)
def test_rules(path, text, rule):
    assert a.file_rule(path, text)[1] == rule
