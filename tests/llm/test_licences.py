import duckdb
from pyspark.sql import functions as F

from leadflow.llm import licences as li

from .conftest import CLASHING

MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."


def files(llm, rows):
    return llm.createDataFrame(rows, "path string, text string").withColumns({k: F.lit(v) for k, v in CLASHING.items() if k != "text"})


def found(llm, rows):
    return {r["path"]: (r["licence"], r["origin"], r["inherited_from"]) for r in li.licences(files(llm, rows)).collect()}


PROSE = " ".join(f"word{i}" for i in range(200))


def test_headers_files_and_the_nearest_directory(llm):
    rows = [("a/LICENSE", f"Copyright (c) 2020 A. Person\n{MIT}\n{PROSE}"), ("a/x.txt", PROSE), ("a/b/y.txt", PROSE), ("a/b/c/own.txt", f"# {APACHE}\n{PROSE}"), ("a/b/c/z.txt", PROSE), ("a/b/d/short.txt", APACHE),
            ("a/b/d/w.txt", PROSE), ("a/b/d/e/f/deep.txt", PROSE), ("top.txt", PROSE), ("ab/no.txt", PROSE), ("other/x.txt", "A licence to print money, they said, and left.")]
    out = found(llm, rows)
    assert out["a/LICENSE"] == ("MIT", "file", None) and out["a/x.txt"] == ("MIT", "inherited", "a") and out["a/b/y.txt"] == ("MIT", "inherited", "a")
    assert out["a/b/c/own.txt"] == ("Apache-2.0", "header", None) and out["a/b/c/z.txt"] == ("MIT", "inherited", "a")
    assert out["a/b/d/short.txt"] == ("Apache-2.0", "file", None) and out["a/b/d/w.txt"] == ("Apache-2.0", "inherited", "a/b/d") and out["a/b/d/e/f/deep.txt"] == ("Apache-2.0", "inherited", "a/b/d")
    assert out["top.txt"] == out["ab/no.txt"] == out["other/x.txt"] == (None, None, None)


def test_a_licence_at_the_root_reaches_all(llm):
    out = found(llm, [("LICENSE", MIT), ("x.txt", PROSE), ("a/b/y.txt", PROSE)])
    assert out == {"LICENSE": ("MIT", "file", None), "x.txt": ("MIT", "inherited", ""), "a/b/y.txt": ("MIT", "inherited", "")}


def test_nulls_repeats_ties_and_long_texts(llm):
    long = (PROSE + "\n") * 3000 + APACHE
    rows = [(None, MIT), ("n/null.txt", None), ("n/empty.txt", ""), ("n/long.txt", long), ("t/x.txt", f"{MIT}\n{APACHE}\n{PROSE}"), ("t/x.txt", f"{MIT}\n{APACHE}\n{PROSE}"), ("t/b.txt", MIT), ("t/a.txt", APACHE), ("t/plain.txt", "")]
    out = found(llm, rows)
    assert out["n/null.txt"] == out["n/empty.txt"] == (None, None, None) and out["n/long.txt"][:2] == ("Apache-2.0", "header")
    assert out["t/x.txt"][0] == "Apache-2.0" and out["t/plain.txt"] == ("Apache-2.0", "inherited", "t") and len(out) == 7


def test_every_template_finds_itself_and_has_an_anchor(llm):
    rows = [(f"{name}/f.txt", f"{PROSE}\n{notice}\n{PROSE}") for name, notice in li.TEMPLATES]
    assert {p.split("/")[0]: licence for p, (licence, _, _) in found(llm, rows).items()} == {name: name for name, _ in li.TEMPLATES}


def test_real_headers_titles_and_bodies(llm):
    gpl = ["This file is part of Foo.", "", "Foo is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or",
           "(at your option) any later version.", "", "You should have received a copy of the GNU General Public License", "along with Foo.  If not, see <https://www.gnu.org/licenses/>."]
    mit = "\n".join(["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal", "in the Software without restriction, including without limitation the rights",
                     "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell", "copies of the Software, and to permit persons to whom the Software is", "furnished to do so, subject to the following conditions:"])
    bsd = li._BSD[0].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ")
    held = "Copyright (c) 2019, A. Person. All rights reserved."
    rows = {"GPL-3.0": "\n".join(f" * {x}" for x in gpl) + "\nint main() {}\n" + PROSE, "MIT": f"x = 1\n\nCopyright (c) 2020 A. Person\n\n{mit}\n\n{PROSE}", "ISC": "\n".join(["// " + x for x in (held, *li._ISC.split(", "))]) + "\n" + PROSE,
            "Apache-2.0": f"{PROSE} More text here. Licensed under the Apache License, Version 2.0. And more.", "AGPL-3.0": "# SPDX-License-Identifier: AGPL-3.0-or-later\n" + PROSE, "LGPL-2.1": "  GNU LESSER GENERAL PUBLIC LICENSE\n     Version 2.1, February 1999\n\n" + PROSE,
            "Proprietary": held + "\n" + PROSE, None: "// SPDX-License-Identifier: Zlib\n" + PROSE}
    out = found(llm, [(f"{name}/x.txt", text) for name, text in rows.items()] + [("b2/LICENSE", f"{held}\n\n{bsd}\n\n{li._BSD[2]}"), ("b3/LICENSE", f"{held}\n\n{bsd}\n\n{li._BSD[1]}\n\n{li._BSD[2]}")])
    assert {name: out[f"{name}/x.txt"][0] for name in rows} == {name: name for name in rows}
    assert out["b2/LICENSE"][:2] == ("BSD-2-Clause", "file") and out["b3/LICENSE"][:2] == ("BSD-3-Clause", "file")


def test_empty_table(llm):
    assert found(llm, []) == {}


def test_sql_twin(llm):
    rows = [(f"s{i % 3}/{'d/' * (i % 3)}{i}.txt", f"{MIT if i % 4 == 0 else APACHE if i % 9 == 0 else 'no license to speak of here'}\n{PROSE if i % 5 else ''}") for i in range(60)]
    con = duckdb.connect()
    con.execute("create table f (path varchar, text varchar)")
    con.executemany("insert into f values (?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute(f"select path, licence, origin, score, inherited_from from ({li.sql_twin('SELECT path, text FROM f')})").fetchall()}
    got = {r["path"]: (r["licence"], r["origin"], r["score"], r["inherited_from"]) for r in li.licences(files(llm, rows)).collect()}
    assert got == want


def test_main_path_is_native(llm):
    plan = li.licences(files(llm, [("a/b.txt", MIT)]))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
