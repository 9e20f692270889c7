import re
import textwrap
from pathlib import Path

import duckdb
import pytest

from chronofid.llm import license_texts, licenses

#: Whole texts that some systems ship; the digests of these are known.
SHIPPED = Path("/usr/share/common-licenses")


SHIPPED_AS = {
    "Apache-2.0": "Apache-2.0", "Artistic-1.0": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2",
    "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.license_scan(docs).collect()}


MIT, ISC = (next(bodies[0] for name, _, bodies in license_texts.LICENSES if name == n) for n in ("MIT", "ISC"))


def test_whole_licences_in_other_dress(spark):
    dressed = "Copyright (c) 2019 Some One\n" + MIT.upper().replace("\n", "\n\n  ").replace(",", " ;").replace("LICENSE", "LICENCE")
    got = scan(spark, [MIT, dressed, MIT + " and more", ISC.replace(".", ""), MIT.replace("COPYRIGHT HOLDERS", "copyright owners")])
    assert [got[i].license_id for i in range(5)] == ["MIT", "MIT", None, "ISC", "MIT"]
    assert got[0].digest == got[1].digest == got[4].digest != got[2].digest


def test_titles_and_copyright_lines(spark):
    opened = ["Copyright (c) Jane Doe 2020", "© 2020 Jane", "Copyright (C) <holder>", "(c) 1999-2003 X", "Copyright Jane Doe", "copyright 2020, jane", "COPYRIGHT 2020 JANE", " * Copyright: Jane", "Copyright [yyyy] [name]", "Copyright by Jane"]
    texts = [f"{title}\n\n{line}\n\n{MIT}" for line in opened for title in ("", "The MIT License (MIT)")]
    got = scan(spark, texts)
    assert [got[i].license_id for i in range(len(texts))] == ["MIT"] * len(texts)
    others = [f"{word} of it\n{MIT}" for word in ("copyright notice", "copyright holders", "Copyright License", '"Copyright" also means')]
    got = scan(spark, others)
    assert [got[i].license_id for i in range(len(others))] == [None] * len(others)


def test_every_licence_wrapped_and_indented(spark):
    texts, want = [], []
    for name, titles, bodies in license_texts.LICENSES:
        for title in ("", *titles):
            for body in bodies:
                wrapped = "\n\n".join(textwrap.fill(p, 68, initial_indent="   ", subsequent_indent="   ") for p in body.split("\n\n"))
                texts.append(f"{title}\n\nCopyright (c) 2001, 2004 The Holders <a@b.c>\nAll rights reserved.\n\n{wrapped}\n")
                want.append(name)
    got = scan(spark, texts)
    assert [got[i].license_id for i in range(len(texts))] == want


def test_headers_of_several_lines(spark):
    header = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    apache = '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.'
    swapped = "\n".join(header.split("\n")[::-1])
    got = scan(spark, [f"import x\n#\n{header}\n\ncode {i}" for i in range(2)] + [apache, swapped, header.replace("3", "2"), header.replace("any later version", "x"), f"{header}\n{header}\n{apache}"])
    assert [(got[i].n_notices, got[i].notices) for i in range(7)] == [
        (1, "GPL-3.0"), (1, "GPL-3.0"), (1, "Apache-2.0"), (0, ""), (1, "GPL-2.0"), (0, ""), (3, "Apache-2.0,GPL-3.0")
    ]


def test_a_licence_inside_a_text(spark):
    got = scan(spark, [f"About\nMIT License\n\nCopyright 2020 X\n\n{MIT}\n\nmore", f"MIT License\n{MIT.split(chr(10))[0]}\nmore"])
    assert (got[0].license_id, got[0].n_notices, got[0].notices) == (None, 1, "MIT") and got[1].n_notices == 0


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    docs = spark.createDataFrame([(1, "a\nAll rights reserved."), (1, "a All\nrights reserved."), (1, "a All\nrights reserved."), (None, None)], "doc_id long, text string")
    assert sorted(r.n_notices for r in licenses.license_scan(docs).collect()) == [0, 0, 0, 1]


def test_digests_of_long_licences(spark):
    known = dict(license_texts.DIGESTS)
    assert len(known) == len(license_texts.DIGESTS) >= 10 and all(re.fullmatch("[0-9a-f]{64}", d) for d in known.values())
    texts = {n: (SHIPPED / f).read_text(errors="replace") for n, f in SHIPPED_AS.items() if (SHIPPED / f).exists()}
    got = scan(spark, [*texts.values(), *("\n".join(x.strip() for x in t.split("\n")) for t in texts.values())])
    assert [got[i].license_id for i in range(2 * len(texts))] == list(texts) * 2


def test_sql_on_texts_of_all_kinds(spark):
    texts = [t for _, t in license_texts.KNOWN[::9]] + ["x\r\nCopyright Jane\r\n© y\nz", "\u2028Copyright 2020\u2028All rights reserved.", None, "", "\n\n", "a\nAll rights reserved.\n\nMIT License\n" + MIT]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(licenses.oracle_sql()).fetchall()
    got = [tuple(r[c] for c in ("doc_id", "digest", "license_id", "n_notices", "notices")) for r in licenses.license_scan(docs).collect()]
    assert sorted(got) == sorted(want)


def test_notices_on_lines(spark):
    got = scan(spark, ["some text\n  Released under the MIT LICENCE!\nmore\nAll rights reserved", "we say: all rights reserved to us", "All rights reserved.", None, "", "?!"])
    assert (got[0].n_notices, got[0].notices, got[0].license_id) == (2, "MIT,all-rights-reserved", None)
    assert got[1].n_notices == 0 and got[2].license_id == "all-rights-reserved" and got[2].n_notices == 1
    assert all(got[i].license_id is None and got[i].n_notices == 0 for i in (3, 4, 5))


def test_known_texts_are_a_parameter(spark):
    known = spark.createDataFrame([("b", "House rules"), ("a", "house RULES."), ("c", None), ("d", "--")], "license_id string, text string")
    docs = spark.createDataFrame([(1, "House, rules!"), (1, "House, rules!"), (2, "rules")], "doc_id long, text string")
    got = sorted((r.doc_id, r.license_id, r.n_notices) for r in licenses.license_scan(docs, known).collect() if r.license_id)
    assert got == [(1, "a", 1), (1, "a", 1)]


def test_messy_and_empty(messy, messy_rows, nothing):
    assert licenses.license_scan(messy).count() == len(messy_rows)
    assert licenses.license_scan(nothing[0]).count() == 0
