import pathlib
import re

import pytest

from epochal.llm import licenses, queries
from tests import oracle


def test_variants(spark, none):
    mit = licenses.KNOWN["MIT"]
    texts = [
        "MIT License\n" + mit, mit, "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper(), mit.replace("\n\n", " ** "), mit.replace("sublicense", "sublicence"), mit.replace("COPYRIGHT HOLDERS", "copyright owners"),
        mit + " but not on Sundays", mit.replace("above copyright", "above\ncopyright"), "(c) 1999-2020 A\n© B\nCopyright <year> C\n" + licenses.KNOWN["BSD-3-Clause"], licenses.NOTICES["MIT notice"], None, "", licenses.KNOWN["ISC"],
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {r.doc_id: r.license for r in licenses.scanned(docs, licenses.known(spark)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: "MIT", 6: None, 7: "MIT", 8: "BSD-3-Clause", 9: "MIT notice", 10: None, 11: None, 12: "ISC"}
    assert licenses.scanned(none, licenses.known(spark)).count() == 0


def test_known_forms_differ(spark):
    """But for titles that differ in punctuation only."""
    names = licenses.known(spark).groupBy("license").count().collect()
    assert {r.license for r in names} == set(licenses.KNOWN | licenses.NOTICES | licenses.DIGESTS)
    assert licenses.known(spark).count() >= len({t for _, t in licenses.catalogue()}) - 5


def test_equals_sql(spark):
    names = queries.oracle_sql()
    con = oracle.connect()
    df = queries.QUERIES["op9_licenses"](spark, oracle.DATA)
    ours = sorted(map(tuple, df.select("doc_id", "digest", "license").collect()), key=repr)
    theirs = sorted(con.execute(f"SELECT doc_id, digest, license FROM ({names['op9_licenses']})").fetchall(), key=repr)
    assert ours == theirs


PLANTED = [
    ("MIT License\n\nCopyright (c) 2018 A. Person\n\n{MIT}", "MIT"), ("Copyright (c) 2020 X. {MIT}", "MIT"), ("Copyright 2020 X, all rights reserved. {ISC}", "ISC"), ("BSD 3-Clause License\n\nCopyright (c) 2001, Y\nAll rights reserved.\n\n{BSD-3-Clause}", "BSD-3-Clause"),
    ("The BSD 3-Clause License\n\nCopyright (c) 2001 Y and Sons,\n  Inc. and\n  its contributors\n\n{BSD-3-Clause}", "BSD-3-Clause"), ("Copyright (c) 2001 by Y, Z\nand others.  All rights reserved.\n{BSD-2-Clause}", "BSD-2-Clause"),
    ("The Unlicense\n\n{Unlicense}", "Unlicense"), ("zlib License\n\n(C) 1995-2024 Z\n\n{Zlib}", "Zlib"), ("{MIT}\n{MIT}", None), ("Apache License {MIT}", None), ("Copyright (c) 2020 X", None),
]


def test_planted_in_a_table(spark, small):
    """Each twice, among all documents, with a very long one; in Spark and in SQL alike."""
    from pyspark.sql import functions as F

    planted = [(10**9 + 2 * i + j, t.format(**licenses.KNOWN)) for i, (t, _) in enumerate(PLANTED) for j in range(2)]
    planted.append((10**9 + 100, (licenses.KNOWN["MIT"] + "\n") * 2000))
    docs = small.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string")).withColumn("digest", F.lit("x"))
    got = {r.doc_id: (r.digest, r.license) for r in licenses.scanned(docs, licenses.known(spark)).collect()}
    assert len(got) == docs.count() and all(got[10**9 + 2 * i + j][1] == name for i, (_, name) in enumerate(PLANTED) for j in range(2))
    assert sum(name is not None for _, name in got.values()) == 2 * sum(name is not None for _, name in PLANTED)
    con = oracle.connect()
    con.register("documents", docs.drop("digest").toPandas())
    assert {i: (d, name) for i, d, name in con.execute(f"SELECT doc_id, digest, license FROM ({licenses.op9_sql()})").fetchall()} == got


def test_licenses_from_files(spark, tmp_path):
    (tmp_path / "My Own-1.0.txt").write_text("Do as you like.\nCopyright 2020 Me\n")
    docs = spark.createDataFrame([(1, "DO as you like!"), (2, licenses.KNOWN["ISC"])], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scanned(docs, licenses.known(spark, str(tmp_path))).collect()} == {1: "My Own-1.0", 2: "ISC"}


def test_owners_and_marks(spark):
    bsd = licenses.KNOWN["BSD-3-Clause"]
    named = bsd.replace("the name of the copyright holder", "the name of Example Labs, Inc.").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "EXAMPLE LABS").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "EXAMPLE LABS")
    starred = named.replace("1. ", "* ").replace("2. ", "- ").replace("3. ", "(c) ").replace("\n\n", "\r\n")
    texts = [named, starred, named.replace("\n\n", " "), named.replace("may be used to endorse", "may not be used to endorse"), named.replace("2. ", "Also, "), bsd.replace("1. Red", "12 Red")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scanned(docs, licenses.known(spark)).collect()}
    assert got == {0: "BSD-3-Clause", 1: "BSD-3-Clause", 2: "BSD-3-Clause", 3: None, 4: None, 5: None}


FOLDER = pathlib.Path("/usr/share/common-licenses")


@pytest.mark.skipif(not FOLDER.exists(), reason="no folder of licences")
def test_long_licenses(spark):
    """Each file as it is, in capitals with other line ends and indents, and with a sentence more; in Spark and in SQL alike."""
    texts = [f.read_text() for f in sorted(FOLDER.iterdir())]
    changed = [(t, t.upper().replace("\n", "\r\n   "), t + "\nExcept on Sundays.") for t in texts]
    docs = spark.createDataFrame([(3 * i + k, t) for i, ts in enumerate(changed) for k, t in enumerate(ts)], "doc_id long, text string")
    got = {r.doc_id: (r.digest, r.license) for r in licenses.scanned(docs, licenses.known(spark)).collect()}
    assert len(texts) > 10
    for i in range(len(texts)):
        assert got[3 * i][1] and got[3 * i] == got[3 * i + 1] and got[3 * i + 2][1] is None
    kept = {r.doc_id: r.c for r in docs.select("doc_id", licenses.canonical(docs.text).alias("c")).collect()}
    assert all(len(kept[3 * i].split()) > 0.9 * len(re.findall(r"\w+", t)) for i, t in enumerate(texts))
    con = oracle.connect()
    con.register("documents", docs.toPandas())
    assert {i: (d, name) for i, d, name in con.execute(f"SELECT doc_id, digest, license FROM ({licenses.op9_sql()})").fetchall()} == got
