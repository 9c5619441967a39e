import re
import textwrap
from collections import Counter

from shiftscope.llm import license_scan as ls


def names(text):
    return [x[0] for x in ls.licences(ls.sentences(text))]


def whole(*ids, version="2.0", glue="\n"):
    return glue.join(ls.SENTENCES[i].replace("{n}", version) for i in ids)


def test_rules():
    assert names("") == []
    assert names("some text\nLicensed under CC BY-NC 4.0.\nmore. Released under the MIT License. x") == ["CC-BY-NC-4.0", "MIT"]
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3"]
    assert names("licensed   under the APACHE license version 2.0.") == ["Apache-2.0"]
    mit = whole("mit-grant", "mit-notice", "mit-warranty", "mit-liability")
    assert names("Copyright (c) 2020 Some One\n\n" + "\n".join(textwrap.wrap(mit.replace("\n", " "), 79))) == ["MIT"]
    bsd = whole("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty")
    assert names(bsd) == ["BSD-3-Clause"]
    assert names(whole("bsd-grant") + "\n1. " + whole("bsd-source") + "\n2. " + whole("bsd-binary") + "\n" + whole("bsd-warranty")) == ["BSD-2-Clause"]
    assert names(whole("bsd-source", "bsd-grant", "bsd-binary")) == []  # the order counts
    assert names(whole("apache-grant", "apache-comply", "apache-copy", "apache-basis", "apache-see")) == ["Apache-2.0"]
    assert names("He was licensed under CC BY-NC 4.0.") == []


def test_every_sentence_is_found_and_triggered():
    for name, text in ls.SENTENCES.items():
        text = text.replace("{n}", "2.0")
        assert [s[2] for s in ls.sentences("Intro here.\n" + text + "\nand after")] == [name], name
        assert any(t in text.lower() for t in ls.TRIGGERS), name


def test_triggers_are_single_words():
    assert all(len(t.split()) == 1 for t in ls.TRIGGERS)


def test_white_space_and_many_lines(spark):
    texts = ["All rights\nreserved.", "All rights  reserved.", "All rights\treserved.", "All rights\u00a0reserved.", "all\n\nrights\r\nreserved."]
    grant = "\n\n".join(textwrap.wrap(whole("mit-grant"), 50))
    assert grant.count("\n") + 1 > 16
    docs = spark.createDataFrame([*enumerate(texts), (9, grant)], "doc_id long, text string")
    want = {i: ["all-rights-reserved"] for i in range(len(texts))} | {9: ["MIT"]}
    assert {r.doc_id: r.licenses for r in ls.scan(docs).collect()} == want
    assert names(whole("mit-grant").replace(" ", "\n\n\n")) == ["MIT"]
    assert names("\n" * 200_000 + "All rights reserved." + "\n" * 200_000) == ["all-rights-reserved"]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    line = {r"Licensed under CC BY-NC ([\d.]+)\.": "CC-BY-NC-", r"This work is licensed under the GNU General Public License, version ([\d.]+)\.": "GPL-", r"Licensed under the Apache License, Version ([\d.]+)\.": "Apache-", r"Released under the MIT License(())\.": "MIT", r"All rights reserved(())\.": "all-rights-reserved"}
    want = {r.doc_id: sorted({name + m[1] for x, name in line.items() for m in re.finditer(rf"(?m)^{x}$", r.text)}) for r in docs.collect()}
    got = {r.doc_id: list(r.licenses) for r in ls.scan(docs).collect()}
    assert got == want
    assert Counter(n for v in got.values() for n in v)["MIT"] > 3


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "All rights reserved.", 2), (None, "", 3)], "doc_id long, text string, licenses int")
    assert sorted((r.doc_id or 0, r.licenses) for r in ls.scan(docs).collect()) == [(0, []), (1, []), (1, ["all-rights-reserved"])]
    assert ls.scan(docs.limit(0)).count() == 0
