import hashlib

from agora.llm.licence_texts import KNOWN_TEXTS
from agora.llm.licences import canonical, known_digests, scan_licences
from tests.llm.cases import SCHEMA, awkward, clashing, documents, prose

MIT = next(t for n, t in KNOWN_TEXTS if n == "MIT")


def test_canonical_forms_agree():
    shouted = "Copyright (c) 2020 Someone\n\n" + MIT.upper().replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace(",", " ;")
    commented = "\n".join("# " + x for x in ("© A. Author\n" + MIT + "\nAll rights reserved.").replace("sublicense", "sub-licence").split("\n"))
    assert canonical(MIT) == canonical(shouted) == canonical(commented)
    assert canonical(MIT) != canonical(MIT.replace("free of charge", "for a charge"))
    assert canonical("Licence licence licence") == "license license license"


def test_scan(spark):
    rows = awkward() + [
        (900, "Copyright 1999 X\n" + MIT.upper(), "en", "s", 1),
        (901, prose(1, 30) + "\n  * RELEASED under the mit licence!\n" + prose(2, 30) + "\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "en", "s", 1),
        (902, "Copyright 1999 X\n(c) Y", "en", "s", 1),
        (903, prose(3, 10) + " Released under the MIT License.", "en", "s", 1),  # not a whole line
        (904, (MIT + "\n") * 400, "en", "s", 1),
    ]
    got = scan_licences(clashing(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[900].text_licence == "MIT" and by[900].notice_lines == 0
    assert by[901].text_licence is None and (by[901].notice_lines, by[901].notices) == (3, "CC-BY-NC-4.0,MIT")
    assert by[902].text_digest is None and by[9].text_digest is None and by[10].text_digest is None and by[11].text_digest is None
    assert by[903].notice_lines == 0 and by[904].text_licence is None
    assert by[1].text_digest == by[2].text_digest == by[3].text_digest == hashlib.sha256(canonical(rows[0][1]).encode()).hexdigest()


def test_join_beyond_the_bound(spark, monkeypatch):
    from agora.llm import licences

    docs = documents(spark)
    near = sorted(map(tuple, scan_licences(docs).collect()), key=str)
    monkeypatch.setattr(licences, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, scan_licences(docs).collect()), key=str) == near


def test_own_table_and_ties(spark):
    known = known_digests(spark, [("A", "some text"), ("B", "Some  TEXT."), ("C", "")])
    got = scan_licences(documents(spark, [(1, "some text", "en", "s", 1)]), known).first()
    assert got.text_licence == "A,B" and got.notices == "A,B"
    assert scan_licences(spark.createDataFrame([], SCHEMA), known).count() == 0


def test_digests_of_long_texts(spark):
    import os

    import pytest

    from agora.llm.licence_texts import KNOWN_DIGESTS

    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts on this machine")
    files = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(i, "# " + open(f"{folder}/{f}").read().upper().replace("\n", "\n# "), "en", "s", 1) for i, f in enumerate(files) if os.path.exists(f"{folder}/{f}")]
    got = {r.doc_id: r.text_licence for r in scan_licences(documents(spark, rows)).collect()}
    assert got == {i: name for i, (f, name) in enumerate(files.items())} and set(files.values()) <= set(KNOWN_DIGESTS)
