"""Findings against an exhaustive alignment of every template with every text."""

import random

import pytest
import zstandard
from conftest import SF_SMALL

from edge import clashing, documents, empty
from sparkqa.llm import licenses, registry
from sparkqa.llm.templates import TEMPLATES
from sparkqa.session import table

SCANNER = licenses.Scanner(TEMPLATES)


def holds(text, name):
    words = [w.lower() for w in licenses.WORD.findall(text)]
    return licenses.align(words, SCANNER.words[name], SCANNER.limit(name)) is not None


def test_query_finds_what_exhaustive_alignment_finds(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents").collect()}
    found = {}
    for r in registry.QUERIES["op1_license_scan"](spark, SF_SMALL).collect():
        assert holds(docs[r.doc_id][r.start:r.end], r.license)
        assert 0 < r.reduction < 1
        found.setdefault(r.doc_id, set()).add(r.license)
    short = [n for n in SCANNER.names if len(SCANNER.words[n]) <= 12 and n not in SCANNER.loose]  # loose: depends on what stands around
    for i, text in docs.items():
        if len(text) < 6000:
            assert {n for n in short if holds(text, n)} == {n for n in found.get(i, set()) if n in short}


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_each_template_wins_on_its_own_text(name):
    text = "Some words before.\n" + TEMPLATES[name].upper().replace(" ", "\n") + "\nand after."
    ((won, start, end, _, notes),) = SCANNER.scan(text)
    assert won == name and not notes
    assert licenses.WORD.findall(text[start:end].lower()) == SCANNER.words[name]


def test_wording_may_differ_within_the_limit():
    rng = random.Random(4)
    for name in ("MIT", "Apache-2.0", "BSD-3-Clause", "GPL-3.0"):
        words, limit = list(SCANNER.words[name]), SCANNER.limit(name)
        for changes in (limit, limit + 4):
            mine = list(words)
            for at in rng.sample(range(2, len(words) - 2), changes):
                mine[at] = "zzz" + str(at)
            found = SCANNER.scan("lead in " * 30 + " ".join(mine) + " tail" * 30)
            assert ([f[0] for f in found] == [name]) == (changes == limit)
            if changes == limit:
                assert len(found[0][4]) == limit


def test_differences_are_named():
    first, end, notes = licenses.align("x the quick red fox jumps y".split(), "the quick brown fox".split(), 2)
    assert (first, end, notes) == (1, 5, ["brown>red"])
    assert licenses.align("a b".split(), "a x b".split(), 1)[2] == ["-x"]
    assert len(licenses.align("a b c".split(), "a c".split(), 1)[2]) == 1
    assert licenses.align("a b x c d".split(), "a b c d".split(), 1)[2] == ["+x"]
    assert licenses.align([], "a b".split(), 1) is None


def test_edge_rows(spark):
    notice = TEMPLATES["MIT-notice"]
    extra = spark.createDataFrame([(1, notice), (None, notice), (1, notice), (2, (notice + "\n") * 300)], "doc_id long, text string")
    got = licenses.licenses(documents(spark).select("doc_id", "text").unionByName(extra)).collect()
    assert sorted((r.doc_id or 0, r.license) for r in got) == [(0, "MIT-notice")] + [(1, "MIT-notice")] * 2 + [(2, "MIT-notice")] * 300
    assert licenses.licenses(clashing(spark)).collect() == []
    assert licenses.licenses(empty(spark)).collect() == []
    assert [r.license for r in licenses.licenses(extra.limit(1), templates={"own": "released under"}).collect()] == ["own"]
    with pytest.raises(ValueError):
        licenses.Scanner({"none": "..."})


@pytest.mark.parametrize("text, name", [
    (TEMPLATES["GPL-3.0"].replace("version 3", "version 2"), "GPL-2.0"),
    (TEMPLATES["GPL-3.0"].replace("GNU General", "GNU Affero General"), "AGPL-3.0"),
    (TEMPLATES["GPL-3.0"].replace("version 3", "version 2").replace("GNU General", "GNU Library General"), "LGPL-2.0"),
    (TEMPLATES["LGPL-2.1"].replace("2.1", "3"), "LGPL-3.0"),
    ("GNU General Public License, version 2.", "GPL-2.0-notice"),
    ("GNU Lesser General Public License, version 2.1.", "LGPL-2.1-notice"),
    ("Creative Commons Attribution 3.0 Unported License", "CC-BY-3.0-deed"),
    ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0-deed"),
    ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0-deed"),
    ("Creative Commons Attribution-ShareAlike 2.5 Generic License", "CC-BY-SA-2.5-deed"),
])
def test_words_that_tell_licenses_apart_are_no_noise(text, name):
    if len(text) < 100:
        text = f"This work is licensed under {'the' if text.startswith('GNU') else 'a'} {text}"
    assert [f[0] for f in SCANNER.scan("Some words before. " + text + " And after.")] == [name]
    assert [n for n in SCANNER.names if holds(text, n) and n not in SCANNER.loose] == [name]


@pytest.mark.parametrize("text", [
    TEMPLATES["GPL-3.0"].replace("version 3", "version 9"), TEMPLATES["Apache-2.0"].replace("Version 2.0", "Version 1.0"),
    "This work is licensed under a Creative Commons Attribution 9.0 International License.",
    "This work is licensed under a Creative Commons 4.0 International License.",
    TEMPLATES["GPL-3.0"].replace("version 3", "version"), TEMPLATES["GPL-2.0"].replace("version 2", "version 2.5"),
])
def test_unknown_versions_are_not_reported_as_known_ones(text):
    assert SCANNER.scan(text) == []


def test_versions_are_read_alike():
    for version in ("version 2", "Version 2.0", "version v2"):
        ((name, _, _, _, notes),) = SCANNER.scan(f"This work is licensed under the GNU General Public License, {version}.")
        assert name == "GPL-2.0-notice" and not notes


@pytest.mark.parametrize("text, name", [
    ("Licensed under the MIT License.", "MIT-notice"), ("Distributed under the terms of the MIT License", "MIT-notice"),
    ("Licensed under the Apache License 2.0.", "Apache-2.0-notice"), ("released under Apache 2.0", "Apache-2.0-notice"),
    ("Distributed under the Apache License, version 2", "Apache-2.0-notice"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0-short"), ("Shared under the CC BY-NC-ND 3.0 license", "CC-BY-NC-ND-3.0-short"),
    ("This file is released under the GNU General Public License v2", "GPL-2.0-notice"),
    ("Released under version 2 of the GNU General Public License.", "GPL-2.0-notice-of"),
    ("made available under the GPLv3", "GPL-3.0-notice-v"), ("licensed under the BSD 2-clause license", "BSD-2-Clause-notice"),
    ("The content is published under the Mozilla Public License 2.0", "MPL-2.0-notice"),
])
def test_notices_are_found_in_any_form(text, name):
    for around in ("{}", "Some words before. {} And after.", "{}\n{}\n{}"):
        whole = around.format(*[text] * 3)
        found = SCANNER.scan(whole)
        assert [f[0] for f in found] == [name] * around.count("{}")
        assert all("under" in whole[start:end].lower() for _, start, end, _, _ in found)


@pytest.mark.parametrize("text", ["Some rights reserved.", "Released under the XYZ License.", "Under the bridge, the license of a poet.",
                                  "Licensed under Apache 3.0", "Licensed under the CC BY license", "mit under license"])
def test_other_words_are_no_notices(text):
    assert SCANNER.scan(text) == []


def test_notices_side_by_side_are_all_found():
    text = "Licensed under CC BY 4.0. Released under the MIT License; distributed under Apache 2.0, under the MIT license"
    assert [f[0] for f in SCANNER.scan(text)] == ["CC-BY-4.0-short", "MIT-notice", "Apache-2.0-notice", "MIT-notice"]


def test_whole_texts_may_differ_within_the_limit():
    rng = random.Random(6)
    for name in ("MIT-text", "Apache-2.0-text", "GPL-2.0-text"):
        words = list(SCANNER.words[name])
        fixed = licenses.fixed_words(list(map(licenses.normal, words)), False)
        free = [i for i, f in enumerate(fixed) if not f and 2 < i < len(words) - 3]
        for at in rng.sample(free, SCANNER.limit(name)):
            words[at] = "zzz" + str(at)
        ((won, _, _, _, notes),) = SCANNER.scan("lead in " * 300 + " ".join(words) + " tail" * 300)
        assert won == name and len(notes) == SCANNER.limit(name)


def test_three_clauses_are_not_two():
    assert [f[0] for f in SCANNER.scan(TEMPLATES["BSD-3-Clause-text"].replace("the copyright holder", "a " * 15))] != ["BSD-2-Clause-text"]
    assert [f[0] for f in SCANNER.scan(TEMPLATES["GPL-3.0-text"])] == ["GPL-3.0-text"]


@pytest.mark.parametrize("text, names", [
    ("Licensed under the Apache License, Version 2.0 or the MIT License", ["Apache-2.0-notice", "MIT-notice"]),
    ("dual licensed under MIT/Apache-2.0.", ["MIT-notice-bare", "Apache-2.0-notice"]),
    ("Licensed under either the MIT License, the BSD 2-Clause License, or GPL version 3, at your option.",
     ["MIT-notice", "BSD-2-Clause-notice", "GPL-3.0-notice-abbreviated"]),
    ("Released under the MIT License and the CC BY 4.0 license. Or so.", ["MIT-notice", "CC-BY-4.0-short"]),
    ("Released under the MIT License and provided by MIT researchers", ["MIT-notice"]),
    ("Released under the MIT License or any other that you like", ["MIT-notice"]),
])
def test_every_license_of_a_list_is_found(text, names):
    for around in ("{}", "Words before. {}\nand after"):
        whole = around.format(text)
        found = SCANNER.scan(whole)
        assert [f[0] for f in found] == names
        assert all(a[2] <= b[1] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("text, name", [
    ("released under MIT", "MIT-notice-bare"), ("released under GPL3.0", "GPL-3.0-notice-v"), ("licensed under LGPL", "LGPL-notice-abbreviated"),
    ("This software is licensed under the Apache License", "Apache-notice"), ("distributed under the GNU GPL.", "GPL-notice-gnu"),
    ("licensed under the GNU Lesser General Public License", "LGPL-notice"),
])
def test_names_without_version_are_found(text, name):
    assert [f[0] for f in SCANNER.scan("Words before. " + text + "\nand after")] == [name]


@pytest.mark.parametrize("text", ["The work was done under MIT.", "It was released under MIT supervision", "Licensed under the Apache License, Version 1.0",
                                  "under GPL rules", "Licensed under the LGPL version 9"])
def test_names_that_may_mean_something_else_are_no_notices(text):
    assert SCANNER.scan(text) == []


@pytest.mark.parametrize("text, note", [
    ("This is not released under the MIT License.", "!not"), ("No part of this work is released under the MIT License.", "!no"),
    ("This isn't released under the MIT License.", "!isn"), ("This is not all. Released under the MIT License.", None),
    ("Not for sale; released under the MIT License.", None),
])
def test_denials_are_differences(text, note):
    ((name, start, end, _, notes),) = SCANNER.scan(text)
    assert name == "MIT-notice" and text[start:end].endswith("the MIT License")
    assert [n for n in notes if n.startswith("!")] == ([note] if note else [])


def test_compression_ranks_rivals_and_wording_decides():
    """The confirmed template is the first of all rivals by reduction that the plain alignment accepts."""
    texts = [f"Some words before. {verb} {TEMPLATES[n].partition('under')[1]}{TEMPLATES[n].partition('under')[2]} And after."
             for n in sorted(SCANNER.notices) for verb in ("Licensed", "This file is distributed")]
    rivals = 0
    for text in texts:
        doc = licenses.Words(text)
        for first, end, names, _ in SCANNER.blocks(doc.words):
            block = doc.words[first:end]
            if set(names) <= SCANNER.notices:
                shares = {n for n in SCANNER.notices if any(w in block for w in SCANNER.needed[n] - {"under", "license", "licence"} if not w[0].isdigit())}
                assert set(names) == shares
            raw = " ".join(block).encode()
            plain = len(zstandard.ZstdCompressor(level=licenses.LEVEL).compress(raw))
            size = {n: len(zstandard.ZstdCompressor(level=licenses.LEVEL, dict_data=zstandard.ZstdCompressionDict(
                " ".join(SCANNER.words[n]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(raw)) for n in names}
            order = sorted(names, key=lambda n: (size[n], n))
            assert [n for _, n in SCANNER.rank(block, names)] == order
            accepted = [n for n in order if licenses.align(block, SCANNER.words[n], SCANNER.limit(n))]
            got = SCANNER.confirmed(block, names)
            assert [c[0] for c in got] == accepted
            assert all(c[3] == 1 - size[c[0]] / plain for c in got)
            rivals += len(names) > 1
    assert rivals > len(texts) // 2


def test_clashing_column_names_are_not_read(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", "x", 3, 0.5)], "doc_id long, text string, license string, start int, id double")
    assert [tuple(r)[:2] for r in licenses.licenses(docs).collect()] == [(1, "MIT-notice")]
