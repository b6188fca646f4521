"""Notices of every family, whole, wrapped and inside other text; shares against brute force."""

import textwrap

import pytest

from pagetables.llm import licences

#: Notices as they stand in files, by family.
NOTICES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT."),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
        "agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied."),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the "
        "terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 2.1 of the License, or (at your option) any later "
        "version. This library is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose "
        "with or without fee is hereby granted, provided that the above copyright notice and "
        'this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND '
        "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."),
    "Public-Domain": (
        "This is free and unencumbered software released into the public domain. Anyone is "
        "free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."),
    "Proprietary": (
        "Copyright (c) 2019 the Example Holdings Inc. and its licensors. All rights reserved."),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International "
        "License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO "
        "Box 1866, Mountain View, CA 94042, USA."),
    "CC-BY-NC": (
        "Except where otherwise noted, this work is licensed under a Creative Commons "
        "Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": (
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 "
        "International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by-sa/4.0/."),
    "CC-BY-NC-SA": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike "
        "4.0 International License."),
}


@pytest.fixture(scope="module")
def model(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return licences.train(corpus)


@pytest.mark.parametrize("family", sorted(NOTICES))
def test_notices_whole_wrapped_and_embedded(model, family):
    text = NOTICES[family]
    forms = [text, f"A heading without an end\nThe fox {text} Then the story goes on.\nAnd on"]
    forms += ["\n".join(mark + line for line in textwrap.wrap(text, width))
              for width in (40, 60, 76) for mark in ("", "# ", " * ")]
    for form in forms:
        assert model.scan(form.encode())[0] == [family]
    both = f"{text}\n\n{NOTICES['MPL-2.0']}".encode()
    assert model.scan(both)[0] == sorted({family, "MPL-2.0"})


def test_mentions_and_other_text_are_no_licence(model):
    for text in ("She reserved all rights to the two front seats of the public bus.",
                 "The general public was not admitted, and no licence was given to use the hall.",
                 "He copied the source code and redistributed it in binary form.", "", " \n#\n", "license"):
        assert model.scan(text.encode())[0] == []


def test_paragraphs_join_lines_that_a_sentence_goes_on_in():
    text = b"One line.\nTwo goes\non here.\n\n#\nLast (ends).)\nopen"
    assert list(licences.paragraphs(text)) == [
        [b"One line."], [b"Two goes", b"on here."], [b"Last (ends).)"], [b"open"]]
    assert list(licences.paragraphs(b"a\n \nb")) == [[b"a"], [b"b"]]


def test_every_run_of_words_lies_in_a_window():
    assert list(licences.windows([])) == [[]]
    for n in (1, 47, 48, 49, 63, 64, 65, 200):
        w = [b"%d" % i for i in range(n)]
        got = list(licences.windows(w))
        assert all(len(x) <= licences.WINDOW for x in got)
        size = min(n, licences.WINDOW - licences.STEP)
        for i in range(n - size + 1):
            run = w[i:i + size]
            assert any(run[0] in x and x[x.index(run[0]):][:size] == run for x in got)


def test_shares_equal_brute_force(model):
    texts = [t for n in NOTICES.values() for t in (n, n.replace(" the ", " some the "), n[40:])]
    for text in texts:
        for w in licences.windows(licences.words(text.encode())):
            want = {}
            for i, family in enumerate(model.families):
                for t in licences.TEMPLATES[family]:
                    base = licences.words(t.encode())
                    pairs = set(zip(base, base[1:]))
                    most = max(len(pairs & set(zip(w[s:], w[s + 1:s + 2 * len(base)])))
                               for s in range(len(w)))
                    share = most / len(pairs)
                    if len(base) <= licences.PHRASE and share < 1:
                        share = min(share, licences.ALIKE)
                    if most:
                        want[i] = max(want.get(i, (0, 0)), (share, most))
            assert model.shares(w) == want


def test_long_text_is_judged_in_blocks(model, monkeypatch):
    text = ("filler of the words and of the rest " * 400 + NOTICES["GPL"] + "\n") * 3 + NOTICES["ISC"]
    whole = model.scan(text.encode())
    monkeypatch.setattr(licences, "TOGETHER", 3)
    assert whole[0] == ["GPL", "ISC"] and model.scan(text.encode()) == whole


def test_templates_of_other_lengths_are_refused():
    for words in ("two words", "word " * 33):
        with pytest.raises(ValueError):
            licences.LicenceModel({"X": (words,)}, [])
