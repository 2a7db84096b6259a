"""Licence notices: families told and confirmed, unknown ones left alone, native scores as the plain ones."""

import math

import pytest

from foliant.llm import licences


@pytest.fixture(scope="module")
def model():
    return licences.train()


def test_scan(spark, model):
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nMore prose."), (2, "All rights reserved."), (3, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
        (4, "Licensed under the Example Community License, version 1."), (5, None), (6, ""), (7, "no telling words here"), (7, "no telling words here"), (8, "word " * 50_000 + "\nThis work is licensed under the GNU General Public License, version 3."), (None, "Released under the MIT License."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as uid", "'x' as family", "'y' as gram")
    out = licences.by_document(licences.scan(df, model)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.licences, r.n_found) for r in out}
    assert got == {1: ("MIT", 1), 2: ("Proprietary", 1), 3: ("Apache-2.0,CC-BY-NC", 2), 4: ("", 0), 5: ("", 0), 6: ("", 0), 7: ("", 0), 8: ("GPL", 1), None: ("MIT", 1)}
    assert licences.by_document(licences.scan(df.limit(0), model)).count() == 0


def test_native_scores_are_the_regressions(spark, model):
    texts = [t for family in licences.NOTICES.values() for t in family] + list(licences.UNKNOWN)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licences.scan(df, model).where("paragraph is not null").collect():
        z = list(model.bias)
        for g in licences.grams_of(licences.words_of(r.body)):
            z = [a + b for a, b in zip(z, model.weights.get(g, [0.0] * len(z)))]
        p = [math.exp(v - max(z)) for v in z]
        assert r.family == licences.CLASSES[p.index(1.0)] and r.probability == pytest.approx(1 / sum(p))


def test_notices_and_unknown(spark, model):
    notices = [(f, t) for f, ts in licences.NOTICES.items() for t in ts]
    df = spark.createDataFrame([(i, "Foo bar baz.\n" + t) for i, (_, t) in enumerate(notices)], "doc_id long, text string")
    right = sum(notices[r.doc_id][0] == r.licences for r in licences.by_document(licences.scan(df, model)).collect())
    assert right >= 0.9 * len(notices)
    df = spark.createDataFrame(list(enumerate(licences.UNKNOWN)), "doc_id long, text string")
    assert licences.by_document(licences.scan(df, model)).where("n_found > 0").count() == 0


def test_every_weight_has_a_telling_word(model):
    assert all(set(g.split()) & set(licences.TELLING) for g in model.weights)


WRAPPED = {
    "GPL": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL": "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.\n#\n# This library is distributed in the hope that it will be useful.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\r\npurpose with or without fee is hereby granted, provided that the above\r\ncopyright notice and this permission notice appear in all copies.\r\n",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */",
}


def test_wrapped_notices(spark, model):
    rows = [(i, t) for i, t in enumerate(WRAPPED.values())] + [(10 + i, f"Foo bar baz.\n\n{t}\n\nMore prose.") for i, t in enumerate(WRAPPED.values())]
    rows += [(20, "Released under the MIT License.\n\n" + WRAPPED["ISC"]), (21, "Released under the MIT License.\nReleased under the MIT License."), (22, "\n".join(licences.UNKNOWN))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.n_found) for r in licences.by_document(licences.scan(df, model)).collect()}
    assert all(got[i] == got[10 + i] == (f, 1) for i, f in enumerate(WRAPPED))
    assert got[20] == ("ISC,MIT", 2) and got[21] == ("MIT", 2) and got[22] == ("", 0)
