"""Quality and toxicity: held-out accuracy on the benchmark tables, and odd rows."""

from pyspark.sql import functions as F

from gradeloom.llm import license_scan as L
from gradeloom.llm import quality as Q
from gradeloom.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    out = Q.op3_quality(spark, SF)
    assert out.count() == 1000 and out.filter("score < 0 or score > 1 or score is null").count() == 0
    held = out.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    assert held.filter("predicted = quality").count() >= 0.97 * held.count()
    assert out.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)).count() == 0


def test_toxicity_on_held_out_labels(spark):
    out = T.op8_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("toxic", "label"), "doc_id").filter("held_out")
    assert out.filter("toxic and label = 0").count() == 0
    assert out.filter("toxic and label = 1").count() >= 0.6 * out.filter("label = 1").count()


def test_odd_rows_and_no_labels(spark, odd, nothing, labels):
    q, t = Q.quality_scores(odd, labels), T.toxicity(odd, labels)
    assert q.count() == t.count() == odd.count()
    assert {r["score"] for r in q.collect()} == {0.5} and {r["severity"] for r in t.collect()} == {0.0}
    assert Q.quality_scores(nothing, labels).count() == 0 and T.toxicity(nothing, labels).count() == 0
    mixed = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (5, 1, 0), (3, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    assert {r["id"] for r in Q.one_label(mixed, "doc_id", "quality").collect()} == {3, 5}
    assert Q.quality_scores(odd, mixed).count() == odd.count() and T.toxicity(odd, mixed).count() == odd.count()


def test_thresholds_stay_in_order_and_weights_are_shared():
    import numpy as np

    x = [np.array([1] * (g > 0) + [2] * (g > 1) + [9], dtype=np.int64) for g in (0, 0, 1, 1, 2, 2)] * 5
    w, theta = T.fit_ordinal(x, np.array([0, 0, 1, 1, 2, 2] * 5), 3)
    assert theta[0] < theta[1] and w[1] > 0 and w[2] > 0
    model = T.Ordinal(w, theta)
    assert model.above(["zzz"], set()).shape == (1, 2)


def test_toxic_labels_come_first_and_only_copies_go(spark):
    import numpy as np

    ids = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(400)], "id long, y int")
    some, many = T._sample(ids, 60)
    assert some.filter("y = 1").count() == 20 and some.count() == 60 and many == {0: 380, 1: 20}
    assert T._sample(ids, 30)[0].filter("y = 1").count() == 15
    notice = " ".join(f"n{i}" for i in range(40))
    texts = [f"{notice} {' '.join(f'{k}x{i}' for i in range(60))}" for k in "abcdef"]
    texts += [texts[0], texts[0]]
    found = T.without_copies(np.array([T.signature(T.words(t)) for t in texts]), np.array([1] * 6 + [1, 0]))
    assert found.tolist() == [0, 1, 2, 3, 4, 5, 7]


def test_license_wordings(spark, odd, nothing):
    cases = {"Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"], "Licensed under CC BY 4.0.": ["CC-BY-4.0"], "a\nThis work is licensed under the GNU General Public License, version 3.\nb": ["GPL-3.0"], "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"], "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.": ["Apache-2.0", "MIT"], "my driving licence expired": []}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    assert [r["licenses"] for r in L.license_scan(df).orderBy("doc_id").collect()] == list(cases.values())
    assert L.scan("This work was licensed under the GNU General Public License, version 3.")[0].differences == "-is +was"
    assert {tuple(r["licenses"]) for r in L.license_scan(odd).collect()} == {()} and L.license_scan(nothing).count() == 0


def test_every_license_notice_of_a_paragraph_counts(spark):
    cases = {
        "Licensed under the MIT License or the Apache License, Version 2.0.": ["Apache-2.0", "MIT"],
        "Released under the MIT License. This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0", "MIT"],
        "Released under\nthe MIT License.": ["MIT"],
        "This work is\nlicensed under the GNU General Public\nLicense, version 3.": ["GPL-3.0"],
        "# Permission is\n# hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal in\n# the Software without restriction": ["MIT"],
        "This is free and unencumbered software released into the public\ndomain.": ["Unlicense"],
        "Dedicated to the public\ndomain under CC0 1.0.": ["CC0-1.0"],
        "Licensed under CC-BY-SA 4.0.": ["CC-BY-SA-4.0"],
        "Licensed under Apache-2.0": ["Apache-2.0"],
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["Apache-2.0", "MIT"],
        "Licensed under CC BY-NC-ND 4.0.": [],
        "a license\n" + "other words\n" * 20 + "Released under the ISC License.": ["ISC"],
    }
    assert {k: [f.license for f in L.scan(k)] for k in cases} == cases
    assert [[f.license for f in L.scan(text)] for _, text, _ in L.TEMPLATES] == [[name] for name, _, _ in L.TEMPLATES]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    assert [r["licenses"] for r in L.license_scan(df).orderBy("doc_id").collect()] == list(cases.values())


def test_licenses_in_their_usual_forms():
    cases = {
        "Released under CC BY 4.0": ["CC-BY-4.0"],
        "SPDX-License-Identifier: GPL-3.0-or-later": ["GPL-3.0"],
        "This code is licensed under the terms of the MIT license": ["MIT"],
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": ["BSD"],
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007": ["GPL-3.0"],
        "see https://creativecommons.org/licenses/by-sa/4.0/ for more": ["CC-BY-SA-4.0"],
        "text http://www.creativecommons.org/licenses/by/4.0/legalcode": ["CC-BY-4.0"],
        "MIT License or the Apache License, Version 2.0": ["Apache-2.0"],
        "Dual licensed under the MIT License or the Apache License, Version 2.0": ["Apache-2.0", "MIT"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": ["CC-BY-NC-4.0"],
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": ["LGPL-3.0"],
        "https://creativecommons.org/licenses/by-nc-sa/4.0/": [],
        "the gnu grazed at mit near the apache river with cc by permission of the substantial fee, in general 3 of them": [],
    }
    found = {k: [f.license for f in L.scan(k)] for k in cases}
    assert found == cases


def test_edited_notices_are_found_and_plain_texts_are_not():
    import random

    rng = random.Random(5)
    plain = [f"w{i}" for i in range(300)]
    for name, text, must in L.TEMPLATES:
        words = text.split()
        if len(words) < 12:
            continue
        spots = [i for i, w in enumerate(words) if not set(L.words(w)) & {*L.words(must), *L.CLAUSES}]
        for _ in range(3):
            edited = list(words)
            for i in rng.sample(spots, max(1, len(words) // 10)):
                edited[i] = rng.choice(plain)
            around = [" ".join(rng.choices(plain, k=40)) for _ in range(2)]
            assert name in [f.license for f in L.scan(f"{around[0]} {' '.join(edited)} {around[1]}")], (name, edited)
    assert not any(L.scan(" ".join(rng.choices(plain + ["license", "mit", "gnu", "cc", "apache", "bsd", "restriction"], k=200))) for _ in range(200))


def test_license_scan_equals_exact_lines_on_the_corpus(spark):
    exact = {"CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License."}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["licenses"] for r in L.op2_license_scan(spark, SF).collect()}
    assert got == {d: ",".join(sorted(k for k, w in exact.items() if w in t.split("\n"))) for d, t in texts.items()}


def test_license_places_are_found_by_compression_before_words_are_compared(monkeypatch):
    compared, differences = [], L.differences
    monkeypatch.setattr(L, "differences", lambda block, template: compared.append(template) or differences(block, template))
    assert L.places(L.words("A gnu herd of 3 grazed near the general; an apache guide walked 2.0 miles, fee unpaid, his permission hereby kept and granted late")) == [] and not compared
    edited = "Code here. Permission is granted, free of charge, to any person getting a copy of this software and associated files, to deal in the Software without restriction"
    assert [p.finding.license for p in L.places(L.words(edited))] == ["MIT"] and compared
