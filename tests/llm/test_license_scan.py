import re

import __spark_entry__
from millrace.llm import license_scan, queries
from tests.oracle import compare

PHRASES = license_scan.PHRASES


def brute(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))


CASES = [
    None, "", "---", "MIT License", "the mit  license, MIT-LICENSE and mit licenses", "cc by cc by\ncc-by-nc", "GNU General\nPublic License gnu general public",
    "émit license", "mit license" * 3, "İmit LICENSE Kmit", "mit licenseK", " , ".join(["apache license"] * 500), "x" * 200000 + " cc by", "gnu general public license gnu",
]


def test_base(spark, sf_dir):
    docs = [(i, t) for i, t in enumerate(CASES)] + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        assert got[i] == brute(t), (i, (t or "")[:60])


def labels_of(spark, texts):
    out = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(0 <= r.score <= 1 for r in out)
    return {r.doc_id: {m.label: (m.start, m.share) for m in r.matches} for r in out}


def test_templates(spark):
    got = labels_of(spark, ["Some words before. " + notice.title() + " and after" for _, notice, _ in license_scan.TEMPLATES])
    for i, (label, _, _) in enumerate(license_scan.TEMPLATES):
        assert got[i][label] == (3, 1.0), (label, got[i])


HEADERS = {
    "mit": """/*
 * Copyright (c) 2020 A. Person
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in
 * all copies or substantial portions of the Software.
 */""",
    "apache-2.0-header": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.""",
    "bsd-3-clause": "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def test_headers_as_files_have_them(spark):
    got = labels_of(spark, list(HEADERS.values()))
    for i, label in enumerate(HEADERS):
        assert label in got[i], (label, got[i])


def test_names_and_key_phrases_alone_give_no_label(spark):
    texts = ["MIT License", "released under the mit license", "the gnu general public license", "license public general gnu the under"]
    texts += ["some words " + " , then ".join(keys) + " more words" for _, notice, keys in license_scan.TEMPLATES if len(notice.split()) > 20]
    got = labels_of(spark, texts)
    assert not any(got.values()), {texts[i]: m for i, m in got.items() if m}
    # all words of a notice, but not in their places
    shuffled = " ".join(sorted(license_scan.TEMPLATES[6][1].split())) + " permission is hereby granted free of charge without restriction"
    assert "mit" not in labels_of(spark, [shuffled])[0]


def test_all_notices_of_a_file_are_found(spark):
    every = ". ".join(notice for _, notice, _ in license_scan.TEMPLATES)
    prose = "redistribution permission conditions files charge deal binary copy associated documentation forms granted"
    got = labels_of(spark, [every, f"{prose}. {license_scan.TEMPLATES[0][1]}"])
    assert set(got[0]) == {label for label, _, _ in license_scan.TEMPLATES} and "gpl-3.0" in got[1]


def test_idf_picks_the_words(spark):
    """Words that the corpus is full of aren't looked up where the template has rarer ones."""
    common = {w: 0.1 for w in license_scan._postings()}
    rare = dict.fromkeys(["merchantability", "fitness", "hope", "useful"], 5.0)
    picked = license_scan.rare_postings(common | rare)
    t = [x[0] for x in license_scan.TEMPLATES].index("gpl-notice")
    assert all(any(u == t for u, _ in picked[w]) for w in rare)
    assert len({w for w, ps in picked.items() if any(u == t for u, _ in ps)}) == license_scan.RARE


def test_odd_tables_and_query(spark, sf_dir):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = license_scan.scan(spark.createDataFrame([(None, None, 1), (1, "mit license", 2), (1, "mit license", 2)], "doc_id long, text string, labels int")).collect()
    assert len(rows) == 3 and [r.labels for r in rows if r.doc_id] == ["mit"] * 2
    out = queries.op2_license_scan(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out} == {i: brute(t) for i, t in texts.items()}


def test_query_matches_sql(spark, sf_dir):
    assert compare(spark, __spark_entry__, "op2_license_scan", sf_dir) > 0
    assert compare(spark, __spark_entry__, "op2_license_scan", "/root/testdata/sf0.01") > 0
