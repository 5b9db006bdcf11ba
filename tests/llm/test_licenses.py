import textwrap

from auger.llm import licenses as L

MIT = """/* MIT License
 *
 * Copyright (c) 2020 Someone
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in all
 * copies or substantial portions of the Software.
 */"""


def test_sentences_and_rules(spark):
    texts = [MIT, "x y.\nLicensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License. Licensed under CC BY-NC 4.0!",
             None, "", "no license here", "LICENSED UNDER CC BY 4.0", "licensed under the mit license agreement", "all rights\nreserved",
             "# This program is distributed in the hope that it will be useful, but WITHOUT\n# ANY WARRANTY; without even the implied warranty of"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string").withColumnRenamed("body", "text").selectExpr("*", "1 as licenses", "2 as m")
    got = {r["doc_id"]: r for r in L.scan(df).collect()}
    assert {k: r["licenses"] for k, r in got.items()} == {0: "MIT", 1: "Apache-2.0", 2: "MIT CC-BY-NC-4.0", 6: "CC-BY-4.0", 8: "Proprietary"}
    assert got[0]["sentence_ids"] == "mit-title mit-grant mit-notice" and got[0]["unmatched"] == "" and got[0]["m"] == 2


def test_rules_use_up_their_sentences_in_order(spark):
    s = lambda *ids: ".\n\n".join(L.SENTENCES[i] for i in ids) + "."
    rows = [(1, s("gpl2-later", "gpl-warranty", "gpl-details")), (2, s("gpl-warranty", "gpl2-later")), (3, s("apache2-grant", "apache2-use", "apache2-use")),
            (4, s("mit-by", "mit-by"))]
    got = {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("GPL-2.0-or-later", ""), 2: ("GPL-2.0-or-later", "gpl-warranty"), 3: ("Apache-2.0", "apache2-use"), 4: ("MIT", "")}


def test_tables_are_sound():
    assert all(i in L.SENTENCES for _, key in L.RULES for i in key)
    assert len(set(L.SENTENCES.values())) == len(L.SENTENCES)


def test_odd_rows(spark, odd_docs, no_docs):
    assert L.scan(odd_docs).count() == 0 and L.scan(no_docs).count() == 0


GPL = """This {what} is free software{stop} you can redistribute it and/or modify
it under the terms of the GNU {name}General Public License as published by
the Free Software Foundation; either version {v} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name}General Public License for more details."""
APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ADVERTS = """
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement: This product includes software
   developed by the University of Somewhere and its contributors.
"""
NAME = """
3. Neither the name of {who} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def notices():
    gpl = lambda v, name="", what="program", stop=";": GPL.format(v=v, name=name, what=what, stop=stop)
    return [("Apache-2.0", APACHE), ("MPL-2.0", MPL), ("GPL-2.0-or-later", gpl("2")), ("GPL-3.0-or-later", gpl("3", stop=":")),
            ("AGPL-3.0-or-later", gpl("3", "Affero ")), ("LGPL-2.1-or-later", gpl("2.1", "Lesser ", "library")),
            ("LGPL-3.0-or-later", gpl("3", "Lesser ")), ("BSD-2-Clause", BSD), ("BSD-3-Clause", BSD + NAME.format(who="the copyright holder")),
            ("BSD-3-Clause", BSD + NAME.format(who="Some Org, Inc.")), ("BSD-4-Clause", BSD + ADVERTS + NAME.format(who="the University")),
            ("ISC", ISC), ("ISC", ISC.replace("and/or", "and"))]


def layouts(text):
    yield text
    yield "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
    yield "\r\n".join(text.split("\n"))
    for mark in ("# ", "// ", " * "):
        yield "\n".join((mark + line).rstrip() for line in text.split("\n"))
    for width in (30, 47, 100):
        yield "\n\n".join(textwrap.fill(p, width, break_long_words=False) for p in text.split("\n\n"))


def test_official_notices_in_any_layout(spark):
    cases = [(name, t) for name, notice in notices() for t in layouts(notice)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in L.scan(df).collect()}
    assert {i: (name, "") for i, (name, _) in enumerate(cases)} == got


def test_what_is_no_sentence_stays_none(spark):
    rows = [(1, "All rights. Reserved"), (2, "the MIT\n\nLicense"), (3, "Licensed under the Apache License, Version 2.0\nThe License is long"),
            (4, "Copyright Someone\nAll rights reserved\nReleased under the MIT\nLicense"), (5, "licensed under the MIT License\nagreement")]
    got = {r["doc_id"]: r["licenses"] for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: "Apache-2.0", 4: "MIT"}


def test_search_parts_are_in_all_sentences():
    assert all(any(p in s for p in L._PARTS) for s in L.SENTENCES.values())


def test_reserved_rights_beside_an_open_licence(spark):
    bsd = ("Copyright (c) 2020, Some Org\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\n"
           "modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain "
           "the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must "
           "reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other "
           "materials provided with the distribution.\n")
    rows = [(1, bsd), (2, "Copyright Some Org. All rights reserved."),
            # ids that come together only when another rule's ids are taken out are no row of ids
            (3, "Mozilla Public License. Released under the MIT License. All rights reserved.")]
    got = {r["doc_id"]: r["licenses"] for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "BSD-2-Clause", 2: "Proprietary", 3: "MIT"}
