r"""License scan by sentence rules, in Spark columns only.

A text is cut into sentences (comment marks at line starts are taken off; a sentence ends at ``. ! ? ;`` before
white space, at an empty line, and at a line end that no small letter follows); each is normalised to
lower-case letters and digits with single blanks and looked up among known licence sentences. Before that,
the words of each known sentence are put on one line wherever they stand in a row, so that neither a wrapped line
nor a stop inside a notice ("v. 2.0", "free software; you can") cuts it. The ids found,
in the order of the text, are matched against the licence rules in the rules' order: a rule is a row of
ids; where it matches, its ids are used up, so a rule for a whole licence comes before those for parts. A mark
stays in their place, so ids that do not follow each other never match a rule. The rules of ``LAST`` hold only
where no other does: "All rights reserved." also stands in notices of open licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised, fixed values.
SENTENCES = {
    "apache2-by": "licensed under the apache license version 2 0",
    "apache2-grant": "licensed under the apache license version 2 0 the license",
    "apache2-use": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is "
                    "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-by": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                 "documentation files the software to deal in the software without restriction including without limitation "
                 "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
                 "permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial "
                  "portions of the software",
    "gpl2-by": "this work is licensed under the gnu general public license version 2",
    "gpl3-by": "this work is licensed under the gnu general public license version 3",
    "gpl2-licensed": "licensed under the gnu general public license version 2",
    "gpl3-licensed": "licensed under the gnu general public license version 3",
    "gpl2-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                  "public license as published by the free software foundation either version 2 of the license or at your "
                  "option any later version",
    "gpl3-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                  "public license as published by the free software foundation either version 3 of the license or at your "
                  "option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the "
                    "implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "ccby4-by": "licensed under cc by 4 0",
    "ccbysa4-by": "licensed under cc by sa 4 0",
    "ccbync4-by": "licensed under cc by nc 4 0",
    "ccbyncsa4-by": "licensed under cc by nc sa 4 0",
    "ccbynd4-by": "licensed under cc by nd 4 0",
    "ccby4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-by": "this work has been dedicated to the public domain under cc0 1 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
    "agpl3-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero "
                   "general public license as published by the free software foundation either version 3 of the license or at "
                   "your option any later version",
    "agpl-details": "see the gnu affero general public license for more details",
    "lgpl21-later": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
                    "general public license as published by the free software foundation either version 2 1 of the license or "
                    "at your option any later version",
    "lgpl3-later": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
                   "general public license as published by the free software foundation either version 3 of the license or at "
                   "your option any later version",
    "lgpl-warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the "
                     "implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that "
                 "the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the "
                  "following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                  "following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-adverts": "all advertising materials mentioning features or use of this software must display the following "
                   "acknowledgement",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                "products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
                 "granted provided that the above copyright notice and this permission notice appear in all copies",
}
# Licence rules in their order, fixed values.
RULES = [
    ("Apache-2.0", ("apache2-grant", "apache2-use", "apache2-copy", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-grant", "apache2-use")),
    ("Apache-2.0", ("apache2-by",)),
    ("Apache-2.0", ("apache2-grant",)),
    ("MIT", ("mit-title", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-by",)),
    ("MIT", ("mit-licensed",)),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-warranty", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-warranty", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-only", ("gpl2-by",)),
    ("GPL-3.0-only", ("gpl3-by",)),
    ("GPL-2.0-only", ("gpl2-licensed",)),
    ("GPL-3.0-only", ("gpl3-licensed",)),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-form",)),
    ("CC-BY-4.0", ("ccby4-by",)),
    ("CC-BY-4.0", ("ccby4-work",)),
    ("CC-BY-SA-4.0", ("ccbysa4-by",)),
    ("CC-BY-SA-4.0", ("ccbysa4-work",)),
    ("CC-BY-NC-4.0", ("ccbync4-by",)),
    ("CC-BY-NC-4.0", ("ccbync4-work",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa4-by",)),
    ("CC-BY-ND-4.0", ("ccbynd4-by",)),
    ("CC0-1.0", ("cc0-by",)),
    ("Unlicense", ("unlicense",)),
    ("AGPL-3.0-or-later", ("agpl3-later", "gpl-warranty", "agpl-details")),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("LGPL-2.1-or-later", ("lgpl21-later", "lgpl-warranty", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-later", "lgpl-warranty", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl21-later", "gpl-warranty", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-later", "gpl-warranty", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-adverts", "bsd-name")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
]
# Rules that hold where no other does, fixed values.
LAST = [("Proprietary", ("reserved",))]
_USED = "#"
_MARK = "\x01"
# Between two words of a sentence: one line end at most and no stop before white space; in a sentence of at least
# LONG words anything, so stops and empty lines inside the notices do not cut them.
_GAP, _ANY_GAP, LONG = r"(?:[^A-Za-z0-9.!?;\n]+(?:\n[^A-Za-z0-9.!?;\n]*)?|\n[^A-Za-z0-9.!?;\n]*|\.)", "[^A-Za-z0-9]+", 15
# Parts of known sentences that notices fill in or write in several ways: id -> (words, pattern), fixed values.
_FORMS = {
    "apache2-grant": ("0 the", r"0[^A-Za-z0-9.!?;]*\([^A-Za-z0-9.!?;]*the"),  # without the bracket it is apache2-by and a new sentence
    "apache2-copy": ("http", "https?"),
    "mpl2-copy": ("https", "https?"),
    "lgpl21-later": ("this library", "this[^A-Za-z0-9]+(?:library|program)"),
    "lgpl3-later": ("this library", "this[^A-Za-z0-9]+(?:library|program)"),
    "bsd-adverts": ("acknowledgement", "acknowledge?ment[^.;]{0,300}"),
    "bsd-name": ("the copyright holder", "[^;]{1,200}?"),
    "isc-grant": ("and or", "and(?:[^A-Za-z0-9]+or)?"),
}
# Each known sentence has a word with one of these parts; texts without them need no search for sentences.
_PARTS = ("licens", "permi", "warrant", "mpl", "public", "reserved", "redistribution", "advertising")


def _in_one_line(i: str) -> tuple[str, str]:
    """The step that writes the words of a known sentence with blanks between, in capitals but for the first letter."""
    words, form = _FORMS.get(i, ("", ""))
    gap = _ANY_GAP if SENTENCES[i].count(" ") + 1 >= LONG else _GAP
    before, found, after = SENTENCES[i].partition(words) if words else (SENTENCES[i], "", "")
    pattern = before.replace(" ", gap) + form * bool(found) + after.replace(" ", gap)
    return rf"(?i)\b({pattern[0]}){pattern[1:]}\b", "$1" + SENTENCES[i][1:].upper()


# Steps from a text to sentences parted by _MARK: (pattern, replacement), fixed values; the longest sentences first.
_MARKS = [(r"(?m)^[ \t]*(/\*+|\*+/|\*+|//+|#+|--)[ \t]*", "")]
_JOINS = [_in_one_line(i) for i in sorted(SENTENCES, key=lambda i: (-len(SENTENCES[i]), i))]
_CUTS = [
    (r"[.!?;]([ \t\r\n]|$)", _MARK + "$1"),
    (r"\n[ \t\r]*\n", _MARK),
    (r"\n([ \t\r]*\p{Ll})", " $1"),
    (r"\n", _MARK),
]
_STEPS = _MARKS + _JOINS + _CUTS


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def sentences(text: Column) -> Column:
    """The normalised sentences of a text, in order."""
    text = _replaced(text, _MARKS)
    text = F.when(text.rlike("(?i)" + "|".join(_PARTS)), _replaced(text, _JOINS)).otherwise(text)
    return F.transform(F.split(_replaced(text, _CUTS), _MARK), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))


def _key(ids: tuple[str, ...]) -> str:
    return "".join(f"|{i}|" for i in ids)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with a known licence sentence, without ``text``, and with ``sentence_ids`` (in order, joined
    by blanks), ``licenses`` (names in rule order, each once, joined by blanks; empty if no rule matches) and
    ``unmatched`` (ids that no rule used). Null, empty and unlicensed texts give no row; repeated rows and
    nulls elsewhere are kept as they are. No row meets another, so keys and sizes do not matter."""
    ids = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    found = F.filter(F.transform(sentences(F.col(text)), lambda s: F.element_at(ids, s)), lambda i: i.isNotNull())
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "sentence_ids", "licenses", "unmatched")]
    rows = docs.select(*keep, found.alias("sentence_ids")).where(F.size("sentence_ids") > 0)
    left = F.concat_ws("", F.transform("sentence_ids", lambda i: F.concat(F.lit("|"), i, F.lit("|"))))
    start = F.struct(left.alias("left"), F.array().cast("array<string>").alias("names"))
    # a last rule is tried where no name was found before the last rules
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_key(key)).alias("key"), F.lit(last).alias("last"))
                      for some, last in ((RULES, False), (LAST, True)) for name, key in some])
    holds = lambda a, r: F.contains(a["left"], r["key"]) & (~r["last"] | (F.size(a["names"]) == 0))
    match = F.aggregate(rules, start, lambda a, r: F.struct(
        F.when(holds(a, r), F.replace(a["left"], r["key"], F.lit(_USED))).otherwise(a["left"]).alias("left"),
        F.when(holds(a, r), F.array_union(a["names"], F.array(r["name"]))).otherwise(a["names"]).alias("names")))
    names = [c for c in rows.columns if c != "sentence_ids"]
    return rows.withColumn("__match", match).select(
        *[F.col(f"`{c}`") for c in names], F.concat_ws(" ", "sentence_ids").alias("sentence_ids"),
        F.concat_ws(" ", "__match.names").alias("licenses"), F.trim(F.regexp_replace("__match.left", r"[|#]+", " ")).alias("unmatched"))


def oracle() -> str:
    """DuckDB text of :func:`scan` over ``documents``, built from the same tables."""
    text = "text"
    for pattern, by in _STEPS:
        new = by.replace("$1", "\\1").replace(_MARK, "' || chr(1) || '")
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    known = ", ".join(f"'{s}': '{i}'" for i, s in SENTENCES.items())
    sql = [f"""with s as (
  select doc_id, list_filter(list_transform(
      list_transform(string_split({text}, chr(1)), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))),
      lambda x: map {{{known}}}[x]), lambda i: i is not null) as ids
  from documents),
r0 as (select doc_id, ids, array_to_string(list_transform(ids, lambda i: '|' || i || '|'), '') as l, []::varchar[] as names from s where len(ids) > 0)"""]
    for k, (name, key) in enumerate(RULES + LAST):
        holds = f"contains(l, '{_key(key)}')" + (" and len(names) = 0" if k >= len(RULES) else "")
        sql.append(f"""r{k + 1} as (select doc_id, ids, case when {holds} then replace(l, '{_key(key)}', '{_USED}') else l end as l,
  case when {holds} and not list_contains(names, '{name}') then list_append(names, '{name}') else names end as names from r{k})""")
    return ",\n".join(sql) + f"""
select doc_id, array_to_string(ids, ' ') as sentence_ids, array_to_string(names, ' ') as licenses,
       trim(regexp_replace(l, '[|#]+', ' ', 'g')) as unmatched from r{len(RULES + LAST)}"""
