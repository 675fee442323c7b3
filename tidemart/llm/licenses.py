"""License recognition by sentences and ordered rules.

Sentences of a text are normalised (A-Z lower-cased, all but a-z and 0-9 as one
space) and looked up among known license sentences; what is unknown drops out.  A
sentence begins and ends at punctuation, a blank line, or any line break, and a
single line break inside it is white space, so wrapped notices, headings and mentions
on a line of their own are all found.  Comment marks (what is no letter or digit at
the start of a line) are taken off first, and a line with nothing else is blank.
The identifiers left, in order, are matched against rules, longest sequences
first: a rule takes every place where its identifiers stand side by side, with at
most ``words_between`` other words between two of them, and those are then gone for
later rules.  A star in a sentence stands for up to ``SLOT_WORDS`` words, such as a holder's name.  DataFrame functions only.
Sentences and rules are a parameter (``RuleTable``, some hundreds of each); ``PUBLIC`` holds common public licenses: their
texts, notices, mentions, dated titles, and tags in files' heads.

Edge cases: a null or empty text has no license; a sentence repeated counts each
time; equal rows give equal results each; null ids stay null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licenses and notices, normalised, by identifier.
SENTENCES = {
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit_named": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_distributed": "distributed under the mit license",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_endorse_any": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_endorse_name": "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_named": "licensed under the bsd license",
    "apache_named": "licensed under the apache license version 2 0",
    "apache_notice": "licensed under the apache license version 2 0 the license",
    "apache_comply": "you may not use this file except in compliance with the license",
    "apache_obtain": "you may obtain a copy of the license at",
    "apache_unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "epl_notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "lgpl_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl3_named": "this work is licensed under the gnu general public license version 3",
    "gpl3_licensed": "licensed under the gnu general public license version 3",
    "gpl2_named": "this work is licensed under the gnu general public license version 2",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl_named": "licensed under the gnu lesser general public license version 3",
    "agpl_named": "licensed under the gnu affero general public license version 3",
    "mpl_notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "ccbync_named": "licensed under cc by nc 4 0",
    "ccby_named": "licensed under cc by 4 0",
    "ccbysa_named": "licensed under cc by sa 4 0",
    "ccbynd_named": "licensed under cc by nd 4 0",
    "ccby_long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0_named": "this work is dedicated to the public domain under a cc0 license",
    "unlicense_grant": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
    "spdx": "spdx license identifier",
    "mit_project": "this project is licensed under the mit license *",
    "mit_short": "licensed under the mit license see *",
    "apache_title": "apache license",
    "apache_date": "version 2 0 january 2004",
    "apache_short": "licensed under the apache 2 0 license",
    "apache_project": "this project is licensed under the apache license *",
    "apache_project_short": "this project is licensed under the apache 2 0 license *",
    "gpl_title": "gnu general public license",
    "gpl3_date": "version 3 29 june 2007",
    "gpl2_date": "version 2 june 1991",
    "lgpl_title": "gnu lesser general public license",
    "agpl_title": "gnu affero general public license",
    "agpl3_date": "version 3 19 november 2007",
    "mpl_title": "mozilla public license version 2 0",
    "boost_title": "boost software license version 1 0 august 17th 2003",
}
#: License identifiers that a tag in a file's head may name.
TAGS = ["MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "Unlicense", "WTFPL", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Artistic-2.0", "PostgreSQL", "Python-2.0"]
#: License, then the sentence identifiers that must stand side by side; earlier rules win.
RULES = [
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse_any"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse_name"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is"]),
    ("Apache-2.0", ["apache_notice", "apache_comply", "apache_obtain"]),
    ("Apache-2.0", ["apache_named", "apache_comply", "apache_obtain"]),
    ("AGPL-3.0-or-later", ["agpl_free", "gpl_hope"]),
    ("Zlib", ["zlib_as_is", "zlib_grant"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("ISC", ["isc_grant"]),
    ("BSL-1.0", ["boost_grant"]),
    ("Zlib", ["zlib_grant"]),
    ("EPL-2.0", ["epl_notice"]),
    ("LGPL-2.1-or-later", ["lgpl_free"]),
    ("AGPL-3.0-or-later", ["agpl_free"]),
    ("MIT", ["mit_grant"]),
    ("MIT", ["mit_named"]),
    ("MIT", ["mit_licensed"]),
    ("MIT", ["mit_distributed"]),
    ("BSD", ["bsd_grant"]),
    ("BSD", ["bsd_named"]),
    ("Apache-2.0", ["apache_notice"]),
    ("Apache-2.0", ["apache_named"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("GPL-3.0-only", ["gpl3_named"]),
    ("GPL-3.0-only", ["gpl3_licensed"]),
    ("GPL-2.0-only", ["gpl2_named"]),
    ("LGPL-3.0-only", ["lgpl_named"]),
    ("AGPL-3.0-only", ["agpl_named"]),
    ("MPL-2.0", ["mpl_notice"]),
    ("CC-BY-NC-4.0", ["ccbync_named"]),
    ("CC-BY-SA-4.0", ["ccbysa_named"]),
    ("CC-BY-ND-4.0", ["ccbynd_named"]),
    ("CC-BY-4.0", ["ccby_named"]),
    ("CC-BY-4.0", ["ccby_long"]),
    ("CC0-1.0", ["cc0_named"]),
    ("Unlicense", ["unlicense_grant"]),
    ("GPL-3.0-only", ["gpl_title", "gpl3_date"]),
    ("GPL-2.0-only", ["gpl_title", "gpl2_date"]),
    ("LGPL-3.0-only", ["lgpl_title", "gpl3_date"]),
    ("AGPL-3.0-only", ["agpl_title", "agpl3_date"]),
    ("Apache-2.0", ["apache_title", "apache_date"]),
    ("MIT", ["mit_project"]),
    ("MIT", ["mit_short"]),
    ("Apache-2.0", ["apache_short"]),
    ("Apache-2.0", ["apache_project_short"]),
    ("Apache-2.0", ["apache_project"]),
    ("MPL-2.0", ["mpl_title"]),
    ("BSL-1.0", ["boost_title"]),
    ("All-Rights-Reserved", ["reserved"]),
]
#: A sentence of each rule holds one of these, so texts without any need no cutting.
HINT = r"[Ll][Ii][Cc][Ee][Nn][Ss]|[Pp][Ee][Rr][Mm][Ii][Ss][Ss][Ii][Oo][Nn]|[Nn][Oo][Tt][Ii][Cc][Ee]|[Ww][Aa][Rr][Rr][Aa][Nn][Tt]|[Rr][Ee][Dd][Ii][Ss][Tt][Rr][Ii][Bb]|[Ee][Nn][Dd][Oo][Rr][Ss][Ee]|[Uu][Nn][Ee][Nn][Cc][Uu][Mm][Bb][Ee][Rr]|[Rr][Ii][Gg][Hh][Tt][Ss]"
#: For the SQL, which takes each line for itself: equal where every known sentence stands on one line.
SENTENCE_END = r"[.!?;:][\x20\x09-\x0D]+|[\x0A\x0D]{2,}|[.!?;:]$|\x0A"
#: Sentences whose public text has a colon, semicolon or full stop inside, after these words.
INNER_ENDS = {"gpl_free": "this program is free software", "gpl2_free": "this program is free software", "agpl_free": "this program is free software", "lgpl_free": "this library is free software", "gpl_hope": "without any warranty", "mpl_notice": "public license v"}
#: Steps of ``marked``: afterwards E is a sentence's end, B a blank line, L a line break (no other capitals are left).
MARKS = [(r"\r\n?", "\n"), (r"(^|\n)[^a-z0-9\n]++", "$1"), (r"[.!?;:](?:[\x20\x09-\x0D]++|$)", "E"), (r"\n{2,}", "B"), (r"\n", "L"), (r"[^a-z0-9BEL]+", " "), (r" ?([BEL]) ?", "$1")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: What the star of a sentence stands for: so many words, a holder's name for one; at a sentence's end there may be none.
SLOT_WORDS = 12


def _tag(name: str) -> str:
    return f"<{name}>"


def normalised(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def marked(text: Column) -> Column:
    """``text`` normalised, with marks where sentences and lines end."""
    out = F.translate(text, UPPER, LOWER)
    for pattern, by in MARKS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


@dataclass(frozen=True)
class RuleTable:
    """``sentences`` by identifier, normalised, with a star for words that differ; ``rules`` in order; ``inner_ends``: the words before an end inside a sentence.

    Each rule needs a sentence that matches ``hint``, if there is one, so texts without it need no cutting.
    """

    sentences: Mapping[str, str]
    rules: Sequence[tuple[str, Sequence[str]]]
    inner_ends: Mapping[str, str] = field(default_factory=dict)
    hint: str | None = None
    words_between: int = 50

    def _pattern(self, name: str) -> str:
        sentence, inner = self.sentences[name], self.inner_ends.get(name)
        if inner:
            sentence = sentence.replace(f"{inner} ", f"{inner}[ LE]")
        return self._starred(re.sub(r" (?!LE\])", "[ L]", sentence), "[ L]")

    @staticmethod
    def _starred(sentence: str, space: str) -> str:
        """``sentence`` with its stars as patterns."""
        word = f"(?:{space}[a-z0-9]+)"
        inside, end = f"{word}{{1,{SLOT_WORDS}}}?{space}", f"{word}{{0,{SLOT_WORDS}}}"
        return sentence.replace(f"{space}*{space}", inside).replace(f"{space}*", end)

    @property
    def slotted(self) -> dict[str, str]:
        """Patterns of the sentences with a star, for texts without marks, the longest first."""
        return {n: self._starred(self.sentences[n], " ") for n in sorted(self.sentences, key=lambda n: -len(self.sentences[n])) if "*" in self.sentences[n]}

    @property
    def known(self) -> str:
        """Any known sentence in a marked text, the longest first."""
        longest = sorted(self.sentences, key=lambda n: -len(self.sentences[n]))
        return "(?<![a-z0-9 ])(?:" + "|".join(map(self._pattern, longest)) + ")(?![a-z0-9 ])"


def with_tags(tags: Sequence[str]) -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Sentences and rules of the tags ``SPDX-License-Identifier: ...`` for these licenses."""
    return {f"id_{normalised(t).replace(' ', '_')}": normalised(t) for t in tags}, [(t, ["spdx", f"id_{normalised(t).replace(' ', '_')}"]) for t in tags]


_IDS, _TAG_RULES = with_tags(TAGS)
PUBLIC = RuleTable({**SENTENCES, **_IDS}, [*RULES, *_TAG_RULES], INNER_ENDS, HINT)


def sentence_ids(marked_text: str, table: RuleTable) -> Column:
    """The identifiers of the known sentences in that column, in order, as one string of tags, with a bar where too much stands between two."""
    known = F.create_map(*[F.lit(x) for name, s in table.sentences.items() if "*" not in s for x in (s, _tag(name))])
    found, rest = F.regexp_extract_all(marked_text, F.lit(table.known), F.lit(0)), F.split(marked_text, table.known, -1)

    def tag_of(sentence: Column) -> Column:
        plain, slots = F.translate(sentence, "LE", "  "), F.lit(None).cast("string")
        for name, pattern in reversed(table.slotted.items()):
            slots = F.when(plain.rlike(f"^{pattern}$"), F.lit(_tag(name))).otherwise(slots)
        return F.coalesce(F.try_element_at(known, plain), slots)

    tags = F.transform(found, tag_of)
    barred = F.transform(F.slice(rest, 1, F.size(found)), lambda r, k: F.when((k > 0) & (F.regexp_count(r, F.lit("[a-z0-9]+")) > table.words_between), F.lit("|")).otherwise(F.lit("")))
    return F.array_join(F.zip_with(barred, tags, lambda bar, tag: F.concat(bar, tag)), "")


def recognise(docs: DataFrame, table: RuleTable = PUBLIC, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document and rule that matched: doc_id, license, rule (from 1), matches, sentences known in all."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("text").rlike(table.hint)) if table.hint else rows.where("text is not null")
    rows = rows.select("doc_id", marked(F.col("text")).alias("marked")).select("doc_id", sentence_ids("marked", table).alias("left"))
    rows = rows.where("left <> ''").withColumn("known_sentences", F.regexp_count("left", F.lit("<")).cast("long"))
    found = []
    for k, (name, ids) in enumerate(table.rules, 1):
        tags = "".join(map(_tag, ids))
        count = F.expr(f"cast((length(`left`) - length(replace(`left`, '{tags}', ''))) / {len(tags)} as long)")
        rows = rows.withColumn(f"n{k}", count).withColumn("left", F.expr(f"replace(`left`, '{tags}', '#')"))
        found.append(F.struct(F.lit(name).alias("license"), F.lit(k).cast("long").alias("rule"), F.col(f"n{k}").alias("matches")))
    each = rows.select("doc_id", "known_sentences", F.explode(F.filter(F.array(*found), lambda x: x["matches"] > 0)).alias("m"))
    return each.select("doc_id", "m.license", "m.rule", "m.matches", "known_sentences")


def oracle_sql(table: RuleTable = PUBLIC) -> str:
    """The same in DuckDB SQL, for texts whose known sentences aren't wrapped."""
    pairs = ", ".join(f"('{s}', '{_tag(n)}')" for n, s in table.sentences.items() if "*" not in s)
    slots = "".join(f" WHEN regexp_full_match(s, '{pattern}') THEN '{_tag(n)}'" for n, pattern in table.slotted.items())
    tag = f"CASE WHEN tag IS NOT NULL THEN tag{slots} END"
    sql = f"""WITH known(s, tag) AS (VALUES {pairs}),
parts AS (
  SELECT rid, doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS k
  FROM (SELECT row_number() OVER () AS rid, doc_id, regexp_split_to_array(text, '{SENTENCE_END}') AS p FROM documents WHERE text IS NOT NULL)),
named AS (
  SELECT rid, doc_id, k, tag, CASE WHEN tag IS NULL AND s <> '' THEN len(string_split(s, ' ')) ELSE 0 END AS others
  FROM (SELECT rid, doc_id, k, s, {tag} AS tag FROM (SELECT rid, doc_id, k, trim(regexp_replace(translate(part, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS s FROM parts) LEFT JOIN known USING (s))),
placed AS (SELECT rid, doc_id, k, tag, sum(others) OVER (PARTITION BY rid ORDER BY k) AS upto FROM named),
barred AS (SELECT rid, doc_id, k, CASE WHEN upto - lag(upto) OVER (PARTITION BY rid ORDER BY k) > {table.words_between} THEN '|' ELSE '' END || tag AS tag FROM placed WHERE tag IS NOT NULL),
n0 AS (SELECT rid, any_value(doc_id) AS doc_id, string_agg(tag, '' ORDER BY k) AS l0, count(*) AS known_sentences FROM barred GROUP BY rid)"""
    unions = []
    for k, (name, ids) in enumerate(table.rules, 1):
        tags = "".join(map(_tag, ids))
        sql += f",\nn{k} AS (SELECT *, replace(l{k - 1}, '{tags}', '#') AS l{k}, CAST((length(l{k - 1}) - length(replace(l{k - 1}, '{tags}', ''))) // {len(tags)} AS BIGINT) AS c{k} FROM n{k - 1})"
        unions.append(f"SELECT doc_id, '{name}' AS license, CAST({k} AS BIGINT) AS rule, c{k} AS matches, CAST(known_sentences AS BIGINT) AS known_sentences FROM n{len(table.rules)} WHERE c{k} > 0")
    return sql + "\n" + "\nUNION ALL ".join(unions)
