"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, and each is normalised to lower-case words. Known licence sentences become their
identifiers, others are left out, and the rules are matched against the sequence of identifiers: a rule is an
ordered list of sentences that states one licence. Where several rules begin at one place the longest counts, and
matches do not overlap.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised as ``normal`` does, and the rules over them.
SENTENCES = {
    "apache2-short": "licensed under the apache license version 2 0",
    "apache2-the-license": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-terms": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-disclaim": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-this-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-this-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl3-library": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "cc0-short": "licensed under cc0 1 0",
    "cc-by-short": "licensed under cc by 4 0",
    "cc-by-sa-short": "licensed under cc by sa 4 0",
    "cc-by-nc-short": "licensed under cc by nc 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache2": "spdx license identifier apache 2 0",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-gpl3": "spdx license identifier gpl 3 0 or later",
    "rights-reserved": "all rights reserved",
}
#: (rule, licence, its sentences in order)
RULES = (
    ("apache2-header", "Apache-2.0", ("apache2-the-license", "apache2-comply", "apache2-copy", "apache2-basis", "apache2-see")),
    ("apache2-notice", "Apache-2.0", ("apache2-the-license",)),
    ("apache2-line", "Apache-2.0", ("apache2-short",)),
    ("apache2-tag", "Apache-2.0", ("spdx-apache2",)),
    ("mit-text", "MIT", ("mit-grant", "mit-as-is")),
    ("mit-text-split", "MIT", ("mit-terms", "mit-notice", "mit-as-is")),
    ("mit-line", "MIT", ("mit-short",)),
    ("mit-use", "MIT", ("mit-licensed",)),
    ("mit-tag", "MIT", ("spdx-mit",)),
    ("isc-text", "ISC", ("isc-grant", "isc-disclaim")),
    ("bsd3-text", "BSD-3-Clause", ("bsd-terms", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("bsd2-text", "BSD-2-Clause", ("bsd-terms", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("bsd3-tag", "BSD-3-Clause", ("spdx-bsd3",)),
    ("gpl3-header", "GPL-3.0-or-later", ("gpl-this-program", "gpl-hope", "gpl-see")),
    ("gpl3-program", "GPL-3.0-or-later", ("gpl-this-program",)),
    ("gpl3-terms", "GPL-3.0-or-later", ("gpl-redistribute",)),
    ("gpl3-line", "GPL-3.0-only", ("gpl3-work",)),
    ("gpl3-tag", "GPL-3.0-or-later", ("spdx-gpl3",)),
    ("gpl2-header", "GPL-2.0-or-later", ("gpl2-this-program", "gpl-hope", "gpl-see")),
    ("gpl2-program", "GPL-2.0-or-later", ("gpl2-this-program",)),
    ("lgpl3-library", "LGPL-3.0-or-later", ("lgpl3-library",)),
    ("mpl2-header", "MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("mpl2-notice", "MPL-2.0", ("mpl2-form",)),
    ("unlicense", "Unlicense", ("unlicense-free",)),
    ("cc0-line", "CC0-1.0", ("cc0-short",)),
    ("cc-by-line", "CC-BY-4.0", ("cc-by-short",)),
    ("cc-by-notice", "CC-BY-4.0", ("cc-by-long",)),
    ("cc-by-sa-line", "CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("cc-by-nc-line", "CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("no-licence", "Proprietary", ("rights-reserved",)),
)
#: Every known sentence holds one of these, so a text with none of them is not cut at all.
HINTS = ("licen", "permission", "redistribut", "copyright", "software", "rights reserved", "warrant", "the mpl")
#: Ends of pieces: marks before white space, and line breaks. Sentences with such a place inside are found by ``joined`` only.
BREAKS = r"[.!?;:]+[ \t\n\r]+|[\r\n]+"


def normal(sentence: str) -> str:
    """Lower-case words and numbers with one space between them."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _token(sentence_id: str) -> str:
    return f"<{sentence_id}>"


def rule_pattern(rules=RULES) -> str:
    """One alternative for each rule, the longest first; a regular expression takes the first that fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[2]), r[0]))
    return "|".join("".join(map(_token, r[2])) for r in ordered)


def joined_pattern(known) -> str:
    """Known sentences over runs of pieces: each begins and ends where a piece does, ends within are skipped; the longest first."""
    ordered = sorted(known, key=lambda s: (-len(s), s))
    return r"(?<=\| )(?:" + "|".join(s.replace(" ", r"(?: \|)? ") for s in ordered) + r")(?= \|)"


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules=RULES, hints: tuple[str, ...] = HINTS, joined: bool = False) -> DataFrame:
    """(doc_id, match_no, rule, license, n_sentences) per match, in order of the text.

    Each row of ``docs`` is scanned by itself, equal ones give equal matches; null and empty texts and texts without a
    known sentence give no row. ``hints`` must have a part of every known sentence; pass ``("",)`` to scan all texts.
    With ``joined`` a sentence may run over several pieces, as in wrapped texts and tags; without, it is one piece.
    """
    known = {text: _token(key) for key, text in (sentences or SENTENCES).items()}
    text = F.lower(F.col("text").cast("string"))
    hint = "|".join(map(re.escape, hints))
    hinted = F.regexp_like(text, F.lit(hint.replace(r"\ ", "[^a-z0-9]+") if joined else hint))
    parts = F.transform(F.split(text, BREAKS), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    ids = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    if joined:
        marked = F.regexp_replace(F.translate(text, "|", " "), BREAKS, " | ")
        marked = F.regexp_replace(F.concat(F.lit("| "), F.regexp_replace(marked, "[^a-z0-9|]+", " "), F.lit(" |")), r" *\|[ |]*", " | ")
        parts = F.transform(F.regexp_extract_all(marked, F.lit(joined_pattern(known)), F.lit(0)), lambda s: F.replace(s, F.lit(" |"), F.lit("")))
    sequence = F.array_join(F.transform(parts, lambda s: F.element_at(ids, s)), "")
    matches = F.regexp_extract_all(sequence, F.lit(f"({rule_pattern(rules)})"), F.lit(1))
    found = docs.where(hinted).select(F.col("doc_id"), F.posexplode(matches).alias("at", "match"))
    table = F.create_map(*[x for name, licence, ids_ in rules for x in (
        F.lit("".join(map(_token, ids_))), F.struct(F.lit(name).alias("rule"), F.lit(licence).alias("license"), F.lit(len(ids_)).alias("n")))])
    rule = F.element_at(table, F.col("match"))
    return found.select("doc_id", (F.col("at") + 1).cast("long").alias("match_no"), rule["rule"].alias("rule"), rule["license"].alias("license"),
                        rule["n"].cast("long").alias("n_sentences"))


def oracle(rules=RULES) -> str:
    """The same scan as SQL: constants as tables, sentences by joins."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(text)}, {quote(_token(key))})" for key, text in SENTENCES.items())
    listed = ", ".join(f"({quote(''.join(map(_token, ids)))}, {quote(name)}, {quote(licence)}, {len(ids)})" for name, licence, ids in rules)
    return f"""
    WITH known(sentence, token) AS (VALUES {known}), listed(match, rule, license, n) AS (VALUES {listed}),
         cut AS (SELECT doc_id, string_split_regex(lower(text), {quote(BREAKS)}) AS parts FROM documents WHERE text IS NOT NULL),
         one AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS no FROM cut),
         seq AS (SELECT o.doc_id, string_agg(k.token, '' ORDER BY o.no) AS tokens FROM one o
                 JOIN known k ON k.sentence = trim(regexp_replace(o.part, '[^a-z0-9]+', ' ', 'g')) GROUP BY o.doc_id),
         hit AS (SELECT doc_id, regexp_extract_all(tokens, {quote(rule_pattern(rules))}) AS hits FROM seq),
         flat AS (SELECT doc_id, unnest(hits) AS match, generate_subscripts(hits, 1) AS match_no FROM hit)
    SELECT f.doc_id, f.match_no, l.rule, l.license, CAST(l.n AS BIGINT) AS n_sentences FROM flat f JOIN listed l USING (match)
    """
