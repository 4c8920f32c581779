"""Licence recognition by sentences: known sentences get identifiers, ordered rules read sequences of identifiers.

Comment signs before lines go first, and a copyright line becomes a paragraph end of its own, up to its first sentence mark that
closes no initial or company sign. A text is cut into sentences. A sentence is lower-cased and all but ASCII letters and digits becomes single spaces; if the
result is a known sentence, its identifier stands for it, otherwise its lines are tried on their own. Pieces of a known
sentence that follow each other count as the sentence; list numbers and separators do not keep sentences apart. Rules are tried in
their order on the sequence of identifiers; a rule's identifiers must follow each other directly, and what a rule has read
is gone for later rules. Identifiers that no rule reads are reported as open.

DataFrame functions only. Nothing is shuffled: a text is one row throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sentences of public licences, normalised, with their identifiers
SENTENCES = {
    "released under the mit license": "mit.ref",
    "licensed under the mit license": "mit.ref",
    "this project is licensed under the mit license": "mit.ref",
    "the mit license": "mit.title",
    "mit license": "mit.title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit.grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit.notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit.warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit.liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd.grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc.warranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc.liability",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd.warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd.liability",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd.binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd.endorse",
    "licensed under the bsd license": "bsd.ref",
    "released under the bsd 3 clause license": "bsd3.ref",
    "licensed under the apache license version 2 0": "apache2.ref",
    "licensed under the apache license version 2 0 the license": "apache2.ref",
    "you may not use this file except in compliance with the license": "apache2.comply",
    "you may obtain a copy of the license at": "apache2.copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2.basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2.see",
    "this work is licensed under the gnu general public license version 3": "gpl3.ref",
    "licensed under the gnu general public license version 3": "gpl3.ref",
    "licensed under the gnu general public license version 2": "gpl2.ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3.grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2.grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl.warranty",
    "see the gnu general public license for more details": "gpl.see",
    "you should have received a copy of the gnu general public license along with this program": "gpl.copy",
    "licensed under the gnu lesser general public license version 3": "lgpl3.ref",
    "licensed under the gnu affero general public license version 3": "agpl3.ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2.ref",
    "licensed under cc by 4 0": "ccby4.ref",
    "licensed under cc by sa 4 0": "ccbysa4.ref",
    "licensed under cc by nc 4 0": "ccbync4.ref",
    "licensed under cc by nd 4 0": "ccbynd4.ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4.ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4.ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4.ref",
    "licensed under cc0 1 0": "cc0.ref",
    "this is free and unencumbered software released into the public domain": "unlicense.grant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense.use",
    "all rights reserved": "reserved",
}

# fixed values: rules in their order, each a licence and the identifiers that must follow each other
RULES = (
    ("MIT", ("mit.title", "mit.grant", "mit.notice", "mit.warranty", "mit.liability")),
    ("MIT", ("mit.title", "mit.grant", "mit.notice", "mit.warranty")),
    ("MIT", ("mit.title", "mit.grant", "mit.notice")),
    ("MIT", ("mit.grant", "mit.notice", "mit.warranty", "mit.liability")),
    ("MIT", ("mit.grant", "mit.notice", "mit.warranty")),
    ("MIT", ("mit.grant", "mit.notice")),
    ("BSD-3-Clause", ("reserved", "bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.warranty", "bsd.liability")),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.warranty", "bsd.liability")),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", ("reserved", "bsd.grant", "bsd.source", "bsd.binary", "bsd.warranty", "bsd.liability")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.warranty", "bsd.liability")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("ISC", ("isc.grant", "isc.warranty", "isc.liability")),
    ("ISC", ("isc.grant",)),
    ("Apache-2.0", ("apache2.ref", "apache2.comply", "apache2.copy", "apache2.basis", "apache2.see")),
    ("Apache-2.0", ("apache2.ref", "apache2.comply", "apache2.copy")),
    ("Apache-2.0", ("apache2.ref",)),
    ("GPL-3.0-or-later", ("gpl3.grant", "gpl.warranty", "gpl.see", "gpl.copy")),
    ("GPL-3.0-or-later", ("gpl3.grant", "gpl.warranty", "gpl.see")),
    ("GPL-3.0-or-later", ("gpl3.grant", "gpl.warranty")),
    ("GPL-3.0-or-later", ("gpl3.grant",)),
    ("GPL-2.0-or-later", ("gpl2.grant", "gpl.warranty", "gpl.see", "gpl.copy")),
    ("GPL-2.0-or-later", ("gpl2.grant", "gpl.warranty", "gpl.see")),
    ("GPL-2.0-or-later", ("gpl2.grant", "gpl.warranty")),
    ("GPL-2.0-or-later", ("gpl2.grant",)),
    ("GPL-3.0", ("gpl3.ref",)),
    ("GPL-2.0", ("gpl2.ref",)),
    ("LGPL-3.0", ("lgpl3.ref",)),
    ("AGPL-3.0", ("agpl3.ref",)),
    ("MPL-2.0", ("mpl2.ref",)),
    ("MIT", ("mit.ref",)),
    ("MIT", ("mit.title",)),
    ("BSD-3-Clause", ("bsd3.ref",)),
    ("BSD", ("bsd.ref",)),
    ("CC-BY-SA-4.0", ("ccbysa4.ref",)),
    ("CC-BY-NC-4.0", ("ccbync4.ref",)),
    ("CC-BY-ND-4.0", ("ccbynd4.ref",)),
    ("CC-BY-4.0", ("ccby4.ref",)),
    ("CC0-1.0", ("cc0.ref",)),
    ("Unlicense", ("unlicense.grant", "unlicense.use")),
    ("Unlicense", ("unlicense.grant",)),
    ("Proprietary", ("reserved",)),
)

# fixed values: known sentences that official texts cut by ; : or v. into these pieces
PIECES = (
    ("gpl2.grant", (
        "this program is free software", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "either version 2 of the license or at your option any later version",
    )),
    ("gpl2.grant", (
        "this program is free software",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    )),
    ("gpl2.grant", (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "either version 2 of the license or at your option any later version",
    )),
    ("gpl3.grant", (
        "this program is free software", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "either version 3 of the license or at your option any later version",
    )),
    ("gpl3.grant", (
        "this program is free software",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    )),
    ("gpl3.grant", (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "either version 3 of the license or at your option any later version",
    )),
    ("gpl.warranty", ("this program is distributed in the hope that it will be useful but without any warranty", "without even the implied warranty of merchantability or fitness for a particular purpose")),
    ("mpl2.ref", ("this source code form is subject to the terms of the mozilla public license v", "2 0")),
    ("bsd.liability", (
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
        "loss of use data or profits",
        "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    )),
)

#: Normalised parts that stand between sentences and do not keep them apart: nothing, list numbers, the address of the Apache licence.
BETWEEN = r"^([0-9]*|https? www apache org licenses license 2 0( txt| html)?)$"
#: Each known sentence holds one of these, so a text without any of them holds no known sentence.
HINTS = ("license", "licensed", "permission", "permitted", "redistributions", "warranty", "liable", "rights", "software")
#: Signs of comments before a line, and a copyright line up to its first sentence mark (not that of an initial or a company sign).
COMMENT = r"(?m)^[\x20\x09]*(#+|//+|/\*+|\*+/|\*+|--+|;+|%+|>+)[\x20\x09]*"
COPYRIGHT = (
    r"(?mi)^[\x20\x09]*(copyright[\x20\x09]*(\(c\)|\xA9)?|\(c\)|\xA9)[\x20\x09]*[0-9]{4}[^\n.;:!?]*(\b([a-z]|inc|ltd|corp|co)\.[^\n.;:!?]*){0,5}[.,]?"
)
SENTENCE_END = r"[.!?;:][^A-Za-z0-9\x20\x09-\x0D]*[\x20\x09-\x0D]+|\n[\x20\x09]*\n"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hint_pattern(sentences: dict[str, str]) -> str:
    """Letters in either case; a table with other words gets the words that its sentences need."""
    words = [h for h in HINTS if any(h in s.split() for s in sentences)]
    words += sorted({max(s.split(), key=len) for s in sentences if not set(words) & set(s.split())})
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    return "|".join(map(either, words))


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def uncommented(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, COMMENT, ""), COPYRIGHT, "\n\n")


def marks(text: Column, sentences: dict[str, str] = SENTENCES, pieces=PIECES) -> Column:
    """The text as a chain: [identifier] for a known sentence or line, <piece> for a piece of one, ~ for others, nothing for what BETWEEN has."""
    marked = {p: f"<{p}>" for _, cut in pieces for p in cut} | {s: f"[{name}]" for s, name in sentences.items()}
    table = F.create_map(*[F.lit(x) for pair in marked.items() for x in pair])
    known = lambda part: F.try_element_at(table, normalised(part))
    line = lambda part: F.coalesce(known(part), F.when(normalised(part).rlike(BETWEEN), "").otherwise("~"))
    lines = lambda part: F.transform(F.split(part, "\n"), line)
    named = F.transform(F.split(uncommented(text), SENTENCE_END), lambda s: F.when(known(s).isNotNull(), F.array(known(s))).otherwise(lines(s)))
    return F.array_join(F.flatten(named), "")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """One row per input row: doc_id, sentences (identifiers in text order), licenses (in text order), open (identifiers that no rule reads).

    Null, empty and licence-free texts get empty arrays; repeated rows are scanned each; of rules that fit the same place the
    first in order wins. Other columns are ignored.
    """
    body = F.col(text).cast("string")
    own = tuple((name, cut) for name, cut in PIECES if name in sentences.values())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.when(body.rlike(hint_pattern(sentences)), marks(body, sentences, own)).alias("_marks"))
    # texts without any known part need no reading
    chain = F.when(F.col("_marks").rlike(r"[\[<]"), F.col("_marks"))
    for name, cut in own:
        chain = F.replace(chain, F.lit("".join(f"<{p}>" for p in cut)), F.lit(f"[{name}]"))
    rows = rows.select("doc_id", F.coalesce(F.regexp_replace(chain, "<[^>]*>", "~"), F.lit("")).alias("_chain"))
    read = F.when(F.col("_chain") != "", F.col("_chain"))
    for licence, parts in rules:
        read = F.replace(read, F.lit("".join(f"[{p}]" for p in parts)), F.lit("{" + licence + "}"))
    rows = rows.select("doc_id", "_chain", F.coalesce(read, F.lit("")).alias("_read"))
    inside = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    return rows.select(
        "doc_id", inside("_chain", r"\[([^\]]*)\]").alias("sentences"), inside("_read", r"\{([^}]*)\}").alias("licenses"), inside("_read", r"\[([^\]]*)\]").alias("open"),
    )


def scan_sql() -> str:
    """The same in the other dialect, for comparison."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    marked = {p: f"<{p}>" for _, cut in PIECES for p in cut} | {sentence: f"[{name}]" for sentence, name in SENTENCES.items()}
    table = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in marked.items()) + "}"
    norm = lambda x: f"trim(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    body = f"regexp_replace(regexp_replace(coalesce(text, ''), {quoted(COMMENT)}, '', 'g'), {quoted(COPYRIGHT)}, chr(10) || chr(10), 'g')"
    whole = "chain"
    for name, cut in PIECES:
        whole = f"replace({whole}, '{''.join(f'<{p}>' for p in cut)}', '[{name}]')"
    read = "chain"
    for licence, parts in RULES:
        read = f"replace({read}, '{''.join(f'[{p}]' for p in parts)}', '{{{licence}}}')"
    return f"""
WITH parts AS (SELECT doc_id, unnest(string_split_regex(body, {quoted(SENTENCE_END)})) AS s, generate_subscripts(string_split_regex(body, {quoted(SENTENCE_END)}), 1) AS i
               FROM (SELECT doc_id, {body} AS body FROM documents)),
whole AS (SELECT doc_id, i, s, ({table})[{norm('s')}] AS mark FROM parts),
lines AS (SELECT doc_id, i, 0 AS j, mark FROM whole WHERE mark IS NOT NULL
          UNION ALL SELECT doc_id, i, j, coalesce(({table})[{norm('l')}], CASE WHEN regexp_matches({norm('l')}, {quoted(BETWEEN)}) THEN '' ELSE '~' END)
                    FROM (SELECT doc_id, i, unnest(string_split(s, chr(10))) AS l, generate_subscripts(string_split(s, chr(10)), 1) AS j FROM whole WHERE mark IS NULL)),
pieces AS (SELECT doc_id, string_agg(mark, '' ORDER BY i, j) AS chain FROM lines GROUP BY doc_id),
chains AS (SELECT doc_id, regexp_replace({whole}, '<[^>]*>', '~', 'g') AS chain FROM pieces),
reads AS (SELECT doc_id, chain, {read} AS r FROM chains)
SELECT doc_id, array_to_string(regexp_extract_all(chain, '\\[([^\\]]*)\\]', 1), ',') AS sentences, array_to_string(regexp_extract_all(r, '\\{{([^}}]*)\\}}', 1), ',') AS licenses,
       array_to_string(regexp_extract_all(r, '\\[([^\\]]*)\\]', 1), ',') AS open_sentences
FROM reads
"""
