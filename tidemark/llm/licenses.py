"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into paragraphs at blank lines. Within one, lines that were wrapped are
joined (their comment marks dropped) and the whole is cut into sentences; each is
normalised (lower case, single spaces, letters, digits and some marks kept) and looked
up among known licence sentences. A paragraph in which that finds nothing is looked at
once more line by line, for notices without a full stop. The sequence of sentence
identifiers is then matched against ordered licence rules: a rule holds when its
identifiers follow each other directly among the recognised ones, and longer rules go
first and take their identifiers, so that a shorter one does not hold within them.

Everything stays inside one projection over the scan: no shuffle, no Python.

Edge cases: null and empty texts have no sentences and no licence; repeated
sentences and rows count each time; texts of any length are read whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence texts and notices, and their identifiers.
SENTENCES = {
    "this work is licensed under the gnu general public license, version 3": "gpl3.notice",
    "licensed under cc by-nc 4.0": "ccbync4.notice",
    "released under the mit license": "mit.notice",
    "licensed under the mit license": "mit.notice",
    "licensed under the apache license, version 2.0": "apache2.notice",
    "licensed under the apache license, version 2.0 (the license)": "apache2.notice",
    "you may not use this file except in compliance with the license": "apache2.comply",
    "you may obtain a copy of the license at": "apache2.copy",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied": "apache2.basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2.limits",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions": "mit.grant",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so": "mit0.grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit.keep",
    "the above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the software": "mit.keep",
    "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "mit.disclaimer",
    "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software": "mit.liability",
    "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the software) to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following": "bsl1.grant",
    "distributed under the boost software license, version 1.0": "bsl1.notice",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "bsd0.grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc.disclaimer",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd.grant",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd.binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd.advertise",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd.endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd.disclaimer",
    "this software is provided by the regents and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd.disclaimer",
    "this software is provided as-is, without any express or implied warranty": "zlib.disclaimer",
    "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "zlib.grant",
    "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 2 of the license, or (at your option) any later version": "gpl2.later",
    "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "gpl3.later",
    "you can redistribute it and/or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2.only",
    "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, version 3": "gpl3.only",
    "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 2.1 of the license, or (at your option) any later version": "lgpl21.later",
    "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "lgpl3.later",
    "you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "agpl3.later",
    "this program is distributed in the hope that it will be useful, but without any warranty": "gnu.warranty",
    "this library is distributed in the hope that it will be useful, but without any warranty": "gnu.warranty",
    "this source code form is subject to the terms of the mozilla public license, v": "mpl2.notice",
    "if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/": "mpl2.copy",
    "if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/": "mpl2.copy",
    "this is free and unencumbered software released into the public domain": "unlicense.domain",
    "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": "unlicense.free",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law": "cc0.deed",
    "this work is licensed under a creative commons attribution 4.0 international license": "ccby4.notice",
    "this work is licensed under cc by 4.0": "ccby4.notice",
    "this work is licensed under cc by-sa 4.0": "ccbysa4.notice",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license": "ccbysa4.notice",
}
# Licence, then the identifiers that must follow each other. Longer rules go first.
RULES = (
    ("BSD-4-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.advertise")),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("Apache-2.0", ("apache2.notice", "apache2.comply", "apache2.copy")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("MIT", ("mit.grant", "mit.keep", "mit.disclaimer")),
    ("0BSD", ("bsd0.grant", "isc.disclaimer")),
    ("ISC", ("isc.grant", "isc.disclaimer")),
    ("MIT-0", ("mit0.grant", "mit.disclaimer")),
    ("MPL-2.0", ("mpl2.notice", "mpl2.copy")),
    ("Unlicense", ("unlicense.domain", "unlicense.free")),
    ("Zlib", ("zlib.disclaimer", "zlib.grant")),
    ("AGPL-3.0-or-later", ("agpl3.later",)),
    ("Apache-2.0", ("apache2.notice",)),
    ("BSL-1.0", ("bsl1.grant",)),
    ("BSL-1.0", ("bsl1.notice",)),
    ("CC-BY-4.0", ("ccby4.notice",)),
    ("CC-BY-NC-4.0", ("ccbync4.notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4.notice",)),
    ("CC0-1.0", ("cc0.deed",)),
    ("GPL-2.0-only", ("gpl2.only",)),
    ("GPL-2.0-or-later", ("gpl2.later",)),
    ("GPL-3.0-only", ("gpl3.notice",)),
    ("GPL-3.0-only", ("gpl3.only",)),
    ("GPL-3.0-or-later", ("gpl3.later",)),
    ("LGPL-2.1-or-later", ("lgpl21.later",)),
    ("LGPL-3.0-or-later", ("lgpl3.later",)),
    ("MIT", ("mit.notice",)),
    ("MPL-2.0", ("mpl2.notice",)),
)

PARAGRAPH = r"\r?\n[ \t*#/;%>-]*\r?\n"
#: A line that ends within a sentence, with what stands before the next line's first word.
WRAPPED = r"([A-Za-z0-9,()\"'/-])[ \t]*\r?\n[ \t*#/;%>-]*"
#: The holder's own name in the clause against endorsement.
HOLDER = r"(?i)neither the names? of [^\n]{1,120}? nor the names? of (its|their|any) contributors"
CUT = r"[\n\r]+|[.!?;:][ \t]+|[.!?;:]$"
#: A paragraph without such a word cannot hold a licence sentence: a cheap test before sentences are cut.
HINT = r"(?i)licen[sc]e|redistribut|copyright|permission|warrant|public domain|unencumbered|compiled binary|advertising materials"


def normalised(sentence: Column) -> Column:
    kept = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.+,:/()\- ]+", "")
    kept = F.regexp_replace(kept, " +", " ")
    return F.regexp_replace(kept, r"^[ .,:/-]+|[ .,:-]+$", "")


def _identifiers(text: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    ids = F.transform(F.split(text, CUT), lambda s: F.try_element_at(table, normalised(s)))
    return F.filter(ids, lambda i: i.isNotNull())


def recognised(text: Column) -> Column:
    """Identifiers of the known sentences of ``text``, in order."""
    paragraphs = F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH), lambda p: p.rlike(HINT))

    def of(p: Column) -> Column:
        joined = F.regexp_replace(F.regexp_replace(p, WRAPPED, "$1 "), HOLDER, "neither the name of the copyright holder nor the names of its contributors")
        # An array of one, so that the sentences are cut once for both branches.
        return F.element_at(F.transform(F.array(_identifiers(joined)), lambda ids: F.when(F.size(ids) > 0, ids).otherwise(_identifiers(p))), 1)

    return F.flatten(F.transform(paragraphs, of))


def _marked(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_matches, sentence_ids (comma-joined, in order) and licenses (sorted, comma-joined)."""
    found = docs.select("doc_id", recognised(F.col("text")).alias("ids"))
    found = found.select("doc_id", F.size("ids").cast("long").alias("n_matches"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("line"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(_marked(seq)).alias("seq")) for name, seq in RULES))
    start = F.struct(F.col("line").alias("line"), F.array().cast("array<string>").alias("held"))

    def step(acc: Column, rule: Column) -> Column:
        held = F.when(F.contains(acc["line"], rule["seq"]), F.array_append(acc["held"], rule["name"])).otherwise(acc["held"])
        return F.struct(F.replace(acc["line"], rule["seq"], F.lit("|")).alias("line"), held.alias("held"))

    held = F.when(F.col("n_matches") > 0, F.aggregate(rules, start, step)["held"]).otherwise(F.array().cast("array<string>"))
    return found.select("doc_id", "n_matches", "sentence_ids", F.array_join(F.array_sort(F.array_distinct(held)), ",").alias("licenses"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same scan in DuckDB's SQL."""
    known = "MAP {" + ", ".join(f"{_quoted(k)}: '{v}'" for k, v in SENTENCES.items()) + "}"
    cleaned = "regexp_replace(lower(s), '[^a-z0-9.+,:/()\\- ]+', '', 'g')"
    cleaned = f"regexp_replace({cleaned}, ' +', ' ', 'g')"
    cleaned = f"regexp_replace({cleaned}, '^[ .,:/-]+|[ .,:-]+$', '', 'g')"
    ids = lambda t: f"list_filter(list_transform(regexp_split_to_array({t}, {_quoted(CUT)}), lambda s: {known}[{cleaned}]), lambda i: i IS NOT NULL)"
    joined = f"regexp_replace(regexp_replace(p, {_quoted(WRAPPED)}, '\\1 ', 'g'), {_quoted(HOLDER)}, 'neither the name of the copyright holder nor the names of its contributors', 'g')"
    steps, last = [], "found"
    for n, (name, seq) in enumerate(RULES):
        steps.append(f"r{n} AS (SELECT doc_id, n_matches, sentence_ids, replace(line, '{_marked(seq)}', '|') AS line, CASE WHEN contains(line, '{_marked(seq)}') THEN list_append(held, '{name}') ELSE held END AS held FROM {last})")
        last = f"r{n}"
    return f"""
    WITH cut AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), {_quoted(PARAGRAPH)}), lambda p: regexp_matches(p, {_quoted(HINT)})) AS ps FROM documents),
    ids AS (SELECT doc_id, flatten(list_transform(ps, lambda p: CASE WHEN len({ids(joined)}) > 0 THEN {ids(joined)} ELSE {ids("p")} END)) AS ids FROM cut),
    found AS (SELECT doc_id, len(ids)::BIGINT AS n_matches, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(list_transform(ids, lambda i: '<' || i || '>'), ''), '') AS line, []::VARCHAR[] AS held FROM ids),
    {", ".join(steps)}
    SELECT doc_id, n_matches, sentence_ids, coalesce(array_to_string(list_sort(list_distinct(held)), ','), '') AS licenses FROM {last}
    """
