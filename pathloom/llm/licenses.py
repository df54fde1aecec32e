"""License scans: sentences to known identifiers, then ordered rules over the identifiers.

Whole licence sentences are looked up as runs of words, all at once in one automaton. Sentences that name a licence
("this project is licensed under the MIT License", "License: MIT OR Apache-2.0") are recognised by family: how they begin, then
the longest known name, looked up by its words; tags are read as expressions.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

# Licence sentences by identifier, whole, as licences and notices have them.
SENTENCES = {
    "apache2-notice": "Licensed under the Apache License, Version 2.0",
    "apache2-compliance": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "mit-notice": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-asis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "ccbync4-notice": "Licensed under CC BY-NC 4.0",
    "ccby4-notice": "Licensed under CC BY 4.0",
    "ccbysa4-notice": "Licensed under CC BY-SA 4.0",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "unlicense-notice": "This is free and unencumbered software released into the public domain",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "apache2-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl2-free": "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-only": "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-free": "is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-free": "is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-free": "is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "bsd0-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "bsl-notice": "Distributed under the Boost Software License, Version 1.0",
    "mpl2-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl2-title": "Mozilla Public License Version 2.0 1. Definitions",
    "epl2-text": "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")",
    "epl2-header": "made available under the terms of the Eclipse Public License 2.0 which is available at",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-deed": "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law",
    "unlicense-dedicate": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
}
# Identifiers of licences that a tag of one line may name.
TAGGED = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later "
    "GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 MS-PL OFL-1.1 PostgreSQL Unlicense Zlib"
).split()
SENTENCES |= {f"{x}-tag-notice": f"SPDX-License-Identifier: {x}" for x in TAGGED}
# Other wordings of the identifiers, found wherever they stand; where a program or holder is named, the part without the name.
VARIANTS = [
    ("apache2-notice", "under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("apache2-notice", "under the Apache License, Version 2.0 (the \"License\"); you may not use these files except in compliance with the License"),
    ("apache2-compliance", "you may not use these files except in compliance with the License"),
    ("mit-condition", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    ("mit-asis", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NON-INFRINGEMENT"),
    ("gpl-free", "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-free", "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3, or (at your option) any later version"),
    ("gpl-warranty", "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("mpl2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions, and the following disclaimer"),
    ("bsd-endorse", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "may not be used to endorse or promote products derived from this software without specific prior written permission"),
]
# Beginnings of sentences that identify a licence only as whole sentences of their own.
BEGINNINGS = [
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit-asis", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
]
# Rules in order of preference; a rule holds if its identifiers occur in this order in a text.
RULES = [
    ("MIT-text", "MIT", ["mit-grant", "mit-condition", "mit-asis"]),
    ("BSD-3-text", "BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-text", "BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("Apache-2-header", "Apache-2.0", ["apache2-notice", "apache2-compliance", "apache2-copy", "apache2-asis"]),
    ("GPL-3-header", "GPL-3.0-or-later", ["gpl-free", "gpl-warranty"]),
    ("Apache-2-notice", "Apache-2.0", ["apache2-notice"]),
    ("MIT-notice", "MIT", ["mit-notice"]),
    ("MIT-licensed", "MIT", ["mit-licensed"]),
    ("GPL-3-notice", "GPL-3.0", ["gpl3-notice"]),
    ("CC-BY-NC-4-notice", "CC-BY-NC-4.0", ["ccbync4-notice"]),
    ("CC-BY-4-notice", "CC-BY-4.0", ["ccby4-notice"]),
    ("CC-BY-SA-4-notice", "CC-BY-SA-4.0", ["ccbysa4-notice"]),
    ("MPL-2-notice", "MPL-2.0", ["mpl2-notice"]),
    ("Unlicense-notice", "Unlicense", ["unlicense-notice"]),
    ("Apache-2-text", "Apache-2.0", ["apache2-title", "apache2-terms"]),
    ("GPL-2-header", "GPL-2.0-or-later", ["gpl2-free", "gpl-warranty"]),
    ("GPL-2-only-header", "GPL-2.0-only", ["gpl2-only"]),
    ("GPL-2-text", "GPL-2.0", ["gpl2-title"]),
    ("GPL-3-text", "GPL-3.0", ["gpl3-title"]),
    ("LGPL-2.1-header", "LGPL-2.1-or-later", ["lgpl21-free", "gpl-warranty"]),
    ("LGPL-2.1-text", "LGPL-2.1", ["lgpl21-title"]),
    ("LGPL-3-header", "LGPL-3.0-or-later", ["lgpl3-free", "gpl-warranty"]),
    ("LGPL-3-text", "LGPL-3.0", ["lgpl3-title"]),
    ("AGPL-3-header", "AGPL-3.0-or-later", ["agpl3-free", "gpl-warranty"]),
    ("AGPL-3-text", "AGPL-3.0", ["agpl3-title"]),
    ("ISC-text", "ISC", ["isc-grant", "isc-asis"]),
    ("0BSD-text", "0BSD", ["bsd0-notice", "isc-asis"]),
    ("Zlib-text", "Zlib", ["zlib-asis", "zlib-grant", "zlib-origin"]),
    ("BSL-1-text", "BSL-1.0", ["bsl-grant"]),
    ("BSL-1-notice", "BSL-1.0", ["bsl-notice"]),
    ("MPL-2-text", "MPL-2.0", ["mpl2-title"]),
    ("EPL-2-text", "EPL-2.0", ["epl2-text"]),
    ("EPL-2-header", "EPL-2.0", ["epl2-header"]),
    ("CC0-text", "CC0-1.0", ["cc0-title"]),
    ("CC0-deed", "CC0-1.0", ["cc0-deed"]),
]
RULES += [(f"{x}-tag", x, [f"{x}-tag-notice"]) for x in TAGGED]
# A rule does not hold where its last identifier is followed by this one before its first comes again.
UNLESS = {"BSD-2-text": "bsd-endorse"}
# Names by which sentences call a licence, in words; a name may be followed by "license", and those of "GNU" by "only" or "or later".
NAMES = {
    "MIT": "mit|expat|mit expat", "Apache-2.0": "apache 2|apache 2 0|apache license 2|apache license 2 0|apache license version 2|apache license version 2 0|apache software license 2 0|apache software license version 2 0|asl 2 0",
    "BSD-2-Clause": "bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd", "BSD-3-Clause": "bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd", "ISC": "isc", "Zlib": "zlib", "Unlicense": "unlicense",
    "MPL-2.0": "mpl 2 0|mpl v2 0|mozilla public license 2 0|mozilla public license v 2 0|mozilla public license version 2 0", "BSL-1.0": "boost software license|boost software license 1 0|boost software license version 1 0",
    "EPL-2.0": "eclipse public license 2 0|eclipse public license v 2 0|eclipse public license version 2 0|epl 2 0", "Artistic-2.0": "artistic license 2 0", "OFL-1.1": "sil open font license 1 1|sil open font license version 1 1",
    "CC-BY-4.0": "cc by 4 0|creative commons attribution 4 0|creative commons attribution 4 0 international", "CC-BY-SA-4.0": "cc by sa 4 0|creative commons attribution sharealike 4 0|creative commons attribution sharealike 4 0 international|creative commons attribution share alike 4 0 international",
    "CC-BY-NC-4.0": "cc by nc 4 0|creative commons attribution noncommercial 4 0|creative commons attribution noncommercial 4 0 international", "CC0-1.0": "cc0|cc0 1 0|cc0 1 0 universal|creative commons zero",
}
# GNU licences by their names' words and the versions that each has.
GNU = {"GPL": ("gnu general public license|gnu gpl|gpl", ("2.0", "3.0")), "LGPL": ("gnu lesser general public license|gnu lgpl|lgpl", ("2.1", "3.0")), "AGPL": ("gnu affero general public license|gnu agpl|agpl", ("3.0",))}
# Identifiers of expressions that are no longer in use, and what they mean now.
OLD_TAGS = {"GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later", "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later", "LGPL-3.0": "LGPL-3.0-only", "LGPL-3.0+": "LGPL-3.0-or-later", "AGPL-3.0": "AGPL-3.0-only", "AGPL-3.0+": "AGPL-3.0-or-later"}


def _names() -> dict[str, str]:
    """Licence by the words of its names, GNU ones with each way of writing their version."""
    out = {n: lic for lic, names in NAMES.items() for n in names.split("|")}
    for short, (names, versions) in GNU.items():
        for v in versions:
            whole = [v.replace(".", " ")] + ([v[0]] if v.endswith(".0") else [])
            for n in names.split("|"):
                out |= {f"{n} {how}{w}": f"{short}-{v}" for w in whole for how in ("", "v", "version ", "v ")}
                out |= {f"{n}v{w}": f"{short}-{v}" for w in whole}
    return out


NAMED = _names()
RULES += [(f"{x}-named", x, [f"{x}-named-notice"]) for x in dict.fromkeys([*NAMED.values(), *(f"{x}-{v}-{end}" for x, (_, vs) in GNU.items() for v in vs for end in ("only", "or-later"))])]
#: How a sentence that grants a licence begins, in words; what stands before is its subject.
_LEAD = re.compile(r" (?:licen[sc]ed|released|distributed|available|provided|offered|published|covered|governed|redistributed) (?:under|by) (?:(?:the )?(?:terms|conditions)(?: and conditions)? of )?(?:an? |the )?")
SUBJECT_WORDS = 12
#: How a subject ends before the verb; a copyright line needs none of these.
_ENDS_SUBJECT = {"is", "are", "dual", "also", "hereby", "now"}
#: Words that deny or weaken it, before and after.
_DENIED = set("not no nor never neither none nothing without unless if whether cannot think thinks said says that which who whose many most some few".split())
_WEAK = {"style", "like", "compatible", "inspired", "based", "compliant"}
#: A line that only names the licence.
_TAG = re.compile(r"(?im)^[^\w\n]*(?:spdx[ -]license[ -]identifier|licen[sc]e(?:[ -]expression)?)[\"']?[ \t]*[:=]+[ \t]*(\S[^\n]*)$")
_TERM = re.compile(r"\(|\)|[A-Za-z0-9.+-]+")
_KNOWN_TAGS = {x.lower(): x for x in TAGGED} | {k.lower(): v for k, v in OLD_TAGS.items()}


def _name_at(words: list[str], k: int) -> tuple[str, int] | None:
    """(licence, words of its name) of the longest known name at word k."""
    for n in range(min(9, len(words) - k), 0, -1):
        lic = NAMED.get(" ".join(words[k : k + n]))
        if lic:
            k += n
            rest = words[k : k + 8]
            if rest[:1] in (["license"], ["licence"]):
                rest = rest[1:]
            if rest[:1] and rest[0] in _WEAK:
                return None
            if lic.partition("-")[0] in GNU:
                said = " ".join(rest)
                if said.startswith(("or later", "or any later", "or at your option any later", "or newer")):
                    lic += "-or-later"
                elif said.startswith("only"):
                    lic += "-only"
            return lic, n
    return None


def read_expression(value: str) -> list[str]:
    """Licences that an expression of identifiers names (``A OR (B AND C WITH exception)``), old identifiers by their
    present ones; empty if it holds anything else."""
    value = value.strip().strip("\"'`*/#;,-> \t")
    found, skip = [], False
    if _TERM.sub("", value).strip():
        return []
    for term in _TERM.findall(value):
        if skip:
            skip = False
        elif term.upper() == "WITH":
            skip = True
        elif term in "()" or term.upper() in ("AND", "OR"):
            continue
        elif (known := _KNOWN_TAGS.get(term.lower())) is None:
            return []
        else:
            found.append(known)
    return found


#: Identifiers of one-line notices, which must be sentences or lines of their own: a text that mentions one has no licence.
ALONE = ("-notice", "-licensed")
#: Every known sentence has one of these words; other texts are not searched.
ANCHOR = r"(?i)licen[sc]e|software|\b(?:released|distributed|available|provided|offered|published)\s+under\b|warranty|redistribution|\bCC[^\p{L}\p{N}]+BY\b|\bCC0\b|public domain|\bMPL\b|use,? reproduction"
_WORD = re.compile(r"[^\W_]+")
#: Marks between two words that end a sentence: a stop before white space, a colon at a line's end, a line without words.
_STOP = re.compile(r"[.!?]\s|:\s*\n|\n[^\n]*\n")
#: Comment marks that are words, at the beginning of a line.
_MARK = re.compile(r"^[ \t]*(?:dnl|rem)(?=[ \t]|$)", re.M)


def _words(sentence: str) -> str:
    """Lower case, runs of anything but letters and digits as one space, none at the ends."""
    return " ".join(_WORD.findall(sentence.lower()))


def _dictionary(sentences: dict[str, str]) -> list[tuple[str, str, bool]]:
    """(identifier, words, must it stand alone); the variants of the identifiers in ``sentences`` come with them."""
    known = {(k, _words(s), k.endswith(ALONE)): None for k, s in sentences.items()}
    known |= {(k, _words(s), False): None for k, s in VARIANTS if k in sentences}
    known |= {(k, _words(s), True): None for k, s in BEGINNINGS if k in sentences}
    return [x for x in known if x[1]]


def automaton(known: list[tuple[str, str, bool]]):
    """Finds all known sentences of a text in one pass."""
    import ahocorasick

    out, entries = ahocorasick.Automaton(), {}
    for x in known:
        entries.setdefault(f" {x[1]} ", []).append(x)
    for words, own in entries.items():
        out.add_word(words, own)
    out.make_automaton()
    return out


def find_sentences(text: str, known, named: bool = True) -> list[tuple[int, str]]:
    """(number of the first word, identifier) of each known sentence in the text, in order; ``known`` is an
    :func:`automaton`, ``named`` adds sentences and tags that name a licence.

    Words are compared, so case, punctuation, line breaks and comment marks do not matter. A sentence that must stand
    alone begins a line or sentence, ends one, and has no other sentence's end inside.
    """
    text = _MARK.sub("", text.lower())
    spans = [m.span() for m in _WORD.finditer(text)]
    joined = " " + " ".join(text[a:b] for a, b in spans) + " "
    starts, at = [], 0
    for a, b in spans:
        starts.append(at)
        at += b - a + 1

    def gap(k: int) -> str:  # what stands before word k
        return text[spans[k - 1][1] if k else 0 : spans[k][0] if k < len(spans) else len(text)]

    def ends(k: int) -> bool:
        return k == 0 or k == len(spans) or "\n" in gap(k) or bool(_STOP.search(gap(k)))

    found = set()
    for end, entries in known.iter(joined):
        for name, words, alone in entries:
            k = bisect.bisect_left(starts, end - len(words) - 1)
            n = words.count(" ") + 1
            if not alone or (ends(k) and ends(k + n) and not any(_STOP.search(gap(i)) for i in range(k + 1, k + n))):
                found.add((k, name))
    if named:
        words = joined.split()
        for m in _LEAD.finditer(joined):
            k = bisect.bisect_left(starts, m.start())  # the verb
            first = next((i for i in range(k, max(-1, k - SUBJECT_WORDS - 1), -1) if ends(i)), None)
            subject = words[first:k] if first is not None else ["none"]
            granted = not subject or subject[-1] in _ENDS_SUBJECT or subject[0] == "copyright"
            if granted and not _DENIED & set(subject) and (hit := _name_at(words, bisect.bisect_left(starts, m.end() - 1))):
                found.add((first, f"{hit[0]}-named-notice"))
        for m in _TAG.finditer(text):
            k = bisect.bisect_left(spans, (m.start(), 0))
            tags = read_expression(m[1])
            if tags:
                found |= {(k, f"{x}-tag-notice") for x in tags}
                continue
            value = [w for w in _WORD.findall(m[1]) if w not in ("osi", "approved", "the")]
            hit = _name_at(value, 0)
            if hit and " ".join(value[hit[1] :]) in ("", "license", "licence", "only", "or later", "license or later", "license only"):
                found.add((k, f"{hit[0]}-named-notice"))
    return sorted(found)


def sentence_ids(df: DataFrame, id_col: str, text_col: str, sentences: dict[str, str] = SENTENCES) -> DataFrame:
    """``(id, ids)``: the known sentences of each whole text in order, for the texts that have any.

    Wrapped sentences, sentences below a heading or a copyright line and those in comments are found as they are in
    plain text (see :func:`find_sentences`).
    """
    listed, named = _dictionary(sentences), sentences is SENTENCES
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(ANCHOR)) if sentences is SENTENCES else df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def start():
        known = automaton(listed) if listed else None

        def work(values):
            return {"_hits": [",".join(f"{k}:{name}" for k, name in find_sentences(t or "", known, named)) if known else "" for t in values]}

        return work

    hits = append_columns(texts, "text", [("_hits", T.StringType())], start).where("_hits <> ''")
    hits = hits.select("id", F.explode(F.split("_hits", ",")).alias("h"))
    hits = hits.select("id", F.struct(F.split_part("h", F.lit(":"), F.lit(1)).cast("int").alias("pos"), F.split_part("h", F.lit(":"), F.lit(2)).alias("sentence_id")).alias("hit"))
    return hits.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("hit")), lambda h: h["sentence_id"]).alias("ids"))


def _in_order(ids: Column, rule: list[str], unless: str | None = None) -> Column:
    """Does ``ids`` hold the rule's identifiers in this order: a fold that counts how far the rule has come. One that is
    complete goes back to none at ``unless``, until its first identifier comes again."""
    n, wanted = len(rule), F.array(*[F.lit(x) for x in rule])

    def step(k, x):
        on = F.when((k < n) & (x == F.get(wanted, k)), k + 1)
        if unless:
            on = on.when((k == n) & (x == unless), 0).when((k == n) & (x == rule[0]), n + 1)
        return on.otherwise(k)

    return F.aggregate(ids, F.lit(0), step) >= n


def licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """``(id, license, rule, n_sentences)``: a row for each licence of each text that has one, by its first rule that holds.

    Null and empty texts have none; rows that share an id are read as one text's parts; a null id is an id of its own;
    no rows give no rows; other columns do not matter; a text of any length is searched whole. A licence's full text
    that shows how to apply it has the licence of that notice too. The sentences and rules are fixed lists. A BSD text
    with the third clause is not also one without it.
    """
    found = sentence_ids(df, id_col, text_col, sentences)
    hits = F.array(*[F.when(_in_order(F.col("ids"), seq, UNLESS.get(name)), F.struct(F.lit(k).alias("k"), F.lit(lic).alias("license"), F.lit(name).alias("rule"), F.lit(len(seq)).cast("long").alias("n_sentences"))) for k, (name, lic, seq) in enumerate(rules)])
    each = found.select("id", F.explode(F.array_compact(hits)).alias("h")).select("id", "h.*")
    first = each.groupBy("id", "license").agg(F.min_by(F.struct("rule", "n_sentences"), "k").alias("r"))
    return first.select(F.col("id").alias(id_col), "license", "r.rule", "r.n_sentences")
