"""Licence recognition by sentence rules.

A text is cut into sentences, each normalised to its words and numbers, so that marks, blanks, line
ends and comment signs do not matter; those that are known
licence sentences become identifiers. A document is then a short sequence of identifiers, which is
matched against rules: ordered sequences of identifiers, each naming a licence.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import Step, with_arrow

#: Sentences of public licences and notices, by identifier.
SENTENCES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-2.0-compliance": "you may not use this file except in compliance with the License",
    "apache-2.0-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-2.0-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-notice": "Released under the MIT License",
    "mit-notice-2": "Licensed under the MIT License",
    "mit-notice-3": "This project is licensed under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-notice": "Licensed under the ISC License",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense-opening": "This is free and unencumbered software released into the public domain",
    "bsd-permit": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd-notice": "Licensed under the BSD License",
    "bsd-3-notice": "Licensed under the 3-Clause BSD License",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3-notice-2": "Licensed under the GNU General Public License, version 3",
    "gpl-2-notice": "This work is licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-merchant": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-notice": "This work is licensed under the GNU Lesser General Public License, version 3",
    "lgpl-2.1-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "agpl-notice": "This work is licensed under the GNU Affero General Public License, version 3",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "epl-2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-sa-4-notice": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nd-4-notice": "Licensed under CC BY-ND 4.0",
    "cc-by-4-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0-notice": "Released under CC0 1.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-bsd-2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-bsd-3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-gpl-2": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-gpl-3": "SPDX-License-Identifier: GPL-3.0-only",
    "public-domain": "This work is in the public domain",
    "all-rights": "All rights reserved",
}
#: Rules as (licence, identifiers in their order).
RULES = (
    ("Apache-2.0", ("apache-2.0-notice",)),
    ("Apache-2.0", ("apache-2.0-header", "apache-2.0-compliance")),
    ("Apache-2.0", ("apache-2.0-compliance", "apache-2.0-copy")),
    ("Apache-2.0", ("apache-2.0-header", "apache-2.0-compliance", "apache-2.0-copy", "apache-2.0-warranty", "apache-2.0-see")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("MIT", ("mit-notice-3",)),
    ("MIT", ("mit-condition",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-notice",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("Unlicense", ("unlicense-opening",)),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-permit", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-permit", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD", ("bsd-notice",)),
    ("BSD-3-Clause", ("bsd-3-notice",)),
    ("GPL-3.0", ("gpl-3-notice",)),
    ("GPL-3.0", ("gpl-3-notice-2",)),
    ("GPL-3.0", ("gpl-free",)),
    ("GPL-3.0", ("gpl-free", "gpl-warranty", "gpl-merchant")),
    ("GPL-2.0", ("gpl-2-notice",)),
    ("GPL-2.0", ("gpl-2-free",)),
    ("GPL-2.0", ("gpl-2-free", "gpl-warranty", "gpl-merchant")),
    ("LGPL-3.0", ("lgpl-notice",)),
    ("LGPL-2.1", ("lgpl-2.1-free",)),
    ("AGPL-3.0", ("agpl-notice",)),
    ("AGPL-3.0", ("agpl-free",)),
    ("MPL-2.0", ("mpl-2-notice",)),
    ("MPL-2.0", ("mpl-2-notice", "mpl-2-copy")),
    ("EPL-2.0", ("epl-2-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-work",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache-2.0",)),
    ("BSD-2-Clause", ("spdx-bsd-2",)),
    ("BSD-3-Clause", ("spdx-bsd-3",)),
    ("GPL-2.0", ("spdx-gpl-2",)),
    ("GPL-3.0", ("spdx-gpl-3",)),
    ("Public domain", ("public-domain",)),
    ("Proprietary", ("all-rights",)),
)
#: Licences that other licences' texts also speak of; they count only where no other licence is found.
WEAK = ("Proprietary",)
#: A sentence ends at its mark before white space, or at a line end that no lower-case word continues.
BOUNDARY = re.compile(r"(?<=[.!?;:])\s+|,\s*(?=you may not)|\n\s*\n|\n(?![ \t]*[a-z])")
PART = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*")
_HITS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("id", T.StringType())]))


def sentence_hits(docs: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``hits``: code point ranges and identifiers of the known sentences, in text order.

    Line ends, comment signs at wrapped lines and marks such as the one of ``v. 2.0`` cut sentences too,
    so parts that follow each other are joined as long as a known sentence begins with them; the
    longest that is known whole is the hit.
    """
    known = {tuple(PART.findall(s.lower())): i for i, s in (sentences or SENTENCES).items()}
    most = max(map(len, known), default=0)
    firsts = {k[0] for k in known if k}
    begun = {k[:n] for k in known for n in range(1, len(k) + 1)}

    def fn(texts: pa.Array) -> list[pa.Array]:
        out = []
        for t in texts.to_pylist():
            parts, at = [], 0
            for m in [*BOUNDARY.finditer(t or ""), None]:
                end, after = (m.start(), m.end()) if m else (len(t or ""), 0)
                if at < end:
                    parts.append((at, end))
                at = after
            hits, i = [], 0
            while i < len(parts):
                whole, past = None, i + 1
                first = PART.search(t, *parts[i])
                if first and first.group().lower() in firsts:
                    words: tuple[str, ...] = ()
                    for j in range(i, len(parts)):
                        # one word more than any known sentence has is enough to tell; blanks and signs do not count
                        more = islice(PART.finditer(t, *parts[j]), most + 1 - len(words))
                        words += tuple(m.group().lower() for m in more)
                        if words not in begun:
                            break
                        if words in known:
                            whole, past = {"begin": parts[i][0], "end": parts[j][1], "id": known[words]}, j + 1
                if whole:
                    hits.append(whole)
                i = past
            out.append(hits)
        return [pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("id", pa.string())])))]

    return with_arrow(docs, Step((text,), (T.StructField("hits", _HITS),), fn), keep=None if keep is None else [*keep, "hits"])


def _in_order(ids: str, rule: tuple[str, ...]) -> Column:
    """True if the array column holds the rule's identifiers in this order, others between them or not."""
    steps = F.array(*[F.lit(r) for r in rule])
    done = F.aggregate(F.col(ids), F.lit(0), lambda k, x: F.when(F.get(steps, k) == x, k + 1).otherwise(k))
    return done == len(rule)


def _within(short: tuple[str, ...], long: tuple[str, ...]) -> bool:
    """True if the identifiers of ``short`` are some of ``long``'s, in the same order."""
    rest = iter(long)
    return len(short) < len(long) and all(x in rest for x in short)


def scan(docs: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules: tuple = RULES, weak: tuple = WEAK, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``hits``, ``sentence_ids`` (their identifiers in order) and ``licences``, sorted and distinct.

    A rule that fits gives way to any other that fits and holds all its identifiers in their order, so
    that the three-clause text is not the two-clause one as well. ``weak`` licences are named where no
    other is. Null and empty texts, and texts without a known sentence, have empty arrays. Sentences
    of any length are read; a repeated sentence is a hit each time, a licence is named once. Repeated
    rows are scanned each by itself, an empty table gives no rows, and columns called like the
    results give way to them.
    """
    keep = None if keep is None else [c for c in keep if c.lower() not in ("sentence_ids", "licences")]
    found = sentence_hits(docs.drop("sentence_ids", "licences"), text, sentences, keep).withColumn("sentence_ids", F.col("hits.id"))
    fits = [_in_order("sentence_ids", ids) for _, ids in rules]
    named = []
    for (name, ids), fit in zip(rules, fits, strict=True):
        for (other, more), above in zip(rules, fits, strict=True):
            if other != name and _within(ids, more):
                fit = fit & ~above
        named.append(F.when(fit, F.lit(name)))
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_distinct(F.array_compact(F.array(*named))))
    strong = F.filter(every, lambda x: ~x.isin(*weak)) if weak else every
    best = F.element_at(F.transform(F.array(F.struct(every.alias("every"), strong.alias("strong"))), lambda s: F.when(F.size(s["strong"]) > 0, s["strong"]).otherwise(s["every"])), 1)
    return found.withColumn("licences", F.when(F.size("hits") > 0, best).otherwise(none))
