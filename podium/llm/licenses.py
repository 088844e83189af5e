"""Licence scans: lines, paragraphs, whole texts and runs of words against licence templates.

A unit of text and a template are compared by the Dice coefficient of their sets of word bigrams.
Since 2 * min(a, b) / (a + b) bounds it from above, only templates of a size near the unit's are
candidates. Licences that no unit has are sought in the runs of a template's number of words, wherever
they lie in the text. All of it is one expression on the row of a document; nothing is shuffled.
"""

import json

from pyspark.sql import functions as F

THRESHOLD = 0.8
MARK = r"^[ \t]*(?:/\*+|\*+/|\*+|//+!?|#+|;+|--+|%+|<!--|dnl\b|REM\b)[ \t]*"

# The grant that all BSD licences share tells none of them; it gives way to a member's own words.
MEMBERS = {"BSD": ("BSD-2-Clause", "BSD-3-Clause")}

_GNU = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the "
    "GNU {2} General Public License as published by the Free Software Foundation{3} either version "
    "{4} of the License, or (at your option) any later version."
)
_MIT_NOTICE = (
    "The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
_BSD_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission."
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
    "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)

# Names of licences and the words of their public notices and texts.
TEMPLATES = (
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "short notice", "Licensed under the MIT License"),
    ("MIT", "project notice", "This project is licensed under the MIT License"),
    (
        "MIT",
        "grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    ),
    (
        "MIT",
        "disclaimer",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "GPL-3.0",
        "notice",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    ("GPL-3.0", "short notice", "Licensed under the GNU General Public License v3.0"),
    (
        "GPL-3.0",
        "header",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "header",
        "This program is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "notice",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ),
    (
        "AGPL-3.0",
        "notice",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ),
    (
        "MPL-2.0",
        "header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
    (
        "BSD",
        "grant",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
    ),
    ("BSD-3-Clause", "notice", "Released under the BSD 3-Clause License."),
    (
        "ISC",
        "grant",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    (
        "Unlicense",
        "grant",
        "This is free and unencumbered software released into the public domain. Anyone is free "
        "to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ),
    ("CC0-1.0", "notice", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "notice", "Licensed under CC BY-ND 4.0."),
    (
        "CC-BY-4.0",
        "work notice",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    ("AGPL-3.0", "header", _GNU.format("program", ":", "Affero", ",", "3")),
    ("LGPL-3.0", "header", _GNU.format("program", ":", "Lesser", ",", "3")),
    ("LGPL-3.0", "library header", _GNU.format("library", ":", "Lesser", ",", "3")),
    ("LGPL-2.1", "header", _GNU.format("library", ";", "Lesser", ";", "2.1")),
    ("LGPL-2.0", "header", _GNU.format("library", ";", "Library", ";", "2")),
    (
        "GPL-2.0",
        "notice",
        "This work is licensed under the GNU General Public License, version 2.",
    ),
    (
        "LGPL-2.1",
        "notice",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    ("BSD-2-Clause", "notice", "Released under the BSD 2-Clause License."),
)
_BODY = {(name, title): body for name, title, body in TEMPLATES}
TEMPLATES += (
    ("MIT", "whole", f"{_BODY['MIT', 'grant']} {_MIT_NOTICE} {_BODY['MIT', 'disclaimer']}"),
    ("BSD-2-Clause", "whole", f"{_BODY['BSD', 'grant']} {_BSD_CONDITIONS} {_BSD_DISCLAIMER}"),
    (
        "BSD-3-Clause",
        "whole",
        f"{_BODY['BSD', 'grant']} {_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    ),
    ("BSD-3-Clause", "names", _BSD_NAMES),
    ("ISC", "whole", f"{_BODY['ISC', 'grant']} {_ISC_DISCLAIMER}"),
    *(
        (
            f"CC-{short}-4.0",
            "work notice",
            f"This work is licensed under a Creative Commons {words} 4.0 International License.",
        )
        for short, words in (
            ("BY-SA", "Attribution-ShareAlike"),
            ("BY-NC", "Attribution-NonCommercial"),
            ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    ),
)


def normalised(text):
    """Lower case, with one space for all that is neither letter nor digit."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def pairs_in_order(words):
    """The pairs of neighbouring words of an array, as hashes."""
    starts = F.sequence(F.lit(1), F.size(words) - 1)
    pair = F.transform(starts, lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) > 1, pair).otherwise(F.array().cast("array<long>"))


def bigrams(words):
    """The distinct pairs of neighbouring words of an array, as hashes."""
    return F.array_distinct(pairs_in_order(words))


def units(text):
    """The lines, the paragraphs and the whole of a text, each different one once.

    Paragraphs are cut once more without comment marks, where lines of marks alone part them.
    """
    mark = "(?dm)" + MARK  # lines end with a line feed alone
    bare = F.split(F.regexp_replace(text, mark, ""), "\n[ \t]*\n")
    bare = F.when(text.rlike(mark + "$"), bare).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \t]*\n"), bare, F.array(text)))


KNOWN_TYPE = (
    "array<struct<order:int,name:string,title:string,size:int,length:int,first:bigint,pairs:array<bigint>>>"
)


def _templates(spark, templates):
    """A constant array of struct(order, name, title, size, length, first, pairs), and all their pairs.

    Templates of one word or none agree with nothing and are left out.
    """
    texts = F.array(*(F.lit(text) for _, _, text in templates))
    words = F.transform(texts, lambda t: F.split(normalised(t), " "))
    found = spark.range(1).select(F.transform(words, pairs_in_order).alias("pairs")).first()["pairs"]
    known = []
    for number, ((name, title, _), ordered) in enumerate(zip(templates, found, strict=True)):
        pairs = list(dict.fromkeys(ordered))
        if pairs:
            known.append(
                {
                    "order": -number, "name": name, "title": title, "size": len(pairs),
                    "length": len(ordered), "first": pairs[0], "pairs": pairs,
                }
            )
    every = sorted({p for t in known for p in t["pairs"]})
    # One text each, read once when the plan is made.
    return F.from_json(F.lit(json.dumps(known)), KNOWN_TYPE), F.from_json(F.lit(json.dumps(every)), "array<bigint>")


def _own(found):
    """The licences found, without general names where one of their members is found too."""
    for general, members in MEMBERS.items():
        names = F.transform(found, lambda m: m["name"])
        member = F.arrays_overlap(names, F.array(*map(F.lit, members)))
        found = F.filter(found, lambda m: (m["name"] != F.lit(general)) | ~member)
    return found


HIT_TYPE = "dice:double,order:int,name:string,title:string"
LAST = f"struct<start:int,stop:int,common:int,{HIT_TYPE}>"
STATE = f"struct<last:{LAST},found:array<struct<{HIT_TYPE}>>>"


STEPS = 16  # places a template's length is sought at within a stretch of its pairs


def _enough(common, t, threshold):
    """Whether ``common`` shared pairs can make a set agree with a template.

    The set has at least the pairs it shares, so 2 * common / (common + size) bounds its Dice.
    """
    return F.lit(2.0) * common >= threshold * (common + t["size"])


def _run_hits(pairs, shared, near, threshold):
    """Runs of ``pairs``, those of a text in order, that agree with a template: an array of hits.

    ``shared`` are the distinct ones among them that any template has, ``near`` the templates that the
    text shares enough with. A run has as many words as the template. It begins where a stretch of the
    template's pairs begins, at its first pair, and in stretches wherever the place is a multiple of a
    16th of its length; near the end of the text it ends the text.
    """
    n = F.size(pairs)

    def at(t, i):
        run = F.array_distinct(F.slice(pairs, i, t["length"]))
        common = F.size(F.array_intersect(run, t["pairs"]))
        return F.struct(
            i.alias("start"),
            (i + t["length"]).alias("stop"),
            common.alias("common"),
            (F.lit(2.0) * common / (F.size(run) + t["size"])).alias("dice"),
            t["order"].alias("order"),
            t["name"].alias("name"),
            t["title"].alias("title"),
        )

    def found(marks):
        """The hits of all templates, the places of pairs that any template has being known."""

        def hits(t):
            step = F.greatest(F.floor(t["length"] / STEPS), F.lit(1)).cast("int")
            last = n - t["length"] + 1
            # Sharing fewer pairs, a run cannot agree; so many places of its pairs must lie in it.
            least = F.ceil(threshold * t["size"] / (2 - threshold) - 1e-9).cast("int")

            def of(own):
                def begins(j):
                    i = F.element_at(own, j)
                    starts = (j == 1) | (F.element_at(own, F.greatest(j - 1, F.lit(1))) != i - 1)
                    starts = starts | (F.element_at(pairs, i) == t["first"]) | (F.pmod(i, step) == 0)
                    far = F.least(j + least - 1, F.size(own))
                    full = (far == j + least - 1) & (F.element_at(own, far) < i + t["length"])
                    return starts & ((i > last) | full)

                some = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own)))
                some = F.coalesce(some, F.array().cast("array<int>"))
                places = F.transform(F.filter(some, begins), lambda j: F.least(F.element_at(own, j), last))
                places = F.transform(F.array_distinct(places), lambda i: at(t, i))
                return F.filter(places, lambda h: h["dice"] >= threshold)

            own = F.filter(marks, lambda i: F.array_contains(t["pairs"], F.element_at(pairs, i)))
            return F.transform(F.array(own), of)[0]

        fitting = F.filter(near, lambda t: n >= t["length"])
        return F.flatten(F.transform(fitting, hits))

    marks = F.filter(F.sequence(F.lit(1), n), lambda i: F.array_contains(shared, F.element_at(pairs, i)))
    return F.transform(F.array(marks), found)[0]


def _run_licences(hits):
    """The best hit of each licence. Of two that overlap by half of the shorter, one counts.

    That is the one with more pairs in common, then the higher Dice, then the earlier template.
    """
    def worth(h):
        return F.struct(h["common"], h["dice"], h["order"])

    def add(found, h):
        brief = F.struct(h["dice"], h["order"], h["name"], h["title"]).cast(f"struct<{HIT_TYPE}>")
        better = F.exists(found, lambda f: (f["name"] == h["name"]) & (f["dice"] >= h["dice"]))
        others = F.filter(found, lambda f: f["name"] != h["name"])
        return F.when(better, found).otherwise(F.concat(others, F.array(brief)))

    def step(state, h):
        last, found = state["last"], state["found"]
        both = F.least(last["stop"], h["stop"]) - F.greatest(last["start"], h["start"])
        clash = last.isNotNull() & (
            2 * both >= F.least(last["stop"] - last["start"], h["stop"] - h["start"])
        )
        better = F.when(worth(h) > worth(last), h).otherwise(last)
        return F.struct(
            F.when(clash, better).otherwise(h).alias("last"),
            F.when(clash | last.isNull(), found).otherwise(add(found, last)).alias("found"),
        ).cast(STATE)

    start = F.struct(
        F.lit(None).cast(LAST).alias("last"), F.array().cast(f"array<struct<{HIT_TYPE}>>").alias("found")
    ).cast(STATE)
    return F.aggregate(
        F.array_sort(hits),
        start,
        step,
        lambda s: F.when(s["last"].isNull(), s["found"]).otherwise(add(s["found"], s["last"])),
    )


def dice_scan(docs, templates=TEMPLATES, threshold=THRESHOLD):
    """The licences found in each row of ``docs`` (doc_id, text).

    A unit has the licence of the template it agrees with best (the earlier among equals), if that
    is by at least ``threshold``. license, template and dice are those of the best unit, licenses
    the names of all units, sorted and joined by commas, n_units the number of such units that
    differ in their bigrams. A licence that no unit has counts with the best run that has it, as one
    more unit. Without any, and for null and empty texts, they are null, null, null,
    empty and 0. Repeated rows are each answered; an empty table gives no rows.
    """
    known, every_pair = _templates(docs.sparkSession, templates)

    def best(near, pairs):
        def dice(common, t):
            return F.lit(2.0) * common / (F.size(pairs) + t["size"])

        # No template agrees better than if the smaller set were part of the larger one.
        near = F.filter(near, lambda t: dice(F.least(F.size(pairs), t["size"]), t) >= threshold)
        compared = F.transform(
            near,
            lambda t: F.struct(
                dice(F.size(F.array_intersect(pairs, t["pairs"])), t).alias("dice"),
                t["order"].alias("order"),
                t["name"].alias("name"),
                t["title"].alias("title"),
            ),
        )
        return F.array_max(F.filter(compared, lambda c: c["dice"] >= threshold))

    def in_order(text):
        # Bound to a name: within the lambda an expression would be computed again for every word.
        return F.transform(F.array(F.split(normalised(text), " ")), pairs_in_order)[0]

    text = F.col("text")
    rows = docs.select("doc_id", "text", in_order(text).alias("pairs"))
    # All pairs of a unit are pairs of the text, but where a comment mark is a word.
    bare = F.regexp_replace(text, "(?dm)" + MARK, "")
    more = F.when(text.rlike(r"(?dm)^[ \t]*(?:dnl|REM)\b"), in_order(bare)).otherwise(F.array().cast("array<long>"))
    rows = rows.select("doc_id", "text", "pairs", F.array_intersect(F.concat("pairs", more), every_pair).alias("shared"))
    near = F.filter(known, lambda t: _enough(F.size("shared"), t, threshold))
    near = F.filter(near, lambda t: _enough(F.size(F.array_intersect("shared", t["pairs"])), t, threshold))
    rows = rows.select("doc_id", "text", "pairs", "shared", near.alias("near"))
    # A text that shares too little with every template as a whole has no unit or run that agrees.
    any_near = F.size("near") > 0
    words = F.transform(units(text), lambda u: F.split(normalised(u), " "))
    each = F.array_distinct(F.transform(words, bigrams))
    hits = _run_hits(F.col("pairs"), F.col("shared"), F.col("near"), threshold)
    rows = rows.select(
        "doc_id", "near", F.when(any_near, each).alias("units"), F.when(any_near, hits).alias("hits")
    )
    found = rows.select("doc_id", F.transform("units", lambda u: best(F.col("near"), u)).alias("by_unit"), _run_licences(F.col("hits")).alias("by_run"))
    found = found.select("doc_id", F.filter("by_unit", lambda m: m.isNotNull()).alias("by_unit"), "by_run")
    named = F.transform("by_unit", lambda m: m["name"])
    more = F.filter("by_run", lambda m: ~F.array_contains(named, m["name"]))
    more = F.when(F.size("by_run") > 0, more).otherwise(F.array().cast(f"array<struct<{HIT_TYPE}>>"))
    found = found.select("doc_id", F.concat("by_unit", more).alias("by_unit"))
    found = found.select("doc_id", _own("by_unit").alias("by_unit"))
    every = found.select("doc_id", "by_unit", F.array_max("by_unit").alias("best"))
    names = F.array_sort(F.array_distinct(F.transform("by_unit", lambda m: m["name"])))
    return every.select(
        "doc_id",
        F.col("best.name").alias("license"),
        F.col("best.title").alias("template"),
        F.col("best.dice").alias("dice"),
        F.coalesce(F.array_join(names, ","), F.lit("")).alias("licenses"),
        F.coalesce(F.greatest(F.size("by_unit"), F.lit(0)), F.lit(0)).cast("long").alias("n_units"),
    )
