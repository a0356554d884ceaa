"""Licence scans: lines and windows of whole texts against licence templates by Dice coefficient over word bigrams.

Normalised: everything but A-Z, a-z and 0-9 becomes one space, then lower case.  With ``a`` bigrams in a line or window and
``b`` in a template, Dice = 2 * common / (a + b) can reach ``t`` only if min(a, b) >= t / (2 - t) * max(a, b); templates
outside that bound are never compared.  Only DataFrame functions run; the template table is a constant.

Each line is compared as a whole.  Windows over the words of the whole text, line ends aside, begin and end with a bigram of
the template, so that wrapped notices and those inside of prose are found too.  Of overlapping candidates the one of greatest
Dice stays (lines first, then longer ones); a window inside of a line that reaches the threshold gives way to the line.
The SQL form states the whole lines only.

Defined results: null and empty texts give no rows; a text of fewer than two words has no bigram and never matches;
lines are numbered from 1; of equally good templates the name that sorts first wins; repeated rows give repeated rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import table

#: Dice coefficient from which a line or window counts as a template's.
THRESHOLD = 0.75

# Well-known licence notices and sentences of public licence texts.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal into the public domain."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def template_rows() -> list[tuple[str, int, list[str]]]:
    """(licence, template number, its distinct bigrams)."""
    out = []
    for name, texts in sorted(TEMPLATES.items()):
        for text in texts:
            words = re.sub("[^A-Za-z0-9]+", " ", text).strip().lower().split(" ")
            out.append((name, len(out), list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))))
    return out


def signs(threshold: float) -> list[str]:
    """Substrings of normalised texts: whatever reaches ``threshold`` with a template holds at least one of them.

    Such a line or window holds ``share`` of the template's bigrams, so one of more than the others holds a sign.
    """
    share, out = threshold / 2 * (1 + threshold / (2 - threshold)), []
    for _, _, own in template_rows():
        spare = len(own) - math.ceil(share * len(own) - 1e-9)
        open_ = [b for b in own if not any(s in b for s in out)]
        while len(own) - len(open_) <= spare:
            word = max((w for b in open_ for w in b.split(" ")), key=lambda w: (len(w), w))
            out.append(word if len(word) >= 7 else open_[0])
            open_ = [b for b in open_ if out[-1] not in b]
    return out


def normal(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))


def bigrams(w: Column) -> Column:
    return F.transform(F.slice(w, F.lit(2), F.size(w)), lambda x, i: F.concat_ws(" ", w[i], x))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def notices(text: Column, threshold: float) -> Column:
    """The notices of a text: array of (minus: -Dice, ..., license, line_no)."""
    rows = template_rows()
    sizes = [len(r[2]) for r in rows]
    slack = threshold / (2 - threshold)
    known = sorted({b for r in rows for b in r[2]})
    templates = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(k).alias("template"), F.array(*map(F.lit, own)).alias("bigrams")) for name, k, own in rows])
    minus = lambda common, a, b: -F.round(2 * common / (a + b), 6)
    fits = lambda a, b: F.least(a, b) >= slack * F.greatest(a, b)

    def candidate(minus, kind, first, last, license, template, line_no):
        """In the order of choice: Dice, lines before windows, longer ones, names; ``first`` and ``last`` are words."""
        return F.struct(minus.alias("minus"), F.lit(kind).alias("kind"), (first - last).alias("short"), license.alias("license"), template.alias("template"), first.alias("first"), last.alias("last"), line_no.alias("line_no"))

    def best_template(own):
        a = F.size(own)
        scored = F.transform(
            F.filter(templates, lambda t: fits(a, F.size(t["bigrams"]))),
            lambda t: F.struct(minus(F.size(F.array_intersect(own, t["bigrams"])), a, F.size(t["bigrams"])).alias("minus"), t["license"].alias("license"), t["template"].alias("template"), t["bigrams"].alias("bigrams")),
        )
        # common >= t / 2 * (a + b) and b >= slack * a: so many of the line's bigrams must be in some template
        possible = a.between(min(sizes) * slack, max(sizes) / slack) & (F.size(F.filter(own, lambda b: b.isin(known))) >= threshold / 2 * (1 + slack) * a)
        return F.when(possible, F.array_min(scored))

    def of_lines(lines, line_of, hits):
        scored = F.transform(lines, lambda w, i: F.struct((i + 1).alias("line_no"), let(F.array_distinct(bigrams(w)), best_template).alias("best")))

        def placed(c):
            at = F.transform(F.filter(hits, lambda h: (line_of[h["at"]] == c["line_no"]) & (line_of[h["at"] + 1] == c["line_no"]) & F.array_contains(c["best"]["bigrams"], h["bigram"])), lambda h: h["at"])
            return let(at, lambda p: candidate(c["best"]["minus"], 0, p[0], F.element_at(p, -1) + 1, c["best"]["license"], c["best"]["template"], c["line_no"]))

        return F.transform(F.filter(scored, lambda c: -c["best"]["minus"] >= threshold), placed)

    def of_windows(all_, line_of, hits):
        def windows(t, own):
            b = F.size(t["bigrams"])

            def ending(h, k, g, n):
                length = g["at"] - h["at"] + 1
                a = F.size(F.array_distinct(F.slice(all_, h["at"] + 1, length)))
                common = F.size(F.array_distinct(F.transform(F.slice(own, k + 1, n + 1), lambda x: x["bigram"])))
                enough = (n + 1 >= threshold / 2 * (1 + slack) * b - 1e-9) & (length <= 2 * b / slack)
                dice = F.when(enough, let(F.struct(a.alias("a"), common.alias("c")), lambda v: F.when(fits(v["a"], b), minus(v["c"], v["a"], b))))
                return candidate(dice, 1, h["at"], g["at"] + 1, t["license"], t["template"], line_of[h["at"]])

            # a window has at most b / slack distinct bigrams; twice that leaves room for repeated ones
            from_ = lambda h, k: F.filter(F.transform(F.slice(own, k + 1, F.floor(2 * b / slack).cast("int")), lambda g, n: ending(h, k, g, n)), lambda c: -c["minus"] >= threshold)
            return F.flatten(F.transform(own, from_))

        own = lambda t: F.filter(hits, lambda h: F.array_contains(t["bigrams"], h["bigram"]))
        return F.flatten(F.transform(templates, lambda t: let(own(t), lambda o: windows(t, o))))

    def chosen(all_, line_of, hits, lines):
        def pick(found):
            return let(F.array_sort(found), lambda c: F.aggregate(c, F.slice(c, 1, 0), lambda taken, x: F.when(F.exists(taken, lambda o: (o["first"] <= x["last"]) & (x["first"] <= o["last"])), taken).otherwise(F.concat(taken, F.array(x)))))

        within = lambda c, o: (c["first"] <= o["last"]) & (o["first"] <= c["last"]) & (line_of[c["first"]] == o["line_no"]) & (line_of[c["last"]] == o["line_no"])
        return let(of_lines(lines, line_of, hits), lambda whole: pick(F.concat(whole, F.filter(of_windows(all_, line_of, hits), lambda c: ~F.exists(whole, lambda o: within(c, o))))))

    hits_of = lambda all_: F.filter(F.transform(all_, lambda b, i: F.struct(i.alias("at"), b.alias("bigram"))), lambda h: h["bigram"].isin(known))
    lines_of = F.transform(F.split(text, "\n"), lambda line: F.filter(F.split(normal(line), " "), lambda w: w != ""))
    numbers = lambda lines: F.flatten(F.transform(lines, lambda w, i: F.array_repeat(i + 1, F.size(w))))
    of_bigrams = lambda lines, all_: let(numbers(lines), lambda line_of: let(hits_of(all_), lambda hits: chosen(all_, line_of, hits, lines)))
    return let(lines_of, lambda lines: let(F.flatten(lines), lambda w: let(bigrams(w), lambda all_: of_bigrams(lines, all_))))


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, line_no, license, dice): the notices of each text, with the line on which they begin."""
    marks = F.array(*map(F.lit, signs(threshold)))
    able = docs.select("doc_id", "text").where(let(normal(F.col("text")), lambda t: F.exists(marks, lambda m: t.contains(m))))
    found = able.select("doc_id", F.explode(notices(F.col("text"), threshold)).alias("n"))
    return found.select("doc_id", F.col("n.line_no").alias("line_no"), F.col("n.license").alias("license"), (-F.col("n.minus")).alias("dice"))


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence notices of all whole documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_sql() -> str:
    values = ", ".join(f"('{b}', '{name}', {k}, {len(own)})" for name, k, own in template_rows() for b in own)
    slack = THRESHOLD / (2 - THRESHOLD)
    return f"""
    WITH templates(bigram, license, template, b) AS (VALUES {values}),
    lines AS (
      SELECT row_number() OVER () AS line_id, doc_id, line_no, line
      FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)
    ),
    words AS (SELECT line_id, doc_id, line_no, list_filter(string_split(lower(regexp_replace(line, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM lines),
    pairs AS (SELECT DISTINCT line_id, doc_id, line_no, w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT *, unnest(range(1, len(w))) AS i FROM words)),
    sized AS (SELECT *, count(*) OVER (PARTITION BY line_id) AS a FROM pairs),
    hits AS (
      SELECT line_id, doc_id, line_no, license, template, round(2.0 * count(*) / (a + b), 6) AS dice
      FROM sized JOIN templates USING (bigram)
      WHERE least(a, b) >= {slack!r} * greatest(a, b)
      GROUP BY line_id, doc_id, line_no, license, template, a, b
    )
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, license, CAST(dice AS DOUBLE) AS dice
    FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY dice DESC, license, template) AS k FROM hits WHERE dice >= {THRESHOLD})
    WHERE k = 1
    """
