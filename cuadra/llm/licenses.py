"""License scans by ordered signature rules, in DataFrame functions only.

Rules are regular expressions over the words of a text. A rule is tried only where its family's keyword
occurs. Of overlapping detections, one that lies within another of higher priority, or within a longer one
of the same priority, is suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import columns, let, lower_ascii, table

#: What is no part of a word once A-Z are in lower case.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Contract phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Families: label, keyword that gates them, and how a text may name the license. `{v}` is replaced by each version.
FAMILIES = [
    ("mit", "mit", ["mit", "mit expat", "expat mit"], [""]),
    ("apache", "apache", ["apache", "apache software", "asf apache"], ["", "1 0", "1 1", "2 0", "version 2 0"]),
    ("gpl", "general", ["gnu general public", "general public"], ["", "version 1", "version 2", "version 3", "v2", "v3"]),
    ("gpl", "gpl", ["gpl", "gnu gpl"], ["", "2 0", "3 0", "v2", "v3", "version 2", "version 3"]),
    ("lgpl", "lesser", ["gnu lesser general public", "lesser general public"], ["", "version 2 1", "version 3"]),
    ("lgpl", "lgpl", ["lgpl", "gnu lgpl"], ["", "2 1", "3 0", "v2 1", "v3"]),
    ("agpl", "affero", ["gnu affero general public", "affero general public"], ["", "version 3"]),
    ("agpl", "agpl", ["agpl", "gnu agpl"], ["", "3 0", "v3"]),
    ("bsd", "bsd", ["bsd", "new bsd", "modified bsd", "simplified bsd"], ["", "2 clause", "3 clause", "4 clause"]),
    ("mpl", "mozilla", ["mozilla public"], ["", "version 1 1", "version 2 0", "2 0"]),
    ("mpl", "mpl", ["mpl"], ["1 1", "2 0", "v2"]),
    ("epl", "eclipse", ["eclipse public"], ["", "version 1 0", "version 2 0", "1 0", "2 0"]),
    ("cc", "creative", ["creative commons attribution", "creative commons", "creative commons zero"], ["", "4 0", "3 0", "2 0"]),
    ("cc", "cc", ["cc by", "cc by sa", "cc by nc", "cc by nd", "cc by nc sa"], ["4 0", "3 0", "1 0"]),
    ("cc", "cc0", ["cc0"], ["", "1 0"]),
    ("isc", "isc", ["isc"], [""]),
    ("zlib", "zlib", ["zlib", "zlib libpng"], [""]),
    ("unlicense", "unlicense", ["unlicense", "the unlicense"], [""]),
    ("boost", "boost", ["boost software", "boost"], ["", "1 0", "version 1 0"]),
    ("artistic", "artistic", ["artistic", "perl artistic"], ["", "1 0", "2 0"]),
    ("eupl", "eupl", ["eupl"], ["", "1 1", "1 2"]),
    ("wtfpl", "wtfpl", ["wtfpl"], ["", "2"]),
    ("cddl", "cddl", ["cddl"], ["", "1 0", "1 1"]),
    ("psf", "python", ["python software foundation"], ["", "2 0"]),
    ("psf", "psf", ["psf"], ["", "2 0"]),
    ("ofl", "ofl", ["sil ofl", "ofl"], ["", "1 1"]),
]
#: Shapes of a grant around a license's name, by priority (1 is highest; sentences of a license's own text have 2 to 4).
SHAPES = [
    (1, "spdx license identifier {name}"),
    (5, "(licensed|released|distributed|published|available|provided) under (the )?(terms of )?(the )?{name}( license| licence)?"),
    (6, "(under|to|of|by|in) (the )?{name} (license|licence)"),
    (7, "{name} (license|licence)"),
]


#: Sentences of the licenses' own texts and notices, for texts that name no license: priority, label, keyword, wording.
#: 2: what a license grants or is called in its own text; 3: conditions, warranty and liability; 4: notices that refer to a license.
WORDINGS = [
    (2, "mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (2, "mit", "deal", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    (3, "mit", "substantial", "the above copyright notice and this permission notice (including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    (3, "mit", "noninfringement", "the warranties of merchantability fitness for a particular purpose and noninfringement"),
    (3, "mit", "dealings", "out of or in connection with the software or the use or other dealings in the software"),
    (3, "mit", "advertising", "the name of (the above copyright holders|a copyright holder) shall not be used in advertising or otherwise to promote the sale"),
    (2, "isc", "hereby", "permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    (3, "isc", "disclaims", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    (3, "isc", "disclaims", "isc disclaims all warranties with regard to this software"),
    (3, "isc", "tortious", "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    (2, "bsd", "hereby", "permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    (2, "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    (3, "bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    (3, "bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    (3, "bsd", "endorse", "(contributors|author|university) may (not )?be used to endorse or promote products derived from this software"),
    (3, "bsd", "contributors", "this software is provided by the (copyright holders|regents|authors|author) and contributors as is"),
    (3, "bsd", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    (3, "bsd", "procurement", "procurement of substitute goods or services loss of use data or profits or business interruption"),
    (4, "bsd", "bsd", "use of this source code is governed by a bsd style license"),
    (2, "apache", "hereby", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (copyright|except as stated in this section patent) license"),
    (3, "apache", "prominent", "you must cause any modified files to carry prominent notices stating that you changed the files"),
    (3, "apache", "derivative", "you must give any other recipients of the work or derivative works a copy of this license"),
    (3, "apache", "notice", "if the work includes a notice text file as part of its distribution"),
    (3, "apache", "licensor", "unless required by applicable law or agreed to in writing licensor provides the work"),
    (4, "apache", "compliance", "you may not use this file except in compliance with the license"),
    (4, "apache", "applicable", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    (4, "apache", "apache", "you may obtain a copy of the license at (http|https) www apache org licenses"),
    (4, "apache", "asf", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    (2, "gpl", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    (2, "gpl", "copyleft", "we have designed this general public license to use copyleft"),
    (3, "gpl", "verbatim", "you may (copy and distribute|convey) verbatim copies of the program s source code as you receive it"),
    (3, "gpl", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    (3, "gpl", "affirms", "this license explicitly affirms your unlimited permission to run the unmodified program"),
    (3, "gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    (4, "gpl", "general", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    (4, "gpl", "general", "you should have received a copy of the gnu general public license along with this program"),
    (2, "lgpl", "lesser", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    (2, "lgpl", "lesser", "this license the lesser general public license applies to some specially designated software packages"),
    (3, "lgpl", "combined", "you may convey a combined work under terms of your choice that taken together effectively do not restrict modification"),
    (3, "lgpl", "lesser", "see the gnu lesser general public license for more details"),
    (4, "lgpl", "lesser", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    (4, "lgpl", "lesser", "you should have received a copy of the gnu lesser general public license"),
    (2, "agpl", "affero", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    (3, "agpl", "interacting", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    (3, "agpl", "affero", "see the gnu affero general public license for more details"),
    (4, "agpl", "affero", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    (4, "agpl", "affero", "you should have received a copy of the gnu affero general public license"),
    (2, "mpl", "hereby", "the initial developer hereby grants you a world wide royalty free non exclusive license subject to third party intellectual property claims"),
    (3, "mpl", "covered", "any modifications that you create or to which you contribute must be under the terms of this license covered software"),
    (3, "mpl", "secondary", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    (4, "mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    (4, "mpl", "mozilla", "the contents of this file are subject to the mozilla public license"),
    (4, "mpl", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    (2, "epl", "agreement", "the accompanying program is provided under the terms of this eclipse public license agreement"),
    (3, "epl", "recipient", "each contributor hereby grants recipient a non exclusive worldwide royalty free copyright license"),
    (4, "epl", "eclipse", "made available under the terms of the eclipse public license"),
    (2, "cc", "waived", "has waived all copyright and related or neighboring rights"),
    (2, "cc", "affirmer", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    (3, "cc", "redistribute", "you are free to share copy and redistribute the material in any medium or format"),
    (3, "cc", "appropriate", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    (3, "cc", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    (3, "cc", "commercial", "you may not use the material for commercial purposes"),
    (4, "cc", "creative", "this work is licensed under (a|the) creative commons"),
    (4, "cc", "creativecommons", "to view a copy of this license visit (http|https) creativecommons org licenses"),
    (2, "zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    (3, "zlib", "misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    (3, "zlib", "liable", "in no event will the (authors|author) be held liable for any damages arising from the use of this software"),
    (3, "zlib", "altered", "this notice may not be removed or altered from any source distribution"),
    (2, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    (3, "unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    (3, "unlicense", "relinquishment", "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights"),
    (2, "boost", "hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    (3, "boost", "object", "solely in the form of machine executable object code generated by a source language processor"),
    (4, "boost", "boost", "distributed under the boost software license version 1 0 see accompanying file"),
    (2, "artistic", "intent", "the intent of this document is to state the conditions under which a package may be copied"),
    (2, "artistic", "establishes", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    (3, "artistic", "artistic", "you may distribute the modified version under the terms of the artistic license"),
    (4, "artistic", "perl", "you can redistribute it and or modify it under the same terms as perl itself"),
    (2, "eupl", "european", "european union public (licence|license)"),
    (4, "eupl", "compliance", "you may not use this work except in compliance with the licence"),
    (2, "wtfpl", "verbatim", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    (2, "cddl", "development", "common development and distribution license"),
    (3, "cddl", "contents", "the contents of this file are subject to the terms of the common development and distribution license"),
    (2, "psf", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce"),
    (3, "psf", "psf", "psf is making python available to licensee on an as is basis"),
    (3, "psf", "psf", "psf s license agreement and psf s notice of copyright"),
    (2, "ofl", "font", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    (3, "ofl", "font", "the font software may be modified altered or added to"),
    (3, "ofl", "font", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    (4, "ofl", "reserved", "no modified version of the font software may use the reserved font name"),
]


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern) of every rule, in order; patterns see each word as ` word `."""
    out = []
    for priority, shape in SHAPES:
        for label, keyword, names, versions in FAMILIES:
            for name in names:
                for version in versions:
                    out.append((priority, label, keyword, _spaced(shape.replace("{name}", f"{name} {version}".strip()))))
    out += [(priority, label, keyword, _spaced(wording)) for priority, label, keyword, wording in WORDINGS]
    return sorted(out, key=lambda r: r[0])


def _spaced(shape: str) -> str:
    """A pattern of words as one over text in which every word stands between two spaces of its own."""
    out, word = [], ""
    for c in shape + " ":
        if c.isalnum():
            word += c
            continue
        if word:
            out.append(f" {word} ")
            word = ""
        if c in "()?|":
            out.append("(?:" if c == "(" else c)
    return "".join(out)


RULES = rules()
#: A rule is tried only in texts that hold its keyword as a word; `license` gates the contract's phrases.
KEYWORDS = sorted({keyword for _, _, keyword, _ in RULES} | {"license"})


def plain_words(text: Column) -> Column:
    """The words with one space between them."""
    return F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD, " "))


def _n(spaced: Column) -> Column:
    """How many words a piece of spaced text has."""
    return F.floor((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("int")


def _hits(spaced: Column, pattern: Column, priority: Column, label: Column, rule: Column) -> Column:
    """Every place of a pattern: first word, last word, and the rule."""
    pieces, found = F.split(spaced, pattern, -1), F.regexp_extract_all(spaced, pattern, F.lit(0))

    def step(a, x):
        start = a["at"] + _n(x["piece"])
        end = start + _n(x["found"])
        hit = F.struct(start.alias("start"), (-end).alias("minus_end"), priority.alias("priority"), rule.alias("rule"), label.alias("label"))
        return F.struct(end.alias("at"), F.concat(a["hits"], F.array(hit)).alias("hits"))

    empty = F.array().cast("array<struct<start:int,minus_end:int,priority:int,rule:int,label:string>>")
    both = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("piece"), found.alias("found"))
    return F.aggregate(both, F.struct(F.lit(0).alias("at"), empty.alias("hits")), step, lambda a: a["hits"])


def _survivors(hits: Column) -> Column:
    """(n, labels) of the detections that none suppresses, in one pass over them by start and falling end."""

    def step(a, x):
        active = F.filter(a["active"], lambda y: y["minus_end"] < -x["start"])
        within = F.exists(active, lambda y: (y["minus_end"] <= x["minus_end"]) & ((y["priority"] < x["priority"]) | (y["priority"] == x["priority"])))
        one = F.struct(x["minus_end"].alias("minus_end"), x["priority"].alias("priority"))
        return F.struct(
            F.concat(active, F.array(one)).alias("active"),
            (a["n"] + F.when(within, 0).otherwise(1)).alias("n"),
            F.when(within | F.array_contains(a["labels"], x["label"]), a["labels"]).otherwise(F.concat(a["labels"], F.array(x["label"]))).alias("labels"),
        )

    start = F.struct(F.array().cast("array<struct<minus_end:int,priority:int>>").alias("active"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("labels"))
    return F.aggregate(F.array_sort(hits), start, step, lambda a: F.struct(a["n"].alias("n"), a["labels"].alias("labels")))


def _detections(spaced: Column, present: Column) -> Column:
    by_keyword: dict[str, list] = {}
    for k, (priority, label, keyword, pattern) in enumerate(RULES):
        by_keyword.setdefault(keyword, []).append(F.struct(F.lit(pattern).alias("pattern"), F.lit(priority).alias("priority"), F.lit(label).alias("label"), F.lit(k).alias("rule")))
    groups = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*v).alias("rules")) for k, v in by_keyword.items()])
    tried = F.flatten(F.transform(F.filter(groups, lambda g: F.array_contains(present, g["keyword"])), lambda g: g["rules"]))
    return F.flatten(F.transform(tried, lambda r: _hits(spaced, r["pattern"], r["priority"], r["label"], r["rule"])))


def scan(docs: DataFrame) -> DataFrame:
    """Find license statements in every whole text.

    `labels` holds the base labels and those of the detections that survive suppression; `score` is
    n / (n + 1) for n base places and survivors. A null text is like an empty one: no words, no labels,
    score 0. Ties between equal intervals of equal priority go to the first rule. Null ids and repeated rows
    are scanned like others, an empty table gives no rows, extra columns are not carried.
    """
    rows = columns(docs, doc_id="long", text="string").select("doc_id", plain_words(F.col("text")).alias("body"))
    empty = F.array().cast("array<struct<start:int,minus_end:int,priority:int,rule:int,label:string>>")
    known = F.array(*[F.lit(k) for k in KEYWORDS])

    def base(s: Column) -> Column:
        phrases = F.array(*[F.struct(F.lit(_spaced(p)).alias("pattern"), F.lit(label).alias("label")) for p, label in BASE.items()])
        hit = F.filter(phrases, lambda p: F.contains(s, p["pattern"]))
        return F.array_sort(F.flatten(F.transform(hit, lambda p: _hits(s, p["pattern"], F.lit(0), p["label"], F.lit(-1)))))

    def found(w: Column) -> Column:
        return F.struct(F.when(F.col("body") == "", F.lit(0)).otherwise(F.size(w)).cast("long").alias("n_words"), F.array_intersect(w, known).alias("present"))

    def judged(s: Column) -> Column:
        gated = F.when(F.array_contains(F.col("w.present"), "license"), base(s)).otherwise(empty)
        return F.struct(gated.alias("base"), _survivors(_detections(s, F.col("w.present"))).alias("method"))

    rows = rows.select("doc_id", "body", let(F.split("body", " "), found).alias("w"))
    # the places of words are looked for only where a keyword stands
    spaced = F.when(F.size("w.present") > 0, F.concat(F.lit(" "), F.replace("body", F.lit(" "), F.lit("  ")), F.lit(" "))).otherwise(F.lit(""))
    rows = rows.select("doc_id", F.col("w.n_words").alias("n_words"), let(spaced, judged).alias("x"))
    labels = F.transform(F.col("x.base"), lambda h: h["label"])
    n = F.size("x.base") + F.col("x.method.n")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("x.base").cast("long").alias("n_base"),
        F.get("x.base", F.lit(0))["start"].cast("long").alias("first_word"),
        F.when(F.size("x.base") > 0, F.element_at("x.base", -1)["start"]).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(labels, F.col("x.method.labels"))), ",").alias("labels"),
        (n / (n + 1)).alias("score"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_RULES_SQL = ",\n".join(f"({k}, {p}, '{label}', ' {keyword} ', '{pattern}')" for k, (p, label, keyword, pattern) in enumerate(RULES))
_BASE_SQL = ",\n".join(f"(-1, 0, '{label}', '{_spaced(p)}', '{_spaced(p)}')" for p, label in BASE.items())
OP2_SQL = rf"""
WITH rules(rule, priority, label, keyword, pattern) AS (VALUES {_RULES_SQL}, {_BASE_SQL}),
t AS (
  SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NO_WORD}', ' ', 'g'), ' ') AS body
  FROM documents),
s AS (SELECT doc_id, CASE WHEN body = '' THEN '' ELSE ' ' || replace(body, ' ', '  ') || ' ' END AS spaced FROM t),
m AS (
  SELECT doc_id, rule, priority, label, string_split_regex(spaced, pattern) AS pieces, regexp_extract_all(spaced, pattern) AS found
  FROM s JOIN rules ON contains(spaced, keyword)),
hits AS (
  SELECT doc_id, rule, priority, label,
         (list_sum(list_transform(pieces[1:i], lambda x: len(x) - len(replace(x, ' ', ''))))
          + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x) - len(replace(x, ' ', '')))), 0))::BIGINT // 2 AS s,
         (len(found[i]) - len(replace(found[i], ' ', ''))) // 2 AS n
  FROM m, unnest(range(1, len(found) + 1)) u(i)),
base AS (
  SELECT doc_id, count(*) AS n, min(s) AS first_word, max(s) AS last_word, list(DISTINCT label) AS labels FROM hits WHERE rule < 0 GROUP BY doc_id),
method AS (SELECT row_number() OVER () AS id, *, s + n AS e FROM hits WHERE rule >= 0),
left_over AS (
  SELECT doc_id, count(*) AS n, list(DISTINCT label) AS labels FROM method d
  WHERE NOT EXISTS (SELECT 1 FROM method o WHERE o.doc_id = d.doc_id AND o.s <= d.s AND o.e >= d.e
                    AND (o.priority < d.priority OR (o.priority = d.priority AND (o.n > d.n OR (o.n = d.n AND o.rule < d.rule)))))
  GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN spaced = '' THEN 0 ELSE (len(spaced) - len(replace(spaced, ' ', ''))) // 2 END::BIGINT AS n_words,
       coalesce(b.n, 0)::BIGINT AS n_base, b.first_word, b.last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(l.labels, [])))), ','), '') AS labels,
       (coalesce(b.n, 0) + coalesce(l.n, 0))::DOUBLE / (coalesce(b.n, 0) + coalesce(l.n, 0) + 1)::DOUBLE AS score
FROM s LEFT JOIN base b USING (doc_id) LEFT JOIN left_over l USING (doc_id)
"""
