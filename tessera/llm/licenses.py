"""License scans with ordered signature rules, in DataFrame functions alone.

A text with no license keyword is done after one look.  Any other becomes a
line of lower-cased words.  Rules are sentences of license texts and notices,
written one by one, and license families (name pattern, keyword) in statement
forms (pattern, priority, relevance), several hundred in all; a rule runs only if
its keyword, which all its matches contain, stands in the text.
All matches go in one sweep, in order of start: a match inside another of the
same or a higher priority is suppressed.  The labels left over join the labels
of the base phrases.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, table

#: Phrases counted at every place they stand, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_V = r"(?:(?:version |ver |v ?))?"
_L = r"licen[cs]e"
#: (label, keyword, name pattern over lower-cased words, registry name of the license); names that share no word are
#: rows of their own, the further ones without a registry name.
FAMILIES = (
    ("mit", "mit", rf"(?:the )?mit(?: x11)? {_L}", "mit"),
    ("mit", "expat", rf"(?:the )?expat(?: x11)? {_L}", None),
    ("x11", "x11", rf"x11 {_L}", "x11"),
    ("apache-1.1", "apache", rf"apache (?:software )?{_L} {_V}1 1", "apache 1 1"),
    ("apache-2.0", "apache", rf"apache (?:software )?{_L} {_V}2(?: 0)?", "apache 2 0"),
    ("apache", "apache", rf"apache (?:software )?{_L}", "apache"),
    ("gpl-1.0", "gpl", rf"gpl {_V}1(?: 0)?", "gpl 1 0"),
    ("gpl-1.0", "general public", rf"general public {_L} {_V}1(?: 0)?", None),
    ("gpl-2.0", "general public", rf"(?:gnu )?general public {_L} {_V}2(?: 0)?", "gpl 2 0"),
    ("gpl-2.0", "gpl", rf"gplv? ?{_V}2(?: 0)?", "gpl 2 0 only"),
    ("gpl-3.0", "general public", rf"(?:gnu )?general public {_L} {_V}3(?: 0)?", "gpl 3 0"),
    ("gpl-3.0", "gpl", rf"gplv? ?{_V}3(?: 0)?", "gpl 3 0 only"),
    ("gpl", "general public", rf"(?:gnu )?general public {_L}", "gpl"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public {_L} {_V}2 1", "lgpl 2 1"),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public {_L} {_V}3(?: 0)?", "lgpl 3 0"),
    ("lgpl", "lesser", rf"(?:gnu )?lesser general public {_L}", "lgpl"),
    ("lgpl", "library general", rf"(?:gnu )?library general public {_L}", None),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public {_L} {_V}3(?: 0)?", "agpl 3 0"),
    ("agpl", "affero", rf"(?:gnu )?affero general public {_L}", "agpl"),
    ("gfdl", "free documentation", rf"(?:gnu )?free documentation {_L}", "gfdl 1 3"),
    ("bsd-2-clause", "bsd", rf"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: {_L})?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", rf"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: {_L})?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", rf"(?:bsd 4 clause|4 clause bsd|original bsd)(?: {_L})?", "bsd 4 clause"),
    ("bsd", "bsd", rf"bsd(?: style)? {_L}", "bsd"),
    ("0bsd", "0bsd", rf"0bsd(?: {_L})?", "0bsd"),
    ("0bsd", "zero clause", rf"zero clause bsd(?: {_L})?", None),
    ("isc", "isc", rf"isc {_L}", "isc"),
    ("mpl-1.1", "mozilla", rf"mozilla public {_L} {_V}1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public {_L} {_V}2(?: 0)?", "mpl 2 0"),
    ("mpl", "mozilla", rf"mozilla public {_L}", "mpl"),
    ("epl-1.0", "eclipse", rf"eclipse public {_L} {_V}1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", rf"eclipse public {_L} {_V}2(?: 0)?", "epl 2 0"),
    ("edl", "eclipse", rf"eclipse distribution {_L}", "edl"),
    ("cddl", "common development", rf"common development and distribution {_L}", "cddl 1 0"),
    ("cpl", "common public", rf"common public {_L}", "cpl 1 0"),
    ("eupl", "european union", rf"european union public {_L}", "eupl 1 2"),
    ("artistic-2.0", "artistic", rf"artistic {_L} {_V}2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", rf"artistic {_L}", "artistic 1 0"),
    ("zlib", "zlib", rf"zlib(?: libpng)? {_L}", "zlib"),
    ("boost-1.0", "boost", rf"boost software {_L}", "bsl 1 0"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-4.0", "creative commons", rf"creative commons attribution (?:4 0|{_V}4)(?: international)?(?: {_L})?", "cc by 4 0"),
    ("cc-by-sa-4.0", "creative commons", rf"creative commons attribution share ?alike (?:4 0|{_V}4)(?: international)?(?: {_L})?", "cc by sa 4 0"),
    ("cc-by-nc", "creative commons", rf"creative commons attribution non ?commercial(?: [34] 0)?(?: international)?(?: {_L})?", "cc by nc 4 0"),
    ("cc", "creative commons", rf"creative commons(?: attribution)?(?: {_L})?", "cc by"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", "wtfpl"),
    ("wtfpl", "do what the", r"do what the fuck you want to public license", None),
    ("postgresql", "postgresql", rf"postgresql {_L}", "postgresql"),
    ("python", "python", rf"python software foundation {_L}", "psf 2 0"),
    ("openssl", "openssl", rf"openssl {_L}", "openssl"),
    ("php", "php", rf"php {_L}", "php 3 01"),
    ("ruby", "ruby", rf"ruby {_L}", "ruby"),
    ("ofl-1.1", "open font", rf"(?:sil )?open font {_L}", "ofl 1 1"),
    ("ms-pl", "microsoft", rf"microsoft public {_L}", "ms pl"),
    ("ms-rl", "microsoft", rf"microsoft reciprocal {_L}", "ms rl"),
    ("afl-3.0", "academic free", rf"academic free {_L}", "afl 3 0"),
    ("osl-3.0", "open software", rf"open software {_L}", "osl 3 0"),
    ("odbl-1.0", "open database", rf"open database {_L}", "odbl 1 0"),
    ("sspl-1.0", "server side", rf"server side public {_L}", "sspl 1 0"),
    ("bsl-1.1", "business source", rf"business source {_L}", "busl 1 1"),
    ("elastic-2.0", "elastic", rf"elastic {_L}", "elastic 2 0"),
)
#: (pattern around a family's {name} or {id}, priority, relevance); a higher priority suppresses what lies inside.
FORMS = (
    (r"spdx {lic} identifier {id}", 4, 1.0),
    (r"(?:is |are )?(?:licensed|released|distributed|published|provided|available|covered|offered) under (?:the )?(?:terms of (?:the )?)?{name}", 3, 0.95),
    (r"(?:subject to|governed by|in accordance with|in compliance with|permitted by|conditions of|terms of) (?:the )?(?:terms of (?:the )?)?{name}", 3, 0.9),
    (r"{lic}(?:d)? (?:is |as |type |name )?(?:the )?{name}", 2, 0.85),
    (r"{name}(?: agreement| text| file| notice| terms)", 2, 0.8),
    (r"{name}", 1, 0.7),
)
#: (label, keyword, pattern, priority, relevance) of sentences of license texts and notices, over lower-cased words.
SINGLE = (
    ("proprietary", "rights reserved", r"all rights reserved", 0, 0.3),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 1, 0.6),
    ("proprietary", "trade secret", r"(?:contains|constitutes?) (?:the )?(?:confidential|proprietary)(?: [^ ]+){0,6} trade secrets?(?: rights)?", 1, 0.6),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|software|program)(?: via any medium)? is (?:strictly )?prohibited", 2, 0.8),
    ("proprietary", "end user licen", rf"end user {_L} agreement", 1, 0.6),
    ("proprietary", "reverse engineer", r"(?:you )?(?:may|shall) not (?:copy modify )?reverse engineer(?: decompile)?(?: or disassemble)?(?: the)? software", 1, 0.6),
    ("proprietary", "internal use", rf"(?:for )?internal use only(?: under)?(?: this)?(?: {_L})?", 0, 0.3),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain", 1, 0.7),
    ("public-domain", "no copyright", r"no copyright is claimed", 1, 0.6),
    ("public-domain", "disclaims copyright", r"the author disclaims copyright to this source code", 2, 0.8),
    ("copyleft", "copyleft", r"copyleft", 0, 0.3),
    ("free-unknown", "free software", r"(?:is|are) free software", 0, 0.3),
    ("free-unknown", "open source licen", rf"(?:an |any |the )?(?:osi approved )?open source {_L}", 0, 0.3),
    ("free-unknown", "freely", r"may be (?:used|copied|redistributed)(?: and| or| modified| copied| distributed| redistributed){0,4} freely", 0, 0.4),
    ("warranty-disclaimer", "warrant", r"without (?:any )?warranty of any kind(?: express or implied)?", 0, 0.3),
    ("warranty-disclaimer", "merchantability", r"implied warrant(?:y|ies) of merchantability (?:or|and) fitness for a particular purpose(?: are disclaimed)?", 0, 0.3),
    ("warranty-disclaimer", "be liable", r"in no event (?:shall|will) (?:the )?(?:author|authors|copyright holder|copyright holders|regents|contributors)(?: or(?: [^ ]+){1,4})? be liable", 0, 0.3),
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 3, 0.95),
    ("mit", "deal in the software", r"to deal in the software without restriction(?: including without limitation)?(?: the rights)?", 2, 0.85),
    ("mit", "substantial portions", r"this permission notice shall be included in all copies or substantial portions of the software", 2, 0.85),
    ("mit", "sublicense", r"(?:use copy modify merge publish distribute|publish distribute) sublicense and or sell copies of the software", 2, 0.85),
    ("mit-0", "mit no attribution", r"mit no attribution", 2, 0.85),
    ("x11", "x consortium", r"except as contained in this notice the names? of (?:the )?x consortium shall not be used in advertising", 3, 0.95),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 3, 0.9),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 2, 0.85),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice", 2, 0.85),
    ("bsd-3-clause", "neither the name", r"neither the names? of(?: [^ ]+){1,12} may be used to endorse or promote products derived from this software", 3, 0.95),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 3, 0.95),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 3, 0.9),
    ("isc", "above copyright notice", r"provided that the above copyright notice and this permission notice appear in all copies", 2, 0.8),
    ("0bsd", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 4, 0.95),
    ("apache-2.0", "except in compliance", rf"you may not use this file except in compliance with the {_L}", 2, 0.85),
    ("apache-2.0", "apache org licenses", r"apache org licenses license 2 0", 3, 0.95),
    ("apache-2.0", "unless required by applicable", rf"unless required by applicable law or agreed to in writing software distributed under the {_L}", 2, 0.85),
    ("apache-2.0", "asf under one", rf"licensed to the apache software foundation asf under one or more contributor {_L} agreements", 3, 0.95),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation", 2, 0.8),
    ("gpl", "free software you can", r"free software you can redistribute it and or modify it under the terms of the gnu general public license", 3, 0.95),
    ("gpl-2.0-or-later", "or at your option", r"either version 2 of the license or at your option any later version", 2, 0.9),
    ("gpl-3.0-or-later", "or at your option", r"either version 3 of the license or at your option any later version", 2, 0.9),
    ("gpl", "copy of the gnu general", r"you should have received a copy of the gnu general public license", 2, 0.85),
    ("gpl", "free software foundation", r"published by the free software foundation", 1, 0.6),
    ("gpl", "51 franklin", r"free software foundation inc 51 franklin (?:st|street) fifth floor boston", 1, 0.6),
    ("gpl", "59 temple place", r"free software foundation inc 59 temple place", 1, 0.6),
    ("gpl", "for most software", rf"the {_L}s? for most software (?:and other practical works )?are designed to take away your freedom", 2, 0.9),
    ("gpl", "take away your freedom", r"designed to take away your freedom to share and change", 2, 0.85),
    ("lgpl", "copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public license", 3, 0.95),
    ("lgpl", "copy of the gnu library", r"you should have received a copy of the gnu library general public license", 3, 0.95),
    ("lgpl-2.1-or-later", "version 2 1 of the", r"either version 2 1 of the license or at your option any later version", 3, 0.95),
    ("agpl", "copy of the gnu affero", r"you should have received a copy of the gnu affero general public license", 3, 0.95),
    ("agpl", "remotely through a computer", r"all users interacting with it remotely through a computer network(?: [^ ]+){0,16} corresponding source", 2, 0.85),
    ("gfdl", "invariant sections", r"with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts", 3, 0.95),
    ("classpath-exception", "classpath exception", r"(?:with the )?classpath exception", 2, 0.8),
    ("classpath-exception", "linking this library", r"linking this library statically or dynamically with other modules is making a combined work", 3, 0.95),
    ("gcc-exception", "runtime library exception", r"gcc runtime library exception", 2, 0.85),
    ("linking-exception", "special exception", r"as a special exception(?: [^ ]+){0,14} (?:permission to|you may) link", 2, 0.8),
    ("mpl-2.0", "source code form is subject", r"this source code form is subject to the terms of the mozilla public license", 3, 0.95),
    ("mpl", "copy of the mpl", r"if a copy of the mpl was not distributed with this file", 2, 0.85),
    ("mpl-1.1", "contents of this file", r"the contents of this file are (?:subject to|used under) the mozilla public license version 1 1", 4, 0.95),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 3, 0.95),
    ("cddl", "contents of this file", r"the contents of this file are subject to the terms of (?:either )?(?:of )?(?:the )?common development and distribution license", 3, 0.95),
    ("cpl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the common public license", 3, 0.95),
    ("boost-1.0", "boost org license", r"boost org license 1 0 txt", 3, 0.95),
    ("boost-1.0", "machine executable object", r"machine executable object code generated by a source language processor", 2, 0.85),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented", 2, 0.85),
    ("zlib", "plainly marked", r"altered source versions must be plainly marked as such", 2, 0.85),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 3, 0.95),
    ("wtfpl", "you just do what", r"you just do what the fuck you want to", 2, 0.85),
    ("cc0-1.0", "publicdomain zero", r"creativecommons org publicdomain zero 1 0", 3, 0.95),
    ("cc-by-4.0", "licenses by 4", r"creativecommons org licenses by 4 0", 3, 0.95),
    ("cc-by-3.0", "licenses by 3", r"creativecommons org licenses by 3 0", 3, 0.95),
    ("cc-by-sa-4.0", "licenses by sa 4", r"creativecommons org licenses by sa 4 0", 3, 0.95),
    ("cc-by-sa-3.0", "licenses by sa 3", r"creativecommons org licenses by sa 3 0", 3, 0.95),
    ("cc-by-nc", "licenses by nc", r"creativecommons org licenses by nc(?: sa| nd)? (?:1|2|3|4) 0", 3, 0.95),
    ("cc-by-nd", "licenses by nd", r"creativecommons org licenses by nd (?:1|2|3|4) 0", 3, 0.95),
    ("artistic", "conditions under which", r"the intent of this document is to state the conditions under which a package may be copied", 2, 0.85),
    ("perl", "same terms as perl", r"(?:under the )?same terms as perl itself", 2, 0.85),
    ("python", "python software foundation", rf"this {_L} agreement is between the python software foundation", 3, 0.95),
    ("openssl", "openssl toolkit", r"developed by the openssl project for use in the openssl toolkit", 2, 0.85),
    ("curl", "curl licen", rf"curl {_L}", 2, 0.8),
    ("libpng", "libpng licen", rf"libpng {_L}", 2, 0.8),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group", 2, 0.85),
    ("unicode", "unicode data files", r"obtaining a copy of the unicode data files", 2, 0.85),
    ("ofl-1.1", "scripts sil org ofl", r"scripts sil org ofl", 2, 0.85),
    ("ofl-1.1", "reserved font name", r"with reserved font name", 1, 0.7),
    ("beerware", "beer in return", r"you can buy me a beer in return", 2, 0.85),
    ("json", "good not evil", r"the software shall be used for good not evil", 2, 0.9),
    ("commons-clause", "commons clause", rf"commons clause {_L} condition", 2, 0.85),
    ("polyform", "polyform", rf"polyform (?:noncommercial|small business|strict|shield) {_L}", 2, 0.85),
    ("unknown-license", "licensed under", rf"licensed under (?:the )?(?:terms of (?:the )?)?[^ ]+ {_L}", 0, 0.4),
    ("unknown-license", "see the licen", rf"see the {_L}(?: file)? for (?:the specific language|details|more information)", 0, 0.4),
    ("unknown-license", "file for licen", rf"see (?:the )?(?:copying|notice) file for {_L} (?:details|terms|information)", 0, 0.4),
    ("unknown-license", "dual licensed", r"dual licensed under", 0, 0.4),
)
PRIORITIES = 5


def rules() -> list[dict]:
    """Every signature rule: families by forms, then the single statements."""
    out = [
        {"label": label, "keyword": f"identifier {ids}" if "{id}" in form else keyword, "re": f"(?<= )(?:{form.format(name=f'(?:{name})', id=ids, lic=_L)})(?= )", "priority": priority, "score": score}
        for label, keyword, name, ids in FAMILIES
        for form, priority, score in FORMS
        if ids or "{id}" not in form
    ]
    return out + [{"label": label, "keyword": k, "re": f"(?<= )(?:{p})(?= )", "priority": priority, "score": s} for label, k, p, priority, s in SINGLE]


#: A text none of whose places match this holds no keyword and no base phrase.
GATE = r"(?i)licen[cs]e|spdx|gpl|bsd|creative|cc0|wtfpl|public|rights|copy|distribut|permission|warrant|liable|software|trade secret|confidential|perl|mpl|machine executable|altered source|jpeg group|font|internal use|a beer|what the fuck|classpath|linking|invariant sections|runtime library|computer network|your freedom|no attribution|consortium|copied|freely|good not evil|unicode data|openssl|sil org|exception"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _count_words(col: Column) -> Column:
    return F.regexp_count(col, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")


def _spaces(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(" ")))


def _matches(line: Column, rule: Column) -> Column:
    """(s, e, priority, label, score) of each match of one rule."""
    found = F.regexp_extract_all(line, rule["re"], F.lit(0))

    def placed(m: Column) -> Column:
        def at(between: Column) -> Column:
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
            step = lambda acc, i: let(
                acc["at"] + F.length(F.get(between, i)),
                lambda s: F.struct((s + F.length(F.get(m, i))).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + F.length(F.get(m, i))).alias("e")))).alias("out")),
            )
            spans = F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), zero, step, lambda acc: acc["out"])
            return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("minus_e"), (-rule["priority"]).alias("minus_p"), rule["label"].alias("label"), rule["score"].alias("score")))

        return F.when(F.size(m) > 0, let(F.split(line, rule["re"]), at))

    return let(found, placed)


def _swept(found: Column) -> Column:
    """(labels, score) of the matches that no match of the same or a higher priority contains."""
    zero = F.struct(F.array_repeat(F.lit(-1), PRIORITIES).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, x: Column) -> Column:
        ends = F.transform(acc["ends"], lambda v, i: F.when(i == -x["minus_p"], F.greatest(v, -x["minus_e"])).otherwise(v))
        over = F.exists(F.transform(acc["ends"], lambda v, i: (i >= -x["minus_p"]) & (v >= -x["minus_e"])), lambda v: v)
        return F.struct(ends.alias("ends"), F.when(over, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(x["label"]))).alias("labels"), F.when(over, acc["score"]).otherwise(F.greatest(acc["score"], x["score"])).alias("score"))

    return F.aggregate(F.array_sort(found), zero, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["score"].alias("score")))


_RESULT = "struct<n_base:bigint,first_word:bigint,last_word:bigint,base:array<string>,labels:array<string>,score:double>"


def _scanned(text: Column, n_words: Column) -> Column:
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))
    # the SPDX rules' keywords are looked for only behind a common one
    by_keyword: dict[str, list[dict]] = {}
    for r in rules():
        by_keyword.setdefault("spdx" if "spdx" in r["re"] else r["keyword"], []).append(r)
    grouped = json.dumps([{"keyword": k, "rules": v} for k, v in by_keyword.items()])
    table_ = F.from_json(F.lit(grouped), "array<struct<keyword:string,rules:array<struct<keyword:string,label:string,re:string,priority:int,score:double>>>>")

    def body(p: Column) -> Column:
        counts = [F.regexp_count(p, F.lit(f" {phrase}(?= )")).cast("long") for phrase, _ in BASE]
        has = [p.contains(f" {phrase} ") for phrase, _ in BASE]
        first = F.least(*[F.when(h, _spaces(F.substring_index(p, f" {phrase} ", 1))) for h, (phrase, _) in zip(has, BASE, strict=True)])
        last = F.greatest(*[F.when(h, n_words - _spaces(F.substring_index(p, f" {phrase} ", -1)) - len(phrase.split())) for h, (phrase, _) in zip(has, BASE, strict=True)])
        base = F.array_compact(F.array(*[F.when(h, F.lit(label)) for h, (_, label) in zip(has, BASE, strict=True)]))
        live = F.filter(table_, lambda g: p.contains(g["keyword"]))
        found = F.flatten(F.transform(live, lambda g: F.flatten(F.filter(F.transform(F.filter(g["rules"], lambda r: p.contains(r["keyword"])), lambda r: _matches(p, r)), lambda m: m.isNotNull()))))
        done = lambda s: F.struct(sum(counts[1:], counts[0]).alias("n_base"), first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), base.alias("base"), s["labels"].alias("labels"), s["score"].alias("score"))
        return let(_swept(found), done)

    return let(line, body)


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score of each row's whole text.

    Null reads as empty: no words, no labels, score 0.  score is the relevance
    of the best match left (0.5 at least with a base phrase).  Rows are
    scanned each on its own, repeated ones alike.  Result columns' names must
    not be among ``keep``.
    """
    clash = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "__r", "__t"} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are result columns")
    whole = docs.select(*[docs[c] for c in keep], F.coalesce(docs[text].cast("string"), F.lit("")).alias("__t"))
    n = _count_words(F.col("__t"))
    none = F.lit(None).cast(_RESULT)
    # one expression for all, so that no part of it is worked out twice
    out = whole.select(*keep, let(n, lambda k: F.struct(k.alias("n_words"), F.when(F.col("__t").rlike(GATE), _scanned(F.col("__t"), k)).otherwise(none).alias("r"))).alias("__r"))
    r = "__r.r."
    labels = F.array_sort(F.array_union(F.col(r + "base"), F.col(r + "labels")))
    return out.select(
        *keep, F.col("__r.n_words").alias("n_words"), F.coalesce(r + "n_base", F.lit(0)).cast("long").alias("n_base"), F.col(r + "first_word").alias("first_word"), F.col(r + "last_word").alias("last_word"),
        F.coalesce(F.array_join(F.array_sort(F.col(r + "base")), ","), F.lit("")).alias("base_labels"), F.coalesce(F.array_join(labels, ","), F.lit("")).alias("labels"),
        F.coalesce(F.when(F.col(r + "n_base") > 0, F.greatest(F.col(r + "score"), F.lit(0.5))).otherwise(F.col(r + "score")), F.lit(0.0)).alias("score"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])
