"""Licence scan by ordered signature rules, in DataFrame operations only.

A text is normalised to its lower-case words. Rules are regular expressions over that form, each with a
keyword, a priority and a label. A first filter passes only texts with a licence word, a second one only the
rules whose keyword begins a word of the text. Each detection is an interval of characters; one that lies inside another
of the same or a higher priority is suppressed. All of it happens within the row: no shuffle, no explosion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licences as (label, keyword, name). A name is a regular expression over lower-case words.
LICENCES = (
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e"),
    ("agpl", "agpl", "agpl(?: ?v?3(?: 0)?)?"),
    ("apache", "apache", "apache(?: software)? licen[cs]e"),
    ("apache", "apache", "apache(?: license)? (?:version |v)?2(?: 0)?"),
    ("artistic", "artistic", "artistic licen[cs]e(?: (?:version )?[12] 0)?"),
    ("bsd", "bsd", "(?:(?:new|modified|simplified|revised) )?bsd(?: (?:[0234]|two|three|four) clause)?(?: style)? licen[cs]e"),
    ("bsd", "bsd", "bsd (?:[0234]|two|three|four) clause"),
    ("bsl", "boost", "boost software licen[cs]e"),
    ("busl", "business", "business source licen[cs]e"),
    ("cc-by", "cc", "cc by(?: [1-4] 0)?"),
    ("cc-by", "creative", "creative commons attribution"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] 0)?"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] 0)?"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:s|atives)"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] 0)?"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike"),
    ("cc0", "cc0", "cc0(?: 1 0)?"),
    ("cc0", "zero", "(?:creative commons|cc) zero"),
    ("cddl", "cddl", "cddl(?: 1 [01])?"),
    ("cddl", "common", "common development and distribution licen[cs]e"),
    ("cecill", "cecill", "cecill(?: [abc2])?"),
    ("cpl", "common", "common public licen[cs]e"),
    ("ecl", "educational", "educational community licen[cs]e"),
    ("epl", "eclipse", "eclipse public licen[cs]e"),
    ("epl", "epl", "epl(?: version| v|v) ?[12](?: 0)?"),
    ("epl", "epl", "epl [12] 0"),
    ("eupl", "eupl", "eupl(?: 1 [012])?"),
    ("eupl", "european", "european union public licen[cs]e"),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e"),
    ("gfdl", "gfdl", "gfdl(?: 1 [123])?"),
    ("gpl", "gnu", "gnu(?: general)? public licen[cs]e"),
    ("gpl", "gnu", "gnu gpl(?: ?(?:version |v ?)?[123](?: 0)?)?"),
    ("gpl", "gpl", "gpl ?(?:version |v ?)?[123](?: 0)?(?: or later| only)?"),
    ("isc", "isc", "isc licen[cs]e"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", "library", "(?:gnu )?library general public licen[cs]e"),
    ("lgpl", "lgpl", "lgpl(?: ?v?[23](?: [01])?)?"),
    ("libpng", "libpng", "(?:zlib )?libpng licen[cs]e"),
    ("mit", "mit", "mit(?: x11)? licen[cs]e"),
    ("mit", "mit", "mit x11"),
    ("mit", "mit", "mit(?= (?:or |and )?apache (?:license )?(?:version |v)?2)"),
    ("mpl", "mozilla", "mozilla public licen[cs]e"),
    ("mpl", "mpl", "mpl(?: version| v|v) ?[12](?: [01])?"),
    ("mpl", "mpl", "mpl [12] [01]"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e"),
    ("ncsa", "ncsa", "(?:uiuc )?ncsa(?: open source)? licen[cs]e"),
    ("odbl", "odbl", "odbl(?: 1 0)?"),
    ("odbl", "database", "open database licen[cs]e"),
    ("ofl", "ofl", "(?:sil )?ofl(?: 1 1)?"),
    ("ofl", "font", "(?:sil )?open font licen[cs]e"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("osl", "open", "open software licen[cs]e"),
    ("php", "php", "php licen[cs]e"),
    ("psf", "python", "python software foundation licen[cs]e"),
    ("sspl", "sspl", "sspl(?: ?v?1)?"),
    ("sspl", "server", "server side public licen[cs]e"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("upl", "universal", "universal permissive licen[cs]e"),
    ("vim", "vim", "vim licen[cs]e"),
    ("w3c", "w3c", "w3c(?: software)? licen[cs]e"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("x11", "x11", "x11 licen[cs]e"),
    ("zlib", "zlib", "zlib licen[cs]e"),
    ("zpl", "zope", "zope public licen[cs]e"),
)
# Identifiers after an SPDX tag, as (label, identifier) in lower-case words.
SPDX = (
    ("0bsd", "0bsd"),
    ("afl", "afl [123] [012]"),
    ("agpl", "agpl [13] 0(?: only| or later)?"),
    ("apache", "apache [12] [01]"),
    ("artistic", "artistic [12] 0(?: perl| cl8)?"),
    ("blueoak", "blueoak 1 0 0"),
    ("bsd", "bsd [1234] clause(?: [a-z]+)?"),
    ("bsl", "bsl 1 0"),
    ("busl", "busl 1 1"),
    ("cc-by", "cc by [1-4] [05]"),
    ("cc-by-nc", "cc by nc [1-4] [05]"),
    ("cc-by-nc-nd", "cc by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", "cc by nc sa [1-4] [05]"),
    ("cc-by-nd", "cc by nd [1-4] [05]"),
    ("cc-by-sa", "cc by sa [1-4] [05]"),
    ("cc0", "cc0 1 0"),
    ("cddl", "cddl 1 [01]"),
    ("cecill", "cecill(?: [abc12])?(?: [01])?"),
    ("cpl", "cpl 1 0"),
    ("curl", "curl"),
    ("ecl", "ecl [12] 0"),
    ("elastic", "elastic 2 0"),
    ("epl", "epl [12] 0"),
    ("eupl", "eupl 1 [012]"),
    ("fsl", "fsl 1 1 (?:mit|apache 2 0)"),
    ("ftl", "ftl"),
    ("gfdl", "gfdl 1 [123](?: only| or later)?"),
    ("gpl", "gpl [123] 0(?: only| or later)?(?: with [a-z]+ exception(?: [0-9] [0-9])?)?"),
    ("hpnd", "hpnd"),
    ("icu", "icu"),
    ("ijg", "ijg"),
    ("ipl", "ipl 1 0"),
    ("isc", "isc"),
    ("lgpl", "lgpl [23] [01](?: only| or later)?"),
    ("libpng", "libpng(?: 2 0)?"),
    ("lppl", "lppl 1 [0123][ac]?"),
    ("mit", "mit(?: 0| cmu| modern variant)?"),
    ("mpl", "mpl [12] [01](?: no copyleft exception)?"),
    ("ms-pl", "ms pl"),
    ("ms-rl", "ms rl"),
    ("mulanpsl", "mulanpsl [12] 0"),
    ("ncsa", "ncsa"),
    ("odbl", "odbl 1 0"),
    ("odc-by", "odc by 1 0"),
    ("ofl", "ofl 1 [01](?: no rfn| rfn)?"),
    ("openssl", "openssl"),
    ("osl", "osl [123] [01]"),
    ("pddl", "pddl 1 0"),
    ("php", "php 3 0(?: 1)?"),
    ("postgresql", "postgresql"),
    ("psf", "psf 2 0|python 2 0(?: 1)?"),
    ("qpl", "qpl 1 0"),
    ("ruby", "ruby"),
    ("sspl", "sspl 1 0"),
    ("tcl", "tcl"),
    ("unicode", "unicode (?:3 0|dfs 201[56]|tou)"),
    ("unlicense", "unlicense"),
    ("upl", "upl 1 0"),
    ("vim", "vim"),
    ("w3c", "w3c(?: 19980720| 20150513)?"),
    ("wtfpl", "wtfpl"),
    ("x11", "x11"),
    ("zlib", "zlib(?: acknowledgement)?"),
    ("zpl", "zpl [12] [01]"),
)
# Addresses of licence texts as (label, keyword, address).
ADDRESSES = (
    ("agpl", "licenses", "gnu org licenses agpl(?: 3 0)?"),
    ("apache", "apache", "apache org licenses license 2 0"),
    ("bsd", "opensource", "opensource org licenses? bsd(?: license| [23] clause)"),
    ("bsl", "boost", "boost org license 1 0(?: txt)?"),
    ("cc-by", "creativecommons", "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("epl", "eclipse", "eclipse org legal epl(?: v?[12]0| [12] 0)"),
    ("gfdl", "licenses", "gnu org licenses fdl(?: 1 [123])?"),
    ("gpl", "licenses", "gnu org licenses (?:gpl|old licenses gpl 2 0)(?: 3 0)?"),
    ("isc", "opensource", "opensource org licenses? isc"),
    ("lgpl", "licenses", "gnu org licenses (?:lgpl|old licenses lgpl 2 1)(?: 3 0)?"),
    ("mit", "opensource", "opensource org licenses? mit(?: license)?"),
    ("mpl", "mozilla", "mozilla org (?:en us )?mpl(?: 2 0)?"),
    ("odbl", "licenses", "opendatacommons org licenses odbl"),
    ("ofl", "scripts", "scripts sil org ofl"),
    ("unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", "wtfpl net"),
)
# Sentences of licence texts as (label, keyword, sentence).
NOTICES = (
    ("afl", "academic", "licensed under the academic free license version [123] [012]"),
    ("agpl", "affero", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "remote", "offer all users interacting with it remotely through a computer network"),
    ("apache", "warranties", "without warranties or conditions of any kind either express or implied see the license for the specific language"),
    ("apache", "compliance", "you may not use this file except in compliance with the license"),
    ("apache", "licensed", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("artistic", "perl", "under the same terms as perl itself|perl artistic license"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "endorse", "be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("bsl", "boost", "distributed under the boost software license version 1 0"),
    ("bsl", "machine", "solely in the form of machine executable object code generated by a source language processor"),
    ("busl", "change", "change license (?:apache|gpl|mpl)"),
    ("cc-by", "attribution", "creative commons attribution [1-4] 0 (?:international|unported|generic)"),
    ("cc-by-nc-sa", "attribution", "creative commons attribution noncommercial sharealike [1-4] 0"),
    ("cc-by-sa", "attribution", "creative commons attribution sharealike [1-4] 0"),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights"),
    ("cc0", "dedicated", "(?:has )?dedicated th(?:e|is) work to the public domain"),
    ("cddl", "common", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cecill", "cecill", "governed by the cecill(?: [abc])? license under french law"),
    ("epl", "eclipse", "made available under the terms of the eclipse public license"),
    ("eupl", "eupl", "licensed under the eupl"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("agpl", "redistribute", "is free software you can redistribute it and or modify it under the terms of (?:version 3 of )?the gnu affero general public license"),
    ("agpl", "received", "you should have received a copy of the gnu affero general public license"),
    ("gpl", "redistribute", "is free software you can redistribute it and or modify it under the terms of (?:version [123] of )?the gnu general public license"),
    ("gpl", "redistribute", "this (?:program|file) is free software you can redistribute it and or modify it(?! under the terms)"),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "received", "you should have received a copy of the gnu general public license"),
    ("gpl", "published", "gnu general public license as published by the free software foundation"),
    ("isc", "granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", "author disclaims all warranties with regard to this software"),
    ("lgpl", "redistribute", "is free software you can redistribute it and or modify it under the terms of (?:version (?:2|3|2 1) of )?the gnu (?:lesser|library) general public license"),
    ("lgpl", "redistribute", "this library is free software you can redistribute it and or modify it(?! under the terms)"),
    ("lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lppl", "latex", "distributed and or modified under the conditions of the latex project public license"),
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial", "this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "limitation", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "liable", "in no event shall the authors or copyright holders be liable for any claim"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mozilla", "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("ms-pl", "microsoft", "subject to the microsoft public license"),
    ("odbl", "database", "made available under the open database license"),
    ("ofl", "font", "this font software is licensed under the sil open font license"),
    ("ofl", "reserved", "with reserved font name"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("php", "php", "subject to version [23] 0(?: 1)? of the php license"),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("psf", "python", "psf is making python available to licensee"),
    ("public-domain", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public", "(?:placed|released|put) (?:in|into|to) the public domain"),
    ("public-domain", "public", "this (?:code|data|document|file|image|program|software|text|work) is (?:hereby )?(?:in|dedicated to) the public domain"),
    ("sspl", "server", "server side public license version 1"),
    ("unlicense", "unlicense", "for more information please refer to https? unlicense org"),
    ("wtfpl", "fuck", "do what the fuck you want to public license"),
    ("x11", "consortium", "the name of the x consortium shall not be used in advertising"),
    ("zlib", "misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "implied", "this software is provided as is without any express or implied warranty"),
    ("zpl", "zope", "subject to the provisions of the zope public license"),
)
# A short name that counts beside another licence, as (label, keyword, name).
BESIDE = (("mit", "mit", "(?:(?<=apache 2 0 or )|(?<=apache 2 0 and )|(?<=apache 2 0 )|(?<=apache license 2 0 or ))mit"),)
# What is a weak sign of a licence, which one in the same text suppresses.
WEAK = (("proprietary", "rights", "all rights reserved"),)
WEAK_WEIGHT = 0.3
# Short names as (label, keyword, name) that count only behind a metadata key, before "licensed", or behind a grant.
SHORT = (
    ("0bsd", "0bsd", "0bsd"),
    ("agpl", "agpl", "agpl(?: ?v?3(?: 0)?)?"),
    ("apache", "apache", "apache(?: ?v?2(?: 0)?)?"),
    ("bsd", "bsd", "bsd(?: [0234] clause)?"),
    ("cc0", "cc0", "cc0(?: 1 0)?"),
    ("epl", "epl", "epl(?: ?v?[12](?: 0)?)?"),
    ("gpl", "gpl", "gpl(?: ?v?[123](?: 0)?)?"),
    ("isc", "isc", "isc"),
    ("lgpl", "lgpl", "lgpl(?: ?v?[23](?: [01])?)?"),
    ("mit", "mit", "mit(?! (?:das|dem|den|der|des|die|ein|eine|einem|einen|einer|ihm|ihnen|ihr|ihrem|ihren|ihrer|seinem|seinen|seiner|und|zu|zum|zur) )"),
    ("mpl", "mpl", "mpl(?: ?v?[12](?: [01])?)?"),
    ("ofl", "ofl", "ofl(?: 1 1)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("zlib", "zlib", "zlib"),
)
# What grants a licence, before its name.
GRANT = (
    "(?:(?:dual |triple )?(?:re)?licen[cs]ed|released|distributed|published|available|shared|provided|covered|governed|subject) (?:under|by|to) "
    "(?:the )?(?:terms (?:and conditions )?(?:of|in) (?:the )?)?(?:either the )?"
)
SHORT_GRANT = GRANT.replace("(?:under|by|to)", "under")
#: What stands before an identifier: the tag, and up to eight words that join other identifiers to this one. Java asks
#: for look-behinds of bounded length, so the words are spelt out.
TAG = " spdx license identifiers? (?:" + "(?:[a-z0-9]{1,24} )?" * 7 + "[a-z0-9]{1,24} (?:or|and) )?"
# The phrases that always count, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: A text without a word that begins like this has no detection: every match and base phrase has one. Words share
#: their first letters here, so that most words are dismissed at the first.
GATE = (
    r" (?:licen[cs]|a(?:cademic|dvertising|gpl|pache|ffero|rtistic|ttribution)|b(?:oost org|sd|usl)|c(?:c|ddl|ecill|onfidential|reativecommons|reative commons)|dedicated|e(?:clipse|pl|upl)"
    r"|endorse|fuck|g(?:fdl|pl|nu|ranted)|invariant|l(?:gpl|iable|atex|imitation)|m(?:achine|erchantability|isrepresented|it x11|ozilla|pl)|o(?:dbl|fl|penssl)|p(?:ermi[st]|sf|ublic domain|erl)"
    r"|re(?:distrib|motely|served)|s(?:cripts sil|ource|pdx|spl|ubstantial)|u(?:n(?:authorized|licen)|nder (?:the )?(?:terms (?:and conditions )?(?:of|in) (?:the )?)?(?:either the )?(?:0bsd|isc|mit|zlib) )|w(?:tfpl|arrant|aived))"
)


def rules() -> list[tuple[str, str, int, float, str]]:
    """(label, keyword, priority, weight, expression) of every rule.

    In order of priority: SPDX identifiers, addresses and sentences of licence texts (3), grants of a named licence,
    metadata keys and "licensed" with a short name (2), and names alone and weak signs (1).
    """

    def whole(text, after=""):
        # What stands before is looked at where the words themselves have been found, which is rare.
        return f"(?<= )(?:{text})(?= )" + (f"(?<={after}(?:{text}))" if after else "")

    out = [(label, "spdx", 3, 1.0, whole(text, TAG)) for label, text in SPDX]
    out += [(label, keyword, 3, 0.95, whole(text)) for label, keyword, text in NOTICES]
    out += [(label, keyword, 3, 0.9, whole(text)) for label, keyword, text in ADDRESSES]
    out += [(label, keyword, 2, 0.9, whole(name, GRANT)) for label, keyword, name in LICENCES]
    out += [(label, keyword, 2, 0.85, whole(name, SHORT_GRANT)) for label, keyword, name in SHORT]
    out += [(label, "licen", 2, 0.85, whole(f"licen[cs]es?(?: id| identifier| name| type)? (?:{name})")) for label, _, name in SHORT]
    out += [(label, keyword, 2, 0.85, whole(f"(?:{name}) licen[cs]ed")) for label, keyword, name in SHORT]
    out += [(label, keyword, 1, 0.7, whole(name)) for label, keyword, name in LICENCES + BESIDE]
    return out + [(label, keyword, 1, WEAK_WEIGHT, whole(text)) for label, keyword, text in WEAK]


def normal_words(text: str | Column = "text") -> Column:
    """The text's words, [a-z0-9] and all non-ASCII characters after lower-casing A-Z, one space around each."""
    raw = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # lower() also folds other letters; only two of them would become ASCII, and such texts are folded sign by sign.
    low = F.when(F.contains(raw, F.lit("\u212a")) | F.contains(raw, F.lit("\u0130")), F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(raw))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _any_of(words) -> str:
    """An expression for the longest of the words, by their first letters."""
    by_letter: dict[str, set[str]] = {}
    for word in words:
        by_letter.setdefault(word[0], set()).add(word[1:])
    return "|".join(f"{letter}(?:{'|'.join(sorted(rest, key=lambda w: (-len(w), w)))})" for letter, rest in sorted(by_letter.items()))


def _rule_table() -> Column:
    return F.array(*(F.struct(F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(priority).alias("priority"), F.lit(weight).alias("weight"), F.lit(text).alias("expression")) for label, keyword, priority, weight, text in rules()))


def _detections(words: Column) -> Column:
    """Every match of the rules whose keyword begins one of the words: begin and end (characters), rule fields."""

    def of_rule(rule: Column) -> Column:
        matches = F.regexp_extract_all(words, rule["expression"], F.lit(0))
        between = F.split(words, rule["expression"], -1)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int,label:string,priority:int,weight:double>>").alias("found"))

        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.length(F.element_at(between, i))
            end = begin + F.length(F.element_at(matches, i))
            return F.struct(end.alias("at"), F.array_append(acc["found"], F.struct(begin.alias("begin"), end.alias("end"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["weight"].alias("weight"))).alias("found"))

        return F.when(F.size(matches) > 0, F.aggregate(F.sequence(F.lit(1), F.size(matches)), start, step, lambda acc: acc["found"])).otherwise(start["found"])

    # One pass finds the keywords, the longest at each word; what a shorter one begins, it begins too.
    present = F.array_distinct(F.regexp_extract_all(words, F.lit(f" ({_any_of(r[1] for r in rules())})"), F.lit(1)))
    table = F.transform(F.array(present), lambda has: F.filter(_rule_table(), lambda r: F.exists(has, lambda k: F.startswith(k, r["keyword"]))))[0]
    return F.flatten(F.transform(table, of_rule))


def _survivors(found: Column) -> Column:
    """Detections that do not lie inside an earlier-sorted one of the same or a higher priority; weak ones only where no others are."""
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["begin"].alias("begin"), (-d["end"]).alias("minus_end"), (-d["priority"]).alias("minus_priority"), d["label"].alias("label"), d["weight"].alias("weight"))))
    none = F.struct(*(F.lit(-1).alias(f"e{p}") for p in (1, 2, 3)), F.array().cast("array<struct<begin:int,end:int,label:string,priority:int,weight:double>>").alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["minus_end"], -d["minus_priority"]
        reach = F.when(priority == 3, acc["e3"]).when(priority == 2, F.greatest(acc["e2"], acc["e3"])).otherwise(F.greatest(acc["e1"], acc["e2"], acc["e3"]))
        kept = F.when(reach >= end, acc["kept"]).otherwise(F.array_append(acc["kept"], F.struct(d["begin"].alias("begin"), end.alias("end"), d["label"].alias("label"), priority.alias("priority"), d["weight"].alias("weight"))))
        return F.struct(*(F.when(priority == p, F.greatest(acc[f"e{p}"], end)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in (1, 2, 3)), kept.alias("kept"))

    kept = F.aggregate(ordered, none, step, lambda acc: acc["kept"])
    strong = lambda d: d["weight"] > WEAK_WEIGHT
    return F.transform(F.array(kept), lambda ds: F.when(F.exists(ds, strong), F.filter(ds, strong)).otherwise(ds))[0]


def scan(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep`, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of each row.

    spans are the surviving detections, with places in characters of the normalised text. Without any, spans is
    empty, labels has the base labels alone and score is 0; otherwise score is the largest weight. A null or empty
    text has no words. Repeated rows stay; other columns of any name are not read; keep must not hold a result's name.
    """
    made = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"}
    if clash := made & {k.lower() for k in keep}:
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")
    phrases = "|".join(p for p, _ in BASE)
    places = rf"(?<= )(?:{phrases})(?= )"
    df = documents.select(*keep, normal_words(text).alias("__w"))
    words = F.col("__w")
    df = df.select(*keep, "__w", words.rlike(GATE).alias("__gate"))
    base = F.col("__gate") & words.rlike(places)
    df = df.select(
        *keep,
        F.when(words == "  ", 0).otherwise(_spaces(words) - 1).cast("long").alias("n_words"),
        F.when(base, F.regexp_count(words, F.lit(places))).otherwise(0).cast("long").alias("n_base"),
        F.when(base, _spaces(F.regexp_extract(words, rf"(?s)^( (?:.*? )??)(?:{phrases}) ", 1)) - 1).cast("long").alias("first_word"),
        F.when(base, _spaces(F.regexp_extract(words, rf"(?s)^(.* )(?:{phrases}) ", 1)) - 1).cast("long").alias("last_word"),
        F.when(base, F.array_compact(F.array(*(F.when(F.contains(words, F.lit(f" {p} ")), F.lit(label)) for p, label in sorted(BASE, key=lambda b: b[1]))))).otherwise(F.array().cast("array<string>")).alias("__base"),
        F.when(F.col("__gate"), _survivors(_detections(words))).otherwise(F.array().cast("array<struct<begin:int,end:int,label:string,priority:int,weight:double>>")).alias("spans"),
    )
    every = F.array_sort(F.array_distinct(F.concat("__base", F.transform("spans", lambda s: s["label"]))))
    return df.select(
        *keep, "n_words", "n_base", "first_word", "last_word",
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["weight"])), F.lit(0.0)).alias("score"),
        "spans",
    )
