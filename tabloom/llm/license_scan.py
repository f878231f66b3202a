"""Licence recognition by sentences and ordered rules.

A text is cut into pieces at line ends and sentence ends; runs of pieces with the words of a known licence sentence are that
sentence, however it is wrapped or pointed. The identifiers found, in
text order, are a sequence that ordered rules are matched against, the most specific first. Every rule that matches takes its
sentences away, so that what is left can match another. Sentences that speak of a licence but aren't known are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised (lower case, letters and digits, single spaces).
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice-kept",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "this work is licensed under the gnu general public license version 2": "gpl-2-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-later",
    "licensed under cc by nc 4 0": "cc-by-nc-notice",
    "licensed under cc by 4 0": "cc-by-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2-notice",
    "all rights reserved": "reserved",
}

# Fixed values: (identifiers in order, licence); the first rules are tried first.
RULES = [
    (("mit-grant", "mit-notice-kept", "mit-as-is"), "MIT"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("apache-notice", "apache-use", "apache-copy", "apache-as-is"), "Apache-2.0"),
    (("apache-notice",), "Apache-2.0"),
    (("mit-notice",), "MIT"),
    (("gpl-3-later",), "GPL-3.0-or-later"),
    (("gpl-2-later",), "GPL-2.0-or-later"),
    (("gpl-3-notice",), "GPL-3.0-only"),
    (("gpl-2-notice",), "GPL-2.0-only"),
    (("cc-by-nc-notice",), "CC-BY-NC-4.0"),
    (("cc-by-sa-notice",), "CC-BY-SA-4.0"),
    (("cc-by-notice",), "CC-BY-4.0"),
    (("mpl-2-notice",), "MPL-2.0"),
    (("unlicense",), "Unlicense"),
]
#: A sentence with one of these words speaks of a licence; the words may stand on two lines.
SPEAKS = "licen[cs]e|permission|redistribut|copyright|warrant|rights[^a-z0-9]+reserved|public[^a-z0-9]+domain|free[^a-z0-9]+software"
UNKNOWN = "unknown"
#: A text is cut at line ends and after . ; : ! ? before white space; a digit's point is no end, nor are two line ends needed.
ENDS = "[\\n\\r]+|(?<=[.;:!?])[ \\t]+"
#: In a lower-case text capitals are free as marks: N a cut, X the ends of an address, V its start, K and L the ends of a
#: known sentence, C a piece that goes on with one, S words of SPEAKS on two lines.
URL = "(?<![a-z0-9])(?:https?://|www\\.)[^\\sN]+"
#: A known sentence is a run of whole pieces with its words, so it may be wrapped or hold cuts of its own; the longest goes first.
KNOWN = "(?<![^NX]) ?(?:{}) ?(?![^NX])".format("|".join(s.replace(" ", "[ N]++") for s in sorted(SENTENCES, key=len, reverse=True)))


def marked(text: Column) -> Column:
    """Lower-case ASCII letters and digits of a text with single spaces between, and the marks."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), ENDS, "N"), URL, "XV$0X")
    flat = F.regexp_replace(flat, "[^a-z0-9NVX]+", " ")
    told = F.regexp_replace(F.regexp_replace(flat, KNOWN, "K$0L"), "(K|\\G(?!^))([^NKL]*)N", "$1$2NC")
    return F.regexp_replace(told, "(rights(?=[ NC]+reserved)|public(?=[ NC]+domain)|free(?=[ NC]+software))(?= ?N)", "$1S")


def sentence_ids(text: Column) -> Column:
    """(place, part, id, url) of the sentences that are known or speak of a licence, in text order. A known sentence has the
    place of its first piece; url tells an unknown piece that is nothing but an address."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    speaks = f"S|{SPEAKS}"

    def item(place: Column, part: Column, id: Column, url: Column) -> Column:
        return F.struct(place.alias("place"), part.cast("int").alias("part"), id.alias("id"), url.alias("url"))

    def pieces(piece: Column, place: Column) -> Column:
        whole = F.array(item(place, F.lit(0), F.lit(UNKNOWN), piece.rlike("^ ?XV[^X]*X ?$")))
        units = F.transform(F.split(piece, "X"), lambda u, k: F.struct(k.alias("part"), u.alias("u")))
        # the ids of known sentences, null here, are laid in below
        told = F.filter(units, lambda x: ~x["u"].startswith("C") & (x["u"].startswith("K") | x["u"].rlike(speaks)))
        cut = F.transform(told, lambda x: item(
            place, x["part"], F.when(~x["u"].startswith("K"), UNKNOWN), x["u"].startswith("V")
        ))
        return F.when(piece.rlike("^C|K"), cut).when(piece.rlike(speaks), whole)

    def found(t: Column) -> Column:
        items = F.flatten(F.array_compact(F.transform(F.split(t, "N"), pieces)))
        names = F.transform(
            F.regexp_extract_all(t, F.lit("K([^L]*)L"), 1), lambda k: F.try_element_at(known, F.trim(F.regexp_replace(k, "[ A-Z]+", " ")))
        )
        named = F.zip_with(F.filter(items, lambda x: x["id"].isNull()), names, lambda x, name: item(x["place"], x["part"], name, x["url"]))
        return F.array_sort(F.concat(F.filter(items, lambda x: x["id"].isNotNull()), named))

    # as a lambda's argument the marked text is made once
    return F.get(F.transform(F.array(marked(text)), found), F.lit(0))


def match_rules(ids: Column) -> tuple[Column, Column]:
    """Licences in rule order, and the identifiers that no rule took, from identifiers in text order. A rule's identifiers
    must follow each other; unknown sentences between them are in the way, an address between two known ones isn't."""

    def is_known(at: Column) -> Column:
        return F.coalesce(F.get(ids, at)["id"] != UNKNOWN, F.lit(False))

    kept = F.filter(ids, lambda x, k: ~(x["url"] & is_known(k - 1) & is_known(k + 1)))
    rest = F.concat(F.lit(";"), F.array_join(F.transform(kept, lambda x: x["id"]), ";;"), F.lit(";"))
    found: list[Column] = []
    for sequence, licence in RULES:
        written = "".join(f";{name};" for name in sequence)
        found.append(F.when(F.contains(rest, F.lit(written)), F.lit(licence)))
        rest = F.replace(rest, F.lit(written), F.lit(";-;"))
    left = F.filter(F.split(rest, ";+"), lambda x: ~x.isin("", "-"))
    return F.array_distinct(F.array_compact(F.array(*found))), left


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, licences, sentences, places, unmatched) of every row: licences in rule order, the identifiers found and their
    sentences' places (from 0), and how many of them no rule took.

    Null and empty texts and texts without licence sentences have empty lists. Repeated rows are scanned each; null ids are kept.
    Other columns don't matter. An empty table gives an empty table. Whole texts are read, wherever a sentence stands.
    """
    none = F.expr("cast(array() as array<struct<place:int,part:int,id:string,url:boolean>>)")
    ids = F.when(F.col(text).rlike(f"(?i){SPEAKS}"), sentence_ids(F.col(text))).otherwise(none)
    told = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(ids, none).alias("ids"))
    licences, left = match_rules(F.col("ids"))
    return told.select(
        "doc_id", licences.alias("licences"), F.transform("ids", lambda x: x["id"]).alias("sentences"),
        F.transform("ids", lambda x: x["place"]).alias("places"), F.size(left).alias("unmatched"),
    )
