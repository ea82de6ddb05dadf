"""License scan: known sentences become identifiers, ordered rules match identifier sequences. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh

#: Normalised sentence -> identifier.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheRef2",
    "you may not use this file except in compliance with the license": "ApacheNotUse",
    "you may obtain a copy of the license at": "ApacheObtain",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind": "AsIs",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "this program is free software": "GplFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "GplRedist",
    "either version 3 of the license or at your option any later version": "Gpl3OrLater",
    "licensed under cc by nc 4 0": "CcByNc4Ref",
    "licensed under cc by 4 0": "CcBy4Ref",
    "licensed under cc by sa 4 0": "CcBySa4Ref",
    "redistribution and use in source and binary forms with or without modification are permitted": "BsdGrant",
    "redistributions of source code must retain the above copyright notice": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice": "BsdBinary",
    "all rights reserved": "AllRights",
}

#: Fixed values: (licence, sequence of identifiers); an earlier rule takes its sentences before a later one.
RULES = [
    ("Apache-2.0", ["ApacheRef2", "ApacheNotUse", "ApacheObtain", "ApacheSee"]),
    ("Apache-2.0", ["ApacheRef2", "ApacheNotUse"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIs"]),
    ("MIT", ["MitRef", "AsIs"]),
    ("GPL-3.0-or-later", ["GplFree", "GplRedist", "Gpl3OrLater"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("Apache-2.0", ["ApacheRef2"]),
    ("MIT", ["MitRef"]),
    ("GPL-3.0", ["Gpl3Ref"]),
    ("CC-BY-NC-4.0", ["CcByNc4Ref"]),
    ("CC-BY-4.0", ["CcBy4Ref"]),
    ("CC-BY-SA-4.0", ["CcBySa4Ref"]),
]

_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and"
_REDIST = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"

#: Sentences as the full notices have them -> identifiers, several where one sentence says what short notices say in several.
NOTICES = {
    "licensed under the apache license version 2 0 the license": "ApacheRef2",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheObtain",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "ApacheObtain",
    _GRANT: "MitGrant",
    _AS_IS + " noninfringement": "AsIs",
    _AS_IS + " non infringement": "AsIs",
    "this program is free software " + _REDIST + " either version 3 of the license or at your option any later version": "GplFree,GplRedist,Gpl3OrLater",
    _REDIST: "GplRedist",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdNeither",
}

#: Rules that only full notices meet; they come before the others.
NOTICE_RULES = [("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdNeither"])]


def sentences(text):
    """Normalised sentences of a text column: cut at line ends and after ``.!?;`` before a blank, A-Z lower-cased, other than a-z and 0-9 as one space."""
    cut = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[.!?;][ \t]+|[\r\n]+", "\n")
    norm = F.transform(F.split(cut, "\n"), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    return F.filter(norm, lambda s: s != "")


def known_sentences(text, known: dict):
    """Identifiers of known sentences in text order. A sentence begins and ends where ``sentences`` cuts; line ends inside it are taken as blanks, unless a blank line or the end of a sentence is there."""
    low = F.concat(F.lit("P"), ascii_lower(F.coalesce(text, F.lit(""))), F.lit("P"))  # no A-Z is left: P marks hard cuts, L line ends
    cut = F.regexp_replace(F.regexp_replace(low, r"[.!?;](?:[ \t]+|(?=[\r\n]))", "P"), r"\r\n?|\n", "L")
    norm = F.regexp_replace(F.regexp_replace(cut, "[^a-z0-9PL]+", " "), " ?([PL]) ?", "$1")
    norm = F.regexp_replace(norm, "LL+|L?P[LP]*", "P")
    forms = "|".join(x.replace(" ", "[ L]") for x in sorted(known, key=lambda x: (-len(x), x)))
    found = F.regexp_extract_all(norm, F.lit(f"(?<=[PL])(?:{forms})(?=[PL])"), F.lit(0))
    ids = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.flatten(F.transform(found, lambda x: F.split(F.try_element_at(ids, F.translate(x, "L", " ")), ",")))


def scan_licenses(docs: DataFrame, text: str = "text", known=SENTENCES | NOTICES, rules=NOTICE_RULES + RULES) -> DataFrame:
    """``docs`` with n_sentences, sentence_ids, licenses and leftover_ids added.

    sentence_ids lists the identifiers of known sentences in text order, also of those that run over line ends (n_sentences counts lines); sentences
    that are not known stand between them unseen. A rule takes every place where its identifiers
    stand one after the other among those not yet taken, so rules given first win.
    licenses: names of rules that took something, distinct, in rule order;
    leftover_ids: known sentences no rule took. Null and empty texts have 0 sentences
    and empty lists; an empty table gives no rows. One row in, one row out, no shuffle: hot sources and copies cost nothing extra. Columns named as the new ones are replaced.
    """
    out = docs.withColumns({"n_sentences": F.size(sentences(F.col(text))).cast("long"), "sentence_ids": known_sentences(F.col(text), known)})
    steps = fresh([*out.columns, "licenses", "leftover_ids"], *[f"left{i}" for i in range(len(rules) + 1)])
    out = out.withColumn(steps[0], F.concat(F.lit(","), F.array_join("sentence_ids", ",,"), F.lit(",")))
    names = []
    for (name, seq), before, after in zip(rules, steps, steps[1:], strict=False):
        want = "," + ",,".join(seq) + ","
        names.append(F.when(F.instr(F.col(before), want) > 0, F.lit(name)))
        out = out.withColumn(after, F.replace(F.col(before), F.lit(want), F.lit(",#,")))
    left = F.filter(F.split(steps[-1], ","), lambda x: (x != "") & (x != "#"))
    out = out.withColumns({"licenses": F.array_distinct(F.array_compact(F.array(*names))), "leftover_ids": left})
    return out.drop(*steps)
