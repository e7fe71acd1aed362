"""Licence recognition by sentences and ordered rules, with DataFrame functions only.

A text is normalised (lower case, runs of anything but letters and digits become one blank) except for marks where a sentence
may begin or end: a full stop, exclamation or question mark before white space, and, inside a sentence as well, a newline and a
colon or semicolon before white space. So hard-wrapped sentences, with comment marks or indentation, are found as well as
whole lines; of several known sentences from one place the longest counts. The identifiers found, in text order, are matched against
licence rules: a rule is a sequence of identifiers that must follow each other without another identifier between them,
and rules are ordered, so a whole licence text outranks a mention by name. Both tables are small fixed parameters and
become map literals, so there is neither a join nor a shuffle.

Defined results: a null or empty text has no sentence and no licence (null); a sentence that is repeated counts at each
place; repeated rows are scanned alike; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

#: Known licence sentences, normalised, and their identifiers (fixed values).
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-name",
    "licensed under the apache license version 2 0 the license": "apache-name",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "released under the mit license": "mit-name",
    "this project is licensed under the mit license": "mit-name",
    "mit license": "mit-name",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "this work is licensed under the gnu general public license version 3": "gpl3-name",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "licensed under cc by nc 4 0": "cc-by-nc-name",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-name",
    "licensed under cc by 4 0": "cc-by-name",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-name",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "all rights reserved": "reserved",
}
#: Rules in order of rank: licence and sequence of identifiers (fixed values).
RULES = [
    ("Apache-2.0", ["apache-name", "apache-compliance", "apache-copy"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-name"]),
    ("GPL-3.0-or-later", ["gpl3-grant"]),
    ("GPL-3.0", ["gpl3-name"]),
    ("Apache-2.0", ["apache-name"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-name"]),
    ("CC-BY-4.0", ["cc-by-name"]),
    ("Proprietary", ["reserved"]),
]
SENTENCE_END = r"[.!?][\x20\x09-\x0D]+"
SOFT_END = r"[:;](?=[\x20\x09-\x0D])"
PLAIN_SENTENCE = re.compile("[a-z0-9]+(?: [a-z0-9]+)*")


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None,
             rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(doc_id, sentence_ids, rule_ranks, licence, licences).

    ``sentence_ids`` are the identifiers in text order, ``rule_ranks`` the places (from 1) of the rules that match, ``licence``
    the licence of the first of them, ``licences`` all of them without repetition, in rule order.
    """
    known, order = SENTENCES if sentences is None else sentences, RULES if rules is None else rules
    # \x01 ends a sentence, a newline may stand at its ends or inside
    marked = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SENTENCE_END, "\x01")
    marked = F.regexp_replace(F.regexp_replace(marked, SOFT_END, "\n"), "[^a-z0-9\n\x01]+", " ")
    longest_first = sorted(filter(PLAIN_SENTENCE.fullmatch, known), key=len, reverse=True)
    wrapped = "|".join(s.replace(" ", r"[ \n]++") for s in longest_first)
    found = F.regexp_extract_all(marked, F.lit(rf"(?:^|[\n\x01]) *+({wrapped})(?= *+(?:[\n\x01]|\z))"), F.lit(1)) if wrapped else F.array().cast("array<string>")
    plain = F.transform(found, lambda s: F.regexp_replace(s, r"[ \n]+", " "))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.lit(None).cast("map<string,string>")
    ids = F.filter(F.transform(plain, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull())
    named = docs.select(F.col(id_col).alias("doc_id"), ids.alias("sentence_ids"))
    line = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    ranks = F.array(*[F.when(F.contains(line, F.lit(f",{','.join(seq)},")), F.struct(F.lit(i).alias("rank"), F.lit(name).alias("licence")))
                      for i, (name, seq) in enumerate(order, 1)]).cast("array<struct<rank:int,licence:string>>")
    out = named.withColumn("hits", F.filter(ranks, lambda x: x.isNotNull()))
    return out.select("doc_id", "sentence_ids", F.col("hits.rank").alias("rule_ranks"), F.get(F.col("hits.licence"), F.lit(0)).alias("licence"),
                      F.array_distinct(F.col("hits.licence")).alias("licences"))
