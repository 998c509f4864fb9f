"""License scan by ordered signature rules, in built-in functions only.

A text is brought to words in lower case with single spaces between them. Rules are regular expressions over that,
written for license families and multiplied over a few templates. A family's rules run only on texts that hold the
family's keyword, and no family is looked for in texts without any of a handful of general words. Every match is an
interval with its rule's priority: an interval that lies within another of the same or a better priority is
suppressed, so that "licensed under the apache license version 2 0" does not also count as a bare "apache license".

Everything happens within a row: no shuffle, no join. Null texts count as empty and have no words and no labels.
Repeated rows give repeated results.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and labels that are always reported where their words stand consecutively.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: License families: label, keyword that every match holds, name as words (a regular expression), and short identifier
#: if it has one of its own.
FAMILIES = (
    ("apache-2.0", "apache", "apache(?: software)?(?: public)? license(?: version)? v?2(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache", "apache(?: software)? license(?: version)? 1 1", "apache 1 1"),
    ("apache", "apache", "apache(?: software| public)* license", "apache"),
    ("mit", "mit", "mit(?: style)? license", "mit"),
    ("mit", "expat", "expat(?: style)? license", None),
    ("mit", "x11", "x11(?: style)? license", None),
    ("bsd-3-clause", "bsd", "(?:new |revised |modified )?bsd 3 clause|3 clause bsd|(?:new|revised|modified) bsd license", "bsd 3 clause"),
    ("bsd-2-clause", "bsd", "(?:simplified )?bsd 2 clause|2 clause bsd|simplified bsd license|freebsd license", "bsd 2 clause"),
    ("bsd", "bsd", "bsd(?: style)? license", "bsd"),
    ("gpl-2.0", "general public", "(?:gnu )?general public license(?: version| v)? ?2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "general public", "(?:gnu )?general public license(?: version| v)? ?3(?: 0)?", "gpl 3 0"),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public license", "lgpl"),
    ("agpl-3.0", "general public", "(?:gnu )?affero general public license", "agpl 3 0"),
    ("gpl", "general public", "(?:gnu )?general public license", "gpl"),
    ("gpl", "gpl", "gnu gpl|gpl license|gplv[123]", "gpl"),
    ("lgpl", "lgpl", "gnu lgpl|lgpl license|lgplv[23]", "lgpl"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation license", "gfdl"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version)? 2(?: 0)?", "mpl 2 0"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version)? 1 1", "mpl 1 1"),
    ("mpl", "mozilla", "mozilla public license", "mpl"),
    ("epl-2.0", "eclipse", "eclipse public license(?: version| v)? ?2(?: 0)?", "epl 2 0"),
    ("epl", "eclipse", "eclipse public license", "epl"),
    ("edl", "eclipse", "eclipse distribution license", "edl"),
    ("cddl", "common development", "common development and distribution license", "cddl"),
    ("cpl", "common public", "common public license", "cpl"),
    ("eupl", "european union", "european union public licen[cs]e", "eupl"),
    ("osl", "open software", "open software license", "osl"),
    ("afl", "academic free", "academic free license", "afl"),
    ("artistic", "artistic", "artistic license", "artistic"),
    ("bsl-1.0", "boost", "boost software license", "bsl 1 0"),
    ("busl", "business source", "business source license", "busl"),
    ("elastic", "elastic", "elastic license", "elastic 2 0"),
    ("sspl", "server side", "server side public license", "sspl 1 0"),
    ("isc", "isc", "isc license", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)? license", "zlib"),
    ("unlicense", "unlicense", "the unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("ofl", "open font", "(?:sil )?open font license", "ofl 1 1"),
    ("psf", "python software", "python software foundation license", "psf 2 0"),
    ("php", "php", "php license", "php 3 01"),
    ("ruby", "ruby", "ruby license", "ruby"),
    ("postgresql", "postgresql", "postgresql license", "postgresql"),
    ("odbl", "open database", "open database license", "odbl 1 0"),
    ("odc-by", "open data commons", "open data commons attribution license", "odc by 1 0"),
    ("pddl", "public domain dedication", "public domain dedication and license", "pddl 1 0"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv\\w*", "cc by nc nd"),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike", "cc by nc sa"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial", "cc by nc"),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv\\w*", "cc by nd"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike", "cc by sa"),
    ("cc-by", "creative commons", "creative commons attribution", "cc by"),
    ("cc-by-nc", "cc by nc", "cc by nc(?: [1-4] 0)?", "cc by nc"),
    ("cc-by-nd", "cc by nd", "cc by nd(?: [1-4] 0)?", "cc by nd"),
    ("cc-by-sa", "cc by sa", "cc by sa(?: [1-4] 0)?", "cc by sa"),
    ("cc", "creative commons", "creative commons(?: license)?", "cc"),
)
#: Ways in which a license is named: words before and after, priority (lower wins), and confidence.
TEMPLATES = (
    ("spdx license identifier (?:{id})", 1, 1.0),
    ("(?:licen[cs]ed|released|distributed|available|published|provided|redistribute it|offered) under (?:the )?"
     "(?:terms of (?:the )?)?(?:{name})(?: (?:licen[cs]e|international|unported))*", 1, 0.95),
    ("(?:terms of|subject to|governed by|covered by|see) (?:the )?(?:{name})", 2, 0.85),
    ("(?:opensource|apache|gnu|mozilla|eclipse|spdx|creativecommons) org licenses (?:{id})(?: html| txt)?", 2, 0.9),
    ("(?:{name})", 3, 0.7),
)
#: Wordings of licenses and notices: label, keyword, expression, priority, confidence.
WORDINGS = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 1, 0.95),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 1, 0.9),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification", 1, 0.9),
    ("gpl", "free software", "this program is free software you can redistribute it", 1, 0.9),
    ("apache-2.0", "in compliance with", "you may not use this file except in compliance with the license", 1, 0.9),
    ("bsl-1.0", "boost", "distributed under the boost software license", 1, 0.95),
    ("zlib", "as is", "this software is provided as is without any express or implied warranty", 2, 0.6),
    ("no-warranty", "warranty", "without warranty of any kind", 3, 0.5),
    ("no-warranty", "warranties", "without warranties or conditions of any kind", 3, 0.5),
    ("public-domain", "public domain", "(?:released|dedicated|placed|is) (?:in|into|to) the public domain", 1, 0.9),
    ("public-domain", "public domain", "public domain", 3, 0.5),
    ("proprietary", "proprietary", "proprietary and confidential|confidential and proprietary", 2, 0.8),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|use|distribution)(?: \\w+){0,6} prohibited", 2, 0.8),
    ("reserved", "reserved", "all rights reserved", 2, 0.6),
    ("reserved", "rechte", "alle rechte vorbehalten", 2, 0.6),
    ("reserved", "droits", "tous droits réservés", 2, 0.6),
    ("reserved", "derechos", "todos los derechos reservados", 2, 0.6),
    ("reserved", "rights", "some rights reserved", 2, 0.6),
    ("reserved", "no part of this", "no part of this (?:work|publication|book) may be reproduced", 2, 0.6),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 3, 0.4),
    ("copyright", "copyright", "copyright (?:by|of|holders?|notice)", 3, 0.3),
    ("gpl", "lizenz", "gnu general public lizenz", 2, 0.8),
    ("gpl", "gpl", "unter der gpl", 2, 0.8),
    ("cc-by", "creative commons", "creative commons (?:namensnennung|lizenz)", 2, 0.8),
    ("cc", "licence", "licence creative commons", 2, 0.8),
    ("cc", "licencia", "licencia creative commons", 2, 0.8),
)
#: Some general word stands in every text that any rule can match.
GENERAL = ("licen", "lizenz", "right", "recht", "droit", "derecho", "permi", "free", "public", "commons", "spdx", "cc0",
           "cc by", "wtfpl", "gpl", "bsd", "boost", "redistribution", "warrant", "proprietary", "unauthorized", "as is",
           "org licenses", "no part of this")

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def rules() -> dict[str, list[tuple[str, str, int, float]]]:
    """Per keyword its rules in order: pattern, label, priority, confidence."""
    found: dict[str, list[tuple[str, str, int, float]]] = {}
    for label, keyword, name, short in FAMILIES:
        for pattern, priority, confidence in TEMPLATES:
            if short is None and "{id}" in pattern:
                continue
            # an identifier or address holds the short form, which need not hold the family's keyword
            key = short.split(" ")[0] if "{id}" in pattern else keyword
            found.setdefault(key, []).append((pattern.format(name=name, id=short), label, priority, confidence))
    for label, keyword, pattern, priority, confidence in WORDINGS:
        found.setdefault(keyword, []).append((pattern, label, priority, confidence))
    return found


def _rule_table() -> Column:
    """All rules as one constant, by keyword; every pattern ends at word boundaries."""
    families = []
    for keyword, own in rules().items():
        entries = [F.struct(F.lit(f"(?<= )(?:{pattern})(?= )").alias("pattern"), F.lit(label).alias("label"),
                            F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence"))
                   for pattern, label, priority, confidence in own]
        families.append(F.struct(F.lit(keyword).alias("keyword"), F.array(*entries).alias("rules")))
    return F.array(*families)


def words_of(text: Column) -> Column:
    """The words of a text in lower case (A-Z only), each with one space before it, and one at the end."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, NOT_WORD, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _matches(words: Column, rule: Column) -> Column:
    """Intervals of a rule's matches: start, negated end, priority, label and confidence, as they are to be sorted."""
    hits = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    gaps = F.split(words, rule["pattern"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast(
        "array<struct<start:int,past:int,priority:int,label:string,confidence:double>>").alias("found"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(F.struct(
            begin.alias("start"), (-end).alias("past"), rule["priority"].alias("priority"), rule["label"].alias("label"),
            rule["confidence"].alias("confidence")))).alias("found"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, start, add, lambda state: state["found"])).otherwise(start["found"])


def _unsuppressed(found: Column) -> Column:
    """Labels, confidence and number of intervals that lie in no other of the same or a better priority.

    In order of start and falling end, an interval lies in an earlier one exactly if some earlier end reaches its own;
    the furthest end so far is kept for each of the three priorities.
    """
    zero = F.struct(*[F.lit(-1).alias(f"end{p}") for p in (1, 2, 3)], F.array().cast("array<string>").alias("labels"),
                    F.lit(0.0).alias("confidence"), F.lit(0).alias("n"))

    def add(state: Column, one: Column) -> Column:
        reach = F.when(one["priority"] == 1, state["end1"]).when(
            one["priority"] == 2, F.greatest(state["end1"], state["end2"])).otherwise(
            F.greatest(state["end1"], state["end2"], state["end3"]))
        kept, end = reach < -one["past"], -one["past"]
        return F.struct(
            *[F.when(kept & (one["priority"] == p), F.greatest(state[f"end{p}"], end)).otherwise(state[f"end{p}"]).alias(f"end{p}")
              for p in (1, 2, 3)],
            F.when(kept, F.array_union(state["labels"], F.array(one["label"]))).otherwise(state["labels"]).alias("labels"),
            F.when(kept, F.greatest(state["confidence"], one["confidence"])).otherwise(state["confidence"]).alias("confidence"),
            F.when(kept, state["n"] + 1).otherwise(state["n"]).alias("n"))

    return F.aggregate(F.array_sort(found), zero, add)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, places of the base phrases, labels of base and rules, and a score.

    The score is the highest confidence of the rules that matched, 0 without any match.
    """
    phrases = "|".join(BASE)
    words = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words_of(F.col("text").cast("string")).alias("words"))
    w = F.col("words")
    held = reduce(Column.__or__, [w.contains(f" {p} ") for p in BASE])
    general = reduce(Column.__or__, [w.contains(g) for g in GENERAL])
    families = F.filter(_rule_table(), lambda f: w.contains(f["keyword"]))
    found = F.flatten(F.transform(F.flatten(F.transform(families, lambda f: f["rules"])), lambda r: _matches(w, r)))
    staged = words.select(
        "doc_id", "words",
        F.when(held, F.split(w, f" (?=(?:{phrases}) )")).otherwise(F.array(w)).alias("parts"),
        F.array_compact(F.array(*[F.when(w.contains(f" {p} "), F.lit(label)) for p, label in BASE.items()])).alias("base"),
        F.when(general, _unsuppressed(found)).alias("rules"))
    parts, n_words = F.col("parts"), F.when(w == "  ", F.lit(0)).otherwise(_spaces(w) - 1)
    n_base = F.size(parts) - 1
    labels = F.array_union("base", F.coalesce(F.col("rules.labels"), F.array().cast("array<string>")))
    return staged.select(
        "doc_id", n_words.cast("bigint").alias("n_words"), n_base.cast("bigint").alias("n_base"),
        F.when(n_base > 0, _spaces(parts[0])).cast("bigint").alias("first_word"),
        F.when(n_base > 0, n_words - _spaces(F.element_at(parts, -1))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("rules.confidence"), F.lit(0.0)), F.when(n_base > 0, 0.5).otherwise(0.0)).alias("score"),
        F.coalesce(F.col("rules.n"), F.lit(0)).cast("bigint").alias("n_matches"))
