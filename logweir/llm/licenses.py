r"""License scan: an ordered list of signature rules, gated by keywords, overlaps resolved by priority.

``rules()`` crosses the license families below with the ways in which texts name a license (an SPDX tag,
"licensed under the ...", "... license", "... version 2.0", a bare short name) to some hundreds of regular
expressions over the lower-cased text, beside hand-written signatures of sentences from the licenses themselves. A rule only runs on a text that passes the gate of its form (``GATES``) and
holds the rule's keyword. Gates and keywords are single words that the expressions cannot do without, so they never
stop a rule that would match. Overlaps are resolved by priority: matches are taken from the highest priority down,
the earlier and then the longer ones first, and one that lies in a match taken before, or overlaps it, is suppressed.
So nothing is lost to a match that is itself suppressed.

Beside the rules, the base counts every place where the words of a phrase stand one after another; words
are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``. Base labels are always part of ``labels``.

All is one projection over the scan, without shuffle; the largest unit of work is one text.

Defined results: NULL and empty texts have no words and no labels, positions NULL, score 0; repeated rows
are scanned one by one; an empty table gives an empty result; whatever columns the input has, ``scan`` returns
its rows as the struct ``doc`` beside columns of its own, so that names never clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.text import bind, lower_ascii

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# label: (keyword the text must hold, spellings of the name, SPDX ids), spaces stand for any separators.
FAMILIES = {
    "mit": ("mit|expat", "mit|expat", "mit(-0)?"),
    "apache": ("apache", "apache( software)?", r"apache-[12]\.[01]"),
    "gpl": ("gpl|general", "(gnu )?general public|gnu gpl|gpl", r"gpl-[123]\.0(-only|-or-later)?"),
    "lgpl": ("lgpl|lesser|library", "(gnu )?(lesser|library) general public|gnu lgpl|lgpl", r"lgpl-[23]\.[01](-only|-or-later)?"),
    "agpl": ("agpl|affero", "(gnu )?affero general public|gnu agpl|agpl", r"agpl-[13]\.0(-only|-or-later)?"),
    "bsd": ("bsd", "([234] clause |new |modified |simplified )?bsd( [0234] clause)?", "(0bsd|bsd-[1-4]-clause)"),
    "mpl": ("mpl|mozilla", "mozilla public|mpl", r"mpl-[12]\.[01]"),
    "epl": ("epl|eclipse", "eclipse public|epl", r"epl-[12]\.0"),
    "cddl": ("cddl|common", "common development and distribution|cddl", r"cddl-1\.[01]"),
    "isc": ("isc", "isc", "isc"),
    "zlib": ("zlib", "zlib( libpng)?", "zlib"),
    "bsl": ("boost|bsl", "boost software", r"bsl-1\.0"),
    "unlicense": ("unlicense", "the unlicense|unlicense", "unlicense"),
    "wtfpl": ("wtfpl|fuck", "wtfpl|do what the fuck you want to public", "wtfpl"),
    "cc-by": ("creative|cc", "(creative commons|cc) (attribution|by)", r"cc-by-[1-4]\.[05]"),
    "cc-by-sa": ("creative|cc", "(creative commons|cc) (attribution share ?alike|by sa)", r"cc-by-sa-[1-4]\.[05]"),
    "cc-by-nc": ("creative|cc", "(creative commons|cc) (attribution non ?commercial|by nc)", r"cc-by-nc-[1-4]\.[05]"),
    "cc-by-nd": ("creative|cc", "(creative commons|cc) (attribution no derivatives|by nd)", r"cc-by-nd-[1-4]\.[05]"),
    "cc0": ("cc0|creative", "cc0|creative commons zero", r"cc0-1\.0"),
    "artistic": ("artistic", "(perl )?artistic", r"artistic-[12]\.0"),
    "psf": ("psf|python", "python software foundation|psf", r"(psf|python)-2\.0"),
    "postgresql": ("postgresql", "postgresql", "postgresql"),
    "ofl": ("ofl|font", "(sil )?open font|ofl", r"ofl-1\.[01]"),
    "ms-pl": ("microsoft|ms", "microsoft public|ms pl", "ms-pl"),
    "ms-rl": ("microsoft|ms", "microsoft reciprocal|ms rl", "ms-rl"),
    "eupl": ("eupl|european", "european union public|eupl", r"eupl-1\.[012]"),
    "cecill": ("cecill", "cecill( [bc])?", r"cecill-[bc12](\.[01])?"),
    "afl": ("afl|academic", "academic free|afl", r"afl-[123]\.[01]"),
    "osl": ("osl|open", "open software|osl", r"osl-[123]\.[01]"),
    "x11": ("x11", "x11", "x11"),
    "ncsa": ("ncsa", "(university of illinois )?ncsa( open source)?", "ncsa"),
    "openssl": ("openssl", "openssl", "openssl"),
    "vim": ("vim", "vim", "vim"),
    "ruby": ("ruby", "ruby", "ruby"),
    "php": ("php", "php", r"php-3\.0[01]?"),
    "qpl": ("qpl|public", "q public|qpl", r"qpl-1\.0"),
    "sleepycat": ("sleepycat", "sleepycat", "sleepycat"),
    "w3c": ("w3c", "w3c( software)?", "w3c"),
    "zpl": ("zpl|zope", "zope public|zpl", r"zpl-[12]\.[01]"),
    "upl": ("upl|universal", "universal permissive|upl", r"upl-1\.0"),
    "ecl": ("ecl|educational", "educational community|ecl", r"ecl-[12]\.0"),
    "beerware": ("beer", "beer ?ware", "beerware"),
    "apsl": ("apsl|apple", "apple public source|apsl", r"apsl-[12]\.[01]"),
    "cpl": ("cpl|common", "common public|cpl", r"cpl-1\.0"),
    "lppl": ("lppl|latex", "latex project public|lppl", r"lppl-1\.[0-3][abc]?"),
    "odbl": ("odbl|database", "open (data commons open )?database|odbl", r"odbl-1\.0"),
    "sspl": ("sspl|server", "server side public|sspl", r"sspl-1\.0"),
    "busl": ("busl|business", "business source|busl", r"busl-1\.1"),
    "elastic": ("elastic", "elastic", r"elastic-2\.0"),
}

# Fixed values, label: (keyword, sentences of the license or of its notice).
BODIES = {
    "mit": ("hereby", ("permission is hereby granted free of charge to any person obtaining a copy of this software",
                       "the above copyright notice and this permission notice shall be included in all copies or substantial"
                       " portions of the software")),
    "bsd": ("redistribution|redistributions", (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the above copyright notice",
        "redistributions in binary form must reproduce the above copyright notice")),
    "gpl": ("redistribute", ("this program is free software you can redistribute it",
                             "\\w+ is free software you can redistribute it and or modify it under the terms of the gnu general public")),
    "lgpl": ("redistribute", ("this library is free software you can redistribute it",)),
    "agpl": ("affero", ("under the terms of the gnu affero general public",)),
    "apache": ("compliance", ("you may not use this file except in compliance with the license",)),
    "isc": ("fee", ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
    "zlib": ("misrepresented", ("the origin of this software must not be misrepresented",)),
    "mpl": ("subject", ("this source code form is subject to the terms of the mozilla public",)),
    "bsl": ("organization", ("permission is hereby granted free of charge to any person or organization obtaining a copy",)),
    "unlicense": ("unencumbered", ("this is free and unencumbered software released into the public domain",)),
    "epl": ("accompanying", ("this program and the accompanying materials are made available under the terms of the eclipse public",)),
    "cc0": ("waived", ("has waived all copyright and related or neighboring rights",)),
    "postgresql": ("agreement", ("permission to use copy modify and distribute this software and its documentation for any purpose"
                                 " without fee and without a written agreement is hereby granted",)),
}
BODY = (70, 1.0)

# form: (priority, score, pattern with {name} or {spdx}); higher priority is tried and kept first.
FORMS = {
    "tag": (60, 1.0, "spdx license identifier {spdx}"),
    "grant": (50, 0.95, "(licensed|released|distributed|available|provided|published|covered)( \\w+)? (under|by)( the)?"
                        "( terms of( the)?)? ({name})( licen[cs]e)?( v(ersion)? ?[0-9](\\.[0-9]+)?)?"),
    "versioned": (40, 0.9, "({name})( licen[cs]e)? v(ersion)? ?[0-9](\\.[0-9]+)?"),
    "named": (30, 0.8, "({name}) (public )?licen[cs]e"),
    "reversed": (20, 0.7, "licen[cs]e( is)? ({name})"),
}
# form: what any text that it matches holds.
GATES = {
    "tag": "spdx",
    "grant": "licensed|released|distributed|available|provided|published|covered",
    "versioned": f"{SEPARATOR}v(?:ersion)?{SEPARATOR}*[0-9]",
    "named": "licen",
    "reversed": "licen",
    "body": "hereby|redistribut|affero|compliance|misrepresented|subject|unencumbered|accompanying|waived",
}


def rules() -> list[tuple[str, str, int, float, str, str]]:
    """(id, label, priority, score, keyword alternatives, regular expression), highest priority first."""
    def pattern(text: str) -> str:
        spaced = text.replace(" ?", "\0").replace(" ", SEPARATOR + "+").replace("\0", SEPARATOR + "*")
        return f"(?<!{WORD})(?:{spaced})(?!{WORD})"

    made = [(f"{label}-{form}", label, priority, score, keyword,
             pattern(shape.format(name=name, spdx=spdx.replace("-", SEPARATOR)).replace("(", "(?:")))
            for form, (priority, score, shape) in FORMS.items()
            for label, (keyword, name, spdx) in FAMILIES.items()]
    made += [(f"{label}-{k}-body", label, *BODY, keyword, pattern(sentence))
             for label, (keyword, sentences) in BODIES.items() for k, sentence in enumerate(sentences)]
    return sorted(made, key=lambda rule: -rule[2])


def gates(text: Column) -> Column:
    """For each form whether its rules can match."""
    def passes(gate: str) -> Column:
        if SEPARATOR in gate:
            return text.rlike(gate)
        return reduce(lambda a, b: a | b, (text.contains(word) for word in gate.split("|")))

    return F.array(*[passes(gate) for gate in GATES.values()])


def gated_matches(text: Column) -> Column:
    """``matches``, without looking at the rules where no form can match."""
    nothing = F.array().cast(
        "array<struct<start:int,minus_stop:int,minus_priority:int,rule:string,label:string,score:double>>")
    return bind(gates(text), lambda open: F.when(F.array_contains(open, True), matches(text, open)).otherwise(nothing))


def find(text: Column, regex: Column) -> Column:
    """Start and length of each match, in text order."""
    nothing = F.array().cast("array<struct<start:int,size:int>>")
    def places(hits: Column) -> Column:
        def step(a: Column, gap: Column, hit: Column) -> Column:
            start = a["at"] + gap
            return F.struct((start + hit).alias("at"),
                            F.concat(a["found"], F.array(F.struct(start.alias("start"), hit.alias("size")))).alias("found"))

        gaps = F.transform(F.split(text, regex, -1), lambda x: F.length(x))
        both = F.arrays_zip(gaps.alias("gap"), F.transform(hits, lambda x: F.length(x)).alias("hit"))
        start = F.struct(F.lit(0).alias("at"), nothing.alias("found"))
        return F.aggregate(F.slice(both, 1, F.size(hits)), start, lambda a, x: step(a, x["gap"], x["hit"]),
                           lambda a: a["found"])

    return bind(F.regexp_extract_all(text, regex, F.lit(0)),
                lambda hits: F.when(F.size(hits) == 0, nothing).otherwise(places(hits)))


def matches(text: Column, open: Column) -> Column:
    """All matches of all rules of open forms whose keyword the text holds, sorted for ``resolve``."""
    shape = "struct<rule:string,label:string,priority:int,score:double,keys:array<string>,regex:string,form:int>"
    forms = list(GATES)
    listed = F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("label"), F.lit(r[2]).alias("priority"),
                                F.lit(r[3]).alias("score"), F.array(*map(F.lit, r[4].split("|"))).alias("keys"),
                                F.lit(r[5]).alias("regex"), F.lit(forms.index(r[0].rsplit("-", 1)[1])).alias("form"))
                       for r in rules()]).cast(f"array<{shape}>")
    gated = F.filter(listed, lambda r: F.get(open, r["form"]) & F.exists(r["keys"], lambda key: text.contains(key)))
    found = F.transform(gated, lambda r: F.transform(find(text, r["regex"]), lambda m: F.struct(
        m["start"].alias("start"), (-m["start"] - m["size"]).alias("minus_stop"), (-r["priority"]).alias("minus_priority"),
        r["rule"].alias("rule"), r["label"].alias("label"), r["score"].alias("score"))))
    return F.array_sort(F.flatten(found))


def resolve(found: Column) -> Column:
    """Labels, number and best score of the matches that stay."""
    ranked = F.array_sort(F.transform(found, lambda m: F.struct(
        m["minus_priority"], m["start"], m["minus_stop"], m["rule"], m["label"], m["score"])))
    nothing = F.array().cast("array<struct<start:int,stop:int,label:string,score:double>>")

    def step(taken: Column, m: Column) -> Column:
        clash = F.exists(taken, lambda t: (m["start"] < t["stop"]) & (t["start"] < -m["minus_stop"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(F.struct(
            m["start"].alias("start"), (-m["minus_stop"]).alias("stop"), m["label"].alias("label"), m["score"].alias("score")))))

    return bind(F.aggregate(ranked, nothing, step), lambda taken: F.struct(
        F.array_distinct(F.transform(F.array_sort(taken), lambda t: t["label"])).alias("labels"),
        F.size(taken).alias("n"), F.coalesce(F.array_max(F.transform(taken, lambda t: t["score"])), F.lit(0.0)).alias("score")))


def base_places(text: Column) -> Column:
    """(word position, label) of every base phrase in the lower-cased text."""
    def at(w: Column, i: Column, phrase: str) -> Column:
        return reduce(lambda a, b: a & b, (F.get(w, i + k) == word for k, word in enumerate(phrase.split())))

    def label(w: Column, i: Column) -> Column:
        cases = F.lit(None).cast("string")
        for phrase, name in BASE.items():
            cases = F.when(at(w, i, phrase), F.lit(name)).otherwise(cases)
        return cases

    listed = F.filter(F.split(text, SEPARATOR + "+", -1), lambda x: x != "")
    return bind(listed, lambda w: F.filter(
        F.transform(w, lambda _, i: F.struct(i.cast("bigint").alias("i"), label(w, i).alias("label"))),
        lambda x: x["label"].isNotNull()))


def count_words(text: Column) -> Column:
    edge = F.left(text, F.lit(1)).rlike(SEPARATOR).cast("int") + F.right(text, F.lit(1)).rlike(SEPARATOR).cast("int")
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, SEPARATOR + "+", -1)) - edge).cast("bigint")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input rows as ``doc``, ``n_words``, ``base`` places, all ``matches`` and what is ``found`` in the end."""
    low = F.col("low")
    phrases = "|".join(phrase.replace(" ", SEPARATOR + "+") for phrase in BASE)
    no_base = F.array().cast("array<struct<i:bigint,label:string>>")
    rows = docs.select(F.struct("*").alias("doc"), lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("low")).select(
        "doc", count_words(low).alias("n_words"),
        F.when(low.contains("license") & low.rlike(phrases), base_places(low)).otherwise(no_base).alias("base"),
        gated_matches(low).alias("matches"))
    return rows.withColumn("found", F.when(F.size("matches") > 0, resolve(F.col("matches"))))
