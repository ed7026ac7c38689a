"""License scans by sentence rules.

A text is split into sentences (after sentence marks, at blank lines and list items; wrapped lines are joined); each is
normalised (lower case, quotes and markers away, one space, ``licence`` as ``license``, ``version`` as ``v``) and mapped
to identifiers of known licence sentences: by the whole sentence (``EXACT``), else by the patterns it holds (``SENTENCES``: names
with versions, and sentences with fields), by place, each once; where two start at one place the earlier in the list
counts. A ``^`` in a pattern is the start of a line or sentence. A sentence that denies a licence (``DENIED``: "is not
licensed under") has no identifiers. An SPDX tag gives one identifier for each licence of its expression, in order;
exceptions after WITH are left out. The sequence of identifiers of a text is then matched against ordered rules: a
rule is a run of identifiers and the licence it stands for; an earlier rule takes its run before a later one. What
no rule takes is reported as unmatched.

All of it is one projection of DataFrame functions: no shuffle, no Python. Normalising never joins what stands apart, so
a known sentence can only be in a text that has one of the words the patterns need (``needed``, taken from the tables
themselves); only such texts are split and matched.

Defined results: a null or empty text, or one without a known sentence, has no sentences and no licences. A text
that names a licence twice lists it once, in order of its first mention. Very long texts are read whole. Rows are scanned
one by one, whatever their id, repeated rows alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtox.llm.rows import typed

#: Identifier and pattern of known licence sentences, in order; patterns match normalised sentences.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("cc0", r"(\bcc0\b|public domain dedication)"),
    ("agpl-3", "gnu affero general public license,? v ?3"),
    ("lgpl-3", "gnu lesser general public license,? v ?3"),
    ("lgpl-2.1", "gnu lesser general public license,? v ?2[.]1"),
    ("gpl-3", "gnu (general public license|gpl),? v ?3"),
    ("gpl-2", "gnu (general public license|gpl),? v ?2"),
    ("gpl-any", "gnu general public license"),
    ("apache-2", "apache license,? v ?2[.]0"),
    ("mit", "(released|licensed|available|distributed) under (the )?(terms of the )?mit license"),
    ("bsd-3", "bsd 3-clause|3-clause bsd"),
    ("bsd-2", "bsd 2-clause|2-clause bsd"),
    ("epl-2", "eclipse public license( -)?,? (v ?)?2[.]0"),
    ("epl-1", "eclipse public license( -)?,? (v ?)?1[.]0"),
    ("bsl-1", "boost software license( -)?,? (v ?)?1[.]0"),
    ("gfdl-1.3", "gnu free documentation license,? v ?1[.]3"),
    ("gfdl-1.2", "gnu free documentation license,? v ?1[.]2"),
    ("gfdl-1.1", "gnu free documentation license,? v ?1[.]1"),
    ("gfdl-any", "gnu free documentation license"),
    ("ofl-1.1", "sil open font license,? v ?1[.]1"),
    ("cddl-1", "common development and distribution license( cddl)?,? v ?1[.]0"),
    ("artistic-2", "artistic license,? (v ?)?2[.]0"),
    ("odbl", "open (data commons open )?database license"),
    ("psf", "python software foundation license"),
    ("unlicense-name", "(under the unlicense|^the unlicense)"),
    ("isc-name", "(under the isc license|^isc license|^the isc license)"),
    ("isc-grant", "^permission to use, copy, modify,? and (or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib-marked", "altered source vs must be plainly marked as such"),
    ("mit-title", "^(the )?mit license( mit)?$"),
    ("mpl-2", "mozilla public license,? v ?2[.]0"),
    ("or-later", "(or|at your option) any later v"),
    ("free-permission", "^permission is hereby granted, free of charge"),
    ("keep-notice", "above copyright notice .*shall be included"),
    ("bsd-grant", "^redistribution and use in source and binary forms"),
    ("bsd-source", "redistributions of source code must retain"),
    ("bsd-binary", "redistributions in binary form must reproduce"),
    ("bsd-name", "neither the name .*may be used to endorse"),
    ("no-warranty", "(without warranty of any kind|without any warranty|provided as is)"),
    ("all-rights", "all rights reserved"),
    ("public-domain", "in the public domain"),
)
#: Runs of identifiers and the licence they stand for, in order.
NAMED_RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("mit-title", "free-permission", "keep-notice", "no-warranty"), "MIT"), (("free-permission", "keep-notice", "no-warranty"), "MIT"),
    (("mit-title", "free-permission", "keep-notice"), "MIT"), (("free-permission", "keep-notice"), "MIT"),
    (("bsd-3", "bsd-grant", "bsd-source", "bsd-binary", "bsd-name"), "BSD-3-Clause"), (("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"), "BSD-3-Clause"),
    (("bsd-2", "bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"), (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("gpl-3", "or-later"), "GPL-3.0-or-later"),
    (("gpl-2", "or-later"), "GPL-2.0-or-later"),
    (("gpl-any", "gpl-3"), "GPL-3.0"),
    (("gpl-any", "gpl-2"), "GPL-2.0"),
    (("apache-2",), "Apache-2.0"), (("mit",), "MIT"),
    (("gpl-3",), "GPL-3.0"), (("gpl-2",), "GPL-2.0"), (("gpl-any",), "GPL"),
    (("agpl-3",), "AGPL-3.0"), (("lgpl-3",), "LGPL-3.0"), (("lgpl-2.1",), "LGPL-2.1"),
    (("cc0",), "CC0-1.0"), (("epl-2",), "EPL-2.0"), (("epl-1",), "EPL-1.0"), (("bsl-1",), "BSL-1.0"), (("ofl-1.1",), "OFL-1.1"),
    (("gfdl-1.3", "or-later"), "GFDL-1.3-or-later"), (("gfdl-1.2", "or-later"), "GFDL-1.2-or-later"), (("gfdl-1.1", "or-later"), "GFDL-1.1-or-later"),
    (("gfdl-1.3",), "GFDL-1.3"), (("gfdl-1.2",), "GFDL-1.2"), (("gfdl-1.1",), "GFDL-1.1"), (("gfdl-any",), "GFDL"),
    (("cddl-1",), "CDDL-1.0"), (("artistic-2",), "Artistic-2.0"), (("odbl",), "ODbL-1.0"), (("psf",), "PSF-2.0"),
    (("isc-grant", "no-warranty"), "ISC"), (("isc-grant",), "ISC"), (("isc-name",), "ISC"), (("zlib-marked",), "Zlib"),
    (("unlicense-free", "no-warranty"), "Unlicense"), (("unlicense-free",), "Unlicense"), (("unlicense-name",), "Unlicense"), (("mit-title",), "MIT"),
    (("bsd-3",), "BSD-3-Clause"), (("bsd-2",), "BSD-2-Clause"), (("mpl-2",), "MPL-2.0"), (("public-domain",), "Public-Domain"),
)
#: The notices of the GNU licences, which name the licence before its version.
NOTICES: tuple[tuple[str, str], ...] = (
    ("agpl-any", "gnu affero general public license"), ("lgpl-any", "gnu (lesser|library) general public license"),
    ("either-2.1", "either v ?2[.]1"), ("either-2", "either v ?2"), ("either-3", "either v ?3"),
)
NOTICE_RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("gpl-any", "either-3", "or-later"), "GPL-3.0-or-later"), (("gpl-any", "either-2", "or-later"), "GPL-2.0-or-later"),
    (("lgpl-any", "either-3", "or-later"), "LGPL-3.0-or-later"), (("lgpl-any", "either-2.1", "or-later"), "LGPL-2.1-or-later"),
    (("agpl-any", "either-3", "or-later"), "AGPL-3.0-or-later"),
    (("gpl-any", "either-3"), "GPL-3.0"), (("gpl-any", "either-2"), "GPL-2.0"), (("lgpl-any",), "LGPL"), (("agpl-any",), "AGPL"),
)
#: Whole normalised sentences (one space for a line end) and their identifiers.
EXACT: tuple[tuple[str, str], ...] = (
    ("this is free and unencumbered software released into the public domain", "unlicense-free"),
    ("all rights reserved", "all-rights"),
    ("the mit license mit", "mit-title"), ("mit license", "mit-title"), ("the mit license", "mit-title"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "keep-notice"),
    ("redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd-grant"),
    ("altered source vs must be plainly marked as such, and must not be misrepresented as being the original software", "zlib-marked"),
)
#: Licences by their SPDX identifiers.
SPDX = ("0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 "
        "EUPL-1.2 GFDL-1.1 GFDL-1.2 GFDL-1.3 GFDL-1.1-or-later GFDL-1.2-or-later GFDL-1.3-or-later GPL-2.0 GPL-2.0-or-later GPL-3.0 GPL-3.0-or-later ISC LGPL-2.1 "
        "LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL ODbL-1.0 OFL-1.1 PSF-2.0 Unlicense WTFPL Zlib").split()
#: Creative Commons licences, their parts and versions.
CC_PARTS = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
CC_KINDS, CC_VERSIONS = ("by-nc-sa", "by-nc-nd", "by-sa", "by-nc", "by-nd", "by"), ("1.0", "2.0", "2.5", "3.0", "4.0")


def _cc(kind: str, version: str) -> str:
    """Pattern of a Creative Commons licence: its short or long name, then the version."""
    parts = kind.split("-")
    long = "[ -]".join("no-?deriv(ative)?s?" if p == "nd" else "share-?alike" if p == "sa" else "non-?commercial" if p == "nc" else CC_PARTS[p] for p in parts)
    named = f"creative commons {long}" if kind == "by" else long
    return rf"(\bcc[ -]{'[ -]'.join(parts)}|{named})[ -](v ?)?{version.replace('.', '[.]')}"


_CC = [(f"cc-{k}-{v}", k, v) for k in CC_KINDS for v in CC_VERSIONS]
SENTENCES = tuple((name, _cc(k, v)) for name, k, v in _CC) + PATTERNS + NOTICES
RULES = (tuple(((f"spdx:{x.lower()}",), x) for x in SPDX) + tuple(((f"spdx:{name}",), f"CC-{k.upper()}-{v}") for name, k, v in _CC)
         + NOTICE_RULES[:5] + NAMED_RULES[:10] + NOTICE_RULES[5:] + NAMED_RULES[10:] + tuple(((name,), f"CC-{k.upper()}-{v}") for name, k, v in _CC))
#: A sentence that says under which licence something is not.
DENIED = "(not|never|no longer|nor)[ \\n](been[ \\n]|be[ \\n])?(licensed|released|available|distributed|published|covered|offered|under)"
TAG = "spdx-license-identifier: *([a-z0-9.+ -]+)"
#: Ends of sentences become the mark \x01: "v. 2" is "v 2", a line end after "version" is a blank, then blank lines (of a comment, too), list items, marks.
ENDS = (("(?i)([^a-z])v[.][ \\t]*([0-9])", "$1v $2"), ("(?i)(version|[^a-z]v)[ \\t]{0,2}\\r?\\n", "$1 "), ("\\n[ \\t\\r*#/>]*\\n", "\x01"),
        ("\\n[ \\t]*((?:[-\u2022]|[(]?[0-9a-zA-Z]{1,2}[.)])[ \\t])", "\x01$1"), ("[.!?;]+[ \\t\\r\\n]+", "\x01"))
#: Normalising, after lower case.
CLEAN = (("[\"'`*#/<>()\u201c\u201d\u2018\u2019\\t\\r ]+", " "), (" *\\n[ .,;:!?-]*", "\n"), ("licence", "license"), ("version", "v"),
         ("^[ \\n.,;:!?-]+|[ \\n.,;:!?-]+$", ""))


def needed(patterns: Sequence[str]) -> str:
    """A pattern that every text with a match of one of ``patterns`` has in it: of each, a run of letters that no option,
    class or choice touches, or, in a pattern that is all choice, one of each branch of the first."""
    def run(pattern: str) -> str | None:
        plain = re.sub(r"\\b|\[[^]]*\][*+?]?|[a-z]\?", " ", pattern)
        runs = [w for w in re.findall("[a-z0-9]+", plain) if w != "v" and not w.isdigit()]
        return next((w for w in runs if w.startswith("licen")), max(runs, key=len, default=None))

    words: set[str] = set()
    for p in patterns:
        fixed = run(re.sub(r"\([^()]*\)\??", " ", p))
        found = [fixed] if fixed else [run(x) for x in p.partition("(")[2].partition(")")[0].split("|")]
        if None in found:
            return ""  # nothing is needed: every text is read
        words |= {re.sub("^licen.*", "licen", w) for w in found}  # both spellings
    words = {w for w in words if not any(o != w and o in w for o in words if len(o) > 3)}
    return "|".join(rf"\b{w}\b" if len(w) <= 3 and w != "gnu" else w for w in sorted(words))  # short ones stand alone in the patterns


def normalised(sentence: Column) -> Column:
    s = F.lower(sentence)
    for pattern, to in CLEAN:
        s = F.regexp_replace(s, pattern, to)
    return s


def over_lines(pattern: str) -> str:
    """The pattern with the end of a wrapped line wherever it has a blank."""
    return "(?ms)" + re.sub(r"\[ -\]| ", lambda m: "[ \\n-]" if len(m[0]) > 1 else "[ \\n]", pattern)


def scan(docs: DataFrame, sentences: Sequence[tuple[str, str]] = SENTENCES, rules: Sequence[tuple[tuple[str, ...], str]] = RULES,
         exact: Sequence[tuple[str, str]] = EXACT) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, n_unmatched) for each row; lists joined by commas, '' if none."""
    wrapped = [(name, over_lines(pattern)) for name, pattern in sentences]
    some = "|".join(f"(?:{pattern})" for _, pattern in wrapped) or "(?!)"
    whole = F.create_map(*(F.lit(x) for pair in exact for x in pair)) if exact else F.create_map().cast("map<string,string>")
    none = F.array().cast("array<string>")

    def held(s: Column) -> Column:
        places = F.array(*(F.struct(F.regexp_instr(s, F.lit(pattern)).alias("at"), F.lit(i).alias("rank"), F.lit(name).alias("name"))
                           for i, (name, pattern) in enumerate(wrapped)))
        first = F.aggregate(F.array_sort(F.filter(places, lambda x: x["at"] > 0)), F.array().cast("array<struct<at:int,rank:int,name:string>>"),
                            lambda out, x: F.when(F.exists(out, lambda y: y["at"] == x["at"]), out).otherwise(F.concat(out, F.array(x))))
        return F.transform(first, lambda x: x["name"])

    def tagged(s: Column) -> Column:
        expression = F.regexp_replace(F.regexp_extract(s, TAG, 1), " with [^ ]+", "")
        ids = F.filter(F.split(expression, " "), lambda x: ~x.isin("", "and", "or"))
        return F.transform(ids, lambda x: F.concat(F.lit("spdx:"), F.regexp_replace(F.regexp_replace(x, "-only$", ""), "[+]$", "-or-later")))

    def known(s: Column) -> Column:
        name = F.try_element_at(whole, F.replace(s, F.lit("\n"), F.lit(" ")))
        return F.when(s.rlike(TAG), tagged(s)).when(name.isNotNull(), F.array(name)).when(s.rlike("(?s)" + DENIED), none) \
            .when(s.rlike(some), held(s)).otherwise(none)

    text = F.col("text")
    for pattern, to in ENDS:
        text = F.regexp_replace(text, pattern, to)
    ids = F.flatten(F.transform(F.transform(F.split(text, "\x01"), normalised), known)) if wrapped else none
    words = needed([p for _, p in sentences] + [s for s, _ in exact] + ["spdx"])
    ids = F.when(F.lower("text").rlike(words), ids)
    found = typed(docs, doc_id="long", text="string").withColumn("ids", F.coalesce(ids, none))
    left = F.array_join(F.transform("ids", lambda x: F.concat(F.lit(";"), x, F.lit(";"))), "")
    for run, name in rules:
        left = F.replace(left, F.lit("".join(f";{x};" for x in run)), F.lit(f"[{name}]"))
    found = found.withColumn("left", F.when(F.size("ids") > 0, left).otherwise(""))
    names = F.array_distinct(F.regexp_extract_all("left", F.lit("\\[([^\\]]+)\\]"), F.lit(1)))
    rest = F.regexp_extract_all("left", F.lit(";([^;]+);"), F.lit(1))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
                        F.array_join(names, ",").alias("licenses"), F.size(rest).cast("long").alias("n_unmatched"))
