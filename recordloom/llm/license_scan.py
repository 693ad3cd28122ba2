"""License scan with ordered signature rules (DataFrame functions only).

A text is lower-cased (A-Z) and reduced to its words, joined by single blanks.
Each rule has a keyword: only if the word text contains it is the rule's
regular expression tried (keyword prefilter). Every match is a detection, an
interval of words. Detections are resolved in order of position: one that lies
within the interval of a detection of the same or a better priority is
suppressed, so "apache license version 2 0" leaves no mere "apache license".

The whole scan is one expression per document: no shuffle, no join, and the
rule table is a constant of the plan.

Defined cases: a null text is an empty one (no words, no labels, score 0);
repeated rows and null ids give one result row each; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the contract: phrase and label.
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Priorities: 0 identifiers and full notices, 1 named licenses with a version,
# 2 names alone, 3 hints. The confidence of a priority is the score it gives.
CONFIDENCE = (1.0, 0.9, 0.7, 0.4)

# Before a version's number: blank, "version", "v", or a "v" joined to it ("gpl v3", "version 2 0", "license v2 0").
_V = r"(?: version)?(?: v ?| )"
_SAID_V = r" (?:version(?: v ?| )|v ?)"
# After a number that is not the first part of a longer version.
_ENDS = r"(?! [0-9]{1,2}(?![^ ]))"
_LATER = r"(?: or(?: \(?at your option\)?)?(?: any)? later(?: version)?| or newer| plus)"
_LIC = r" (?:license|licence)"
_PUB = r" public (?:license|licence)"

# Families with versions: keyword, label, name pattern, versions.
FAMILIES = (
    ("apache", "apache", r"apache(?: software)?(?:" + _LIC + r")?", ("1 0", "1 1", "2 0")),
    ("mozilla", "mpl", r"mozilla" + _PUB, ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", r"mpl", ("1 0", "1 1", "2 0")),
    ("eclipse", "epl", r"eclipse" + _PUB, ("1 0", "2 0")),
    ("epl", "epl", r"epl", ("1 0", "2 0")),
    ("european union", "eupl", r"european union" + _PUB, ("1 0", "1 1", "1 2")),
    ("eupl", "eupl", r"eupl", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic", r"artistic" + _LIC, ("1 0", "2 0")),
    ("academic free", "afl", r"academic free" + _LIC, ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("open software", "osl", r"open software" + _LIC, ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("common development", "cddl", r"common development and distribution" + _LIC, ("1 0", "1 1")),
    ("cddl", "cddl", r"cddl", ("1 0", "1 1")),
    ("boost", "bsl", r"boost software" + _LIC, ("1 0",)),
    ("open font", "ofl", r"(?:sil )?open font" + _LIC, ("1 0", "1 1")),
    ("ofl", "ofl", r"ofl", ("1 0", "1 1")),
    ("latex project", "lppl", r"latex project" + _PUB, ("1 0", "1 1", "1 2", "1 3")),
    ("lppl", "lppl", r"lppl", ("1 0", "1 1", "1 2", "1 3")),
    ("php", "php", r"php" + _LIC, ("2 0", "3 0", "3 01")),
    ("zope", "zpl", r"zope" + _PUB, ("1 1", "2 0", "2 1")),
    ("python software", "psf", r"python software foundation" + _LIC, ("2", "2 0")),
    ("common public", "cpl", r"common" + _PUB, ("1 0",)),
    ("ibm public", "ipl", r"ibm" + _PUB, ("1 0",)),
    ("microsoft public", "ms-pl", r"microsoft" + _PUB, ("1 0",)),
    ("server side", "sspl", r"server side" + _PUB, ("1", "1 0")),
    ("business source", "busl", r"business source" + _LIC, ("1 0", "1 1")),
    ("elastic", "elastic", r"elastic" + _LIC, ("1 0", "2 0")),
    ("affero", "agpl", r"(?:gnu )?affero general" + _PUB, ("1 0", "3", "3 0")),
    ("agpl", "agpl", r"agpl", ("1 0", "3", "3 0")),
    ("lesser general", "lgpl", r"(?:gnu )?lesser general" + _PUB, ("2 1", "3", "3 0")),
    ("library general", "lgpl", r"(?:gnu )?library general" + _PUB, ("2", "2 0")),
    ("lgpl", "lgpl", r"lgpl", ("2", "2 0", "2 1", "3", "3 0")),
    ("general public", "gpl", r"(?:gnu )?general" + _PUB, ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("free documentation", "gfdl", r"(?:gnu )?free documentation" + _LIC, ("1 1", "1 2", "1 3")),
    ("gfdl", "gfdl", r"gfdl", ("1 1", "1 2", "1 3")),
    ("open database", "odbl", r"open database" + _LIC, ("1 0",)),
    ("odbl", "odbl", r"odbl", ("1 0",)),
    ("cecill", "cecill", r"cecill(?: [bc])?", ("1 0", "1 1", "2 0", "2 1")),
    ("cc0", "cc0", r"cc0", ("1 0",)),
)

# Names that are also written in one word with the version: "gplv3", "lgplv2 1", "gpl3".
FUSED = ("apache", "mpl", "epl", "eupl", "cddl", "ofl", "lppl", "agpl", "lgpl", "gpl", "gfdl", "odbl", "cecill")

# Creative Commons: parts of the license, written as codes or as words.
CC_PARTS = (
    ("by", "attribution"),
    ("by sa", "attribution share ?alike"),
    ("by nd", "attribution no ?deriv(?:ative)?s(?: works)?"),
    ("by nc", "attribution non ?commercial"),
    ("by nc sa", "attribution non ?commercial share ?alike"),
    ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Rules of their own: keyword, label, priority, pattern.
SINGLE_RULES = (
    ("permission is hereby granted", "mit", 0, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("permission to use", "isc", 0, r"permission to use copy modify and (?:or )?distribute this software for any purpose"),
    ("redistribution and use", "bsd", 0, r"redistribution and use in source and binary forms with or without modification"),
    ("neither the name", "bsd-3", 0, r"neither the names? of .+? may be used to endorse or promote products"),
    ("advertising materials", "bsd-4", 0, r"all advertising materials mentioning features or use of this software"),
    ("without any express", "zlib", 0, r"this software is provided as is without any express or implied warranty"),
    ("unencumbered software", "unlicense", 0, r"this is free and unencumbered software released into the public domain"),
    ("you just do what", "wtfpl", 0, r"you just do what the fuck you want to"),
    ("free software foundation", "gpl", 1, r"as published by the free software foundation"),
    ("any later version", "gpl-or-later", 1, r"(?:or )?(?:at your option )?any later version"),
    ("licensed under the apache", "apache-2.0", 0, r"licensed under the apache license version 2 0"),
    ("spdx", "spdx", 3, r"spdx license identifier"),
    ("mit license", "mit", 2, r"(?:the )?mit" + _LIC),
    ("mit licence", "mit", 2, r"(?:the )?mit licence"),
    ("mit licensed", "mit", 2, r"mit licensed"),
    ("under mit", "mit", 3, r"under mit"),
    ("expat", "mit", 2, r"expat" + _LIC),
    ("x11 license", "x11", 2, r"x11 license"),
    ("isc license", "isc", 2, r"isc license"),
    ("zlib", "zlib", 2, r"zlib(?: libpng)?" + _LIC),
    ("bsd", "bsd-0", 1, r"(?:0|zero) clause bsd(?: license)?"),
    ("bsd", "bsd-1", 1, r"(?:1|one) clause bsd(?: license)?"),
    ("bsd", "bsd-2", 1, r"(?:2|two) clause bsd(?: license)?"),
    ("bsd", "bsd-3", 1, r"(?:3|three) clause bsd(?: license)?"),
    ("bsd", "bsd-4", 1, r"(?:4|four) clause bsd(?: license)?"),
    ("bsd", "bsd-2", 1, r"bsd (?:2|two) clause(?: license)?"),
    ("bsd", "bsd-3", 1, r"bsd (?:3|three) clause(?: license)?"),
    ("bsd", "bsd-2", 2, r"simplified bsd" + _LIC),
    ("bsd", "bsd-3", 2, r"(?:new|revised|modified) bsd" + _LIC),
    ("bsd", "bsd", 2, r"bsd(?: style)?" + _LIC),
    ("unlicense", "unlicense", 2, r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", 2, r"wtfpl"),
    ("beerware", "beerware", 2, r"beerware(?: license)?"),
    ("openssl license", "openssl", 2, r"openssl license"),
    ("ruby license", "ruby", 2, r"ruby license"),
    ("perl license", "perl", 2, r"perl license"),
    ("vim license", "vim", 2, r"vim license"),
    ("postgresql license", "postgresql", 2, r"postgresql license"),
    ("university of illinois", "ncsa", 2, r"university of illinois(?: ncsa)? open source license"),
    ("universal permissive", "upl", 2, r"universal permissive" + _LIC),
    ("blue oak", "blueoak", 2, r"blue oak model license"),
    ("mulan", "mulan", 2, r"mulan (?:permissive software|public) license"),
    ("commons clause", "commons-clause", 2, r"commons clause"),
    ("creative commons zero", "cc0", 1, r"creative commons zero(?: v?1 0)?(?: universal)?"),
    ("cc0", "cc0", 2, r"cc0"),
    ("public domain dedication", "pddl", 1, r"public domain dedication(?: and license)?"),
    ("public domain", "public-domain", 2, r"(?:in|into|to) the public domain"),
    ("public domain", "public-domain", 3, r"public domain"),
    ("creative commons", "cc", 2, r"creative commons(?: license)?"),
    ("dual license", "dual", 3, r"dual license"),
    ("dual licensed", "dual", 3, r"dual licensed"),
    ("triple license", "triple", 3, r"triple license"),
    ("triple licensed", "triple", 3, r"triple licensed"),
    ("source available", "source-available", 3, r"source available(?: license)?"),
    ("proprietary", "proprietary", 2, r"proprietary (?:software|license|and confidential)"),
    ("confidential and", "proprietary", 2, r"confidential and proprietary"),
    ("trade secret", "proprietary", 3, r"trade secret of"),
    ("trade secrets", "proprietary", 3, r"trade secrets of"),
    ("end user license", "eula", 2, r"end user license agreement"),
    ("eula", "eula", 3, r"eula"),
    ("terms of service", "terms", 3, r"terms of service"),
    ("terms of use", "terms", 3, r"terms of use"),
    ("no part of this", "reserved", 1, r"no part of this (?:publication|book|work|document) may be reproduced"),
    ("alle rechte", "reserved", 1, r"alle rechte vorbehalten"),
    ("tous droits", "reserved", 1, r"tous droits réservés"),
    ("todos los derechos", "reserved", 1, r"todos los derechos reservados"),
    ("copyright", "copyright", 2, r"copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("copyright", "copyright", 3, r"copyright(?: c)?"),
    ("licensed under", "licensed", 3, r"licensed under"),
    ("permission of the", "permission", 3, r"without (?:the )?(?:prior )?(?:written )?permission of the (?:author|publisher|owner)"),
    ("without warranty", "warranty", 3, r"without warranty of any kind"),
    ("provided as is", "warranty", 3, r"provided as is"),
    ("fair use", "fair-use", 3, r"fair use"),
    ("open government", "ogl", 2, r"open government" + _LIC),
    ("crown copyright", "crown", 2, r"crown copyright"),
)

# Identifiers of the public license list, as words behind "SPDX-License-Identifier:", and our labels.
SPDX = (
    ("mit", "mit"), ("mit 0", "mit-0"), ("isc", "isc"), ("zlib", "zlib"), ("x11", "x11"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"),
    ("0bsd", "bsd-0"), ("bsd 1 clause", "bsd-1"), ("bsd 2 clause", "bsd-2"), ("bsd 3 clause", "bsd-3"), ("bsd 4 clause", "bsd-4"),
    ("apache 1 0", "apache-1.0"), ("apache 1 1", "apache-1.1"), ("apache 2 0", "apache-2.0"),
    ("gpl 1 0 only", "gpl-1.0"), ("gpl 1 0 or later", "gpl-1.0-or-later"), ("gpl 2 0", "gpl-2.0"), ("gpl 2 0 only", "gpl-2.0"),
    ("gpl 2 0 or later", "gpl-2.0-or-later"), ("gpl 3 0", "gpl-3.0"), ("gpl 3 0 only", "gpl-3.0"), ("gpl 3 0 or later", "gpl-3.0-or-later"),
    ("lgpl 2 0 only", "lgpl-2.0"), ("lgpl 2 0 or later", "lgpl-2.0-or-later"), ("lgpl 2 1", "lgpl-2.1"), ("lgpl 2 1 only", "lgpl-2.1"),
    ("lgpl 2 1 or later", "lgpl-2.1-or-later"), ("lgpl 3 0", "lgpl-3.0"), ("lgpl 3 0 only", "lgpl-3.0"), ("lgpl 3 0 or later", "lgpl-3.0-or-later"),
    ("agpl 3 0", "agpl-3.0"), ("agpl 3 0 only", "agpl-3.0"), ("agpl 3 0 or later", "agpl-3.0-or-later"),
    ("mpl 1 1", "mpl-1.1"), ("mpl 2 0", "mpl-2.0"), ("epl 1 0", "epl-1.0"), ("epl 2 0", "epl-2.0"), ("eupl 1 1", "eupl-1.1"), ("eupl 1 2", "eupl-1.2"),
    ("cddl 1 0", "cddl-1.0"), ("cddl 1 1", "cddl-1.1"), ("bsl 1 0", "bsl-1.0"), ("ofl 1 1", "ofl-1.1"), ("artistic 2 0", "artistic-2.0"),
    ("afl 3 0", "afl-3.0"), ("osl 3 0", "osl-3.0"), ("ms pl", "ms-pl"), ("upl 1 0", "upl"), ("ncsa", "ncsa"), ("postgresql", "postgresql"),
    ("openssl", "openssl"), ("ruby", "ruby"), ("php 3 01", "php-3.01"), ("python 2 0", "psf-2.0"), ("vim", "vim"), ("odbl 1 0", "odbl-1.0"),
    ("busl 1 1", "busl-1.1"), ("sspl 1 0", "sspl-1.0"), ("elastic 2 0", "elastic-2.0"), ("blueoak 1 0 0", "blueoak"), ("mulanpsl 2 0", "mulan"),
    ("cc0 1 0", "cc0-1.0"), ("cc by 3 0", "cc-by-3.0"), ("cc by 4 0", "cc-by-4.0"), ("cc by sa 3 0", "cc-by-sa-3.0"), ("cc by sa 4 0", "cc-by-sa-4.0"),
    ("cc by nc 4 0", "cc-by-nc-4.0"), ("cc by nd 4 0", "cc-by-nd-4.0"), ("cc by nc sa 4 0", "cc-by-nc-sa-4.0"), ("cc by nc nd 4 0", "cc-by-nc-nd-4.0"),
)


def rules() -> list[tuple[str, str, int, str]]:
    """All rules in order: keyword, label, priority, pattern (several hundred)."""
    out = list(SINGLE_RULES)
    out += [("spdx", label, 0, f"spdx license identifier {words}") for words, label in SPDX]
    for keyword, label, name, versions in FAMILIES:
        for version in versions:
            tag = f"{label}-{version.replace(' ', '.')}"
            major, _, minor = version.partition(" ")
            alone = minor == "0" and major not in versions  # "v2" means 2.0
            number = name + _V + version
            if alone:
                number = f"(?:{number}|{name}{_SAID_V}{major}{_ENDS})"
            out.append((keyword, tag, 1, number))
            out.append((keyword, f"{tag}-or-later", 0, number + _LATER))
            if keyword in FUSED:
                for word in (f"{keyword}v{major}", f"{keyword}{major}"):
                    rest = f" {minor}" if minor else ""
                    fused = "(?:gnu )?" + word + (f"(?:{rest}|{_ENDS})" if alone else rest)
                    out.append((word, tag, 1, fused))
                    out.append((word, f"{tag}-or-later", 0, fused + _LATER))
        out.append((keyword, label, 2, name))
    for code, name in CC_PARTS:
        label = "cc-" + code.replace(" ", "-")
        for version in CC_VERSIONS:
            tag = f"{label}-{version.replace(' ', '.')}"
            out.append(("cc by", tag, 1, f"cc {code}" + _V + version))
            out.append(("creative commons", tag, 1, f"creative commons {name}(?: international| unported| generic)?" + _V + version))
        out.append(("cc by", label, 2, f"cc {code}"))
        out.append(("creative commons", label, 2, f"creative commons {name}"))
    return out


def _quoted(value: str) -> str:
    return "r'" + value + "'"


def _whole_words(pattern: str) -> str:
    return f"(?<![^ ])(?:{pattern})(?![^ ])"


def _gate_word(keyword: str) -> str:
    """The keyword's longest word: a text without this word can't hold the keyword."""
    return max(keyword.split(), key=len)


def _rule_table(entries: list[tuple[str, str, int, str]]) -> str:
    """SQL map: keyword -> array of its rules."""
    by_keyword: dict[str, list[str]] = {}
    for keyword, label, priority, pattern in entries:
        by_keyword.setdefault(keyword, []).append(
            f"struct({_quoted(label)} AS label, {priority} AS priority, {_quoted(_whole_words(pattern))} AS pattern)"
        )
    pairs = ", ".join(f"{_quoted(k)}, array({', '.join(v)})" for k, v in by_keyword.items())
    return f"map({pairs})"


def _spaces(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


def _matches(text: str, pattern: str) -> str:
    """SQL: word intervals (s, e exclusive) of all matches of a pattern in a blank-joined word text."""
    return (
        f"aggregate(zip_with(slice(split({text}, {pattern}, -1), 1, size(regexp_extract_all({text}, {pattern}, 0))), "
        f"regexp_extract_all({text}, {pattern}, 0), "
        f"(p, h) -> struct({_spaces('p')} AS gap, {_spaces('h')} AS inner)), "
        "struct(0 AS at, cast(array() AS array<struct<s:int,e:int>>) AS found), "
        "(a, x) -> struct(a.at + x.gap + x.inner AS at, "
        "concat(a.found, array(struct(a.at + x.gap AS s, a.at + x.gap + x.inner + 1 AS e))) AS found), "
        "a -> a.found)"
    )


def _resolve(found: str) -> str:
    """SQL: the detections that survive; ``found`` is sorted by start, longest first, then priority.

    A container of an interval always comes before it in that order, so the
    furthest end per priority so far tells whether there is one.
    """
    seen = "greatest(" + ", ".join(f"IF(d.priority >= {p}, a.m{p}, -1)" for p in range(4)) + ")"
    marks = ", ".join(f"IF(d.priority = {p}, greatest(a.m{p}, d.e), a.m{p}) AS m{p}" for p in range(4))
    return (
        f"aggregate({found}, struct({', '.join(f'-1 AS m{p}' for p in range(4))}, "
        "cast(array() AS array<struct<s:int,e:int,priority:int,label:string>>) AS kept), "
        f"(a, d) -> struct({marks}, IF({seen} >= d.e, a.kept, "
        "concat(a.kept, array(struct(d.s AS s, d.e AS e, d.priority AS priority, d.label AS label)))) AS kept), "
        "a -> a.kept)"
    )


def word_text(text: Column) -> Column:
    """Words of the lower-cased (A-Z) text, joined by single blanks."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # Only A-Z change, so "K" (Kelvin) and the like stay words of their own.
    plain = F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, upper, lower)).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    entries: list[tuple[str, str, int, str]] | None = None,
) -> DataFrame:
    """License detections of every document.

    Returns doc_id, n_words, base (word intervals and labels of the base
    phrases), detections (surviving intervals: s, e, priority, label).
    """
    entries = rules() if entries is None else entries
    by_word: dict[str, list[str]] = {}
    for keyword in dict.fromkeys(k for k, *_ in entries):
        by_word.setdefault(_gate_word(keyword), []).append(keyword)
    gates = ", ".join(_quoted(w) for w in by_word)
    keywords = "map(" + ", ".join(
        f"{_quoted(w)}, array({', '.join(_quoted(k) for k in ks)})" for w, ks in by_word.items()
    ) + ")"
    base = ", ".join(
        f"transform(IF(contains(norm, {_quoted(p)}), {_matches('norm', _quoted(_whole_words(p)))}, "
        f"cast(array() AS array<struct<s:int,e:int>>)), m -> struct(m.s AS s, m.e AS e, {_quoted(label)} AS label))"
        for p, label in BASE_PHRASES
    )
    hits = docs.select(F.col(id_col).alias("doc_id"), word_text(common.text_of(text_col)).alias("norm")).select(
        "doc_id",
        "norm",
        # One hashed pass over the words; only then are keywords searched as text.
        F.expr(f"array_intersect(split(norm, ' '), array({gates}))").alias("gate"),
    ).select(
        "doc_id",
        "norm",
        F.expr(f"filter(flatten(transform(gate, w -> element_at({keywords}, w))), k -> contains(norm, k))").alias("found"),
    )
    raw = hits.select(
        "doc_id",
        F.expr(f"cast(IF(norm = '', 0, {_spaces('norm')} + 1) AS bigint)").alias("n_words"),
        F.expr(f"concat({base})").alias("base"),
        F.expr(
            f"sort_array(transform(flatten(transform(flatten(transform(found, k -> element_at({_rule_table(entries)}, k))), "
            f"r -> transform({_matches('norm', 'r.pattern')}, m -> struct(m.s AS s, -m.e AS e, r.priority AS priority, r.label AS label)))), "
            "x -> x))"
        ).alias("all_found"),
    )
    return raw.select(
        "doc_id", "n_words", "base",
        F.expr(_resolve("transform(all_found, x -> struct(x.s AS s, -x.e AS e, x.priority AS priority, x.label AS label))")).alias(
            "detections"
        ),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scan over all documents: base places, labels and score."""
    found = scan_licenses(common.read_table(spark, sf_dir, "documents"))
    score = "CASE " + " ".join(
        f"WHEN exists(detections, d -> d.priority = {p}) THEN {c}D" for p, c in enumerate(CONFIDENCE)
    ) + " WHEN size(base) > 0 THEN 0.7D ELSE 0D END"
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.expr("cast(array_min(transform(base, b -> b.s)) AS bigint)").alias("first_word"),
        F.expr("cast(array_max(transform(base, b -> b.s)) AS bigint)").alias("last_word"),
        F.expr("array_join(sort_array(array_distinct(transform(base, b -> b.label))), ',')").alias("base_labels"),
        F.expr(
            "array_join(sort_array(array_distinct(concat(transform(base, b -> b.label), "
            "transform(detections, d -> d.label)))), ',')"
        ).alias("labels"),
        F.expr(score).alias("score"),
        F.expr(
            "array_join(transform(detections, d -> concat(d.s, ':', d.e, ':', d.label)), ',')"
        ).alias("spans"),
    )
