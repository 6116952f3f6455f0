"""License scans by ordered signature rules, with DataFrame functions only.

A text is reduced to its words; a text in which some rule's keyword occurs passes the gate; of the rules, those whose
own keyword occurs are matched. Every text that a rule matches holds the rule's keyword, so the gate loses nothing. A detection inside a longer one, or on the same words as one of an earlier rule, is suppressed.

Defined cases: null text counts as empty (no words, no detections); texts of any length are scanned whole; repeated
rows are kept; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases and labels of the contract; as rules they come first.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

_V = r"(?: version| ?v)? ?"
#: (label, keyword, patterns over single-spaced lower-case words). Version rules are made from the families below.
SINGLE = [
    ("mit", "mit", ["mit licen[cs]e", "spdx license identifier mit", "license mit", "licensed under mit", "released under the mit licen[cs]e"]),
    ("mit", "permission is hereby granted", ["permission is hereby granted free of charge to any person obtaining a copy"]),
    ("isc", "isc", ["isc licen[cs]e", "spdx license identifier isc", "licensed under isc"]),
    ("isc", "permission to use", ["permission to use copy modify and or distribute this software for any purpose"]),
    ("bsd-2", "bsd", ["bsd 2 clause", "2 clause bsd(?: licen[cs]e)?", "simplified bsd licen[cs]e", "freebsd licen[cs]e"]),
    ("bsd-3", "bsd", ["bsd 3 clause", "3 clause bsd(?: licen[cs]e)?", "new bsd licen[cs]e", "modified bsd licen[cs]e", "revised bsd licen[cs]e"]),
    ("bsd-4", "bsd", ["bsd 4 clause", "4 clause bsd(?: licen[cs]e)?", "original bsd licen[cs]e"]),
    ("bsd-0", "bsd", ["0bsd", "zero clause bsd", "bsd zero clause(?: licen[cs]e)?"]),
    ("bsd", "bsd", ["bsd licen[cs]e", "bsd style licen[cs]e", "licensed under bsd"]),
    ("bsd", "redistribution", ["redistribution and use in source and binary forms with or without modification are permitted"]),
    ("unlicense", "unlicense", ["the unlicense", "unlicense org", "spdx license identifier unlicense"]),
    ("unlicense", "public domain", ["free and unencumbered software released into the public domain"]),
    ("public-domain", "public domain", ["(?:in|into) the public domain", "public domain dedication", "dedicated to the public domain"]),
    ("wtfpl", "wtfpl", ["wtfpl"]),
    ("zlib", "zlib", ["zlib licen[cs]e", "zlib libpng licen[cs]e", "spdx license identifier zlib"]),
    ("libpng", "libpng", ["libpng licen[cs]e"]),
    ("boost-1", "boost", ["boost software licen[cs]e(?: version 1 0)?"]),
    ("boost-1", "bsl 1 0", ["bsl 1 0"]),
    ("postgresql", "postgresql", ["postgresql licen[cs]e"]),
    ("python-2", "python", ["python software foundation licen[cs]e(?: version 2)?"]),
    ("python-2", "psf licen", ["psf licen[cs]e"]),
    ("php-3", "php", ["php licen[cs]e(?: version 3 01?)?"]),
    ("ruby", "ruby", ["ruby licen[cs]e"]),
    ("perl-artistic", "artistic", ["artistic licen[cs]e"]),
    ("openssl", "openssl", ["openssl licen[cs]e"]),
    ("curl", "curl", ["curl licen[cs]e"]),
    ("x11", "x11", ["x11 licen[cs]e", "mit x11 licen[cs]e"]),
    ("ncsa", "ncsa", ["ncsa open source licen[cs]e", "university of illinois ncsa"]),
    ("ofl-1", "open font", ["sil open font licen[cs]e(?: version 1 1)?"]),
    ("cc0-1", "cc0", ["cc0(?: 1 0)?(?: universal)?"]),
    ("cc", "creative commons", ["creative commons licen[cs]e", "licensed under (?:a )?creative commons"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
    ("busl-1.1", "business source", ["business source licen[cs]e(?: version 1 1| 1 1)?"]),
    ("busl-1.1", "busl", ["busl 1 1"]),
    ("sspl-1", "server side public", ["server side public licen[cs]e(?: version 1| v1)?"]),
    ("sspl-1", "sspl", ["sspl(?: ?v?1)?(?: 0)?"]),
    ("elastic-2", "elastic licen", ["elastic licen[cs]e(?: version| ?v)?(?: ?2)?(?: 0)?"]),
    ("mit-0", "mit 0", ["mit 0(?: licen[cs]e)?"]),
    ("mit-0", "mit no attribution", ["mit no attribution(?: licen[cs]e)?"]),
    ("warranty-disclaimer", "warranty", ["without warranty of any kind", "provided as is without (?:express or implied )?warranty"]),
]
#: (label, keyword, names in words, abbreviations, versions)
FAMILIES = [
    ("apache", "apache", ["apache(?: software)? licen[cs]e"], ["apache"], ["2", "1 1", "1"]),
    ("gpl", "gpl", [], ["gpl", "gnu gpl"], ["3", "2", "1"]),
    ("gpl", "general public", ["(?:gnu )?general public licen[cs]e"], [], ["3", "2", "1"]),
    ("lgpl", "lgpl", [], ["lgpl", "gnu lgpl"], ["3", "2 1", "2"]),
    ("lgpl", "lesser general", ["(?:gnu )?lesser general public licen[cs]e"], [], ["3", "2 1"]),
    ("lgpl", "library general", ["(?:gnu )?library general public licen[cs]e"], [], ["2"]),
    ("agpl", "agpl", [], ["agpl", "gnu agpl"], ["3", "1"]),
    ("agpl", "affero", ["(?:gnu )?affero general public licen[cs]e"], [], ["3", "1"]),
    ("gfdl", "free documentation", ["(?:gnu )?free documentation licen[cs]e"], [], ["1 3", "1 2", "1 1"]),
    ("mpl", "mozilla", ["mozilla public licen[cs]e"], [], ["2", "1 1", "1"]),
    ("mpl", "mpl", [], ["mpl"], ["2", "1 1", "1"]),
    ("epl", "eclipse", ["eclipse public licen[cs]e"], [], ["2", "1"]),
    ("cddl", "common development", ["common development and distribution licen[cs]e"], [], ["1 1", "1"]),
    ("eupl", "european union public", ["european union public licen[cs]e"], [], ["1 2", "1 1"]),
    ("epl", "epl", [], ["epl"], ["2", "1"]),
    ("cddl", "cddl", [], ["cddl"], ["1 1", "1"]),
    ("eupl", "eupl", [], ["eupl"], ["1 2", "1 1"]),
    ("cpl", "cpl", [], ["cpl"], ["1"]),
    ("osl", "osl", [], ["osl"], ["3", "2 1"]),
    ("afl", "afl", [], ["afl"], ["3", "2 1"]),
    ("cpl", "common public", ["common public licen[cs]e"], [], ["1"]),
    ("osl", "open software", ["open software licen[cs]e"], [], ["3", "2 1"]),
    ("afl", "academic free", ["academic free licen[cs]e"], [], ["3", "2 1"]),
    ("ms-pl", "microsoft public", ["microsoft public licen[cs]e"], [], ["1"]),
    ("cecill", "cecill", ["cecill"], [], ["2 1", "2", "1"]),
    ("artistic", "artistic", ["artistic licen[cs]e"], [], ["2", "1"]),
]
#: Creative Commons: conditions in words and letters.
CONDITIONS = {"by": "attribution", "by nc": "attribution non ?commercial", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s?", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}


def rules() -> list[tuple[str, str, str]]:
    """(label, keyword, pattern) in order of priority: the contract's phrases, then longer and more exact forms first."""
    out = [(label, phrase, phrase) for phrase, label in BASE]
    for label, keyword, names, short, versions in FAMILIES:
        for v in versions:
            named = f"{label}-{v.replace(' ', '.')}"
            zero = f"{v}(?: 0)?" if " " not in v else v
            out += [(named, keyword, f"(?:licensed |released |distributed )?(?:under )?(?:the )?{n}{_V}{zero}(?: or (?:any )?later)?") for n in names]
            out += [(named, keyword, f"{s}{_V}{zero}(?: only| or later)?") for s in short]
            out += [(named, keyword, f"spdx license identifier {s} {zero}(?: only| or later)?") for s in short[:1]]
            if names and keyword != "apache":
                out.append((named, keyword, f"version {zero} of the {names[0]}"))
    for letters, named in sorted(CONDITIONS.items(), key=lambda x: -len(x[0])):
        label = f"cc-{letters.replace(' ', '-')}"
        for v in ("4 0", "3 0", "2 5", "2 0", "1 0"):
            out.append((f"{label}-{v.replace(' ', '.')}", f"cc {letters}", f"cc {letters} {v}"))
            out.append((f"{label}-{v.replace(' ', '.')}", "creative commons", f"creative commons {named} (?:licen[cs]e )?(?:version )?{v}(?: international| unported| generic)?"))
            out.append((f"{label}-{v.replace(' ', '.')}", "creativecommons", f"creativecommons org licenses {letters} {v}"))
        out.append((label, f"cc {letters}", f"cc {letters}"))
        out.append((label, "creative commons", f"creative commons {named}"))
        out.append((label, "creativecommons", f"creativecommons org licenses {letters}"))
    for label, keyword, patterns in SINGLE:
        out += [(label, keyword, p) for p in patterns]
    for label, keyword, names, short, _ in FAMILIES:
        out += [(label, keyword, f"(?:licensed |released |distributed )?(?:under )?(?:the )?{n}") for n in names]
        out += [(label, keyword, f"(?:licensed |released |distributed )under (?:the )?{s}") for s in short]
    return out


def gate_words() -> list[str]:
    """Keywords of the rules, less those that hold another one."""
    keys = {keyword for _, keyword, _ in rules()}
    return sorted(k for k in keys if not any(o != k and o in k for o in keys))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _marked(flat: Column, pattern: Column, mark: str) -> Column:
    """Indexes of the words before which a mark is set; the mark is no character of ``flat``."""
    words = F.split(F.regexp_replace(flat, pattern, F.lit(mark)), " ")
    return F.filter(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit("\x01")), i)), lambda i: i.isNotNull())


def _places(flat: Column, phrase: str) -> Column:
    """Word indexes at which the words of a phrase stand one after the other."""
    return F.when(F.contains(flat, F.lit(phrase)), _marked(flat, F.lit(f"(?<![^ ])(?={phrase}(?![^ ]))"), "\x01")).otherwise(F.array().cast("array<int>"))


NONE = "array<struct<first:int,minus_last:int,priority:int,label:string>>"


def _detections(flat: Column, table: Column) -> Column:
    """(first word, word after the last, priority, label) of every match of every rule whose keyword occurs, in order.

    A mark before each match tells, once the text is cut into words, at which word it begins.
    """

    def of_rule(rule: Column) -> Column:
        pattern = F.concat(F.lit("(?<![^ ])(?:"), rule["pattern"], F.lit(")(?![^ ])"))

        def placed(found: Column) -> Column:
            at = F.zip_with(_marked(flat, pattern, "\x01$0"), found, lambda i, m: F.struct(i.alias("first"), (-(i + _spaces(m) + 1)).alias("minus_last"), rule["priority"].alias("priority"), rule["label"].alias("label")))
            return F.when(F.size(found) > 0, at).otherwise(F.array().cast(NONE))

        return F.flatten(F.transform(F.array(F.regexp_extract_all(flat, pattern, F.lit(0))), placed))

    return F.array_sort(F.flatten(F.transform(F.filter(table, lambda r: F.contains(flat, r["keyword"])), of_rule)))


#: Detections that are walked with one growing array; longer lists go part by part.
PART = 256


def _unsuppressed(found: Column) -> Column:
    """Walks detections by first word, longer ones first, then by priority; one that ends no later than an earlier one is inside it."""
    kind = "array<struct<first:int,last:int,label:string,priority:int>>"

    def step(acc: Column, d: Column) -> Column:
        last = -d["minus_last"]
        fresh = last > acc["end"]
        item = F.struct(d["first"].alias("first"), last.alias("last"), d["label"].alias("label"), d["priority"].alias("priority"))
        return F.struct(
            F.greatest(acc["end"], last).alias("end"),
            F.when(fresh, acc["covered"] + last - F.greatest(acc["end"], d["first"])).otherwise(acc["covered"]).alias("covered"),
            F.when(fresh, F.concat(acc["kept"], F.array(item))).otherwise(acc["kept"]).alias("kept"),
        )

    def walk(found: Column) -> Column:
        def part(acc: Column, at: Column) -> Column:
            start = F.struct(acc["end"].alias("end"), acc["covered"].alias("covered"), F.array().cast(kind).alias("kept"))
            walked = F.aggregate(F.slice(found, at, F.lit(PART)), start, step)
            return F.struct(walked["end"].alias("end"), walked["covered"].alias("covered"), F.concat(acc["kept"], F.array(walked["kept"])).alias("kept"))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered"), F.array().cast(f"array<{kind}>").alias("kept"))
        parts = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(PART))
        return F.aggregate(parts, start, part, lambda acc: F.struct(acc["covered"].alias("covered"), F.flatten(acc["kept"]).alias("kept")))

    return F.element_at(F.transform(F.array(found), walk), 1)  # bound once, so that it is computed once


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, base, detections, covered): places of the contract's phrases, and what the rules find."""
    table = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(label).alias("label"), F.lit(k).alias("keyword"), F.lit(p).alias("pattern")) for i, (label, k, p) in enumerate(rules())])
    low = docs.select(F.col(id_col), F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER).alias("low"))
    flat = low.select(id_col, F.trim(F.regexp_replace("low", BREAK, " ")).alias("flat"))
    counted = flat.withColumn("n_words", F.when(F.col("flat") == "", 0).otherwise(_spaces(F.col("flat")) + 1).cast("long"))
    gated = counted.withColumn("gate", reduce(or_, (F.contains("flat", F.lit(k)) for k in gate_words())))
    base = F.array(*[F.struct(F.lit(label).alias("label"), _places(F.col("flat"), phrase).alias("at")) for phrase, label in BASE])
    none = "array<struct<first:int,last:int,label:string,priority:int>>"
    walked = gated.withColumn("base", F.when(F.col("gate"), base)).withColumn(
        "walked", F.when(F.col("gate"), _unsuppressed(_detections(F.col("flat"), table)))
    )
    return walked.select(
        id_col,
        "n_words",
        F.coalesce("base", F.array().cast("array<struct<label:string,at:array<int>>>")).alias("base"),
        F.coalesce("walked.kept", F.array().cast(none)).alias("detections"),
        F.coalesce("walked.covered", F.lit(0)).alias("covered"),
    )


def license_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    scanned = scan_licenses(docs, id_col, text_col)
    places = F.flatten(F.transform("base", lambda b: b["at"]))
    base = F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    labels = F.array_union(base, F.transform("detections", lambda d: d["label"]))
    score = F.when(F.col("n_words") > 0, F.least(F.lit(1.0), F.col("covered") / F.col("n_words"))).otherwise(0.0)
    return scanned.select(
        id_col,
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        score.alias("score"),
    )
