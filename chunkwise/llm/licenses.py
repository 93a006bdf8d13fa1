"""License scan: ordered signature rules over whole texts, in DataFrame functions only.

Base signatures are phrases of words (``BASE_PHRASES``).  The method's own
signatures are regexes over the lower-cased text, generated from the license
table below and each gated by keywords: a regex runs only on texts that hold
one of its keywords, which every match holds, and only texts that hold one of
``gate_literals`` (made from the rules) are searched at all.
Overlapping detections are resolved by priority and containment: a detection
inside another of higher priority, or inside a longer or earlier-listed one of
the same priority, is suppressed.

Null texts count as empty; an empty text has no words and no labels, an empty
table no rows.  Equal rows get equal results.  Only the id and text columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what is between words; they may still hold A-Z
BASE_PHRASES = (
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
)
ANCHOR = "license"  # the word that every base phrase holds

# Labels of families: (label, keywords with | between, name, SPDX identifier); names and identifiers are regexes.
FAMILIES = (
    ("mit", "mit|expat", r"(?:mit|expat)", r"mit(?:-0)?"),
    ("x11", "x11", r"x11", r"x11"),
    ("apache", "apache", r"apache(?: software)?", r"apache-[12]\.[01]"),
    ("gpl", "general public", r"(?:gnu )?general public", r"gpl-[123](?:\.0)?(?:-only|-or-later|\+)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl[ -]?v?[123]?(?:\.0)?", r"gpl-v[123]"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public", r"lgpl-[23](?:\.[01])?(?:-only|-or-later|\+)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl[ -]?v?[23]?(?:\.[01])?", r"lgpl-v[23]"),
    ("lgpl", "library", r"(?:gnu )?library general public", r"lgpl-2\.0"),
    ("agpl", "affero", r"(?:gnu )?affero general public", r"agpl-[13](?:\.0)?(?:-only|-or-later)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl[ -]?v?[13]?(?:\.0)?", r"agpl-v3"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", r"gfdl-1\.[123](?:-only|-or-later)?"),
    ("bsd", "bsd", r"(?:(?:new|modified|simplified|revised|[0234][ -]clause) )?bsd(?: [0234][ -]clause)?", r"(?:0bsd|bsd-[1234]-clause)"),
    ("mpl", "mozilla", r"mozilla(?: public)?", r"mpl-[12]\.[01]"),
    ("mpl", "mpl", r"mpl[ -]?v?[12]?(?:\.[01])?", r"mpl-v[12]"),
    ("epl", "eclipse", r"eclipse(?: public| distribution)?", r"ep?l-[12]\.0"),
    ("cddl", "development and distribution", r"common development and distribution", r"cddl-1\.[01]"),
    ("cddl", "cddl", r"cddl", r"cddl"),
    ("cpl", "common public", r"common public", r"cpl-1\.0"),
    ("isc", "isc|internet systems consortium", r"(?:isc|internet systems consortium)", r"isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", r"zlib(?:-acknowledgement)?"),
    ("libpng", "libpng", r"libpng", r"libpng(?:-2\.0)?"),
    ("boost", "boost", r"boost(?: software)?", r"bsl-1\.0"),
    ("artistic", "artistic", r"(?:perl )?artistic", r"artistic-[12]\.0"),
    ("perl", "perl", r"perl(?: 5)?", r"perl-5"),
    ("python", "python", r"python(?: software foundation)?", r"(?:psf|python)-2\.0"),
    ("php", "php", r"php", r"php-3\.0[1]?"),
    ("ruby", "ruby", r"ruby", r"ruby"),
    ("openssl", "openssl", r"(?:dual )?openssl", r"openssl"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("eupl", "european union", r"european union public", r"eupl-1\.[012]"),
    ("eupl", "eupl", r"eupl", r"eupl"),
    ("ofl", "open font", r"(?:sil )?open font", r"ofl-1\.[01]"),
    ("odbl", "open database", r"open (?:data commons open )?database", r"odbl-1\.0"),
    ("odc-by", "attribution", r"open data commons attribution", r"odc-by-1\.0"),
    ("pddl", "public domain dedication", r"public domain dedication", r"pddl-1\.0"),
    ("ms-pl", "microsoft", r"microsoft (?:public|reciprocal|limited public)", r"ms-[pr]l"),
    ("apsl", "apple", r"apple public source", r"apsl-[12]\.[012]"),
    ("ibm", "ibm", r"ibm public", r"ipl-1\.0"),
    ("sun", "sun", r"sun (?:industry standards source|public)", r"(?:sissl|spl-1\.0)"),
    ("npl", "netscape", r"netscape public", r"npl-1\.[01]"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice)?", r"w3c"),
    ("curl", "curl", r"curl", r"curl"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql"),
    ("vim", "vim", r"vim", r"vim"),
    ("ncsa", "illinois", r"university of illinois(?:/ncsa)?(?: open source)?", r"ncsa"),
    ("afl", "academic free", r"academic free", r"afl-[123]\.[012]"),
    ("osl", "open software", r"open software", r"osl-[123]\.[012]"),
    ("ecl", "educational", r"educational community", r"ecl-[12]\.0"),
    ("upl", "universal permissive", r"universal permissive", r"upl-1\.0"),
    ("cecill", "cecill", r"cecill(?:-[bc])?", r"cecill-(?:[bc]|[12]\.[01])"),
    ("sspl", "server side", r"server side public", r"sspl-1\.0"),
    ("busl", "business source", r"business source", r"bus?l-1\.1"),
    ("elastic", "elastic", r"elastic", r"elastic-2\.0"),
    ("qpl", "public", r"q public", r"qpl-1\.0"),
    ("lppl", "latex", r"latex project public", r"lppl-1\.[0123]c?"),
    ("tcl", "tcl", r"tcl(?:/tk)?", r"tcl"),
    ("beerware", "beer", r"beer[ -]?ware", r"beerware"),
    ("unicode", "unicode", r"unicode", r"unicode-(?:dfs-201[56]|tou|3\.0)"),
    ("llama", "llama", r"llama(?: [234](?:\.[0-9])?)?(?: community)?", r"llama[234](?:\.[0-9])?"),
    ("rail", "rail", r"(?:creativeml |bigscience )?open ?rail(?:-m|\+\+-m)?", r"(?:creativeml-)?openrail(?:-m)?"),
)

# Creative Commons terms: (label, the letters, the words).
COMMONS = (
    ("cc-by-nc-nd", r"by[ -]nc[ -]nd", r"attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc-sa", r"by[ -]nc[ -]sa", r"attribution[ -]non-?commercial[ -]share-? ?alike"),
    ("cc-by-nc", r"by[ -]nc", r"attribution[ -]non-?commercial"),
    ("cc-by-nd", r"by[ -]nd", r"attribution[ -]no-?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-sa", r"by[ -]sa", r"attribution[ -]share-? ?alike"),
    ("cc-by", r"by", r"attribution"),
)

# Signatures with a wording of their own: (label, keywords, regex, priority).
NOTICES = (
    ("mit", "free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy", 3),
    ("isc", "with or without fee", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee", 3),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification", 3),
    ("apache", "apache.org/licenses", r"https?://(?:www\.)?apache\.org/licenses/[a-z0-9._-]+", 3),
    ("gpl", "gnu.org/licenses", r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl[a-z0-9._-]*", 3),
    ("lgpl", "gnu.org/licenses", r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl[a-z0-9._-]*", 3),
    ("agpl", "gnu.org/licenses", r"https?://(?:www\.)?gnu\.org/licenses/agpl[a-z0-9._-]*", 3),
    ("mpl", "mozilla.org", r"https?://(?:www\.)?mozilla\.org/[a-z]*/?mpl/[a-z0-9._/-]*", 3),
    ("mit", "opensource.org", r"https?://(?:www\.)?opensource\.org/licenses/mit[a-z0-9._-]*", 3),
    ("bsd", "opensource.org", r"https?://(?:www\.)?opensource\.org/licenses/bsd[a-z0-9._-]*", 3),
    ("gpl", "free software foundation", r"it under the terms of the gnu general public license as published by the free software foundation", 3),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such", 3),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 3),
    ("cc0", "cc0|cc 0|cc-0", r"\bcc[ -]?0(?:[ -]1\.0)?(?: universal)?\b", 3),
    ("cc0", "publicdomain", r"creativecommons\.org/publicdomain/zero/[0-9.]+", 3),
    ("public-domain", "public domain", r"\b(?:released|placed|dedicated|donated) (?:in)?to the public domain\b", 2),
    ("public-domain", "public domain", r"\bpublic domain\b", 1),
    ("proprietary", "rights reserved", r"\ball rights reserved\b", 1),
    ("proprietary", "proprietary", r"\bproprietary (?:and confidential|licen[cs]e)\b", 2),
    ("proprietary", "copying of this file", r"\bunauthori[sz]ed copying of this file\b", 2),
    ("copyleft", "copyleft", r"\bcopyleft\b", 1),
    ("copyright", "copyright", r"\bcopyright (?:\(c\) |© )?(?:19|20)[0-9]{2}\b", 1),
    ("no-warranty", "warrant", r"\bwithout warranty of any kind\b", 1),
)


def signature_rules() -> list[tuple[int, int, str, str, str]]:
    """(rule number, priority, label, keywords with | between, regex), in order; a few hundred.

    Priority 3: identifiers, addresses and full wordings; 2: named references; 1: hints.
    """
    word = r"licen[cs]e"
    version = r"(?:,? ?(?:version|v)\.? ?[0-9](?:\.[0-9])*)"
    rules: list[tuple[int, str, str, str]] = []
    for label, keyword, name, spdx in FAMILIES:
        rules += [
            (3, label, "spdx", rf"spdx-license-identifier: ?\(?{spdx}\b"),
            (2, label, keyword, rf"\b(?:licensed|released|distributed|available|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?{name} {word}{version}?"),
            (2, label, keyword, rf"\b{name} {word}{version}?"),
            (2, label, keyword, rf"\b{word}: ?(?:the )?{name}\b"),
        ]
    for label, letters, wording in COMMONS:
        rules += [
            (3, label, "spdx", rf"spdx-license-identifier: ?\(?cc-{letters.replace('[ -]', '-')}-[1234]\.0\b"),
            (3, label, "creativecommons", rf"creativecommons\.org/licenses/{letters.replace('[ -]', '-')}/[0-9.]+"),
            (2, label, "cc by|cc-by", rf"\bcc[ -]{letters}\b(?:[ -][1234]\.[05])?"),
            (2, label, "creative commons", rf"\bcreative commons {wording}(?: [1234]\.[05])?(?: international| unported| generic)?"),
        ]
    rules += [(priority, label, keyword, regex) for label, keyword, regex, priority in NOTICES]
    return [(i, p, label, keyword, regex) for i, (p, label, keyword, regex) in enumerate(rules)]


def gate_literals() -> tuple[str, ...]:
    """Literals of which every match of any rule holds one: ``licen`` where a regex needs it outside of groups, else its keywords."""
    out: dict[str, None] = {}
    for *_, keywords, regex in signature_rules():
        plain, before = regex.replace(r"\(", "").replace(r"\)", ""), None
        while plain != before:
            plain, before = re.sub(r"\([^()]*\)", "|", plain), plain
        out.update(dict.fromkeys(["licen"] if "licen" in plain else keywords.split("|")))
    return tuple(out)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def _holds_any(text: Column, keywords: tuple[str, ...]) -> Column:
    return _once(F.lower(text), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keywords]))


def _rule_table(spark: SparkSession) -> DataFrame:
    """The signatures as a table of a few hundred rows, whatever the documents; meant for a broadcast."""
    rows = [(i, p, label, k, f"(?i){regex}") for i, p, label, ks, regex in signature_rules() for k in ks.split("|")]
    return spark.createDataFrame(rows, "rule int, priority int, label string, keyword string, regex string")


def _pieces(text: Column, regex: Column) -> Column:
    """(gap, size) per match: the characters before it since the last one, and its own."""
    found = F.regexp_extract_all(text, regex, F.lit(0))
    lengths = F.zip_with(
        F.transform(F.split(text, regex, -1), F.length), F.transform(found, F.length),
        lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")),
    )
    return F.filter(lengths, lambda x: x["size"].isNotNull())


def detections(docs: DataFrame, text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """(keys, label, priority, rule, start, end): what is left after suppression; offsets are code points.

    ``keys`` name the columns that tell texts apart.  Only gated texts leave the
    scan, as their detections; those are ordered per text by one window.
    """
    keys = keys or ["doc_id"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    gated = docs.select(*keys, text.alias("__text")).where(_holds_any(F.col("__text"), gate_literals()))
    keywords = F.array(*[F.lit(k) for k in dict.fromkeys(k for r in signature_rules() for k in r[3].split("|"))])
    present = _once(F.lower("__text"), lambda low: F.filter(keywords, lambda k: F.contains(low, k)))
    active = gated.select(*keys, "__text", F.explode(present).alias("keyword")).join(F.broadcast(_rule_table(docs.sparkSession)), "keyword")
    hits = active.where(F.regexp_like("__text", F.col("regex"))).select(
        *keys, "label", "priority", "rule", F.posexplode(_pieces(F.col("__text"), F.col("regex"))).alias("__n", "__p")
    )
    hits = hits.select(*keys, "label", "priority", "rule", "__n", "__p.gap", "__p.size").dropDuplicates([*keys, "rule", "__n"])
    so_far = Window.partitionBy(*keys, "rule").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    hits = hits.repartition(*keys).withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    hits = hits.select(*keys, "label", "priority", "rule", "start", "end")
    # Everything that can hold a detection comes before it in this order, so the furthest end so far decides.
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = lambda level: F.max(F.when(F.col("priority") >= level, F.col("end"))).over(order)
    held = F.coalesce(F.when(F.col("priority") == 3, reach(3)).when(F.col("priority") == 2, reach(2)).otherwise(reach(1)), F.lit(-1))
    return hits.withColumn("__held", held >= F.col("end")).where(~F.col("__held")).drop("__held")


def _phrase_places(words: Column, phrase: tuple[str, ...], label: str) -> Column:
    def starts_here(word: Column, i: Column) -> Column:
        rest = [F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(phrase) if k]
        return F.when(reduce(lambda a, b: a & b, rest, word == phrase[0]), i)

    starts = F.filter(F.transform(words, starts_here), lambda i: i.isNotNull())
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def _base_places(words: Column) -> Column:
    """Array of (start word, label) of every place of a base phrase."""
    return F.concat(*[_phrase_places(words, phrase, label) for phrase, label in BASE_PHRASES])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 0 without a label; else the best evidence: 1 for priority 3,
    0.8 for 2 or a base phrase, 0.4 for hints only.  Detections meet their
    document again by the id and a hash of the text; no text is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.withColumn("__hash", F.xxhash64("__text"))
    words = F.array_remove(F.split("__text", BREAK), "")
    empty = F.expr("CAST(array() AS array<struct<start:int,label:string>>)")
    low_words = F.array_remove(F.split(F.lower("__text"), BREAK), "")
    base = F.when(_holds_any(F.col("__text"), (ANCHOR,)), _once(low_words, _base_places)).otherwise(empty)
    facts = rows.select("__id", "__hash", F.size(words).cast("long").alias("n_words"), base.alias("__base"))
    found = detections(rows, "__text", ["__id", "__hash"]).groupBy("__id", "__hash").agg(
        F.collect_set("label").alias("__labels"), F.max("priority").alias("__best")
    )
    starts = F.transform("__base", lambda b: b["start"])
    base_set = F.array_distinct(F.transform("__base", lambda b: b["label"]))
    same = facts["__id"].eqNullSafe(found["__id"]) & (facts["__hash"] == found["__hash"])
    every = F.array_sort(F.array_union(base_set, F.coalesce("__labels", F.array().cast("array<string>"))))
    level = F.col("__best")
    best = F.greatest(
        F.when(level == 3, 1.0).when(level == 2, 0.8).when(level == 1, 0.4).otherwise(0.0), F.when(F.size("__base") > 0, 0.8).otherwise(0.0)
    )
    return facts.join(found, same, "left").select(
        facts["__id"].alias(id_col), "n_words", F.size("__base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        best.alias("score"),
    )
