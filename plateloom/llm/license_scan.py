"""License scans with DataFrame functions only: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateloom.llm.common import lower_ascii

#: What separates words, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, the name's pattern in normalised words, keywords, versions.
FAMILIES = (
    ("apache", "apache(?: software)?", "apache", ("1 0", "1 1", "2 0")),
    ("mit", "(?:mit|expat|x11)", "mit expat x11", ()),
    ("bsd-2-clause", "(?:simplified bsd|bsd 2 clause|freebsd)", "bsd freebsd", ()),
    ("bsd-3-clause", "(?:new bsd|modified bsd|bsd 3 clause)", "bsd", ()),
    ("bsd", "bsd", "bsd", ()),
    ("gpl", "(?:gnu )?(?:gpl|general public)", "gpl general", ("1 0", "2 0", "3 0")),
    ("lgpl", "(?:gnu )?(?:lgpl|lesser general public|library general public)", "lgpl lesser library", ("2 0", "2 1", "3 0")),
    ("agpl", "(?:gnu )?(?:agpl|affero general public)", "agpl affero", ("1 0", "3 0")),
    ("fdl", "(?:gnu )?free documentation", "documentation", ("1 1", "1 2", "1 3")),
    ("mpl", "(?:mpl|mozilla public)", "mpl mozilla", ("1 0", "1 1", "2 0")),
    ("epl", "(?:epl|eclipse public)", "epl eclipse", ("1 0", "2 0")),
    ("cddl", "(?:cddl|common development and distribution)", "cddl development", ("1 0", "1 1")),
    ("cpl", "common public", "common", ("1 0",)),
    ("eupl", "(?:eupl|european union public)", "eupl european", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic", "artistic", ("1 0", "2 0")),
    ("bsl", "boost software", "boost", ("1 0",)),
    ("isc", "isc", "isc", ()),
    ("zlib", "(?:zlib|zlib libpng)", "zlib", ()),
    ("unlicense", "unlicense", "unlicense", ()),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public)", "wtfpl public", ("2 0",)),
    ("python", "(?:psf|python software foundation)", "psf python", ("2 0",)),
    ("openssl", "openssl", "openssl", ()),
    ("ofl", "(?:ofl|sil open font)", "ofl sil", ("1 0", "1 1")),
    ("cc-by", "(?:cc by|creative commons attribution)", "cc creative", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)", "cc creative", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)", "cc creative", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)", "cc creative", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "cc creative", ("3 0", "4 0")),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)", "cc creative", ("3 0", "4 0")),
    ("cc0", "(?:cc0|creative commons zero)", "cc0 creative", ("1 0",)),
    ("odbl", "(?:odbl|open database)", "odbl database", ("1 0",)),
    ("ms-pl", "(?:ms pl|microsoft public)", "ms microsoft", ()),
    ("qpl", "(?:qpl|q public)", "qpl q", ("1 0",)),
    ("afl", "academic free", "academic", ("2 1", "3 0")),
    ("osl", "open software", "software", ("2 1", "3 0")),
    ("postgresql", "postgresql", "postgresql", ()),
    ("ncsa", "(?:ncsa|university of illinois)", "ncsa illinois", ()),
    ("zpl", "(?:zpl|zope public)", "zpl zope", ("2 0", "2 1")),
)
#: How a family is named in a text, from the surest: N stands for the name and V for the version. Then words of which a match
#: has one (none: the family's), and a weight.
TEMPLATES = (
    ("spdx license identifier N(?: V)?", "spdx", 1.0),
    ("(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?N(?: (?:licen[cs]e|licence))?(?: (?:version|v) ?V| V)?", "licensed licenced released distributed available published", 0.95),
    ("N(?: licen[cs]e)? (?:version |v ?)?V", "", 0.9),
    ("N licen[cs]e", "license licence", 0.8),
)
#: Notices without a family: label, pattern, words of which a match has one, weight.
NOTICES = (
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*", "copyright", 0.6),
    ("permission", "permission is hereby granted free of charge", "hereby", 0.9),
    ("as-is", "provided as is(?: without (?:express or implied )?warrant(?:y|ies))?", "provided", 0.6),
    ("no-warranty", "without warranty of any kind", "warranty", 0.6),
    ("redistribution", "redistribution and use in source and binary forms", "redistribution", 0.9),
    ("public-domain", "(?:released into|dedicated to|in) the public domain", "domain", 0.8),
    ("proprietary", "(?:proprietary and confidential|unauthori[sz]ed copying)", "proprietary copying", 0.7),
)
_DETECTIONS = "array<struct<start:int,back:int,priority:int,label:string,weight:double>>"


def rules() -> list[tuple[int, str, str, list[str], list[str], float]]:
    """``(priority, label, pattern, words, more words, weight)`` in order of priority.

    Templates come first, then families, then versions from the newest. A match has one of the words and one of the more
    words.
    """
    found = []
    for shape, words, weight in TEMPLATES:
        for label, name, own, versions in FAMILIES:
            for v in [*reversed(versions), None]:
                if v is None and shape.endswith("V"):
                    continue
                major, _, minor = (v or "").partition(" ")
                number = f"{major}(?: {minor})?" if minor == "0" else f"{major} {minor}"
                if v is None:
                    body = shape.replace("(?: (?:version|v) ?V| V)?", "").replace("(?: V)?", "")
                else:
                    body = shape.replace("(?: (?:version|v) ?V| V)?", f"(?: (?:version|v) ?{number}| {number})").replace("(?: V)?", f" {number}").replace("V", number)
                found.append((f"{label}-{v.replace(' ', '.')}" if v else label, body.replace("N", name), (words or own).split(), own.split(), weight))
    found += [(label, body, words.split(), words.split(), weight) for label, body, words, weight in NOTICES]
    return [(k, label, f"(?<![^ ])(?:{body})(?![^ ])", words, more, weight) for k, (label, body, words, more, weight) in enumerate(found)]


def gate() -> list[str]:
    """Words of which every text that matches a rule has one."""
    return sorted({w for _, _, _, words, _, _ in rules() for w in words})


def _starts(words: Column, phrase: str) -> Column:
    """Where the words of ``phrase`` stand consecutively."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            found = found & F.coalesce(F.get(words, i + j) == part, F.lit(False))
        return found

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _matches(normal: Column, rule: Column) -> Column:
    """The places of a rule in words, in order of the text."""
    pieces = F.split(normal, rule["pattern"], -1)
    found = F.call_function("regexp_extract_all", normal, rule["pattern"], F.lit(0))
    both = F.arrays_zip(pieces.alias("p"), found.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_DETECTIONS).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + _spaces(x["p"])
        stop = begin + _spaces(x["m"]) + 1
        one = F.array(F.struct(begin.alias("start"), (-stop).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight")))
        moved = F.struct((begin + _spaces(x["m"])).alias("at"), F.concat(acc["kept"], one).alias("kept"))
        return F.when(x["m"].isNull(), acc).otherwise(moved)

    return F.aggregate(both, start, step, lambda acc: acc["kept"])


def _resolved(found: Column) -> Column:
    """Detections that no other contains and that don't overlap a neighbour of better, or of equal and earlier, priority.

    In order of start, longest first, a detection is contained in an earlier one just if it ends within the reach of
    those before it.
    """
    start = F.struct(F.lit(0).alias("reach"), F.array().cast(_DETECTIONS).alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        return F.when(-d["back"] > acc["reach"], F.struct((-d["back"]).alias("reach"), F.concat(acc["kept"], F.array(d)).alias("kept"))).otherwise(acc)

    return F.aggregate(F.array_sort(found), start, step, lambda acc: acc["kept"])


def _without_beaten(kept: Column) -> Column:
    def stays(d: Column, i: Column) -> Column:
        before, after = F.get(kept, i - 1), F.get(kept, i + 1)
        beaten_before = F.coalesce((-before["back"] > d["start"]) & (before["priority"] <= d["priority"]), F.lit(False))
        beaten_after = F.coalesce((-d["back"] > after["start"]) & (after["priority"] < d["priority"]), F.lit(False))
        return ~beaten_before & ~beaten_after

    return F.filter(kept, stays)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: base phrases and the detections of the signature rules.

    Columns: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections``. Texts are
    lower-cased (A-Z) and cut into words; rules see the words joined by blanks. A rule is tried only where its keyword
    occurs. Detections are places in words with rule, label and weight; of overlapping ones, contained ones and those of
    worse priority than a neighbour go. ``score`` is the largest weight, 0.5 for base phrases alone, else 0. Null and
    empty texts have no word, no label and score 0; repeated rows give repeated results; an empty table gives none.
    Nothing is shuffled. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"))
    rows = rows.select("doc_id", F.array_remove(F.split("t", SEPARATORS), "").alias("w"))
    rows = rows.select("doc_id", "w", F.size("w").alias("n"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("normal"))
    none = F.array().cast("array<int>")
    for k, (phrase, _) in enumerate(BASE):
        rows = rows.withColumn(f"b{k}", F.when(F.contains("normal", F.lit(f" {phrase} ")), _starts(F.col("w"), phrase)).otherwise(none))
    listed = F.array(*(F.struct(F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(body).alias("pattern"), F.lit(words).alias("words"), F.lit(more).alias("more"), F.lit(weight).alias("weight")) for p, label, body, words, more, weight in rules()))
    inner = F.trim("normal")
    tried = F.filter(listed, lambda r: F.arrays_overlap("w", r["words"]) & F.arrays_overlap("w", r["more"]))
    found = F.flatten(F.transform(tried, lambda r: _matches(inner, r)))
    gated = F.arrays_overlap("w", F.lit(gate()))
    rows = rows.withColumn("found", F.when(gated, found).otherwise(F.array().cast(_DETECTIONS)))
    rows = rows.withColumn("kept", _resolved(F.col("found"))).withColumn("kept", _without_beaten(F.col("kept")))
    places = F.concat(*(F.col(f"b{k}") for k in range(len(BASE))))
    base = F.array_sort(F.array_compact(F.array(*(F.when(F.size(f"b{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)))))
    rows = rows.select("doc_id", F.col("n").cast("long").alias("n_words"), places.alias("places"), base.alias("base"), "kept")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("kept", lambda d: d["label"]))))
    weights = F.transform("kept", lambda d: d["weight"])
    detections = F.transform("kept", lambda d: F.struct(d["start"].alias("first"), (-d["back"]).alias("stop"), d["label"].alias("label"), d["weight"].alias("weight")))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(weights), F.when(F.size("places") > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
        detections.alias("detections"),
    )
