"""License scan by ordered signature rules, in DataFrame operations only.

A signature is a pattern over the words of a text (lower case, one space
between words), with a label, a keyword and a priority.  Texts without any
keyword are not looked at; of the others only signatures whose keyword occurs
are searched.  Where detections overlap, one that lies inside another of a
better priority, or inside a longer one of the same priority, is suppressed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word characters: ASCII digits and letters, and everything beyond ASCII.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases whose places are always counted, their labels and keywords.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
BASE_KEYWORDS = ["mit licen", "apache", "cc by"]

# Families of licenses as (label, keyword, names, versions).
FAMILIES = [
    ("gpl", "general public", ["gnu general public licen[cs]e", "general public licen[cs]e"], ["1", "2", "3"]),
    ("gpl", "gpl", ["gnu gpl", "gpl"], ["1", "2", "3"]),
    ("lgpl", "lesser general", ["gnu lesser general public licen[cs]e", "lesser general public licen[cs]e"], ["2", "2 1", "3"]),
    ("lgpl", "library general", ["gnu library general public licen[cs]e"], ["2"]),
    ("lgpl", "lgpl", ["gnu lgpl", "lgpl"], ["2", "2 1", "3"]),
    ("agpl", "affero", ["gnu affero general public licen[cs]e", "affero general public licen[cs]e"], ["1", "3"]),
    ("agpl", "agpl", ["gnu agpl", "agpl"], ["1", "3"]),
    ("gfdl", "free documentation", ["gnu free documentation licen[cs]e"], ["1 1", "1 2", "1 3"]),
    ("apache", "apache", ["apache software licen[cs]e", "apache licen[cs]e", "apache"], ["1 0", "1 1", "2", "2 0"]),
    ("mpl", "mozilla", ["mozilla public licen[cs]e"], ["1 0", "1 1", "2 0"]),
    ("mpl", "mpl", ["mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse", ["eclipse public licen[cs]e"], ["1 0", "2 0"]),
    ("epl", "epl", ["epl"], ["1 0", "2 0"]),
    ("cddl", "common development", ["common development and distribution licen[cs]e"], ["1 0", "1 1"]),
    ("cddl", "cddl", ["cddl"], ["1 0", "1 1"]),
    ("eupl", "european union", ["european union public licen[cs]e"], ["1 0", "1 1", "1 2"]),
    ("eupl", "eupl", ["eupl"], ["1 0", "1 1", "1 2"]),
    ("osl", "open software", ["open software licen[cs]e"], ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", "academic free", ["academic free licen[cs]e"], ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("artistic", "artistic", ["perl artistic licen[cs]e", "artistic licen[cs]e"], ["1 0", "2 0"]),
    ("bsl", "boost", ["boost software licen[cs]e"], ["1 0"]),
    ("cpl", "common public", ["common public licen[cs]e"], ["1 0"]),
    ("ipl", "ibm public", ["ibm public licen[cs]e"], ["1 0"]),
    ("php", "php", ["php licen[cs]e"], ["3 0", "3 01"]),
    ("python", "python", ["python software foundation licen[cs]e", "python licen[cs]e"], ["2", "2 0"]),
    ("zpl", "zope", ["zope public licen[cs]e"], ["1 1", "2 0", "2 1"]),
    ("sil-ofl", "open font", ["sil open font licen[cs]e", "open font licen[cs]e"], ["1 0", "1 1"]),
    ("odbl", "open database", ["open database licen[cs]e"], ["1 0"]),
    ("openssl", "openssl", ["openssl licen[cs]e"], []),
    ("unlicense", "unlicense", ["the unlicense", "unlicense"], []),
    ("wtfpl", "wtfpl", ["wtfpl"], ["1", "2"]),
    ("zlib", "zlib", ["zlib libpng licen[cs]e", "zlib licen[cs]e"], []),
    ("isc", "isc licen", ["isc licen[cs]e"], []),
    ("mit", "mit licen", ["mit licen[cs]e"], []),
    ("mit", "mit x11", ["mit x11 licen[cs]e"], []),
    ("mit", "mit expat", ["mit expat licen[cs]e"], []),
    ("bsd-2-clause", "bsd", ["bsd 2 clause licen[cs]e", "bsd 2 clause", "2 clause bsd", "simplified bsd licen[cs]e"], []),
    ("bsd-3-clause", "bsd", ["bsd 3 clause licen[cs]e", "bsd 3 clause", "3 clause bsd", "new bsd licen[cs]e"], []),
    ("bsd-4-clause", "bsd", ["bsd 4 clause licen[cs]e", "original bsd licen[cs]e"], []),
    ("bsd", "bsd", ["bsd style licen[cs]e", "bsd licen[cs]e"], []),
]

# Elements of the Creative Commons family.
CC_PARTS = {
    "by": "attribution",
    "by sa": "attribution share ?alike",
    "by nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
    "by nc": "attribution non ?commercial",
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

# Wording without a family, as (label, keyword, pattern).
PLAIN = [
    ("public-domain", "public domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "public domain dedication"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("all-rights-reserved", "all rights", "all rights reserved"),
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification"),
    ("proprietary", "proprietary", "proprietary and confidential"),
]

_VERSION = "(?: version| ver| v)? ?"
_GRANT = "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?"


def signatures() -> list[tuple[str, str, int, str]]:
    """The ordered rules: (label, keyword, priority, pattern); priority 1 is best.

    1: base phrases and names with a version; 2: grants of a name; 3: names;
    each list of a family is ordered as written.
    """
    rules = [(label, keyword, 1, phrase) for (phrase, label), keyword in zip(BASE.items(), BASE_KEYWORDS, strict=True)]
    for label, keyword, names, versions in FAMILIES:
        for name in names:
            for version in versions:
                rules.append((f"{label}-{version.replace(' ', '.')}", keyword, 1, f"{name}(?: licen[cs]e)?{_VERSION}{version}(?: or later)?"))
            rules.append((label, keyword, 2, f"{_GRANT}{name}"))
            if name not in ("gpl", "mpl", "epl", "apache"):
                rules.append((label, keyword, 3, name))
    for short, spoken in CC_PARTS.items():
        label = "cc-" + short.replace(" ", "-")
        for version in CC_VERSIONS:
            rules.append((f"{label}-{version.replace(' ', '.')}", "cc by", 1, f"cc {short}(?: licen[cs]e)? {version}"))
            rules.append((f"{label}-{version.replace(' ', '.')}", "creative commons", 1, f"creative commons {spoken}(?: licen[cs]e)?{_VERSION}{version}"))
        rules.append((label, "cc by", 3, f"cc {short}"))
        rules.append((label, "creative commons", 3, f"creative commons {spoken}"))
    return rules + [(label, keyword, 2, pattern) for label, keyword, pattern in PLAIN]


def keywords(rules: list[tuple[str, str, int, str]]) -> list[str]:
    return sorted({rule[1] for rule in rules})


def hint(text: Column, rules: list[tuple[str, str, int, str]]) -> Column:
    """A cheap look at the raw text: does the longest word of any keyword occur at all?"""
    longest = sorted({max(k.split(), key=len) for k in keywords(rules)})
    needed = [w for w in longest if not any(o != w and o in w for o in longest)]
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in needed])


def normalised(text: Column) -> Column:
    """The words of a text in ASCII lower case with one space between and around them."""
    spaced = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), BREAK, " ")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(spaced, upper, upper.lower())


def _places(norm: Column, pattern: Column) -> Column:
    """Start and end word of each match of a whole-word pattern, in order.

    A mark goes before each match; the words before a mark are counted by the
    spaces of the pieces up to it.  The space after a match is not taken, so
    it can begin the next one.
    """
    whole = F.concat(F.lit(" (?:"), pattern, F.lit(")(?= )"))
    pieces = F.split(F.regexp_replace(norm, whole, F.lit("\x01$0")), "\x01")
    starts = F.aggregate(
        F.transform(pieces, lambda p: F.regexp_count(p, F.lit(" "))),
        F.array().cast("array<int>"),
        lambda done, n: F.concat(done, F.array(n + F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)))),
    )
    lengths = F.transform(F.regexp_extract_all(norm, whole, F.lit(0)), lambda m: F.regexp_count(m, F.lit(" ")))
    # the last sum counts all words and has no match
    matched = F.filter(F.arrays_zip(starts.alias("s"), lengths.alias("n")), lambda z: z["n"].isNotNull())
    return F.transform(matched, lambda z: F.struct(z["s"].alias("start"), (z["s"] + z["n"]).alias("end")))


def _phrase_places(norm: Column, phrase: str) -> Column:
    """Start words of a fixed phrase, also where places overlap (none of the base phrases can)."""
    return F.transform(_places(norm, F.lit(phrase)), lambda p: p["start"])


def present(norm: Column, rules: list[tuple[str, str, int, str]]) -> Column:
    """The keywords that occur in a normalised text."""
    known = F.array(*[F.lit(k) for k in keywords(rules)])
    return F.filter(known, lambda k: F.contains(norm, F.concat(F.lit(" "), k)))


def active(norm: Column, found: Column, rules: list[tuple[str, str, int, str]]) -> Column:
    """The rules whose keyword is among ``found`` and whose pattern occurs."""
    ordered = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(priority).alias("priority"), F.lit(pattern).alias("pattern"))
        for label, keyword, priority, pattern in rules
    ])
    matching = F.filter(
        ordered,
        lambda r: F.array_contains(found, r["keyword"]) & F.rlike(norm, F.concat(F.lit(" (?:"), r["pattern"], F.lit(") "))),
    )
    # two uses of ``found`` also keep Catalyst from moving its work into the lambda
    return F.when(F.size(found) > 0, matching)


def detections(norm: Column, matching: Column) -> Column:
    """All places of the matching rules as structs, ordered by start."""
    found = F.flatten(F.transform(
        matching,
        lambda r: F.transform(
            _places(norm, r["pattern"]),
            lambda p: F.struct(
                p["start"].alias("start"), (-p["end"]).alias("minus_end"), r["priority"].alias("priority"), r["label"].alias("label"),
            ),
        ),
    ))
    return F.array_distinct(F.array_sort(found))


def suppressed(found: Column, reach: int) -> Column:
    """Drop detections that lie inside a better one.

    ``found`` is ordered by start.  A pattern is at most 16 words long and
    matches at most once at a start, so only ``reach`` = 16 x rules entries
    on either side can touch an entry; no others need to be compared.
    """
    return F.filter(
        found,
        lambda d, i: ~F.exists(
            F.slice(found, F.greatest(i + 1 - reach, F.lit(1)), 2 * reach),
            lambda e: (e["start"] <= d["start"])
            & (e["minus_end"] <= d["minus_end"])
            & (
                (e["priority"] < d["priority"])
                | ((e["priority"] == d["priority"]) & ((e["start"] < d["start"]) | (e["minus_end"] < d["minus_end"])))
            ),
        ),
    )


def scan_licenses(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with the license columns added, each name after ``prefix``.

    ``n_words``; ``n_base``, ``first_word``, ``last_word``: places of the base
    phrases; ``base_labels``; ``labels``: base labels and those of the
    signatures that are not suppressed, sorted, joined by commas;
    ``detections``: the kept detections (start, end, priority, label);
    ``score``: 1.0 with a detection of priority 1, 0.8 of 2, 0.5 of 3, else 0.

    NULL and empty texts have no words and no labels.  Rows are kept one for
    one; input columns whose names clash with new ones are replaced.
    """
    rules = signatures()
    value = F.coalesce(F.col(text), F.lit(""))
    gated = F.when(hint(F.col("__lower"), rules), normalised(value))
    out = {c: f"{prefix}{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "detections", "score")}
    step = df.withColumns({out["n_words"]: F.regexp_count(value, F.lit(WORD)).cast("long"), "__lower": F.lower(value)})
    step = step.withColumn("__norm", gated).drop("__lower")
    norm = F.col("__norm")
    step = step.withColumns({f"__base_{label}": F.when(F.contains(norm, F.lit(f" {phrase} ")), _phrase_places(norm, phrase)) for phrase, label in BASE.items()})
    empty = F.array().cast("array<int>")
    base = [F.coalesce(F.col(f"__base_{label}"), empty) for label in BASE.values()]
    step = (
        step.withColumn("__places", F.concat(*base))
        .withColumn("__present", F.when(norm.isNotNull(), present(norm, rules)))
        .withColumn("__active", active(norm, F.col("__present"), rules))
        .withColumn("__found", detections(norm, F.col("__active")))
        .withColumn("__kept", suppressed(F.col("__found"), 16 * len(rules)))
    )
    named = F.array_compact(F.array(*[F.when(F.size(places) > 0, F.lit(label)) for places, label in zip(base, BASE.values(), strict=True)]))
    kept = F.coalesce(F.col("__kept"), F.array().cast("array<struct<start:int,minus_end:int,priority:int,label:string>>"))
    best = F.array_min(F.transform(kept, lambda d: d["priority"]))
    step = step.withColumns({
        out["n_base"]: F.size("__places").cast("long"),
        out["first_word"]: F.array_min("__places").cast("long"),
        out["last_word"]: F.array_max("__places").cast("long"),
        out["base_labels"]: F.array_join(F.array_sort(named), ","),
        out["labels"]: F.array_join(F.array_sort(F.array_distinct(F.concat(named, F.transform(kept, lambda d: d["label"])))), ","),
        out["detections"]: F.transform(kept, lambda d: F.struct(d["start"].alias("start"), (-d["minus_end"]).alias("end"), d["priority"].alias("priority"), d["label"].alias("label"))),
        out["score"]: F.when(best == 1, 1.0).when(best == 2, 0.8).when(best == 3, 0.5).otherwise(0.0),
    })
    return step.drop("__norm", "__places", "__present", "__active", "__found", "__kept", *[f"__base_{label}" for label in BASE.values()])
