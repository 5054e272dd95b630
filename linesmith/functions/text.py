"""Text and code primitives as Column expressions; all of them stay inside Catalyst."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What looks like a part number but is a size, count, date, year or electrical value.
EXCLUDED = (
    r"[0-9]{1,4}-?(?:FT|IN)",
    r"[0-9]+(?:-[0-9]+)?/[0-9]+-?IN",
    r"[0-9]{1,2}-[0-9]{1,2}/[0-9]{1,2}",
    r"[0-9]{1,2}-[0-9]{1,2}",
    r"[0-9]{1,2}/[0-9]{1,2}",
    r"[0-9]-?PLY",
    r"[0-9]{1,3}X[0-9]{1,3}",
    r"(?:[0-9]/[0-9]|[0-9]{1,3})(?:IN|FT)X[0-9]{1,3}(?:IN|FT)",
    r"[0-9]{1,2}X[0-9]{1,2}IN",
    r"(?:[0-9]/[0-9]|[0-9]{1,3})X[0-9]{1,3}FT",
    r"[0-9]{1,3}X[0-9]{1,3}X(?:[0-9]/[0-9]|[0-9]{1,3})",
    r"[0-9]{1,3}[-/]?(?:PC|PACK|PK|CT|MIL|BX|BOX)",
    r"(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12][0-9]|3[01])/(?:20)?[0-9]{2}",
    r"(?:20)?[0-9]{2}/(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12][0-9]|3[01])",
    r"20(?:2[0-9]|30)",
    r"[0-9]{1,4}-?V|[0-9]{1,4}-?A(?:MP)?|[0-9]{1,4}-?W",
    r"CAT[0-9]",
)
EXCLUDED_PATTERN = "^(?:" + "|".join(EXCLUDED) + ")$"
#: Character classes whose maximal runs of 4 to 50 characters are part-number candidates.
CANDIDATE_CLASSES = ("0-9", "0-9-", "0-9/", "0-9/-", "A-Z0-9", "A-Z0-9-", "A-Z0-9/", "A-Z0-9/-", "0-9.", "A-Z0-9.")
NAME_DROPS = "&-/\\_.,() "


def clean_description(c: Column) -> Column:
    """Upper case, decoration and line breaks to single spaces, edges stripped."""
    c = F.regexp_replace(F.upper(c), r"[_*|=@^]", " ")
    c = F.btrim(F.regexp_replace(c, r"[\r\n]+", " "), F.lit(' "-.'))
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_for_model(c: Column) -> Column:
    """Currency and percent in words, stray periods and other marks dropped, spaces collapsed."""
    c = F.replace(F.replace(c, F.lit("$"), F.lit(" dollars ")), F.lit("%"), F.lit(" percent "))
    c = F.regexp_replace(c, r"(?<![0-9])\.(?![0-9])", "")
    c = F.regexp_replace(c, r"""[^A-Za-z0-9\s.\-/'"]""", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_for_classification(c: Column) -> Column:
    return clean_for_model(F.lower(c))


def remove_separators(c: Column, dots: bool = True) -> Column:
    return F.translate(c, "-/." if dots else "-/", "")


_MARKS = "".join(ch for ch in map(chr, range(1, 128)) if not ch.isalnum())


def alphanumeric(c: Column) -> Column:
    """The ASCII letters and digits. An expression takes many times as long as a table of marks, so it is left to texts with other characters."""
    return F.when(F.rlike(c, F.lit(r"[^\x01-\x7F]")), F.regexp_replace(c, "[^a-zA-Z0-9]", "")).otherwise(F.translate(c, _MARKS, ""))


def name_key(c: Column) -> Column:
    """The key under which spellings of a manufacturer meet."""
    return F.translate(F.upper(F.trim(c)), NAME_DROPS, "")


def scrub_part_number(c: Column) -> Column:
    return F.translate(c, "-/='\"| ", "")


# Letters that do not decompose, and how they are spelled out.
SPELLED_OUT = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D"}


def _plain(ch: str) -> str:
    """A character's compatibility decomposition, spelled out, as far as it is ASCII."""
    return "".join(x for y in unicodedata.normalize("NFKD", ch) for x in SPELLED_OUT.get(y, y) if x.isascii())


def _decompositions() -> tuple[str, str, dict[str, str]]:
    """All characters that become one ASCII character, these, and those that become several."""
    single, several = [], {}
    for code in range(0x80, 0x110000):
        ch = chr(code)
        if 0xD800 <= code < 0xE000 or not (unicodedata.decomposition(ch) or ch in SPELLED_OUT):
            continue
        plain = _plain(ch)
        if len(plain) == 1:
            single.append((ch, plain))
        elif plain:
            several[ch] = plain
    return "".join(a for a, _ in single), "".join(b for _, b in single), several


_FROM, _TO, _SEVERAL = _decompositions()


def remove_accents(c: Column) -> Column:
    """Characters without their marks, in compatibility form; some letters are spelled out, what is not ASCII then is dropped."""
    # Most texts are plain ASCII and stay as they are. Characters that become several are looked up one by one, in the few texts that hold any.
    text = c
    table = F.create_map(*(F.lit(x) for pair in _SEVERAL.items() for x in pair))
    spelled = F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(table[ch], ch)), "")
    c = F.when(F.rlike(c, F.lit("[" + "".join(_SEVERAL) + "]")), spelled).otherwise(c)
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), F.regexp_replace(F.translate(c, _FROM, _TO), r"[^\x00-\x7F]", "")).otherwise(text)


def is_present(c: Column) -> Column:
    """Not null, not blank, and not the text NULL."""
    return F.coalesce(~F.upper(F.trim(c)).isin("", "NULL"), F.lit(False))


def is_defined(c: Column) -> Column:
    return is_present(c) & (F.upper(F.trim(c)) != "UNDEFINED")


def is_own_part_number(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit("^AK[0-9]+$")), F.lit(False))


def is_upc(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit("^[0-9]{8,12}$")), F.lit(False))


def unspsc_or_blank(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit("^[0-9]{8}$")), c).otherwise("")


def effective_length(c: Column) -> Column:
    """Length without separators and without what exceeds two of a repeated character, plus one for 2 and for 4 capitals."""
    excess = F.aggregate(F.regexp_extract_all(c, F.lit(r"((.)\2{2,})"), 1), F.lit(0), lambda n, run: n + F.length(run) - 2)
    capitals = F.length(F.regexp_replace(c, "[^A-Z]", ""))
    n = F.length(remove_separators(c)) - excess + F.when(capitals >= 4, 2).when(capitals >= 2, 1).otherwise(0)
    return F.when(F.length(c) > 0, n).otherwise(0)


def is_excluded(c: Column) -> Column:
    return F.rlike(c, F.lit(EXCLUDED_PATTERN))


def is_candidate(c: Column) -> Column:
    return (effective_length(c) >= 4) & F.rlike(c, F.lit("[0-9]")) & ~is_excluded(c)


def part_number_candidates(c: Column) -> Column:
    """Valid maximal runs of the candidate classes, without separators at their ends."""
    found = [F.transform(F.filter(F.regexp_extract_all(c, F.lit(f"[{k}]+"), 0), lambda x: (F.length(x) >= 4) & (F.length(x) <= 50)), lambda x: F.btrim(x, F.lit("-/."))) for k in CANDIDATE_CLASSES]
    return F.filter(F.array_distinct(F.flatten(F.array(*found))), is_candidate)


def lookup_variations(candidates: Column) -> Column:
    """Each candidate as it is, without `-/`, and without `-/.`."""
    return F.array_distinct(F.concat(candidates, F.transform(candidates, lambda x: remove_separators(x, dots=False)), F.transform(candidates, lambda x: remove_separators(x))))


def independent_candidates(candidates: Column) -> Column:
    """Normalised candidates that are not part of another one."""
    n = F.array_distinct(F.transform(candidates, lambda x: remove_separators(x)))
    return F.filter(n, lambda a: ~F.exists(n, lambda b: (a != b) & F.contains(b, a)))


def _phrase(name: Column) -> Column:
    return F.array_join(F.regexp_extract_all(name, F.lit(r"(?U)\w+"), 0), r"[\W_]+")


def starts_with_phrase(text: Column, name: Column) -> Column:
    """Whether the text begins with the words of the name, whatever separates them."""
    words = _phrase(name)
    return F.coalesce((words != "") & F.rlike(text, F.concat(F.lit("(?iU)^"), words, F.lit(r"(?!\w)"))), F.lit(False))


def contains_name(text: Column, name: Column) -> Column:
    """Whether the name stands in the text as whole words, marks other than spaces and underscores left aside."""
    plain = lambda c: F.regexp_replace(c, r"(?U)[^\w\s]", " ")
    words = F.trim(plain(name))
    return F.coalesce((words != "") & F.rlike(plain(text), F.concat(F.lit(r"(?iU)\b"), words, F.lit(r"\b"))), F.lit(False))


def boundary_class(text: Column, name: Column) -> Column:
    """WHOLE_WORD, EMBEDDED or INVALID by what stands around the first occurrence of the name in the text."""
    pattern = F.concat(F.lit("(?iU)"), _phrase(name))
    at = F.regexp_instr(text, pattern)
    before = F.substring(text, at - 1, F.lit(1))
    after = F.substring(text, at + F.length(F.regexp_substr(text, pattern)), F.lit(1))
    clear = lambda c, edge: edge | c.isin(" ", "(", ")", ",", ".")
    soft = lambda c: c.isin("-", "/", ".")
    first, last = clear(before, at == 1), clear(after, after == "")
    return F.when((at == 0) | (_phrase(name) == ""), "INVALID").when(first & last, "WHOLE_WORD").when((first & soft(after)) | (soft(before) & last), "EMBEDDED").otherwise("INVALID")


def similarity_points(s: Column, mid: float = 0.55) -> Column:
    return F.rint((s - mid) / (1 - mid) * 100)


def codes_compatible(a: Column, b: Column) -> Column:
    """Whether one code is the other's generic form (zeros at its end)."""
    return F.startswith(b, F.rtrim(a, F.lit("0"))) | F.startswith(a, F.rtrim(b, F.lit("0")))


def code_level(c: Column) -> Column:
    return F.when(F.endswith(c, F.lit("0000")), 1).when(F.endswith(c, F.lit("00")), 2).otherwise(3)


def code_variants(c: Column) -> Column:
    """The code, its class and its family."""
    return F.array_distinct(F.array(c, F.concat(F.substring(c, 1, 6), F.lit("00")), F.concat(F.substring(c, 1, 4), F.lit("0000"))))


def code_match(expected: Column, predicted: Column, digits: int = 6) -> Column:
    """yes, no or skip: equality of the first digits, unless there is nothing to compare with."""
    skip = expected.isNull() | F.upper(F.trim(expected)).isin("-", "", "NAN", "R", "LOT")
    return F.when(skip, "skip").when(F.substring(expected, 1, digits) == F.substring(F.coalesce(predicted, F.lit("")), 1, digits), "yes").otherwise("no")


def prefix_or_suffix(a: Column, b: Column) -> Column:
    return F.startswith(a, b) | F.endswith(a, b) | F.startswith(b, a) | F.endswith(b, a)


# Points by effective length of a part number, and by length of a name that stands alone.
PART_POINTS = ((4, 10), (5, 30), (6, 45), (7, 60), (8, 70), (9, 80), (10, 90), (11, 95))


def part_points(length: Column) -> Column:
    out = F.lit(100)
    for below, points in reversed(PART_POINTS):
        out = F.when(length < below, points).otherwise(out)
    return out


# Points for the words in which a searched result is compared with the request.
MFR_WORDS = {"Exact": 40, "Likely": 30, "Possible": 20, "Not Detected": 0, "Mismatch": -10}
PART_WORDS = {"Exact": 25, "Strong": 20, "Partial": 15, "Possible": 5, "No Match": 0}
DESCR_WORDS = {"Exact": 25, "Very High": 20, "High": 15, "Medium": 5, "Low": 0}


def word_points(c: Column, points: dict[str, int]) -> Column:
    """The points of a word as it is spelled; any other word, and null, count 0."""
    table = F.create_map(*(F.lit(x) for pair in points.items() for x in pair))
    return F.coalesce(table[c], F.lit(0))


def rental_label(name: Column, flag: Column) -> Column:
    return F.when(flag == "Y", F.concat_ws(" - ", F.lit("RENTAL"), name)).otherwise(name)


def augmented_description(text: Column, part: Column, mfr: Column) -> Column:
    """The text with part number and manufacturer in front, where they are present and not in it."""
    one = F.when(is_present(part) & ~F.contains(text, part), F.concat_ws(" ", part, text)).otherwise(text)
    return F.when(is_present(mfr) & ~F.contains(one, mfr), F.concat_ws(" ", mfr, one)).otherwise(one)


def edge_ngrams(c: Column, least: int = 6, most: int = 30) -> Column:
    """Prefixes of the separator-free part number, in lower case."""
    plain = F.lower(remove_separators(c))
    return F.when(F.length(plain) >= least, F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length(plain))), lambda n: F.substring(plain, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def log_id(job_id: Column) -> Column:
    return F.regexp_replace(job_id, "~([^~]*)$", "-$1")


def job_id(log_id: Column) -> Column:
    return F.regexp_replace(log_id, "-([^-]*)$", "~$1")


def fenced_json(c: Column) -> Column:
    """The text between code fences, or the text itself."""
    return F.trim(F.regexp_replace(c, r"(?s)^.*?```(?:json)?\s*|\s*```.*$", ""))


def is_json(body: Column) -> Column:
    """Whether a text without fences (see fenced_json) is JSON."""
    return F.coalesce((body != "") & F.try_parse_json(body).isNotNull(), F.lit(False))


def json_outcome(c: Column) -> Column:
    """ok, truncated (it begins like JSON), invalid or empty."""
    body = fenced_json(c)
    return F.when(body.isNull() | (body == ""), "empty").when(F.try_parse_json(body).isNotNull(), "ok").when(F.rlike(body, F.lit(r"^[\[{]")), "truncated").otherwise("invalid")


def central_time(ts: Column) -> Column:
    """A UTC time as US central time."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/Chicago"), ts.cast("timestamp_ntz"))


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def in_days_before(ts: Column, as_of: Column, days: int) -> Column:
    """From midnight so many days before as_of up to the last midnight."""
    today = F.date_trunc("day", as_of)
    return (ts >= today - F.make_dt_interval(days=F.lit(days))) & (ts < today)
