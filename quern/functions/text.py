"""Text as Column expressions: cleaning, folding, tokens, keys, containment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and the letters they fold to.
FOLDS = {
    "a": "àáảãạăằắẳẵặâầấẩẫậäåā", "e": "èéẻẽẹêềếểễệëē", "i": "ìíỉĩịïîī", "o": "òóỏõọôồốổỗộơờớởỡợöōø",
    "u": "ùúủũụưừứửữựüûū", "y": "ỳýỷỹỵÿ", "d": "đ", "c": "ç", "n": "ñ",
}


def clean(c: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold(c: Column) -> Column:
    """Lower case without accents, every run of other than letters and digits one space."""
    accented = "".join(FOLDS.values())
    plain = "".join(k * len(v) for k, v in FOLDS.items())
    return F.trim(F.regexp_replace(F.translate(F.lower(c), accented, plain), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column, stop: list[str] | None = None, least: int = 3) -> Column:
    """The distinct folded words of at least `least` letters that are no stop words."""
    words = F.filter(F.split(fold(c), " "), lambda w: F.length(w) >= least)
    return F.array_except(words, F.array(*(F.lit(s) for s in stop or [])).cast("array<string>"))


#: Phrases about an offer rather than a product, folded, the longer before the shorter.
PHRASES = [
    "qua tang khong ban", "gift not for sale", "not for sale", "hang tang kem", "hang tang", "khong ban", "bao bi giao ngau nhien", "giao ngau nhien", "doc quyen", "chinh hang",
    "freeship", "free ship", "flash sale", "sale", "hot", "new", "bestseller", "best seller", "giveaway", "free gift", "combo", "tang kem",
]
BRACKETED = r"[\[\(][^\]\)]{0,60}[\]\)]"
#: A bracket that holds a phrase.
DECORATED = r"[\[\(](?=[^\]\)]*(?:" + "|".join(PHRASES) + r"))[^\]\)]{0,60}[\]\)]"


def without_decoration(c: Column) -> Column:
    """Without what stands in brackets."""
    return clean(F.regexp_replace(c, r"\[[^\]]*\]|\([^)]*\)|\{[^}]*\}", " "))


def lower_plain(c: Column) -> Column:
    """Lower case without accents; marks stay."""
    return F.translate(F.lower(c), "".join(FOLDS.values()), "".join(k * len(v) for k, v in FOLDS.items()))


def without_phrases(folded: Column) -> Column:
    """A folded title without the brackets that hold a registered phrase, and without the phrases themselves."""
    out = F.regexp_replace(folded, DECORATED, " ")
    for phrase in PHRASES:
        out = F.replace(out, F.lit(phrase), F.lit(" "))
    return clean(out)


def removed_phrases(folded: Column) -> Column:
    """What without_phrases takes out: the inside of such brackets, then each phrase that is still there, in order."""
    inside = F.transform(F.regexp_extract_all(folded, F.lit(f"({DECORATED})"), F.lit(1)), lambda x: F.trim(F.substring(x, F.lit(2), F.length(x) - 2)))
    left, found = F.regexp_replace(folded, DECORATED, " "), []
    for phrase in PHRASES:
        found.append(F.when(F.contains(left, F.lit(phrase)), F.lit(phrase)))
        left = F.replace(left, F.lit(phrase), F.lit(" "))
    return F.array_distinct(F.concat(inside, F.array_compact(F.array(*found))))


def leaf_of(ref: Column) -> Column:
    """The last part of a dotted reference."""
    return F.substring_index(ref, ".", -1)


def iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def epoch(stamp: Column, zone: str = "UTC") -> Column:
    """Seconds since 1970 of a local date and time, read in its time zone; null for what is none."""
    return F.unix_seconds(F.to_utc_timestamp(F.try_to_timestamp(stamp), zone))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best of three likenesses of two folded texts: as they are, with their words sorted, and of shared words against all.

    0 to 1, made from edit distances, so close to but not the same as a weighted ratio by matching blocks.
    """
    ta, tb = (F.sort_array(F.array_distinct(F.split(c, " "))) for c in (a, b))
    both = F.array_intersect(ta, tb)
    core = F.array_join(both, " ")
    fuller = [F.trim(F.concat_ws(" ", core, F.array_join(F.array_except(t, both), " "))) for t in (ta, tb)]
    sorted_ = similarity(F.array_join(ta, " "), F.array_join(tb, " "))
    sets = F.when(F.size(both) > 0, F.greatest(*(similarity(core, f) for f in fuller), similarity(*fuller))).otherwise(0.0)
    return F.greatest(similarity(a, b), 0.95 * sorted_, 0.95 * sets)


def key_of(*parts: str) -> Column:
    return F.concat_ws(":", *parts)


def short_hash(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def contains(c: Column, part: str) -> Column:
    """Whether part occurs; case counts, and no character of it is a wildcard."""
    return F.contains(c, F.lit(part))


def similarity(a: Column, b: Column) -> Column:
    """One less the edits between two strings as a share of the longer; 1 for two empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def truthy(c: Column) -> Column:
    return F.lower(c.cast("string")).isin("true", "1")


def all_nines(c: Column, least: int) -> Column:
    return c.cast("decimal(20,0)").cast("string").rlike(f"^9{{{least},}}$")
