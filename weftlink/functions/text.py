"""Normalisation, address, contact and set functions as column expressions.

Everything stays in the JVM but Unicode folding (NFKC, case folding, accents,
transliteration by character name), for which Spark has no built-in; those are Arrow
UDFs, and ``ascii_only`` leaves them out where the input is known to be ASCII.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlink.functions import constants as C
from weftlink.session import application

EMPTY = "array<string>"


def words_of(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def raw_text(c: Column) -> Column:
    """Null becomes empty; blanks of any script at the ends go."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


_made: dict[tuple[str, str], Callable[..., Column]] = {}


def _mapped(f: Callable[[str | None], str], c: Column) -> Column:
    """``f`` over the distinct values of each batch; equal calls give equal expressions, which Spark evaluates once."""
    key = (application(), f.__name__)
    if key not in _made:

        def run(s: pd.Series) -> pd.Series:
            known: dict = {}
            return pd.Series([known[x] if x in known else known.setdefault(x, f(x)) for x in s], dtype=object)

        run.__name__ = f.__name__
        _made[key] = F.pandas_udf(run, "string")
    return _made[key](c)


def _nfkc_casefold(x: str | None) -> str:
    return unicodedata.normalize("NFKC", x or "").casefold()


def nfkc_casefold(c: Column) -> Column:
    return _mapped(_nfkc_casefold, c)


def _fold_accents(x: str | None) -> str:
    if not x or x.isascii():
        return (x or "").lower()
    return "".join(k for k in unicodedata.normalize("NFKD", (x or "").casefold()) if not unicodedata.combining(k))


def fold_accents(c: Column) -> Column:
    """NFKD without combining marks, case folded."""
    return _mapped(_fold_accents, c)


def _syllables(x: str | None) -> str:
    if not x or x.isascii():
        return x or ""
    out = []
    for k in x:
        name = unicodedata.name(k, "") if "\u0900" <= k <= "\u0d7f" else ""
        found = re.search(r"LETTER ([A-Z]+)", name) or re.search(r"VOWEL SIGN ([A-Z]+)", name)
        out.append(found[1].lower() if found else "" if name else k)
    return "".join(out)


def transliterated_by_name(c: Column) -> Column:
    """Indic letters and vowel signs as the syllable in their Unicode names; other Indic signs go."""
    return _mapped(_syllables, c)


def _romanized(x: str | None) -> str:
    if not x or x.isascii():
        return (x or "").lower()
    out = []
    for k in unicodedata.normalize("NFKD", x.casefold()):
        if k.isascii():
            out.append(k)
        elif not unicodedata.combining(k) or unicodedata.name(k, "").startswith(INDIC):
            found = re.search(r"(?:LETTER|SYLLABLE|VOWEL SIGN|LIGATURE) (?:FINAL |SHORT |HARD |SOFT |VISARGA )?([A-Z]+)", unicodedata.name(k, ""))
            sound = found[1].lower() if found else ""
            if unicodedata.name(k, "").startswith("GREEK"):
                sound = GREEK.get(sound, sound[:1])
            elif unicodedata.name(k, "").startswith(("CYRILLIC", "HEBREW", "ARABIC", "ARMENIAN", "GEORGIAN")) and len(sound) > 1:
                sound = sound.strip("aeiou") or sound[:1]
            out.append(sound)
    return "".join(out)


INDIC = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")
GREEK = {"theta": "th", "phi": "f", "chi": "ch", "psi": "ps"}


def romanized(c: Column) -> Column:
    """Lower-case ASCII for any script whose characters are named by their sounds.

    Accents go; letters and syllables become the sound in their Unicode names (of
    alphabets its consonants). Characters without such a name, as Chinese ones, go.
    """
    return _mapped(_romanized, c)


def _letter_table() -> tuple[str, str]:
    source, target = [], []
    of = {o: k for k, offsets in C.INDIC_LETTERS.items() for o in offsets}
    for cp in range(0x0900, 0x0D80):
        if letter := of.get((cp - 0x0900) % 0x80):
            source.append(chr(cp))
            target.append(letter)
    for letter, group in C.LATIN_FOLDS.items():
        source += group
        target += letter * len(group)
    return "".join(source), "".join(target)


def transliterated(c: Column) -> Column:
    """Indic letters and accented Latin vowels as one Latin letter each; all else beyond ASCII goes."""
    source, target = _letter_table()
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), source, target), r"[^\x00-\x7F]", "")


def folded(c: Column, ascii_only: bool = False) -> Column:
    return F.lower(raw_text(c)) if ascii_only else nfkc_casefold(raw_text(c))


def normalized_folded(c: Column) -> Column:
    """Of folded text: letters, digits and marks of any script as words, single blanks between."""
    c = F.replace(c, F.lit("&"), F.lit(" and "))
    c = F.regexp_replace(c, "['’`ʼ]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}\p{M}]", " "), " +", " "))


def normalize_text(c: Column, ascii_only: bool = False) -> Column:
    return normalized_folded(folded(c, ascii_only))


def split_words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda t: t != "")


def _replaced(c: Column, table: dict[str, str]) -> Column:
    for old, new in table.items():
        c = F.regexp_replace(c, rf"(?<![^ ]){old}(?![^ ])", new)
    return c


def business_name(normalized: Column) -> Column:
    """Abbreviations written out; legal endings after the first word stripped."""
    return F.regexp_replace(_replaced(normalized, C.NAME_WORDS), rf"(?: (?:{'|'.join(C.LEGAL_ENDINGS)}))+$", "")


def address(normalized: Column) -> Column:
    return _replaced(normalized, C.ADDRESS_WORDS)


def address_parts(c: Column, ascii_only: bool = False) -> dict[str, Column]:
    """postal_code, city, state, street_number and street_tokens of an address; hints, not facts."""
    raw = folded(c, ascii_only)
    found = [F.regexp_extract(raw, p, 1) for p in C.POSTAL]
    postal = F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))
    cut = F.lit(None).cast("string")
    for p, f in reversed(list(zip(C.POSTAL, found, strict=True))):
        cut = F.when(f != "", F.regexp_replace(F.regexp_replace(raw, p, ""), "[ ,]+$", "")).otherwise(cut)
    parts = F.filter(F.transform(F.split(F.coalesce(cut, raw), ","), normalized_folded), lambda x: x != "")
    n = F.size(parts)
    return {
        "postal_code": F.regexp_replace(postal, r"[\s-]", ""),
        "city": F.when(n >= 3, F.get(parts, n - 2)).when(n == 2, F.get(parts, F.lit(1))).otherwise(""),
        "state": F.when(n >= 3, F.get(parts, n - 1)).otherwise(""),
        "street_number": F.regexp_extract(raw, C.STREET_NUMBER, 1),
        "street_tokens": F.array_join(F.filter(split_words(address(normalized_folded(raw))), lambda t: ~t.rlike(r"^\p{Nd}+$")), " "),
    }


def contacts(c: Column) -> dict[str, Column]:
    """The first e-mail address, its domain, the first host, and the first labelled phone number."""
    text = F.coalesce(c, F.lit(""))
    mail = f"(?U){C.EMAIL}"
    domain = F.lower(F.regexp_extract(text, mail, 2))
    url = F.regexp_extract(text, f"(?i){C.LINK}", 0)
    host = F.lower(F.regexp_extract(F.regexp_replace(url, r"(?i)^https?://", ""), r"^(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"[.,;)\"']+$", ""), r"^www\.", "")
    phone = F.trim(F.regexp_extract(text, f"(?i){C.TELEPHONE}", 1))
    digits = F.regexp_replace(phone, r"\D", "")
    return {
        "email": F.when(domain != "", F.concat(F.regexp_extract(text, mail, 1), F.lit("@"), domain)).otherwise(""),
        "email_domain": domain,
        "website_domain": host,
        "phone": F.when(F.length(digits).between(7, 15), F.concat(F.when(phone.startswith("+"), "+").otherwise(""), digits)).otherwise(""),
    }


def informative(c: Column, generic: Iterable[str] = C.GENERIC_NAME, by_bytes: bool = False) -> Column:
    """The distinct words of more than one character (or byte) that are not generic."""
    stop = words_of(generic)
    size = F.octet_length if by_bytes else F.length
    return F.array_distinct(F.filter(split_words(c), lambda t: (size(t) > 1) & ~F.array_contains(stop, t)))


def ngrams(c: Column, n: int) -> Column:
    """The distinct n-grams without blanks; a shorter text is one, an empty one has none."""
    v = F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(""))
    return F.when(v == "", F.array().cast(EMPTY)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(v) - n + 1)), lambda i: F.substring(v, i, F.lit(n)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets (arrays without repeats); 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 where either is empty."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def length_ratio(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)))


def equal(a: Column, b: Column) -> Column:
    """1 where both are given and alike."""
    return ((a != "") & (a == b)).cast("double")


def numbers(c: Column) -> Column:
    """The distinct words that are digits only."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\b\d+\b"), F.lit(0)), lambda x: x != ""))


def hex_number(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("long")


def soundex(c: Column) -> Column:
    """Four characters; any letter without a code, H and W included, parts two equal codes."""
    up = F.upper(c)
    codes = F.translate(F.regexp_replace(up, "[^BFPVCGJKQSXZDTLMNR]", "0"), "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    runs = F.regexp_replace(codes, r"(.)\1+", "$1")
    return F.when(c == "", "").otherwise(F.substring(F.concat(F.substring(up, 1, 1), F.replace(F.substring(runs, 2, 1 << 20), F.lit("0"), F.lit("")), F.lit("0000")), 1, 4))


def skeleton(latin: Column) -> Column:
    """Consonants of romanised text, digraphs merged, repeats collapsed."""
    v = F.lower(latin)
    for old, new in C.DIGRAPHS.items():
        v = F.replace(v, F.lit(old), F.lit(new))
    return F.regexp_replace(F.regexp_replace(v, "[aeiou]", ""), r"(.)\1+", "$1")


def nonlatin(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"[^\x{0000}-\x{024F}]").cast("double")


def acronym_score(a: Column, b: Column) -> Column:
    """1 if one name is the initials of the other, 0.7 if it begins them without stop words."""
    legal = words_of(w for group in C.LEGAL_FORMS.values() for w in group)
    of = lambda c: F.filter(F.regexp_extract_all(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~F.array_contains(legal, w))
    stop = words_of(C.STOPWORDS)

    def one(short: Column, long: Column) -> Column:
        initials = lambda x: F.array_join(F.transform(x, lambda w: F.left(w, F.lit(1))), "")
        whole, bare, target = initials(long), initials(F.filter(long, lambda w: ~F.array_contains(stop, w))), F.get(short, F.lit(0))
        return F.when((F.size(short) == 1) & (F.size(long) >= 2), F.when((target == whole) | (target == bare), 1.0).when(bare.startswith(target), 0.7).otherwise(0.0)).otherwise(0.0)

    return F.greatest(one(of(a), of(b)), one(of(b), of(a)))


def is_acronym(a: Column, b: Column) -> Column:
    """Whether one name is a single word that stands among the initials of the other, generic words left out."""
    stop = words_of(C.GENERIC_EVIDENCE)
    x, y = (F.filter(split_words(c), lambda w: ~F.array_contains(stop, w)) for c in (a, b))
    initials = lambda v: F.array_join(F.transform(v, lambda w: F.left(w, F.lit(1))), "")
    one = lambda short, long: (F.size(short) == 1) & (F.length(F.get(short, F.lit(0))) >= 2) & F.contains(initials(long), F.get(short, F.lit(0)))
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & (one(x, y) | one(y, x)), F.lit(False))


def legal_classes(tokens: Column) -> Column:
    """The classes of legal forms among words."""
    return F.filter(F.array(*[F.when(F.arrays_overlap(tokens, words_of(w)), F.lit(k)) for k, w in C.LEGAL_FORMS.items()]), lambda x: x.isNotNull())


def categories(tokens: Column) -> Column:
    return F.filter(F.array(*[F.when(F.arrays_overlap(tokens, words_of(w)), F.lit(k)) for k, w in C.CATEGORIES.items()]), lambda x: x.isNotNull())


def rules_text(mask: Column) -> Column:
    """Names of the rules in a mask, joined by bars."""
    return F.array_join(F.filter(F.array(*[F.when(mask.bitwiseAND(1 << i) != 0, F.lit(r)) for i, r in enumerate(C.RULES)]), lambda x: x.isNotNull()), "|")


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def sigmoid(z: Column, temperature: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-z / temperature))


def fbeta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    d = beta * beta * precision + recall
    return F.when(d == 0, 0.0).otherwise((1 + beta * beta) * precision * recall / d)
