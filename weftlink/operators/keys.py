"""Blocking keys: each family adds (key, bit) pairs to a record, to be exploded into one long table.

Keys are readable strings, so families cannot collide and results can be checked in SQL;
``hashed`` turns them into 64 bits for storage. Where a family may give more keys than
its slots, those with the least MD5 stay, which is a stable pseudo-random choice.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.functions import constants as C
from weftlink.functions import text as X

BIT = {r: 1 << i for i, r in enumerate(C.RULES)}
BANDS = 8
#: A prime above 28 bits.
PRIME = 268_435_459


def _prefixed(prefix: str, parts: Column, country: Column | None = None) -> Column:
    lead = F.lit(f"{prefix}|") if country is None else F.concat(F.lit(f"{prefix}|"), country, F.lit("|"))
    return F.transform(parts, lambda p: F.concat(lead, p))


def _given(country: Column, keys: Column) -> Column:
    """No keys for records without a country."""
    return F.when(country != "", keys).otherwise(F.array().cast(X.EMPTY))


def first_by_hash(keys: Column, n: int) -> Column:
    few = F.transform(F.slice(F.array_sort(F.transform(keys, lambda k: F.struct(F.md5(k.cast("binary")).alias("h"), k.alias("k")))), 1, n), lambda s: s["k"])
    return F.when(F.size(keys) <= n, keys).otherwise(few)


def _pairs(parts: Column) -> Column:
    """All unordered pairs of a sorted set, joined by a bar."""
    s = F.array_sort(parts)
    return F.flatten(F.transform(s, lambda a: F.transform(F.filter(s, lambda b: a < b), lambda b: F.concat(a, F.lit("|"), b))))


def _product(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, F.lit("|"), b))))


def longest(tokens: Column, n: int) -> Column:
    """The longest in bytes, then the first in order."""
    return F.transform(F.slice(F.array_sort(F.transform(tokens, lambda t: F.struct((-F.octet_length(t)).alias("s"), t.alias("t")))), 1, n), lambda s: s["t"])


def address_words(address: Column) -> Column:
    """Words of three bytes or more that are neither generic nor digits."""
    stop = X.words_of(C.GENERIC_KEY_ADDRESS)
    return F.array_distinct(F.filter(X.split_words(address), lambda t: (F.octet_length(t) >= 3) & ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$")))


def digit_runs(address: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(address, F.lit("[0-9]+"), F.lit(0)), lambda x: x != ""))


def soundexes(name: Column) -> Column:
    stop, generic = X.words_of(C.GENERIC_SOUNDEX), X.words_of(C.GENERIC_KEY_NAME)
    tokens = F.filter(X.split_words(X.transliterated(name)), lambda t: (F.octet_length(t) > 2) & ~F.array_contains(generic, t))
    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens, X.soundex), lambda s: ~F.array_contains(stop, s))))


def minhash_bands(c: Column, field: str) -> Column:
    """Eight bands of two minima each over 4-grams without blanks; none for an empty text.

    The hashes are x + j y modulo a prime, x and y being two parts of the gram's MD5.
    """
    part = lambda h, at: F.conv(F.substring(h, at, 7), 16, 10).cast("long")
    digests = F.transform(X.ngrams(c, 4), lambda g: F.md5(g.cast("binary")))
    grams = F.transform(digests, lambda h: F.struct(part(h, 1).alias("x"), part(h, 9).alias("y")))
    least = lambda j: F.array_min(F.transform(grams, lambda g: (g["x"] + j * g["y"]) % PRIME))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.concat(F.lit(f"L{field}"), b, F.lit("|"), least(2 * b), F.lit("-"), least(2 * b + 1)))
    return F.when(F.size(grams) == 0, F.array().cast(X.EMPTY)).otherwise(bands)


def sized_grams(c: Column) -> Column:
    """The 3-, 4- and 5-grams of a text, each after its size."""
    of = lambda n: F.transform(X.ngrams(c, n), lambda g: F.concat(F.lit(f"{n}:"), g))
    return F.flatten(F.array(of(3), of(4), of(5)))


def memory_families() -> dict[str, Column]:
    """All tokens: (country, word), (country, city, word), (country, postal), 3-5-grams, (country, address word), name."""
    name, country = F.col("name_norm"), F.col("country_norm")
    words = X.informative(name)
    return {
        "country_name": _given(country, _prefixed("T", words, country)),
        "city_name": _given(country, F.when(F.col("city") != "", _prefixed("C", F.transform(words, lambda w: F.concat(F.col("city"), F.lit("|"), w)), country)).otherwise(F.array().cast(X.EMPTY))),
        "postal": _given(country, F.when(F.col("postal_code") != "", _prefixed("P", F.array("postal_code"), country)).otherwise(F.array().cast(X.EMPTY))),
        "name_ngram": _prefixed("G", sized_grams(name)),
        "address": _given(country, _prefixed("A", X.informative(F.col("address_norm"), C.GENERIC_ADDRESS), country)),
        "strong_name": F.when(name != "", _prefixed("N", F.array(name))).otherwise(F.array().cast(X.EMPTY)),
    }


def disk_families(lsh: bool = True) -> dict[str, list[Column]]:
    """The wider set: name, longest words, MinHash bands, postal number, address bag, number with word."""
    name, address, country = F.col("name_norm"), F.col("address_norm"), F.col("country_norm")
    words = longest(X.informative(name, C.GENERIC_KEY_NAME, by_bytes=True), 3)
    digits = F.filter(X.split_words(address), lambda t: t.rlike("^[0-9]+$"))
    postal = F.filter(digits, lambda t: F.octet_length(t).between(4, 10))
    none = F.array().cast(X.EMPTY)
    bands = {"name_ngram": [minhash_bands(name, "n")], "address": [minhash_bands(address, "a")]} if lsh else {"name_ngram": [], "address": []}
    return {
        "strong_name": [F.when(name != "", _prefixed("N", F.array(name))).otherwise(none)],
        "country_name": [_given(country, _prefixed("T", words, country))],
        "name_ngram": bands["name_ngram"],
        "address": [*bands["address"], F.when(address != "", _prefixed("A", F.array(F.array_join(F.array_sort(X.split_words(address)), " ")))).otherwise(none)],
        "postal": [_given(country, F.when(F.size(postal) > 0, _prefixed("P", F.array(F.element_at(postal, -1)), country)).otherwise(none))],
        "name_number": [_given(country, F.when(F.size(digits) > 0, _prefixed("X", F.transform(F.slice(words, 1, 2), lambda w: F.concat(F.get(digits, F.lit(0)), F.lit("|"), w)), country)).otherwise(none))],
    }


def supplement_families() -> dict[str, list[Column]]:
    """Soundex with number, soundex with address word, number with word, word pairs, name pairs; at most 10, 14, 16, 14 and 10."""
    country = F.col("country_norm")
    sx, numbers, words = soundexes(F.col("name_norm")), F.array_sort(digit_runs(F.col("address_norm"))), F.array_sort(address_words(F.col("address_norm")))
    keyed = lambda prefix, parts, n: _given(country, first_by_hash(_prefixed(prefix, parts, country), n))
    return {
        "name_number": [keyed("SXN", _product(sx, numbers), 10)],
        "address_number": [keyed("SXW", _product(sx, words), 14), keyed("AN", _product(numbers, words), 16), keyed("AW2", _pairs(words), 14)],
        "name_pair": [keyed("NP", _pairs(X.informative(F.col("name_norm"), C.GENERIC_KEY_NAME, by_bytes=True)), 10)],
    }


def joined(*sets: dict[str, list[Column]]) -> dict[str, list[Column]]:
    """Families of several sets under their rules."""
    out: dict[str, list[Column]] = {}
    for families in sets:
        for rule, columns in families.items():
            out.setdefault(rule, []).extend(columns)
    return out


def diagnostic_families() -> dict[str, list[Column]]:
    """The wider keys in a readable form without slots: at most six address words and four numbers take part."""
    country, address, name = F.col("country_norm"), F.col("address_norm"), F.col("name_norm")
    generic, stop = X.words_of(C.GENERIC_VETO), X.words_of(C.GENERIC_SOUNDEX)
    tokens = F.filter(X.split_words(X.transliterated(name)), lambda t: (F.length(t) > 2) & ~F.array_contains(generic, t))
    sounds = F.array_sort(F.array_except(F.transform(tokens, X.soundex), stop))
    numbers = F.array_sort(X.numbers(address))
    place = F.filter(X.split_words(address), lambda t: (F.length(t) >= 3) & ~F.array_contains(X.words_of(C.GENERIC_KEY_ADDRESS), t) & ~t.rlike(r"^\d+$"))
    few, own = F.slice(place, 1, 6), lambda prefix, parts: _given(country, _prefixed(prefix, parts, country))
    later = lambda s: F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.greatest(F.size(s), F.lit(1))), lambda b: F.concat(a, F.lit("|"), b))))
    return {
        "name_number": [own("SXN", _product(sounds, numbers))],
        "address_number": [own("SXW", _product(sounds, few)), own("AN", _product(F.slice(numbers, 1, 4), few)), own("AW2", later(place))],
        "name_pair": [own("NP", later(tokens))],
    }


def key_lists(families: dict[str, Column | list[Column]], wanted: Iterable[str] | None = None) -> Column:
    """The distinct keys of a record, as an array of (key, bit)."""
    wanted = set(wanted or families)
    lists = [(BIT[rule], c) for rule, cs in families.items() if rule in wanted for c in (cs if isinstance(cs, list) else [cs])]
    marked = lambda c, b: F.transform(c, lambda k: F.struct(k.alias("key"), F.lit(b).alias("bit")))
    return F.array_distinct(F.flatten(F.array(*[marked(c, b) for b, c in lists])))


def key_table(records: DataFrame, families: dict[str, Column | list[Column]], wanted: Iterable[str] | None = None) -> DataFrame:
    """(entity_id, key, bit), one row for each distinct key of a record."""
    return records.select("entity_id", F.explode(key_lists(families, wanted)).alias("k")).select("entity_id", "k.key", "k.bit")


def hashed(keys: DataFrame) -> DataFrame:
    return keys.withColumn("key", F.xxhash64("key"))
