"""The same queries for DuckDB, built from shared parts."""

from __future__ import annotations

from weftlink.functions import constants as C
from weftlink.functions import text as X
from weftlink.operators.blocking import Retrieval
from weftlink.operators.keys import BANDS, PRIME
from weftlink.plans.binding import LAYERS

_R = Retrieval()


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def norm_folded(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(replace({x}, '&', ' and '), '[''’`ʼ]', '', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', ' ', 'g'), ' +', ' ', 'g'))"


def norm(x: str) -> str:
    return norm_folded(f"lower({x})")


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def mapped(x: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items())
    return f"array_to_string(list_transform({words(x)}, lambda w: CASE w {cases} ELSE w END), ' ')"


def business(x: str) -> str:
    return f"regexp_replace({mapped(norm(x), C.NAME_WORDS)}, '(?: (?:{'|'.join(C.LEGAL_ENDINGS)}))+$', '')"


def informative(x: str, generic, size: str = "length") -> str:
    return f"list_distinct(list_filter({words(x)}, lambda w: {size}(w) > 1 AND NOT list_contains({listed(generic)}, w)))"


def ngrams(x: str, n: int) -> str:
    v = f"replace({x}, ' ', '')"
    return f"CASE WHEN {v} = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, length({v}) - {n} + 1) + 1), lambda i: substr({v}, i, {n}))) END"


def lev(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"


def jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def minus(a: str, b: str) -> str:
    """The members of set ``a`` that ``b`` lacks."""
    return f"list_filter({a}, lambda u: NOT list_contains({b}, u))"


def union(a: str, b: str) -> str:
    return f"list_distinct(list_concat({a}, {b}))"


def lcs(a: str, b: str) -> str:
    """The length of the longest common subsequence; the places of ``a`` are the bits of a number."""
    full = f"((1::HUGEINT << length({a})::INTEGER) - 1)"
    masks = f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = c THEN 1::HUGEINT << (i - 1)::INTEGER ELSE 0::HUGEINT END))::HUGEINT)"
    return f"(length({a}) - bit_count(list_reduce({masks}, lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}, {full})))"


def indel(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 2.0 * {lcs(a, b)} / (length({a}) + length({b})) END)"


def sorted_words(x: str) -> str:
    return f"array_to_string(list_sort({words(x)}), ' ')"


def _parts(a: str, b: str) -> str:
    x, y = f"list_distinct({words(a)})", f"list_distinct({words(b)})"
    joined = lambda v: f"array_to_string(list_sort({v}), ' ')"
    return f"{joined(f'list_intersect({x}, {y})')} AS common, {joined(minus(x, y))} AS rest_a, {joined(minus(y, x))} AS rest_b, len({x}) AS na, len({y}) AS nb"


def token_set(a: str, b: str) -> str:
    side = lambda r: f"(CASE WHEN common = '' OR {r} = '' THEN common || {r} ELSE common || ' ' || {r} END)"
    left, right = "left_side", "right_side"
    return f"""(SELECT CASE WHEN na = 0 OR nb = 0 THEN 0.0 WHEN common <> '' AND (rest_a = '' OR rest_b = '') THEN 1.0 ELSE greatest({indel(left, right)}, CASE WHEN common = '' THEN 0.0 ELSE 2.0 * length(common) / (length(common) + least(length({left}), length({right}))) END) END
    FROM (SELECT *, {side('rest_a')} AS left_side, {side('rest_b')} AS right_side FROM (SELECT {_parts(a, b)})))"""


def token_sort(a: str, b: str) -> str:
    return f"(SELECT {indel('sa', 'sb')} FROM (SELECT {sorted_words(a)} AS sa, {sorted_words(b)} AS sb))"


def partial(a: str, b: str) -> str:
    """The best of the shorter text against windows of the longer."""
    window = "substr(lo, greatest(1, i + 1)::BIGINT, (i + length(sh) - greatest(0, i))::BIGINT)"
    return f"""(SELECT CASE WHEN sh = '' THEN 0.0 ELSE (SELECT max(v) FROM (SELECT {indel('sh', 'win')} AS v FROM (SELECT sh, {window} AS win FROM unnest(range(1 - length(sh), length(lo))) AS u(i)))) END
    FROM (SELECT CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END AS sh, CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END AS lo))"""


def weighted(a: str, b: str) -> str:
    longer = f"(greatest(length({a}), length({b})) / greatest(1, least(length({a}), length({b}))))"
    far = lambda x: f"(CASE WHEN {a} <> '' AND {b} <> '' AND {longer} >= 1.5 THEN {x} ELSE '' END)"
    part = f"(CASE WHEN len(list_intersect({words(a)}, {words(b)})) > 0 THEN 1.0 ELSE {partial(far(sorted_words(a)), far(sorted_words(b)))} END)"
    scale = f"(CASE WHEN {longer} <= 8 THEN 0.9 ELSE 0.6 END)"
    return f"""(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {longer} < 1.5 THEN greatest({indel(a, b)}, 0.95 * greatest({token_sort(a, b)}, {token_set(a, b)}))
    ELSE greatest({indel(a, b)}, {scale} * {partial(far(a), far(b))}, 0.95 * {scale} * {part}) END)"""


def contacts(text: str) -> dict[str, str]:
    """The first e-mail address, its domain, the first host and the first labelled number."""
    w = r"\p{L}\p{M}\p{N}_"
    mail = rf"(?:^|[^{w}.+-])([{w}.!#$%&''*+/=?^`{{|}}~-]+)@([{w}-]+(?:\.[{w}-]+)+)"
    url = f"regexp_extract({text}, '(?i)(?:https?://|www\\.)[^\\s<>|]+', 0)"
    host = f"lower(regexp_extract(regexp_replace({url}, '(?i)^https?://', ''), '^(?:[^/?#@]*@)?([^/?#:]*)', 1))"
    host = f"regexp_replace(regexp_replace({host}, '[.,;)\"'']+$', ''), '^www\\.', '')"
    phone = f"trim(regexp_extract({text}, '(?i){C.TELEPHONE}', 1))"
    digits = f"regexp_replace({phone}, '\\D', '', 'g')"
    return {
        "email": f"CASE WHEN regexp_extract({text}, '{mail}', 2) <> '' THEN regexp_extract({text}, '{mail}', 1) || '@' || lower(regexp_extract({text}, '{mail}', 2)) ELSE '' END",
        "email_domain": f"lower(regexp_extract({text}, '{mail}', 2))",
        "website_domain": host,
        "phone": f"CASE WHEN length({digits}) BETWEEN 7 AND 15 THEN CASE WHEN {phone} LIKE '+%' THEN '+' ELSE '' END || {digits} ELSE '' END",
    }


_CODES = lambda w: f"string_split(translate(regexp_replace(upper({w}), '[^BFPVCGJKQSXZDTLMNR]', '0', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556'), '')"


def soundex(w: str) -> str:
    c = _CODES(w)
    return f"substr(upper(substr({w}, 1, 1)) || array_to_string(list_transform(range(2, len({c}) + 1), lambda i: CASE WHEN ({c})[i] <> ({c})[i - 1] AND ({c})[i] <> '0' THEN ({c})[i] ELSE '' END), '') || '0000', 1, 4)"


def transliterated(x: str) -> str:
    source, target = X._letter_table()
    return f"regexp_replace(translate(coalesce({x}, ''), '{source}', '{target}'), '[^\\x00-\\x7F]', '', 'g')"


def minhash(x: str, field: str) -> str:
    """Band keys of a text; an empty list for an empty one."""
    digest = f"list_transform({ngrams(x, 4)}, lambda g: md5(g))"
    least = lambda j: f"list_min(list_transform(ds, lambda h: (('0x' || substr(h, 1, 7))::BIGINT + ({j}) * ('0x' || substr(h, 9, 7))::BIGINT) % {PRIME}))"
    return f"(SELECT CASE WHEN len(ds) = 0 THEN [] ELSE list_transform(range(0, {BANDS}), lambda b: 'L{field}' || b || '|' || {least('2 * b')} || '-' || {least('2 * b + 1')}) END FROM (SELECT {digest} AS ds))"


POSTAL = "coalesce(" + ", ".join(f"nullif(regexp_extract(low, '{p}', 1), '')" for p in C.POSTAL) + ", '')"
CUT = "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN regexp_replace(regexp_replace(low, '{p}', ''), '[ ,]+$', '')" for p in C.POSTAL) + " ELSE low END"


def _bound() -> str:
    source = "part"
    for layer in LAYERS:
        source = f"(SELECT {', '.join(layer)} FROM {source})"
    return f"bound AS (SELECT * FROM {source})"


RAW = f"{_bound()}, raw AS (SELECT entity_id, business_name, business_address, country FROM bound)"
_CONTACTS = ", ".join(f"{c} AS {k}" for k, c in contacts("(business_name || ' ' || business_address)").items())
REC = f"""{RAW}, low AS (SELECT *, lower(trim(business_address)) AS low FROM raw),
cut AS (SELECT *, {POSTAL} AS postal, list_filter(list_transform(string_split({CUT}, ','), lambda x: {norm('x')}), lambda x: x <> '') AS parts FROM low),
rec AS MATERIALIZED (SELECT entity_id, business_name, business_address, country, {business('business_name')} AS name_norm, {mapped(norm('business_address'), C.ADDRESS_WORDS)} AS address_norm, {norm('country')} AS country_norm,
  regexp_replace(postal, '[\\s-]', '', 'g') AS postal_code, CASE WHEN len(parts) >= 3 THEN parts[len(parts) - 1] WHEN len(parts) = 2 THEN parts[2] ELSE '' END AS city, CASE WHEN len(parts) >= 3 THEN parts[len(parts)] ELSE '' END AS state,
  regexp_extract(low, '{C.STREET_NUMBER}', 1) AS street_number, {_CONTACTS} FROM cut)"""
_GRAMS = " UNION ALL ".join(f"SELECT entity_id, 'G|{n}:' || unnest({ngrams('name_norm', n)}) AS key, 8 AS bit FROM rec" for n in (3, 4, 5))
KEYS = f"""{REC}, keys AS (
  SELECT entity_id, 'T|' || country_norm || '|' || unnest({informative('name_norm', C.GENERIC_NAME)}) AS key, 1 AS bit FROM rec WHERE country_norm <> ''
  UNION ALL SELECT entity_id, 'C|' || country_norm || '|' || city || '|' || unnest({informative('name_norm', C.GENERIC_NAME)}), 2 FROM rec WHERE country_norm <> '' AND city <> ''
  UNION ALL SELECT entity_id, 'P|' || country_norm || '|' || postal_code, 4 FROM rec WHERE country_norm <> '' AND postal_code <> ''
  UNION ALL {_GRAMS}
  UNION ALL SELECT entity_id, 'A|' || country_norm || '|' || unnest({informative('address_norm', C.GENERIC_ADDRESS)}), 16 FROM rec WHERE country_norm <> ''
  UNION ALL SELECT entity_id, 'N|' || name_norm, 32 FROM rec WHERE name_norm <> ''),
ka AS (SELECT * FROM keys WHERE entity_id LIKE 'S1-%'), kall AS MATERIALIZED (SELECT * FROM keys WHERE entity_id NOT LIKE 'S1-%'),
counted AS (SELECT key, count(*) AS n, CASE WHEN key[1] IN ('P', 'N', 'C') THEN {_R.max_posting} ELSE least({_R.max_posting}, greatest({_R.floor}, floor((SELECT count(*) FROM rec WHERE entity_id NOT LIKE 'S1-%') * {_R.max_share}))) END AS bound FROM kall GROUP BY key),
kt AS (SELECT * FROM kall SEMI JOIN (SELECT key FROM counted WHERE n <= bound) USING (key))"""
_SIZED = lambda x: f"list_concat({', '.join(f'list_transform({ngrams(x, n)}, lambda g: {n} || g)' for n in (3, 4, 5))})"
PAIRS = f"""{KEYS}, met AS (SELECT ka.entity_id AS anchor_id, kt.entity_id AS target_id, coalesce(bit_or(CASE WHEN kt.bit NOT IN (8, 16) THEN kt.bit END), 0) AS mask0, count(*) FILTER (kt.bit = 16) AS n_address, count(*) FILTER (kt.bit = 8) AS n_grams FROM ka JOIN kt USING (key) GROUP BY 1, 2),
near AS (SELECT anchor_id, target_id, {jac('ga', 'gt')} AS j, {indel('na', 'nt')} AS r FROM (SELECT anchor_id, target_id, a.name_norm AS na, t.name_norm AS nt, {_SIZED('a.name_norm')} AS ga, {_SIZED('t.name_norm')} AS gt FROM met JOIN rec a ON a.entity_id = anchor_id JOIN rec t ON t.entity_id = target_id WHERE n_grams >= {_R.gram_overlap})),
pairs AS MATERIALIZED (SELECT * FROM (SELECT anchor_id, target_id, mask0 | CASE WHEN n_address >= {_R.address_overlap} THEN 16 ELSE 0 END | CASE WHEN j >= {_R.gram_jaccard} THEN 8 ELSE 0 END | CASE WHEN r >= {_R.strong_ratio} THEN 32 ELSE 0 END AS mask FROM met LEFT JOIN near USING (anchor_id, target_id)) WHERE mask <> 0)"""
TRUTH = """truth AS (SELECT firm_id AS anchor_id, entity_id AS target_id FROM bound WHERE kind = 'same'),
anchors AS (SELECT entity_id AS anchor_id FROM raw WHERE entity_id LIKE 'S1-%')"""
SIDES = "JOIN rec a ON a.entity_id = pairs.anchor_id JOIN rec t ON t.entity_id = pairs.target_id"
SCORED = f"""{PAIRS}, {TRUTH}, scored AS MATERIALIZED (SELECT anchor_id, target_id, mask, round(0.6 * ({lev('a.name_norm', 't.name_norm')}) + 0.3 * ({lev('a.address_norm', 't.address_norm')}) + 0.1 * (a.country_norm = t.country_norm)::DOUBLE, 6) AS p, 'S' || substr(target_id, 2, 1) AS source FROM pairs {SIDES})"""
LABELLED = f"{SCORED}, labelled AS (SELECT s.*, CASE WHEN x.anchor_id IS NULL THEN 0 ELSE 1 END AS label FROM scored s LEFT JOIN truth x USING (anchor_id, target_id))"

RULES_TEXT = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN mask & {1 << i} <> 0 THEN '{r}' END" for i, r in enumerate(C.RULES)) + "], lambda x: x IS NOT NULL), '|')"
_LONGEST = f"list_slice(list_transform(list_sort(list_transform({informative('name_norm', C.GENERIC_KEY_NAME, 'strlen')}, lambda w: {{'s': -strlen(w), 't': w}})), lambda x: x.t), 1, 3)"
_DIGITS = f"list_filter({words('address_norm')}, lambda w: regexp_matches(w, '^[0-9]+$'))"
DISK = f"""dx AS (SELECT *, {_LONGEST} AS w3, {_DIGITS} AS ds, list_filter({_DIGITS}, lambda w: strlen(w) BETWEEN 4 AND 10) AS ps FROM rec),
dk AS (SELECT DISTINCT * FROM (SELECT entity_id, 'N|' || name_norm AS key, 32 AS bit FROM dx WHERE name_norm <> ''
  UNION ALL SELECT entity_id, 'T|' || country_norm || '|' || unnest(w3), 1 FROM dx WHERE country_norm <> ''
  UNION ALL SELECT entity_id, unnest({minhash('name_norm', 'n')}), 8 FROM dx
  UNION ALL SELECT entity_id, unnest({minhash('address_norm', 'a')}), 16 FROM dx
  UNION ALL SELECT entity_id, 'A|' || {sorted_words('address_norm')}, 16 FROM dx WHERE address_norm <> ''
  UNION ALL SELECT entity_id, 'P|' || country_norm || '|' || ps[-1], 4 FROM dx WHERE country_norm <> '' AND len(ps) > 0
  UNION ALL SELECT entity_id, 'X|' || country_norm || '|' || ds[1] || '|' || unnest(list_slice(w3, 1, 2)), 64 FROM dx WHERE country_norm <> '' AND len(ds) > 0))"""
_SOUNDS = f"list_sort(list_filter(list_distinct(list_transform(list_filter({words('name_norm')}, lambda w: strlen(w) > 2 AND NOT list_contains({listed(C.GENERIC_KEY_NAME)}, w)), lambda w: {soundex('w')})), lambda c: NOT list_contains({listed(C.GENERIC_SOUNDEX)}, c)))"
PLACE_WORDS = f"list_sort(list_distinct(list_filter({words('address_norm')}, lambda w: strlen(w) >= 3 AND NOT list_contains({listed(C.GENERIC_KEY_ADDRESS)}, w) AND NOT regexp_matches(w, '^[0-9]+$'))))"


def _product(x: str, y: str) -> str:
    return f"flatten(list_transform({x}, lambda a: list_transform({y}, lambda b: a || '|' || b)))"


def _pairs(x: str) -> str:
    return f"flatten(list_transform({x}, lambda a: list_transform(list_filter({x}, lambda b: b > a), lambda b: a || '|' || b)))"


def _slots(prefix: str, keys: str, n: int) -> str:
    whole = f"list_transform({keys}, lambda k: '{prefix}|' || country_norm || '|' || k)"
    return f"unnest(list_slice(list_transform(list_sort(list_transform({whole}, lambda k: {{'h': md5(k), 'k': k}})), lambda x: x.k), 1, {n}))"


SUPPLEMENT = f"""sx AS (SELECT *, {_SOUNDS} AS ss, list_sort(list_distinct(regexp_extract_all(address_norm, '[0-9]+'))) AS ns, {PLACE_WORDS} AS ws, list_sort({informative('name_norm', C.GENERIC_KEY_NAME, 'strlen')}) AS nw FROM rec WHERE country_norm <> ''),
sk AS (SELECT DISTINCT * FROM (SELECT entity_id, {_slots('SXN', _product('ss', 'ns'), 10)} AS key, 64 AS bit FROM sx
  UNION ALL SELECT entity_id, {_slots('SXW', _product('ss', 'ws'), 14)}, 128 FROM sx
  UNION ALL SELECT entity_id, {_slots('AN', _product('ns', 'ws'), 16)}, 128 FROM sx
  UNION ALL SELECT entity_id, {_slots('AW2', _pairs('ws'), 14)}, 128 FROM sx
  UNION ALL SELECT entity_id, {_slots('NP', _pairs('nw'), 10)}, 256 FROM sx))"""
WIDE = f"""{REC}, {DISK}, {SUPPLEMENT}, wk AS MATERIALIZED (SELECT * FROM dk UNION ALL SELECT * FROM sk),
wn AS (SELECT key FROM wk WHERE entity_id NOT LIKE 'S1-%' GROUP BY key HAVING count(*) <= CASE WHEN key LIKE 'N|%' OR key LIKE 'A|%' THEN 1200 ELSE 240 END),
wide AS (SELECT a.entity_id AS anchor_id, t.entity_id AS target_id, bit_or(t.bit) AS mask FROM wk a JOIN wk t USING (key) SEMI JOIN wn USING (key) WHERE a.entity_id LIKE 'S1-%' AND t.entity_id NOT LIKE 'S1-%' GROUP BY 1, 2)"""
NUMBERS = lambda c: f"list_distinct(regexp_extract_all({c}, '\\b\\d+\\b'))"


def draw(key: str, seed: int) -> str:
    return f"('0x' || substr(md5({key} || '|{seed}'), 1, 8))::BIGINT / 4294967296.0"
