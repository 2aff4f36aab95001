"""Registered queries: every operator applied to the driver's tables, and its DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions import constants as C
from weftlink.functions import text as X
from weftlink.functions.fuzzy import similarity
from weftlink.operators import blocking, decide, keys, metrics, pairwise, quality, splits
from weftlink.operators import features as feat
from weftlink.plans import binding as B
from weftlink.plans import sql as S
from weftlink.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _rounded(features: dict) -> list:
    return [F.round(c, 6).alias(k) for k, c in features.items()]


# --- scalar functions and projections


@query(f"WITH {S.REC} SELECT entity_id, name_norm, address_norm, country_norm FROM rec")
def norm_records(spark, sf):
    return B.records(spark, sf).select("entity_id", "name_norm", "address_norm", "country_norm")


@query(f"WITH {S.REC} SELECT entity_id, postal_code, city, state, street_number FROM rec")
def address_components(spark, sf):
    return B.records(spark, sf).select("entity_id", "postal_code", "city", "state", "street_number")


MAIL = r"([A-Za-z0-9_.!#$%&*+/=?^`{|}~-]+)@([A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+)"


@query(
    """SELECT page_id, CASE WHEN h LIKE 'www.%' THEN substr(h, 5) ELSE h END AS website_domain FROM (
    SELECT page_id, lower(regexp_extract(regexp_replace(regexp_extract(url, '(?i)(?:https?://|www\\.)[^\\s<>|]+', 0), '(?i)^https?://', ''), '^(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h FROM pages)"""
)
def url_domain_pages(spark, sf):
    p = B.table(spark, sf, "pages")
    return p.select("page_id", X.contacts(F.col("url"))["website_domain"].alias("website_domain"))


@query("SELECT doc_id, " + ", ".join(f"{c} AS {k}" for k, c in S.contacts("coalesce(text, '')").items()) + " FROM documents")
def contacts_documents(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", *[c.alias(k) for k, c in X.contacts(F.col("text")).items()])


@query(f"WITH {S.REC} SELECT entity_id, array_to_string(list_sort({S.informative('name_norm', C.GENERIC_NAME)}), ' ') AS name_words, array_to_string(list_sort({S.informative('address_norm', C.GENERIC_ADDRESS)}), ' ') AS address_words FROM rec")
def token_stop_filter(spark, sf):
    words = lambda c, g: F.array_join(F.array_sort(X.informative(F.col(c), g)), " ")
    return B.records(spark, sf).select("entity_id", words("name_norm", C.GENERIC_NAME).alias("name_words"), words("address_norm", C.GENERIC_ADDRESS).alias("address_words"))


@query(f"WITH {S.REC} SELECT entity_id, len({S.ngrams('name_norm', 3)}) AS n3, len({S.ngrams('name_norm', 4)}) AS n4, array_to_string(list_sort({S.ngrams('name_norm', 5)}), ' ') AS g5 FROM rec")
def ngram_sets(spark, sf):
    g = lambda n: X.ngrams(F.col("name_norm"), n)
    return B.records(spark, sf).select("entity_id", F.size(g(3)).cast("long").alias("n3"), F.size(g(4)).cast("long").alias("n4"), F.array_join(F.array_sort(g(5)), " ").alias("g5"))


@query(f"WITH {S.REC} SELECT entity_id, length(name_norm) AS n_name, strlen(address_norm) AS n_bytes FROM rec")
def name_lengths(spark, sf):
    return B.records(spark, sf).select("entity_id", F.length("name_norm").cast("long").alias("n_name"), F.octet_length("address_norm").cast("long").alias("n_bytes"))


@query(f"WITH {S.REC}, w AS (SELECT DISTINCT unnest({S.words('name_norm')}) AS word FROM rec) SELECT word, {S.soundex('word')} AS soundex FROM w")
def soundex_words(spark, sf):
    w = B.records(spark, sf).select(F.explode(X.split_words(F.col("name_norm"))).alias("word")).distinct()
    return w.select("word", X.soundex(F.col("word")).alias("soundex"))


@query(f"SELECT doc_id, length({S.transliterated('text')})::INTEGER AS n_latin, regexp_matches(coalesce(text, ''), '[^\\x{{0000}}-\\x{{024F}}]')::DOUBLE AS nonlatin FROM documents")
def transliterated_documents(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", F.length(X.transliterated(F.col("text"))).alias("n_latin"), X.nonlatin(F.col("text")).alias("nonlatin"))


_FOLDED = "replace(lower(coalesce(text, '')), 'ß', 'ss')"


@query(f"SELECT doc_id, sha256(strip_accents({_FOLDED})) AS folded_sha, sha256({S.norm_folded(f'nfc_normalize({_FOLDED})')}) AS normalized_sha FROM documents")
def folded_documents(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(X.fold_accents(F.col("text")), 256).alias("folded_sha"), F.sha2(X.normalize_text(F.col("text")), 256).alias("normalized_sha"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS n_numbers, regexp_matches(text, '[^\\x00-\\x7F]') AS non_ascii, regexp_matches(text, '[A-Z]') AS uppercase, length(trim(text)) < 3 AS near_empty FROM documents")
def text_predicates(spark, sf):
    t = F.col("text")
    return B.table(spark, sf, "documents").select("doc_id", F.size(keys.digit_runs(t)).cast("long").alias("n_numbers"), t.rlike(r"[^\x00-\x7F]").alias("non_ascii"), t.rlike("[A-Z]").alias("uppercase"), (F.length(F.trim(t)) < 3).alias("near_empty"))


# --- keys, posting limits and joins


@query(f"WITH {S.KEYS} SELECT key, bit, count(*) AS n FROM keys GROUP BY ALL")
def memory_keys(spark, sf):
    return keys.key_table(B.records(spark, sf), keys.memory_families()).groupBy("key", "bit").agg(F.count("*").alias("n"))


_WORDS = S.PLACE_WORDS


@query(f"WITH {S.REC}, x AS (SELECT entity_id, country_norm AS c, list_distinct(regexp_extract_all(address_norm, '[0-9]+')) AS nums, {_WORDS} AS ws FROM rec WHERE country_norm <> ''), n AS (SELECT entity_id, c, ws, unnest(nums) AS num FROM x) SELECT entity_id, 'AN|' || c || '|' || num || '|' || unnest(ws) AS key FROM n")
def keys_number_word(spark, sf):
    r = B.records(spark, sf)
    k = keys._given(F.col("country_norm"), keys._prefixed("AN", keys._product(keys.digit_runs(F.col("address_norm")), keys.address_words(F.col("address_norm"))), F.col("country_norm")))
    return r.select("entity_id", F.explode(k).alias("key"))


@query(f"WITH {S.REC}, x AS (SELECT entity_id, country_norm AS c, {_WORDS} AS ws FROM rec WHERE country_norm <> ''), n AS (SELECT entity_id, c, ws, unnest(ws) AS a FROM x) SELECT entity_id, 'AW2|' || c || '|' || a || '|' || unnest(list_filter(ws, lambda b: b > a)) AS key FROM n")
def keys_word_pairs(spark, sf):
    r = B.records(spark, sf)
    k = keys._given(F.col("country_norm"), keys._prefixed("AW2", keys._pairs(keys.address_words(F.col("address_norm"))), F.col("country_norm")))
    return r.select("entity_id", F.explode(k).alias("key"))


@query(f"WITH {S.REC} SELECT entity_id, 'A|' || array_to_string(list_sort({S.words('address_norm')}), ' ') AS key FROM rec WHERE address_norm <> ''")
def keys_address_bag(spark, sf):
    r = B.records(spark, sf)
    return r.where("address_norm <> ''").select("entity_id", F.explode(keys.disk_families(lsh=False)["address"][0]).alias("key"))


@query(f"WITH {S.REC}, {S.DISK} SELECT entity_id, key, bit FROM dk")
def disk_keys(spark, sf):
    return keys.key_table(B.records(spark, sf), keys.disk_families())


@query(f"WITH {S.REC}, {S.SUPPLEMENT} SELECT entity_id, key, bit FROM sk")
def supplement_keys(spark, sf):
    return keys.key_table(B.records(spark, sf), keys.supplement_families())


_SET = lambda x, cap=None: x if cap is None else f"list_slice({x}, 1, {cap})"
_DIAGNOSTIC = f"""d AS (SELECT entity_id, country_norm AS c, list_filter({S.words('name_norm')}, lambda w: length(w) > 2 AND NOT list_contains({S.listed(C.GENERIC_VETO)}, w)) AS nw, list_sort({S.NUMBERS('address_norm')}) AS ns, list_filter({S.words('address_norm')}, lambda w: length(w) >= 3 AND NOT list_contains({S.listed(C.GENERIC_KEY_ADDRESS)}, w) AND NOT regexp_matches(w, '^[0-9]+$')) AS ws FROM rec WHERE country_norm <> ''),
e AS (SELECT *, list_filter(list_distinct(list_transform(nw, lambda w: {S.soundex('w')})), lambda x: NOT list_contains({S.listed(C.GENERIC_SOUNDEX)}, x)) AS ss FROM d)"""
_LATER = lambda x: f"flatten(list_transform(range(1, len({x}) + 1), lambda i: list_transform({x}[i + 1:], lambda b: {x}[i] || '|' || b)))"
_KEYED = lambda prefix, parts, bit: f"SELECT entity_id, unnest(list_transform({parts}, lambda k: '{prefix}|' || c || '|' || k)) AS key, {bit} AS bit FROM e"


@query(f"WITH {S.REC}, {_DIAGNOSTIC} SELECT DISTINCT * FROM ({_KEYED('SXN', S._product('ss', 'ns'), 64)} UNION ALL {_KEYED('SXW', S._product('ss', 'ws[1:6]'), 128)} UNION ALL {_KEYED('AN', S._product('ns[1:4]', 'ws[1:6]'), 128)} UNION ALL {_KEYED('AW2', _LATER('ws'), 128)} UNION ALL {_KEYED('NP', _LATER('nw'), 256)})")
def diagnostic_keys(spark, sf):
    return keys.key_table(B.records(spark, sf), keys.diagnostic_families())


@query(f"WITH {S.KEYS} SELECT key, n FROM counted WHERE n > bound")
def frequent_keys(spark, sf):
    n = B.n_targets(spark, sf)
    r = blocking.Retrieval()
    bound = F.when(F.substring("key", 1, 1).isin("P", "N", "C"), r.max_posting).otherwise(blocking.generic_limit(n, r.max_posting, r.floor, r.max_share))
    return blocking.frequent_keys(keys.key_table(B.sides(spark, sf)[1], keys.memory_families()), bound)


@query(f"WITH {S.KEYS} SELECT entity_id, key, bit FROM kt")
def posting_suppression(spark, sf):
    return B.key_tables(spark, sf)[1].select("entity_id", "key", "bit")


@query(f"WITH {S.PAIRS} SELECT anchor_id, target_id, mask FROM pairs")
def blocking_union_mask(spark, sf):
    return B.retrieved(spark, sf)


@query(f"WITH {S.WIDE} SELECT anchor_id, target_id, mask, {S.RULES_TEXT} AS blocking_rules FROM wide")
def disk_candidates(spark, sf):
    from weftlink.plans import linkage

    return blocking.with_rules(linkage.retrieve(*B.sides(spark, sf), linkage.Settings()))


@query(f"WITH {S.WIDE} SELECT target_id AS entity_id, count(*) AS n_anchors, max(name_norm) AS name_norm FROM wide JOIN rec ON entity_id = target_id GROUP BY 1")
def store_candidates(spark, sf):
    """Both sides from one store: keys meet bucket by bucket, records are looked up by id."""
    from weftlink.operators import store
    from weftlink.plans import linkage

    s = linkage.Settings()
    kept = store.build(B.records(spark, sf), keys.joined(keys.disk_families(), keys.supplement_families()))
    limited = blocking.limited(kept.keys(spark, anchors=False), s.limit, {p: s.wide * s.limit for p in "NA"})
    counts = blocking.candidates(kept.keys(spark, anchors=True), limited).groupBy(F.col("target_id").alias("entity_id")).agg(F.count("*").alias("n_anchors"))
    return kept.lookup(spark, counts).join(counts, "entity_id").select("entity_id", "n_anchors", "name_norm")


@query(f"WITH {S.KEYS} SELECT ka.entity_id AS anchor_id, kt.entity_id AS target_id, count(*) AS shared FROM ka JOIN kt USING (key) WHERE key LIKE 'A|%' GROUP BY 1, 2 HAVING count(*) >= 2")
def address_overlap_join(spark, sf):
    ka, kt = B.key_tables(spark, sf)
    own = F.col("key").startswith("A|")
    return blocking.overlap_join(ka.where(own), kt.where(own), 2)


@query(f"WITH {S.REC} SELECT a.entity_id AS anchor_id, t.entity_id AS target_id FROM rec a JOIN rec t USING (name_norm) WHERE a.entity_id LIKE 'S1-%' AND t.entity_id NOT LIKE 'S1-%' AND name_norm <> ''")
def exact_name_join(spark, sf):
    return blocking.exact_name_join(*B.sides(spark, sf))


@query(
    f"""WITH {S.KEYS}, s AS (SELECT entity_id, list(key) AS grams FROM keys WHERE bit = 8 GROUP BY 1), c AS (SELECT a.entity_id AS anchor_id, kt.entity_id AS target_id, count(*) AS shared FROM ka a JOIN kt USING (key) WHERE a.bit = 8 GROUP BY 1, 2 HAVING count(*) >= 3),
    j AS (SELECT anchor_id, target_id, shared, {S.jac('x.grams', 'y.grams')} AS jaccard FROM c JOIN s x ON x.entity_id = anchor_id JOIN s y ON y.entity_id = target_id)
    SELECT anchor_id, target_id, shared, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.12"""
)
def ngram_join(spark, sf):
    a, t = (x.withColumn("grams", keys.sized_grams(F.col("name_norm"))) for x in B.sides(spark, sf))
    ka, kt = (x.where(F.col("key").startswith("G|")) for x in B.key_tables(spark, sf))
    return blocking.ngram_join(a, t, ka, kt).select("anchor_id", "target_id", "shared", F.round("jaccard", 6).alias("jaccard"))


@query(f"WITH {S.REC}, a AS (SELECT country_norm, count(*) AS n FROM rec WHERE entity_id LIKE 'S1-%' AND country_norm <> '' GROUP BY 1), t AS (SELECT country_norm, count(*) AS m FROM rec WHERE entity_id NOT LIKE 'S1-%' AND country_norm <> '' GROUP BY 1) SELECT coalesce(sum(n * m), 0)::BIGINT AS n_pairs FROM a JOIN t USING (country_norm)")
def country_only_analytic(spark, sf):
    return blocking.country_only_pairs(*B.sides(spark, sf))


_BITS = " UNION ALL ".join(f"SELECT '{r}' AS rule, label FROM labelled WHERE mask & {1 << i} <> 0" for i, r in enumerate(C.RULES))


@query(f"WITH {S.LABELLED} SELECT rule, count(*) AS n_pairs, sum(label)::BIGINT AS n_true FROM ({_BITS} UNION ALL SELECT 'combined', label FROM labelled) GROUP BY rule")
def blocking_rule_report(spark, sf):
    return blocking.rule_report(B.found(spark, sf), B.truth(spark, sf))


@query(
    f"""WITH {S.SCORED}, c AS (SELECT count(*) AS n, (SELECT count(*) FROM anchors) AS na, (SELECT count(DISTINCT anchor_id) FROM pairs) AS nz, (SELECT count(*) FROM truth) AS nt, (SELECT count(*) FROM truth SEMI JOIN pairs USING (anchor_id, target_id)) AS f, (SELECT count(*) FROM rec WHERE entity_id NOT LIKE 'S1-%') AS m FROM pairs)
    SELECT n AS n_pairs, round(CASE WHEN nt = 0 THEN 1.0 ELSE f / nt END, 6) AS recall, round(n / na, 6) AS mean_candidates, round(1 - n / (na * m), 6) AS reduction, round((na - nz) / na, 6) AS zero_share FROM c"""
)
def candidate_report(spark, sf):
    n = B.n_targets(spark, sf)
    return blocking.candidate_report(B.pairs(spark, sf), B.truth(spark, sf), B.anchors(spark, sf), n)


@query(f"WITH {S.SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY p DESC, target_id) AS place FROM scored) SELECT anchor_id, target_id, p, place::INTEGER AS place FROM r WHERE place <= 8")
def topk_candidates(spark, sf):
    return blocking.top_k(B.scored(spark, sf), "p", 8).select("anchor_id", "target_id", "p", "place")


_KS = (8, 16, 32, 64, 128)


@query(f"WITH {S.SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY p DESC, target_id) AS place FROM scored), t AS (SELECT place FROM truth LEFT JOIN r USING (anchor_id, target_id)) SELECT k::INTEGER AS k, count(*) FILTER (place <= k) AS found, round(count(*) FILTER (place <= k) / nullif(count(*), 0), 6) AS recall FROM t, unnest({list(_KS)}) AS u(k) GROUP BY k")
def topk_recall_curve(spark, sf):
    return blocking.top_k_recall(B.scored(spark, sf), B.truth(spark, sf), "p", _KS)


@query(
    f"""WITH {S.SCORED}, o AS (SELECT *, mask & 16 <> 0 AS own, p + CASE WHEN mask & 16 <> 0 THEN 0.1 ELSE 0.0 END AS s FROM scored), k AS (SELECT *, own AND row_number() OVER (PARTITION BY anchor_id, own ORDER BY s DESC, target_id) <= 2 AS kept FROM o),
    r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY kept DESC, s DESC, target_id) AS place FROM k) SELECT anchor_id, target_id, mask, p, source, place::INTEGER AS place FROM r WHERE place <= 8"""
)
def reserved_topk(spark, sf):
    return blocking.reserved_top_k(B.scored(spark, sf), "p", 8, "address", 2, 0.1).select("anchor_id", "target_id", "mask", "p", "source", "place")


@query(
    f"""WITH {S.SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY p DESC, target_id) AS place FROM scored), x AS (SELECT r.*, place <= 8 AS k, t.anchor_id IS NOT NULL AS y FROM r LEFT JOIN truth t USING (anchor_id, target_id)),
    e AS (SELECT unnest(list_append(string_split({S.RULES_TEXT}, '|'), 'all')) AS rule, k, y FROM x), n AS (SELECT anchor_id, count(place) AS r, count(*) FILTER (place <= 8) AS k FROM anchors LEFT JOIN r USING (anchor_id) GROUP BY 1)
    SELECT 'raw' AS scope, rule, count(*) AS n, count(*) FILTER (y) AS n_true FROM e GROUP BY rule UNION ALL SELECT 'retained', rule, count(*) FILTER (k), count(*) FILTER (k AND y) FROM e GROUP BY rule
    UNION ALL SELECT 'anchors', rule, v, 0 FROM (SELECT count(*) AS anchors, count(*) FILTER (k = 0) AS "no candidate", count(*) FILTER (k = 1) AS "one candidate", count(*) FILTER (k > 1) AS "several candidates", count(*) FILTER (r > k) AS "cut by the cap", max(r) AS "most raw candidates", max(k) AS "most candidates" FROM n) UNPIVOT (v FOR rule IN (*))"""
)
def retrieval_audit(spark, sf):
    s = B.scored(spark, sf)
    return blocking.retrieval_audit(s, blocking.top_k(s, "p", 8), B.truth(spark, sf), B.anchors(spark, sf))


@query(f"WITH {S.SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY p DESC, target_id) AS place FROM scored) SELECT anchor_id, target_id, place::INTEGER AS place FROM truth JOIN r USING (anchor_id, target_id) WHERE place > 4")
def dropped_rank_positions(spark, sf):
    return blocking.rank_positions(B.scored(spark, sf), B.truth(spark, sf), "p", 4)


@query(
    f"""WITH {S.SCORED}, m AS (SELECT anchor_id, target_id FROM truth ANTI JOIN pairs USING (anchor_id, target_id)), f AS (SELECT len(list_intersect({S.words('a.name_norm')}, {S.words('t.name_norm')})) > 0 AS name_word, len(list_intersect(regexp_extract_all(a.address_norm, '[0-9]+'), regexp_extract_all(t.address_norm, '[0-9]+'))) > 0 AS number FROM m JOIN rec a ON a.entity_id = anchor_id JOIN rec t ON t.entity_id = target_id)
    SELECT channel, count(*) AS n FROM (SELECT 'name_word' AS channel FROM f WHERE name_word UNION ALL SELECT 'number' FROM f WHERE number UNION ALL SELECT 'any' FROM f WHERE name_word OR number UNION ALL SELECT 'none' FROM f WHERE NOT name_word AND NOT number) GROUP BY 1"""
)
def channel_what_if(spark, sf):
    channels = {"name_word": X.split_words(F.col("name_norm")), "number": keys.digit_runs(F.col("address_norm"))}
    return blocking.channel_what_if(blocking.missed_pairs(B.found(spark, sf), B.truth(spark, sf)), *B.sides(spark, sf), channels)


_PLACE = lambda s: f"list_filter({S.words(f'{s}.address_norm')}, lambda w: length(w) >= 3 AND NOT list_contains({S.listed(C.GENERIC_KEY_ADDRESS)}, w) AND NOT regexp_matches(w, '^[0-9]+$'))"
_SOUND = lambda s: f"list_filter(list_transform(list_filter({S.words(f'{s}.name_norm')}, lambda w: length(w) > 2 AND NOT list_contains({S.listed(C.GENERIC_VETO)}, w)), lambda w: {S.soundex('w')}), lambda x: NOT list_contains({S.listed(C.GENERIC_SOUNDEX)}, x))"


@query(
    f"""WITH {S.SCORED}, m AS (SELECT anchor_id, target_id FROM truth ANTI JOIN pairs USING (anchor_id, target_id)), f AS (SELECT len(list_intersect({_SOUND('a')}, {_SOUND('t')})) AS s, len(list_intersect({S.NUMBERS('a.address_norm')}, {S.NUMBERS('t.address_norm')})) AS n, len(list_intersect({_PLACE('a')}, {_PLACE('t')})) AS w, a.country_norm = t.country_norm AS c FROM m JOIN rec a ON a.entity_id = anchor_id JOIN rec t ON t.entity_id = target_id),
    g AS (SELECT s > 0 AND (n > 0 OR w > 0) AS one, c AND ((n > 0 AND w > 0) OR w >= 2) AS two FROM f) SELECT channel, v AS n FROM (SELECT count(*) FILTER (one) AS phonetic, count(*) FILTER (two) AS relaxed_address, count(*) FILTER (one OR two) AS either, count(*) AS missed FROM g) UNPIVOT (v FOR channel IN (*))"""
)
def location_channels(spark, sf):
    return blocking.location_channels(blocking.missed_pairs(B.pairs(spark, sf), B.truth(spark, sf)), *B.sides(spark, sf))


@query(f"WITH {S.SCORED} SELECT anchor_id, target_id FROM truth ANTI JOIN pairs USING (anchor_id, target_id)")
def missed_pairs(spark, sf):
    return blocking.missed_pairs(B.pairs(spark, sf), B.truth(spark, sf))


@query(f"WITH {S.SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY p DESC, target_id) AS place FROM scored) SELECT CASE WHEN place <= 4 THEN 'retained' WHEN place IS NOT NULL THEN 'capped' ELSE 'never' END AS state, count(*) AS n FROM truth LEFT JOIN r USING (anchor_id, target_id) GROUP BY 1")
def gap_diagnosis(spark, sf):
    s = B.scored(spark, sf)
    return blocking.gap(s, blocking.top_k(s, "p", 4), B.truth(spark, sf))


@query(
    f"""WITH {S.SCORED}, named AS (SELECT entity_id AS target_id, name_norm, country_norm FROM rec WHERE entity_id NOT LIKE 'S1-%' AND name_norm <> ''), few AS (SELECT name_norm, country_norm FROM named GROUP BY ALL HAVING count(*) <= 20),
    sure AS (SELECT DISTINCT anchor_id, name_norm, country_norm FROM scored JOIN named USING (target_id) WHERE p >= 0.6)
    SELECT DISTINCT anchor_id, target_id FROM sure JOIN few USING (name_norm, country_norm) JOIN named USING (name_norm, country_norm) ANTI JOIN scored USING (anchor_id, target_id)"""
)
def alias_expansion(spark, sf):
    return blocking.alias_pairs(B.scored_by_place(spark, sf), B.sides(spark, sf)[1], threshold=0.6)


@query("WITH d AS (SELECT doc_id, md5(text) AS h, lang FROM documents) SELECT l.doc_id AS left_id, min(r.doc_id) AS right_id, count(*) AS n_right FROM d l JOIN d r USING (h, lang) WHERE l.doc_id % 2 = 0 AND r.doc_id % 2 = 1 GROUP BY 1")
def train_test_overlap(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("entity_id"), F.md5(F.col("text").cast("binary")).alias("name_norm"), F.lit("").alias("address_norm"), F.col("lang").alias("country_norm"))
    return blocking.overlap(d.where("entity_id % 2 = 0"), d.where("entity_id % 2 = 1"))


# --- features


def _gathered(spark, sf):
    return feat.gathered(B.pairs(spark, sf), *B.sides(spark, sf))


def _sql_text(prefix: str, raw: str) -> str:
    a, t = f"a.{prefix}_norm", f"t.{prefix}_norm"
    wa, wt = f"list_distinct({S.words(a)})", f"list_distinct({S.words(t)})"
    return f"""(a.{raw} <> '' AND a.{raw} = t.{raw})::DOUBLE AS {prefix}_exact, ({a} <> '' AND {a} = {t})::DOUBLE AS {prefix}_normalized_exact, round({S.lev(a, t)}, 6) AS {prefix}_levenshtein_similarity, round({S.jac(wa, wt)}, 6) AS {prefix}_jaccard_similarity,
    len(list_intersect({wa}, {wt}))::DOUBLE AS {prefix}_token_overlap, abs(length({a}) - length({t}))::DOUBLE AS {prefix}_length_difference, round(CASE WHEN {a} = '' OR {t} = '' THEN 0.0 ELSE least(length({a}), length({t})) / greatest(length({a}), length({t})) END, 6) AS {prefix}_length_ratio, ({a} = '')::DOUBLE AS {prefix}_left_missing, ({t} = '')::DOUBLE AS {prefix}_right_missing"""


@query(f"WITH {S.PAIRS} SELECT anchor_id, target_id, {_sql_text('name', 'business_name')}, {_sql_text('address', 'business_address')} FROM pairs {S.SIDES}")
def base_features(spark, sf):
    fields = ("business_name", "business_address", "address_norm")
    return B.measured(spark, sf, pairwise.text_features, fields, tuple(feat.text_features())).drop("mask")


_COMPONENTS = ", ".join(f"(a.{f} <> '' AND a.{f} = t.{f})::DOUBLE AS {n}_match, (a.{f} <> '' AND t.{f} <> '')::DOUBLE AS {n}_both_present" for n, f in (("postal_code", "postal_code"), ("city", "city"), ("state", "state"), ("street_number", "street_number"), ("country", "country_norm")))


@query(f"WITH {S.PAIRS} SELECT anchor_id, target_id, {_COMPONENTS} FROM pairs {S.SIDES}")
def component_features(spark, sf):
    return B.measured(spark, sf, pairwise.component_features, tuple(pairwise.COMPONENTS.values()), tuple(feat.component_features())).drop("mask")


_FLAGS = ", ".join(f"(mask & {1 << i} <> 0)::DOUBLE AS blocked_by_{r}" for i, r in enumerate(C.RULES))


@query(f"WITH {S.PAIRS} SELECT anchor_id, target_id, {_FLAGS}, bit_count(mask)::DOUBLE AS number_of_blocking_rules, (target_id LIKE 'S3-%')::DOUBLE AS candidate_source3 FROM pairs")
def blocking_flags(spark, sf):
    return B.found(spark, sf).select("anchor_id", "target_id", *[c.alias(k) for k, c in feat.rule_features().items()])  # whole numbers


_NGRAM = ", ".join(f"round({S.jac(S.ngrams('a.name_norm', n), S.ngrams('t.name_norm', n))}, 6) AS name_char_{n}gram_similarity" for n in (3, 4, 5))


@query(f"WITH {S.PAIRS} SELECT anchor_id, target_id, {_NGRAM}, round({S.jac(S.ngrams('a.address_norm', 3), S.ngrams('t.address_norm', 3))}, 6) AS address_char_ngram_similarity FROM pairs {S.SIDES}")
def ngram_features(spark, sf):
    a, t = (feat.with_grams(x) for x in B.sides(spark, sf))
    g = feat.gathered(B.pairs(spark, sf), a, t, [f"{f}_{n}" for f, n in feat.GRAMS.values()])
    return g.select("anchor_id", "target_id", *_rounded(feat.ngram_features(made=True)))


@query(f"WITH {S.PAIRS} SELECT anchor_id, target_id, round(jaro_winkler_similarity(a.name_norm, t.name_norm), 6) AS jw FROM pairs {S.SIDES}")
def jaro_winkler_pairs(spark, sf):
    return _gathered(spark, sf).select("anchor_id", "target_id", F.round(similarity("jaro_winkler", *feat.both("name_norm")), 6).alias("jw"))


_NAMES = f"g AS (SELECT anchor_id, target_id, mask, a.name_norm AS an, t.name_norm AS tn, a.address_norm AS aa, t.address_norm AS ta, a.country_norm AS ac, t.country_norm AS tc FROM pairs {S.SIDES})"


@query(f"WITH {S.PAIRS}, {_NAMES} SELECT anchor_id, target_id, round({S.indel('an', 'tn')}, 6) AS indel, round({S.token_sort('an', 'tn')}, 6) AS token_sort, round({S.token_set('an', 'tn')}, 6) AS token_set, round({S.partial('an', 'tn')}, 6) AS partial, round({S.weighted('an', 'tn')}, 6) AS weighted FROM g")
def fuzzy_pairs(spark, sf):
    return _gathered(spark, sf).select("anchor_id", "target_id", *[F.round(similarity(k, *feat.both("name_norm")), 6).alias(k) for k in ("indel", "token_sort", "token_set", "partial", "weighted")])


@query(f"WITH {S.PAIRS}, {_NAMES}, s AS (SELECT anchor_id, target_id, {S.indel('an', 'tn')} AS n, {S.token_set('aa', 'ta')} AS a FROM g) SELECT anchor_id, target_id, round(greatest(n, a) + 0.35 * least(n, a), 6) AS rank FROM s")
def fallback_rank(spark, sf):
    return _gathered(spark, sf).select("anchor_id", "target_id", F.round(feat.fallback_rank(), 6).alias("rank"))


def _grouped_features(name: str, group: Callable[[], dict], sql: str | None = None):
    def run(spark, sf):
        return _gathered(spark, sf).select("anchor_id", "target_id", *_rounded({k: c.cast("double") for k, c in group().items()}))

    run.__name__ = name
    query(sql)(run)


_RUNS = lambda c: f"list_distinct(regexp_extract_all({c}, '[0-9]+'))"
_SIZE = lambda a, b: f"least(length({a}), length({b})) / greatest(1, length({a}), length({b}))"
_OVER = lambda x, y: f"len(list_intersect({x}, {y})) / greatest(1, len({S.union(x, y)}))"
_FUZZY = {"ratio": S.indel, "wratio": S.weighted, "token_set": S.token_set, "token_sort": S.token_sort, "jaro": lambda a, b: f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE jaro_winkler_similarity({a}, {b}) END)"}
_COARSE = {f"{p}_{k}": f(*c) for p, c in (("name", ("an", "tn")), ("address", ("aa", "ta"))) for k, f in _FUZZY.items() if (p, k) != ("address", "jaro")}
_COARSE |= {"name_length_ratio": _SIZE("an", "tn"), "address_length_ratio": _SIZE("aa", "ta"), "country_match": "(ac = tc)::DOUBLE", "name_missing": "(an = '' OR tn = '')::DOUBLE", "address_missing": "(aa = '' OR ta = '')::DOUBLE"}
_COARSE |= {"number_overlap": f"len(list_intersect({_RUNS('aa')}, {_RUNS('ta')}))::DOUBLE", "number_jaccard": _OVER(_RUNS("aa"), _RUNS("ta")), "name_token_jaccard": _OVER(S.words("an"), S.words("tn")), "address_token_jaccard": _OVER(S.words("aa"), S.words("ta"))}
_COARSE |= {r: f"(mask & {1 << i} <> 0)::DOUBLE" for i, r in enumerate(C.RULES)}
_columns = lambda c: ", ".join(f"round({v}, 6) AS {k}" for k, v in c.items())


@query(f"WITH {S.PAIRS}, {_NAMES} SELECT anchor_id, target_id, {_columns(_COARSE)} FROM g")
def coarse_features(spark, sf):
    names = [n for n in feat.coarse_features() if n not in C.RULES]
    x = B.measured(spark, sf, pairwise.coarse_features, ("address_norm", "country_norm", "runs"), tuple(names), feat.with_runs)
    return x.select("anchor_id", "target_id", *names, *_rounded(feat.rules()))


_INFORMATIVE = lambda c: f"list_filter(list_distinct({S.words(c)}), lambda w: NOT list_contains({S.listed(C.GENERIC_VETO)}, w))"
_CONFLICT = lambda x, y: f"(len({x}) > 0 AND len({y}) > 0 AND len(list_intersect({x}, {y})) = 0)::DOUBLE"
_ENHANCED = f"""e AS (SELECT *, trim(aa) = '' AS no_a, trim(ta) = '' AS no_t, {S.indel('an', 'tn')} AS ratio, CASE WHEN trim(aa) = '' OR trim(ta) = '' THEN 0.5 ELSE {S.token_set('aa', 'ta')} END AS place, {S.NUMBERS('aa')} AS na, {S.NUMBERS('ta')} AS nt, {_INFORMATIVE('an')} AS ca, {_INFORMATIVE('tn')} AS ct FROM g)"""
@query(
    f"""WITH {S.PAIRS}, {_NAMES}, {_ENHANCED} SELECT anchor_id, target_id, no_t::DOUBLE AS is_target_addr_missing, no_a::DOUBLE AS is_anchor_addr_missing, (no_a OR no_t)::DOUBLE AS addr_missing_either, (no_t AND ratio >= 0.75)::DOUBLE AS name_dominant_blank_addr, (no_t AND an = tn)::DOUBLE AS name_exact_blank_addr,
    CASE WHEN ratio >= 0.85 AND place >= 0.8 THEN 0.0 ELSE {_CONFLICT('na', 'nt')} END AS veto_num_conflict_tempered, CASE WHEN place >= 0.95 THEN 0.0 ELSE {_CONFLICT('ca', 'ct')} END AS veto_name_conflict_tempered, 0.0::DOUBLE AS margin_to_best, 1.0::DOUBLE AS is_top FROM e"""
)
def enhanced_features(spark, sf):
    names = tuple(feat.enhanced_features())
    return B.measured(spark, sf, pairwise.enhanced_features, ("address_norm", "numbers", "core"), names, feat.with_conflicts).drop("mask")


@query(f"WITH {S.SCORED} SELECT anchor_id, target_id, round(max(p) OVER w - p, 6) AS margin_to_best, (max(p) OVER w - p <= 1e-6)::DOUBLE AS is_top FROM scored WINDOW w AS (PARTITION BY anchor_id, source)")
def margin_features(spark, sf):
    return feat.margin_features(B.scored(spark, sf)).select("anchor_id", "target_id", F.round("margin_to_best", 6).alias("margin_to_best"), "is_top")


_CORE_WORDS = lambda c: f"list_filter(list_distinct({S.words(c)}), lambda w: NOT list_contains({S.listed(C.GENERIC_EVIDENCE)}, w))"
_SORTED = lambda x: f"array_to_string(list_sort({x}), ' ')"
_grouped_features(
    "evidence_text_features",
    feat.evidence_text_features,
    f"""WITH {S.PAIRS}, {_NAMES}, c AS (SELECT *, {_SORTED(_CORE_WORDS('an'))} AS ca, {_SORTED(_CORE_WORDS('tn'))} AS ct FROM g), d AS MATERIALIZED (SELECT aa, ta, {S.partial('aa', 'ta')} AS part FROM (SELECT DISTINCT aa, ta FROM g)) SELECT anchor_id, target_id, round({S.indel('an', 'tn')}, 6) AS name_fold_ratio, round({S.token_sort('an', 'tn')}, 6) AS name_fold_token_sort, round({S.indel('ca', 'ct')}, 6) AS core_name_ratio,
    round({S.indel('aa', 'ta')}, 6) AS address_fold_ratio, round(part, 6) AS address_partial_ratio, 0.0::DOUBLE AS name_nonlatin_left, 0.0::DOUBLE AS name_nonlatin_right FROM c JOIN d USING (aa, ta)""",
)
_CONTACT = ", ".join(f"(a.{f} <> '' AND a.{f} = t.{f})::DOUBLE AS {f}_match, (a.{f} <> '' AND t.{f} <> '')::DOUBLE AS {f}_both_present" for f in ("email", "email_domain", "website_domain", "phone"))
_WHOLE = lambda s: f"trim({s}.name_norm || ' ' || {s}.address_norm)"
_grouped_features(
    "full_base_features",
    feat.base_features,
    f"""WITH {S.PAIRS} SELECT anchor_id, target_id, {_sql_text('name', 'business_name')}, {_sql_text('address', 'business_address')}, {_NGRAM}, round({S.jac(S.ngrams('a.address_norm', 3), S.ngrams('t.address_norm', 3))}, 6) AS address_char_ngram_similarity, {_COMPONENTS},
    round({_FUZZY['jaro']('a.name_norm', 't.name_norm')}, 6) AS name_jaro_winkler, round({S.weighted('a.name_norm', 't.name_norm')}, 6) AS name_wratio, round({S.token_set('a.address_norm', 't.address_norm')}, 6) AS address_token_set_similarity, {_CONTACT}, (right(a.phone, 7) <> '' AND right(a.phone, 7) = right(t.phone, 7))::DOUBLE AS phone_suffix_match,
    round({S.lev(_WHOLE('a'), _WHOLE('t'))}, 6) AS name_address_combined_similarity, {_FLAGS}, bit_count(mask)::DOUBLE AS number_of_blocking_rules, (target_id LIKE 'S3-%')::DOUBLE AS candidate_source3 FROM pairs {S.SIDES}""",
)

@query(
    f"""WITH {S.PAIRS}, v AS (SELECT anchor_id, target_id, {S.NUMBERS('a.address_norm')} AS na, {S.NUMBERS('t.address_norm')} AS nt, {_INFORMATIVE('a.name_norm')} AS ca, {_INFORMATIVE('t.name_norm')} AS ct, regexp_extract(a.address_norm, '\\b\\d+\\b') AS fa, regexp_extract(t.address_norm, '\\b\\d+\\b') AS ft FROM pairs {S.SIDES})
    SELECT anchor_id, target_id, (len(na) > 0 AND len(nt) > 0 AND len(list_intersect(na, nt)) = 0)::DOUBLE AS address_number_conflict, round(CASE WHEN len(na) + len(nt) = 0 THEN 1.0 ELSE {S.jac('na', 'nt')} END, 6) AS address_numeric_jaccard,
    CASE WHEN len(na) > 0 AND len(nt) > 0 THEN least(100.0, abs(fa::BIGINT - ft::BIGINT))::DOUBLE ELSE 0.0 END AS primary_num_diff, CASE WHEN len(na) > 0 AND len(nt) > 0 THEN (fa::BIGINT = ft::BIGINT)::DOUBLE ELSE 0.5 END AS primary_num_match,
    (len(ca) > 0 AND len(ct) > 0 AND len(list_intersect(ca, ct)) = 0)::DOUBLE AS core_name_conflict, round({S.jac('ca', 'ct')}, 6) AS core_name_jaccard FROM v"""
)
def veto_features(spark, sf):
    v = feat.veto_features(fuzzy=False)
    names = ("address_number_conflict", "address_numeric_jaccard", "primary_num_diff", "primary_num_match", "core_name_conflict", "core_name_jaccard")
    return _gathered(spark, sf).select("anchor_id", "target_id", *_rounded({n: v[n] for n in names}))


_LEGAL = sorted({w for group in C.LEGAL_FORMS.values() for w in group})
_LETTERS = lambda c: f"list_filter(regexp_extract_all(replace(lower({c}), '&', ' and '), '[a-z0-9]+'), lambda w: NOT list_contains({S.listed(_LEGAL)}, w))"
_INITIALS = lambda x: f"array_to_string(list_transform({x}, lambda w: substr(w, 1, 1)), '')"
_BARE = lambda x: _INITIALS(f"list_filter({x}, lambda w: NOT list_contains({S.listed(C.STOPWORDS)}, w))")
_ACRONYM = lambda s, w: f"(CASE WHEN len({s}) = 1 AND len({w}) >= 2 THEN CASE WHEN {s}[1] = {_INITIALS(w)} OR {s}[1] = {_BARE(w)} THEN 1.0 WHEN starts_with({_BARE(w)}, {s}[1]) THEN 0.7 ELSE 0.0 END ELSE 0.0 END)"
_GROUPS = lambda words, groups: "list_filter([" + ", ".join(f"CASE WHEN len(list_intersect({words}, {S.listed(w)})) > 0 THEN '{k}' END" for k, w in groups.items()) + "], lambda x: x IS NOT NULL)"
_SOUNDEX = lambda words: f"list_transform(list_filter({words}, lambda w: length(w) > 2), lambda w: {S.soundex('w')})"
_grouped_features(
    "veto_features_full",
    feat.veto_features,
    f"""WITH {S.PAIRS}, {_NAMES}, v AS (SELECT *, {S.NUMBERS('aa')} AS na, {S.NUMBERS('ta')} AS nt, regexp_extract(aa, '\\b\\d+\\b') AS fa, regexp_extract(ta, '\\b\\d+\\b') AS ft, {_INFORMATIVE('an')} AS ca, {_INFORMATIVE('tn')} AS ct, list_distinct({S.words('an')}) AS wa, list_distinct({S.words('tn')}) AS wt, list_distinct({S.words('aa')}) AS pa, list_distinct({S.words('ta')}) AS pt, {_LETTERS('an')} AS xa, {_LETTERS('tn')} AS xt FROM g),
    u AS (SELECT *, {_GROUPS('wa', C.LEGAL_FORMS)} AS la, {_GROUPS('wt', C.LEGAL_FORMS)} AS lt, {_GROUPS('wa', C.CATEGORIES)} AS ka, {_GROUPS('wt', C.CATEGORIES)} AS kt, len(na) > 0 AND len(nt) > 0 AS given FROM v)
    SELECT anchor_id, target_id, {_CONFLICT('na', 'nt')} AS address_number_conflict, round(CASE WHEN len(na) + len(nt) = 0 THEN 1.0 ELSE {S.jac('na', 'nt')} END, 6) AS address_numeric_jaccard, CASE WHEN given THEN least(100.0, abs(fa::BIGINT - ft::BIGINT))::DOUBLE ELSE 0.0 END AS primary_num_diff, CASE WHEN given THEN (fa::BIGINT = ft::BIGINT)::DOUBLE ELSE 0.5 END AS primary_num_match,
    {_CONFLICT('ca', 'ct')} AS core_name_conflict, round({S.jac('ca', 'ct')}, 6) AS core_name_jaccard, ({_OVER('pa', 'pt')} >= 0.6 AND len(list_intersect(ca, ct)) = 0)::DOUBLE AS shared_building_diff_name, greatest({_ACRONYM('xa', 'xt')}, {_ACRONYM('xt', 'xa')})::DOUBLE AS acronym_score, {_CONFLICT('la', 'lt')} AS legal_type_conflict, {_CONFLICT('ka', 'kt')} AS category_conflict,
    (len(list_intersect(ka, kt)) > 0)::DOUBLE AS category_match, 0.0::DOUBLE AS is_indic_target, (len(list_intersect({_SOUNDEX('ca')}, {_SOUNDEX('ct')})) > 0)::DOUBLE AS phonetic_soundex_match, round({S.indel('an', 'tn')}, 6) AS indic_trans_ratio FROM u""",
)


_BARE_RUNS = lambda c: f"list_distinct(list_transform(regexp_extract_all({c}, '[0-9]+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END))"


def _sets(s: str) -> dict[str, str]:
    n, a, runs = f"{s}n", f"{s}a", _BARE_RUNS(f"{s}a")
    return {"name": f"list_distinct({S.words(n)})", "core": _CORE_WORDS(n), "address": f"list_distinct({S.words(a)})", "address_words": f"list_filter(list_distinct({S.words(a)}), lambda w: NOT regexp_matches(w, '[0-9]'))", "numbers": runs, "small_numbers": f"list_filter({runs}, lambda x: length(x) < 5)", "large_numbers": f"list_filter({runs}, lambda x: length(x) >= 5)"}


_SET_COLUMNS = ", ".join(f"{c} AS {s}_{k}" for s in "at" for k, c in _sets(s).items())
_SET_FEATURES = {}
for _k in _sets("a"):
    _x, _y = f"a_{_k}", f"t_{_k}"
    _n = f"len(list_intersect({_x}, {_y}))"
    _SET_FEATURES |= {f"{_k}_intersection": f"{_n}::DOUBLE", f"{_k}_left_coverage": f"{_n} / greatest(1, len({_x}))", f"{_k}_right_coverage": f"{_n} / greatest(1, len({_y}))", f"{_k}_conflict": _CONFLICT(_x, _y), f"{_k}_left_only": f"len({S.minus(_x, _y)})::DOUBLE", f"{_k}_right_only": f"len({S.minus(_y, _x)})::DOUBLE"}
_IDF = """one AS (SELECT * FROM rec WHERE entity_id LIKE 'S1-%'), df AS (SELECT c, w, count(*) AS df FROM (SELECT country_norm AS c, unnest(list_distinct(list_filter(string_split(name_norm, ' '), lambda w: w <> ''))) AS w FROM one) GROUP BY ALL), sz AS (SELECT country_norm AS c, count(*) AS size FROM one GROUP BY 1), nf AS (SELECT country_norm AS c, name_norm AS n, count(*) AS f FROM one GROUP BY ALL HAVING count(*) > 1),
ew AS (SELECT anchor_id, target_id, ac, unnest(list_distinct(list_concat(a_name, t_name))) AS w, a_name, t_name FROM sets), ex AS (SELECT anchor_id, target_id, list_contains(a_name, ew.w) AS l, list_contains(t_name, ew.w) AS r, ln(1 + coalesce(size, 1) / (1 + coalesce(df, 0))) AS v FROM ew LEFT JOIN df ON df.c = ac AND df.w = ew.w LEFT JOIN sz ON sz.c = ac),
es AS (SELECT anchor_id, target_id, coalesce(sum(v) FILTER (l AND r), 0) / greatest(1e-9, sum(v)) AS j, coalesce(sum(v) FILTER (l AND r), 0) / greatest(1e-9, coalesce(sum(v) FILTER (l), 0)) AS lc, coalesce(max(v) FILTER (l AND r), 0) AS mx, coalesce(max(v) FILTER (NOT (l AND r)), 0) AS mu FROM ex GROUP BY 1, 2)"""


@query(
    f"""WITH {S.PAIRS}, {_NAMES}, sets AS MATERIALIZED (SELECT anchor_id, target_id, an, tn, ac, tc, {_SET_COLUMNS} FROM g), {_IDF}
    SELECT anchor_id, target_id, {_columns(_SET_FEATURES)}, round(coalesce(j, 0), 6) AS name_idf_jaccard, round(coalesce(lc, 0), 6) AS name_idf_left_coverage, round(coalesce(mx, 0), 6) AS name_shared_max_idf, round(coalesce(mu, 0), 6) AS name_unshared_max_idf, round(ln(1 + coalesce(fa.f, 1)), 6) AS name_anchor_frequency, round(ln(1 + coalesce(ft.f, 1)), 6) AS name_target_frequency
    FROM sets LEFT JOIN es USING (anchor_id, target_id) LEFT JOIN nf fa ON fa.c = ac AND fa.n = an LEFT JOIN nf ft ON ft.c = tc AND ft.n = tn"""
)
def evidence_features(spark, sf):
    a, t = B.sides(spark, sf)
    stats = feat.corpus_stats(a)
    made = [feat.with_evidence(x, stats, own) for x, own in ((a, True), (t, False))]
    fields = ("country_norm", "idf", "idf_none", "idf_frequency", *[f"evidence_{f}" for f in feat.EVIDENCE])
    names = (*feat.IDF, *feat.evidence_set_features())
    return blocking.memory_candidates(*made, B.n_targets(spark, sf), measures=pairwise.evidence_features, fields=fields, columns=names).drop("mask")


_SKELETON = lambda w: "regexp_replace(" * 14 + "regexp_replace(" + "replace(" * len(C.DIGRAPHS) + w + "".join(f", '{a}', '{b}')" for a, b in C.DIGRAPHS.items()) + ", '[aeiou]', '', 'g')" + "".join(f", '{c}{c}+', '{c}', 'g')" for c in "bcdfgklmnprstv")
_VIEWS = lambda s: f"{s}n AS {s}_ascii_name, array_to_string(list_filter({S.words(s + 'n')}, lambda w: NOT list_contains({S.listed(C.GENERIC_EVIDENCE)}, w)), ' ') AS {s}_ascii_core, {s}a AS {s}_ascii_address, list_transform(regexp_extract_all({s}a, '[0-9]+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END) AS {s}_nums"


def detail_features(spark, sf):
    counts = feat.corpus_stats(B.sides(spark, sf)[0])[0]
    fields = tuple(f"detail_{k}" for k in (*feat.VIEWS, "runs", "cores", "frequency"))
    names = (*feat.detail_features(made=True), "detail_left_name_frequency", "detail_right_name_frequency")
    return B.measured(spark, sf, pairwise.detail_features, fields, names, lambda x: feat.with_own_frequency(feat.with_details(x), counts)).drop("mask")


query()(detail_features)


@query(f"WITH {S.REC}, a AS (SELECT * FROM rec WHERE entity_id LIKE 'S1-%'), w AS (SELECT country_norm AS country, unnest(list_distinct({S.words('name_norm')})) AS token FROM a) SELECT country, token, count(*) AS df FROM w GROUP BY ALL")
def corpus_stats(spark, sf):
    return feat.corpus_stats(B.sides(spark, sf)[0])[1]


_TERMS = " UNION ALL ".join(f"SELECT entity_id, substr(name_norm, i::INTEGER, {n}) AS term FROM rec, unnest(range(1, length(name_norm) - {n} + 2)) AS u(i)" for n in (2, 3, 4))
_FIT = f"t AS ({_TERMS}), tf AS (SELECT entity_id, term, count(*) AS tf FROM t GROUP BY ALL), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM rec)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 100000)"


@query(f"WITH {S.REC}, {_FIT} SELECT term, round(idf, 6) AS idf FROM idf")
def tfidf_df_idf(spark, sf):
    return feat.tfidf_fit(B.records(spark, sf), "name_norm", 100_000).select("term", F.round("idf", 6).alias("idf"))


@query(
    f"""WITH {S.PAIRS}, {_FIT}, r AS (SELECT entity_id, term, tf * idf AS w FROM tf JOIN idf USING (term)), u AS (SELECT entity_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS w FROM r),
    c AS (SELECT anchor_id, target_id, sum(x.w * y.w) AS cos FROM pairs JOIN u x ON x.entity_id = anchor_id JOIN u y ON y.entity_id = target_id AND x.term = y.term GROUP BY 1, 2)
    SELECT anchor_id, target_id, round(coalesce(cos, 0.0), 5) AS cos FROM pairs LEFT JOIN c USING (anchor_id, target_id)"""
)
def tfidf_cosine(spark, sf):
    a, t = B.sides(spark, sf)
    idf = feat.tfidf_fit(B.records(spark, sf), "name_norm", 100_000)
    w = [feat.tfidf_vectors(x, "name_norm", idf) for x in (a, t)]
    return feat.tfidf_cosine(B.pairs(spark, sf), *w, "cos").select("anchor_id", "target_id", F.round("cos", 5).alias("cos"))


_OTHERS = ", ".join(f"((count(*) FILTER (p >= {t}) OVER w) - (p >= {t})::INTEGER)::DOUBLE AS others_above_{str(t).replace('.', '_')}" for t in (0.1, 0.3, 0.5, 0.675, 0.9, 0.99))


@query(f"WITH {S.SCORED} SELECT anchor_id, target_id, (rank() OVER (PARTITION BY anchor_id ORDER BY p DESC))::DOUBLE AS probability_rank, round(max(p) OVER w, 6) AS group_max, round(sum(p) OVER w - p, 6) AS group_sum_others, round(max(p) OVER w - p, 6) AS gap_to_max, {_OTHERS}, round(sum(p * p) OVER w - p * p, 6) AS group_sum_squares_others FROM scored WINDOW w AS (PARTITION BY anchor_id)")
def context_features(spark, sf):
    packed = B.context(spark, sf)
    if packed is not None:
        return packed
    x = feat.context_features(B.scored(spark, sf))
    drop = {"mask", "p", "source", "base_probability", "base_logit"}
    return x.select("anchor_id", "target_id", *[F.round(c, 6).alias(c) for c in x.columns if c not in drop | {"anchor_id", "target_id"}])


@query()
def peer_features(spark, sf):
    x = feat.peer_features(B.scored(spark, sf).select("anchor_id", "target_id", "p"), B.sides(spark, sf)[1])
    return x.select("anchor_id", "target_id", "p", *[F.round(c, 6).alias(c) for c in x.columns if c.startswith("peer_")])


@query("SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_cosine(spark, sf):
    e = B.table(spark, sf, "embeddings")
    a, b = e.select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("left_id"), F.col("vec_id").alias("right_id"), F.col("embedding").alias("y"))
    return a.join(b, "left_id").select("left_id", "right_id", F.round(feat.cosine(F.col("x"), F.col("y")), 6).alias("cos"))


# --- decisions


@query(f"WITH {S.SCORED} SELECT anchor_id, target_id, round(CASE WHEN max(p) OVER (PARTITION BY anchor_id, source) - p <= 0.2 THEN p ELSE 0 END, 6) AS p FROM scored")
def margin_gate(spark, sf):
    return decide.margin_gate(B.scored(spark, sf), 0.2).select("anchor_id", "target_id", F.round("p", 6).alias("p"))


@query(f"WITH {S.SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY p DESC, anchor_id) AS r FROM scored) SELECT anchor_id, target_id, p FROM r WHERE r = 1")
def target_arbitration(spark, sf):
    return decide.arbitrated(B.scored(spark, sf)).select("anchor_id", "target_id", "p")


@query(f"WITH {S.SCORED}, m AS (SELECT *, max(p) OVER (PARTITION BY target_id) AS top FROM scored), w AS (SELECT *, count(*) OVER (PARTITION BY target_id) AS n FROM m WHERE p = top) SELECT anchor_id, target_id, p FROM w WHERE n = 1")
def unique_owner_abstain(spark, sf):
    return decide.unique_owner(B.scored(spark, sf)).select("anchor_id", "target_id", "p")


@query(f"WITH {S.SCORED}, r AS (SELECT *, max(p) OVER (PARTITION BY target_id) AS top FROM scored) SELECT target_id, max(p) AS best, coalesce(max(p) FILTER (p < top), 0) AS second, count(*) FILTER (p = top) AS ties FROM r GROUP BY 1")
def owner_stats(spark, sf):
    return decide.owner_stats(B.scored(spark, sf)).select("target_id", "best", "second", "ties")


_ROUNDS = 12


def _capped(rounds: int = _ROUNDS) -> str:
    """Rounds of locally best pairs with one target of a source for each anchor, laid end to end."""
    out, live = [], "scored"
    for k in range(rounds):
        out.append(f"w{k} AS MATERIALIZED (SELECT anchor_id, target_id, p, source FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY p DESC, anchor_id, target_id) AS b, row_number() OVER (PARTITION BY anchor_id, source ORDER BY p DESC, anchor_id, target_id) AS g FROM {live}) WHERE b = 1 AND g = 1)")
        out.append(f"l{k} AS MATERIALIZED (SELECT anchor_id, target_id, p, source FROM {live} ANTI JOIN w{k} USING (target_id) ANTI JOIN w{k} z USING (anchor_id, source))")
        live = f"l{k}"
    return ", ".join(out) + ", capped AS (" + " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(rounds)) + ")"


@query(f"WITH {S.SCORED}, {_capped()} SELECT anchor_id, target_id, p, source FROM capped")
def arbitration_capped(spark, sf):
    return decide.arbitrated_capped(B.scored(spark, sf), 1).select("anchor_id", "target_id", "p", "source")


@query(f"WITH {S.SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY p DESC, anchor_id) = 1 AS won FROM scored) SELECT anchor_id, target_id, won, CASE WHEN won THEN p ELSE 0.0 END AS p FROM r")
def won_pairs(spark, sf):
    s = B.scored(spark, sf)
    return decide.winners(s, decide.arbitrated(s)).select("anchor_id", "target_id", "won", "p")


@query(
    f"""WITH {S.SCORED}, r AS (SELECT *, max(p) OVER w AS best FROM scored WINDOW w AS (PARTITION BY target_id)), o AS (SELECT target_id, coalesce(max(p) FILTER (p < best), 0) AS second, count(*) FILTER (p = best) AS ties FROM r GROUP BY 1), x AS (SELECT anchor_id, count(*) AS n, count(*) FILTER (p = best AND ties = 1) AS u, count(*) FILTER (p = best AND ties = 1 AND p - second < 0.1) AS m FROM r JOIN o USING (target_id) WHERE p >= 0.675 GROUP BY 1)
    SELECT country_norm, count(*) AS n_anchors, sum(coalesce(n, 0))::BIGINT AS pair_matches, sum(coalesce(u, 0))::BIGINT AS unique_matches, sum(coalesce(m, 0))::BIGINT AS small_margin_unique, count(*) FILTER (coalesce(n, 0) = 0) AS pair_empty, count(*) FILTER (coalesce(u, 0) = 0) AS unique_empty FROM anchors JOIN rec ON entity_id = anchor_id LEFT JOIN x USING (anchor_id) GROUP BY 1"""
)
def graph_audit(spark, sf):
    a = B.sides(spark, sf)[0].select(F.col("entity_id").alias("anchor_id"), "country_norm")
    return decide.graph_audit(B.scored(spark, sf), a, 0.675)


#: Faults planted by the last digit of an id.
_PLANTED = "CASE substr(target_id, -1) WHEN '1' THEN NULL WHEN '2' THEN CAST('NaN' AS DOUBLE) WHEN '3' THEN p + 1 WHEN '4' THEN -p - 0.5 ELSE p END"


@query(f"WITH {S.SCORED}, x AS (SELECT {_PLANTED} AS p FROM scored) SELECT CASE WHEN p IS NULL THEN 'null' WHEN isnan(p) THEN 'nan' ELSE 'range' END AS fault, count(*) AS n FROM x WHERE p IS NULL OR isnan(p) OR p < 0 OR p > 1 GROUP BY 1")
def probability_faults(spark, sf):
    return decide.probability_faults(B.scored(spark, sf).selectExpr(f"{_PLANTED} AS p"))


@query(
    f"""WITH {S.SCORED}, x AS (SELECT anchor_id, target_id, p, row_number() OVER d AS k, sum(p) OVER (PARTITION BY anchor_id ORDER BY p DESC, target_id ROWS UNBOUNDED PRECEDING) AS s, sum(p) OVER g AS t, exp(sum(ln(greatest(1 - p, 1e-12))) OVER g) AS no FROM scored WINDOW g AS (PARTITION BY anchor_id), d AS (PARTITION BY anchor_id ORDER BY p DESC, target_id)),
    v AS (SELECT *, round(1.25 * s / (0.25 * t + k), 12) AS v FROM x), b AS (SELECT anchor_id, max(v) AS top FROM v GROUP BY 1), c AS (SELECT anchor_id, top, min(k) AS kk FROM v JOIN b USING (anchor_id) WHERE v = top GROUP BY 1, 2)
    SELECT anchor_id, target_id, p, k::INTEGER AS k FROM v JOIN c USING (anchor_id) WHERE k <= kk AND top > round(no, 12)"""
)
def expected_f_cutoff(spark, sf):
    return decide.expected_f_cutoff(B.scored(spark, sf)).select("anchor_id", "target_id", "p", "k")


@query(f"WITH {S.SCORED}, c AS (SELECT target_id, count(*) AS c FROM scored WHERE p >= 0.5 GROUP BY 1) SELECT coalesce(sum(c), 0)::BIGINT AS n_pairs, count(*) AS n_targets, coalesce(max(c), 0) AS max_claims, coalesce(sum(c - 1), 0)::BIGINT AS n_duplicates FROM c")
def claims_report(spark, sf):
    return decide.claims_report(decide.thresholded(B.scored(spark, sf), 0.5))


# --- metrics

_PER = """pa AS (SELECT anchor_id, count(x.target_id) AS n_pred, count(*) FILTER (x.target_id IS NOT NULL AND t.target_id IS NOT NULL) AS tp FROM anchors LEFT JOIN (SELECT * FROM scored WHERE p >= {t}) x USING (anchor_id) LEFT JOIN truth t USING (anchor_id, target_id) GROUP BY 1),
pb AS (SELECT anchor_id, n_pred, tp, coalesce(n_true, 0) AS n_true FROM pa LEFT JOIN (SELECT anchor_id, count(*) AS n_true FROM truth GROUP BY 1) USING (anchor_id)),
pc AS (SELECT *, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS pr, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_true = 0 THEN 0.0 ELSE tp / n_true END AS rc FROM pb),
pd AS (SELECT *, CASE WHEN 0.25 * pr + rc = 0 THEN 0.0 ELSE 1.25 * pr * rc / (0.25 * pr + rc) END AS f FROM pc)"""


@query(
    f"""WITH {S.SCORED}, {_PER.format(t=0.7)}, s AS (SELECT avg(pr) AS pr, avg(rc) AS rc, avg(f) AS f, sum(tp) AS tp, sum(n_pred - tp) AS fp, sum(n_true - tp) AS fn, count(*) AS n, sum(n_true) AS nt, count(*) FILTER (n_true = 0) AS sg, count(*) FILTER (n_true = 0 AND n_pred = 0) AS rt FROM pd), m AS (SELECT *, tp / (tp + fp) AS mp, tp / (tp + fn) AS mr, n * (SELECT count(*) FROM rec WHERE entity_id NOT LIKE 'S1-%') - nt AS neg FROM s)
    SELECT round(pr, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f05, round(mp, 6) AS micro_precision, round(mr, 6) AS micro_recall, round(1.25 * mp * mr / (0.25 * mp + mr), 6) AS micro_f05, round(fp / neg, 6) AS false_positive_rate, round(rt / sg, 6) AS singleton_accuracy, sg AS singletons, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn FROM m"""
)
def entity_macro_f05(spark, sf):
    n = B.n_targets(spark, sf)
    return metrics.entity_report(decide.thresholded(B.scored(spark, sf), 0.7), B.truth(spark, sf), B.anchors(spark, sf), n)


_GRID = metrics.disk_grid()
_STEPS = f"grid AS (SELECT unnest(range(0, {len(_GRID)})) AS step, unnest({_GRID}::DOUBLE[]) AS threshold)"


@query(
    f"""WITH {S.SCORED}, {_STEPS}, nt AS (SELECT anchor_id, count(*) AS n_true FROM truth GROUP BY 1), y AS (SELECT s.*, t.anchor_id IS NOT NULL AS y FROM scored s LEFT JOIN truth t USING (anchor_id, target_id)),
    c AS (SELECT step, anchor_id, count(*) AS n, count(*) FILTER (y) AS tp FROM y JOIN grid ON p >= threshold GROUP BY ALL), x AS (SELECT step, threshold, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp, coalesce(n_true, 0) AS t FROM anchors CROSS JOIN grid LEFT JOIN c USING (step, anchor_id) LEFT JOIN nt USING (anchor_id)),
    r AS (SELECT *, CASE WHEN n = 0 AND t = 0 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE tp / n END AS pr, CASE WHEN n = 0 AND t = 0 THEN 1.0 WHEN t = 0 THEN 0.0 ELSE tp / t END AS rc FROM x)
    SELECT step::INTEGER AS step, threshold, round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall, round(avg(CASE WHEN 0.25 * pr + rc = 0 THEN 0.0 ELSE 1.25 * pr * rc / (0.25 * pr + rc) END), 6) AS f05 FROM r GROUP BY ALL"""
)
def threshold_sweep(spark, sf):
    return metrics.threshold_sweep(B.scored(spark, sf), B.truth(spark, sf), B.anchors(spark, sf), _GRID)


@query(f"WITH {S.LABELLED}, scored2 AS (SELECT * FROM labelled WHERE label = 1), {_PER.format(t=0.0).replace('FROM scored WHERE', 'FROM scored2 WHERE')} SELECT round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall, round(avg(f), 6) AS f05, sum(tp)::BIGINT AS tp FROM pd")
def oracle_ceiling(spark, sf):
    """What a perfect model would reach on the candidates: labels as probabilities."""
    sure = _labelled(spark, sf).withColumn("p", F.col("label").cast("double"))
    return metrics.entity_report(decide.thresholded(sure, 0.5), B.truth(spark, sf), B.anchors(spark, sf), B.n_targets(spark, sf)).select("precision", "recall", "f05", "tp")


@query(f"WITH {S.LABELLED}, c AS (SELECT count(*) AS n, greatest(1, sum(label)) AS pos, greatest(1, count(*) - sum(label)) AS neg FROM labelled) SELECT label, round(n / (2 * CASE WHEN label = 1 THEN pos ELSE neg END), 6) AS weight, count(*) AS n_pairs FROM labelled, c GROUP BY ALL")
def class_weights(spark, sf):
    """The weights of ``models.weighted``, which follow from the pairs of each label; they need no p."""
    per = blocking.labelled(B.found(spark, sf), B.truth(spark, sf)).groupBy("label").agg(F.count("*").alias("n_pairs")).persist()
    n = per.agg(F.sum("n_pairs")).first()[0] or 0
    return per.select("label", F.round(F.lit(n) / (2 * F.col("n_pairs")), 6).alias("weight"), "n_pairs")


@query(f"WITH {S.SCORED}, l AS (SELECT anchor_id, target_id, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS z FROM scored) SELECT anchor_id, target_id, round(z, 6) AS logit, round(1 / (1 + exp(-z / 1.2)), 6) AS tempered FROM l")
def logits(spark, sf):
    z = X.logit(F.col("p"))
    return B.scored(spark, sf).select("anchor_id", "target_id", F.round(z, 6).alias("logit"), F.round(X.sigmoid(z, 1.2), 6).alias("tempered"))


def _labelled(spark, sf):
    return blocking.labelled(B.scored(spark, sf), B.truth(spark, sf))


@query(
    f"""WITH {S.LABELLED}, b AS (SELECT p, sum(label) AS t, count(*) AS n FROM labelled GROUP BY p), c AS (SELECT *, sum(t) OVER w AS ct, sum(n) OVER w AS cn FROM b WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), s AS (SELECT sum(t) AS pos, sum(n) AS n, sum(t * ct / cn) AS ap, sum((n - t) * (ct - t / 2)) AS auc FROM c)
    SELECT round(ap / pos, 6) AS average_precision, round(auc / (pos * (n - pos)), 6) AS roc_auc, (SELECT round(avg((p - label) ** 2), 6) FROM labelled) AS brier, (SELECT round(avg(-CASE WHEN label = 1 THEN ln(least(greatest(p, 1e-8), 1 - 1e-8)) ELSE ln(1 - least(greatest(p, 1e-8), 1 - 1e-8)) END), 6) FROM labelled) AS log_loss FROM s"""
)
def probability_diagnostics(spark, sf):
    return metrics.probability_report(_labelled(spark, sf))


@query(f"WITH {S.LABELLED} SELECT label, (p >= 0.7)::INTEGER AS predicted, count(*) AS n FROM labelled GROUP BY ALL")
def confusion_matrix(spark, sf):
    return metrics.confusion(_labelled(spark, sf), 0.7)


@query(f"WITH {S.SCORED}, {_PER.format(t=0.7)} SELECT country_norm, count(*) AS n, round(avg(f), 6) AS f05 FROM pd JOIN rec ON entity_id = anchor_id GROUP BY 1")
def country_scores(spark, sf):
    a = B.sides(spark, sf)[0].select(F.col("entity_id").alias("anchor_id"), "country_norm")
    return metrics.country_scores(decide.thresholded(B.scored(spark, sf), 0.7), B.truth(spark, sf), a)


@query(f"WITH {S.LABELLED}, m AS (SELECT CASE WHEN label = 1 AND p < 0.7 AND p * 1.1 >= 0.7 THEN 'recovered_true' WHEN label = 0 AND p < 0.7 AND p * 1.1 >= 0.7 THEN 'new_false' END AS slice FROM labelled) SELECT slice, count(*) AS n FROM m WHERE slice IS NOT NULL GROUP BY 1")
def model_change_slices(spark, sf):
    x = _labelled(spark, sf).withColumn("p2", F.col("p") * 1.1)
    return metrics.model_changes(x, "p", "p2", 0.7)


@query(f"WITH {S.LABELLED} SELECT anchor_id, target_id, round(p * p, 6) AS p2, round(p - p * p, 6) AS change FROM labelled ORDER BY p - p * p DESC, anchor_id, target_id LIMIT 12")
def top_changes(spark, sf):
    x = metrics.top_changes(_labelled(spark, sf).withColumn("p2", F.col("p") * F.col("p")), "p", "p2")
    return x.select("anchor_id", "target_id", F.round("p2", 6).alias("p2"), F.round("change", 6).alias("change"))


_CLAIMS = lambda x: f"SELECT count(*) AS c FROM ({x}) WHERE p >= 0.6 GROUP BY target_id"
_POLICY = lambda name, x: f"SELECT '{name}' AS policy, coalesce(sum(c), 0)::BIGINT AS n_pairs, count(*) AS n_targets, coalesce(max(c), 0) AS max_claims, coalesce(sum(c - 1), 0)::BIGINT AS n_duplicates FROM ({_CLAIMS(x)})"


@query(f"WITH {S.SCORED}, {_capped()} {_POLICY('none', 'SELECT * FROM scored')} UNION ALL {_POLICY('target', 'SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY p DESC, anchor_id) AS r FROM scored) WHERE r = 1')} UNION ALL {_POLICY('capped', 'SELECT * FROM capped')}")
def arbitration_comparison(spark, sf):
    return decide.arbitration_comparison(B.scored_from(spark, sf, 0.6), 0.6)  # what wins needs no lower p


@query()
def bootstrap_interval(spark, sf):
    x = metrics.per_anchor(decide.thresholded(B.scored(spark, sf), 0.7), B.truth(spark, sf), B.anchors(spark, sf))
    m, lo, hi = metrics.bootstrap_interval(x.select("anchor_id", "f05"), "f05")
    return spark.range(1).select(F.lit(m).alias("mean"), F.lit(lo).alias("low"), F.lit(hi).alias("high"))


# --- quality, splits, export, models, streaming



@query(
    f"""WITH {S.RAW} SELECT count(*) AS n_rows, count(DISTINCT entity_id) AS n_ids, count(*) - count(DISTINCT entity_id) AS n_repeated_ids, count(*) FILTER (trim(business_name) = '') AS missing_business_name, count(*) FILTER (trim(business_address) = '') AS missing_business_address, count(*) FILTER (trim(country) = '') AS missing_country,
    count(DISTINCT country) FILTER (country <> '') AS n_countries, count(*) FILTER (length(trim(business_name)) < 3) AS near_empty_names, count(*) FILTER (regexp_matches(business_name, '[^\\x00-\\x7F]')) AS non_ascii_names, count(*) FILTER (regexp_matches(business_name, '[A-Z]')) AS uppercase_names, count(*) FILTER (regexp_matches(business_name, '[^\\w\\s]')) AS punctuated_names,
    count(*) FILTER (regexp_matches(business_name || ' ' || business_address, '(?i)https?://|www\\.')) AS with_url, count(*) FILTER (regexp_matches(business_name || ' ' || business_address, '[\\w.]+@[\\w-]+\\.\\w+')) AS with_email, count(*) FILTER (regexp_matches(business_name || ' ' || business_address, '(?i)\\b(?:tel|phone|mobile|mob)')) AS with_phone, count(*) FILTER (business_name = '' AND business_address = '') AS without_identifiers FROM raw"""
)
def quality_profile(spark, sf):
    return quality.profile(B.raw_records(spark, sf))


@query("WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang HAVING count(*) > 1) SELECT count(*) AS n_groups, coalesce(sum(n), 0)::BIGINT AS n_rows FROM g")
def duplicate_fingerprints(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("text").alias("business_name"), F.lit("").alias("business_address"), F.col("lang").alias("country"))
    return quality.repeated_records(d)


@query(f"WITH {S.RAW}, {S.TRUTH}, c AS (SELECT anchor_id, count(target_id) AS n_matches FROM anchors LEFT JOIN truth USING (anchor_id) GROUP BY 1) SELECT n_matches, count(*) AS n_anchors FROM c GROUP BY 1")
def match_histogram(spark, sf):
    return quality.match_histogram(B.truth(spark, sf), B.anchors(spark, sf))


_REASONS = {
    "country_mismatch": "ac <> '' AND tc <> '' AND ac <> tc",
    "missing_country": "ac = '' OR tc = ''",
    "acronym_or_initials": "acr",
    "no_informative_name_word": "shared = 0",
    "low_name_overlap": "shared = 1 AND nset < 0.7",
    "address_discrepancy": "place < 0.5",
    "shared_address_other_name": "place >= 0.7 AND shared = 0",
    "number_conflict": "len(na) > 0 AND len(nt) > 0 AND len(list_intersect(na, nt)) = 0",
    "name_divergence": "ratio < 0.6 AND sorted < 0.65 AND NOT acr",
}
_PLAIN_WORDS = lambda c: f"list_filter({S.words(c)}, lambda w: NOT list_contains({S.listed(C.GENERIC_EVIDENCE)}, w))"
_SHORT = lambda s, w: f"(len({s}) = 1 AND length({s}[1]) >= 2 AND contains({_INITIALS(w)}, {s}[1]))"
_SIDES_OF = lambda x: f"g AS (SELECT anchor_id, target_id, a.name_norm AS an, t.name_norm AS tn, a.address_norm AS aa, t.address_norm AS ta, a.country_norm AS ac, t.country_norm AS tc FROM {x} JOIN rec a ON a.entity_id = anchor_id JOIN rec t ON t.entity_id = target_id)"
_KINDS = lambda name, rest, kinds: f"SELECT unnest(CASE WHEN len(k) = 0 THEN ['{rest}'] ELSE k END) AS {name}, count(*) AS n FROM (SELECT list_filter([{', '.join(f'CASE WHEN {c} THEN {k!r} END' for k, c in kinds.items())}], lambda x: x IS NOT NULL) AS k FROM h) GROUP BY 1"


@query(
    f"""WITH {S.SCORED}, m AS (SELECT anchor_id, target_id FROM truth ANTI JOIN pairs USING (anchor_id, target_id)), {_SIDES_OF('m')}, i AS (SELECT *, {_PLAIN_WORDS('an')} AS xa, {_PLAIN_WORDS('tn')} AS xt FROM g),
    h AS (SELECT *, len(list_intersect(xa, xt)) AS shared, coalesce(len(xa) > 0 AND len(xt) > 0 AND ({_SHORT('xa', 'xt')} OR {_SHORT('xt', 'xa')}), false) AS acr, {S.token_set('an', 'tn')} AS nset, {S.token_set('aa', 'ta')} AS place, {S.indel('an', 'tn')} AS ratio, {S.token_sort('an', 'tn')} AS sorted, {_RUNS('aa')} AS na, {_RUNS('ta')} AS nt FROM i) {_KINDS('reason', 'subtle', _REASONS)}"""
)
def missed_reasons(spark, sf):
    return quality.missed_reasons(feat.gathered(blocking.missed_pairs(B.pairs(spark, sf), B.truth(spark, sf)), *B.sides(spark, sf)))


_FALSE = {
    "target_of_several_anchors": "claims > 1",
    "number_conflict": "len(na) > 0 AND len(nt) > 0 AND len(list_intersect(na, nt)) = 0",
    "no_shared_name_word": "shared = 0",
    "other_legal_form": "len(la) > 0 AND len(lt) > 0 AND la <> lt",
    "other_place_of_same_name": "(an = tn OR (shared >= 2 AND shared = len(wa))) AND len(list_intersect(na, nt)) = 0",
}


@query(
    f"""WITH {S.LABELLED}, m AS (SELECT *, count(*) OVER (PARTITION BY target_id) AS claims FROM labelled WHERE p >= 0.5), {_SIDES_OF('(SELECT anchor_id, target_id FROM m WHERE label = 0)')}, i AS (SELECT g.*, claims, list_distinct({S.words('an')}) AS wa, list_distinct({S.words('tn')}) AS wt, {S.NUMBERS('aa')} AS na, {S.NUMBERS('ta')} AS nt FROM g JOIN m USING (anchor_id, target_id)),
    h AS (SELECT *, len(list_intersect(wa, wt)) AS shared, list_sort(list_intersect(wa, {S.listed(_LEGAL)})) AS la, list_sort(list_intersect(wt, {S.listed(_LEGAL)})) AS lt FROM i) {_KINDS('kind', 'other', _FALSE)}"""
)
def false_positive_kinds(spark, sf):
    accepted = decide.thresholded(_labelled(spark, sf), 0.5)
    return quality.false_positive_kinds(feat.gathered(accepted, *B.sides(spark, sf)))


@query(
    f"""WITH {S.LABELLED}, f AS (SELECT anchor_id, target_id FROM labelled WHERE p >= 0.5 AND label = 0), q AS (SELECT f.anchor_id, f.target_id, x.name_norm AS xn, x.address_norm AS xa, y.name_norm AS yn, y.address_norm AS ya FROM f JOIN rec x ON x.entity_id = f.target_id LEFT JOIN truth t ON t.anchor_id = f.anchor_id LEFT JOIN rec y ON y.entity_id = t.target_id),
    v AS (SELECT anchor_id, target_id, max(CASE WHEN yn IS NULL THEN NULL ELSE 0.5 * {S.indel('xn', 'yn')} + 0.5 * {S.token_set('xa', 'ya')} END) AS v FROM q GROUP BY 1, 2)
    SELECT CASE WHEN v IS NULL THEN 'no true target' WHEN v >= 0.9 THEN 'from 0.9' WHEN v >= 0.8 THEN 'from 0.8' WHEN v >= 0.7 THEN 'from 0.7' WHEN v >= 0.5 THEN 'from 0.5' ELSE 'below 0.5' END AS band, count(*) AS n FROM v GROUP BY 1"""
)
def nearest_truth(spark, sf):
    false = decide.thresholded(_labelled(spark, sf), 0.5).where("label = 0")
    return quality.nearest_truth(false, B.truth(spark, sf), B.sides(spark, sf)[1])


@query(f"WITH {S.LABELLED} SELECT least(floor(p / 0.1), 9)::INTEGER AS bin, label, count(*) AS n FROM labelled GROUP BY ALL")
def probability_bins(spark, sf):
    return quality.probability_bins(_labelled(spark, sf))


@query(f"WITH {S.RAW}, {S.TRUTH} SELECT anchor_id, CASE WHEN {S.draw('anchor_id', 17)} >= 0.8 THEN 'validation' WHEN {S.draw('anchor_id', 17)} >= 0.6 THEN 'calibration' ELSE 'fit' END AS split, floor({S.draw('anchor_id', 0)} * 3)::INTEGER AS fold FROM anchors")
def split_disjoint(spark, sf):
    return splits.folds(splits.split(B.anchors(spark, sf), "anchor_id", {"fit": 0.6, "calibration": 0.2, "validation": 0.2}, 17), "anchor_id", 3)


@query(
    f"""WITH {S.RAW}, {S.TRUTH}, f AS (SELECT anchor_id, (anchor_id IN (SELECT anchor_id FROM truth))::INTEGER AS flag FROM anchors), o AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY md5(anchor_id || '|17'), anchor_id) - 1 AS place, count(*) OVER (PARTITION BY flag) AS n FROM f), h AS (SELECT *, ceil(round(n * 0.2, 9)) AS held FROM o)
    SELECT anchor_id, CASE WHEN place < held THEN 'validation' WHEN place < held + ceil(round((n - held) * (0.2 / 0.8), 9)) THEN 'calibration' ELSE 'fit' END AS split FROM h"""
)
def stratified_split(spark, sf):
    marks = B.truth(spark, sf).select("anchor_id").distinct().withColumn("_t", F.lit(True))
    return splits.stratified(B.anchors(spark, sf).join(marks, "anchor_id", "left"), "anchor_id", F.col("_t"), 17).select("anchor_id", "split")


@query(f"WITH {S.RAW}, {S.TRUTH}, o AS (SELECT anchor_id, row_number() OVER (ORDER BY md5(anchor_id || '|17'), anchor_id) - 1 AS place FROM anchors), u AS (SELECT anchor_id FROM o WHERE place >= 150 ORDER BY md5(anchor_id || '|99'), anchor_id LIMIT 50) SELECT anchor_id, CASE WHEN place < 100 THEN 'fit' ELSE 'validation' END AS split FROM o WHERE place < 150 UNION ALL SELECT anchor_id, 'fresh' FROM u")
def fresh_holdout(spark, sf):
    """Two parts of fixed sizes, and a sample of anchors that neither has."""
    a = B.anchors(spark, sf)
    used = splits.dealt(a, "anchor_id", {"fit": 100, "validation": 50}, 17)
    return used.select("anchor_id", "split").union(splits.holdout(a, used, "anchor_id", 50, 99).select("anchor_id", F.lit("fresh")))


@query(f"WITH {S.RAW}, {S.TRUTH} SELECT entity_id, business_name, business_address, country, coalesce(owner, '') AS owner FROM (SELECT * FROM raw) r LEFT JOIN (SELECT target_id, anchor_id AS owner FROM truth) t ON t.target_id = r.entity_id")
def source_files(spark, sf):
    """The records and their truth, written as the files of a training part, checked and read again."""
    from weftlink.session import scratch_path

    root, raw = scratch_path(spark, "sources"), B.raw_records(spark, sf)
    for i in (1, 2, 3):
        tables.write_lists(raw.where(F.col("entity_id").startswith(f"S{i}-")), f"{root}/train/train_source{i}.tsv")
    lists = tables.match_lists(B.truth(spark, sf), B.anchors(spark, sf), by=None)
    tables.write_lists(lists, f"{root}/train/train_ground_truth.tsv")
    one, others = tables.load_sources(spark, root, "train")
    own = tables.load_truth(spark, f"{root}/train/train_ground_truth.tsv", one, others).select(F.col("target_id").alias("entity_id"), F.col("anchor_id").alias("owner"))
    return one.unionByName(others).join(own, "entity_id", "left").withColumn("owner", F.coalesce("owner", F.lit("")))


@query(f"WITH {S.SCORED} SELECT anchor_id, target_id, (row_number() OVER (PARTITION BY anchor_id ORDER BY target_id) - 1)::INTEGER AS position FROM pairs")
def candidate_files(spark, sf):
    """Candidate lists written and read again, in the order of their cells."""
    from weftlink.session import scratch_path

    path = scratch_path(spark, "candidates.tsv")
    tables.write_lists(tables.match_lists(B.found_lists(spark, sf), B.anchors(spark, sf), "candidate_entity_ids", by=None), path)
    return tables.read_candidates(spark, path)


@query(f"WITH {S.SCORED}, r AS (SELECT anchor_id, target_id, p FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY p DESC, anchor_id) AS r FROM scored) WHERE r = 1 AND p >= 0.6) SELECT a.anchor_id AS source1_entity_id, coalesce(string_agg(target_id, ',' ORDER BY p DESC, target_id), '') AS matched_entity_ids FROM anchors a LEFT JOIN r USING (anchor_id) GROUP BY 1")
def match_lists_export(spark, sf):
    return tables.match_lists(decide.thresholded(decide.arbitrated(B.scored(spark, sf)), 0.6), B.anchors(spark, sf))


#: Faults planted in exported lists, by the number of the anchor.
_WRONG_CELL = "CASE WHEN n % 39 = 6 AND cell <> '' THEN cell || ',S9-none' WHEN n % 39 = 9 AND cell LIKE '%,%' THEN replace(cell, ',', ', ') WHEN n % 39 = 12 AND cell <> '' THEN cell || ',' || split_part(cell, ',', 1) ELSE cell END"
_ROWS = "CASE WHEN n % 21 = 0 THEN 0 WHEN n % 33 = 3 THEN 2 ELSE 1 END"
_LISTS = f"""won AS (SELECT anchor_id, target_id, p FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY p DESC, anchor_id) AS r FROM scored) WHERE r = 1 AND p >= 0.6), m0 AS (SELECT a.anchor_id AS id, coalesce(string_agg(target_id, ',' ORDER BY p DESC, target_id), '') AS cell FROM anchors a LEFT JOIN won USING (anchor_id) GROUP BY 1),
m1 AS (SELECT *, CAST(substr(id, 4) AS BIGINT) AS n FROM m0), m AS (SELECT CASE WHEN n % 51 = 15 THEN 'S1-x' ELSE id END AS id, {_WRONG_CELL} AS cell FROM m1, unnest(range(0, {_ROWS})) AS u(i)), ids AS (SELECT id, cell, list_filter(list_transform(string_split(cell, ','), lambda x: trim(x)), lambda x: x <> '') AS ids FROM m), each AS (SELECT id, unnest(ids) AS t FROM ids)"""


@query(
    f"""WITH {S.SCORED}, {_LISTS}, f AS (SELECT 'matches: anchors without a row' AS fault, (SELECT count(*) FROM anchors WHERE anchor_id NOT IN (SELECT id FROM m)) AS n UNION ALL SELECT 'matches: rows of unknown anchors', (SELECT count(*) FROM m WHERE id NOT IN (SELECT anchor_id FROM anchors)) UNION ALL SELECT 'matches: anchors with several rows', (SELECT count(*) FROM (SELECT id FROM m GROUP BY 1 HAVING count(*) > 1))
    UNION ALL SELECT 'matches: cells not in canonical form', (SELECT count(*) FROM ids WHERE cell <> array_to_string(ids, ',')) UNION ALL SELECT 'matches: repeated ids', (SELECT count(*) FROM ids WHERE len(ids) <> len(list_distinct(ids))) UNION ALL SELECT 'matches: unknown ids', (SELECT count(*) FROM each WHERE t NOT IN (SELECT entity_id FROM rec WHERE entity_id NOT LIKE 'S1-%'))
    UNION ALL SELECT 'matches that are no candidates', (SELECT count(*) FROM each WHERE (id, t) NOT IN (SELECT (anchor_id, target_id) FROM pairs))) SELECT * FROM f WHERE n > 0"""
)
def submission_validate(spark, sf):
    """The faults of lists in which some were planted."""
    s, a = B.scored(spark, sf), B.anchors(spark, sf)
    m = tables.match_lists(decide.thresholded(decide.arbitrated(s), 0.6), a).selectExpr("source1_entity_id AS id", "matched_entity_ids AS cell", "CAST(substr(source1_entity_id, 4) AS BIGINT) AS n")
    m = m.withColumn("rows", F.expr(_ROWS)).where("rows > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    m = m.selectExpr("CASE WHEN n % 51 = 15 THEN 'S1-x' ELSE id END AS source1_entity_id", f"{_WRONG_CELL} AS matched_entity_ids")
    return tables.submission_faults(m, tables.match_lists(s, a, "candidate_entity_ids", by=None), a, B.sides(spark, sf)[1])


@query(
    f"""WITH {S.PAIRS} SELECT anchor_id, target_id, (a.name_norm <> '' AND a.name_norm = t.name_norm AND ((a.address_norm <> '' AND a.address_norm = t.address_norm) OR (a.postal_code <> '' AND a.postal_code = t.postal_code AND a.street_number <> '' AND a.street_number = t.street_number)) AND ((a.country_norm <> '' AND a.country_norm = t.country_norm) OR a.country_norm = '' OR t.country_norm = ''))::DOUBLE AS p FROM pairs {S.SIDES}"""
)
def exact_rule_model(spark, sf):
    from weftlink.operators.models import exact_rule

    g = _gathered(spark, sf).select("anchor_id", "target_id", *[c.alias(k) for k, c in (feat.text_features() | feat.component_features()).items()])
    return exact_rule(g).select("anchor_id", "target_id", "p")


def _chosen(spark, sf):
    from weftlink.plans import linkage

    s = linkage.Settings(trees=10, rank_trees=20)
    return linkage.select_model(spark, *B.sides(spark, sf), B.truth(spark, sf), s), s


@query()
def calibrated_model_select(spark, sf):
    return _chosen(spark, sf)[0].table(spark)


@query()
def ranker_recall(spark, sf):
    return spark.createDataFrame(_chosen(spark, sf)[0].recall, "k int, found long, recall double")


@query()
def linked_matches(spark, sf):
    """The whole linkage: matches of all anchors by the model that was chosen."""
    from weftlink.plans import linkage

    chosen, s = _chosen(spark, sf)
    return tables.match_lists(linkage.link(*B.sides(spark, sf), chosen, s)[0], B.anchors(spark, sf))


@query()
def stacked_rerank(spark, sf):
    from weftlink.plans import linkage, rerank

    a, t = B.sides(spark, sf)
    truth, s = B.truth(spark, sf), linkage.Settings()
    marks = B.anchors(spark, sf).join(truth.select("anchor_id").distinct().withColumn("_t", F.lit(True)), "anchor_id", "left")
    parts = splits.stratified(marks, "anchor_id", F.col("_t"), s.seed).drop("_t")
    names = list(feat.text_features()) + list(feat.component_features())
    described = feat.assembled(_gathered(spark, sf), [feat.base_features()], names)
    rows = rerank.stacked(blocking.labelled(described, truth).join(parts, "anchor_id"), names, a, t, truth, depths=(3, 5), trees=5, base_depth=4)[1]
    return spark.createDataFrame(rows, "depth int, weight double, threshold double, precision double, f05 double")


@query(f"WITH {S.SCORED} SELECT anchor_id, target_id, mask, p, p >= 0.6 AS keep FROM scored")
def incremental_scoring(spark, sf):
    from weftlink.session import scratch_path
    from weftlink.streaming import scoring

    place = scratch_path(spark, "scoring")
    B.scored(spark, sf).drop("source").write.parquet(f"{place}/pairs")
    for _ in range(2):  # the second run finds nothing to do
        scoring.score_incrementally(spark, f"{place}/pairs", f"{place}/out", lambda b: b.withColumn("keep", F.col("p") >= 0.6), {"threshold": 0.6})
    return scoring.scores(spark, f"{place}/out").drop("batch")
