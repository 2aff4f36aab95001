"""The driver's tables as records to link: source 1 are anchors, sources 2 and 3 targets.

Three parts in a row are one firm: the first is its anchor, the others are listings in the
two target sources. Digits of MD5 sums, which Spark and DuckDB both have, choose words,
places and what each listing does to them. Most listings are of the firm itself; some are
of a namesake elsewhere or of another tenant of the house. The expressions are the same
text in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftlink.operators import blocking, cells, pairwise
from weftlink.operators.records import preprocess
from weftlink.session import ready, scratch_path, written

_HEX = "0123456789abcdef"


def _word(h: str, at: int, syllables: int) -> str:
    one = lambda i, letters: f"translate(substr({h}, {i}, 1), '{_HEX}', '{letters}')"
    return " || ".join(f"{one(at + 2 * k, 'bcdfghjklmnprstv')} || {one(at + 2 * k + 1, 'aeiouaeiouaeioua')}" for k in range(syllables))


def _capital(x: str) -> str:
    return f"upper(substr({x}, 1, 1)) || substr({x}, 2)"


def _digits(h: str, at: int, n: int) -> str:
    return f"translate(substr({h}, {at}, {n}), '{_HEX}', '0123456789012345')"


def _choice(h: str, at: int, *options: tuple[str, str], other: str) -> str:
    """The first option whose digit is not below the one at a place of ``h``."""
    return "CASE " + " ".join(f"WHEN substr({h}, {at}, 1) <= '{upto}' THEN {x}" for upto, x in options) + f" ELSE {other} END"


#: Layers of expressions over ``part``; each sees the columns of the one before.
LAYERS: tuple[tuple[str, ...], ...] = (
    ("p_partkey AS k", "p_name", "p_brand", "p_size", "CAST(floor(p_partkey / 3.0) AS BIGINT) AS e", "p_partkey % 3 AS s"),
    (
        "*",
        "md5(CAST(e AS STRING) || '/firm') AS hf",
        "md5(CAST(k AS STRING) || '/listing') AS hl",
        "md5(CAST(e % 127 AS STRING) || '/family') AS hn",
        "md5(CAST(CAST(floor(e / 24.0) AS BIGINT) AS STRING) || '/town') AS ht",
        "md5(CAST(CAST(floor(e / 5.0) AS BIGINT) AS STRING) || '/street') AS hs",
    ),
    (
        "*",
        f"CASE WHEN s = 0 THEN 'anchor' ELSE {_choice('hl', 1, ('b', repr('same')), ('d', repr('namesake')), other=repr('tenant'))} END AS kind",
        f"{_word('hf', 1, 3)} AS w1",
        f"{_word('hn', 1, 2)} AS w2",
        f"{_choice('hf', 10, ('0', repr(' Clinic')), ('1', repr(' Academy')), ('2', repr(' Foods')), other=repr(''))} AS trade",
        f"{_choice('hl', 3, ('3', repr(' Ltd.')), ('6', repr(' Limited')), ('8', repr(' Inc')), ('9', repr(' LLC')), ('a', repr(' Pvt. Ltd.')), ('b', repr(' plc')), other=repr(''))} AS form",
        f"{_choice('hs', 9, ('5', repr(' Street')), ('9', repr(' Road')), ('c', repr(' Lane')), other=repr(' Avenue'))} AS way",
        f"{_choice('ht', 20, ('6', repr('Norvia')), ('d', repr('Kestria')), other=repr('Palvo'))} AS land",
        f"{_choice('hf', 14, ('0', 'CASE WHEN hl < ' + repr('8') + ' OR s = 0 THEN ' + repr('mail') + ' ELSE ' + repr('') + ' END'), ('1', repr('web')), ('2', repr('phone')), other=repr(''))} AS contact",
    ),
    (
        "*",
        f"CASE WHEN substr(hf, 20, 1) = '7' THEN trade ELSE '' END AS suffix",
        f"CASE WHEN s = 0 THEN w1 || ' ' || w2 ELSE {_choice('hl', 2, ('5', 'w1 || ' + repr(' ') + ' || w2'), ('7', 'w2 || ' + repr(' ') + ' || w1'), ('9', 'substr(w1, 1, 2) || substr(w1, 4) || ' + repr(' ') + ' || w2'), ('b', 'substr(w1, 1, 3) || substr(w1, 5, 1) || substr(w1, 4, 1) || substr(w1, 6) || ' + repr(' ') + ' || w2'), ('c', 'upper(w1) || ' + repr(' & ') + ' || w2'), ('d', 'substr(w1, 1, 1) || substr(w2, 1, 1)'), ('e', 'w1 || ' + repr(' ') + ' || w2 || ' + repr(' Svcs')), other='w1')} END AS words",
        f"CASE WHEN s > 0 AND substr(hl, 4, 1) IN ('a', 'b') THEN CAST(p_size AS STRING) ELSE '1' || {_digits('hf', 11, 2)} END AS number",
        f"CASE WHEN kind = 'namesake' OR (s > 0 AND substr(hl, 4, 1) = 'e') THEN hl ELSE hs END AS h_street",
        f"CASE WHEN kind = 'namesake' OR (s > 0 AND substr(hl, 4, 1) = 'e') THEN hl ELSE ht END AS h_town",
        "CASE WHEN s > 0 AND substr(hl, 4, 1) IN ('8', '9') THEN CASE way WHEN ' Street' THEN ' St' WHEN ' Road' THEN ' Rd.' WHEN ' Lane' THEN ' Ln' ELSE ' Ave' END ELSE way END AS short_way",
        f"CASE contact WHEN 'mail' THEN 'Desk@' || w1 || '.Example.org, ' WHEN 'web' THEN 'www.' || w1 || '.example/start, ' WHEN 'phone' THEN 'Tel: +49 (030) 55' || {_digits('hf', 24, 4)} || ', ' ELSE '' END AS reach",
    ),
    (
        "'S' || CAST(1 + s AS STRING) || '-' || CAST(k AS STRING) AS entity_id",
        f"CASE kind WHEN 'tenant' THEN p_name || ' ' || p_brand ELSE {_capital('words')} || suffix || form END AS business_name",
        f"CASE WHEN s > 0 AND substr(hl, 4, 1) = 'c' THEN '' ELSE reach || number || ' ' || {_capital('(' + _word('h_street', 1, 3) + ')')} || short_way || CASE WHEN substr(hf, 13, 1) < 'd' THEN ', Harbour Side, ' ELSE ', ' END || {_capital('(' + _word('h_town', 1, 3) + ')')} || ', ' || {_capital('(' + _word('h_town', 9, 2) + ')')} || CASE WHEN s > 0 AND substr(hl, 4, 1) = 'd' THEN '' ELSE ' 4' || {_digits('h_street', 11, 4)} END END AS business_address",
        "CASE WHEN s > 0 AND substr(hl, 5, 1) = '0' THEN '' WHEN s > 0 AND substr(hl, 5, 1) = '1' THEN 'Palvo' ELSE land END AS country",
        "kind",
        "'S1-' || CAST(3 * e AS STRING) AS firm_id",
    ),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    df = df.repartition(4 * spark.sparkContext.defaultParallelism)  # a small file is one task
    for layer in LAYERS:
        df = df.selectExpr(*layer)
    return df


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir).select("entity_id", "business_name", "business_address", "country")


_stored: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A prepared table, written once for an application and read by every query after that."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path, df = scratch_path(spark, name), make()
        written(df, path)
        _stored[key] = path, df.schema
    path, schema = _stored[key]
    return ready(spark).read.schema(schema).parquet(path)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "records", lambda: preprocess(raw_records(spark, sf_dir), ascii_only=True))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = records(spark, sf_dir)
    one = F.col("entity_id").startswith("S1-")
    return r.where(one), r.where(~one)


def n_targets(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").count()


def key_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keys of anchors, and of targets without the too frequent ones."""
    return blocking.memory_keys(*sides(spark, sf_dir), n_targets(spark, sf_dir))


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the in-memory mode."""
    return blocking.memory_candidates(*sides(spark, sf_dir), n_targets(spark, sf_dir))


def _dealt(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Candidates of as many cells as a stage has tasks lie evenly; those of fewer are dealt out by anchor."""
    n, cores = 4 * spark.sparkContext.defaultParallelism, spark.sparkContext.defaultParallelism
    t = n_targets(spark, sf_dir)
    a, b = cells.blocks(table(spark, sf_dir, "part").count() - t, t, cores)
    return df if a * b >= n else df.repartition(n, "anchor_id")


def measured(spark: SparkSession, sf_dir: str, measures: Callable, fields: tuple[str, ...], columns: tuple[str, ...], made: Callable[[DataFrame], DataFrame] | None = None, without: int = 0) -> DataFrame:
    """Candidates of the in-memory mode with measures that are worked out where they are found.

    ``made`` gives the records further fields, once for each and not for each of its pairs.
    Candidates of the rules ``without`` are left out.
    """
    both = [made(x) if made else x for x in sides(spark, sf_dir)]
    return blocking.memory_candidates(*both, n_targets(spark, sf_dir), measures=measures, fields=fields, columns=columns, without=without)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, dealt out evenly: what is worked out for pairs follows the files they lie in."""
    return _once(spark, sf_dir, "pairs", lambda: _dealt(spark, sf_dir, retrieved(spark, sf_dir)))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are read once: the stored ones if there are any, else as their cells send them out."""
    return pairs(spark, sf_dir) if (spark.sparkContext.applicationId, sf_dir, "pairs") in _stored else retrieved(spark, sf_dir)


def found_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(anchor_id, targets): the candidates of each anchor in a few lists, so that no row moves for each of them."""
    return blocking.memory_candidates(*sides(spark, sf_dir), n_targets(spark, sf_dir), listed=True)


def _with_source(df: DataFrame) -> DataFrame:
    return df.select("anchor_id", "target_id", "mask", "p", F.concat(F.lit("S"), F.substring("target_id", 2, 1)).alias("source"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with p, a fixed mean of similarities."""

    def make() -> DataFrame:
        df = measured(spark, sf_dir, pairwise.mean_similarity, ("address_norm", "country_norm"), ("p",))
        return _with_source(_dealt(spark, sf_dir, df))

    return _once(spark, sf_dir, "scored", make)


def scored_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored candidates that no rule of names finds: of the stored ones if there are any, else worked out alone."""
    if (spark.sparkContext.applicationId, sf_dir, "scored") in _stored:
        return scored(spark, sf_dir).where(F.col("mask").bitwiseAND(blocking.NAMED) == 0)
    fields = ("address_norm", "country_norm")
    return _once(spark, sf_dir, "scored_by_place", lambda: measured(spark, sf_dir, pairwise.mean_similarity, fields, ("p",), without=blocking.NAMED))


def scored_from(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    """The scored candidates with p of ``least`` or more: of the stored ones if there are any, else the others never leave their cells."""
    if (spark.sparkContext.applicationId, sf_dir, "scored") in _stored:
        return scored(spark, sf_dir).where(F.col("p") >= least)
    return _with_source(measured(spark, sf_dir, pairwise.sure_similarity(least), ("address_norm", "country_norm"), ("p",)))


#: Anchors of a part of packed scores, by the mean; a part is held whole by its task.
PART = 2_000


def context(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The context of each scored candidate, six places, from lists of p dealt out by anchor; none if scores are stored."""
    if (spark.sparkContext.applicationId, sf_dir, "scored") in _stored:
        return None
    n = max(4 * spark.sparkContext.defaultParallelism, -(-sides(spark, sf_dir)[0].count() // PART))
    lists = blocking.memory_candidates(*sides(spark, sf_dir), n_targets(spark, sf_dir), measures=pairwise.mean_similarity, fields=("address_norm", "country_norm"), packed=True)
    schema = ", ".join(["anchor_id string, target_id string", *[f"{c} double" for c in pairwise.CONTEXT]])
    return lists.repartition(n, "anchor_id").mapInArrow(lambda batches: cells.unpacked(batches, pairwise.context), schema)


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("entity_id like 'S1-%'").select(F.col("entity_id").alias("anchor_id"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings of each firm itself."""
    own = F.col("kind") == "same"
    return _bound(spark, sf_dir).select("kind", "firm_id", "entity_id").where(own).select(F.col("firm_id").alias("anchor_id"), F.col("entity_id").alias("target_id"))
