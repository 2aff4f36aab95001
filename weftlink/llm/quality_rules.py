"""Quality rules with host-level verdicts, in DataFrame expressions only.

Every document is measured once (one narrow pass over its whole text), its rule
failures are added up per host, the failure rate of each host is shrunk with a
beta prior fitted to all hosts by moments, and the verdict on the
host is joined back. Measures are kept as a narrow table, so the text is read
once; the sums per host are partial on the map side, so a host with a third of
all rows costs a few rows in the shuffle. The join with the verdicts carries no
hint: Spark broadcasts them while they are below its checked size and otherwise
splits the hot host with its skew join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm.text import WORD_CHAR, small_side, sum_of, words
from weftlink.session import checkpointed

SYMBOL = r"[#*$%&|<>]"
#: Rejected hosts up to this number are broadcast, about 10 MB.
BROADCAST_HOSTS = 100_000


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; the first two decide on a document alone."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    min_word_chars: int = 3
    max_word_chars: int = 10
    max_host_rate: float = 0.5
    prior_strength: float = 10.0


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A null or empty text measures 0 everywhere. Three-word windows are compared by
    64-bit hashes within their own document.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({"_w": words(F.col(text)), "_l": F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD_CHAR))})
    w = F.col("_w")
    triple = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    out = out.withColumn("_h", triple)
    h = F.col("_h")
    ordered = F.when(F.size(F.array_distinct(h)) == F.size(h), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    out = out.withColumn("_s", ordered)
    s = F.col("_s")
    same = lambda x, i, j: F.when(j >= 0, F.get(s, j)["h"] == x["h"])
    hit = F.transform(s, lambda x, i: F.when(F.coalesce(same(x, i, i - 1), F.lit(False)) | F.coalesce(same(x, i, i + 1), F.lit(False)), x["i"]).otherwise(F.lit(-1)))
    out = out.withColumn("_p", F.sort_array(F.filter(hit, lambda x: x >= 0)))
    p, k = F.col("_p"), F.size("_p")
    covered = F.when(k == 0, F.lit(0).cast("long")).otherwise(3 + sum_of(F.zip_with(F.slice(p, F.lit(1), k - 1), F.slice(p, F.lit(2), k - 1), lambda a, b: F.least(F.lit(3), b - a))))
    return out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOL)).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": covered,
        }
    ).drop("_w", "_l", "_h", "_s", "_p")


def base_failed(r: Rules) -> Column:
    return (F.col("n_words") < r.min_words) | (100 * F.col("n_repeat_words") > r.max_repeat_percent * F.col("n_words"))


def soft_failed(r: Rules) -> Column:
    """Rules that a document may break on a good host."""
    n = F.col("n_words")
    return (100 * F.col("n_symbols") > r.max_symbol_percent * n) | (100 * F.col("n_dup_lines") > r.max_dup_line_percent * F.col("n_lines")) | (F.col("word_chars") < r.min_word_chars * n) | (F.col("word_chars") > r.max_word_chars * n)


def host_verdicts(docs: DataFrame, r: Rules, host: str = "host") -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_rejected) from rows with ``failed``.

    The prior is beta(a, b) with the mean over all documents and the variance between hosts
    that is left when the variance of sampling so many documents of each is taken off;
    hosts count by their documents. Where nothing is left, hosts do not differ, and the
    prior weighs as much as all documents, or ``prior_strength`` if that is more.
    """
    hosts = checkpointed(docs.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")))
    n, k = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    hosts_, w, bad, squares, rates = hosts.agg(F.count("*"), F.sum(n), F.sum(k), F.sum(n * n), F.sum(k * k / n)).first()
    w, bad = w or 0.0, bad or 0.0
    m = bad / w if w else 0.0
    free = w - squares / w - (hosts_ - 1) if w else 0.0
    rho = (rates - w * m * m - m * (1 - m) * (hosts_ - 1)) / (m * (1 - m) * free) if 0 < m < 1 and free > 1e-9 else 0.0
    strength = max(1 / rho - 1, 1e-6) if rho > 1e-9 else max(w, r.prior_strength)
    shrunk = (F.col("n_failed") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", F.round(shrunk, 6)).withColumn("host_rejected", shrunk > r.max_host_rate)


def judge(df: DataFrame, r: Rules = Rules(), text: str = "text", host: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """The measures and verdicts of every row of ``df``, with the columns in ``keep``.

    A row goes if it breaks one of the first two rules, or if its host is rejected
    and it breaks any other rule; clean rows of a rejected host stay. A null host
    is a host of its own. Repeated rows and ties are judged alike and all returned; a very
    long text is measured whole; an empty table gives no rows. Further columns of ``df``
    are not read. A column in ``keep`` stands in place of a result of its name.
    """
    own = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("_keep"), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.col(f"`{text}`").alias("_text"))
    m = measured(own, "_text").drop("_text").withColumn("base_failed", base_failed(r))
    m = checkpointed(m.withColumn("soft_failed", soft_failed(r)).withColumn("failed", F.col("base_failed") | F.col("soft_failed")))
    out = m.join(host_verdicts(m, r), "host")
    out = out.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_rejected") & F.col("soft_failed")))
    return out.select(*[F.col("_keep")[f"c{i}"].alias(c) for i, c in enumerate(keep)], *[c for c in out.columns if c not in keep and c != "_keep"])


def kept_documents(df: DataFrame, r: Rules = Rules(), text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``df`` that stay, with the columns of ``df``.

    Texts are measured once: the rows that break neither of the first two rules are written
    down with their verdicts, from which the sums per host are made, so the disk holds the
    texts once more and none is shuffled.
    """
    columns = df.columns
    own = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("_row"), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.col(f"`{text}`").alias("_text"))
    m = measured(own, "_text").withColumns({"base_failed": base_failed(r), "soft_failed": soft_failed(r)})
    m = checkpointed(m.select("host", "base_failed", "soft_failed", (F.col("base_failed") | F.col("soft_failed")).alias("failed"), F.when(~F.col("base_failed"), F.col("_row")).alias("_row")))
    verdicts = small_side(host_verdicts(m.select("host", "failed"), r).where("host_rejected").select("host", "host_rejected"), BROADCAST_HOSTS)
    out = m.where(~F.col("base_failed")).join(verdicts, "host", "left").where(~(F.coalesce("host_rejected", F.lit(False)) & F.col("soft_failed")))
    return out.select(*[F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(columns)])
