"""Secret scans with multipart credential linking, in DataFrame expressions only.

Strong spans (assignments, access identifiers, long hexadecimal runs) are reported by
themselves. Weak candidates (identifiers, short secrets, endpoints) are common in clean
text, so each is reported only if a part of another role lies in the same scope. Scopes
are blank-line separated blocks. The interval join runs inside each row, block by block:
the parts of a role in a block are summed up by their first end and their last start,
which is all that a part needs to know whether one of them lies beside it. So the work of
a text grows with its parts, not with their pairs; there is no shuffle and no row key, and
a lost executor costs its own rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base patterns; ASCII letters in either case for the first.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak candidates by role.
WEAK_ID = r"""(?i)(?<![A-Za-z0-9\x01])(?:access_?key_?id|client_?id|user_?name|user|login|account_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{4,}"""
WEAK_SECRET = r"""(?i)(?<![A-Za-z0-9\x01])(?:pass|pwd|passphrase|credentials?|auth|private_?key|access_?key|signature)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@#%-]{6,}"""
ENDPOINT = r"""(?i)https?://[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![A-Za-z0-9\x01])(?:host|hostname|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9:/_.-]{4,}"""
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: What parts scopes; no pattern matches across a line.
BLANK_LINE = r"\n(?:[\x20\t\r]*\n)+"
SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"
#: Stands for what a strong span covers when weak parts are looked for; no pattern matches it.
COVERED = "\x01"


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def sums_before(lengths: Column, width: int = 32) -> Column:
    """For each entry the sum of those before it; entries are summed in groups, and groups of groups.

    Spark has no running sum over an array; groups keep the work near the number of entries.
    """

    def in_groups(a: Column, depth: int) -> Column:
        plain = lambda v: F.transform(v, lambda _, i: total(F.slice(v, 1, i)))
        if depth == 0:
            return plain(a)
        starts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int"))
        groups = F.transform(starts, lambda k: F.slice(a, k * width + 1, F.lit(width)))
        bases = in_groups(F.transform(groups, total), depth - 1)
        return F.flatten(F.zip_with(groups, bases, lambda g, b: F.transform(g, lambda _, i: b + total(F.slice(g, 1, i)))))

    few, many = in_groups(lengths, 0), in_groups(lengths, 2)
    return F.when(F.size(lengths) <= width, few).otherwise(many)


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Leftmost non-overlapping matches as (start, ord, kind, end), in code points.

    The pieces between matches give the positions. ``keep`` sees the matched text.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
    item = lambda x: F.struct((x["at"] + x["whole"] - F.length(x["m"])).alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), (x["at"] + x["whole"]).alias("end"))
    rows = F.arrays_zip(sums_before(lengths).alias("at"), lengths.alias("whole"), found.alias("m"))
    rows = F.filter(rows, lambda x: keep(x["m"])) if keep else rows
    return F.when(text.rlike(pattern), F.transform(rows, item)).otherwise(F.array().cast(SPAN))


def long_value(m: Column) -> Column:
    """Whether group 2 of an assignment has 8 characters or more."""
    return F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8


def listed(array: Column) -> Column:
    """``kind:start:end`` by start, then kind."""
    return F.array_join(F.transform(F.sort_array(array), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, found: Column) -> Column:
    """``text`` with all that the spans cover made unmatchable; lengths stay. The spans are disjoint and in order."""
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(found, i - 1)["end"])
    parts = F.transform(found, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), F.repeat(F.lit(COVERED), s["end"] - s["start"])))
    rest = F.substring(text, F.element_at(found, -1)["end"] + 1, F.length(text))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(F.array_join(parts, ""), rest))


def _beside(role: Column):
    """Whether a span has one of ``role`` wholly before or after it."""
    first, last = F.array_min(F.transform(role, lambda s: s["end"])), F.array_max(F.transform(role, lambda s: s["start"]))
    return F.struct(first.alias("first"), last.alias("last"))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_assign, n_access, n_hex, base_sha256, spans and n_linked, in place of columns of those names.

    ``spans`` has the base spans and the linked weak ones; weak parts are looked for in what
    base spans leave. A weak secret needs an identifier or an endpoint beside it in its
    scope, a weak identifier needs a secret, an endpoint needs a secret, at any distance.
    Null counts as empty; very long texts are scanned whole; rows are independent, so
    repeated rows and ties agree, and an empty table gives none. All other columns stay as
    they are, whatever their names.
    """
    columns = [c for c in df.columns if c not in ADDED]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    out = df.select(row.alias("row"), body.alias("t"))
    t = F.col("t")
    out = out.withColumns({"assign": spans(t, ASSIGN, "assign", long_value), "access": spans(t, ACCESS, "access"), "hex": spans(t, HEX, "hex")})
    weak = t.rlike(WEAK_ID) | t.rlike(WEAK_SECRET) | t.rlike(ENDPOINT)
    # blocks of a text with weak parts, and where each begins
    out = out.withColumn("b", F.when(weak, F.split(t, BLANK_LINE, -1)).otherwise(F.array().cast("array<string>")))
    gaps = F.regexp_extract_all(t, F.lit(BLANK_LINE), F.lit(0))
    sizes = F.transform("b", lambda b, i: F.length(b) + F.coalesce(F.length(F.get(F.when(weak, gaps), i)), F.lit(0)))
    out = out.withColumn("sizes", sizes).withColumn("at", sums_before(F.col("sizes")))
    out = out.withColumn("b", F.zip_with("b", "at", lambda b, at: F.struct(b.alias("t"), at.alias("at"), spans(b, ASSIGN, "assign", long_value).alias("assign"), spans(b, ACCESS, "access").alias("access"), spans(b, HEX, "hex").alias("hex"))))
    rest = lambda x: masked(masked(masked(x["t"], x["assign"]), x["access"]), x["hex"])
    out = out.withColumn("b", F.transform("b", lambda x: F.struct(x["at"], x["assign"], x["access"], x["hex"], rest(x).alias("t"))))
    out = out.withColumn("b", F.transform("b", lambda x: F.struct(x["at"], x["assign"], x["access"], x["hex"], spans(x["t"], WEAK_ID, "weak_id").alias("id"), spans(x["t"], WEAK_SECRET, "weak_secret").alias("secret"), spans(x["t"], ENDPOINT, "endpoint").alias("end"))))
    out = out.withColumn("b", F.transform("b", lambda x: F.struct(x["at"], x["id"], x["secret"], x["end"], _beside(F.concat(x["assign"], x["hex"], x["secret"])).alias("secrets"), _beside(F.concat(x["access"], x["id"], x["end"])).alias("others"))))
    near = lambda s, role: (role["first"] <= s["start"]) | (role["last"] >= s["end"])
    moved = lambda s, at: F.struct((s["start"] + at).alias("start"), s["ord"], s["kind"], (s["end"] + at).alias("end"))
    own = lambda x: F.transform(F.concat(F.filter(x["id"], lambda s: near(s, x["secrets"])), F.filter(x["secret"], lambda s: near(s, x["others"])), F.filter(x["end"], lambda s: near(s, x["secrets"]))), lambda s: moved(s, x["at"]))
    out = out.withColumn("links", F.flatten(F.transform("b", own)))
    strong = F.concat("assign", "access", "hex")
    values = {
        "n_assign": F.size("assign").cast("long"),
        "n_access": F.size("access").cast("long"),
        "n_hex": F.size("hex").cast("long"),
        "base_sha256": F.sha2(listed(strong).cast("binary"), 256),
        "spans": listed(F.concat(strong, F.coalesce("links", F.array().cast(SPAN)))),
        "n_linked": F.coalesce(F.size("links"), F.lit(0)).cast("long"),
    }
    return out.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(columns)], *[v.alias(k) for k, v in values.items()])


ADDED = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")
