"""Secret scan with multipart credential linking, in DataFrame operations only.

A pattern's matches and the gaps between them give every span: gap and match lengths are summed along the text. Base kinds
(assign, access, hex) are always reported. Weak candidates alone prove nothing and are reported only where complementary parts
co-occur within ``SCOPE`` code points of the same text:

* opaque (a long mixed string) and short (an assigned secret of 6 to 11 characters) need an access identifier nearby: a base
  access span or a login candidate;
* login (an assigned user, client or key name) needs a secret nearby (assign, hex, opaque or short) and an endpoint nearby.

The interval join of parts is a sweep: over a text's spans in order of their start, the span that ends last before and the one
that starts first after tell the nearest part of each role, so no pairs are made and a text of n spans costs n log n. Every span
is reported with the nearest part of each complementary role in scope: its links. Of parts equally near, the one before counts;
spans that begin alike are ordered by end. A candidate that overlaps a base span is none, nor is a login or an opaque string
that lies in an endpoint; a short one there (a parameter of a URL) counts. Only numbers are kept between the steps, never texts;
a text's spans are all that meets in one group, however long the text.

A null or empty text has no spans. Repeated rows count each (rows are told apart by a number of their own, fixed by writing
the spans once). An empty table gives an empty result. Other columns are not needed and not returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: As long as the least length asks, these find what the patterns without it find: a match is the rest of a run.
ACCESS = rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}+"
HEX = rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LEAST},}}+"

# Weak candidates and endpoints.
OPAQUE = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}+={0,2}"
LOGIN = r"""(?i)\b(access_?key(?:_?id)?|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
ENDPOINT = r"""(?i)\bhttps?://[^\x20\x09-\x0D"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}"""
SHORT_LEAST = 6
SCOPE = 200

#: In the order of reports; the last is never reported.
KINDS = ("assign", "access", "hex", "opaque", "short", "login", "endpoint")
BASE = 3
_NO = {k: i for i, k in enumerate(KINDS)}
IDENTIFIERS, SECRETS = ("access", "login"), ("assign", "hex", "opaque", "short")


def _matches(text: Column, pattern: str, kind_of: Callable[[Column], Column]) -> Column:
    """Array of (gap, size, kind) of a pattern's matches in order; kind is null for a match that isn't reported."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    there = F.filter(pairs, lambda x: x["found"].isNotNull())
    found = F.transform(there, lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["found"]).alias("size"), kind_of(x["found"]).cast("int").alias("kind")))
    return F.when(text.rlike(pattern), found)


def _assign_kind(found: Column) -> Column:
    size = F.char_length(F.regexp_extract(found, ASSIGN, 2))
    return F.when(size >= ASSIGN_LEAST, _NO["assign"]).when(size >= SHORT_LEAST, _NO["short"])


def _opaque_kind(found: Column) -> Column:
    return F.when(found.rlike("[0-9]") & found.rlike("[A-Z]") & found.rlike("[a-z]"), _NO["opaque"])


def _always(kind: str) -> Callable[[Column], Column]:
    return lambda found: F.lit(_NO[kind])


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of every row, and (row, kind, start, end) of every span, endpoints too."""
    text = F.col("_text")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    patterns = {
        "assign": _matches(text, ASSIGN, _assign_kind),
        "access": F.when(F.contains(text, F.lit("AKIA")), _matches(text, ACCESS, _always("access"))),
        "hex": _matches(text, HEX, _always("hex")),
        "opaque": _matches(text, OPAQUE, _opaque_kind),
        "login": _matches(text, LOGIN, _always("login")),
    }
    first = numbered.select("row", "doc_id", "_text", *[c.alias(k) for k, c in patterns.items()])
    # Endpoints are never reported alone: they matter beside any other match.
    ends = F.when(F.coalesce(*patterns).isNotNull(), _matches(text, ENDPOINT, _always("endpoint")))
    found = cut(first.select("row", "doc_id", *patterns, ends.alias("endpoint")))
    lists = F.filter(F.array(*[F.struct(F.lit(i).alias("by"), F.col(k).alias("all")) for i, k in enumerate([*patterns, "endpoint"])]), lambda x: x["all"].isNotNull())
    each = found.select("row", F.explode(lists).alias("p")).select("row", "p.by", F.posexplode("p.all").alias("at", "m"))
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(Window.partitionBy("row", "by").orderBy("at"))
    placed = each.withColumn("end", end.cast("long")).filter("m.kind is not null")
    return found.select("row", "doc_id"), placed.select("row", F.col("m.kind").alias("kind"), (F.col("end") - F.col("m.size")).cast("long").alias("start"), "end")


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """Base spans, and the weak ones with complementary parts in scope; with the nearest part of each other role in scope."""
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # a running least, from the text's end
    kind = F.col("kind")

    def of(kinds) -> Column:
        return kind.isin(*[_NO[k] for k in kinds])

    def sweep(df: DataFrame, roles: dict[str, Column]) -> DataFrame:
        """Of each role's spans, the one that ends last of those up to here, and the one that starts first from here on."""
        df = df.withColumns({f"{r}_before": F.max(F.when(has, F.struct("end", "start", "kind"))).over(before) for r, has in roles.items()})
        return df.withColumns({f"{r}_after": F.min(F.when(has, F.struct("start", "end", "kind"))).over(after) for r, has in roles.items()})

    def gap(role: str) -> Column:
        return F.least(F.col("start") - F.col(f"{role}_before.end"), F.col(f"{role}_after.start") - F.col("end"))

    def near(role: str, most: int) -> Column:
        return F.coalesce(gap(role) <= most, F.lit(False))

    def nearest(role: str, for_kinds) -> Column:
        """Of equally near ones, the one before."""
        sides = [F.struct(*[F.col(f"{role}_{side}.{f}").alias(f) for f in ("kind", "start", "end")]) for side in ("before", "after")]
        first = F.coalesce(F.col("start") - F.col(f"{role}_before.end") == gap(role), F.lit(False))
        return F.when(of(for_kinds) & near(role, scope), F.when(first, sides[0]).otherwise(sides[1])).alias(role)

    swept = sweep(spans, {"base": kind < BASE, "endpoint": of(["endpoint"])})
    outside = ~F.coalesce(F.col("endpoint_before.end") > F.col("start"), F.lit(False))
    alone = ~near("base", -1) & (of(["short"]) | outside)
    parts = swept.filter((kind < BASE) | of(["endpoint"]) | alone)
    parts = sweep(parts, {"identifier": of(IDENTIFIERS), "secret": of(SECRETS)})
    weak_secret = of(["opaque", "short"]) & near("identifier", scope)
    weak_login = of(["login"]) & near("secret", scope) & near("endpoint", scope)
    kept = parts.filter((kind < BASE) | weak_secret | weak_login)
    return kept.select("row", "kind", "start", "end", nearest("identifier", SECRETS), nearest("secret", IDENTIFIERS), nearest("endpoint", SECRETS + IDENTIFIERS))


ROLES = ("identifier", "secret", "endpoint")
_PART = "struct<kind:int,start:bigint,end:bigint>"


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and spans, an array of (start, kind, end, identifier, secret, endpoint), of every row.

    kind is a place in KINDS; the last three are the parts (kind, start, end) of the other roles that the span is linked to, the
    nearest in scope of each, null for none: a secret's identifier, an identifier's secret, and the endpoint of either.
    """
    rows, spans = _spans(docs)
    gathered = _linked(spans, scope).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", *ROLES))).alias("spans"))
    none = F.array().cast(f"array<struct<start:bigint,kind:int,end:bigint,{','.join(f'{r}:{_PART}' for r in ROLES)}>>")
    return rows.join(gathered, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def _named(x: Column) -> Column:
    return F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, _named), ",")


def _links(spans: Column) -> Column:
    """span>part for every link, in the order of spans and roles."""
    return F.array_join(F.flatten(F.transform(spans, lambda x: F.array_compact(F.array(*[F.when(x[r].isNotNull(), F.concat(_named(x), F.lit(">"), _named(x[r]))) for r in ROLES])))), ",")


def query(spark, sf_dir):
    """op8: counts and a digest of the base spans, all spans, and the links between parts."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == _NO[kind])).cast("long").alias(f"n_{kind}")

    counts = [of(kind) for kind in KINDS[:BASE]]
    base = F.filter("spans", lambda x: x["kind"] < BASE)
    return found.select("doc_id", *counts, F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"), _links(F.col("spans")).alias("links"))


def counts(spark, sf_dir):
    """A side query of op8: how many base spans of each kind, which SQL can tell too."""
    return query(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


COUNTS = r"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16))::BIGINT AS n_hex
FROM documents
"""
