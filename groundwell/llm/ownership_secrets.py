"""Secrets in texts, judged by who else holds them.

Candidates are found by patterns. Their digests are counted over the whole corpus by distinct
repositories and owners: a value that several owners hold is a copied example, one that a single
owner holds in few repositories looks like a live credential. Spans of the base patterns always
count; looser candidates count only if they look live. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundwell.functions.bind import let

from .common import stored, whole

# The base patterns, the group that holds the value, and its least length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    # The added kind: long mixed-case words with digits, not part of a longer word.
    "owned": (r"(?<![A-Za-z0-9+/_.=-])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}", 0, 24),
}
#: A value is live if no more owners and repositories than these hold it.
MOST_OWNERS, MOST_REPOSITORIES = 1, 3


def _found(text: Column, pattern: str, group: int) -> Column:
    """Matches of a pattern, in order: code points since the last match, in the match, in the value, and its digest."""
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    values = F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda v: F.struct(F.length(v).alias("n"), F.sha2(v, 256).alias("digest")))
    widths = F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length)
    # the gap after the last match has no match beside it
    return F.when(F.regexp_like(text, p), F.transform(
        values, lambda v, i: F.struct(F.get(gaps, i).alias("gap"), F.get(widths, i).alias("width"), v["n"].alias("n"), v["digest"].alias("digest"))
    ))


def candidates(docs: DataFrame, key: str, text: str, owner: Column, repository: Column) -> DataFrame:
    """One row per text: _row, key, _owner, _repo and an array of matches per kind, without the text."""
    return docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("_owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("_repo"), whole(F.col(text)).alias("_text"),
    ).select(
        "_row", "_key", "_owner", "_repo", *[_found(F.col("_text"), p, g).alias(kind) for kind, (p, g, _) in KINDS.items()]
    )


def spans(found: DataFrame) -> DataFrame:
    """One row per candidate that is long enough: _row, _owner, _repo, kind, order, start, end, digest."""
    out = None
    for order, (kind, (_, _, least)) in enumerate(KINDS.items()):
        rows = found.where(F.col(kind).isNotNull()).select("_row", "_owner", "_repo", F.posexplode_outer(kind).alias("_at", "_m"))
        upto = W.partitionBy("_row").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
        placed = rows.withColumn("_end", F.sum(F.col("_m.gap") + F.col("_m.width")).over(upto))
        part = placed.where(F.col("_m.n") >= least).select(
            "_row", "_owner", "_repo", F.lit(kind).alias("kind"), F.lit(order).alias("order"),
            (F.col("_end") - F.col("_m.width")).alias("start"), F.col("_end").alias("end"), F.col("_m.digest").alias("digest"),
        )
        out = part if out is None else out.union(part)
    return out


def ownership(found: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """digest, n_owners, n_repositories, live. Rows are made distinct map-side before they meet, so a widely
    copied value costs one row per task, owner and repository."""
    held = found.select("digest", "_owner", "_repo").distinct()
    return held.groupBy("digest").agg(
        F.count_distinct("_owner").alias("n_owners"), F.count_distinct("_owner", "_repo").alias("n_repositories")
    ).withColumn("live", (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: Column | None = None,
         repository: Column | None = None, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Spans of each whole text: key, found (array of start, end, kind, live, in order), one row per row of `docs`.

    `owner` and `repository` default to the columns source and (source, lang). Null text is empty; null owners
    and repositories count as one. A candidate of the added kind stands only where it looks live and overlaps
    no base span. Repeated rows repeat, null keys stay, other columns are ignored.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    found = stored(candidates(docs, key, text, owner, repository))
    placed = stored(spans(found))
    judged = placed.join(ownership(placed, most_owners, most_repositories), "digest")
    kept = judged.where((F.col("kind") != "owned") | F.col("live")).groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "order", "end", "kind", "live"))).alias("_all")
    )
    base = F.filter("_all", lambda s: s["kind"] != "owned")
    apart = F.filter("_all", lambda s: (s["kind"] != "owned") | ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string,live:boolean>>")
    return found.select("_row", "_key").join(kept.select("_row", apart.alias("_kept")), "_row", "left").select(
        F.col("_key").alias(key), F.coalesce("_kept", none).alias("found")
    )


def digest_columns(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans of `scan`."""
    def listed(items):
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["kind"] != "owned")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        key, *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def redact(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping spans replaced by `mask`. Spans come in order of their starts."""
    kind = "array<struct<start:bigint,end:bigint>>"
    last = F.lit(None).cast("struct<start:bigint,end:bigint>")

    def add(acc, s):
        open_, span = acc["open"], F.struct(s["start"].alias("start"), s["end"].alias("end"))
        meets = open_.isNotNull() & (open_["end"] > s["start"])
        return F.struct(
            F.when(meets | open_.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(open_))).alias("done"),
            F.when(meets, F.struct(open_["start"].alias("start"), F.greatest(open_["end"], s["end"]).alias("end"))).otherwise(span).alias("open"),
        )

    joined = F.aggregate(found, F.struct(F.array().cast(kind).alias("done"), last.alias("open")), add, lambda acc: F.concat(acc["done"], F.array(acc["open"])))

    def build(spans):
        starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["end"]))
        stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("bigint")))
        pieces = F.zip_with(starts, stops, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
        return F.array_join(pieces, mask)

    return F.when(F.size(found) == 0, text).otherwise(let(joined, build))


def mask_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`docs` with the secrets of each text masked; all columns stay."""
    marked = docs.withColumn("_secret_row", F.xxhash64(key, text))
    found = scan(marked, "_secret_row", text).where(F.size("found") > 0).groupBy("_secret_row").agg(F.first("found").alias("_secret_spans"))
    joined = marked.join(found.hint("shuffle_hash"), "_secret_row", "left")
    masked = F.when(F.col("_secret_spans").isNull(), F.col(text)).otherwise(redact(F.col(text), F.col("_secret_spans"), mask))
    return joined.withColumn(text, masked).select(*docs.columns)
