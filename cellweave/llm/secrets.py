"""Secret scan: pattern spans plus bare tokens that corpus-wide ownership shows to be somebody's own.

Everything on the main path is DataFrame expressions. Offsets come from
splitting a text by a pattern and summing the lengths of gaps and matches, so
no row-wise Python is needed. Candidate hashes are aggregated by distinct
repositories and owners: a value that many owners share, or many repositories
of one owner, is a copied example, one that stays with a few is live-looking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The base patterns, kinds in listed order. The minimum length is that of the group named last.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 18 or more after AKIA is the same set of spans as every AKIA run of which the short ones are dropped.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Added by the method: long tokens of letters in both cases and digits, wherever they stand.
BARE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9a-z+/_=-]*[A-Z])(?=[0-9A-Z+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "bare")


def _spans(text: Column, kind: str, pattern: str, kept: Column | None = None) -> Column:
    """Array of (start, end, kind, value) of the pattern's matches; ``kept``: a flag for each match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    kept = F.transform(found, lambda x: F.lit(True)) if kept is None else kept
    rows = F.aggregate(
        F.arrays_zip(found.alias("value"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), kept.alias("kept")),
        F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("at"),
            F.when(
                x["kept"],
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(x["gap"])).alias("start"),
                            (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("end"),
                            F.lit(KINDS.index(kind)).alias("kind"),
                            x["value"].alias("value"),
                        )
                    ),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    none = F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def find_candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, and ``spans``: array of (start, end, kind, secret) with ends exclusive, in code points.

    ``secret`` is the value itself: group 2 for assignments, the match otherwise.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    value = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1))
    assign = _spans(t, "assign", ASSIGN, F.transform(value, lambda v: F.length(v) >= 12))
    spans = F.concat(assign, _spans(t, "access", ACCESS), _spans(t, "hex", HEX), _spans(t, "bare", BARE))
    out = docs.select(*keep, spans.alias("spans"))
    secret = lambda x: F.when(x["kind"] == 0, F.regexp_extract(x["value"], ASSIGN, 1)).otherwise(x["value"])
    return out.withColumn("spans", F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["kind"], F.sha2(secret(x), 256).alias("secret"))))


def ownership(candidates: DataFrame, repo: str, owner: str) -> DataFrame:
    """(secret, n_repos, n_owners, n_spans) over the corpus; distinct pairs are combined before they are counted, so a value found everywhere costs a row per repository."""
    each = candidates.groupBy("secret", repo, owner).agg(F.count(F.lit(1)).alias("n"))
    by_repo = each.groupBy("secret", repo).agg(F.sum("n").alias("n"))
    by_owner = each.select("secret", owner).distinct().groupBy("secret").agg(F.count(owner).alias("n_owners"))
    return by_repo.groupBy("secret").agg(F.count(repo).alias("n_repos"), F.sum("n").alias("n_spans")).join(by_owner, "secret")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source", max_owners: int = 2, max_repos: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans`` (start, end, kind name, secret hash, n_owners, live).

    Base spans always stay. A bare token is added when at most ``max_owners``
    owners and ``max_repos`` repositories hold its value and it overlaps no
    base span of its document. ``live`` marks values of at most so many of
    both; others are copied examples. A null or empty text has no spans. A
    null owner counts as no owner, a null repository as none. Rows that repeat a doc_id are
    answered one by one. Extra columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("_d"), F.col(repo).cast("string").alias("_r"), F.col(owner).cast("string").alias("_o"), F.col(text).alias("_t"))
    found = materialize(find_candidates(rows, "_t", ("_d", "_r", "_o")).withColumn("_row", F.monotonically_increasing_id()), "secrets")
    each = found.select("_row", "_r", "_o", F.explode("spans").alias("s")).select("_row", "_r", "_o", "s.*")
    stats = ownership(each, "_r", "_o")
    told = each.join(stats, "secret").withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    told = told.filter((F.col("kind") < KINDS.index("bare")) | F.col("live"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    per = told.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", F.col("kind").alias("k"), "end", kind.alias("kind"), "secret", "n_owners", "n_repos", "live"))).alias("spans"))
    base = F.filter("spans", lambda x: x["k"] < KINDS.index("bare"))
    free = F.filter("spans", lambda x: (x["k"] < KINDS.index("bare")) | ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    none = F.array().cast(per.schema["spans"].dataType)
    return found.select("_row", F.col("_d").alias(doc_id)).join(per.withColumn("spans", free), "_row", "left").select(doc_id, F.coalesce("spans", none).alias("spans"))


def op9_secret_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scan_secrets(docs)
    base = F.filter("spans", lambda x: x["k"] < 3)
    join = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return out.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(join(base), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
    )
