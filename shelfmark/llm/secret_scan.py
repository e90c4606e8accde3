"""Secret scans over a ledger of content-addressed blobs, in DataFrame expressions only.

Every version of every path is addressed by the SHA-256 of its text. Only pairs of blob and rule version that the
ledger lacks are scanned, each blob once however many paths and versions hold it; the findings are joined back to
all of them. Hits come from `regexp_extract_all` and their places from the lengths of what `split` leaves between
them, so positions are code points.

Defined results: a null text is an empty one; repeated rows and copies share one ledger entry and all get its spans;
an empty table gives no rows; a very long text gives one row per hit until its spans are gathered again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import stored, text_of

RULE_VERSION = "base-1"
# Fixed by the contract: kinds in their order, pattern, group whose length counts, least length.
RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of [0-9a-f]+ is whole or fails, so the least length may stand in the pattern
)
MASK = "[REDACTED]"
SPANS = "array<struct<start:int,kind:int,end:int>>"


def blob_id(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _at_least(least: int):
    return lambda x: F.length(x) >= least


def hits(content: Column) -> Column:
    """Per kind with a hit: the lengths of gaps and hits in turn, and which hits are long enough."""
    parts = []
    for at, (_, pattern, group, least) in enumerate(RULES):
        rule = F.lit(pattern)
        found = F.struct(
            F.lit(at).alias("kind"),
            F.transform(F.split(content, pattern, -1), F.length).alias("gaps"),
            F.transform(F.regexp_extract_all(content, rule, F.lit(0)), F.length).alias("hits"),
            F.transform(F.regexp_extract_all(content, rule, F.lit(group)), _at_least(least)).alias("long"),
        )
        parts.append(F.when(content.rlike(pattern), found))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def spans_of(scanned: DataFrame) -> DataFrame:
    """blob_id and spans (by start, then kind) of scanned blobs (blob_id, found)."""
    zipped = F.arrays_zip(
        F.slice("x.gaps", F.lit(1), F.size("x.hits")).alias("gap"), F.col("x.hits").alias("hit"), F.col("x.long").alias("long")
    )
    each = (
        scanned.filter(F.size("found") > 0)
        .select("blob_id", F.explode("found").alias("x"))
        .select("blob_id", "x.kind", F.posexplode(zipped))
        .select("blob_id", "kind", "pos", "col.*")
        .repartition("blob_id")
    )
    until = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("blob_id", "kind").orderBy("pos")).cast("int")
    span = F.when(F.col("long"), F.struct((F.col("end") - F.col("hit")).alias("start"), "kind", "end"))
    return (
        each.withColumn("end", until)
        .groupBy("blob_id")
        .agg(F.array_sort(F.collect_list(span)).cast(SPANS).alias("spans"))
    )


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger entries (blob_id, rule_version, spans) of all blobs that the ledger lacks under this rule version.

    versions: any columns with `content`. Append the result to the ledger's table. A clean blob has an entry too,
    without spans, so that it isn't scanned again.
    """
    content = F.coalesce("content", F.lit(""))
    blobs = versions.select(blob_id(content).alias("blob_id"), content.alias("content"))
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == rule_version).select("blob_id")
        blobs = blobs.join(known, "blob_id", "left_anti")
    unseen = blobs.groupBy("blob_id").agg(F.first("content").alias("content"))
    scanned = stored(unseen.select("blob_id", hits(F.col("content")).alias("found")), "secret-hits")
    clean = scanned.filter(F.size("found") == 0).select("blob_id", F.array().cast(SPANS).alias("spans"))
    return clean.unionByName(spans_of(scanned)).select("blob_id", F.lit(rule_version).alias("rule_version"), "spans")


def join_findings(versions: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """versions (with blob_id) and the spans of each; none: an empty array."""
    entries = ledger.filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob_id", "spans")
    return versions.join(entries, "blob_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def count_of(spans: Column, name: str) -> Column:
    """How many spans are of the named kind."""
    at = [rule[0] for rule in RULES].index(name)
    return F.size(F.filter(spans, lambda s: s["kind"] == at)).cast("bigint")


def label(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(rule[0]) for rule in RULES])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by the mask; overlapping spans become one."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK)))
            .otherwise(acc["out"])
            .alias("out"),
        )

    return F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every document, with a ledger that is new."""
    ledger = stored(update_ledger(docs.select(text_of().alias("content"))), "secret-ledger")
    return join_findings(docs.select("doc_id", blob_id(text_of()).alias("blob_id")), ledger).select("doc_id", "spans")


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with all secrets masked; documents without any stay as they are, a null text stays null."""
    ledger = stored(update_ledger(docs.select(text_of().alias("content"))), "secret-ledger")
    rows = docs.select(F.struct("*").alias("row"), blob_id(text_of()).alias("blob_id"))
    found = join_findings(rows, ledger)
    text = F.when(F.size("spans") > 0, redact(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    return found.select(F.col("row").withField("text", text).alias("row")).select("row.*")
