"""Secret scan with multipart linking.

Base matches (assignments, access identifiers, hex runs) are reported as they
stand.  Weak parts (account names, short secrets, endpoints) are only reported
where complementary parts co-occur within a scope of ``SCOPE`` characters: an
identifier needs a secret near it, a secret an identifier, an endpoint both.
Parts of a document are sorted by place and swept once each way, so an interval
join costs no pairs.  Everything is column expressions; offsets are code points.

Defined results: a null or empty text has no spans; rows equal in doc_id and
text are scanned apart and give equal rows; a null doc_id stays null; empty
tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eoframe.llm.common import real_id, table, with_key
from eoframe.session import stable

SCOPE = 300
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern, part it plays); the order is that of spans that start together
BASE = (
    ("assign", ASSIGN, "secret"),
    ("access", r"AKIA[A-Z0-9]{14,}", "id"),
    ("hex", r"[0-9a-f]{16,}", "secret"),
)
WEAK = (
    ("id", r"""(?i)\b(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", "id"),
    ("secret", r"""(?i)\b(?:password|passwd|pwd|pass|secret|token|auth|api_?key)["']?\x20*[:=]\x20*["']?[^\s"']{4,}""", "secret"),
    ("endpoint", r"""(?i)\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\s"'<>]+""", "endpoint"),
)
SHORT = 12
STEP = 256


def _with_sums(df: DataFrame, steps: str, out: str) -> DataFrame:
    """Running sums of the array ``steps``: sums of whole stretches of ``STEP`` first, so long arrays stay cheap."""
    add = lambda a, x: a + x
    zero = F.lit(0).cast("bigint")
    n = F.size(steps)
    some = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int")), lambda b: F.aggregate(F.slice(steps, b * STEP + 1, F.lit(STEP)), zero, add)))
    df = df.withColumn("_some", some)
    before = F.transform("_some", lambda _, i: F.aggregate(F.slice("_some", F.lit(1), i), zero, add))
    df = df.withColumn("_before", before)
    whole = lambda i: F.floor(i / STEP).cast("int")
    sums = F.transform(steps, lambda _, i: F.get("_before", whole(i)) + F.aggregate(F.slice(steps, whole(i) * STEP + 1, i % STEP + 1), zero, add))
    return df.withColumn(out, F.coalesce(sums, F.array().cast("array<bigint>"))).drop("_some", "_before")


def _with_spans(df: DataFrame, out: str, kind: str, no: int, pattern: str) -> DataFrame:
    """``df`` with ``out``: an array of (start, no, end, kind, value length) of the pattern's matches in ``text``."""
    df = df.withColumn("_m", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    some = F.size("_m") > 0
    gaps = F.when(some, F.transform(F.split("text", pattern, -1), lambda g: F.char_length(g).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_g", gaps).withColumn("_l", F.transform("_m", lambda m: F.char_length(m).cast("bigint")))
    if kind == "assign":
        df = df.withColumn("_v", F.transform(F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(2))), lambda v: F.char_length(v)))
    else:
        df = df.withColumn("_v", F.transform("_m", lambda m: F.char_length(m)))
    # a match starts after all gaps up to it and all matches before it
    df = df.withColumn("_s", F.transform("_l", lambda x, i: F.get("_g", i) + F.when(i > 0, F.get("_l", i - 1)).otherwise(0)))
    df = _with_sums(df, "_s", "_at")
    spans = F.transform("_at", lambda s, i: F.struct(
        s.alias("start"), F.lit(no).alias("no"), (s + F.get("_l", i)).alias("end"), F.lit(kind).alias("kind"), F.get("_v", i).alias("value")))
    return df.withColumn(out, spans).drop("_m", "_g", "_l", "_v", "_s", "_at")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, by start and then kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def _link(found: DataFrame) -> DataFrame:
    """(doc_id, tk, more): weak spans whose complementary parts lie within the scope."""
    roles = {k: role for k, _, role in (*BASE, *WEAK)}
    role = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    every = found.where(F.size("weak") > 0).distinct().select("doc_id", "tk", F.explode(F.concat("base", "weak")).alias("x")).select("doc_id", "tk", "x.*")
    parts = every.withColumn("role", role[F.col("kind")]).withColumn("is_weak", F.col("no") > len(BASE))
    # a document's parts, as many as its length allows
    back = Window.partitionBy("doc_id", "tk").orderBy("start", "no").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("doc_id", "tk").orderBy("start", "no").rowsBetween(1, Window.unboundedFollowing)

    def near(what: str) -> Column:
        prior = F.max(F.when(F.col("role") == what, F.col("end"))).over(back)
        after = F.min(F.when(F.col("role") == what, F.col("start"))).over(ahead)
        return F.coalesce(F.col("start") - prior <= SCOPE, F.lit(False)) | F.coalesce(after - F.col("end") <= SCOPE, F.lit(False))

    seen = parts.select("*", near("id").alias("by_id"), near("secret").alias("by_secret"))
    good = (
        F.when(F.col("role") == "id", F.col("by_secret")).when(F.col("role") == "secret", F.col("by_id"))
        .otherwise(F.col("by_id") & F.col("by_secret"))
    )
    return seen.where(F.col("is_weak") & good).groupBy(F.col("doc_id").alias("md"), F.col("tk").alias("mt")).agg(
        F.collect_list(F.struct("start", "no", "end", "kind", "value")).alias("more"))


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    d = with_key(docs)
    for no, (kind, pattern, _) in enumerate((*BASE, *WEAK), 1):
        d = _with_spans(d, f"k{no}", kind, no, pattern)
    base = F.concat(F.filter("k1", lambda x: x.value >= SHORT), "k2", "k3")
    # an assignment that is a base span is no weak one
    taken = F.transform(F.filter("k1", lambda x: x.value >= SHORT), lambda x: x.start)
    weak = F.concat("k4", F.filter("k5", lambda x: ~F.array_contains(taken, x.start)), "k6")
    found = stable(d.select("doc_id", "tk", base.alias("base"), weak.alias("weak")))
    out = found.join(_link(found), (F.col("doc_id") == F.col("md")) & (F.col("tk") == F.col("mt")), "left")
    count = lambda no: F.size(F.filter("base", lambda x: x.no == no)).cast("bigint")
    none = F.filter("base", lambda x: F.lit(False))
    return out.select(
        real_id("doc_id").alias("doc_id"), count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", F.coalesce("more", none))).alias("spans"),
    )


def op7_credential_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
