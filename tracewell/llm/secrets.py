"""Credentials in texts, single and in parts.

Base findings are strong on their own: an assignment to a secret's name, an access key id, a long run of
hexadecimal digits. Weak candidates are parts of a credential that mean nothing alone: an account
identifier, an unnamed random-looking token, an endpoint. They are linked by an interval join within a
scope of ``REACH`` code points: a weak candidate is reported only if complementary parts lie within reach,
an identifier or access key for a token, a token or base secret for an identifier, both for an endpoint.
A weak candidate that overlaps a base finding is part of it and not reported.

The join has one row per part: sorted by position inside a text, the nearest parts of each role before and
after are running maxima and minima, so its work is that of a sort and no pairs are made, however many
parts a text has. Positions come from the lengths of matches and of what a split leaves between them. Only
texts with a match leave the scan, and of rows alike in doc_id and text one per task. DataFrame functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import documents, query, whole, written

REACH = 200


def _either(names: str) -> str:
    """A pattern for the names with each ASCII letter in either case, and no other letter that folds to it."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.islower() else c for c in names)


_SET = r"""["']?\x20*[:=]\x20*["']?"""
_SECRET, _ACCOUNT = _either("(?:password|passwd|secret|token|api_?key)"), _either("(?:username|user|login|account|client_?id)")
#: kind: pattern and the group whose length counts. Runs of at least so many characters are the long ones of
#: all maximal runs; a value too short is dropped only after it has been matched.
PATTERNS = {
    "assign": (_SECRET + _SET + r"([A-Za-z0-9+/_.=-]+)", 1),
    "access": (r"AKIA[A-Z0-9]{16,}", 0),
    "hex": (r"[0-9a-f]{24,}", 0),
    "ident": (_ACCOUNT + _SET + r"([A-Za-z0-9@._-]+)", 1),
    "opaque": (r"[A-Za-z0-9+/]{32,}", 0),
    "endpoint": (r"(?:https?|postgresql|postgres|mysql|mongodb|redis|amqp|s3)://([A-Za-z0-9@:._/-]+)", 1),
}
KINDS = list(PATTERNS)
BASE = KINDS[:3]
_LEAST = {"assign": 6, "access": 20, "hex": 24, "ident": 3, "opaque": 32, "endpoint": 4}
_OPAQUE_MOST = 88
_IDS, _SECRETS = ["ident", "access"], ["opaque", "assign", "hex"]


def parts(docs: DataFrame) -> DataFrame:
    """(key, kind, rank, start, stop) of every base finding and weak candidate in the texts of (key, text)."""
    listed = docs.select("key", "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, (p, _) in PATTERNS.items()])
    some = F.greatest(*[F.size(k) for k in KINDS]) > 0

    def one(kind: str) -> Column:
        pattern, group = PATTERNS[kind]
        value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else F.col(kind)
        made = F.struct(
            F.lit(kind).alias("kind"),
            F.lit(KINDS.index(kind)).alias("rank"),
            F.transform(F.split("text", pattern, -1), F.length).alias("gaps"),
            F.transform(kind, F.length).alias("lengths"),
            value.alias("matched"),
        )
        return F.when(F.size(kind) > 0, made)

    found = listed.filter(some).select("key", F.array_compact(F.array(*map(one, KINDS))).alias("kinds"))
    # Rows alike in doc_id and text: one per task, then one.
    found = found.groupBy("key").agg(F.first("kinds").alias("kinds")).select("key", F.explode("kinds").alias("k")).select("key", "k.*")
    found = found.select("key", "kind", "rank", "gaps", "lengths", F.posexplode("matched").alias("i", "value"))
    found = found.select("key", "kind", "rank", "i", "value", F.get("gaps", "i").alias("gap"), F.get("lengths", "i").alias("length"))
    so_far = W.partitionBy("key", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("length")).over(so_far).cast("int")
    found = found.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("length"))
    least = F.element_at(F.create_map(*[F.lit(x) for k in KINDS for x in (k, _LEAST[k])]), F.col("kind"))
    random = (F.length("value") <= _OPAQUE_MOST) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]")
    found = found.filter((F.length("value") >= least) & ((F.col("kind") != "opaque") | random))
    return found.select("key", "kind", "rank", "start", "stop")


def linked(found: DataFrame) -> DataFrame:
    """The parts to report: base findings, and weak candidates with their complement within reach."""
    order = ["start", "stop", "rank"]
    before = W.partitionBy("key").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("key").orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)
    roles = {"id": _IDS, "secret": _SECRETS, "base": BASE}
    wide = found
    for role, kinds in roles.items():
        own = F.col("kind").isin(kinds)
        wide = wide.withColumn(f"{role}_before", F.max(F.when(own, F.col("stop"))).over(before))
    for role, kinds in roles.items():
        own = F.col("kind").isin(kinds)
        wide = wide.withColumn(f"{role}_after", F.min(F.when(own, F.col("start"))).over(after))

    def near(role: str, reach: int) -> Column:
        left = F.col("start") - F.col(f"{role}_before") <= reach
        right = F.col(f"{role}_after") - F.col("stop") <= reach
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    complete = (
        F.when(F.col("kind") == "ident", near("secret", REACH))
        .when(F.col("kind") == "opaque", near("id", REACH))
        .otherwise(near("id", REACH) & near("secret", REACH))
    )
    base = F.col("kind").isin(BASE)
    return wide.filter(base | (complete & ~near("base", -1))).select("key", "kind", "rank", "start", "stop")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, stop by start, then kind) of every row, empty where nothing is found.

    Null and empty texts have no spans. Repeated rows and null doc_ids get a row each; no rows give no rows.
    Columns other than doc_id and text are not read.
    """
    key = F.struct(
        F.col("doc_id").isNull().alias("none"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.xxhash64(whole()).alias("hash"),
        F.length(whole()).alias("length"),
    )
    rows = docs.select("doc_id", whole().alias("text")).withColumn("key", key)
    spans = linked(parts(rows)).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "stop"))).alias("spans"))
    joined = rows.select("key", "doc_id").join(written(spans, "spans"), "key", "left")
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>")
    return joined.select("doc_id", F.coalesce("spans", empty).alias("spans"))


def _sql() -> str:
    quoted = {k: p.replace("'", "''") for k, (p, _) in PATTERNS.items()}
    each = "\n UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, {KINDS.index(k)} AS rank, {_LEAST[k]} AS least, regexp_extract_all(t, '{quoted[k]}', 0) AS m, "
        f"regexp_extract_all(t, '{quoted[k]}', {PATTERNS[k][1]}) AS v, string_split_regex(t, '{quoted[k]}') AS g FROM d"
        for k in KINDS
    )
    isin = lambda kinds: "(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    near = lambda kinds, reach: (
        f"EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.kind IN {isin(kinds)} AND (o.kind, o.start) <> (s.kind, s.start) "
        f"AND o.start - s.stop <= {reach} AND s.start - o.stop <= {reach})"
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({each}),
p AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
a AS (
  SELECT doc_id, kind, rank, least, v[i] AS value, length(m[i]) AS n,
         (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))::BIGINT AS stop
  FROM p
),
s AS (
  SELECT doc_id, kind, rank, stop - n AS start, stop FROM a
  WHERE length(value) >= least AND (kind <> 'opaque' OR (length(value) <= {_OPAQUE_MOST}
    AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')))
),
l AS (
  SELECT * FROM s WHERE kind IN {isin(BASE)} OR (NOT {near(BASE, -1)} AND CASE kind
    WHEN 'ident' THEN {near(_SECRETS, REACH)} WHEN 'opaque' THEN {near(_IDS, REACH)}
    ELSE {near(_IDS, REACH)} AND {near(_SECRETS, REACH)} END)
),
r AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind IN {isin(BASE)}) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM l GROUP BY doc_id
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (doc_id)
"""


@query(_sql())
def op1_secret_scan(spark, sf_dir):
    found = scanned(documents(spark, sf_dir))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
