"""Secret scan with multipart credential linking, as column expressions alone.

Base spans (assigned values, access identifiers, long hex) are reported wherever they stand. Identifiers, endpoints and bare
keys are weak: each is reported only where its complement stands within SCOPE characters: a key beside an identifier, an
identifier beside a key, an endpoint beside both. Weak spans are parts of their own only where they overlap no base span and no weak span of a kind
named before them, so nothing is its own complement. The interval join of a text's parts is a search of the nearest part before and behind, by running
values over the parts in order of position; lists are folded in blocks, so a text with many parts costs about in proportion to their
number, and no row leaves its partition.

Spark's regular expressions tell what matched but not where. The text between matches (split by the same pattern) gives the places:
a match starts where the pieces and matches before it end. All offsets are code points. Kinds that a text can't hold (it has no "=" or ":",
no "://") cost one look for those characters, and weak kinds are looked for only where a complement can be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

SCOPE = 200
VALUE = "[A-Za-z0-9+/_.=-]+"


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = f"(?:{_either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?({VALUE})"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KEY_ID = f"(?:{_either_case('client|account|access|consumer|app|user')})[_-]?(?:{_either_case('id|name|key_id|keyid')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_.@-]+)"
BARE = "[A-Za-z0-9+/_-]{16,}"
ENDPOINT = "[a-z]+://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?"

#: kind, its order among spans that start together, its part (i: identifier, s: key, e: endpoint), pattern, what its texts contain, test of (whole, group).
KINDS = [
    ("assign", 0, "s", ASSIGN, (":", "="), lambda m, g: F.length(g) >= 6),
    ("access", 1, "i", ACCESS, ("AKIA",), lambda m, g: F.length(m) >= 20),
    ("hex", 2, "s", HEX, (), lambda m, g: F.length(m) >= 24),
    ("key_id", 3, "i", KEY_ID, (":", "="), lambda m, g: F.length(g) >= 6),
    ("endpoint", 4, "e", ENDPOINT, ("://",), lambda m, g: F.length(m) >= 10),
    ("bare_key", 5, "s", BARE, (), lambda m, g: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")),
]
#: A pattern that finds the same matches of 24 characters or more, and no others.
LONG_HEX = "[0-9a-f]{24,}"
_SPAN = "array<struct<start:int,ord:int,end:int,kind:string,part:string>>"
#: Values that a fold of a list takes at a time.
FOLD = 64


def let(value, body):
    """Expression: body of the value, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(values, step, start):
    """Expression: for each value of a list the fold of those before it, in blocks of FOLD: about as many steps as FOLD times their number."""

    def folded(part, begin):
        return F.aggregate(part, begin, step)

    def by_blocks(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / F.lit(FOLD)).cast("int")), lambda k: folded(F.slice(v, k * FOLD + 1, FOLD), start))
        heads = lambda sums: F.transform(sums, lambda x, k: folded(F.slice(sums, 1, k), start))
        inside = lambda h: F.transform(v, lambda x, i: folded(F.slice(v, F.floor(i / F.lit(FOLD)).cast("int") * FOLD + 1, F.pmod(i, F.lit(FOLD))), h[F.floor(i / F.lit(FOLD)).cast("int")]))
        return let(blocks, lambda b: let(heads(b), inside))

    return let(values, lambda v: F.when(F.size(v) > 0, by_blocks(v)).otherwise(F.slice(v, 1, 0)))


def _none():
    return F.array().cast(_SPAN)


def _found(text, kind: str, order: int, part: str, pattern: str, holds: tuple, keep):
    """All spans of one kind in a text, in order."""
    grouped = pattern.count("(") > pattern.count("(?:")
    pattern = LONG_HEX if kind == "hex" else pattern
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.zip_with(matches, F.split(text, pattern, -1), lambda m, gap: F.struct(F.length(m).alias("n"), F.length(gap).alias("gap"), m.alias("m")))

    def placed(found):
        lengths = F.transform(found, lambda r: F.coalesce(r["n"], F.lit(0)) + F.coalesce(r["gap"], F.lit(0)))
        return let(running(lengths, lambda a, x: a + x, F.lit(0)), lambda before: F.transform(found, lambda r, i: F.struct((before[i] + r["gap"]).alias("start"), F.lit(order).alias("ord"), (before[i] + r["gap"] + r["n"]).alias("end"), F.lit(kind).alias("kind"), F.lit(part).alias("part"), r["m"].alias("m"))))

    def kept(r):
        m = r["m"]
        # the split has a last piece that no match follows
        return m.isNotNull() & keep(m, F.regexp_extract(m, pattern, 1) if grouped else m)

    spans = F.transform(F.filter(let(rows, placed), kept), lambda r: F.struct(r["start"], r["ord"], r["end"], r["kind"], r["part"])).cast(_SPAN)
    may = F.lit(not holds)
    for h in holds:
        may = may | F.contains(text, F.lit(h))
    return F.when(may, F.when(text.rlike(pattern), spans).otherwise(_none())).otherwise(_none())


def _apart(weak, strong):
    """Those of the weak spans that overlap no strong one; both in order, weak ones apart from each other."""

    def checked(both):
        ends = F.transform(both, lambda x: F.when(x["ord"] < 3, x["end"]).otherwise(0))
        back = F.transform(F.reverse(both), lambda x: F.when(x["ord"] < 3, -x["start"]).otherwise(-(1 << 30)))
        last, following = running(ends, lambda a, x: F.greatest(a, x), F.lit(0)), running(back, lambda a, x: F.greatest(a, x), F.lit(-(1 << 30)))
        # a strong span that starts where a weak one does stands before it
        free = lambda ahead, behind: F.filter(both, lambda x, i: (x["ord"] >= 3) & (ahead[i] <= x["start"]) & (-behind[F.size(both) - 1 - i] >= x["end"]))
        return let(last, lambda ahead: let(following, lambda behind: free(ahead, behind)))

    marked = F.transform(strong, lambda x: x.withField("ord", F.least(x["ord"], F.lit(2))))
    return F.when((F.size(weak) > 0) & (F.size(strong) > 0), let(F.array_sort(F.concat(marked, weak)), checked)).otherwise(weak)


def _near(parts, part: str, scope: int):
    """For each of the parts (in order) whether one of kind `part` ends within scope before it or starts within scope behind it.

    Parts that are not base spans overlap nothing, so the nearest one before ends last of those before."""

    def both_ways(p):
        ends = F.transform(p, lambda x: F.when(x["part"] == part, x["end"]).otherwise(-(1 << 30)))
        starts = F.transform(F.reverse(p), lambda x: F.when(x["part"] == part, -x["start"]).otherwise(-(1 << 30)))
        last, following = (running(v, lambda a, x: F.greatest(a, x), F.lit(-(1 << 30))) for v in (ends, starts))
        hit = lambda before, behind: F.transform(p, lambda x, i: (x["start"] - before[i] <= scope) | (-behind[F.size(p) - 1 - i] - x["end"] <= scope))
        return let(last, lambda before: let(following, lambda behind: hit(before, behind)))

    return let(parts, both_ways)


def scan(docs: DataFrame, text: str = "text", spans: str = "spans", scope: int = SCOPE) -> DataFrame:
    """docs with `spans`: array<struct<start, end, kind>> of every text, ordered by start, then kind; ends exclusive, code points.

    Of weak spans that overlap, the kind named first counts (identifier, endpoint, bare key); one that overlaps a base span is none.
    Null and empty texts have no spans. Rows stay as they come, repeated ones too; a column named like the result is
    kept, and the result takes the name with "_" before it."""
    t, base, ids, ends, keys, parts, near_i, near_s, out = fresh(docs, "scan_text", "scan_base", "scan_ids", "scan_endpoints", "scan_keys", "scan_parts", "scan_near_id", "scan_near_key", spans)
    kinds = {kind: (kind, *rest) for kind, *rest in KINDS}
    seen = lambda kind: _found(F.col(t), *kinds[kind])
    rows = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = rows.withColumn(base, F.array_sort(F.concat(*(seen(k) for k in ("assign", "access", "hex")))))
    rows = rows.withColumn(ids, _apart(seen("key_id"), F.col(base)))
    # endpoints and bare keys count beside an identifier alone
    held = (F.size(ids) > 0) | F.exists(base, lambda x: x["part"] == "i")
    rows = rows.withColumn(ends, F.when(held, _apart(seen("endpoint"), F.array_sort(F.concat(base, ids)))).otherwise(_none()))
    rows = rows.withColumn(keys, F.when(held, _apart(seen("bare_key"), F.array_sort(F.concat(base, ids, ends)))).otherwise(_none()))
    rows = rows.withColumn(parts, F.array_sort(F.concat(base, ids, ends, keys)))
    some = F.size(F.col(ids)) + F.size(F.col(ends)) + F.size(F.col(keys)) > 0
    for name, part in ((near_i, "i"), (near_s, "s")):
        rows = rows.withColumn(name, F.when(some, _near(F.col(parts), part, scope)))
    kept = lambda x, i: (x["ord"] <= 2) | F.when(x["part"] == "s", F.col(near_i)[i]).when(x["part"] == "i", F.col(near_s)[i]).otherwise(F.col(near_i)[i] & F.col(near_s)[i])
    linked = F.when(F.col(near_i).isNull(), F.col(parts)).otherwise(F.filter(parts, kept))
    return rows.select(*docs.columns, F.transform(linked, lambda r: F.struct(r["start"], r["end"], r["kind"])).alias(out))


def redacted(text, spans, mark: str = "[REDACTED]"):
    """Expression: the text with each span (ordered by start; overlapping ones as one) replaced by the mark."""

    def masked(s):
        pieces = lambda before: F.transform(s, lambda r, i: F.when(r["start"] >= before[i], F.concat(F.substring(text, before[i] + 1, r["start"] - before[i]), F.lit(mark))).otherwise(""))
        rest = F.substring(text, F.array_max(F.transform(s, lambda r: r["end"])) + 1, F.lit(2147483647))
        return let(running(F.transform(s, lambda r: r["end"]), lambda a, x: F.greatest(a, x), F.lit(0)), lambda before: F.concat(F.array_join(pieces(before), ""), rest))

    return F.when(F.size(spans) > 0, let(spans, masked)).otherwise(text)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of every document's spans."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.array_join(F.transform(base, one), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", one), ",").alias("spans"),
    )


def _sql() -> str:
    tests = {
        "assign": "length(g) >= 6", "access": "length(m) >= 20", "hex": "length(m) >= 24", "key_id": "length(g) >= 6",
        "bare_key": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')", "endpoint": "length(m) >= 10",
    }
    kinds = []
    for kind, order, part, pattern, *_ in KINDS:
        p = pattern.replace("'", "''")
        group = 1 if pattern.count("(") - pattern.count("(?:") else 0
        kinds.append(f"""
  SELECT r, start, '{kind}' AS kind, {order} AS ord, '{part}' AS part, start + length(m) AS stop FROM (
    SELECT r, m, g, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT r, ms, gaps, unnest(ms) AS m, unnest(gs) AS g, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT r, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS gs, string_split_regex(t, '{p}') AS gaps FROM d))
  ) WHERE {tests[kind]}""")
    free = "NOT EXISTS (SELECT 1 FROM {0} b WHERE b.r = x.r AND b.start < x.stop AND x.start < b.stop)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({' UNION ALL '.join(kinds)}),
p2 AS (SELECT * FROM raw WHERE ord <= 2),
p3 AS (SELECT * FROM p2 UNION ALL SELECT * FROM raw x WHERE ord = 3 AND {free.format('p2')}),
p4 AS (SELECT * FROM p3 UNION ALL SELECT * FROM raw x WHERE ord = 4 AND {free.format('p3')}),
parts AS (SELECT * FROM p4 UNION ALL SELECT * FROM raw x WHERE ord = 5 AND {free.format('p4')}),
linked AS (
  SELECT x.*, bool_or(y.part = 'i') AS near_i, bool_or(y.part = 's') AS near_s
  FROM parts x LEFT JOIN parts y ON x.r = y.r AND (y.start >= x.stop AND y.start - x.stop <= {SCOPE} OR x.start >= y.stop AND x.start - y.stop <= {SCOPE})
  GROUP BY ALL
),
kept AS (SELECT r, start, ord, kind, kind || ':' || start || ':' || stop AS one FROM linked
  WHERE ord <= 2 OR (part = 's' AND near_i) OR (part = 'i' AND near_s) OR (part = 'e' AND near_i AND near_s)),
digests AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
         string_agg(one, ',' ORDER BY start, ord) FILTER (ord <= 2) AS base, string_agg(one, ',' ORDER BY start, ord) AS spans
  FROM kept GROUP BY r
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN digests USING (r)
"""


SQL = _sql()
