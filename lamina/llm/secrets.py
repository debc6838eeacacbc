"""Secret scans over an incremental blob ledger (native).

Every version of a document is content-addressed by the SHA-256 of its text. The
ledger is a folder of (blob, spans) by batch, rule and rule version: a pair of blob and
rule version that it has is never scanned again, so a rerun reads only new texts and a
changed rule rescans with that rule alone. An update compares digests with the ledger's
partitions of the rules in force; only texts of unseen pairs are shuffled and scanned. A
batch is named by the pairs that it scans and written over, so that one that is run again
after a failure replaces itself. Findings are joined back from the ledger to all rows that
hold the blob.

Matches are found by two passes over the texts that a rule's guard lets through:
one cuts out the matches, one the gaps between them; positions are running sums of
their lengths, taken by a window over a blob's matches.

Each blob is scanned once, on the text of its row with the smallest id: texts are joined to
unseen blobs by blob and id, so copies of a hot one don't meet. The join back is a plain
equi-join of digests, which Spark splits where one blob is hot.

Defined results: null text counts as empty and has no findings; equal rows get equal
results; spans are in code points with the end exclusive; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, materialize, new_path, sized, text_or_empty


class Rule(NamedTuple):
    """Matches of ``pattern``, leftmost and non-overlapping, count if ``group`` has at
    least ``least`` characters; only texts that ``guard`` (a pattern, or a plain
    string if ``plain``) finds something in are searched."""

    name: str
    version: int
    pattern: str
    guard: str
    plain: bool = False
    group: int = 0
    least: int = 0
    base: bool = True


# The base rules' patterns and lengths. The lengths of access and hex
# are part of the pattern: a run that is too short has no long enough run inside.
RULES = (
    Rule("assign", 1, r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", group=2, least=12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", "AKIA", plain=True),
    Rule("hex", 1, r"[0-9a-f]{16,}", r"[0-9a-f]{16}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----BEGIN ", plain=True, base=False),
)

LEDGER = "blob string, spans array<struct<start: bigint, end: bigint>>, batch string, rule string, version int"


def _matches(text: Column, rule: Rule) -> Column:
    """Array of (gap before, length, keep) of the rule's matches, null without any."""
    p = F.lit(rule.pattern)
    found, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, rule.pattern, -1)
    part = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else found
    rows = F.zip_with(F.zip_with(found, part, lambda m, g: F.struct(F.char_length(m).alias("n"), (F.char_length(g) >= rule.least).alias("keep"))), gaps, lambda m, g: F.struct(F.char_length(g).alias("gap"), m["n"].alias("n"), m["keep"].alias("keep")))
    guard = F.contains(text, F.lit(rule.guard)) if rule.plain else text.rlike(rule.guard)
    return F.when(guard, rows)


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """LEDGER rows of blobs (blob, text, seen: names of rules not to run)."""
    todo = F.array(*(
        F.when(~F.array_contains("seen", r.name), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), _matches(F.col("text"), r).alias("found"))) for r in rules
    ))
    per_rule = blobs.select("blob", F.explode(todo).alias("x")).where("x is not null").select("blob", "x.rule", "x.version", "x.found")
    # The last element of found is the gap after the last match; it has no match.
    parts = per_rule.select("blob", "rule", "version", F.posexplode_outer("found").alias("i", "m"))
    upto = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ended = parts.withColumn("end", F.sum(F.expr("bigint(coalesce(m.gap, 0)) + coalesce(m.n, 0)")).over(upto))
    kept = F.expr("if(m.n is not null and m.keep, named_struct('start', `end` - m.n, 'end', `end`), null)")
    return ended.groupBy("blob", "rule", "version").agg(F.array_sort(F.collect_list(kept)).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The whole ledger, empty where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _in_force(rules: tuple[Rule, ...]) -> Column:
    return reduce(Column.__or__, ((F.col("rule") == r.name) & (F.col("version") == r.version) for r in rules))


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the pairs of docs' blobs and rules that the ledger (a folder) has not, add
    them as one batch, and return the whole ledger."""
    spark = docs.sparkSession
    text = text_or_empty()
    digests = docs.select("doc_id", F.sha2(text, 256).alias("blob")).groupBy("blob").agg(F.min("doc_id").alias("rep"))
    known = read_ledger(spark, ledger).where(_in_force(rules)).select("blob", "rule")
    none = F.array().cast("array<string>")
    seen = digests.join(known, "blob", "left").groupBy("blob", "rep").agg(F.collect_set("rule").alias("seen"))
    todo = materialize(seen.where(F.size("seen") < len(rules)), "todo")
    mark = todo.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("blob", F.array_sort("seen"))).alias("x")).first()
    if mark.n:
        # Texts are shuffled once, to their blob and id, whether the unseen blobs are few enough to be broadcast or not.
        rows = docs.select("doc_id", F.sha2(text, 256).alias("blob"), text.alias("text")).withColumn("place", F.xxhash64("blob", "doc_id")).drop("doc_id")
        unseen = todo.select("blob", F.xxhash64("blob", F.col("rep").alias("doc_id")).alias("place"), F.coalesce("seen", none).alias("seen"))
        blobs = rows.join(sized(unseen, BROADCAST_BYTES // 8), ["blob", "place"]).dropDuplicates(["blob", "place"]).drop("place")
        name = hashlib.sha256(repr((mark.n, mark.x, sorted((r.name, r.version) for r in rules))).encode()).hexdigest()[:32]
        scan(blobs, rules).write.mode("overwrite").partitionBy("rule", "version").parquet(f"{ledger}/batch={name}")
    return read_ledger(spark, ledger)


def find_secrets(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: doc_id, and found, an array of (start, kind number,
    end) of all rules' spans in order."""
    whole = update_ledger(docs, ledger, rules)
    number = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))))
    per_blob = whole.where(_in_force(rules)).where("size(spans) > 0").select("blob", F.expr("spans"), number[F.col("rule")].alias("k"))
    per_blob = per_blob.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("k").alias("k"), s["end"].alias("end")))))).alias("found"))
    per_blob = materialize(per_blob, "findings")  # so that the join below is split where a blob is hot
    rows = docs.select("doc_id", F.sha2(text_or_empty(), 256).alias("blob"))
    return rows.join(sized(per_blob), "blob", "left").select("doc_id", F.coalesce("found", F.expr("cast(array() as array<struct<start: bigint, k: int, end: bigint>>)")).alias("found"))


def spans_text(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*(F.lit(r.name) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_blob_ledger(spark, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the first sees the texts whose digest starts with 0 to 7,
    the second all of them, of which it scans those that the first has not."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = new_path(spark, "ledger")
    update_ledger(docs.where(F.sha2(text_or_empty(), 256) < "8"), ledger)
    rows = find_secrets(docs, ledger)
    count = lambda k: F.size(F.filter("found", lambda s: s["k"] == k)).cast("bigint")
    base = sum(r.base for r in RULES)
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text(F.filter("found", lambda s: s["k"] < base)), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))


OP8_SQL = r"""
with r as (select * from (values
  (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12, true),
  (1, 'access', '(AKIA[A-Z0-9]+)', 1, 18, true),
  (2, 'hex', '([0-9a-f]+)', 1, 16, true),
  (3, 'pem', '(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)', 1, 0, false)) t(k, kind, p, g, least, base)),
d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
m as (
  select rid, 0 k, regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) a, regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) v, string_split_regex(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') s from d
  union all select rid, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') from d
  union all select rid, 2, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') from d
  union all select rid, 3, regexp_extract_all(t, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'), regexp_extract_all(t, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'), string_split_regex(t, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----') from d),
x as (select rid, k, i, length(a[i]) n, length(v[i]) nv, length(s[i]) gap from (select *, unnest(range(1, len(a) + 1)) i from m) y),
e as (select rid, k, n, nv, sum(gap + n) over (partition by rid, k order by i) en from x),
f as (select rid, r.k, kind, base, cast(en - n as bigint) st, cast(en as bigint) en from e join r on r.k = e.k and nv >= least),
g as (select rid, count(*) filter (k = 0) a, count(*) filter (k = 1) c, count(*) filter (k = 2) h,
  coalesce(string_agg(kind || ':' || st || ':' || en, ',' order by st, k) filter (base), '') b, string_agg(kind || ':' || st || ':' || en, ',' order by st, k) s from f group by rid)
select doc_id, cast(coalesce(a, 0) as bigint) n_assign, cast(coalesce(c, 0) as bigint) n_access, cast(coalesce(h, 0) as bigint) n_hex, sha256(coalesce(b, '')) base_sha256, coalesce(s, '') spans
from d left join g using (rid)
"""
