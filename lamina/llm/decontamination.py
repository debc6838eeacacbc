"""Benchmark decontamination by a prefix-filtered set join (native).

Items are cut into windows of WINDOW words. A window is the set of its word
shingles (three words; one or two where the window is shorter). One pass over the
documents keeps the shingles that any window has, with their positions. Shingles are
ordered by rarity among all documents; containment of a whole window needs each of
its shingles, so its prefix is the single rarest one, and only that is joined. A
candidate start must leave room for the whole window (positional and length bounds),
and is then verified word by word on the text, all candidates of a document at once.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased. Shingle hashes
only find candidates; what counts as a hit is compared as text.

The benchmark side is broadcast when its counted rows allow it, and joined by a
shuffle beyond. Identical windows of many items are one row until hits are known.

Defined results: null text has no words; an item without words has no window; a null
item_id is not listed among the items of a document, though its windows hit; equal
rows of documents get equal results; items that share an id are one item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, sized, text_or_empty

WINDOW = 10
SHINGLE = 3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; ``lower`` does for pure ASCII what the slower
    character map does for the rest."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(low, _GAP), "")


def _shingle(k: int, array: str, at: str) -> str:
    parts = ", ".join(f"get({array}, {at} + {j})" for j in range(k))
    return f"xxhash64({k}, {parts})"


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, win, len) of the items; win is the words joined by spaces."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(text_or_empty()).alias("w")).where("size(w) > 0")
    cut = F.expr(f"if(size(w) <= {window}, array(w), transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window})))")
    return items.select("item_id", F.explode(cut).alias("x")).select("item_id", F.array_join("x", " ").alias("win"), F.size("x").alias("len")).distinct()


def scan(docs: DataFrame, shingles: DataFrame, kinds: list[int]) -> DataFrame:
    """(doc_id, digest, n_words, at, shingle): one row per document with at = -1, and
    one for each of its shingles that a window has."""
    d = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("digest"), words(text_or_empty()).alias("w")).withColumn("n_words", F.size("w"))
    every = [f"if(n_words = 0, array(), transform(sequence(0, n_words - 1), i -> {_shingle(k, 'w', 'i')}))" for k in kinds]
    d = d.select("doc_id", "digest", "n_words", F.posexplode(F.expr(f"concat(array(0L), {', '.join(every)})" if every else "array(0L)")).alias("pos", "shingle"))
    d = d.withColumn("shingle", F.expr("if(pos = 0, null, shingle)"))
    found = d.join(sized(shingles), "shingle", "left").where("pos = 0 or known")
    return found.select("doc_id", "digest", "n_words", F.expr("if(pos = 0, -1, (pos - 1) % n_words)").alias("at"), "shingle")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(every document's doc_id, digest, n_words; distinct verified hits doc_id,
    digest, start, len, win; items by window)."""
    items = materialize(windows(benchmark, window), "windows")
    wins = materialize(items.select("win", "len").distinct(), "wins")
    kinds = sorted(r[0] for r in wins.select(F.least(F.lit(SHINGLE), F.col("len"))).distinct().collect())
    tokens = [
        wins.where(f"least({SHINGLE}, len) = {k}").select("win", "len", F.posexplode(F.expr(f"transform(sequence(0, len - {k}), i -> {_shingle(k, 'split(win, chr(32))', 'i')})")).alias("offset", "shingle"))
        for k in kinds
    ]
    if not tokens:
        n = scan(docs, docs.sparkSession.createDataFrame([], "shingle bigint, known boolean"), [])
        none = n.limit(0).select("doc_id", "digest", *(F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("len", "int"), ("win", "string"))))
        return n.drop("at", "shingle"), none, items
    tokens = materialize(reduce(DataFrame.unionByName, tokens), "tokens")
    known = materialize(tokens.select("shingle").distinct().withColumn("known", F.lit(True)), "known")
    seen = materialize(scan(docs, known, kinds), "scan")

    found = seen.where("at >= 0")
    rarity = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct("n", "shingle", "offset")).alias("p")  # a shingle that never occurs drops its window here
    whole = tokens.groupBy("win").agg(F.count(F.lit(1)).alias("needed"))
    ranked = tokens.join(rarity, "shingle")
    prefix = ranked.groupBy("win", "len").agg(first, F.count(F.lit(1)).alias("got")).join(whole, "win").where("got = needed")
    prefix = materialize(prefix.select("win", "len", "p.shingle", "p.offset"), "prefix")
    cand = found.join(sized(prefix), "shingle").withColumn("start", F.col("at") - F.col("offset"))
    cand = cand.where("start >= 0 and start + len <= n_words")
    per = cand.groupBy(F.col("doc_id").alias("c_id"), F.col("digest").alias("c_digest")).agg(F.collect_set(F.struct("start", "len", "win")).alias("cands"))
    per = materialize(per, "candidates")
    d = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("digest"), text_or_empty().alias("text"))
    # Texts without candidates are left out by ids and digests alone, before the others are shuffled.
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("digest") == F.col("c_digest"))
    d = d.join(sized(per.select("c_id", "c_digest")), same, "left_semi")
    d = d.join(per, same).select("doc_id", "digest", words(F.col("text")).alias("w"), "cands")
    good = F.expr("filter(cands, c -> array_join(slice(w, c.start + 1, c.len), ' ') = c.win)")
    out = materialize(d.select("doc_id", "digest", F.inline(good)).distinct(), "hits")
    return seen.where("at < 0").select("doc_id", "digest", "n_words"), out, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, digest (of the text), n_words, n_hit, n_items,
    items_sha256 and contaminated."""
    every, found, items = hits(docs, benchmark, window)
    before = Window.partitionBy("doc_id", "digest").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    runs = found.select("doc_id", "digest", "start", "len").distinct().withColumn("end", F.col("start") + F.col("len"))
    runs = runs.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))))
    n_hit = runs.groupBy("doc_id", "digest").agg(F.sum("new").alias("n_hit"))
    ids = found.select("doc_id", "digest", "win").join(sized(items), "win").where("item_id is not null").select("doc_id", "digest", "item_id").distinct()
    ids = ids.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    per = n_hit.alias("h").join(ids.alias("i"), by_names("h", "i"), "left").select("h.*", "i.ids")
    out = every.alias("d").join(per.alias("p"), by_names("d", "p"), "left")
    return out.select(
        F.col("d.doc_id"), F.col("d.digest"), F.col("d.n_words").cast("bigint").alias("n_words"),
        F.coalesce(F.col("p.n_hit"), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("p.ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("p.ids", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("p.n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a window of the benchmark."""
    _, found, _ = hits(docs, benchmark, window)
    keys = materialize(found.select(F.col("doc_id").alias("l_id"), F.col("digest").alias("l_digest")).distinct(), "contaminated")
    k = sized(keys)
    return docs.join(k, docs["doc_id"].eqNullSafe(k["l_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == k["l_digest"]), "left_anti")


def by_names(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("digest")


OP7_SQL = r"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') t from (select item_id, w, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from b where len(w) > 0) x),
lens as (select distinct n from win),
pos as (select rid, n, i, array_to_string(w[i:i + n - 1], ' ') t from (select rid, w, n, unnest(range(1, len(w) - n + 2)) i from d, lens where len(w) >= n) x),
hit as (select rid, n, i, item_id from pos join win using (n, t)),
words as (select rid, count(distinct i + j) n_hit from (select rid, i, unnest(range(0, n)) j from (select distinct rid, n, i from hit) y) x group by rid),
items as (select rid, count(distinct item_id) n_items, sha256(string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar))) s from hit group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, coalesce(s, sha256('')) items_sha256, n_hit is not null contaminated
from d left join words using (rid) left join items using (rid)
"""
