"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Words are the runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased.  Of the hashes of K consecutive
words each window of WINDOW - K + 1 neighbours keeps the least, with its place; so every span of WINDOW words that a
document shares with an item has a fingerprint in common with it.  Documents' fingerprints are joined with the
items', and each match is extended over the neighbouring words: WINDOW words or more that agree around it are hit.
Items of fewer than WINDOW words, but not none, are one window each; for each such length that occurs (nine at
most) the documents' grams of that length are joined too.

The items' fingerprints are broadcast if there are at most BROADCAST_ROWS of them, and joined by a shuffle
otherwise.  Fingerprints never leave the task that made them in the first case; only matches are shuffled.  A table
with fewer input partitions than the session has cores (one small file) is dealt out first.

Defined cases: null texts have no words; items without words are in no document; an item whose item_id is null
marks words but isn't listed; repeated items are listed once; repeated rows are judged each; a null doc_id is
kept; with no items nothing is hit; an empty table gives no rows; a text of any length is one array of its words'
hashes, some 100 bytes a word; other columns are passed through only if named.  Words count as equal if their
64-bit hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
K = 5
BROADCAST_ROWS = 200_000
#: The low bits of a fingerprint hold its place; a text of 2^31 bytes has fewer words than 2^30.
PLACE_BITS = 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A text's words as an array."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), GAPS), "")


def fingerprints(df: DataFrame, keep: list[str], short: list[int], window: int, k: int) -> DataFrame:
    """keep, n_words, and prints: an array of (size, hash, place, left, around) - the words of the print and up to
    window - k on either side, as hashes, left of them before it.  short: lengths below window to take as they are."""
    place = (1 << PLACE_BITS) - 1
    df = df.select(*keep, words(F.col("text")).alias("_w")).select(*keep, F.expr("transform(_w, x -> xxhash64(x))").alias("_h"))
    df = df.select(*keep, "_h", F.size("_h").alias("n_words"))
    packed = f"transform(slice(_h, 1, greatest(n_words - {k - 1}, 0)), (x, i) -> (xxhash64(slice(_h, i + 1, {k})) & {(1 << 63) - 1 - place}L) | i)"
    df = df.withColumn("_g", F.expr(packed))
    span = window - k + 1
    df = df.withColumn("_f", F.expr(f"array_distinct(transform(slice(_g, 1, greatest(size(_g) - {span - 1}, 0)), (x, i) -> array_min(slice(_g, i + 1, {span}))))"))
    side = window - k
    at = f"cast(v & {place}L as int)"
    prints = f"transform(_f, v -> struct({window} as size, v & {(1 << 63) - 1 - place}L as hash, {at} as place, least({at}, {side}) as left, slice(_h, {at} - least({at}, {side}) + 1, least({at}, {side}) + {k + side}) as around))"
    for n in short:
        prints += f", transform(slice(_h, 1, greatest(n_words - {n - 1}, 0)), (x, i) -> struct({n} as size, xxhash64(slice(_h, i + 1, {n})) as hash, cast(i as int) as place, 0 as left, cast(array() as array<bigint>) as around))"
    return df.select(*keep, "n_words", F.expr(f"concat({prints})").alias("prints"))


def _run(mine: str, other: str, at: str, step: int, most: int) -> str:
    """How many words agree, one after another, from an offset on, most at most."""
    tests = [f"{at.format(mine)} + {step * i} < 0 or {at.format(other)} + {step * i} < 0 or get({mine}.around, {at.format(mine)} + {step * i}) is null or not (get({mine}.around, {at.format(mine)} + {step * i}) <=> get({other}.around, {at.format(other)} + {step * i}))" for i in range(most)]
    return "case " + " ".join(f"when {t} then {i}" for i, t in enumerate(tests)) + f" else {most} end"


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, k: int = K, columns: tuple[str, ...] = ("doc_id",), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """columns of docs with n_words, n_hit, items (those whose windows occur, as sorted strings) and n_items."""
    items = items.select("item_id", "text")
    sizes = items.select(F.size(words(F.col("text"))).alias("n"))
    short = sorted(r["n"] for r in sizes.filter(f"n between 1 and {window - 1}").distinct().collect())  # fewer than window of them
    own = fingerprints(items, ["item_id"], [], window, k).select("item_id", F.explode("prints").alias("p"))
    own = own.select("item_id", F.col("p.size").alias("i_size"), F.col("p.hash").alias("i_hash"), F.struct("p.left", "p.around").alias("q"))
    if short:
        small = items.select("item_id", words(F.col("text")).alias("w")).select("item_id", F.expr("transform(w, x -> xxhash64(x))").alias("h")).filter(f"size(h) between 1 and {window - 1}")
        own = own.unionByName(small.select("item_id", F.size("h").alias("i_size"), F.xxhash64("h").alias("i_hash"), F.struct(F.lit(0).alias("left"), F.array().cast("array<bigint>").alias("around")).alias("q")))
    own = own.distinct()
    few = own.limit(broadcast_rows + 1).count() <= broadcast_rows

    renamed = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    names = [f"c{i}" for i in range(len(columns))]
    rows = docs.select(*renamed, F.col("text").alias("text"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    made = fingerprints(rows, ["rid", *names], short, window, k)
    # one row of each text stays without a print, so that texts without a match stay
    p = made.select("rid", *names, "n_words", F.explode(F.expr("concat(array(cast(null as struct<size: int, hash: bigint, place: int, left: int, around: array<bigint>>)), prints)")).alias("p"))
    met = p.join(F.broadcast(own) if few else own, (p["p"]["size"] == own["i_size"]) & (p["p"]["hash"] == own["i_hash"]), "left").filter("p is null or i_size is not null")
    before, behind = _run("p", "q", "{0}.left - 1", -1, window - k), _run("p", "q", f"{{0}}.left + {k}", 1, window - k)
    same = f"slice(p.around, p.left + 1, {k}) = slice(q.around, q.left + 1, {k})"
    met = met.select("rid", *names, "n_words", "item_id", "p", F.expr(f"case when p is null then null when p.size < {window} then 0 when {same} then {before} end").alias("l"), F.expr(f"case when p is null then null when p.size < {window} then p.size when {same} then {k} + {behind} end").alias("r"))
    met = met.withColumn("hit", F.expr("l + r >= p.size"))
    met = met.filter("p is null or hit").select("rid", *names, "n_words", F.expr("if(hit, struct(p.place - l as a, p.place + r as b), null)").alias("span"), F.expr("if(hit, cast(item_id as string), null)").alias("item"))
    one = met.groupBy("rid", "n_words", *names).agg(F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    hit = "aggregate(spans, struct(0L as n, 0 as e), (s, x) -> struct(s.n + greatest(x.b - greatest(x.a, s.e), 0) as n, greatest(s.e, x.b) as e), s -> s.n)"
    return one.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), F.col("n_words").cast("long").alias("n_words"), F.expr(hit).alias("n_hit"), "items", F.size("items").cast("long").alias("n_items"))


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without contaminated rows, with their own columns."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    found = contamination(docs.select("doc_id", "text", digest.alias("digest")), items, columns=("doc_id", "digest"), **options)
    bad = found.filter("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (digest == bad["_digest"]), "left_anti")
