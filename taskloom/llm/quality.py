"""Quality rules: base counts and a log-likelihood ratio of hashed n-grams (operator 4).

The n-grams of a text are its words, its pairs of adjacent words and, as a
further feature, the pairs of their endings (last two characters), each hashed
into ``buckets`` bins. Two multinomials over the bins are counted over all documents (raw corpus) and over
those labelled good (trusted target), with add-one smoothing. The score of a
text is the mean log ratio of its n-grams; a text is kept if it passes the base
rules and scores at least ``threshold``. Everything is built-in functions: one
aggregate for the counts, in which every word with its successor is a row, and a
scoring pass without a shuffle that looks each n-gram up in one array of
``buckets`` doubles. Functions of array elements are interpreted, so the scoring
pass has as few of them as it can: two for the hashes of words and endings, one
for the n-grams that end with a word, one for triples, and the sort of triples only in texts that
repeat one.

Defined results: a null or empty text has no words and fails the base rules; a
null doc_id is scored like any other but is never labelled; repeated rows are
scored each and counted each; several labels of one document count as good if
one says so; without any good document every ratio is zero. Other columns,
those of ``labels`` included, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.llm.native import words

BUCKETS = 1 << 16
#: Mean log ratio below which a text is closer to the rest of the corpus than to the target.
THRESHOLD = -1.0


def once(c: Column) -> Column:
    """The column as a step of its own. A filter on a later column must not pull this expression into itself, where
    it would run once per array element; the condition is always true, and being random it is never moved."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def bin_of(buckets: int, *hashes: str) -> str:
    """Bin of a word (its hash) or of a pair (both hashes)."""
    return f"cast(pmod({f'xxhash64({hashes[0]}, {hashes[1]})' if len(hashes) > 1 else hashes[0]}, {buckets}) as int)"


def ending(word: str) -> str:
    """Hash of the last two characters; salted, so that no pair of endings is a pair of words."""
    return f"xxhash64(substring({word}, -2), 'pair')"


def grams(texts: DataFrame, ws: str, buckets: int) -> DataFrame:
    """texts with one row per n-gram, its ``bin``: words of the array ``ws``, pairs of neighbours, pairs of their endings."""
    own = [c for c in texts.columns if c != ws]
    each = texts.select(*own, F.inline(F.expr(f"arrays_zip({ws}, slice({ws}, 2, greatest(size({ws}) - 1, 0)))")).alias("_w", "_v"))
    hashed = each.select(*own, *[F.expr(e).alias(n) for n, e in (
        ("_v", "_v"), ("_a", "xxhash64(_w)"), ("_b", "xxhash64(_v)"), ("_c", ending("_w")), ("_d", ending("_v")))])
    found = F.array(F.expr(bin_of(buckets, "_a")), *[
        F.expr(f"if(_v is null, null, {bin_of(buckets, *pair)})") for pair in (("_a", "_b"), ("_c", "_d"))])
    return hashed.select(*own, F.explode(found).alias("bin")).where("bin is not null")


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """One row: ratios, array of ``buckets`` log ratios target / corpus."""
    spark = docs.sparkSession
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1 and doc_id is not null").select(
        F.col("doc_id").alias("good_id"))
    # one strategy at every size: both sides are dealt by id
    marked = docs.join(good.hint("merge"), F.col("doc_id") == F.col("good_id"), "left").select(
        F.col("good_id").isNotNull().cast("long").alias("good"), words(F.col("text")).alias("ws"))
    counts = grams(marked, "ws", buckets).groupBy("bin").agg(
        F.count("*").alias("raw"), F.sum("good").alias("target"))
    bins = spark.range(buckets).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0)
    row = bins.agg(F.sum("raw").alias("r"), F.sum("target").alias("t"),
                   F.array_sort(F.collect_list(F.struct("bin", "raw", "target"))).alias("bins"))
    return row.select(F.expr(f"""transform(bins, x -> if(t = 0, 0D,
        ln((x.target + 1D) / (t + {buckets}D)) - ln((x.raw + 1D) / (r + {buckets}D))))""").alias("ratios"))


def score(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ratio, kept."""
    ratios = log_ratios(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), buckets)
    own = docs.columns
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumns({
        "_ws": once(words(F.col("text"))),
        "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]")),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
    })
    df = df.withColumns({
        "n_words": F.size("_ws").cast("long"),
        "word_chars": F.length(F.array_join("_ws", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hash": once(F.transform("_ws", lambda w: F.xxhash64(w))),
        "_ends": once(F.expr(f"transform(_ws, w -> {ending('w')})")),
    })
    df = df.withColumns({
        "_triples": once(F.expr("transform(slice(_hash, 3, greatest(size(_hash) - 2, 0)), (h, i) -> xxhash64(_hash[i], _hash[i + 1], h))")),
    })
    # word triples by hash, then by place: those equal to a neighbour stand in the text twice or more
    df = df.withColumn("_sorted", once(F.expr(
        "case when size(array_distinct(_triples)) < size(_triples) then sort_array(transform(_triples, (h, i) -> struct(h as h, i as i))) end")))
    df = df.withColumn("_twice", once(F.expr(
        "sort_array(transform(filter(_sorted, (x, i) -> "
        "coalesce(x.h = get(_sorted, i - 1).h, false) or coalesce(x.h = get(_sorted, i + 1).h, false)), x -> x.i))")))
    df = df.withColumns({
        "n_repeat_words": F.coalesce(F.expr(
            "aggregate(transform(_twice, (p, i) -> cast(least(3, coalesce(get(_twice, i + 1) - p, 3)) as bigint)), 0L, (a, x) -> a + x)"),
            F.lit(0).cast("long")),
        "_ratios": ratios.scalar(),
    })
    # the array of ratios is named once, so that no row holds a copy of it
    df = df.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "log_ratio": F.expr(
            f"transform(array(_ratios), r -> aggregate(transform(_hash, (a, i) -> r[{bin_of(buckets, 'a')}] + if(i = 0, 0D, "
            f"r[{bin_of(buckets, '_hash[i - 1]', 'a')}] + r[{bin_of(buckets, '_ends[i - 1]', '_ends[i]')}])), "
            "0D, (total, x) -> total + x))[0] / greatest(3 * size(_hash) - 2, 1)"),
    })
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept"]
    return df.select(*[c for c in own if c not in out], *out)
