"""Quality rules in built-in functions only: text statistics and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PRIOR = 10
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), common.WORD_BREAK), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text, the first occurrence included.

    Windows are told apart by a 64-bit hash. Where all differ the answer is 0; else they are sorted as one number each (the
    first bits of the hash, then the position). Neighbours with equal first bits are few; those are compared by their
    whole hashes, in a sort of their own, and windows that have a twin mark their positions.
    """

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.when(i + 1 < F.size(at), F.least(F.lit(3), at[i + 1] - p)).otherwise(3))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def marked(h: Column) -> Column:
        low = F.when(F.size(h) <= 1 << 20, F.lit((1 << 20) - 1)).otherwise(F.lit((1 << 31) - 1)).cast("long")  # the position's bits
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))

        def near(s: Column) -> Column:
            same = lambda x, j: x.bitwiseXOR(F.get(s, j)).bitwiseAND(F.bitwise_not(low)) == 0
            both = F.filter(s, lambda x, i: ((i > 0) & same(x, i - 1)) | ((i + 1 < F.size(s)) & same(x, i + 1)))
            spots = F.transform(both, lambda x: x.bitwiseAND(low).cast("int"))
            return F.sort_array(F.transform(spots, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            twin = lambda x, j: x["h"] == F.get(s, j)["h"]
            both = F.filter(s, lambda x, i: ((i > 0) & twin(x, i - 1)) | ((i + 1 < F.size(s)) & twin(x, i + 1)))
            return F.sort_array(F.transform(both, lambda x: x["i"]))

        return let(let(let(packed, near), twins), covered)

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(marked(h)))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(count(words))


def gram_buckets(words: Column, buckets: int) -> Column:
    """A bucket for each word and each pair of neighbouring words."""
    put = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    ones = F.transform(words, lambda w: put(F.xxhash64(w)))
    twos = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: put(F.xxhash64(words[i - 1], words[i])))
    return F.when(F.size(words) > 1, F.concat(ones, twos)).otherwise(ones)


def bucket_weights(docs: DataFrame, halves: DataFrame, buckets: int) -> list[float]:
    """For each bucket log P(bucket | trusted) - log P(bucket | all).

    The raw multinomial counts every n-gram of every document; the target counts those of all trusted documents
    of the "fit" half. ``PRIOR`` counts that follow the raw
    multinomial are added to each bucket, so n-grams that were hardly seen say little.
    """
    fit = common.small(halves.filter("fit").select("doc_id", F.lit(1).alias("ok")))
    marked = docs.select("doc_id", "text").join(fit, "doc_id", "left").select("ok", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    grams = marked.select("ok", F.explode(gram_buckets(F.col("words"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("ok").alias("good"), F.count("*").alias("raw"))
    good, raw = [0] * buckets, [0] * buckets
    for r in counts.collect():  # one row a bucket
        good[r["bucket"]], raw[r["bucket"]] = r["good"], r["raw"]
    share = sum(good) / max(1, sum(raw))
    return [math.log((g + PRIOR) / (r * share + PRIOR)) for g, r in zip(good, raw, strict=True)]


def _halves(trusted: DataFrame) -> DataFrame:
    """doc_id of every trusted document, once, and whether it is of the half that is fitted on."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    return common.durable(ids.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0).alias("fit")))


def quality_rules(
    docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 15, keep_share: float = 0.998,
    least_words: int = 50, most_repeated: int = 50, carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr; and the columns ``carry``.

    ``docs``: doc_id, text. ``trusted``: doc_id of trusted documents. llr is the mean over the n-grams of a document of the
    log ratio of the trusted and the raw multinomial. The threshold is the value (to 0.001) that ``keep_share`` of the
    trusted documents outside the fitted half reach; it is the same for every document, and nothing is drawn at random.
    Three scans, and no shuffle of text unless trusted ids are too many to broadcast: counts, threshold (trusted documents only), verdicts.

    A null or empty text has no words, so base_failed is true. Without trusted documents (or with an empty table) every
    ratio is 0 and only the base rules decide. Rows that repeat an id are each judged on their own; a null id is never
    trusted. Other columns are ignored.
    """
    kept_as = {f"_in_{i}": c for i, c in enumerate(carry)}
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(a) for a, c in kept_as.items()]
    )
    halves = _halves(trusted)
    weights = common.literal_table(bucket_weights(rows.select("doc_id", "text"), halves, buckets))
    aside = rows.select("doc_id", "text").join(common.small(halves.filter("not fit").select("doc_id")), "doc_id", "left_semi")
    judge = lambda df: _measure(df, weights, buckets, least_words, most_repeated)
    floor = threshold(judge(aside).filter("not base_failed"), keep_share)
    out = judge(rows).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(floor)))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr",
        *[F.col(a).alias(c) for a, c in kept_as.items()],
    )


def _measure(rows: DataFrame, weights: Column, buckets: int, least_words: int, most_repeated: int) -> DataFrame:
    text, words = F.coalesce(F.col("text"), F.lit("")), F.col("_words")
    total = F.aggregate(
        gram_buckets(words, buckets), F.lit(0.0).cast("double"), lambda a, g: a + F.get(weights, g)
    )
    scored = rows.select("*", F.explode(F.array(words_of(F.col("text")))).alias("_words")).select(
        *rows.columns,
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"),
        n_repeat_words(words).alias("n_repeat_words"),
        F.when(F.size(words) == 0, 0.0).otherwise(total / (2 * F.size(words) - 1)).alias("llr"),
    )
    return scored.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))


def threshold(scored: DataFrame, keep_share: float) -> float:
    """The llr, to 0.001, that ``keep_share`` of the rows reach; minus infinity if there are none."""
    steps = scored.groupBy(F.floor(F.col("llr") * 1000).alias("step")).count()
    counts = sorted((r["step"], r["count"]) for r in steps.collect())  # the ratio is bounded, so the steps are few thousand at most
    below, most = 0, (1 - keep_share) * sum(n for _, n in counts)
    for step, n in counts:
        below += n
        if below > most:
            return step / 1000
    return float("-inf")
