"""Secrets in built-in functions only: fixed patterns, and character Markov models for random-looking strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import let, words_of

ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans_of(text: Column, pattern: str, kind: str, rank: int, good) -> Column:
    """(start, rank, kind, end) of the leftmost non-overlapping matches for which ``good(match, group 2 or match)`` holds.

    Starts follow from the lengths of what lies between matches, in code points.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if pattern == ASSIGN else None

    def place(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda x: F.struct(F.char_length(x["gap"]).alias("g"), F.coalesce(F.char_length(x["hit"]), F.lit(0)).alias("n")))
        ends = let(lengths, lambda x: running(x))
        second = inner if inner is not None else found
        rows = F.transform(found, lambda h, i: F.struct(h.alias("h"), F.get(second, i).alias("v"), i.alias("i")))
        kept = F.filter(rows, lambda r: good(r["h"], r["v"]))
        return let(ends, lambda e: F.transform(kept, lambda r: F.struct(
            F.get(e, r["i"])["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.get(e, r["i"])["e"].alias("end"))))

    none = F.array().cast(SPAN)
    return let(hits, lambda found: F.when(F.size(found) == 0, none).otherwise(place(found).cast(SPAN)))


def running(lengths: Column, run: int = 256) -> Column:
    """(s, e) of each match, from the lengths (g, n) of the gap before it and of itself: running sums, in runs of ``run``.

    Appending copies a list, so runs are summed first: the cost of n matches is n * run and (n / run) ** 2, not n ** 2.
    """
    spot = "array<struct<s:int,e:int>>"
    count = F.floor((F.size(lengths) + run - 1) / run).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.slice(lengths, i * run + 1, run))

    def begins(part: Column) -> Column:
        total = F.transform(part, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y["g"] + y["n"]))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(total, zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))["out"]

    def inside(part: Column, at: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            s = a["at"] + x["g"]
            return F.struct((s + x["n"]).alias("at"), F.array_append(a["out"], F.struct(s.alias("s"), (s + x["n"]).alias("e"))).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(spot).alias("out")), step)["out"]

    return let(parts, lambda p: let(begins(p), lambda b: F.flatten(F.transform(p, lambda x, i: inside(x, F.get(b, i))))))


def _pairs(token: Column) -> Column:
    """Numbers of the character pairs of a token: previous (0 at the start) times the alphabet's size, plus next."""
    n = len(ALPHABET) + 1
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    return F.transform(
        F.sequence(F.lit(1), F.char_length(token)),
        lambda i: F.when(i == 1, F.lit(0)).otherwise(at(i - 1)) * n + at(i),
    )


def labelled_samples(spark: SparkSession, docs: DataFrame, n_random: int = 20_000, n_docs: int = 2_000) -> DataFrame:
    """token, random (1 or 0), aside: digests in four notations, and identifiers made of the words of about ``n_docs`` documents.

    The documents are those with a hash of their id below a threshold; identifiers are single words and words joined
    with underscores, hyphens or capitals. A quarter (by the hash of the token) stands ``aside`` to measure the models.
    """
    seed = F.col("id").cast("string")
    digest = F.sha2(F.concat(F.lit("sample"), seed), 256)
    raw = F.base64(F.unhex(digest))
    shape = F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.substring(raw, 1, 40))
    shape = shape.when(F.col("id") % 4 == 2, F.upper(F.substring(raw, 1, 20))).otherwise(F.regexp_replace(F.substring(raw, 1, 32), "[+/=]", "0"))
    hard = spark.range(n_random).select(shape.alias("token"), F.lit(1).alias("random"))
    few = common.by_hash(docs.select("doc_id", "text"), "doc_id", n_docs, docs.count())
    w = F.col("w")
    few = few.select(F.explode(F.array(F.filter(words_of(F.col("text")), lambda x: x.rlike("^[A-Za-z]+$")))).alias("w"))
    few = few.filter(F.size("w") >= 4).select("w", F.explode(F.sequence(F.lit(3), F.size("w") - 1)).alias("i"))
    i = F.col("i")
    joined = F.when(i % 4 == 0, w[i]).when(i % 4 == 1, F.concat_ws("_", w[i - 2], w[i - 1], w[i])).when(i % 4 == 2, F.concat_ws("-", w[i - 1], w[i]))
    joined = joined.otherwise(F.concat(F.lower(w[i - 3]), F.initcap(w[i - 2]), F.initcap(w[i - 1])))
    every = hard.unionByName(few.select(joined.alias("token"), F.lit(0).alias("random")))
    return every.withColumn("aside", F.pmod(F.xxhash64("token"), F.lit(4)) == 0)


def train(samples: DataFrame) -> DataFrame:
    """One row, ``table``: for every pair of characters log P(next | previous, random) - log P(next | previous, ordinary)."""
    n = len(ALPHABET) + 1
    pairs = samples.filter("token <> ''").select("random", F.explode(_pairs(F.col("token"))).alias("pair"))
    seen = pairs.groupBy("pair").agg(F.sum("random").alias("a"), F.sum(1 - F.col("random")).alias("b"))
    every = samples.sparkSession.range(n * n).select(F.col("id").cast("int").alias("pair")).join(seen, "pair", "left")
    every = every.select("pair", F.floor(F.col("pair") / n).alias("p"), (F.coalesce("a", F.lit(0)) + 0.5).alias("a"), (F.coalesce("b", F.lit(0)) + 0.5).alias("b"))
    rows = every.groupBy("p").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    ratio = F.log(F.col("a") / F.col("sa")) - F.log(F.col("b") / F.col("sb"))
    both = every.join(rows, "p").select("pair", ratio.alias("r"))
    listed = F.sort_array(F.collect_list(F.struct("pair", "r")))
    return both.agg(F.transform(listed, lambda x: x["r"]).alias("table"))


def ratio(token: Column, table: Column) -> Column:
    """Log-likelihood ratio of a token, per character."""
    total = F.aggregate(F.transform(_pairs(token), lambda p: F.get(table, p)), F.lit(0.0).cast("double"), lambda a, x: a + x)
    return total / F.greatest(F.char_length(token), F.lit(1))


def calibrate(aside: DataFrame, table: Column, least_chars: int, most_false: float) -> tuple[float, float]:
    """(threshold, recall): the least ratio, in steps of 0.05 from 0.5 up, that at most ``most_false`` of ordinary strings reach.

    Ordinary strings count from three quarters of ``least_chars`` on; recall is that of the random strings aside.
    """
    step = F.least(F.lit(100), F.greatest(F.lit(0), F.floor((ratio(F.col("token"), table) - 0.5) / 0.05 + 1))).cast("int")
    held = aside.filter(F.char_length("token") >= F.when(F.col("random") == 1, 1).otherwise(3 * least_chars // 4))
    counts = {(r["step"], r["random"]): r["count"] for r in held.groupBy(step.alias("step"), "random").count().collect()}  # at most 202 rows
    above = lambda k, label: sum(n for (s, x), n in counts.items() if x == label and s > k)
    total = max(1, above(-1, 0)), max(1, above(-1, 1))
    for k in range(100):
        if above(k, 0) <= most_false * total[0]:
            break
    return 0.5 + 0.05 * k, above(k, 1) / total[1]


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, least_chars: int = 20, most_false: float = 0.001) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    The patterns give the base spans. Every other run of ``least_chars`` or more token characters that overlaps none
    of them is a span of kind "random" if its log-likelihood ratio a character, random to ordinary, reaches a threshold:
    the least from 0.5 on that at most ``most_false`` of the ordinary labelled strings held aside reach. ``samples``:
    token, random, aside. Spans are kind:start:end in code points, end exclusive, by start and then kind.

    Null and empty texts have no spans. Rows are judged one by one, so repeated rows and ids agree; other columns are
    ignored, and an empty table gives no rows (the models then rest on the random samples alone).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    given = common.durable(samples if samples is not None else labelled_samples(spark, rows))
    table = common.literal_table(train(given.filter("not aside")).first()["table"])  # a number for each pair of characters
    least_ratio, _ = calibrate(given.filter("aside"), table, least_chars, most_false)
    text = F.col("text")
    yes = lambda h, v: F.lit(True)
    found = rows.select(
        "doc_id",
        F.explode(
            F.array(
                F.struct(
                    spans_of(text, ASSIGN, "assign", 0, lambda h, v: F.char_length(v) >= 6).alias("assign"),
                    spans_of(text, ACCESS, "access", 1, lambda h, v: F.char_length(h) >= 20).alias("access"),
                    spans_of(text, HEX, "hex", 2, yes).alias("hex"),
                    spans_of(text, "[A-Za-z0-9+/_=-]{%d,}" % least_chars, "random", 3, lambda h, v: ratio(h, table) >= least_ratio).alias("random"),
                )
            )
        ).alias("f"),
    )
    base = F.concat("f.assign", "f.access", "f.hex")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    extra = F.filter("f.random", lambda r: ~F.exists("base", lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"])))
    return (
        found.select("*", F.explode(F.array(F.sort_array(base))).alias("base"))
        .select("*", F.explode(F.array(extra)).alias("more"))
        .select(
            "doc_id",
            F.size("f.assign").cast("long").alias("n_assign"),
            F.size("f.access").cast("long").alias("n_access"),
            F.size("f.hex").cast("long").alias("n_hex"),
            F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
            joined(F.sort_array(F.concat("base", "more"))).alias("spans"),
            F.size("more").cast("long").alias("n_random"),
        )
    )
