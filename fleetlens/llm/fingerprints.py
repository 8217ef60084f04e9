"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a bag of word n-grams weighted by their counts. For sample k each term gets,
from hashes of (term, k), r and c ~ Gamma(2, 1) and b ~ U(0, 1). With weight w,
t = floor(ln w / r + b) and a = c * exp(-r * (t - b + 1)); the term with the smallest a is
the sample. a depends on the term, k and t alone, so two documents share a sample exactly if
they share that (term, t), which happens with the generalised Jaccard similarity
sum(min(w)) / sum(max(w)) as probability. The minimum of a itself therefore identifies the
sample, and one hash aggregation with K minima yields the signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NULL_ID, range_bucket, range_splits, shuffle_partitions, stash, told_apart

#: Samples in a signature, words in a term.
SAMPLES, TERM_WORDS = 16, 2
#: Text is dealt to this many times the usual number of partitions.
SMALLER = 4


def terms(text: Column, n: int = TERM_WORDS) -> Column:
    """Array of the hashes of the word n-grams of a text (fewer words: the whole sequence as one; none: empty)."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    if n == 1:
        return F.transform(words, lambda w: F.xxhash64(w))
    grams = lambda a: F.transform(
        F.slice(a, 1, F.greatest(F.size(a) - (n - 1), F.least(F.size(a), F.lit(1)))),
        lambda w, i: F.xxhash64(w, *[F.get(a, i + j) for j in range(1, n)]),
    )
    # Bound as a lambda's variable, the array of words is made once and not again for each of its elements.
    return F.get(F.transform(F.array(words), grams), 0)


def _unit(bits: Column, shift: int, width: int) -> Column:
    """A number in (0, 1) from `width` bits of a hash."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(0.5)) / F.lit(float(1 << width))


def _gamma(bits: Column) -> Column:
    """A draw of Gamma(2, 1), the sum of two exponentials, from the low 32 bits of a hash (16 each)."""
    return -F.log(_unit(bits, 0, 16) * _unit(bits, 16, 16))


def sample(term: Column, weight: Column, k: int) -> Column:
    """a of one term for sample k: the smallest over a document's terms is its sample.

    Two 64-bit hashes give all randomness: c and b come from the first (32 bits each), r from the
    second. r must not be cut off: on a long text the rare terms' smallest a come from the largest r.
    """
    h, g = F.xxhash64(term, F.lit(k)), F.xxhash64(term, F.lit(-1 - k))
    c, b, r = _gamma(h), _unit(h, 32, 32), _gamma(g)
    # ln 1 = 0, so most terms need no logarithm and no floor: t is 0.
    t = F.when(weight == 1, F.lit(0.0)).otherwise(F.floor(F.log(weight) / r + b).cast("double"))
    return c * F.exp(r * (b - F.lit(1.0) - t))


def signatures(bags: DataFrame, keys: list[str], term: str, weight: str, samples: int = SAMPLES) -> DataFrame:
    """keys + sig (array of ints, one per sample) from rows (keys, term, weight).

    Terms must be bigint hashes, weights positive. A null term stands for an empty document:
    if it is all a document has, every sample is 0; otherwise it counts for nothing.
    """
    real = F.col(term).isNotNull()
    least = [F.min(F.when(real, sample(F.col(term), F.col(weight).cast("double"), k))).alias(f"__a{k}") for k in range(samples)]
    made = bags.groupBy(*keys).agg(*least)
    code = lambda a: F.coalesce(F.when(a.isNotNull(), F.xxhash64(a).bitwiseAND(F.lit(0x7FFFFFFF))), F.lit(0)).cast("int")
    return made.select(*keys, F.array(*[code(F.col(f"__a{k}")) for k in range(samples)]).alias("sig"))


def fingerprint(docs: DataFrame, keys: list[str], text: str, samples: int = SAMPLES, n: int = TERM_WORDS) -> DataFrame:
    """keys + sig for each document of docs (rows with equal keys are one document).

    Null text counts as empty; an empty text or one of white space alone gets zeros. Extra
    columns are ignored. If docs is already partitioned by (some of) the keys nothing is shuffled.
    """
    words = docs.select(*keys, F.explode_outer(terms(F.coalesce(F.col(text), F.lit("")), n)).alias("__term"))
    bags = words.groupBy(*keys, "__term").agg(F.count(F.lit(1)).alias("__weight"))
    return signatures(bags, keys, "__term", "__weight", samples)


def likeness(one: Column, two: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples: an unbiased estimate of generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(one, two, lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x) / F.lit(float(samples))


def as_text(sig: Column) -> Column:
    """A signature as a hex string of eight digits a sample."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def next_ids(ids: DataFrame, col: str) -> DataFrame:
    """(col, next_id): the id that follows in descending order; after the smallest comes the largest.

    Windows run within ranges of ids; one row per range carries the ends over.
    """
    splits = range_splits(ids, col, shuffle_partitions(ids.sparkSession))
    held = ids.select(col, range_bucket(F.col(col), splits).alias("__r"))
    ends = held.groupBy("__r").agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    order = Window.orderBy("__r")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("__r", F.coalesce(F.lag("__hi").over(order), F.max("__hi").over(whole)).alias("__below"))
    inside = Window.partitionBy("__r").orderBy(col)
    found = held.withColumn("__p", F.lag(col).over(inside)).join(F.broadcast(ends), "__r")
    return found.select(col, F.coalesce("__p", "__below").alias("next_id"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """(id, next_id, n_chars, text, edited) for docs (id, text), no id null or twice: each text and its edited form.

    Edited: the last floor(n_chars / 3) code points give way to the first as many, or all,
    of the next document's. Text is shuffled once; only the prefixes asked for travel on.
    """
    held = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    # Terms are counted where the text lies, so partitions are cut small enough for their hash tables.
    laid = held.repartition(SMALLER * shuffle_partitions(docs.sparkSession), "id")
    follow = stash(next_ids(held.select("id"), "id"), "next")
    asked = held.select("id", F.char_length("text").alias("n")).join(follow, "id")
    asks = asked.select(F.col("next_id").alias("__of"), F.col("id").alias("__for"), "next_id", F.col("n").alias("n_chars"), F.floor(F.col("n") / 3).cast("int").alias("__need"))
    given = laid.join(asks.hint("shuffle_hash"), laid["id"] == asks["__of"]).select("__for", "next_id", "n_chars", "__need", F.col("text").substr(F.lit(1), F.col("__need")).alias("__tail"))
    both = laid.join(given.hint("shuffle_hash"), laid["id"] == given["__for"])
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars") - F.col("__need")), F.col("__tail"))
    return both.select("id", "next_id", F.col("n_chars").cast("long").alias("n_chars"), "text", F.coalesce(edited, F.lit("")).alias("edited"))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, n: int = TERM_WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how near they are.

    Rows that repeat a doc_id are documents of their own, one after another in the order of ids.
    A null id is the smallest. Null text: empty.
    """
    docs, repeated = told_apart(docs.select("doc_id", "text"))
    pairs = edited_pairs(docs.select(F.col("__row").alias("id"), "text"))
    forms = pairs.select("id", F.inline(F.array(F.struct(F.lit(False).alias("form"), F.col("text").alias("body")), F.struct(F.lit(True).alias("form"), F.col("edited").alias("body")))))
    words = forms.select("id", "form", F.explode_outer(terms(F.col("body"), n)).alias("__term"))
    bags = words.groupBy("id", "form", "__term").agg(F.count(F.lit(1)).alias("__weight"))
    sigs = signatures(bags, ["id", "form"], "__term", "__weight", samples)
    pick = lambda form: F.max(F.when(F.col("form") == form, F.col("sig")))
    both = sigs.groupBy("id").agg(pick(False).alias("sig"), pick(True).alias("edited_sig"))
    facts = pairs.select("id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    rows = stash(both.join(facts.hint("shuffle_hash"), "id"), "fingerprints")
    following = rows.select(F.col("id").alias("next_id"), F.col("sig").alias("next_sig"))
    rows = rows.join(docs.select(F.col("__row").alias("id"), "doc_id"), "id") if repeated else rows.withColumn("doc_id", F.when(F.col("id") != NULL_ID, F.col("id")))
    return rows.join(following, "next_id").select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig"), samples).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig"), samples).alias("near_next"),
    )
