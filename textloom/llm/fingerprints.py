"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is its words weighted by their counts. For each sample every weighted word draws, from a
hash of word and sample, r and c from the gamma distribution of shape 2 and b from the uniform one;
with t = floor(ln(weight) / r + b) its value is ln c - r (t - b + 1), and the word and t with the
least value are the sample. Two documents agree in a sample with a probability equal to the
generalised Jaccard similarity of their weighted words. Value and identity are packed into one
64-bit integer, so that a sample is a plain ``min`` over the words.

Documents are dealt once by a hash of doc_id and text. Their words are counted and sampled where they are,
without a further shuffle; only thirds of texts and finished fingerprints travel to the neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.shared import staged

SAMPLES = 32
REPEATS = 1 << 12
NULL_ID = -(1 << 63)
BLANK = r"[\x20\x09-\x0D]+"


def uniform(bits: Column, shift: int, width: int) -> Column:
    """A value strictly between 0 and 1 from ``width`` bits of a hash."""
    part = F.shiftrightunsigned(bits, shift) if shift else bits
    return (part.bitwiseAND(F.lit((1 << width) - 1)) + F.lit(0.5)) * F.lit(2.0**-width)


def sample(k: int) -> Column:
    """The packed value of a word in sample ``k``, from columns h (its hash) and lw (ln weight)."""
    one, two = F.xxhash64(F.col("h"), F.lit(2 * k)), F.xxhash64(F.col("h"), F.lit(2 * k + 1))
    r = -F.ln(uniform(one, 0, 32) * uniform(one, 32, 31))
    log_c = F.ln(-F.ln(uniform(two, 0, 22) * uniform(two, 22, 22)))
    b = uniform(two, 44, 20)
    t = F.floor(F.col("lw") / r + b)
    value = ((log_c - r * (t - b + F.lit(1.0)) + F.lit(1000.0)) * F.lit(2.0**32)).cast("long")
    return F.shiftleft(value, 21).bitwiseOR(one.bitwiseXOR(t).bitwiseAND(F.lit((1 << 21) - 1)))


def signatures(texts: DataFrame) -> DataFrame:
    """(id, keys): the samples of each text of (id, text), 32 bits of each; texts without words have no row.

    Where the rows are already dealt by id, neither aggregation moves them.
    """
    words = texts.select("id", F.explode(F.split("text", BLANK)).alias("word")).where("word != ''")
    counted = words.select("id", F.xxhash64("word").alias("h")).groupBy("id", "h").agg(F.count(F.lit(1)).alias("n"))
    weighted = counted.select("id", "h", F.ln("n").alias("lw"))
    least = weighted.groupBy("id").agg(*(F.min(sample(k)).alias(f"k{k}") for k in range(SAMPLES)))
    low = F.lit(0xFFFFFFFF)
    return least.select("id", F.array(*(F.col(f"k{k}").bitwiseAND(low) for k in range(SAMPLES))).alias("keys"))


def key_of(doc_id: Column, text_key: Column) -> Column:
    """doc_id and a hash of the text as one string in hex, whose order is that of doc_id; one plain column, so
    that what is dealt by it once need not move again."""
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.concat(hexed(doc_id.bitwiseXOR(F.lit(NULL_ID))), hexed(text_key.bitwiseXOR(F.lit(NULL_ID))))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two signatures agree; two texts without words are alike."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same / F.lit(float(SAMPLES)))


def written(keys: Column) -> Column:
    """A signature as text: each sample in hex, empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(keys, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(""))


def neighbours(docs: DataFrame) -> DataFrame:
    """(id, prev_id, need, times): each document's predecessor in descending order of id, the last one's
    successor being the first, and how many code points of it the predecessor may ask for.

    Ids are ordered range by range; only the largest id of each range meets the others in one task.
    """
    ids = staged(docs.groupBy("id").agg(F.max(F.length("text")).alias("n"), F.count(F.lit(1)).alias("times")), "ids")
    ranged = staged(ids.repartitionByRange("id").withColumn("range", F.spark_partition_id()), "ranges")
    tops = ranged.groupBy("range").agg(F.max("id").alias("top"))
    order = Window.orderBy("range")
    below = tops.select("range", F.coalesce(F.lag("top").over(order), F.max("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("below"))
    inside = ranged.select("range", "id", "n", "times", F.lead("id").over(Window.partitionBy("range").orderBy(F.desc("id"))).alias("next"))
    linked = inside.join(F.broadcast(below), "range")  # a row for each partition of the shuffle
    return linked.select(F.coalesce("next", "below").alias("id"), F.col("id").alias("prev_id"), F.floor(F.col("n") / 3).cast("int").alias("need"), "times")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for
    every document.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or
    all) of the next document in descending order of doc_id and, where these are equal, of a hash of the text. A
    null text is empty; a null doc_id is smaller than any other. Rows that repeat a doc_id are each
    fingerprinted; rows that repeat doc_id and text are one document in that order, with a row of the
    result for each of them. A single document is its own next. Texts without words have an empty
    fingerprint. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    plain = docs.select(key_of(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.xxhash64(text)).alias("id"), text.alias("text"))
    own = plain.groupBy("id").agg(F.min("text").alias("text"))
    links = staged(neighbours(plain), "neighbours")
    heads = own.join(links, "id").select(F.col("prev_id").alias("id"), "times", F.expr("substring(text, 1, need)").alias("head"))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = own.join(heads, "id").select("id", "times", F.length("text").cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("head", F.lit(1), third)).alias("text"))
    facts = edited.select("id", "times", "n_chars", F.sha2(F.encode("text", "utf-8"), 256).alias("edited_sha256"))
    signed = signatures(own).join(links.select("id", "prev_id"), "id")
    sent = signed.select(F.explode(F.array(F.struct("id", F.lit(True).alias("own")), F.struct(F.col("prev_id").alias("id"), F.lit(False).alias("own")))).alias("to"), "keys")
    pairs = sent.groupBy("to.id").agg(F.max(F.when(F.col("to.own"), F.col("keys"))).alias("own"), F.max(F.when(~F.col("to.own"), F.col("keys"))).alias("next"))
    all_ = facts.join(signatures(edited), "id", "left").join(pairs, "id", "left")
    # Rows that repeat, in two steps so that neither makes a long list.
    times = F.col("times") - 1
    many = all_.withColumn("many", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(times / REPEATS))))
    many = many.withColumn("few", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(REPEATS - 1), times - F.col("many") * REPEATS))))
    own_id = F.conv(F.substring("id", 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(NULL_ID))
    doc_id = F.when(own_id != NULL_ID, own_id)
    return many.select(
        doc_id.alias("doc_id"), "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("keys")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("keys")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
