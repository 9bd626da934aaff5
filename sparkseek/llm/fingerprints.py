"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is the multiset of its paragraphs (parts between newlines; a null text is empty, and every
text has at least one paragraph, maybe an empty one). Each paragraph becomes a wide vector:

* 8 equality lanes of 32 bits: four 64-bit hashes of the whole paragraph;
* 128 likeness lanes of 32 bits: for each word of the paragraph, the 128 sign bits hashed from the
  shingle of up to three words that begins there, added up;
* one count lane: the number of those shingles.

A fingerprint is the lane-wise sum modulo 2**32, of every lane. Addition commutes, so the order of paragraphs
doesn't matter, and `combine` adds or takes away paragraphs without the rest of the text, in any order.

Likeness is the cosine of the two documents' signed likeness lanes, which estimates the cosine of
their shingle counts with a standard error of about 0.09; below zero counts as zero, and equal
fingerprints give exactly 1.

Rows with a null id come after all others; rows that share an id are ordered by a hash of their texts, then by the texts, and those that agree
in both are interchangeable; an empty table gives an empty result; other columns are ignored. A single row is its own neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions

WORD_BREAK = r"[\x20\x09-\x0D]+"
LANE = 0xFFFFFFFF
NULL = -(1 << 63)  # stands for a null id in the order of ids
EQUALITY, LIKENESS = 4, 2  # 64-bit hashes of a paragraph; of a shingle


def _lane_names() -> list[str]:
    return [f"e{i}{half}" for i in range(EQUALITY) for half in "hl"] + [f"s{i}_{j}" for i in range(LIKENESS) for j in range(32)] + ["n"]


def sums(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row for each value of keys with the sums `e..`, `s..` and `n` over the text's paragraphs.

    An `s` sum holds two lanes of 32 bits, which 2**32 shingles would fill; a text has fewer than 2**31 characters.
    """
    paragraphs = df.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_p"))
    words = F.filter(F.split("_p", WORD_BREAK), lambda w: w != "")
    hashed = paragraphs.select(*keys, *[F.xxhash64(F.lit(i), "_p").alias(f"_e{i}") for i in range(EQUALITY)], words.alias("_w"))
    shingles = F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))
    rows = hashed.select(*keys, *[f"_e{i}" for i in range(EQUALITY)], F.posexplode_outer(shingles).alias("_at", "_h"))
    once = F.coalesce(F.col("_at"), F.lit(0)) == 0
    bits = [F.coalesce("_h", F.lit(0)), F.when(F.col("_h").isNotNull(), F.xxhash64("_h")).otherwise(0)]
    rows = rows.select(*keys, *[F.when(once, F.col(f"_e{i}")).otherwise(0).alias(f"_e{i}") for i in range(EQUALITY)], *[b.alias(f"_b{i}") for i, b in enumerate(bits)], F.col("_h").isNotNull().cast("long").alias("_n"))
    halves = [(F.shiftrightunsigned(f"_e{i}", 32) if half == "h" else F.col(f"_e{i}").bitwiseAND(F.lit(LANE))) for i in range(EQUALITY) for half in "hl"]
    signs = [F.shiftrightunsigned(f"_b{i}", j).bitwiseAND(F.lit(0x100000001)) for i in range(LIKENESS) for j in range(32)]
    return rows.groupBy(*keys).agg(*[F.sum(x).alias(name) for x, name in zip([*halves, *signs, F.col("_n")], _lane_names(), strict=True)])


def lanes(prefix: str = "") -> Column:
    """The sums of a row as array<bigint>: equality lanes, pairs of likeness lanes, count."""
    names = _lane_names()
    equality = [F.col(prefix + x).bitwiseAND(F.lit(LANE)) for x in names[: 2 * EQUALITY]]
    return F.array(*equality, *[F.col(prefix + x) for x in names[2 * EQUALITY :]])


def as_text(vector: Column) -> Column:
    """Hexadecimal digits: 8 for each equality lane, 16 for each pair of likeness lanes and the count."""
    return F.concat(
        *[F.lpad(F.lower(F.hex(vector[i])), 8, "0") for i in range(2 * EQUALITY)],
        F.array_join(F.transform(F.slice(vector, 2 * EQUALITY + 1, 32 * LIKENESS + 1), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""),
    )


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """The vector of the paragraphs of both (sign 1), or of left without those of right (sign -1)."""
    one = lambda x, y: F.pmod(x + sign * y, F.lit(LANE + 1))
    low, high = lambda x: x.bitwiseAND(F.lit(LANE)), lambda x: F.shiftrightunsigned(x, 32)
    # a likeness entry holds two lanes, and neither borrows from the other
    return F.zip_with(left, right, lambda x, y: F.shiftleft(one(high(x), high(y)), 32).bitwiseOR(one(low(x), low(y))))


def _signed(vector: Column) -> Column:
    n = F.element_at(vector, -1)
    pairs = F.slice(vector, 2 * EQUALITY + 1, 32 * LIKENESS)
    high = F.transform(pairs, lambda x: (2 * F.shiftrightunsigned(x, 32) - n).cast("double"))
    low = F.transform(pairs, lambda x: (2 * x.bitwiseAND(F.lit(LANE)) - n).cast("double"))
    return F.concat(high, low)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _likeness(a: Column, b: Column, same: Column, sa: Column, sb: Column, na: Column, nb: Column) -> Column:
    cosine = F.when((na > 0) & (nb > 0), _dot(sa, sb) / F.sqrt(na * nb)).otherwise(0.0)
    return F.when(same, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, vector, fingerprint) of every text; rows that agree in id and text give one row."""
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    keyed = df.select("_id", F.sha2("_t", 256).alias("_k"), "_t").dropDuplicates(["_id", "_k"])
    out = sums(keyed, ["_id", "_k"], "_t").select(F.col("_id").alias(id_col), lanes().alias("vector"))
    return out.select(id_col, "vector", as_text(F.col("vector")).alias("fingerprint"))


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _at_most(cuts: list[int], value: Column) -> Column:
    """How many of the ascending cuts are at most the value, by binary search."""
    if not cuts:
        return F.lit(0).cast("bigint")
    steps = _numbers([1 << i for i in reversed(range(len(cuts).bit_length()))])
    ahead = lambda at, step: F.get(_numbers(cuts), (at + step - 1).cast("int"))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda at, step: F.when(ahead(at, step) <= value, at + step).otherwise(at))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_partition: int = 4) -> DataFrame:
    """Every document's fingerprint beside that of an edited text and of its neighbour's text.

    The neighbour is the next document in descending id (of the last: the first). The edited text has
    its last floor(n / 2) code points replaced by the neighbour's first as many, or all it has.

    Neighbours are found in ranges of ids, cut at quantiles, so no task sees all documents; an id (or null) that fills
    several ranges is cut by the hash of the texts. Each range also gets the first document of the next range. Everything is
    computed where that one exchange puts the rows.
    """
    spark = docs.sparkSession
    df = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL)).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), F.col(id_col).isNull().alias("_null"))
    df = df.withColumn("_h", F.xxhash64("_t"))
    ranges = per_partition * partitions(spark)
    found = [int(c) for c in df.approxQuantile("_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)]
    parts = {c: found.count(c) for c in found}  # how many ranges' rows an id has
    cuts = sorted({*found, *(c + 1 for c, n in parts.items() if n > 1 and c + 1 < -NULL)})
    # ranges in descending order: from the last cut down; the one of an id with several ranges' rows is cut in as many by the hash
    many = [parts.get(c, 1) for c in reversed(cuts)] + [1]
    before = [sum(many[:i]) for i in range(len(many))]
    place = (len(cuts) - _at_most(cuts, F.col("_id"))).cast("int")
    share = F.floor(F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(NULL)), 32) * F.get(_numbers(many), place) / F.lit(LANE + 1))
    df = df.withColumn("_r", (F.get(_numbers(before), place) + share).cast("int"))
    # a range's first document: largest id, then smallest hash and text; one number for each range comes to the driver
    heads = {row["_r"]: row["_top"] for row in df.groupBy("_r").agg(F.max("_id").alias("_top")).collect()}
    pairs = df.withColumn("_ghost", F.lit(False))
    if heads:
        order = sorted(heads)
        previous = {r: order[i - 1] for i, r in enumerate(order)}  # what comes before the first range is the last
        tops = F.get(_numbers([heads.get(r, 0) for r in range(order[-1] + 1)]), F.col("_r"))
        back = F.get(_numbers([previous.get(r, 0) for r in range(order[-1] + 1)]), F.col("_r")).cast("int")
        first = df.where(F.col("_id") == tops).groupBy("_r", "_id", "_null").agg(F.min(F.struct("_h", "_t")).alias("_x"))
        ghosts = first.select("_id", F.col("_x._t").alias("_t"), "_null", F.col("_x._h").alias("_h"), back.alias("_r"), F.lit(True).alias("_ghost"))
        pairs = pairs.unionByName(ghosts)
    w = Window.partitionBy("_r").orderBy("_ghost", F.col("_id").desc(), "_null", "_h", "_t")
    pairs = pairs.select("*", F.row_number().over(w).alias("_k"), F.lead("_t").over(w).alias("_next"))
    rows = pairs.withColumn("_id", F.when(~F.col("_null"), F.col("_id")))
    half = F.floor(F.length("_t") / 2).cast("int")
    edited = F.concat(F.substring(F.col("_t"), F.lit(1), F.length("_t") - half), F.substring(F.col("_next"), F.lit(1), half))
    both = rows.select("_r", "_k", "_id", "_ghost", F.length("_t").cast("long").alias("n_chars"), F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("_t").alias("t")), F.struct(F.lit(1).alias("v"), F.when(~F.col("_ghost"), edited).alias("t")))).alias("_x"))
    both = both.where("_x.v = 0 or not _ghost").select("_r", "_k", "_id", "_ghost", "n_chars", F.col("_x.v").alias("_v"), F.when(F.col("_x.v") == 1, F.sha2("_x.t", 256)).alias("_sha"), F.col("_x.t").alias("_t"))
    keys = ["_r", "_k", "_v", "_id", "_ghost", "n_chars", "_sha"]
    prints = sums(both, keys, "_t").select(*keys, lanes().alias("vec"))
    prints = prints.select(*keys, as_text(F.col("vec")).alias("fp"), _signed(F.col("vec")).alias("sg"))
    prints = prints.withColumn("nn", _dot(F.col("sg"), F.col("sg")))
    near = Window.partitionBy("_r").orderBy("_k", "_v")
    one = F.struct("fp", "sg", "nn", "_sha")
    # the order within a range is text, edited, next text, ...: the row after a text is its edited text, the one after that its neighbour
    seen = prints.select("_r", "_k", "_v", "_id", "_ghost", "n_chars", one.alias("a"), F.lead(one, 1).over(near).alias("b"), F.lead(one, 2).over(near).alias("c"))
    seen = seen.where("_v = 0 and not _ghost")
    like = lambda x, y: _likeness(F.col(x), F.col(y), F.col(f"{x}.fp") == F.col(f"{y}.fp"), F.col(f"{x}.sg"), F.col(f"{y}.sg"), F.col(f"{x}.nn"), F.col(f"{y}.nn"))
    return seen.select(F.col("_id").alias(id_col), "n_chars", F.col("b._sha").alias("edited_sha256"), F.col("a.fp").alias("fingerprint"), F.col("b.fp").alias("edited_fingerprint"), like("a", "b").alias("near_edited"), like("a", "c").alias("near_next"))
