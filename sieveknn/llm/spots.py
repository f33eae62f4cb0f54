"""Document fingerprints by spot signatures.

A spot is a common word (an antecedent); its signature is that word with the chain of the next content
words, common words between them skipped. The start of a text counts as an antecedent too, so
every text with a content word has a signature. Where no common word follows a content word or any of the ``GAP - 1``
before it, that word is an antecedent too, so that lists and names are not known by their start alone. The fingerprint is the set of signatures, written as
the sorted hexadecimal 64-bit hashes; the likeness of two is their Jaccard index.

Sets whose sizes differ by more than the wanted likeness cannot reach it: ``pruned_jaccard`` then skips
the comparison, and ``near_pairs`` only lets sets meet whose size classes can.

* A null text is empty. Two equal texts have likeness 1, also without any signature; else an empty
  set has likeness 0.
* Rows with a null id come after all others, rows of one id in descending order of their texts.
* A single row is its own next document. Further columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveknn.llm.common import stored, whole_text

# Common words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in a is that it for on was be with as this by at are from or an he his not but had have "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine des als auch es an werden aus er hat dass sie nach "
    "le la les de des et que un une du en est pour qui dans par sur pas au plus ne se ce il sont avec "
    "el los las y del por con su para como más pero al lo sus este ya entre cuando"
).split()
CHAIN = 2
GAP = 4  # content words without a common word, after which the next one counts as an antecedent
MAX_BUCKETS = 4096
MAX_BROADCAST_BYTES = 32 << 20
_MARK = "\u0001"


def signatures(text: Column, chain: int = CHAIN, common: list[str] = COMMON_WORDS) -> Column:
    """The distinct signatures of a text as ``array<long>``."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # Content words start a segment, the common words behind one stay in its segment.
    marked = F.transform(words, lambda w: F.when(w.isin(*sorted(set(common))), F.concat(F.lit(_MARK), w)).otherwise(F.concat(F.lit(" "), w)))
    segments = F.split(F.concat(F.lit(_MARK + "^"), F.array_join(marked, "")), " ")

    def from_segments(parts: Column) -> Column:
        content = F.transform(parts, lambda s: F.substring_index(s, _MARK, 1))
        chains = F.slice(content, 2, F.size(content))
        for step in range(2, chain + 1):
            chains = F.zip_with(chains, F.slice(content, step + 1, F.size(content)), lambda a, b: F.when(a.isNotNull(), F.concat_ws(" ", a, b)))
        spots = F.zip_with(
            parts,
            chains,
            lambda s, c: F.when(
                c.isNotNull() & s.contains(_MARK), F.transform(F.slice(F.split(s, _MARK), 2, 1 << 30), lambda word: F.xxhash64(word, c))
            ).otherwise(F.array().cast("array<long>")),
        )
        hashes = F.zip_with(content, chains, lambda word, c: F.when(c.isNotNull(), F.xxhash64(word, c)))

        def without_spots(marked: Column) -> Column:
            bare = F.transform(marked, lambda m, i: ~m & ~F.exists(F.slice(marked, F.greatest(i - GAP + 2, F.lit(1)), GAP), lambda x: x))
            return F.array_compact(F.zip_with(bare, hashes, lambda b, h: F.when(b, h)))

        added = F.transform(F.array(F.transform(parts, lambda s: s.contains(_MARK))), without_spots)[0]
        return F.array_distinct(F.concat(F.flatten(spots), added))

    # A one-element array binds the segments, so that they are made once.
    return F.transform(F.array(segments), from_segments)[0]


def fingerprint(sigs: Column) -> Column:
    """The set as text: sorted hashes of 16 hexadecimal digits."""
    return F.array_join(F.transform(F.array_sort(sigs), lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def pruned_jaccard(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard index of two sets; 0 without comparing where the sizes alone keep it below ``floor``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when((small == 0) | (small < large * F.lit(floor)), F.lit(0.0)).otherwise(shared / (small + large - shared))


def likeness(a: Column, b: Column, same_text: Column, floor: float = 0.0) -> Column:
    return F.when(same_text, F.lit(1.0)).otherwise(pruned_jaccard(a, b, floor))


def size_class(sigs: Column, threshold: float) -> Column:
    """Sets with likeness of at least ``threshold`` are in the same or in neighbouring classes."""
    return F.floor(F.log(F.greatest(F.size(sigs), F.lit(1)).cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, other_id, likeness`` of representatives with likeness of at least ``threshold``.

    Documents with the same set are one (the smallest id stands for them). The others meet, within a size class
    and the next, on a signature among their rarest ones: of ``n`` signatures two sets of that likeness
    share one of the ``n - ceil(threshold * n) + 1`` rarest. Empty sets are near to nothing.
    """
    sets = docs.select("doc_id", signatures(whole_text()).alias("sigs")).where(F.size("sigs") > 0)
    sets = sets.groupBy(F.array_sort("sigs").alias("sigs")).agg(F.min("doc_id").alias("doc_id"))
    sets = stored(sets.where("doc_id is not null").withColumn("part", size_class(F.col("sigs"), threshold)), "spot-sets")
    entries = sets.select("doc_id", F.explode("sigs").alias("sig"))
    counts = stored(entries.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1"), "spot-counts")
    ranked = entries.join(counts, "sig").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("shared"))
    # Signatures of one document only are the rarest; they fill the prefix first and meet nothing.
    prefix = ranked.join(sets, "doc_id").select(
        "doc_id",
        "part",
        F.size("sigs").alias("size"),
        F.explode(
            F.slice(
                "shared",
                1,
                F.greatest(F.lit(0), F.size("sigs") - F.ceil(F.size("sigs") * F.lit(threshold) - 1e-9) + 1 - F.size("sigs") + F.size("shared")).cast("int"),
            )
        ).alias("e"),
    )
    left = prefix.select(F.col("doc_id").alias("a"), F.col("size").alias("na"), F.explode(F.array("part", F.col("part") + 1)).alias("p"), F.col("e.sig").alias("sig"))
    right = prefix.select(F.col("doc_id").alias("b"), F.col("size").alias("nb"), F.col("part").alias("p"), F.col("e.sig").alias("sig"))
    fits = (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold)) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    pairs = left.join(right, ["p", "sig"]).where(fits).select("a", "b").distinct()
    one = sets.select(F.col("doc_id").alias("a"), F.col("sigs").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("sigs").alias("sb"))
    scored = pairs.join(one, "a").join(two, "b").withColumn("likeness", pruned_jaccard(F.col("sa"), F.col("sb"), threshold))
    return scored.where(F.col("likeness") >= threshold).select(F.least("a", "b").alias("doc_id"), F.greatest("a", "b").alias("other_id"), "likeness")


def _bucket(bounds: list[float]) -> Column:
    """How many of the sorted bounds lie below the id, by bisection; -1 for a null id."""
    bits = max(1, len(bounds).bit_length())
    known = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    below = F.aggregate(
        F.sequence(F.lit(1), F.lit(bits)),
        F.lit(0),
        lambda at, step: F.when(
            F.get(known, at + F.pow(F.lit(2), bits - step).cast("int") - 1) < F.col("doc_id").cast("double"), at + F.pow(F.lit(2), bits - step).cast("int")
        ).otherwise(at),
    )
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(below)


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, sigs, next_text, next_sigs``: each document and the one of the next smaller id.

    Documents are dealt once, by ranges of the id; within a range the next one is the window's next row,
    and each range's last row takes the first row of the range below.
    """
    spark = docs.sparkSession
    plain = docs.select("doc_id", whole_text().alias("text"))
    wanted = min(MAX_BUCKETS, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(docs.select("doc_id").approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.5 / wanted)))
    bucket = _bucket(bounds)
    ids = docs.select("doc_id").withColumn("bucket", bucket).groupBy("bucket").agg(F.max("doc_id").alias("top"))
    # At most one text for each range.
    heads = (
        plain.withColumn("bucket", bucket)
        .join(F.broadcast(ids), "bucket")
        .where(F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("bucket")
        .agg(F.max("text").alias("text"))
    )
    heads = stored(heads, "spot-heads")
    down, up = Window.orderBy(F.desc("bucket")), Window.orderBy("bucket")
    follow = heads.select(
        "bucket",
        F.coalesce(F.lead("text").over(down), F.last("text").over(up.rowsBetween(0, Window.unboundedFollowing))).alias("head"),
    )
    follow = stored(follow.withColumn("head_sigs", signatures(F.col("head"))), "spot-follow")
    total = follow.agg(F.sum(F.octet_length("head") + 8 * F.size("head_sigs"))).first()[0] or 0
    if total <= MAX_BROADCAST_BYTES:
        follow = F.broadcast(follow)
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    dealt = plain.withColumn("bucket", bucket).repartition("bucket").withColumn("sigs", signatures(F.col("text")))
    led = dealt.withColumn("lead_text", F.lead("text").over(order)).withColumn("lead_sigs", F.lead("sigs").over(order))
    return led.join(follow, "bucket", "left").select(
        "doc_id",
        "text",
        "sigs",
        F.coalesce("lead_text", "head").alias("next_text"),
        F.coalesce("lead_sigs", "head_sigs").alias("next_sigs"),
    )


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and the next document's.

    The edited text replaces the last third of the code points by as many from the next document's start.
    """
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = with_next(docs).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    )
    edited = edited.withColumn("edited_sigs", signatures(F.col("edited")))
    return edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs"), F.col("text") == F.col("next_text")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
    )
