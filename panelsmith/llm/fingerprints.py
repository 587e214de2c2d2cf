"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits, in built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.llm.common import WORD, written

BINS = 256
BITS = 8
WORDS = 5
_PROBES = 8
RANGE_BYTES = 32 << 20  # texts of a range that is sorted at once
RANGES_A_TASK = 8  # so tasks are about even
MOST_RANGES = 1 << 18  # larger tables have larger ranges


def minhash(df: DataFrame, text: str, out: str, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Add ``out``: the fingerprint of ``text``, an array of ``bins`` numbers of ``bits`` bits.

    A shingle's hash gives its bin (top bits); each bin keeps its least hash, of which the low
    bits are stored. An empty bin takes the value of the first filled bin in a random order of its
    own, the same for all texts (optimal densification): the first probes are tried one by one,
    and if all miss, the filled bin of the least hash under that order is taken. Fewer words than
    a shingle are one shingle; a text without words (or null) has a fingerprint of zeros. Equal
    texts, and texts that differ in case or white space only, have equal fingerprints.
    """
    width = (bins - 1).bit_length()
    if bins != 1 << width or bits not in (4, 8):
        raise ValueError("bins must be a power of two, bits 4 or 8")
    top, half = 64 - width, bins // 2
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    step = df.withColumn("_w", F.transform(tokens, lambda w: F.xxhash64(w)))
    # lambdas read columns of earlier projections, so that nothing is computed once per element
    many = F.transform(F.sequence(F.lit(0), F.size("_w") - words), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(words)]))
    hashes = F.when(F.size("_w") >= words, many).when(F.size("_w") > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<bigint>"))
    # one mark a bin, larger than its hashes: sorted, each bin begins with its least hash, or its mark
    last = (1 << top) - 1
    marks = F.array(*[F.lit(((b - half) << top) | last) for b in range(bins)])
    step = step.withColumn("_s", F.sort_array(F.concat(hashes, marks)))
    first = F.filter("_s", lambda x, i: (i == 0) | (F.shiftright(x, top) != F.shiftright(F.get(F.col("_s"), i - 1), top)))
    step = step.withColumn("_m", F.transform(first, lambda x: F.nullif(x.bitwiseAND(F.lit(last)), F.lit(last))))
    step = step.withColumn("_b", F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.get(F.col("_m"), b).isNotNull()))

    def filled(x: Column, b: Column) -> Column:
        probes = [F.get(F.col("_m"), F.pmod(F.xxhash64(b, F.lit(k)), F.lit(bins)).cast("int")) for k in range(_PROBES)]
        least = F.array_min(F.transform("_b", lambda c: F.struct(F.xxhash64(b, c, F.lit("order")).alias("h"), c.alias("c"))))["c"]
        return F.coalesce(x, *probes, F.get(F.col("_m"), least), F.lit(0)).bitwiseAND(F.lit((1 << bits) - 1)).cast("smallint")

    return step.withColumn(out, F.transform("_m", filled)).drop("_w", "_s", "_m", "_b")


def packed(fingerprint: str, bits: int = BITS) -> Column:
    """The numbers of a fingerprint as lowercase hex digits, end to end."""
    digits = F.array(*[F.lit(f"{v:0{bits // 4}x}") for v in range(1 << bits)])
    return F.array_join(F.transform(fingerprint, lambda v: F.get(digits, v.cast("int"))), "")


def likeness(a: str, b: str, bits: int = BITS) -> Column:
    """The estimated share of common shingles of two fingerprints, 0 to 1: equal parts, less those equal by chance."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)
    chance = 2.0**-bits
    return F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))


def range_edges(rows: DataFrame, parts: int) -> DataFrame:
    """``n, edge``: the first ``pos`` of each of at most ``parts`` ranges of about as many rows, numbered from 0 in order."""
    names = ["nul", "at", "h"]
    dealt = rows.select("pos.*").repartitionByRange(parts, *names)
    first = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*names)).alias("edge"))
    first = written(first.select("edge").distinct(), "range-edges")  # bounds come from a sample: they are drawn once
    return first.select((F.row_number().over(Window.orderBy("edge")) - 1).alias("n"), "edge")  # at most MOST_RANGES rows


def with_next(df: DataFrame, key: str, text: str, carried: list[str], parts: int) -> DataFrame:
    """Add ``next_*`` of the ``carried`` columns: those of the next row by descending key, after the last the first.

    Rows are ordered by descending key (null keys last), rows of equal key by a hash of their ``text``,
    and dealt by ranges of that order, several for each of ``parts`` tasks; so rows that share a key are dealt
    over ranges too, unless they also share the text. A range's first rows also go, as guests, to
    the range before it, whose last row needs them; those of the first range go to the last. So each
    range is sorted on its own, and no row waits for a whole table. A row finds its range in two
    steps, among the first edges of groups of ranges and among those of its group, so it compares
    with about twice the root of their number.
    """
    at = F.coalesce(F.bitwise_not(F.col(key).cast("long")), F.lit(0).cast("long"))
    pos = F.struct(F.col(key).isNull().alias("nul"), at.alias("at"), F.xxhash64(text).alias("h"))
    edges = written(range_edges(df.select(pos.alias("pos")), min(MOST_RANGES, RANGES_A_TASK * parts)), "ranges")
    count = edges.count()
    width = max(1, math.isqrt(max(count - 1, 0)) + 1)  # ranges of a group
    coarse = edges.where(F.col("n") % width == 0).orderBy("n").collect()  # at most the root of MOST_RANGES
    kind = edges.schema["edge"].dataType.simpleString()
    heads = F.array(*[F.struct(F.lit(r.edge.nul).alias("nul"), F.lit(r.edge.at).cast("long").alias("at"), F.lit(r.edge.h).cast("long").alias("h")) for r in coarse])
    fine = edges.groupBy(F.floor(F.col("n") / width).cast("int").alias("_group")).agg(F.sort_array(F.collect_list("edge")).alias("_edges"))
    home = F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("_range") - 1, F.lit(max(count, 1))).alias("range"), F.lit(True).alias("guest"))
    found = (
        df.withColumn("_pos", pos)
        .withColumn("_group", F.size(F.filter(heads.cast(f"array<{kind}>"), lambda e: e <= F.col("_pos"))) - 1)
        .join(F.broadcast(fine), "_group")
        .withColumn("_place", F.size(F.filter("_edges", lambda e: e <= F.col("_pos"))) - 1)
        .withColumn("_range", F.col("_group") * width + F.col("_place"))
        .withColumn("_home", F.explode(F.when(F.get("_edges", F.col("_place")) == F.col("_pos"), F.array(home, before)).otherwise(F.array(home))))
    )
    dealt = found.select(*df.columns, "_pos", "_home").repartition(parts, "_home.range")
    inside = Window.partitionBy("_home.range").orderBy("_home.guest", "_pos")
    nexts = [F.lead(c).over(inside).alias(f"next_{c}") for c in carried]
    return dealt.select(*df.columns, "_home", *nexts).where("not _home.guest").drop("_home")


def fingerprint_documents(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every document's text and of its edited text, and how like they are.

    The edited text has its last third (code points, rounded down) replaced by the first as many of
    the next document by descending doc_id (all of it if shorter). Null texts are empty. Rows of
    equal doc_id follow each other in the order of hashes of their texts, null doc_ids come last;
    repeated rows are rows of their own. A lone document follows itself, whatever its doc_id. An empty table gives no rows; other
    columns are not read.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    printed = minhash(base, "text", "fingerprint", words, bins, bits)
    paired = with_next(printed, "doc_id", "text", ["text", "fingerprint"], parts)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    paired = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), "fingerprint", F.col("next_fingerprint"))
    both = minhash(paired, "_edited", "edited_fingerprint", words, bins, bits)
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        packed("fingerprint", bits).alias("fingerprint"),
        packed("edited_fingerprint", bits).alias("edited_fingerprint"),
        likeness("fingerprint", "edited_fingerprint", bits).alias("near_edited"),
        likeness("fingerprint", "next_fingerprint", bits).alias("near_next"),
    )
