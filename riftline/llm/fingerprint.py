"""Document fingerprints (operator 1) in DataFrame functions only: one-permutation MinHash, densified, b bits a bin.

A shingle (five words; the whole sequence of a shorter text) is hashed once. The top eight bits of its hash name one of
256 bins, each bin keeps its smallest hash, and an empty bin copies the first filled bin on its own pseudorandom probe
sequence, which visits every bin. Of each bin's hash, mixed with the bin's number, the low four bits are stored, 16 bins to
a long. (Without the number, all copies of one hash would agree with another hash, or not, together.) Two bins agree by
chance in one of 16 cases; the likeness takes that out.

Defined cases: a null text counts as empty, and all empty texts share one fingerprint (that of an empty sequence); long
texts are hashed whole; equal texts have equal fingerprints; an empty table gives an empty result; other columns are
ignored. For the edit: documents go by descending doc_id, a null doc_id last; equal doc_ids by a hash of the text, then
the text; after the last comes the first, which for a single document is itself.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftline.llm.native import let, words

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 4
PER_LONG = 64 // LOW_BITS
_NIBBLES = 0x1111111111111111


def _probe(bin_: int) -> tuple[int, int]:
    """Start and odd step of the bin's probe sequence."""
    draw = xxhash.xxh64_intdigest(bin_.to_bytes(4, "little"), seed=1)
    return draw % BINS, (draw >> 32) % BINS | 1


_STARTS = [_probe(b)[0] for b in range(BINS)]
_STEPS = [_probe(b)[1] for b in range(BINS)]


def _shingles(text: Column) -> Column:
    """A hash per shingle."""

    def of(h: Column) -> Column:
        whole = F.array(F.xxhash64(h))
        each = F.transform(
            F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + step) for step in range(SHINGLE)])
        )
        return F.when(F.size(h) < SHINGLE, whole).otherwise(each)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def _bin(h: Column) -> Column:
    return F.shiftright(h, 64 - BIN_BITS)


def _bins(hashes: Column) -> Column:
    """The smallest hash of each bin, null where a bin is empty. In ascending order a bin's hashes are neighbours."""

    def first_of_each(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1))))

    def dense(low: Column) -> Column:
        return let(F.transform(low, lambda h: _bin(h)), lambda at: F.transform(
            F.sequence(F.lit(-BINS // 2).cast("long"), F.lit(BINS // 2 - 1).cast("long")),
            lambda b: F.get(low, F.array_position(at, b).cast("int") - 1),
        ))

    return let(F.sort_array(hashes), lambda s: let(first_of_each(s), dense))


def _densified(bins: Column) -> Column:
    """Round t gives each bin that is still empty the bin at its t-th probe, if that one was filled at first."""
    starts, steps = F.array(*map(F.lit, _STARTS)), F.array(*map(F.lit, _STEPS))

    def fill(first: Column) -> Column:
        def round_(s: Column, t: Column) -> Column:
            probed = F.transform(s["bins"], lambda h, b: F.when(h.isNotNull(), h).otherwise(
                F.get(first, F.pmod(F.get(starts, b) + t * F.get(steps, b), F.lit(BINS)))
            ))
            return F.when(s["full"], s).otherwise(let(probed, lambda p: F.struct(
                p.alias("bins"), (~F.exists(p, lambda h: h.isNull())).alias("full")
            )))

        start = F.struct(first.alias("bins"), (~F.exists(first, lambda h: h.isNull())).alias("full"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), start, round_, lambda s: s["bins"])

    return let(bins, fill)


def packed(text: Column) -> Column:
    """The fingerprint as longs of 16 bins each."""

    def pack(bins: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), lambda g: F.aggregate(
            F.slice(bins, g * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"),
            lambda held, h: F.shiftleft(held, LOW_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("long"))),
        ))

    def bits(bins: Column) -> Column:
        return F.transform(bins, lambda h, b: F.xxhash64(h, b))

    return let(bits(_densified(_bins(_shingles(text)))), pack)


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1: the share of equal bins, freed of chance."""
    low = F.lit(_NIBBLES)

    def unequal(x: Column, y: Column) -> Column:
        return let(x.bitwiseXOR(y), lambda z: F.bit_count(
            z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2))
            .bitwiseOR(F.shiftrightunsigned(z, 3)).bitwiseAND(low)
        ))

    missed = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda held, n: held + n)
    chance = 1 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), ((1 - missed / BINS) - chance) / (1 - chance))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""
    return docs.select("doc_id", as_text(packed(F.col("text"))).alias("fingerprint"))


_FAN = 256


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds (descending) are at or above the key, less one, looked up in two levels."""
    groups = [bounds[i:i + _FAN] for i in range(0, len(bounds), _FAN)]
    tops = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    lists = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    return let(F.size(F.filter(tops, lambda b: b >= key)) - 1, lambda top: top * _FAN + F.size(
        F.filter(F.get(lists, top), lambda b: b >= key)
    ) - 1)


def with_next(docs: DataFrame, values: list[str], *, rows_per_range: int = 1000, most_ranges: int = 1 << 14) -> DataFrame:
    """Each row with the values of the next one by descending doc_id (``next_<name>``), the first after the last.

    Ranges begin at doc_ids that exist (approximate quantiles; the driver holds at most ``most_ranges`` of them). The
    rows at such a bound also visit the range before it as guests, so one shuffle by range is enough and no window
    spans the table.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    top, n = docs.select(key.alias("k")).agg(F.max("k"), F.count(F.lit(1))).first()
    if not n:
        bounds = [0]
    else:
        ranges = max(1, min(most_ranges, n // rows_per_range))
        shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else F.array(F.lit(0.5))
        cuts = docs.select(key.alias("k")).agg(F.percentile_approx("k", shares, 10 * ranges)).first()[0]
        bounds = sorted({top, *(cuts if ranges > 1 else [])}, reverse=True)
    own = _range_of(key, bounds)
    placed = docs.withColumn("_range", own).withColumn("_bound", F.array_contains(F.array(*[F.lit(b).cast("long") for b in bounds]), key))
    visits = F.when(F.col("_bound"), F.array(
        F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest")),
        F.struct(F.pmod(F.col("_range") - 1, F.lit(len(bounds))).alias("range"), F.lit(True).alias("guest")),
    )).otherwise(F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))))
    spread = placed.withColumn("_visit", F.explode(visits))
    order = Window.partitionBy("_visit.range").orderBy("_visit.guest", key.desc(), F.xxhash64("text"), "text")
    following = {f"next_{name}": F.lead(name).over(order) for name in values}
    return spread.withColumns(following).filter(~F.col("_visit.guest")).drop("_range", "_bound", "_visit")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last third is the beginning of the next document."""
    text = F.coalesce("text", F.lit(""))
    marked = docs.select("doc_id", text.alias("text")).withColumn("fp", packed(F.col("text")))
    paired = with_next(marked, ["text", "fp"])
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third)
    )
    both = paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    done = both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", packed(F.col("edited")).alias("edited_fp")
    )
    return done.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
