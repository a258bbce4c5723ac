"""Hard-negative mining (operator 13): exact integer scores by a residue-number-system GEMM, then windowed selection.

Every component x becomes the integer floor(256 * x). A score is the integer inner product of a row with an anchor.
Scores are never formed in floating point: the integer matrices are reduced modulo several primes below 256, each pair of
residue matrices is multiplied in float32 (every partial sum stays below 2 ** 24, so the product is exact), and the exact
signed score is rebuilt from its residues by Chinese remaindering (Garner's mixed radix, with signed digits). The number
of primes follows from a bound on all scores taken over the whole table.

The work is a stated query set against all rows, in blocks: anchors (vec_id divisible by 50) fall into blocks of
``ANCHOR_BLOCK`` rows, all rows into blocks of ``ROW_BLOCK`` rows, and every pair of an anchor block and a row block meets
in one task through a cogroup on (anchor block, row block), all long on both sides: a cogroup casts nothing, and an int
and a long of one value hash to different tasks. A task keeps, per anchor, its local leaders; Spark windows
over the union of the local leaders then give the exact global choice. Two passes: the first picks each anchor's
positives, the second, knowing the positives' scores, picks the negatives of each (anchor, positive).

Defined cases:
- rows with a null label, a null vector, or a null or non-finite component take no part;
- where vec_id is divisible by 7 (negative ids too, by remainder) the label first becomes (label + 1) % 10;
- vectors of unequal length: missing components count as 0, an empty vector scores 0 against everything;
- a null vec_id is never an anchor; such rows may be positives or negatives and sort after every id on equal scores;
- "other rows" of an anchor are the rows whose vec_id differs from the anchor's (null differs from every id);
- repeated rows are separate rows: a repeated anchor gives its rows once per copy, a repeated candidate may fill
  several places; ties of score go to the smaller vec_id;
- an anchor without positives, or a positive without qualifying negatives, gives no row;
- an empty table gives an empty result; other columns (whatever their names) are ignored;
- a table whose score bound passes 2 ** 63 raises ValueError (the scores would not fit the long columns).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftline.llm.shared import stored

ANCHOR_EVERY = 50
RELABEL_EVERY = 7
N_LABELS = 10
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # 50 * positive <= 100 * negative <= 95 * positive
ANCHOR_BLOCK = 1024  # anchors a task holds
ROW_BLOCK = 4096  # rows a task holds: a score matrix of 1024 x 4096 longs is 32 MB
LIMIT = 2**63


def primes_below(n: int) -> list[int]:
    """Primes below n, largest first."""
    sieve = np.ones(n, dtype=bool)
    sieve[:2] = False
    for p in range(2, int(n**0.5) + 1):
        if sieve[p]:
            sieve[p * p :: p] = False
    return [int(p) for p in np.nonzero(sieve)[0][::-1]]


PRIMES = primes_below(256)
CHUNK = (2**24 - 1) // (max(PRIMES) - 1) ** 2  # components summed per float32 product without rounding


def moduli_for(bound: int) -> list[int]:
    """The fewest of the largest primes whose product exceeds 2 * bound + 1, so that every signed score in
    [-bound, bound] has one residue vector."""
    chosen, product = [], 1
    for p in PRIMES:
        chosen.append(p)
        product *= p
        if product > 2 * bound + 1:
            return chosen
    raise ValueError(f"score bound {bound} too large")


def rns_scores(anchors: np.ndarray, rows: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Exact integer ``anchors @ rows.T`` (int64 inputs) by residues modulo ``moduli`` in float32 and Garner's CRT."""
    residues = []
    for p in moduli:
        a = np.mod(anchors, p).astype(np.float32)
        r = np.mod(rows, p).astype(np.float32)
        acc = np.zeros((a.shape[0], r.shape[0]), dtype=np.int64)
        for lo in range(0, max(a.shape[1], 1), CHUNK):
            part = a[:, lo : lo + CHUNK] @ r[:, lo : lo + CHUNK].T  # exact: each sum < 2 ** 24
            acc = (acc + part.astype(np.int64)) % p
        residues.append(acc)
    digits = []
    x, radix = np.zeros_like(residues[0]), 1
    for at, (p, res) in enumerate(zip(moduli, residues, strict=True)):
        seen = np.zeros_like(res)  # the number so far modulo p, from its highest digit down
        for digit, q in zip(digits[::-1], moduli[:at][::-1], strict=True):
            seen = (seen * q + digit) % p
        step = (res - seen) % p * pow(radix, -1, p) % p
        digits.append(np.where(step > p // 2, step - p, step))  # signed digits reach from -(product // 2) to product // 2
        weight = radix & (2**64 - 1)
        x = x + digits[-1] * np.int64(weight - 2**64 if weight >= 2**63 else weight)  # modulo 2 ** 64, where scores fit
        radix *= p
    return x


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _leaders(scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, rids: np.ndarray, chosen: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of ``chosen`` by score descending, then id ascending (nulls last), then rid."""
    order = np.lexsort((rids[chosen], ids[chosen], missing[chosen], -scores[chosen]))
    return chosen[order[:k]]


def _task(moduli: list[int], second: bool):
    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            width = max(len(v) for v in (*anchors["iv"], *rows["iv"]))
            scores = rns_scores(_matrix(anchors["iv"], width), _matrix(rows["iv"], width), moduli)
            ids, missing = rows["vec_id"].to_numpy(dtype=np.int64), rows["unnamed"].to_numpy(dtype=bool)
            rids = rows["rid"].to_numpy(dtype=np.int64)
            labels = rows["lab"].to_numpy(dtype=np.int64)
            for a in range(len(anchors)):
                anchor = anchors.iloc[a]
                s = scores[a]
                if not second:
                    same = np.nonzero((labels == anchor["lab"]) & (missing | (ids != anchor["vec_id"])))[0]
                    for i in _leaders(s, ids, missing, rids, same, POSITIVES):
                        out.append((anchor["rid"], None if missing[i] else int(ids[i]), int(rids[i]), int(s[i])))
                    continue
                other = labels != anchor["lab"]
                for place, ps in zip(anchor["places"], anchor["pscores"], strict=True):
                    low, high = -(-LOW * int(ps) // 100), HIGH * int(ps) // 100  # in Python integers: no overflow
                    fits = np.nonzero(other & (s >= low) & (s <= high))[0]
                    for i in _leaders(s, ids, missing, rids, fits, NEGATIVES):
                        out.append((anchor["rid"], int(place), None if missing[i] else int(ids[i]), int(rids[i]), int(s[i])))
        names = ["anchor_rid", "place", "cand_id", "cand_rid", "score"] if second else ["anchor_rid", "cand_id", "cand_rid", "score"]
        kinds = {name: "int64" for name in names} | {"cand_id": "Int64"} | ({"place": "int32"} if second else {})
        columns = zip(*out) if out else [()] * len(names)
        return pd.DataFrame({name: pd.array(list(c), dtype=kinds[name]) for name, c in zip(names, columns, strict=True)})

    return run


def _clean(table: DataFrame) -> DataFrame:
    """Valid rows with their working label, integer vector and a row id fixed by writing them once."""
    parts = F.col("embedding")
    valid = (
        F.col("label").isNotNull()
        & parts.isNotNull()
        & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    )
    label = F.col("label").cast("long")
    lab = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (label + 1) % N_LABELS).otherwise(label)
    scaled = F.transform(parts, lambda x: x.cast("double") * SCALE)
    return stored(
        table.filter(valid).select(
            F.col("vec_id").cast("long").alias("vec_id"),
            lab.alias("lab"),
            F.transform(scaled, lambda y: F.floor(y)).alias("iv"),
            # bounds in double, before the cast to long could saturate
            F.aggregate(scaled, F.lit(0.0), lambda acc, y: acc + F.abs(F.floor(y))).alias("l1"),
            F.array_max(F.transform(scaled, lambda y: F.abs(F.floor(y)))).alias("linf"),
        ).withColumn("rid", F.monotonically_increasing_id()),
        "negatives_rows",
    )


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every anchor and each of its
    positives, the first three different-label rows whose score lies within 50 % to 95 % of the positive's."""
    rows = _clean(embeddings)
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max("l1").alias("l1"), F.max("linf").alias("linf"),
        F.count(F.when(F.col("vec_id") % ANCHOR_EVERY == 0, 1)).alias("anchors"),
    ).first()
    n, n_anchors = stats["n"], stats["anchors"]
    spark = embeddings.sparkSession
    schema = (
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
    if not n or not n_anchors:
        return spark.createDataFrame([], schema)
    bound = int(stats["l1"] or 0) * int(stats["linf"] or 0)
    if bound >= LIMIT:
        raise ValueError(f"scores may reach {bound}, past the supported 2 ** 63")
    moduli = moduli_for(bound + bound // 2**32)  # the sums of absolute values are doubles
    row_blocks = math.ceil(n / ROW_BLOCK)
    anchor_blocks = math.ceil(n_anchors / ANCHOR_BLOCK)
    body = rows.select("rid", "vec_id", "lab", "iv")
    anchors = body.filter(F.col("vec_id") % ANCHOR_EVERY == 0)

    def own(blocks: int) -> Column:
        return F.pmod(F.xxhash64("rid"), F.lit(blocks).cast("long"))

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))

    # pandas would turn ids with nulls into doubles
    named = body.withColumns({"unnamed": F.col("vec_id").isNull(), "vec_id": F.coalesce("vec_id", F.lit(0).cast("long"))})
    held = named.select("*", own(row_blocks).alias("rb"), every(anchor_blocks).alias("ab"))

    def meet(side: DataFrame, second: bool, out: str) -> DataFrame:
        spread = side.select("*", own(anchor_blocks).alias("ab"), every(row_blocks).alias("rb"))
        return held.groupBy("ab", "rb").cogroup(spread.groupBy("ab", "rb")).applyInPandas(_task(moduli, second), out)

    ahead = Window.partitionBy("anchor_rid").orderBy(
        F.desc("score"), F.asc_nulls_last("cand_id"), F.asc("cand_rid")
    )
    local = meet(anchors, False, "anchor_rid long, cand_id long, cand_rid long, score long")
    positives = stored(
        local.withColumn("place", F.row_number().over(ahead)).filter(f"place <= {POSITIVES}"), "negatives_positives"
    )
    placed = positives.groupBy("anchor_rid").agg(
        F.array_sort(F.collect_list(F.struct("place", "cand_id", "score"))).alias("pos")
    )
    asked = stored(anchors.join(placed, F.col("rid") == F.col("anchor_rid")).select(
        "rid", "vec_id", "lab", "iv", F.col("pos.place").alias("places"), F.col("pos.score").alias("pscores")
    ), "negatives_anchors")
    found = meet(asked, True, "anchor_rid long, place int, cand_id long, cand_rid long, score long")
    within = Window.partitionBy("anchor_rid", "place").orderBy(F.desc("score"), F.asc_nulls_last("cand_id"), F.asc("cand_rid"))
    negatives = found.withColumn("rank", F.row_number().over(within)).filter(f"rank <= {NEGATIVES}")
    pos = positives.select(
        F.col("anchor_rid").alias("_a"), F.col("place").alias("_p"), F.col("cand_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    ids = anchors.select(F.col("rid").alias("_r"), F.col("vec_id").alias("anchor_id"))
    return (
        negatives.join(pos, (F.col("anchor_rid") == F.col("_a")) & (F.col("place") == F.col("_p")))
        .join(ids, F.col("anchor_rid") == F.col("_r"))
        .select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("cand_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
    )
