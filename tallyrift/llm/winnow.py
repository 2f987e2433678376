"""Document fingerprints by winnowing, in built-in functions only.

A text is read as pieces of up to four non-white characters. Every run of GRAM pieces has a
rolling (polynomial) hash, made by doubling: the hash of 2m pieces follows from those of its
halves. Every window of WINDOW neighbouring grams keeps its smallest hash, of equal ones the
rightmost: the place is packed below the hash, later places being smaller, so one minimum
decides both. Two texts that share WINDOW + GRAM - 1 pieces in a row share a fingerprint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrift.llm.common import fresh
from tallyrift.session import materialize

PIECE = r"[^\x20\x09-\x0D]{1,4}"
GRAM, WINDOW = 4, 16  # powers of two
PRIME, BASE = (1 << 31) - 1, 1_000_003
PLACES = (1 << 32) - 1
BUCKET_ROWS, MOST_BUCKETS = 2000, 1 << 16


def _beside(values: Column, step: int, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine`` of every element with the one ``step`` places later."""
    rest = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), rest), F.slice(values, F.lit(step + 1), rest), combine)


def winnow(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` plus ``name``: the selected grams as ``hash * 2^32 + (PLACES - place)``, in the
    order of their places. A text of fewer than GRAM pieces is one gram; without pieces (or
    null) the array is empty. Fewer grams than a window are one window."""
    work, pieces, whole = fresh("grams"), fresh("pieces"), fresh("whole")
    digest = lambda x: F.xxhash64(x).bitwiseAND(F.lit(PRIME)) % PRIME
    rows = rows.withColumn(pieces, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE), F.lit(0)))
    rows = rows.withColumns({work: F.transform(pieces, digest), whole: F.size(pieces)})
    short = F.array(digest(F.array_join(pieces, " ")))
    step = 1
    while step < GRAM:
        power = pow(BASE, step, PRIME)
        rows = rows.withColumn(work, _beside(F.col(work), step, lambda a, b: (a * F.lit(power) + b) % PRIME))
        step *= 2
    grams = F.when(F.col(whole) == 0, F.array().cast("array<bigint>")).when(F.col(whole) < GRAM, short).otherwise(F.col(work))
    rows = rows.withColumn(work, grams)
    rows = rows.withColumn(
        work, F.transform(work, lambda h, i: F.shiftleft(h, 32).bitwiseOR(F.lit(PLACES) - i.cast("bigint")))
    )
    few, lowest = fresh("few"), fresh("lowest")
    rows = rows.withColumns({few: F.size(work) < WINDOW, lowest: F.array_compact(F.array(F.array_min(work)))})
    step = 1
    while step < WINDOW:
        rows = rows.withColumn(work, _beside(F.col(work), step, lambda a, b: F.least(a, b)))
        step *= 2
    selected = F.when(F.col(few), F.col(lowest)).otherwise(F.array_distinct(work))
    return rows.withColumn(name, selected).drop(work, pieces, whole, few, lowest)


def hashes(selected: str) -> Column:
    return F.array_distinct(F.transform(selected, lambda v: F.shiftright(v, 32)))


def written(selected: str) -> Column:
    """The fingerprint as text: ``hash:place`` of every selected gram."""
    one = lambda v: F.concat(F.lower(F.hex(F.shiftright(v, 32))), F.lit(":"), F.lit(PLACES) - v.bitwiseAND(F.lit(PLACES)))
    return F.array_join(F.transform(selected, one), " ")


def likeness(left: Column, right: Column) -> Column:
    """Jaccard similarity of two hash sets; two empty ones are alike."""
    common = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def id_bounds(ids: DataFrame) -> list[int]:
    """Where ranges of about BUCKET_ROWS ids begin, in order; at most about MOST_BUCKETS of them,
    which the driver holds as numbers. Ids alone are sorted by ranges and counted inside them."""
    ranged = ids.where(F.col("_id").isNotNull()).repartitionByRange("_id").withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ids")
    each = max(BUCKET_ROWS, -(-ranged.count() // MOST_BUCKETS))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_id"))
    begins = ranged.withColumn("_place", place - 1).where(F.col("_place") % each == 0)
    return sorted(r[0] for r in begins.select("_id").distinct().collect())  # a few numbers per MOST_BUCKETS


def range_of(number: Column, bounds: list[int]) -> Column:
    """The place of the last bound that is not above ``number``, by bisection; null is -1, below
    all others. The bounds are one constant of the plan."""
    known = F.split(F.lit(",".join(map(str, bounds)) or "0"), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in range(max(len(bounds) - 1, 1).bit_length() - 1, -1, -1)])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step) <= number, at + step).otherwise(at))
    return F.when(number.isNull(), F.lit(-1)).otherwise(place).cast("bigint")


def with_next(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``_at, _ghost`` for a window that meets every document's next one (descending id,
    nulls last, then text; after the last: the first).

    Ids are cut into ranges of equally many documents, however far apart the ids are (see
    ``id_bounds``). The first documents of a range are copied behind the range above it, so a
    window over ranges sees every neighbour and texts are shuffled once. Documents of one id share a
    range."""
    docs = docs.withColumn("_at", range_of(F.col(id_col).cast("bigint"), id_bounds(docs.select(F.col(id_col).cast("bigint").alias("_id")))))
    heads = docs.groupBy("_at").agg(F.max(id_col).alias("_head"))
    above = F.coalesce(F.lead("_at").over(Window.orderBy("_at")), F.lit(None))
    heads = heads.withColumn("_above", above)
    bottom = F.min("_at").over(Window.partitionBy())
    heads = materialize(heads.select("_at", "_head", F.coalesce("_above", bottom).alias("_above")), "heads")
    docs = docs.join(F.broadcast(heads), "_at")  # at most MOST_BUCKETS + 1 rows of three numbers
    own = F.struct(F.col("_at"), F.lit(0).alias("_ghost"))
    copy = F.struct(F.col("_above").alias("_at"), F.lit(1).alias("_ghost"))
    places = F.when(F.col(id_col).eqNullSafe(F.col("_head")), F.array(own, copy)).otherwise(F.array(own))
    return docs.select(id_col, text, F.explode(places).alias("_place")).select(id_col, text, "_place.*")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text whose last third is replaced by the start
    of the next document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. A null text is empty; repeated rows are neighbours of each
    other; a single document is its own next one; no rows give no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("_at").orderBy("_ghost", F.desc_nulls_last("doc_id"), "text")
    rows = with_next(rows, "doc_id", "text").withColumn("_next", F.lead("text").over(order))
    rows = winnow(rows, "text", "_own").withColumn("_hashes", hashes("_own"))
    rows = rows.withColumn("_beside", F.lead("_hashes").over(order)).where("_ghost = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("_next", F.lit(1), third))
    rows = rows.withColumn("_edited", edited).drop("_next")
    rows = winnow(rows, "_edited", "_new").withColumn("_new_hashes", hashes("_new"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        written("_own").alias("fingerprint"),
        written("_new").alias("edited_fingerprint"),
        likeness(F.col("_hashes"), F.col("_new_hashes")).alias("near_edited"),
        likeness(F.col("_hashes"), F.col("_beside")).alias("near_next"),
    )
