"""Order MinHash fingerprints with DataFrame expressions only.

A text's five-word k-mers get their occurrence number. A hash of k-mer and occurrence deals them to buckets; of each bucket
the two minimal ones are selected, put back in text order, and the hash of that tuple is the bucket's component. A tuple
survives an edit only if both k-mers and their order do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 5
#: Buckets are told by the highest 6 bits of the hash: 64 components at most.
BUCKET_BITS = 6
TUPLE = 2
#: Places in a text take the lowest bits: texts of up to 16 million words, beyond which places wrap in the tie order only.
PLACE_BITS = 24
_EMPTY = "cast(array() as array<bigint>)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _run_starts(items: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Places (from 0) of the items that begin a run."""
    marked = F.transform(items, lambda x, i: F.when((i > 0) & same(x, F.get(items, i - 1)), None).otherwise(i))
    return F.filter(marked, lambda i: i.isNotNull())


def _kmers(words: Column) -> Column:
    """Hash of every run of five words, from the hashes of the words; fewer words are one k-mer."""
    count = F.size(words)

    def many(hashed: Column) -> Column:
        beside = F.arrays_zip(hashed, *[F.slice(hashed, F.lit(k + 1), count) for k in range(1, WIDTH)])
        return F.slice(F.transform(beside, lambda run: F.xxhash64(run)), F.lit(1), count - WIDTH + 1)

    found = let(F.transform(words, lambda w: F.xxhash64(w)), many)
    return F.when(count >= WIDTH, found).when(count > 0, F.array(F.xxhash64(words))).otherwise(F.expr(_EMPTY))


def _packed(hashed: Column, place: Column) -> Column:
    """The upper bits of a hash and, below them, a place in the text, so that plain numbers sort by hash."""
    return hashed.bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(place.cast("long"))


def _ranked(kmers: Column) -> Column:
    """Packed hashes of k-mer and occurrence, smallest first. Only a text that repeats a k-mer needs its k-mers sorted for that."""

    def count(in_order: Column) -> Column:
        def fill(starts: Column) -> Column:
            ends = lambda j: F.coalesce(F.get(starts, j + 1), F.size(in_order))
            return F.flatten(F.transform(starts, lambda b, j: F.sequence(F.lit(0), ends(j) - b - 1)))

        occurrence = let(_run_starts(in_order, lambda x, y: F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0), fill)
        low = F.lit((1 << PLACE_BITS) - 1)
        return F.zip_with(in_order, occurrence, lambda x, o: _packed(F.xxhash64(F.shiftright(x, PLACE_BITS), o), x.bitwiseAND(low)))

    single = F.transform(kmers, lambda h, i: _packed(F.xxhash64(F.shiftright(h, PLACE_BITS), F.lit(0)), i))
    several = let(F.sort_array(F.transform(kmers, _packed)), count)
    return F.sort_array(F.when(F.size(F.array_distinct(kmers)) == F.size(kmers), single).otherwise(several))


def _components(kmers: Column, ranked: Column) -> Column:
    """One number a bucket that holds anything: bucket in the upper half, tuple hash in the lower."""

    def bucket(x: Column) -> Column:
        return F.shiftright(x, 64 - BUCKET_BITS)

    # one of a bucket's smallest if the item TUPLE places before is of another bucket
    smallest = F.filter(ranked, lambda x, i: (i < TUPLE) | (F.shiftrightunsigned(x.bitwiseXOR(F.get(ranked, i - TUPLE)), 64 - BUCKET_BITS) != 0))

    def tuples(chosen: Column) -> Column:
        def one(begin: Column, stop: Column) -> Column:
            places = F.sort_array(F.transform(F.slice(chosen, begin + 1, stop - begin), lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))))
            hashed = F.xxhash64(F.transform(places, lambda p: F.get(kmers, p.cast("int")))).bitwiseAND(F.lit(0xFFFFFFFF))
            room = (bucket(F.get(chosen, begin)) + F.lit(1 << (BUCKET_BITS - 1))).cast("long")
            return F.shiftleft(room, 32).bitwiseOR(hashed)

        return let(
            _run_starts(chosen, lambda x, y: bucket(x) == bucket(y)),
            lambda starts: F.transform(starts, lambda b, j: one(b, F.coalesce(F.get(starts, j + 1), F.size(chosen)))),
        )

    return let(smallest, tuples)


def fingerprint(text: Column) -> Column:
    """Components of a text as an array of numbers in bucket order; a null or empty text has none."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")
    found = let(words, lambda w: let(_kmers(w), lambda k: let(_ranked(k), lambda r: _components(k, r))))
    return F.coalesce(found, F.expr(_EMPTY))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components among the buckets that either has; two empty fingerprints are alike."""
    buckets = lambda x: F.transform(x, lambda c: F.shiftright(c, 32))
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(buckets(a), buckets(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(components: Column) -> Column:
    return F.array_join(F.transform(components, F.hex), ".")


def with_next(docs: DataFrame, key: str, order: list[str], carried: list[str], pieces: int) -> DataFrame:
    """`docs` with next_<c> for each carried column: its value in the following row by (key, order), after the last the first.

    Rows are dealt to ranges of the key whose lowest keys are known; the rows of a range's lowest key are also sent to the range
    before, so each range finds its last successor without a global order.
    """
    quantiles = [k / pieces for k in range(pieces)]
    floors = sorted(set(docs.agg(F.percentile_approx(key, quantiles, 10_000)).first()[0] or [0]))
    lowest = F.array(*[F.lit(x).cast("long") for x in floors])
    steps = F.array(*[F.lit(1 << k) for k in range(len(floors).bit_length() - 1, -1, -1)])
    place = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(lowest, at + step) <= F.col(key), F.lit(False)), at + step).otherwise(at)
    )
    ranged = docs.withColumn("_range", place)
    before = F.when(F.col("_range") == 0, F.lit(len(floors) - 1)).otherwise(F.col("_range") - 1)
    own, guest = F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest")), F.struct(before.alias("r"), F.lit(1).alias("guest"))
    sent = ranged.withColumn("_to", F.explode(F.when(F.get(lowest, F.col("_range")) == F.col(key), F.array(own, guest)).otherwise(F.array(own))))
    line = Window.partitionBy("_to.r").orderBy("_to.guest", key, *order)
    return sent.withColumns({f"next_{c}": F.lead(c).over(line) for c in carried}).filter("_to.guest = 0").drop("_to", "_range")


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each row's text and of its text with the last half replaced by the beginning of the next row's text.

    Rows follow each other by id, then text; null ids come first, and after the last row comes the first. Null texts are empty.
    Repeated rows follow each other like any others. Other columns are left alone. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("fingerprint", fingerprint(F.col("text")))
    pieces = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    chained = with_next(keyed, "_key", ["text"], ["text", "fingerprint"], pieces)
    length = F.char_length("text")
    half = F.floor(length / 2)
    edited = chained.select(
        "doc_id", length.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
        F.concat(F.substring(F.col("text"), F.lit(1), (length - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half.cast("int"))).alias("edited"),
    )
    printed = edited.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return printed.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
