"""Homomorphic multiset hash: a text's fingerprint is the sum, lane by lane modulo a power of two, of wide vectors hashed from
its paragraphs (the stretches between line feeds).

A paragraph's vector has three parts, so that sums serve equality and likeness alike:

* `EXACT` lanes modulo 2^32, pseudo-random numbers drawn from the SHA-512 of the paragraph. Two texts agree here if they have
  the same paragraphs with the same multiplicities, in any order.
* the number of its word runs (a run starts at every word and has `RUN` words, fewer at the end of the paragraph; words of more
  than `LONG` bytes are cut into pieces of `PIECE` code points first);
* `PACKED` sums modulo 2^60, each of three counters of 20 bits: how many runs have their hash, which covers the run and how
  often it stood in the paragraph before, in one of `3 PACKED` equal ranges. Less the mean of all counters, the squared
  difference of two fingerprints estimates in how many runs the texts differ.

Vectors add and subtract, so paragraphs are put in or taken out of a fingerprint without the rest of the text, and fingerprints
of parts make those of wholes. Everything is made of DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.llm.common import WORD, whole

RUN, EXACT, PACKED = 3, 16, 40
LONG, PIECE = 48, 8
#: Steps of binary searches in sorted runs.
_HALVES = [1 << k for k in reversed(range(30))]
_EXACT_MASK = (1 << 32) - 1
_FIELD, _FIELDS, _PACKED_MASK = 20, 3, (1 << 60) - 1
#: First hashes of the counters' ranges, but for the first and past the last.
_EDGES = [-(1 << 63) + (i << 64) // (_FIELDS * PACKED) for i in range(1, _FIELDS * PACKED)]
_NOT_WORD = "[\\x20\\x09-\\x0D]+"
#: The modulus of every lane less one: runs, packed counters, exact lanes.
MASKS = [_PACKED_MASK] * (1 + PACKED) + [_EXACT_MASK] * EXACT
_DIGITS = [15] * (1 + PACKED) + [8] * EXACT

assert WORD == "[^" + _NOT_WORD[1:]


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once a row."""
    return F.transform(F.array(value), use)[0]


def _total(items: Column, value, mask: int) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: (acc + value(x)).bitwiseAND(F.lit(mask)))


def _below(ascending: Column, halves: Column, x: Column) -> Column:
    """How many items of a sorted array are less than x."""
    return F.aggregate(halves, F.lit(0), lambda at, s: F.when(F.get(ascending, at + s - 1) < x, at + s).otherwise(at))


def _halves(items: Column) -> Column:
    return F.filter(F.array(*[F.lit(s) for s in _HALVES]), lambda s: s <= F.size(items))


def fingerprint(text: Column) -> Column:
    """array<long> of `1 + PACKED + EXACT` lanes; a null text counts as empty, which is one empty paragraph."""

    def cut(words: Column) -> Column:
        pieces = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))))
        return F.when(F.exists(words, lambda w: F.octet_length(w) > LONG), pieces).otherwise(words)

    def runs(words: Column) -> Column:
        return F.sort_array(F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, RUN)])))

    def told_apart(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.when(F.get(h, i - 1) == x, i - _below(h, _halves(h), x)).otherwise(0)))

    def lanes(paragraphs: Column) -> Column:
        words = F.transform(paragraphs, lambda p: F.filter(F.split(p, _NOT_WORD), lambda w: w != ""))
        hashes = F.sort_array(F.flatten(F.transform(F.transform(F.transform(words, cut), runs), told_apart)))

        def counters(h: Column) -> Column:
            edges = F.array(*[F.lit(e) for e in _EDGES])
            inner = _bound(_halves(h), lambda halves: F.transform(edges, lambda e: _below(h, halves, e)))
            ends = F.concat(F.array(F.lit(0)), inner, F.array(F.size(h)))

            def count(at: Column, i: Column) -> Column:
                return (F.get(at, i + 1) - F.get(at, i)).cast("long")

            def packed(at: Column) -> Column:
                firsts = F.array(*[F.lit(_FIELDS * j) for j in range(PACKED)])
                return F.transform(firsts, lambda i: sum((F.shiftleft(count(at, i + k), _FIELD * k) for k in range(1, _FIELDS)), count(at, i)))

            return F.concat(F.array(F.size(h).cast("long")), _bound(ends, packed))

        def exact(d: Column) -> Column:
            return F.array(*[_total(d, lambda x, i=i: F.xxhash64(x, F.lit(i)).bitwiseAND(F.lit(_EXACT_MASK)), _EXACT_MASK) for i in range(EXACT)])

        digests = F.transform(paragraphs, lambda p: F.sha2(p, 512))
        return F.concat(_bound(hashes, counters), _bound(digests, exact))

    return _bound(F.split(whole(text), "\n", -1), lanes)


def _masks() -> Column:
    return F.array(*[F.lit(m) for m in MASKS])


def add(a: Column, b: Column) -> Column:
    """Fingerprint of all paragraphs of both texts."""
    both = F.zip_with(a, b, lambda x, y: x + y)
    return F.zip_with(both, _masks(), lambda x, m: x.bitwiseAND(m))


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of `a` without the paragraphs of `b`."""
    less = F.zip_with(a, b, lambda x, y: x - y)
    return F.zip_with(less, _masks(), lambda x, m: x.bitwiseAND(m))


def as_hex(lanes: Column) -> Column:
    """The fingerprint as lowercase hex digits of fixed places."""
    digits = F.array(*[F.lit(d) for d in _DIGITS])
    return F.lower(F.array_join(F.zip_with(lanes, digits, lambda x, d: F.lpad(F.hex(x), d, F.lit("0"))), ""))


def _around_mean(lanes: Column) -> Column:
    """The counters less their mean, times their number."""
    field = F.lit((1 << _FIELD) - 1)

    def centred(x: Column) -> Column:
        one = lambda v, k: F.shiftright(v, _FIELD * k).bitwiseAND(field) * (_FIELDS * PACKED) - x[0]
        return F.flatten(F.transform(F.slice(x, 2, PACKED), lambda v: F.array(*[one(v, k) for k in range(_FIELDS)])))

    return _bound(lanes, centred)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of word runs in common, 2 x shared / all (in squared counts where several paragraphs have a run): 1 for
    equal fingerprints, near 0 for texts without a common run. The error is about sqrt(2 / 120) of what differs."""

    def square(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)

    def compare(pair: Column) -> Column:
        apart = square(F.zip_with(pair["x"], pair["y"], lambda x, y: x - y))
        mass = square(pair["x"]) + square(pair["y"])
        return F.when(mass > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / mass))).otherwise(0.0)

    close = _bound(F.struct(_around_mean(a).alias("x"), _around_mean(b).alias("y")), compare)
    return F.when(a == b, F.lit(1.0)).otherwise(close)


def updated(lanes: Column, text: Column, edited: Column, keep: Column) -> Column:
    """The fingerprint of `edited` from that of `text`, where both begin with the same `keep` code points, which end with a line
    feed or are none: the paragraphs after them are taken out and the new ones put in."""
    rest = F.length(text), F.length(edited)
    old, new = text.substr(keep + 1, rest[0]), edited.substr(keep + 1, rest[1])
    return add(subtract(lanes, fingerprint(old)), fingerprint(new))


def combine(rows: DataFrame, lanes: str, by: Sequence[str] = ()) -> DataFrame:
    """Fingerprints of groups (or of the whole table) as sums over rows, added up before the shuffle. Lanes are split into
    halves of 30 bits, so that sums of up to 2^33 rows stay exact. No rows: no groups, or one row of nulls without `by`."""
    half = F.lit((1 << 30) - 1)
    sums = []
    for i in range(len(MASKS)):
        x = F.col(lanes)[i]
        sums += [F.sum(x.bitwiseAND(half)).alias(f"_l{i}"), F.sum(F.shiftright(x, 30)).alias(f"_h{i}")]
    parts = [(F.shiftleft(F.col(f"_h{i}").bitwiseAND(half), 30) + F.col(f"_l{i}")).bitwiseAND(F.lit(m)) for i, m in enumerate(MASKS)]
    return rows.groupBy(*by).agg(*sums).select(*by, F.array(*parts).alias(lanes))


def _bucket_of(key: Column, cuts: Sequence[int]) -> Column:
    """How many of the ascending `cuts` are at most `key`, by binary search; 0 for null."""
    bits = max(1, len(cuts).bit_length())
    padded = list(cuts) + [(1 << 63) - 1] * ((1 << bits) - 1 - len(cuts))
    table = F.from_json(F.lit("[" + ",".join(map(str, padded)) + "]"), "array<bigint>")
    steps = F.array(*[F.lit(1 << (bits - 1 - k)) for k in range(bits)])
    return F.least(F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= key, at + s).otherwise(at)), F.lit(len(cuts)))


def with_next(
    rows: DataFrame, key: str, ties: str, carry: Mapping[str, Column], rows_per_bucket: int = 256, max_buckets: int = 1 << 14
) -> DataFrame:
    """Rows with the columns of `carry` (expressions over `rows`) and `next_` columns that hold those of the following row in
    descending order of the whole-number column `key`, null keys last; the first row follows the last. Equal keys go by the
    hash of `ties`.

    The rows are dealt into ranges of keys cut at approximate quantiles (at most `max_buckets` numbers reach the driver; a
    bucket has more than `rows_per_bucket` rows where that does not suffice, and its sort spills), and the first row of each
    range is also sent to the range before it, so the rows themselves are shuffled once.
    """
    light = rows.select(F.col(key).cast("long").alias("k"))
    wanted = min(max_buckets, light.count() // rows_per_bucket) + 1
    cuts: list[int] = []
    if wanted > 1:
        at = F.array(*[F.lit(i / wanted) for i in range(1, wanted)])
        cuts = sorted(set(light.agg(F.percentile_approx("k", at, F.lit(20 * wanted)).alias("q")).first().q or ()))
    k = F.col("_k")
    keyed = rows.withColumn("_k", F.col(key).cast("long")).withColumn("_b", _bucket_of(k, cuts)).withColumn("_h", F.xxhash64(ties))
    # Descending order as ascending numbers. One light row per bucket reaches the driver.
    rank = F.struct(k.isNull(), F.bitwise_not(k), F.col("_h"))
    firsts = {r["_b"]: r["first"] for r in keyed.groupBy("_b").agg(F.min(rank).alias("first")).collect()}
    order = sorted(firsts, reverse=True)
    edges = rows.sparkSession.createDataFrame([(order[i - 1], firsts[b][1], firsts[b][2]) for i, b in enumerate(order)], "_to int, _ek long, _eh long")
    heads = keyed.join(F.broadcast(edges), k.eqNullSafe(F.bitwise_not("_ek")) & (F.col("_h") == F.col("_eh")))  # one row per bucket
    heads = heads.dropDuplicates(["_to"]).withColumn("_b", F.col("_to")).drop("_to", "_ek", "_eh").withColumn("_guest", F.lit(1))
    both = keyed.withColumn("_guest", F.lit(0)).unionByName(heads).withColumns(dict(carry))
    down = Window.partitionBy("_b").orderBy("_guest", k.desc_nulls_last(), "_h")
    led = both.select("*", *[F.lead(c).over(down).alias(f"next_{c}") for c in carry])
    return led.where("_guest = 0").drop("_b", "_k", "_h", "_guest")


def next_edit_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited (the text whose last third is replaced by the start of the next document's, in
    descending order of ids), lanes and edited_lanes, near_edited and near_next.

    A null text counts as empty. Rows with a null id come last, and repeated rows follow each other; an empty table gives no
    rows. Other columns of `docs` are not read. The edited text's fingerprint is made from that of the text by taking out the
    paragraphs from the cut on and putting the new ones in.
    """
    t = whole(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("text"))
    met = with_next(rows, "doc_id", "text", {"text": F.col("text"), "lanes": fingerprint(F.col("text"))})
    n = F.length("text")
    gone = F.floor(n / 3).cast("int")
    met = met.withColumn("_head", F.col("text").substr(F.lit(1), n - gone))
    met = met.withColumn("edited", F.concat("_head", F.col("next_text").substr(F.lit(1), gone)))
    # Everything up to the last line feed before the cut stays.
    keep = F.length("_head") - F.length(F.substring_index("_head", "\n", -1))
    met = met.withColumn("edited_lanes", updated(F.col("lanes"), F.col("text"), F.col("edited"), keep))
    near = [likeness(F.col("lanes"), F.col(c)).alias(a) for c, a in (("edited_lanes", "near_edited"), ("next_lanes", "near_next"))]
    return met.select("doc_id", n.cast("long").alias("n_chars"), "edited", "lanes", "edited_lanes", *near)
