"""Which texts contain which names, for lists of names that grow as the texts do.

A text that contains a name contains every run of characters that the name has. Each name is filed under the rarest of its
runs of ten (or of the greatest of ``SIZES`` that it has), rarest among the texts; a text is posted under those of its runs
that some name is filed under. The two meet by equality on the run, and what meets is verified against the text itself.
Neither side is broadcast: only bitmaps of fixed size are, of runs that are needed at all, and a list of the runs (fewer than
``HOT``) of which more than one in ``HOT`` of all postings are; those are split over parts, and their names copied to each.

A run is one long: up to three code points exactly, longer runs hashed, which may only bring more together to be verified.
Names of up to six characters are so filed under themselves. Texts are posted under runs of the sizes that names have.
Texts are shuffled and written once, each row of an id and text once, so that they are read by many tasks however few files
they came in; they are shuffled once more, however many names they may contain, and names stream past them, so no row grows
with the names of a text.

Where only the newest texts of each name are asked for, texts are written by slices of their ids, each some ``GROWTH`` times
all newer ones, and gone through from the newest on. A name that has all its texts takes no part in older slices: what
meets follows the names, not names times texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmaps import admits, bitmap
from .components import saved
from .windows import first_per

HOT = 1000
#: Rows of a batch that are worked on at once: what a text posts is many times the text.
PIECE = 256
#: Code points that are looked at together, besides one text of any length: few enough to stay in a core's cache.
POINTS = 1 << 16
#: Sizes of runs: a name's is the greatest that it has.
SIZES = (1, 2, 3, 4, 5, 6, 8, 10)
#: Ids in the newest slice for each text that a name may have, and how many times all newer ones a slice goes on to.
FIRST, GROWTH = 100, 2
#: Ids that bounds of slices are picked from, about.
PICKED = 1 << 14


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, PIECE):
        yield batch.slice(start, PIECE)


def _runs(points: np.ndarray, size: int) -> np.ndarray:
    """The run of ``size`` (of ``SIZES``) code points at each place that has one, as longs."""
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if size <= 3:
        out = points[:n]
        for k in range(1, size):
            out = out | (points[k : k + n] << (21 * k))
        return out
    half = _runs(points, (size + 1) // 2).view(np.uint64)
    out = half[:n] * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    out += half[size // 2 :] * np.uint64(0xC2B2AE3D27D4EB4F)
    return out.view(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1


def grams(text: str, size: int) -> np.ndarray:
    """The distinct runs of ``size`` (of ``SIZES``) code points of a text, each as one long."""
    return np.unique(_runs(_points(text), size))


def _wanted_grams(texts: list[str], sizes: list[int], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """place, gram: the distinct wanted runs of each text, by its place in the list, in order of both. Texts are looked at together."""
    places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.flatnonzero(np.diff(np.cumsum(lengths) // POINTS, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(texts)], strict=False):  # no text, no start
        points = _points("".join(texts[start:end]))
        owner = np.repeat(np.arange(start, end), lengths[start:end])
        at, own = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in sizes:
            out = _runs(points, size)
            if not len(out):
                continue
            keep = owner[: len(out)] == owner[size - 1 :]  # not across two texts
            keep &= admits(wanted, out)
            at.append(owner[: len(out)][keep])
            own.append(out[keep])
        grams, rank = np.unique(np.concatenate(own), return_inverse=True)
        if len(grams):  # place and rank in one long: sorted far faster than both in turn
            code = np.sort(np.concatenate(at) * len(grams) + rank)
            place, rank = np.divmod(code[np.diff(code, prepend=-1) != 0], len(grams))
            places.append(place)
            found.append(grams[rank])
    return np.concatenate(places), np.concatenate(found)


def _name_grams(names: DataFrame) -> DataFrame:
    """name, gram: all runs of each name that are of its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], []
            for name in batch.column(0).to_pylist():
                own = grams(name, max(s for s in SIZES if s <= len(name)))
                names += [name] * len(own)
                found.append(own)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(found))], ["name", "gram"])

    return names.mapInArrow(run, "name string, gram long")


def _postings(texts: DataFrame, wanted: np.ndarray, sizes: list[int], counted: bool) -> DataFrame:
    """key, gram of the wanted grams of each text; or, counted, gram and n, the number of texts within a batch that have it."""
    words = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = []
            for piece in _pieces(batch):
                at, flat = _wanted_grams(piece.column(1).to_pylist(), sizes, words.value)
                if counted:
                    totals.append(np.unique(flat, return_counts=True))
                else:
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(at)), pa.array(flat)], ["key", "gram"])
            if totals:
                gram, place = np.unique(np.concatenate([g for g, _ in totals]), return_inverse=True)
                n = np.zeros(len(gram), np.int64)
                np.add.at(n, place, np.concatenate([c for _, c in totals]))
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])

    return texts.select("key", "text").mapInArrow(run, "gram long, n long" if counted else "key long, gram long")


def rarest_grams(names: DataFrame, texts: DataFrame) -> tuple[DataFrame, list[int]]:
    """name, gram, n: each name under its rarest gram, which n texts have; names with a gram that no text has contain in none and are left out."""
    own = _name_grams(names)
    size = F.greatest(*[F.when(F.length("name") >= s, s).otherwise(0) for s in SIZES])
    sizes = sorted({r[0] for r in names.select(size).distinct().collect()})  # at most those of SIZES
    counts = _postings(
        texts, bitmap(own.select("gram").distinct(), F.col("gram")), sizes or [3], True
    ).groupBy("gram").agg(F.sum("n").alias("n"))
    found = own.join(counts, "gram", "left").groupBy("name").agg(
        F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.min("n").alias("n"), F.count_if(F.col("n").isNull()).alias("absent")
    )
    return found.filter("absent = 0").select("name", "gram", "n"), sizes or [3]


def _met(filed: DataFrame, posted: DataFrame) -> DataFrame:
    """key, name of texts and names under one gram; hot grams in parts."""
    # a gram's postings are its texts, as often as it is filed once: counted already
    sizes = filed.select("gram", "n").distinct()
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = sizes.filter(F.col("n") * HOT > total).select("gram", F.ceil(F.col("n") * HOT / max(total, 1)).cast("int").alias("parts"))
    hot = F.broadcast(hot)  # fewer than HOT rows
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("key"), "parts")).cast("int")
    left = posted.join(hot, "gram", "left").select("key", "gram", part.alias("part"))
    every = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = filed.join(hot, "gram", "left").select("name", "gram", every.alias("part"))
    return left.join(right, ["gram", "part"]).select("key", "name")


def _verified(met: DataFrame, texts: DataFrame) -> DataFrame:
    """name, id where the text of the key (one row a key) does contain the name. Each text comes first, then its names stream past."""
    kind = texts.schema["id"].dataType
    rows = texts.select("key", "id", "text", F.lit(None).cast("string").alias("name"))
    rows = rows.unionByName(met.select("key", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("text"), "name"))
    rows = rows.repartition("key").sortWithinPartitions("key", F.col("name").asc_nulls_first()).select("key", "id", "text", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ident, text = None, None, ""
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            names, ids = [], []
            for key, i, own, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name is None:
                    held, ident, text = key, i, own
                elif key == held and name in text:
                    names.append(name)
                    ids.append(ident)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, batch.schema.field(1).type)], ["name", "id"])

    return rows.mapInArrow(run, f"name string, id {kind.simpleString()}")


def _bounds(ids: DataFrame, first: int) -> list:
    """Ids, descending, that part the ids of a DataFrame in slices: about ``first``, then ``GROWTH`` times those before. None where they have no order.

    They are picked among some ``PICKED`` ids by their hash, so slices may come out larger or smaller; any bounds give the same results.
    """
    if not isinstance(ids.schema["id"].dataType, T.AtomicType):
        return []
    ids = ids.filter("id is not null").distinct()
    total = ids.count()
    if total <= first * GROWTH:
        return []
    apart = -(-total // PICKED)
    some = [r[0] for r in ids.filter(F.pmod(F.xxhash64("id"), F.lit(apart)) == 0).orderBy(F.desc("id")).collect()]
    places = []
    while first * GROWTH <= total:
        places.append(-(-first // apart) - 1)
        first *= GROWTH
    return [some[p] for p in sorted({p for p in places if p < len(some)})]


def _prepared(names: DataFrame, texts: DataFrame, columns: tuple[str, str, str], first: int | None) -> tuple[DataFrame, DataFrame, list[int], int]:
    """Names under their rarest runs; texts (key, id, text, slice) as written; sizes of runs; the number of slices, one where ``first`` is None."""
    name, ident, text = columns
    wanted = names.select(F.lower(name).alias("name")).filter("name != ''").distinct()
    wanted = saved(wanted, "wanted-names")
    bounds = _bounds(texts.select(F.col(ident).alias("id")), first) if first else []
    held = texts.filter(F.col(text).isNotNull()).select(F.col(ident).alias("id"), F.lower(text).alias("text"))
    at = F.lit(0)
    for bound in bounds:  # null ids are the oldest
        at = at + F.when(F.col("id") >= F.lit(bound), 0).otherwise(1)
    same = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull().cast("string"), F.sha2("text", 256))
    held = held.select(at.cast("int").alias("slice"), same.alias("same"), "id", "text").dropDuplicates(["slice", "same"])
    held = saved(held.select(F.monotonically_increasing_id().alias("key"), "id", "text", "slice"), "held-texts", ["slice"])
    filed, sizes = rarest_grams(wanted, held)
    return saved(filed, "filed-names"), held, sizes, len(bounds) + 1


def _found(filed: DataFrame, held: DataFrame, sizes: list[int]) -> DataFrame:
    """name, id: each text that contains a filed name, once each."""
    posted = _postings(held, bitmap(filed.select("gram").distinct(), F.col("gram")), sizes, False)
    # the bitmap may admit grams that nothing is filed under; the join leaves them out
    return _verified(_met(filed, posted), held).distinct()


def containing(names: DataFrame, texts: DataFrame, name: str = "name", ident: str = "id", text: str = "text") -> DataFrame:
    """name (as lower-cased), id: each text that contains a name, whatever the case of either; once each.

    Names that are null or empty are contained in nothing, null texts contain nothing. Rows of one id and text are one; an
    id of several texts is found by each of them; null ids are ids.
    """
    filed, held, sizes, _ = _prepared(names, texts, (name, ident, text), None)
    return _found(filed, held, sizes)


def newest_containing(
    names: DataFrame, texts: DataFrame, newest: int = 20, order: list[Column] | None = None, name: str = "name", ident: str = "id", text: str = "text"
) -> DataFrame:
    """``containing``, of each name the ``newest`` texts: those of the greatest ids, unless another order is given."""
    if order:
        return first_per(containing(names, texts, name, ident, text), ["name"], order, newest)
    filed, held, sizes, slices = _prepared(names, texts, (name, ident, text), FIRST * newest)
    latest = [F.desc("id")]
    if slices == 1:
        return first_per(_found(filed, held, sizes), ["name"], latest, newest)
    found = None
    for at in range(slices):
        if found is not None:  # names that have all their texts are done: what is older than those is not asked for
            done = found.groupBy("name").agg(F.count(F.lit(1)).alias("has")).filter(F.col("has") >= newest)
            filed = saved(filed.join(done, "name", "left_anti"), "filed-names")
            if filed.isEmpty():
                break
        new = first_per(_found(filed, held.filter(F.col("slice") == at), sizes), ["name"], latest, newest)
        new = saved(new, "found-names")
        found = new if found is None else found.unionByName(new)
    return first_per(found, ["name"], latest, newest)


def entity_label(key: Column) -> Column:
    """The words that an entity's key stands for: what follows its kind, hyphens as blanks; a key without a kind as it is."""
    words = F.trim(F.translate(F.regexp_replace(key, "^[^:]*:", ""), "-", " "))
    return F.when(key.contains(":"), words).otherwise(key)


def matched_items(entities: DataFrame, items: DataFrame, newest: int = 20) -> DataFrame:
    """entity_key, item_id: of each entity the newest items that hold its label in name, address, description or metadata.

    entities: entity_key; items: item_id, name, url, description, metadata (a map, looked through as JSON text).
    """
    named = entities.select("entity_key", F.lower(entity_label(F.col("entity_key"))).alias("name")).filter("name != ''").distinct()
    text = F.concat_ws("\n", "name", "url", "description", F.to_json("metadata"))
    found = newest_containing(named, items.select("item_id", text.alias("text")), newest, ident="item_id")
    return found.join(named, "name").select("entity_key", F.col("id").alias("item_id"))
