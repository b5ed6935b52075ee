"""MinHash near-dedup with DartMinHash signatures, banded joins and an exact check of every link.

A document is a weighted set: its five-word shingles with their counts. Each unit of a
shingle's weight is a region on which darts land as a Poisson process along the rank axis,
with arrival times hashed from shingle and unit, so the same unit gets the same darts in
every document. Only darts up to a rank of about k(ln k + MARGIN) over the weight are thrown: most
units get none and cost one hash and a comparison. A dart also names one of the k
coordinates, and each coordinate keeps its earliest dart; a document that leaves one empty is
thrown again to twice the rank. Two documents agree in a coordinate with the probability of
their weighted Jaccard similarity, the sum of the smaller over that of the larger counts.

Bands of ROWS coordinates make groups. In a group one centre, drawn by a hash of the group,
is compared with every member of another class; the links' components become the classes,
the centre leaves its group, and groups of one class are done. So every pair of a group is
compared or already of one class. Later rounds draw GROWTH times as many centres and more, so groups
end within a few rounds; a round meets its groups in one join, which brings each member its centres. Groups that after REFINE_AFTER rounds still hold more than LARGE
members of different classes (a family of copies with ever more edits, say) are not compared
on: their members go on in groups by prefix filtering, which loses no link. Elements are
ordered by the number of these documents that have them, the commonest last by name; two documents at the threshold share
one of the rarest 20 % (and one) of each, and at the first they share enough elements must be
left in both. Edits are rare elements, so documents far from their family meet nobody.
Comparisons are exact: the two element sets, 40 bits an element, are intersected.

Documents with equal shingle counts are one node from the start, named by a 64-bit hash of those
counts and not by doc_id, so null and repeated ids mix nothing up. Documents of one to four words
have the one shingle of all their words; documents without words are classes of their own.
A node is one row that holds its bands, or later its elements: classes are looked up once a node
and go along when its entries are dealt to groups. Where the table of classes is light it goes to
all tasks instead, and entries stay rows of their own.

Defined cases: null text has no words; a null doc_id sorts after all others, and a class of null
ids alone has a null class_id; repeated rows are in one class and share the verdict
(kept_documents returns one of them); rows of one doc_id with different texts are nodes of their
own, and of those in one class one text is kept; other columns are not read. Two documents at similarity 0.8 share
no band with a probability of 0.0003, and more alike ones less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.components import components, solved
from lexloom.llm.support import LAST, Stage, attach, prepare, row_key, row_tag, with_rows
from lexloom.llm.words import grams, mix, names, slices, spans, strings
from lexloom.session import small

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
MARGIN = 4.0
REFINE_AFTER, LARGE = 2, 16
GROWTH = 3

#: Bytes of a table up to which it goes to all tasks whole, and edges up to which one task solves them. Beyond, tables are shuffled and edges contracted.
LIGHT = 4 << 20
SOLVED = 500_000

#: Elements of most sets that come last in prefix filtering, whatever their numbers; the order decides on cost alone.
COMMON = 10_000

_UNIT = np.uint64(0x9FB21C651E98DF25)
_DART = np.uint64(0xD1342543DE82EF95)


def elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and names of all units of shingle weight: the c-th copy of a shingle in a row has its own name."""
    data, offsets = strings(column)
    starts, ends, rows = spans(data, offsets)
    words = names(data, starts, ends)
    n = np.diff(rows)
    gram, valid = grams(words, rows, SHINGLE)
    row = np.repeat(np.arange(len(n)), n)[valid]
    gram = gram[valid]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(n == size)
        if len(short):
            name, _ = grams(words, rows, size)
            row, gram = np.r_[row, short], np.r_[gram, mix(name[rows[short]] + np.uint64(size))]
    key = mix(gram ^ mix(row.astype(np.uint64) * _UNIT))
    order = np.argsort(key)
    key, row, gram = key[order], row[order], gram[order]
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    place = np.arange(len(key))
    copy = place - np.maximum.accumulate(np.where(first, place, 0)) if len(key) else place
    return row, mix(gram + copy.astype(np.uint64) * _UNIT)


def dart_sketches(row: np.ndarray, unit: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """n signatures of k dart names; rows without units keep zeros."""
    out = np.zeros(n * k, np.uint64)
    weight = np.bincount(row, minlength=n)
    open_rows = np.flatnonzero(weight > 0)
    rank = k * (np.log(k) + MARGIN)
    while len(open_rows):
        is_open = np.zeros(n, bool)
        is_open[open_rows] = True
        mine = is_open[row]
        u, r = unit[mine], row[mine]
        until = np.where(weight > 0, rank / np.maximum(weight, 1), 0.0)
        least = (np.exp(-until) * 2.0**53).astype(np.uint64)
        time, names_, rows_, times_, m = np.zeros(len(u)), [], [], [], 0
        while len(u):
            m += 1
            dart = mix(u + np.uint64(m * int(_DART) % 2**64))
            chance = mix(dart ^ _UNIT) >> np.uint64(11)
            if m == 1:  # the first arrival needs no logarithm where it comes too late
                soon = chance >= least[r]
                u, r, time, dart, chance = u[soon], r[soon], time[soon], dart[soon], chance[soon]
            time = time - np.log((chance.astype(np.float64) + 0.5) * 2.0**-53)
            soon = time <= until[r]
            u, r, time, dart = u[soon], r[soon], time[soon], dart[soon]
            names_.append(dart)
            rows_.append(r)
            times_.append(time)
        dart, r, time = np.concatenate(names_), np.concatenate(rows_), np.concatenate(times_)
        place = r * k + (mix(dart ^ _DART) % np.uint64(k)).astype(np.int64)
        order = np.argsort(-time, kind="stable")
        earliest = np.full(n * k, -1, np.int64)
        earliest[place[order]] = order  # the last write of a place is its earliest dart
        full = (earliest.reshape(n, k) >= 0).all(1) & is_open
        at = np.flatnonzero(np.repeat(full, k))
        out[at] = dart[earliest[at]]
        open_rows = np.flatnonzero(is_open & ~full)
        rank *= 2
    return out.reshape(n, k)


def band_names(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The 64-bit names of each signature's bands."""
    out = np.full((len(signatures), bands), rows, np.uint64)
    parts = signatures.reshape(len(signatures), bands, rows)
    for k in range(rows):
        out = mix(out * _DART ^ parts[:, :, k])
    return mix(out + np.arange(1, bands + 1, dtype=np.uint64) * _UNIT)


def _lists(bands: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1]), pa.int32()), pa.array(bands.view(np.int64).ravel()))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 2)):
        n = batch.num_rows
        row, unit = elements(batch.column(2))
        weight = np.bincount(row, minlength=n)
        one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        np.add.at(one, row, mix(unit ^ _UNIT))
        np.add.at(two, row, mix(unit ^ _DART))
        content = np.stack([one, two], 1).astype("<u8").tobytes()
        contents = [content[16 * i : 16 * i + 16] if w else None for i, w in enumerate(weight.tolist())]
        bands = _lists(band_names(dart_sketches(row, unit, n)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(contents, pa.binary()), pa.array(weight), bands], ["key", "tag", "content", "weight", "bands"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band (an element) and the number of a batch's sets that have it."""
    for batch in batches:
        band, held = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_units(x) for x in batch.column(1).to_pylist())]).astype(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(held.astype(np.int64))], ["band", "held"])


def _dealt(common: np.ndarray, threshold: float):
    """For each set all elements that are not common, without a place, and of the common ones, which come last by name, those that its prefix reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_units(x).astype(np.int64) for x in batch.column(1).to_pylist()]
            n = np.array([len(x) for x in sets], np.int64)
            row, band = np.repeat(np.arange(len(sets)), n), np.concatenate([np.zeros(0, np.int64), *sets])
            is_common = np.isin(band, common)
            commons = np.bincount(row[is_common], minlength=len(sets))
            so_far = np.cumsum(is_common)
            before = np.r_[0, so_far][np.cumsum(n) - n]
            place = n[row] - commons[row] + so_far - before[row]
            keep = ~is_common | (place <= n[row] - np.ceil((threshold - 1e-9) * n[row]) + 1)
            row, band, place, is_common = row[keep], band[keep], place[keep], is_common[keep]
            columns = [batch.column(0).take(pa.array(row)), pa.array(band), pa.array(n[row]), pa.array(commons[row]), pa.array(place, mask=~is_common)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "band", "n", "commons", "place"])

    return run


def _gathered(members: DataFrame) -> DataFrame:
    """A row for each node with its entries."""
    return members.groupBy("id").agg(F.collect_list(F.struct("band", "place", "n")).alias("entries"))


def _prefixes(sets: DataFrame, ids: DataFrame, threshold: float, stage: Stage) -> DataFrame:
    """band (an element), id, place of the element from the rarest on, and n elements, for the prefixes of ids' sets.

    No row meets its element's count in a join. The COMMON elements of most sets come last, by name, so a
    set's own row tells their places, and those behind its prefix are not dealt out. Of the others the holders
    are gathered once with their number; elements that only one set has are left out and counted by difference.
    """
    mine = sets.join(ids, "id", "left_semi").select("id", "units")
    counts = mine.mapInArrow(_held, "band long, held long").groupBy("band").agg(F.sum("held").alias("held")).filter("held > 64")
    common = np.array([r["band"] for r in counts.orderBy(F.desc("held"), "band").limit(COMMON).collect()], np.int64)
    units = stage.write(mine.mapInArrow(_dealt(common, threshold), "id long, band long, n long, commons long, place long"), "units")
    held = units.filter("place is null").groupBy("band").agg(F.count("*").alias("df"), F.collect_list(F.struct("id", "n", "commons")).alias("sets")).filter("df > 1")
    of_set = Window.partitionBy("id")
    rare = held.select("band", "df", F.inline("sets")).withColumns({"rank": F.row_number().over(of_set.orderBy("df", "band")), "shared": F.count("*").over(of_set)})
    rare = rare.select("band", "id", (F.col("n") - F.col("commons") - F.col("shared") + F.col("rank")).alias("place"), "n")
    placed = rare.unionByName(units.filter("place is not null").select("band", "id", "place", "n"))
    return placed.filter(F.col("place") <= F.col("n") - F.ceil(F.lit(threshold - 1e-9) * F.col("n")) + 1)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 1)):
        row, unit = elements(batch.column(1))
        order = np.argsort(row, kind="stable")
        raw = np.ascontiguousarray(unit[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
        ends = np.cumsum(np.bincount(row, minlength=batch.num_rows)).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[5 * a : 5 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())], ["id", "units"])


def _units(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return np.sort(out.view("<u8").ravel())


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed element sets."""
    x, y = _units(a), _units(b)
    if not len(x) or not len(y):
        return 0.0
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            like = pa.array([similarity(x, y) for x, y in pairs], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), like], ["a", "b", "similarity"])

    return lambda df: df.mapInArrow(run, "a long, b long, similarity double").filter(F.col("similarity") >= threshold)


def _light(df: DataFrame) -> bool:
    """Whether Catalyst bounds df below LIGHT; so it does with a written table, not with joins of large ones."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= LIGHT


def _met(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """attach(), but light groups go to all rows whole."""
    return rows.join(F.broadcast(groups), key) if _light(groups) else attach(rows, groups, key, size, n_rows)


def _compare(pairs: DataFrame, sets: DataFrame, threshold: float, stage: Stage, name: str, n_rows: int) -> DataFrame:
    """Links among pairs (member, centre): a centre's set goes out to its members, hot centres by broadcast."""
    pairs = stage.write(pairs, f"{name}-pairs")
    member = small(pairs, LIGHT).join(sets.select(F.col("id").alias("member"), F.col("units").alias("mine")), "member")
    its = sets.select(F.col("id").alias("centre"), F.col("units").alias("its"))
    if _light(pairs) and _light(centres := stage.write(its.join(F.broadcast(pairs.select("centre")), "centre", "left_semi"), f"{name}-centres")):
        rows = member.join(F.broadcast(centres), "centre")
    else:
        rows = attach(member, pairs.groupBy("centre").agg(F.count("*").alias("held")).join(its, "centre"), "centre", "held", n_rows)
    rows = rows.select(F.col("member").alias("a"), F.col("centre").alias("b"), "mine", "its")
    return stage.write(_verify(threshold)(rows), f"{name}-links")


def _may_link(threshold: float):
    """Whether a member's centre is of another class and, in groups by element, leaves both enough elements to share."""

    def test(c: Column) -> Column:
        need = F.ceil(F.lit(threshold / (1 + threshold) - 1e-9) * (F.col("n") + c["n"]))
        left = 1 + F.least(F.col("n") - F.col("place"), c["n"] - c["place"])
        return (c["cls"] != F.col("cls")) & F.coalesce(left >= need, F.lit(True))

    return test


def _centres(classed: DataFrame, k: int) -> DataFrame:
    """band, held and the centres of each group of several classes: the first by hash in each of its slots, which its members are dealt to.

    Slots are GROWTH times as many each round, and GROWTH squared times after refining.
    """
    draw = F.struct(F.xxhash64("id", "band", F.lit(k)).alias("h"), *[F.col(c).alias(c) for c in ("id", "cls", "place", "n")])
    if not k:
        groups = classed.groupBy("band").agg(F.count("*").alias("held"), F.min("cls").alias("low"), F.max("cls").alias("high"), F.array(F.min(draw)).alias("centres"))
        return groups.filter("low <> high").select("band", "held", "centres")
    n_slots = GROWTH ** (k if k <= REFINE_AFTER else 2 * k - REFINE_AFTER - 1)
    slot = F.pmod(F.xxhash64("id", "band", F.lit(k + 1000)), F.lit(n_slots)).alias("slot")
    slots = classed.groupBy("band", slot).agg(F.count("*").alias("held"), F.min("cls").alias("low"), F.max("cls").alias("high"), F.min(draw).alias("first"))
    groups = slots.groupBy("band").agg(F.sum("held").alias("held"), F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("first").alias("centres"))
    return groups.filter("low <> high").select("band", "held", "centres")


def _joined_classes(labels: DataFrame | None, found: DataFrame, stage: Stage, name: str, n_rows: int) -> DataFrame:
    """node and label after new links: only the classes that they join are solved anew."""
    edges = found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
    if edges.count() <= SOLVED:
        return stage.write(solved(edges), f"{name}-solved")
    if labels is None:
        return components(found, stage, name, SOLVED)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    ends = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    moved = components(ends, stage, name, SOLVED)
    sizes = labels.groupBy("label").agg(F.count("*").alias("held"))
    moves = moved.select(F.col("node").alias("label"), F.col("label").alias("to")).join(sizes, "label")
    stay = labels.join(moves.select("label"), "label", "left_anti").select("node", "label")
    new = moved.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return stage.write(attach(labels, moves, "label", "held", n_rows).select("node", F.col("to").alias("label")).unionByName(stay).unionByName(new), f"{name}-joined")


def _judged(docs: DataFrame, threshold: float) -> DataFrame:
    """key, tag, class_key (the class's smallest key), class_size, kept and n_shingles of every row."""
    spark = docs.sparkSession
    prepare(spark)
    stage = Stage(spark, "near-dedup")
    texts = docs.select(row_key(docs).alias("key"), row_tag(docs).alias("tag"), "text")
    rows = stage.write(texts.mapInArrow(_sketch, "key long, tag long, content binary, weight long, bands array<long>"), "sketches")
    n_rows = rows.count()
    worded = rows.filter(F.col("content").isNotNull())
    nodes = worded.groupBy("content").agg(F.count("*").alias("size"), F.min(F.struct("key", "tag")).alias("first"), F.first("bands").alias("bands"))
    nodes = stage.write(nodes.select(F.xxhash64("content").alias("id"), "content", "size", "first", "bands"), "nodes")
    no = F.lit(None).cast("long")
    holders = nodes.select("id", F.transform("bands", lambda b: F.struct(b.alias("band"), no.alias("place"), no.alias("n"))).alias("entries"))
    labels, sets, k = None, None, 0
    while not holders.isEmpty():
        if labels is None:
            classed = holders.withColumn("cls", F.col("id"))
        else:
            classed = holders.join(small(labels, LIGHT).withColumnRenamed("node", "id"), "id", "left").withColumn("cls", F.coalesce("label", "id")).drop("label")
        classed = classed.select("id", "cls", *([F.inline("entries")] if "entries" in holders.columns else ["band", "place", "n"]))
        if k == REFINE_AFTER:
            state = classed.groupBy("band").agg(F.count("*").alias("held"), F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high")
            state = stage.write(state.select("band", "held"), f"groups-{k}")
            open_rows = stage.write(_met(classed, state, "band", "held", n_rows), f"open-{k}")
            large = open_rows.filter(F.col("held") > LARGE).select("id").distinct()
            small_groups = open_rows.filter(F.col("held") <= LARGE).select("band", "id", "place", "n")
            holders = small_groups.unionByName(_prefixes(sets, large, threshold, stage))
            holders = stage.write(holders if labels is None or _light(labels) else _gathered(holders), f"holders-{k}-fine")
            k += 1
            continue
        groups = stage.write(_centres(classed, k), f"groups-{k}")
        met = _met(classed, groups, "band", "held", n_rows)
        met = met.withColumns({"is_centre": F.exists("centres", lambda c: c["id"] == F.col("id")), "centres": F.filter("centres", _may_link(threshold))})
        open_rows = stage.write(met.select("band", "id", "place", "n", "is_centre", F.transform("centres", lambda c: c["id"]).alias("centres")), f"open-{k}")
        if sets is None:
            suspects = stage.write(nodes.join(small(open_rows.select("id").distinct(), LIGHT), "id", "left_semi").select("id", "first.key", "first.tag"), "suspects")
            sets = stage.write(texts.join(small(suspects), ["key", "tag"]).select("id", "text").mapInArrow(_sets, "id long, units binary").dropDuplicates(["id"]), "sets")
        pairs = open_rows.select(F.col("id").alias("member"), F.explode("centres").alias("centre")).distinct()
        found = _compare(pairs, sets, threshold, stage, f"round-{k}", n_rows).select("a", "b")
        if not found.isEmpty():
            labels = _joined_classes(labels, found, stage, f"classes-{k}", n_rows)
        holders = open_rows.filter(~F.col("is_centre"))
        holders = stage.write(_gathered(holders), f"holders-{k + 1}") if labels is not None and not _light(labels) else holders
        k += 1
    content = nodes.select("id", "content", "size", "first")
    if labels is not None:
        content = content.join(small(labels, LIGHT).withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    else:
        content = content.withColumn("label", F.col("id"))
    content = stage.write(content, "content")
    classes = content.groupBy("label").agg(F.sum("size").alias("class_size"), F.count("*").alias("held"), F.min("first").alias("best"))
    content = stage.write(attach(content, classes, "label", "held", n_rows).select("content", "size", "class_size", "best"), "classes")
    found = attach(worded.select("key", "tag", "content", "weight"), content, "content", "size", n_rows)
    out = found.select("key", "tag", F.col("best.key").alias("class_key"), "class_size", (F.struct("key", "tag") == F.col("best")).alias("kept"), F.col("weight").alias("n_shingles"))
    bare = rows.filter(F.col("content").isNull()).select("key", "tag", F.col("key").alias("class_key"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), F.col("weight").alias("n_shingles"))
    return out.unionByName(bare)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the class's smallest doc_id), class_size, kept (the class's first text) and n_shingles of every row."""
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return _judged(docs.select("doc_id", "text"), threshold).select(real("key").alias("doc_id"), real("class_key").alias("class_id"), F.col("class_size").cast("long").alias("class_size"), "kept", "n_shingles")


def kept_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, a text of the smallest doc_id, with all columns; documents without words all stay, but for repeated rows."""
    return with_rows(docs, _judged(docs.select("doc_id", "text"), threshold).filter("kept").select("key", "tag"))
