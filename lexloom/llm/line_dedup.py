"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

Lines are \\n-split, without white space at their ends; lines left empty are none. Equal
lines are one row from the start. Distinct lines, of whatever length, are alike when their edit
distance (code points) is at most EDITS: a line of length l is split into EDITS+1 even
segments, one of which every partner holds unchanged, at a place that the lengths and the
segment's number narrow down to a few. Each line is put in an index by its segments and
probes, for its own length and the EDITS shorter ones, the substrings at those places; the
join is on (length, segment number, segment). Pairs are verified by the banded bit-parallel
recurrence of edit distance: the band's 2*EDITS+1 cells of a column are bits of one integer that
slides down the diagonal. A line of EDITS characters or fewer has an empty segment: such lines
meet each other by length, and longer lines by a common character, which every link needs.

A segment that more than HEAVY lines of one length hold doesn't send its lines to the edit
distance pair by pair. Each line that probes it first meets the commonest of those lines alone, which tells the
lines of such segments; then these meet each other under their crowded keys, where a pair comes
out only if the counts of common letters differ by no more than EDITS edits can make them. So all links are found
and n_links counts every other line within EDITS; what still grows with the square of a
crowded segment's lines is the comparison of letter counts, dealt out by SPREAD lines.

Defined cases: null text has no lines; null ids count as occurrences, first_doc_id ignores
them; repeated rows add occurrences; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.components import components
from lexloom.llm.support import Stage, prepare
from lexloom.session import small

EDITS = 2

#: Lines of one length that may hold a segment and still be compared pair by pair.
HEAVY = 32

#: Lines of a crowded segment that one task compares with all others of it.
SPREAD = 1024

#: Segment numbers of the keys by which lines of EDITS characters or fewer meet each other and longer lines.
TINY, CHARACTER = -1, -2

#: Fixed value: characters that are common in many languages, ten to a key; each count takes six bits of its key.
LETTERS = ("etaonisrhd", "lcumwfgypb", "vkjxqz ,.-")
#: Fixed value: characters whose counts are compared before a pair's edit distance is worked out.
CHARACTERS = "abcdefghijklmnopqrstuvwxyz ,."


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id and line for every line that is not blank."""
    raw = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("raw"))
    return raw.select("doc_id", F.btrim("raw", F.lit(" \t\n\x0b\x0c\r")).alias("line")).filter("line <> ''")


def _letters() -> Column:
    """A key of counts for each part of LETTERS."""
    low = F.lower("line")
    keys = []
    for part in LETTERS:
        counts = [F.shiftleft(((F.octet_length(low) - F.octet_length(F.replace(low, F.lit(c), F.lit("")))) % 64).cast("long"), 6 * k) for k, c in enumerate(part)]
        keys.append(sum(counts[1:], counts[0]))
    return F.array(*keys)


def _letters_apart(a: str, b: str) -> Column:
    """At most the sum of differences in letter counts; an edit changes it by two at most."""
    parts = []
    for j, part in enumerate(LETTERS):
        for k in range(len(part)):
            d = F.pmod(F.shiftright(F.col(a)[j], 6 * k) - F.shiftright(F.col(b)[j], 6 * k), F.lit(64))
            parts.append(F.least(d, 64 - d))
    return sum(parts[1:], parts[0])


def _characters_apart(x: str, y: str) -> Column:
    """Sum of differences in the counts of single characters, as far as CHARACTERS go; an edit changes it by two at most."""
    count = lambda t, c: F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit("")))
    parts = [F.abs(count(F.col(x), c) - count(F.col(y), c)) for c in CHARACTERS]
    return sum(parts[1:], parts[0])


def _probes() -> list[tuple[int, int, int]]:
    """How much shorter a partner is, the number of its segment, and how far right of its place the segment may stand."""
    out = []
    for d in range(EDITS + 1):
        for i in range(EDITS + 1):
            out += [(d, i, shift) for shift in range(max(-i, d - (EDITS - i)), min(i, d + (EDITS - i)) + 1)]
    return out


def _keys(lines: DataFrame, probes: list[tuple[int, int, int]], *more: str) -> DataFrame:
    """id, key and longer (than the partners) for each probe of each line that fits; the probes are rows of a constant array."""
    parts = EDITS + 1
    told = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for d, i, shift in probes])
    each = lines.filter(F.col("n_chars") > EDITS).select("id", "line", "n_chars", *more, F.inline(told)).withColumn("length", F.col("n_chars") - F.col("d"))
    spare = F.col("i") - (parts - F.col("length") % parts)  # from zero on for the last segments, which are longer by one
    placed = each.filter(F.col("length") > EDITS).select(
        "id", "line", "n_chars", *more, "length", "i", (F.col("d") > 0).alias("longer"),
        (F.floor(F.col("length") / parts).cast("int") * F.col("i") + F.greatest(spare, F.lit(0)) + 1 + F.col("shift")).alias("at"),
        (F.floor(F.col("length") / parts).cast("int") + F.when(spare >= 0, 1).otherwise(0)).alias("size"),
    )
    fits = placed.filter((F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= F.col("n_chars")))
    return fits.select("id", F.xxhash64("length", "i", F.substr("line", "at", "size")).alias("key"), "longer", *more)


def _tiny_key(length: Column, number: int, text: Column) -> Column:
    return F.xxhash64(length.cast("int"), F.lit(number), text)


def _character_keys(length: Column) -> Column:
    """A key for each distinct character of the line, for partners of this length."""
    return F.transform(F.array_distinct(F.split("line", "")), lambda c: _tiny_key(length, CHARACTER, c))


def index_keys(lines: DataFrame, *more: str) -> DataFrame:
    """id and key under which each line is found, and more of its columns."""
    n = F.col("n_chars")
    tiny = lines.filter(n <= EDITS).select("id", F.explode(F.concat(F.array(_tiny_key(n, TINY, F.lit(""))), _character_keys(n))).alias("key"), *more)
    return _keys(lines, [(0, i, 0) for i in range(EDITS + 1)], *more).select("id", "key", *more).unionByName(tiny)


def probe_keys(lines: DataFrame) -> DataFrame:
    """id, key and longer for partners that are as long as the line or up to EDITS shorter."""
    out = _keys(lines, _probes())
    short = lines.filter(F.col("n_chars") <= 2 * EDITS)
    for d in range(EDITS + 1):
        length = F.col("n_chars") - d
        own = F.when(F.col("n_chars") <= EDITS, F.array(_tiny_key(length, TINY, F.lit("")))).otherwise(_character_keys(length))
        out = out.unionByName(short.filter((length >= 1) & (length <= EDITS)).select("id", F.explode(own).alias("key"), F.lit(d > 0).alias("longer")))
    return out


def band_distance(pattern: Column, text: Column, edits: int = EDITS) -> Column:
    """Edit distance of two strings if it is at most edits, else edits + 1; the text is the longer by at most edits.

    Bit b of a column's words is the pattern's character at column - edits + b. vp and vn hold
    where a cell is one above or below the cell over it; dist follows the band's lower edge, first
    down the diagonal, then, past the pattern's end, along its last row.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    both = F.struct(F.split(pattern, "").alias("p"), F.split(text, "").alias("t"), F.char_length(pattern).alias("m"), F.char_length(text).alias("n"))

    def walk(v: Column) -> Column:
        """v holds the characters of both and their numbers."""

        def matches(i: Column) -> Column:
            eq = F.lit(0)
            for b in range(width):
                at = i + (b - edits)
                eq = eq.bitwiseOR(F.when((at >= 0) & (at < v["m"]) & (F.get(v["p"], at) == F.get(v["t"], i)), 1 << b).otherwise(0))
            return eq

        def step(acc: Column, i: Column) -> Column:
            vp, vn = acc["vp"], acc["vn"]
            over = i - (v["m"] - edits)  # columns past the last one whose band ends inside the pattern

            def turn(x: Column) -> Column:
                d0, hp = x["d0"], x["hp"]
                hn, half = d0.bitwiseAND(vp), F.shiftrightunsigned(x["d0"], 1)
                mask = F.element_at(F.array(*[F.lit(1 << b) for b in range(width)]), F.greatest(F.lit(1), width - 1 - over))
                on = lambda y, bit: F.when(y.bitwiseAND(bit) != 0, 1).otherwise(0)
                grown = F.when(over < 0, 1 - on(d0, F.lit(1 << (width - 1)))).otherwise(on(hp, mask) - on(hn, mask))
                return F.struct(
                    hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp))).bitwiseAND(F.lit(full)).alias("vp"),
                    half.bitwiseAND(hp).alias("vn"),
                    (acc["dist"] + grown).alias("dist"),
                )

            def with_hp(d0: Column) -> Column:
                hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(F.lit(full))
                return _bound(F.struct(d0.alias("d0"), hp.alias("hp")), turn)

            def with_eq(eq: Column) -> Column:
                d0 = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(full))
                return _bound(d0, with_hp)

            return _bound(matches(i), with_eq)

        start = F.struct(F.lit(full ^ ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("dist"))
        return F.aggregate(F.sequence(F.lit(0), v["n"] - 1), start, step, lambda acc: acc["dist"])

    # the band's lower edge starts at row edits, which a shorter pattern doesn't have
    return F.least(F.when(F.char_length(pattern) < edits, F.levenshtein(pattern, text)).otherwise(_bound(both, walk)), F.lit(edits + 1))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """a, b and distance of the pairs within EDITS."""
    text = lines.select("id", "line")
    wanted = pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    suspects = text.join(small(wanted), "id", "left_semi")
    both = pairs.join(suspects.select(F.col("id").alias("a"), F.col("line").alias("x"), F.char_length("line").alias("nx")), "a")
    both = both.repartition(_tasks(lines), "b").join(suspects.select(F.col("id").alias("b"), F.col("line").alias("y"), F.char_length("line").alias("ny")), "b")
    both = both.filter(_characters_apart("x", "y") <= 2 * EDITS)
    turned = F.col("nx") > F.col("ny")
    distance = band_distance(F.when(turned, F.col("y")).otherwise(F.col("x")), F.when(turned, F.col("x")).otherwise(F.col("y")))
    return both.select("a", "b", distance.alias("distance")).filter(F.col("distance") <= EDITS)


def line_links(lines: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Links a, b (ids of distinct lines, each once) with their edit distance, and node and label of their classes.

    lines has id, line, n_chars and n_rows.
    """
    # a line's weight: its occurrences, and bits of its id between lines of as many
    weight = F.shiftleft(F.least("n_rows", F.lit(2**18 - 1)), 44).bitwiseOR(F.col("id").bitwiseAND(F.lit(2**44 - 1)))
    index = index_keys(lines.withColumn("weight", weight), "weight")
    heavy = index.groupBy("key").agg(F.count("*").alias("held"), F.max("weight").alias("top")).filter(F.col("held") > HEAVY)
    heavy = stage.write(heavy.select("key", "top", (1 + F.floor(F.col("held") / SPREAD)).cast("int").alias("parts")), "heavy")
    held = index.join(small(heavy), "key", "left").filter("top is null or top = weight").select("key", F.col("id").alias("a"), F.col("top").isNotNull().alias("is_heavy"))
    probe = probe_keys(lines).select("key", "longer", F.col("id").alias("b"))
    once = F.col("longer") | F.col("is_heavy") | (F.col("a") < F.col("b"))  # of lines of one length each pair meets twice
    met = probe.join(held.hint("shuffle_hash"), "key").filter(once & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "is_heavy")
    pairs = stage.write(met.groupBy("a", "b").agg(F.max("is_heavy").alias("is_heavy")), "pairs")
    wanted = pairs.filter("not is_heavy").select("a", "b")
    if not heavy.isEmpty():
        wanted = stage.write(wanted.unionByName(_crowded(pairs.filter("is_heavy"), heavy, lines, stage)).distinct(), "all-pairs")
    links = stage.write(_verified(wanted, lines), "links")
    return links, components(links.select("a", "b"), stage, "classes")


def _crowded(pairs: DataFrame, heavy: DataFrame, lines: DataFrame, stage: Stage) -> DataFrame:
    """a and b of all lines that share a crowded key and may be alike by their letters; pairs name the lines that probe or hold one."""
    ends = pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    crowd = stage.write(lines.join(small(ends), "id", "left_semi").select("id", "line", "n_chars", _letters().alias("letters")), "crowd")
    letters = lambda name: small(crowd.select(F.col("id").alias(name), F.col("letters").alias(f"g{name}")))
    own = lambda keys, part, name: keys.join(small(heavy.select("key", "parts")), "key").withColumn("part", part).withColumnRenamed("id", name).drop("parts").join(letters(name), name)
    left = stage.write(own(index_keys(crowd), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), "a"), "crowd-index")
    right = stage.write(own(probe_keys(crowd), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "b"), "crowd-probe")
    once = (F.col("longer") | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b"))
    met = right.repartition(_tasks(lines), "key", "part").join(left.hint("shuffle_hash"), ["key", "part"]).filter(once & (_letters_apart("ga", "gb") <= 2 * EDITS))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _tasks(df: DataFrame) -> int:
    """Tasks for steps whose work is not told by their bytes, which Spark would put together in a few."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def line_classes(docs: DataFrame) -> DataFrame:
    """A row for each distinct line: its id (a hash of the line), length, occurrences, first document,
    class (the smallest id of linked lines), number of links and whether it stands for its class."""
    spark = docs.sparkSession
    prepare(spark)
    stage = Stage(spark, "line-dedup")
    counted = lines_of(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])).groupBy("line").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_doc_id"))
    lines = stage.write(counted.select(F.xxhash64("line").alias("id"), "line", F.char_length("line").alias("n_chars"), "n_rows", "first_doc_id"), "lines")
    links, labels = line_links(lines, stage)
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    linked = labels.withColumnRenamed("node", "id").join(ends, "id")
    out = lines.select("id", "n_chars", "n_rows", "first_doc_id").join(linked, "id", "left")
    return out.select(
        F.col("id").alias("line_id"), F.col("n_chars").cast("long").alias("n_chars"), "n_rows", "first_doc_id",
        F.coalesce("label", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.coalesce("label", "id") == F.col("id")).alias("kept"),
    )
