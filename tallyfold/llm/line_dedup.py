"""Fuzzy line dedup by MinHash, in DataFrame functions only.

Lines are split at \\n over the whole corpus. A line's shingles are all its substrings of
SHINGLE bytes (a shorter line is its own shingle). Equal lines are one node. Six
min-hashes of one 64-bit shingle hash (least and greatest, under three XOR masks) are
banded in pairs around a ring: a pair is a candidate if it shares a band and AGREE
min-hashes. At a Jaccard similarity of 0.8 that are 97 % of the pairs, at 0.9 over 99 %.
The candidates of a bucket's nodes with some of them are compared by the exact Jaccard
similarity of their shingles; links of at least 0.8 are joined by a distributed
union-find. Then all nodes of larger buckets that are not in one component meet. A pair
of a larger bucket leaves the join only if parities of its shingle sets, which bound
their symmetric difference from below, do not put it under 0.8: so all candidates are
compared, in one component, or too far apart. Of each component the first line, by
(doc_id, text, place), stays.

Shingles are hashed inside generated code, STEP to a row, so that a line's row meets the
aggregation once for STEP shingles. Arrays that are never empty are exploded by the outer
form: for the inner one Spark makes each array a second time to drop empty ones.

Cases: a null text stays null and an empty one empty; lines of white space only are
always kept; of repeated rows (one id and text) one is judged and the others lose all
lines with content; rows that share an id are documents of their own, and those without
an id come last; lines of any length are read whole; an empty table gives an empty
result; further columns are kept by `dedup_lines`.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import cut, discard, narrow, release
from tallyfold.llm.components import joined

SHINGLE = 12
#: Shingles hashed in one row.
STEP = 8
#: Least similarity in hundredths.
SIMILAR = 80
#: Fixed masks under which the least and the greatest hash of a line are taken.
MASKS = (0, 0x1234567890ABCDEF, 0x5BD1E9955BD1E995)
#: Min-hashes of six that a candidate pair has in common.
AGREE = 3
#: Numbers of 64 bits that hold a shingle set's parities.
PARITIES = 16
#: Nodes of a larger bucket that all its nodes are compared with first.
PIVOTS = 4
#: Nodes of a larger bucket that meet the others in one task.
CHUNK = 1_000
#: 64-bit names that several of the different lines may share; random names of 10^10 lines share about three.
CLASHES = 10_000
_LAST = (1 << 63) - 1
_KEY = ["key", "key2"]


def _key() -> list[Column]:
    """The 128-bit name of a row's (doc_id, text)."""
    text = F.col("text").cast("string")
    return [F.xxhash64("doc_id", text).alias("key"), F.xxhash64(F.lit(1), "doc_id", text).alias("key2")]


def _keyed(docs: DataFrame) -> DataFrame:
    """The name, ord (the id, null last) and text of every row that has a text."""
    rows = docs.select(*_key(), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("ord"), F.col("text").cast("string").alias("text"))
    return rows.where("text is not null")


def _lines(rows: DataFrame, clashes: list[int] = ()) -> DataFrame:
    """Every line that is not only white space, with its place and a 128-bit name (h, h2); `clashes`: values of h that several lines have."""
    lines = rows.select(*_KEY, "ord", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"\S"))
    return _renamed(lines.select("*", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2")), clashes)


def _renamed(lines: DataFrame, clashes: list[int]) -> DataFrame:
    """Lines whose h also names another line get a name made of both halves; h alone tells lines apart then."""
    return lines.withColumn("h", F.when(F.col("h").isin(list(clashes)), F.xxhash64("h", "h2")).otherwise(F.col("h"))) if clashes else lines


def _at() -> Column:
    """A line's place in the corpus: by ord, then half the text's name, then pos; an integer below 2^126."""
    tail = F.shiftrightunsigned("key", 32) * F.lit(1 << 31) + F.col("pos")
    return (F.col("ord").cast("decimal(19,0)") * F.lit(Decimal(1 << 63)).cast("decimal(19,0)") + tail.cast("decimal(19,0)")).cast("decimal(38,0)")


def _place(at: str) -> list[Column]:
    """ord, the half of the text's name and pos of a place."""
    wide = F.lit(Decimal(1 << 63)).cast("decimal(19,0)")
    tail = F.pmod(at, wide)
    split = F.struct(F.expr(f"({at} - pmod({at}, {1 << 63}BD)) div {1 << 63}BD").alias("ord"), tail.cast("long").alias("tail"))
    return [split["ord"].alias("ord"), F.shiftright(split["tail"], 31).alias("half"), split["tail"].bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("pos")]


def _last_start(b: Column) -> Column:
    return F.greatest(F.octet_length(b) - (SHINGLE - 1), F.lit(1))


def _signatures(lines: DataFrame) -> DataFrame:
    """h and the six min-hashes v0 .. v5 of every different line, over all its shingles."""
    rows = lines.select("h", F.col("line").cast("binary").alias("b")).withColumn("last", _last_start(F.col("b")))
    steps = rows.select("h", "b", "last", F.explode_outer(F.sequence(F.lit(1), "last", F.lit(STEP))).alias("i"))
    # a line's last step repeats its last shingle
    hashes = [F.xxhash64(F.substring("b", F.least(F.col("i") + k, F.col("last")), F.lit(SHINGLE))).alias(f"s{k}") for k in range(STEP)]
    found = []
    for i, mask in enumerate(MASKS):
        masked = [F.col(f"s{k}").bitwiseXOR(F.lit(mask)) for k in range(STEP)]
        found += [F.min(F.least(*masked)).alias(f"v{2 * i}"), F.max(F.greatest(*masked)).alias(f"v{2 * i + 1}")]
    return steps.select("h", *hashes).groupBy("h").agg(*found)


def _candidates(signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of nodes of buckets of two or three, and the crowds: the nodes h of buckets of more, by their least node p.

    Pairs of small buckets follow from the least, the greatest and the XOR of all.
    """
    n = 2 * len(MASKS)
    bands = F.array(*(F.xxhash64(F.lit(i), F.col(f"v{i}"), F.col(f"v{(i + 1) % n}")) for i in range(n)))
    rows = signatures.select("h", F.explode(bands).alias("band"))
    buckets = cut(rows.groupBy("band").agg(F.min("h").alias("b"), F.max("h").alias("a"), F.bit_xor("h").alias("x"), F.count("*").alias("n")).where("n > 1"))
    middle = F.col("x").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b"))
    three = buckets.where("n = 3").select("a", "b", middle.alias("c"))
    small = buckets.where("n < 4").select("a", "b").unionByName(three.select("a", F.col("c").alias("b"))).unionByName(three.select(F.col("c").alias("a"), "b"))
    pairs = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    crowds = cut(rows.join(narrow(buckets.where("n > 3").select("band", F.col("b").alias("p"))), "band").select("p", "h").distinct())
    discard(buckets)
    return pairs, crowds


def _agreeing(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) with AGREE min-hashes in common."""
    n = 2 * len(MASKS)
    x, y = (signatures.select(F.col("h").alias(h), *(F.col(f"v{i}").alias(f"{h}{i}") for i in range(n))) for h in "ab")
    same = sum(((F.col(f"a{i}") == F.col(f"b{i}")).cast("int") for i in range(n)), F.lit(0))
    return pairs.join(x, "a").join(y, "b").where(same >= AGREE).select("a", "b")


def _shingles(line: str) -> Column:
    """The shingles of a line, as 64-bit hashes; repeats stay. The outer lambda holds the line: a column would be copied for each shingle."""
    held = F.transform(F.array(line), lambda b: F.transform(F.sequence(F.lit(1), _last_start(b)), lambda i: F.xxhash64(F.substring(b, i, F.lit(SHINGLE)))))
    return F.element_at(held, 1)


def _texts(rows: DataFrame, wanted: DataFrame, clashes: list[int] = ()) -> DataFrame:
    """h and line of the wanted (h, at): only texts that may hold one are split. Texts of one id and half a name are told apart by the line's hash."""
    by_text = cut(wanted.select("h", *_place("at")).groupBy("ord", "half").agg(F.collect_list(F.struct("h", "pos")).alias("wanted")))
    texts = rows.select("ord", F.shiftrightunsigned("key", 32).alias("half"), "text").join(narrow(by_text), ["ord", "half"])
    found = texts.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w")).select(F.col("w.h").alias("want"), F.get("lines", F.col("w.pos")).alias("line"))
    named = _renamed(found.select("want", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2")), clashes)
    return named.where("h = want").select("h", F.col("line").cast("binary").alias("line")).dropDuplicates(["h"])


def _verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of SIMILAR hundredths or more. Texts are sent: they are a small part of their sets."""
    left, right = (found.select(F.col("h").alias(h), F.col("line").alias(line)) for h, line in (("a", "x"), ("b", "y")))
    met = pairs.join(left, "a").join(right, "b")
    sets = met.select("a", "b", F.inline(F.array(F.struct(_shingles("x").alias("x"), _shingles("y").alias("y")))))
    sizes = F.struct(F.size(F.array_intersect("x", "y")).alias("both"), F.size(F.array_union("x", "y")).alias("either"))
    return sets.select("a", "b", F.inline(F.array(sizes))).where(f"100 * both >= {SIMILAR} * either").select("a", "b")


def _members(crowds: DataFrame, found: DataFrame, signatures: DataFrame) -> DataFrame:
    """The rows (p, h) of `crowds` with all crowds of h, n, the size of h's shingle set, its parities s0, s1, ... and its min-hashes.

    A shingle's hash names one of 64 * PARITIES bits; a bit is 1 if it is named an odd number
    of times. Bits that differ between two sets are named by shingles that only one of
    them holds, each by another one.
    """
    nodes = crowds.select("h").distinct()
    sets = found.join(narrow(nodes), "h").select("h", F.inline(F.array(F.struct(_shingles("line").alias("gs")))))
    bits = sets.select("h", F.explode_outer(F.array_distinct("gs")).alias("g")).select("h", F.expr("g & 63").cast("int").alias("bit"), F.expr(f"pmod(shiftright(g, 6), {PARITIES})").alias("slot"))
    parities = [F.expr(f"bit_xor(case when slot = {k} then shiftleft(1L, bit) else 0L end)").alias(f"s{k}") for k in range(PARITIES)]
    told = bits.groupBy("h").agg(F.count("*").alias("n"), *parities).join(signatures, "h")
    return crowds.join(told.join(crowds.groupBy("h").agg(F.collect_list("p").alias("ps")), "h"), "h")


def _meeting(rows: DataFrame, others: DataFrame, once: bool = False) -> DataFrame:
    """The pairs (a, b) of `rows` and `others` of one crowd and different components, with AGREE min-hashes in common, whose shingle sets may be similar; `once`: both are the same rows, and a pair meets in the first of the crowds that both are in.

    Sets of sizes n and m are similar if 9 * their symmetric difference <= n + m. Rows of a
    large crowd are dealt to tasks of CHUNK, and the others sent to each of them.
    """
    # without checks for nulls the condition is short enough to be compiled to machine code
    x, y = (df.select("ps", *(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in df.columns if c != "ps")) for df in (rows, others))
    x = x.withColumn("chunk", F.expr("pmod(xxhash64(h), chunks)")).alias("x")
    y = y.withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).alias("y")
    same = " + ".join(f"int(x.v{i} = y.v{i})" for i in range(2 * len(MASKS)))
    differ = " + ".join(f"bit_count(x.s{k} ^ y.s{k})" for k in range(PARITIES))
    met = x.join(y, F.expr(f"x.p = y.p and x.chunk = y.chunk and x.part <> y.part and {'x.h > y.h and ' if once else ''}{same} >= {AGREE} and 9 * ({differ}) <= x.n + y.n{' and array_min(array_intersect(x.ps, y.ps)) = x.p' if once else ''}"))
    return met.select(F.greatest("x.h", "y.h").alias("a"), F.least("x.h", "y.h").alias("b"))


def _live(members: DataFrame, parts: DataFrame) -> DataFrame:
    """The members of crowds of several components, with their component `part` and the `chunks` of their crowd."""
    of = members.select("p", "h").join(narrow(parts), F.col("h") == F.col("node"), "left").select("p", "h", F.coalesce("component", "h").alias("part"))
    several = of.groupBy("p").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.expr(f"(count(*) - 1) div {CHUNK} + 1").alias("chunks")).where("low < high")
    return cut(members.join(of.join(several.select("p", "chunks"), "p"), ["p", "h"]))


def _masks(docs: DataFrame) -> DataFrame:
    """key, key2, of every line of its text that is not white space twice the place, and one more if it stays, and whether rows repeat; for texts that lose lines."""
    rows = _keyed(docs)
    places = cut(_lines(rows).select(*_KEY, "pos", _at().alias("at"), "h", "h2"))
    # the first place of each different line, from which its text is fetched
    grouped = lambda df: cut(df.groupBy("h").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.min("h2").alias("low"), F.max("h2").alias("high")))
    groups = grouped(places)
    clashes = [r["h"] for r in groups.where("low <> high").select("h").limit(CLASHES + 1).collect()]
    if len(clashes) > CLASHES:
        raise ValueError("too many lines share a hash")
    if clashes:
        discard(groups)
        places = _renamed(places, clashes)
        groups = grouped(places)
    signatures = cut(_signatures(_lines(rows, clashes)))
    release(docs.sparkSession)
    wanted, crowds = _candidates(signatures)
    pairs = cut(_agreeing(wanted, signatures))
    discard(wanted)
    release(docs.sparkSession)
    near = cut(pairs.select(F.explode(F.array("a", "b")).alias("h")).unionByName(crowds.select("h")).distinct())
    found = cut(_texts(rows, groups.select("h", "at").join(narrow(near), "h"), clashes))
    discard(near)
    members = cut(_members(crowds, found, signatures))
    discard(crowds, signatures)
    # with a few nodes of each crowd first, so that most of a crowd is one component when all meet
    every = members.withColumn("part", F.col("h")).withColumn("chunks", F.lit(1).cast("long"))
    some = every.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy(F.xxhash64("h"), "h"))).where(F.col("i") <= PIVOTS).drop("i")
    first = cut(pairs.unionByName(_meeting(every, some)).distinct())
    discard(pairs)
    release(docs.sparkSession)
    links = cut(_verified(first, found))
    parts = joined(None, links)
    discard(first, links)
    release(docs.sparkSession)
    live = _live(members, parts)
    discard(members)
    rest = cut(_meeting(live, live, once=True))
    more = cut(_verified(rest, found))
    discard(live, rest, found)
    release(docs.sparkSession)
    parts = joined(parts, more)
    of = groups.join(narrow(parts), F.col("h") == F.col("node"), "left").select("h", "at", "n", "component")
    several = of.where("component is not null")
    firsts = several.groupBy("component").agg(F.min("at").alias("keep"))
    fates = cut(several.join(firsts, "component").select("h", "keep").unionByName(of.where("component is null and n > 1").select("h", F.col("at").alias("keep"))))
    stays = F.col("keep").isNull() | (F.col("keep") == F.col("at"))
    told = places.join(narrow(fates), "h", "left").select(*_KEY, (2 * F.col("pos").cast("long") + stays.cast("long")).alias("code"), stays.alias("stays"))
    masks = told.groupBy(*_KEY).agg(F.array_sort(F.collect_set("code")).alias("mask"), F.min("stays").alias("whole"), F.count("*").alias("n"))
    return masks.select(*_KEY, "mask", (F.col("n") > F.size("mask")).alias("repeats"), "whole").where("repeats or not whole").drop("whole")


def _apply(docs: DataFrame) -> DataFrame:
    """The rows of docs (as the struct `row`) with text (kept lines), n_lines and n_removed."""
    masks = cut(_masks(docs))
    release(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_key()).join(masks, _KEY, "left")
    places = lambda codes: F.transform(codes, lambda m: F.shiftright(m, 1).cast("int"))
    gone = places(F.filter("mask", lambda m: m % 2 == 0))
    if masks.where("repeats").limit(1).count():
        # of rows with one id and text the first that is written is judged; the others lose what it holds
        repeated = cut(rows.where("repeats").withColumn("i", F.monotonically_increasing_id()))
        firsts = cut(repeated.groupBy(*_KEY).agg(F.min("i").alias("first")))
        told = repeated.join(narrow(firsts), _KEY).select("row", F.when(F.col("i") == F.col("first"), gone).otherwise(places("mask")).alias("gone"))
        rows = rows.where("repeats is null or not repeats").select("row", gone.alias("gone")).unionByName(told)
    else:
        rows = rows.select("row", gone.alias("gone"))
    lines = F.split(F.col("row.text").cast("string"), "\n")
    kept = F.zip_with(lines, _flags(F.col("gone"), F.size(lines)), lambda line, flag: F.when(flag == "1", line))
    text = F.when(F.col("gone").isNull(), F.col("row.text").cast("string")).otherwise(F.array_join(kept, "\n"))
    return rows.select("row", text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def _flags(gone: Column, n: Column) -> Column:
    """Runs of 1 for the lines that stay between the ordered places `gone`, and a 0 for each of these."""
    before = F.concat(F.array(F.lit(-1)), gone)
    runs = F.zip_with(before, F.concat(gone, F.array(n)), lambda a, b: F.repeat(F.lit("1"), b - a - 1))
    return F.split(F.array_join(runs, "0"), "")


def line_dedup(docs: DataFrame) -> DataFrame:
    """Per document its lines, those removed, and the text that is left."""
    return _apply(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", "text")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with their columns and the text that is left; rows that lost their last line with content go."""
    found = _apply(docs)
    empty = F.col("n_removed").__gt__(0) & (F.length(F.trim(F.translate("text", "\n\t\r\x0b\x0c", "     "))) == 0)
    columns = [F.col("text").cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return found.where(~F.coalesce(empty, F.lit(False))).select(*columns)
