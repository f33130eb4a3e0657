"""Fill-in-the-middle: texts cut at unit borders and written in another order, by joins on units.

A unit is a run of ASCII letters or one other character. Units are exploded with their
places, a window gives the running sums of their lengths and ordinals, a document's two
cut requests are joined by unit ordinal, and the offsets found are gathered per document
for `substring`. One row stands for UNITS consecutive units, so that a text makes few
rows; the rest of a cut, below UNITS units, is measured inside the row that it hits.
Lengths are shuffled once by a number of the row, and so are the texts: windows, joins
and aggregates keep that partitioning.

Cases: a null or empty text is plain, with 0 units; a null doc_id draws as the decimal
''; repeated rows are cut alike, as rows of their own; texts of any length are cut whole,
one row of UNITS units after another; an empty table gives an empty result; further
columns are not read. Row numbers come from the scan, which numbers a file's rows alike
on every attempt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Units that one exploded row stands for.
UNITS = 64
#: Shares, of 100, of documents that are rewritten, and of these the ones that begin with the suffix.
RATE, SPM = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(doc_id: Column) -> list[Column]:
    """h1 to h4: 32-bit groups of the hash of `1:` and the decimal id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text), with a number of the row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def exploded_units(rows: DataFrame) -> DataFrame:
    """(row, doc_id, n, place, units, chars): the place, the units and the characters of each UNITS units of a text of n units; partitioned by row."""
    many = F.regexp_extract_all("text", F.lit(f"(?:[A-Za-z]++|[^A-Za-z]){{1,{UNITS}}}+"), F.lit(0))
    parts = rows.where("text <> ''").select("row", "doc_id", many.alias("parts"))
    n = (F.size("parts") - 1).cast("long") * UNITS + F.size(_units(F.element_at("parts", -1)))
    whole = parts.select("row", "doc_id", n.alias("n"), F.transform("parts", F.char_length).alias("lengths")).repartition("row")
    own = whole.select("row", "doc_id", "n", F.posexplode("lengths").alias("place", "chars"))
    return own.withColumn("units", F.least(F.lit(UNITS).cast("long"), F.col("n") - F.col("place") * F.lit(UNITS).cast("long")))


def cut_offsets(rows: DataFrame) -> DataFrame:
    """Per row with units: n, and for both cuts the place (first character, length) of the units they hit and the units to count there."""
    units = exploded_units(rows)
    # all columns name the partition, so that requests and units read one exchange
    before = Window.partitionBy("row", "doc_id", "n").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in (("units", "first"), ("chars", "start"))]
    placed = units.select("row", "units", "chars", *sums)
    ends = [h % (F.col("n") + 1) for h in draws(F.col("doc_id"))[:2]]
    requests = units.where("place = 0").select(F.col("row").alias("of"), "n", F.posexplode(F.array(F.least(*ends), F.greatest(*ends))).alias("cut", "ordinal"))
    # a cut after no units hits none; every other one hits the units that hold its last one
    hit = (F.col("row") == F.col("of")) & (F.col("first") < F.col("ordinal")) & (F.col("ordinal") <= F.col("first") + F.col("units"))
    found = requests.hint("shuffle_hash").join(placed, hit, "left")
    place = F.struct("start", "chars", (F.col("ordinal") - F.col("first")).alias("units"))
    at = [F.max(F.when(F.col("cut") == k, place)).alias(name) for k, name in enumerate(("low", "high"))]
    return found.groupBy("of").agg(F.max("n").alias("n"), *at)


def _offset(text: Column, place: Column) -> Column:
    """Characters before a cut."""
    part = F.substr(text, place["start"].cast("int") + 1, place["chars"].cast("int"))
    return F.coalesce(place["start"] + F.char_length(F.array_join(F.slice(_units(part), 1, place["units"].cast("int")), "")), F.lit(0))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; it holds no mark, so that the first of each is the output's own."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    psm = F.concat(between(PREFIX, SUFFIX), F.substring_index(output, MIDDLE, -1), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), F.substring_index(output, MIDDLE, -1), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars (null if plain) and output of every row."""
    rows = _numbered(docs)
    text, (_, _, h3, h4) = F.col("text"), draws(F.col("doc_id"))
    found = rows.repartition("row").join(cut_offsets(rows).hint("shuffle_hash"), F.col("row") == F.col("of"), "left")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | text.contains(mark)
    plain = (text == "") | marked | (h3 % 100 >= RATE)
    form = F.when(plain, "plain").when(h4 % 100 < SPM, "spm").otherwise("psm")
    found = found.select("doc_id", "text", F.coalesce("n", F.lit(0)).cast("long").alias("n"), form.alias("form"), _offset(text, F.col("low")).alias("low"), _offset(text, F.col("high")).alias("high"))
    low, high = F.col("low").cast("int"), F.col("high").cast("int")
    prefix, middle, suffix = F.substr(text, F.lit(1), low), F.substr(text, low + 1, high - low), F.substr(text, high + 1)
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text)
    made = F.when(F.col("form") != "plain", F.col("low").cast("long")), F.when(F.col("form") != "plain", (F.col("high") - F.col("low")).cast("long"))
    return found.select("doc_id", "text", "n", "form", made[0].alias("prefix_chars"), made[1].alias("middle_chars"), output.alias("output"))


def fill_in_middle_digest(docs: DataFrame) -> DataFrame:
    """The counts of every row, and the hashes of its output and of the text made from that again."""
    out = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    digest = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (back, "restored_sha256"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


ORACLE = f"""
with units as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{UNIT}') as u,
    sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (
  select *, len(u) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
    cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from units),
placed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 % 100 >= {RATE} then 'plain'
      when h4 % 100 < {SPM} then 'spm' else 'psm' end as form from drawn),
parts as (
  select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s from placed)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
    when 'spm' then '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m else text end) as output_sha256,
  sha256(text) as restored_sha256
from parts"""
