"""Audit of how sources of a language differ in their terms, exact in whole numbers.

Terms are counted per document and added up per (lang, source) before any shuffle. A
term that few groups hold is light, others are heavy. The sum of |p - p'| over all kept
terms of two groups of a language is added up from

* what two groups without any term would differ by in all, and what each group's own
  light terms change in that, from the counts of its distinct values;
* what heavy terms change in that, from dense tiles: blocks of TILE_TERMS terms by blocks
  of TILE_GROUPS groups, subtracted row from row in numpy;
* corrections for light terms that both groups hold, from the postings of each term:
  fewer than `heavy` groups hold one.

A tile, a block of postings and a term's row are all bounded; partial sums are added up
per pair of groups. No table is collected.

Cases: null text, lang and source are read as ''; a document without terms still counts
its group; a language without kept terms has pairs of value 0 and no term rows; repeated
rows are documents of their own; texts of any length are counted whole; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import cut, discard, groups_for, map_arrow, narrow, small_batches, text_bytes

#: Documents of a language that hold a kept term, at least; what is added to each count; units of 1; ranks of part `term`.
LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Groups from which on a term is heavy.
HEAVY = 16
#: Terms and groups of a dense tile; postings of a block.
TILE_TERMS, TILE_GROUPS, POSTINGS = 2048, 256, 1 << 19
#: Distinct (group, term) counts that a worker holds before it hands them on.
HELD = 1 << 19
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: In UTF-8, the code points of a term are the ASCII letters and all that is written in bytes from 0x80 on.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): partial counts, added up within a worker's share of the documents."""
    small_batches(docs.sparkSession)
    names = ["lang", "source", "term", "count", "docs"]

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, holders) in held.items():
            terms = pa.array(list(counts), pa.binary()).cast(pa.string())
            columns = [pa.array([x] * len(counts), pa.string()) for x in (lang, source)]
            columns += [terms, pa.array(list(counts.values()), pa.int64()), pa.array([holders[t] for t in counts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), text_bytes(batch.column("text")), strict=True):
                counts, holders = held.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(_TERM.findall(text.translate(_LOWER)))
                counts.update(own)
                holders.update(own.keys())
            if sum(len(counts) for counts, _ in held.values()) > HELD:
                yield from rows(held)
                held = {}
        yield from rows(held)

    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return read.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def _share(count: str, total: str) -> F.Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), in decimals: counts times SCALE may pass 64 bits."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(20,0)) div cast({total} + {PRIOR} * kept as decimal(20,0))")


def shares(docs: DataFrame, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, kept, p0) and their terms (lang, source, term, p, q, heavy); p0 is the share of a term that a group does not hold."""
    counts = cut(term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("of_lang"), F.count("*").alias("groups"))
    kept = cut(kept.where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "of_lang", (F.col("groups") >= heavy).alias("heavy")))
    held = cut(counts.select("lang", "term", "source", "count").join(narrow(kept), ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("of_lang").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    none = F.lit(0).cast("long")
    groups = cut(groups.select("*", F.when(F.col("kept") > 0, _share("0", "total")).otherwise(none).alias("p0")))
    terms = held.join(narrow(groups), ["lang", "source"])
    terms = cut(terms.select("lang", "source", "term", "heavy", "p0", _share("count", "total").alias("p"), _share("of_lang", "lang_total").alias("q")))
    discard(counts, kept, held)
    return groups, terms


def _pairs_table(lang: str, sources: list[str], a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.Table:
    names = pa.array(sources, pa.string())
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": pa.array(value, pa.int64())})


_PAIRS = "lang string, a string, b string, value long"
_TILE = "term string, p long, weight long, kept long"


def _tile(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of one tile for each pair a < b of its groups, one of the first and one of the second block."""
    lang, _, low, high = (x.as_py() for x in key)
    marks = table.filter(pc.is_null(table["p"]))
    sources = marks["source"].to_pylist()
    order = sorted(range(len(sources)), key=lambda i: sources[i].encode())
    sources = [sources[i] for i in order]
    p0, kept, block = (marks[c].to_numpy()[order] for c in ("p0", "kept", "own"))
    place = {s: i for i, s in enumerate(sources)}
    rows = table.filter(pc.is_valid(table["p"]))
    who = np.array([place[s] for s in rows["source"].to_pylist()], np.int64)
    p = rows["p"].to_numpy()
    n = len(sources)
    sums = np.zeros((n, n), np.int64)
    bare = np.abs(p0[:, None] - p0[None, :])  # what two groups differ by in a term that neither holds
    if key[1].as_py() < 0:  # all terms as if no group held one, and what a group's own light ones change in that
        weight, by = rows["weight"].to_numpy(), np.argsort(who, kind="stable")
        ends = np.searchsorted(who[by], np.arange(n + 1))
        for i in range(n):
            own = by[ends[i] : ends[i + 1]]
            own = own[np.argsort(p[own])]
            x, w = p[own], weight[own]
            before, mass = np.concatenate(([0], np.cumsum(w))), np.concatenate(([0], np.cumsum(x * w)))
            at = np.searchsorted(x, p0)
            apart = p0 * before[at] - mass[at] + (mass[-1] - mass[at]) - p0 * (before[-1] - before[at])
            sums[i] = apart - before[-1] * bare[i]
        sums = sums + sums.T + kept[0] * bare
    else:
        terms, which = np.unique(np.array(rows["term"].to_pylist(), object), return_inverse=True)
        dense = np.repeat(p0[:, None], len(terms), axis=1)
        dense[who, which] = p
        for i in range(n):
            sums[i] = np.abs(dense - dense[i]).sum(axis=1) - len(terms) * bare[i]
    a, b = np.triu_indices(n, 1)
    if low != high:
        across = block[a] != block[b]
        a, b = a[across], b[across]
    return _pairs_table(lang, sources, a, b, sums[a, b])


def _postings(table: pa.Table) -> pa.Table:
    """What pairs of groups that both hold a light term differ from the sum of their own corrections, added up over a block of terms."""
    parts = []
    for lang in sorted(set(table["lang"].to_pylist()), key=str.encode):
        rows = table.filter(pc.equal(table["lang"], lang))
        sources = sorted(set(rows["source"].to_pylist()), key=str.encode)
        place = {s: i for i, s in enumerate(sources)}
        who = np.array([place[s] for s in rows["source"].to_pylist()], np.int64)
        _, which = np.unique(np.array(rows["term"].to_pylist(), object), return_inverse=True)
        order = np.lexsort((who, which))
        who, which, p, p0 = who[order], which[order], rows["p"].to_numpy()[order], rows["p0"].to_numpy()[order]
        codes, values = [], []
        for step in range(1, len(which)):
            i = np.flatnonzero(which[step:] == which[:-step])
            if not len(i):  # no term has this many postings
                break
            j = i + step
            codes.append(who[i] * len(sources) + who[j])
            values.append(np.abs(p[i] - p[j]) - np.abs(p[i] - p0[j]) - np.abs(p0[i] - p[j]) + np.abs(p0[i] - p0[j]))
        if not codes:
            continue
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, at, np.concatenate(values))
        parts.append(_pairs_table(lang, sources, code // len(sources), code % len(sources), total))
    return pa.concat_tables(parts) if parts else _pairs_table("", [], *(np.zeros(0, np.int64),) * 3)


def pair_sums(groups: DataFrame, terms: DataFrame, tile_terms: int = TILE_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """(lang, a, b, value) of each two sources a < b of a language: the sum of |p - p'| over all kept terms."""
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // tile_groups))
    bounds = terms.groupBy("lang").agg(F.count_distinct(F.when(F.col("heavy"), F.col("term"))).alias("heavy"), F.count(F.when(~F.col("heavy"), 1)).alias("light"))
    heavy, light = bounds.agg(F.max("heavy"), F.sum("light")).first()
    tiles = max(1, -(-(heavy or 0) // tile_terms))
    own = F.pmod(F.xxhash64("source"), F.lit(blocks)).alias("own")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.struct(F.least(x, "own").alias("low"), F.greatest(x, "own").alias("high")))).alias("at")

    def spread(rows: DataFrame) -> DataFrame:
        """Each row in all tiles that pair its block of groups with another one, or with itself."""
        return rows.select("*", own).select("*", pair).select("lang", "tile", F.col("at.low").alias("low"), F.col("at.high").alias("high"), "own", "source", "p0", "term", "p", "weight", "kept")

    null = [F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in _TILE.split(", "))]
    ones = F.lit(1).cast("long").alias("weight")
    whole = groups.select("lang", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile"), "source", "p0", *null[:3], "kept")
    dense = terms.where("heavy").select("lang", F.pmod(F.xxhash64("term"), F.lit(tiles)).alias("tile"), "source", "p0", "term", "p", ones, null[3])
    few = terms.where("not heavy").groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("weight"))
    few = few.select("lang", F.lit(-1).cast("long").alias("tile"), "source", "p0", null[0], "p", "weight", null[3])
    rows = spread(whole).unionByName(spread(dense)).unionByName(spread(few))
    sums = rows.groupBy("lang", "tile", "low", "high").applyInArrow(_tile, _PAIRS)
    shards = max(1, -(-(light or 0) // POSTINGS))
    posted = terms.where("not heavy").select("lang", "source", "term", "p", "p0", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).alias("shard"))
    posted = posted.groupBy("shard").applyInArrow(lambda t: _postings(t.drop_columns(["shard"])), _PAIRS)
    return sums.unionByName(posted).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, heavy: int = HEAVY, tile_terms: int = TILE_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank of every group."""
    groups, terms = shares(docs, heavy)
    pairs = cut(pair_sums(groups, terms, tile_terms, tile_groups))
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    rank = F.row_number().over(ranked).cast("int").alias("rank")
    above = terms.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), rank)
    return part(both, "pair").unionByName(part(above, "term").where(F.col("rank") <= TOP))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
words as (select d, lang, source, unnest(w) as term from docs),
counts as (select lang, source, term, count(*) as n from words group by all),
kept as (select lang, term from words group by all having count(distinct d) >= {LEAST_DOCS}),
sizes as (select lang, count(*) as v from kept group by all),
groups as (
  select g.lang, g.source, coalesce(v, 0) as v, coalesce(sum(n), 0) as total
  from (select distinct lang, source from docs) g left join sizes using (lang)
    left join (select c.* from counts c join kept using (lang, term)) k using (lang, source) group by all),
langs as (select lang, sum(total) as total from groups group by all),
grid as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + {PRIOR})) // (g.total + {PRIOR} * g.v) as p
  from groups g join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
whole as (
  select k.lang, k.term, 1 + ({SCALE}::hugeint * (sum(c.n) + {PRIOR})) // (any_value(l.total) + {PRIOR} * any_value(s.v)) as q
  from kept k join counts c using (lang, term) join langs l using (lang) join sizes s using (lang) group by all),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from grid a join grid b using (lang, term) where a.source <> b.source group by all),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
term as (select lang, source, 'term' as part, term as item, p - q as value from grid join whole using (lang, term) where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from term))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= {TOP}"""
