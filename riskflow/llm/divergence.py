"""Divergence of sources from each other and from their language (operator 11).

Terms are counted by (lang, source); a language keeps the terms that enough of
its documents hold.  With p = 1 + floor(scale (count + 1) / (N + V)), the
divergence of p from q over the kept terms is the sum of floor((p - q)^2 / q).

The counts become a term-major index: one row for each (lang, term) with the
sources that have it.  Rows of sources are then accumulated as in Gustavson's
sparse product: a group walks its own terms, and the index row of each is
scattered into a dense accumulator with one cell for each peer, so that no pair
of postings is ever emitted.  A term that is missing has count 0 and not p = 0;
so the scattered value is the correction

    f(pg, ph) - f(pg, base_h) - f(base_g, ph) + f(base_g, base_h)

and each pair gets its baseline once: the terms of g against base_h, those of
h against base_g, both from the number of terms by count, and base_g against
base_h for all other terms.  All of it is 64-bit integer arithmetic.

Scale: texts are counted in their splits and only (lang, term) rows with packed
counts are shuffled; the index is dealt by (lang, bucket of terms), the cells
by blocks of groups, so that neither a hot source nor a hot language nor many
sources fill a task.  The result itself has a row for each pair of sources of a
language.

Defined cases: null text, lang and source are ''; groups and languages without
terms keep their pair rows (0 where the language keeps no term); repeated rows
count each; very long texts are counted whole; ties of a rank go by the UTF-8
order of the item; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import give_back, partitions, settle
from riskflow.llm.terms import WORDS, split_texts

SCALE = 1_000_000_000
#: documents of its language that a kept term is in, at least; ranks of terms
LEAST, RANKS = 3, 200
#: counted (source, term) entries a task holds before it hands them on
HELD = 1_000_000
#: index entries in a bucket of terms, on average; accumulator cells of a task
ENTRIES, CELLS = 1_000_000, 4_000_000
#: index entries of a group's terms that are scattered at once
STEP = 250_000


def groups_of(docs: DataFrame) -> DataFrame:
    """lang, source, gid: every (lang, source), numbered within its language by source."""
    g = docs.select("lang", "source").distinct()
    return settle(g.withColumn("gid", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")), "groups")


def _count(batches):
    """lang, term, df, gs, ns: counts of the texts read so far, by (lang, term)."""
    counts, df, held = defaultdict(Counter), defaultdict(Counter), 0

    def hand_on():
        for lang, by_source in counts.items():
            rows = defaultdict(list)
            for gid, c in by_source.items():
                for term, n in c.items():
                    rows[term] += gid, n
            flat = np.fromiter((x for r in rows.values() for x in r), np.int64)
            ends = np.cumsum([0, *(len(r) // 2 for r in rows.values())]).astype("i4")
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(rows), pa.string()), pa.array(list(rows), pa.binary()).cast(pa.string()),
                 pa.array(list(map(df[lang].__getitem__, rows)), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[0::2].astype("i4"))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[1::2]))], names=["lang", "term", "df", "gs", "ns"])

    for b in batches:
        for lang, gid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), split_texts(b.column(2), WORDS)):
            c, terms = counts.setdefault(lang, defaultdict(Counter))[gid], set()
            held -= len(c)
            for words in text:
                c.update(words)
                terms.update(words)
            held += len(c)
            df[lang].update(terms)
            if held > HELD:
                yield from hand_on()
                counts.clear()
                df.clear()
                held = 0
    yield from hand_on()
    counts.clear()
    df.clear()
    give_back()


def _added(t: pa.Table, least: int) -> pa.Table:
    """One row for each (lang, term) of sorted rows, with sums by group; terms in fewer documents are left out."""
    t = t.combine_chunks()
    lang, term = t["lang"].combine_chunks(), t["term"].combine_chunks()
    new = np.ones(len(t), dtype=bool)
    new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    df = np.add.reduceat(t["df"].to_numpy(), first)
    kept = np.flatnonzero(df >= least)
    gs, ns = t["gs"].combine_chunks(), t["ns"].combine_chunks()
    row = np.repeat(np.cumsum(new) - 1, np.diff(gs.offsets.to_numpy()))
    g, n = gs.flatten().to_numpy(), ns.flatten().to_numpy()
    keep = (df >= least)[row]
    row, g, n = row[keep], g[keep], n[keep]
    if len(row):
        order = np.lexsort((g, row))
        row, g, n = row[order], g[order], n[order]
        one = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (g[1:] != g[:-1])])
        row, g, n = row[one], g[one], np.add.reduceat(n, one)
    ends, at = pa.array(np.searchsorted(row, [*kept, len(df)]).astype("i4")), pa.array(first[kept])
    return pa.table({"lang": lang.take(at), "term": term.take(at), "df": pa.array(df[kept]),
                     "gs": pa.ListArray.from_arrays(ends, pa.array(g.astype("i4"))), "ns": pa.ListArray.from_arrays(ends, pa.array(n.astype("i8")))})


def _merge(batches):
    """Index rows of rows sorted by (lang, term); those of the last term may go on in the next batch."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]).select(["lang", "term", "df", "gs", "ns"])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not len(t):
            continue
        last, low, high = (t["lang"][-1].as_py(), t["term"][-1].as_py()), 0, len(t) - 1
        while low < high:  # its first row, by halving
            mid = (low + high) // 2
            if (t["lang"][mid].as_py(), t["term"][mid].as_py()) == last:
                high = mid
            else:
                low = mid + 1
        if low:
            yield from _added(t.slice(0, low), LEAST).drop_columns(["df"]).to_batches()
        rest = _added(t.slice(low), 0)
    if rest is not None:
        yield from _added(rest, LEAST).drop_columns(["df"]).to_batches()


def term_index(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, term, gs, ns: the groups of every kept term, ascending, and their counts."""
    d = docs.join(groups, ["lang", "source"]).select("lang", "gid", "text")
    counted = d.mapInArrow(_count, "lang string, term string, df long, gs array<int>, ns array<long>")
    counted = counted.withColumn("_h", F.xxhash64("lang", "term"))
    spread = counted.repartition(partitions(docs.sparkSession), "_h").sortWithinPartitions("_h", "lang", "term")
    return settle(spread.drop("_h").mapInArrow(_merge, "lang string, term string, gs array<int>, ns array<long>"), "index")


def _profile(batches):
    """lang, gid, c, terms: how many terms of its part of the index a group has with each count."""
    for b in batches:
        lang = b.column(0).dictionary_encode()
        gs, ns = b.column(1), b.column(2)
        code = np.repeat(lang.indices.to_numpy(), np.diff(gs.offsets.to_numpy()))
        cells = np.stack([code.astype("i8"), gs.flatten().to_numpy().astype("i8"), ns.flatten().to_numpy()])
        if cells.size:
            order = np.lexsort(cells)
            cells = cells[:, order]
            one = np.flatnonzero(np.r_[True, (cells[:, 1:] != cells[:, :-1]).any(axis=0)])
            many = np.diff(np.r_[one, cells.shape[1]])
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(cells[0, one])), pa.array(cells[1, one].astype("i4")),
                                              pa.array(cells[2, one]), pa.array(many)], names=["lang", "gid", "c", "terms"])


def _f(p, q):
    return (p - q) * (p - q) // q


def _p(count, total):
    return 1 + SCALE * (count + 1) // total


def _whole(column: pa.ChunkedArray) -> pa.Array:
    """A column of combined chunks as one array."""
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _found(lang: str, gid: int, peer: np.ndarray, term: pa.Array | None, value: np.ndarray) -> pa.Table:
    m = len(value)
    return pa.table({"lang": pa.array([lang] * m, pa.string()), "gid": pa.array(np.full(m, gid, "i4")), "peer": pa.array(peer.astype("i4")),
                     "term": pa.nulls(m, pa.string()) if term is None else term.cast(pa.string()), "value": pa.array(value)})


def _scatter(index: pa.Table, peers: pa.Table) -> pa.Table:
    """Partial pair values and leading terms of a block of groups, over one bucket of a language's terms."""
    give_back()
    peers, index = peers.sort_by("gid").combine_chunks(), index.combine_chunks()
    lang, bucket, v, lang_n = (peers[c][0].as_py() for c in ("lang", "bucket", "v", "lang_n"))
    total = np.maximum(peers["n"].to_numpy() + v, 1)  # no kept term: nothing is divided
    base, lang_total, here = _p(0, total), lang_n + v, peers["gid"].to_numpy()
    mine = np.flatnonzero(peers["mine"].to_numpy())
    terms_of, gs, ns = (_whole(index[c]) for c in ("term", "gs", "ns"))
    g, n = gs.flatten().to_numpy(), ns.flatten().to_numpy()
    sizes = np.diff(gs.offsets.to_numpy()).astype("i8")
    ends = np.cumsum(sizes)
    starts, term = ends - sizes, np.repeat(np.arange(len(sizes), dtype="i4"), sizes)
    p = _p(n, total[g])
    whole = _p(np.add.reduceat(n, starts), lang_total) if len(sizes) else np.empty(0, np.int64)
    rank = pc.rank(terms_of).to_numpy()  # in UTF-8 order
    of_group = np.argsort(g, kind="stable")
    bounds = np.searchsorted(g[of_group], np.arange(len(peers) + 1))
    first = bucket == 0 and v > 0  # the baseline of every pair is added once
    if first:
        many, at_count = ([np.array(x.as_py(), dtype=np.int64) for x in peers[c]] for c in ("ts", "cs"))
        at_count = [_p(c, t) for c, t in zip(at_count, total)]
        terms, flat = np.array([t.sum() for t in many]), np.repeat(np.arange(len(peers)), [len(t) for t in many])
        flat_p, flat_many = np.concatenate(at_count), np.concatenate(many)
    out = [_found(lang, 0, here[:0], None, base[:0])]
    for i in mine:
        acc = np.zeros(len(peers), dtype=np.int64)
        own = of_group[bounds[i]:bounds[i + 1]]
        if len(own):
            t, pi = term[own], p[own]
            step = np.cumsum(sizes[t]) // STEP
            cuts = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1), len(t)]
            for x, y in zip(cuts, cuts[1:]):
                each = sizes[t[x:y]]
                at = np.repeat(starts[t[x:y]] - (np.cumsum(each) - each), each) + np.arange(each.sum())  # the index rows of the group's terms
                h, pg, ph = g[at], np.repeat(pi[x:y], each), p[at]
                np.add.at(acc, h, _f(pg, ph) - _f(pg, base[h]) - _f(base[i], ph) + _f(base[i], base[h]))
            value, q = _f(pi, whole[t]), whole[t]
            more = np.flatnonzero(pi > q)
            lead = more[np.lexsort((rank[t[more]], -value[more]))[:RANKS]]
            out.append(_found(lang, i, np.full(len(lead), -1), terms_of.take(pa.array(t[lead])), value[lead]))
        if first:
            for k in range(0, len(many[i]), 64):
                acc += (_f(at_count[i][k:k + 64, None], base) * many[i][k:k + 64, None]).sum(axis=0)
            np.add.at(acc, flat, _f(base[i], flat_p) * flat_many)
            acc += (v - terms[i] - terms) * _f(base[i], base)
        out.append(_found(lang, i, here[here != i], None, acc[here != i]))
    return pa.concat_tables(out)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    groups = groups_of(docs)
    index = term_index(docs, groups)

    counts = index.select("lang", "gs", "ns").mapInArrow(_profile, "lang string, gid int, c long, terms long")
    counts = counts.groupBy("lang", "gid", "c").agg(F.sum("terms").alias("terms"))
    own = counts.groupBy("lang", "gid").agg(F.sum(F.col("c") * F.col("terms")).alias("n"), F.sum("terms").alias("terms"),
                                           F.collect_list("c").alias("cs"), F.collect_list("terms").alias("ts"))
    langs = index.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    none = F.array().cast("array<long>")
    peers = groups.join(own, ["lang", "gid"], "left").join(langs, "lang", "left").fillna(0, ["n", "terms", "v"]) \
        .withColumns({"cs": F.coalesce("cs", none), "ts": F.coalesce("ts", none)})
    peers = settle(peers, "peers")
    sizes = peers.groupBy("lang").agg(
        F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("peers"),
        F.greatest(F.lit(1), F.ceil(F.sum("terms") / F.lit(ENTRIES))).cast("int").alias("buckets"))
    sizes = settle(sizes.withColumn("per_block", F.greatest(F.lit(1), F.lit(CELLS) / F.col("peers")).cast("int"))
                   .withColumn("blocks", F.ceil(F.col("peers") / F.col("per_block")).cast("int")), "languages")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    rows = index.join(sizes, "lang").withColumn("bucket", F.pmod(F.xxhash64("term", F.lit(7)), F.col("buckets")).cast("int")) \
        .withColumn("block", each("blocks")).select("lang", "bucket", "block", "term", "gs", "ns")
    seats = peers.join(sizes, "lang").withColumn("bucket", each("buckets")).withColumn("block", each("blocks")) \
        .withColumn("mine", F.floor(F.col("gid") / F.col("per_block")) == F.col("block")) \
        .select("lang", "bucket", "block", "gid", "mine", "n", "v", "lang_n",
                *(F.when(F.col("bucket") == 0, F.col(c)).alias(c) for c in ("cs", "ts")))
    key = ["lang", "bucket", "block"]
    found = settle(rows.groupBy(*key).cogroup(seats.groupBy(*key))
                   .applyInArrow(_scatter, "lang string, gid int, peer int, term string, value long"), "divergence")

    pairs = found.filter("peer >= 0").groupBy("lang", "gid", "peer").agg(F.sum("value").alias("value"))
    names = groups.select("lang", F.col("gid").alias("peer"), F.col("source").alias("item"))
    pairs = pairs.join(names, ["lang", "peer"]).select("lang", "gid", F.lit("pair").alias("part"), "item", "value")
    terms = found.filter("peer < 0").select("lang", "gid", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    by_value = Window.partitionBy("lang", "gid").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(by_value)) \
        .unionByName(terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= RANKS))
    return ranked.join(groups, ["lang", "gid"]).select("lang", "source", "part", "item", "value", "rank")
