"""Near duplicates: an inverted join on the coordinates of MinHash signatures, confirmed on full shingle sets."""
from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tapeworks.llm.common import keep_rows, row_key
from tapeworks.llm.words import mixed, release, shingles, text_chunks, word_hashes
from tapeworks.session import discard, materialise

COORDINATES = 64
MAP_BITS = 26  # a bit map of hashes has 2^26 bits (8 MB) at most
SLICE = 16  # coordinates whose values are counted by one aggregate
SKETCH = "n_shingles long, low long, high long, sig array<int>"
STAR = 4  # of its rarest coordinates, so many give a document a pair in the first round
BLOCK = 512  # members of a posting that are compared at once
SMALL = 1 << 20  # rows of 8 to 16 bytes that may be sent to every executor
_SALT = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def match_threshold(percent: int, coordinates: int = COORDINATES, miss: float = 1e-5) -> int:
    """The number of matches that a pair of the wanted similarity falls short of with chance ``miss`` at most."""
    p, below = percent / 100, 0.0
    for m in range(coordinates + 1):
        below += math.comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)
        if below > miss:
            return max(2, m)
    return coordinates


def _sketch(texts: pa.Array) -> pa.Array:
    counts, low, high, sigs, empty = [], [], [], [], []
    for _, raw, off in text_chunks(texts):
        s, per = shingles(*word_hashes(raw, off))
        full = np.flatnonzero(per)
        sig = np.zeros((len(per), COORDINATES), np.int32)
        n, a, b = np.zeros((3, len(per)), np.int64)
        if len(full):
            at = np.concatenate(([0], np.cumsum(per[full])[:-1]))
            for k in range(COORDINATES):
                sig[full, k] = (np.minimum.reduceat(s * _SALT[k], at) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            for d, start in zip(full, at):
                u = np.unique(s[start:start + per[d]])
                n[d] = len(u)
                a[d], b[d] = (x.view(np.int64) for x in (u.sum(dtype=np.uint64), mixed(u).sum(dtype=np.uint64)))
        counts.append(n), low.append(a), high.append(b), sigs.append(sig), empty.append(n == 0)
    flat = np.concatenate(sigs).ravel() if sigs else np.zeros(0, np.int32)
    rows = len(flat) // COORDINATES
    sig = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * COORDINATES), pa.array(flat))
    cat = lambda xs: pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64))
    release()
    return pa.StructArray.from_arrays([cat(counts), cat(low), cat(high), sig], ["n_shingles", "low", "high", "sig"])


def _shingle_set(texts: pa.Array) -> pa.Array:
    sizes, values = [0], []
    for _, raw, off in text_chunks(texts):
        s, per = shingles(*word_hashes(raw, off))
        end = np.cumsum(per)
        for d in range(len(per)):
            u = np.unique(s[end[d] - per[d]:end[d]])
            sizes.append(len(u)), values.append(u.view(np.int64))
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    release()
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, raw, n_shingles, low, high, sig): set size, a 128-bit digest of the set, and its MinHash values."""
    d = docs.select("doc_id", row_key().alias("raw"), arrow_udf(_sketch, SKETCH)("text").alias("s"))
    return materialise(d.select("doc_id", "raw", "s.*"))


def representatives(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, nodes). A class holds the documents with one shingle set; its node is the smallest doc_id."""
    real = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("node"),
                                                           F.min(F.struct("doc_id", "raw", "sig")).alias("m"))
    classes = materialise(classes.select("low", "high", "n_shingles", "node", F.col("m.raw").alias("raw"),
                                         F.col("m.sig").alias("sig")))
    return classes.select("low", "high", "n_shingles", "node"), classes.select("node", "low", "raw", "n_shingles", "sig")


def _bit_map(keys: DataFrame) -> tuple[DataFrame, int]:
    """((word, bits), number of bits): a bit for every 64-bit hash in ``keys`` (its only column), by its low bits.

    Above MAP_BITS it grows no more and lets more others pass; what it lets pass still has to meet ``keys`` in a join.
    """
    bits = max(16, min(MAP_BITS, (32 * keys.count()).bit_length()))
    one = F.expr(f"shiftleft(1L, cast(`{keys.columns[0]}` & 63L AS int))")
    return keys.groupBy(_word(F.col(keys.columns[0]), bits).alias("word")).agg(F.bit_or(one).alias("bits")), bits


def _word(h: Column, bits: int) -> Column:
    return F.shiftright(h.bitwiseAND(F.lit((1 << bits) - 1)), 6)


def _may_hold(keys: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Tells which hashes may be among ``keys``: all that are, and few others. The map goes to every executor."""
    words, bits = _bit_map(keys)
    rows = words.toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    sent = keys.sparkSession.sparkContext.broadcast(table)

    def held(h: np.ndarray) -> np.ndarray:
        at = h & np.int64((1 << bits) - 1)
        return (sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
    return held


def rare_prefix(nodes: DataFrame, matches: int) -> DataFrame:
    """(node, low, raw, n_shingles, sig, tokens) of nodes that may have a partner: their rarest shared coordinates, the
    rarest first; written once.

    Two signatures with ``matches`` common values share one among any K - matches + 1 coordinates if both take them
    by one global order. The order is by exact frequency, so the long postings come last and are skipped. Coordinates
    of one node alone come first and lead nowhere; a node with fewer than ``matches`` others has no partner.
    """
    token = lambda k: F.xxhash64(F.lit(k), F.col("sig")[k])
    d = nodes.withColumn("tokens", F.array(*(token(k) for k in range(COORDINATES))))
    # the values of a coordinate are its own, so slices count apart, each in a smaller table of its task
    parts = [d.select(F.explode(F.slice("tokens", k + 1, SLICE)).alias("token")).groupBy("token").agg(F.count("*").cast("int").alias("n"))
             for k in range(0, COORDINATES, SLICE)]
    common = materialise(reduce(DataFrame.unionAll, parts).where("n > 1"))
    held = _may_hold(common.select("token"))

    @arrow_udf("array<long>")
    def shared(lists: pa.Array) -> pa.Array:
        t = lists.flatten().to_numpy()
        ok = held(t)
        ends = np.concatenate(([0], np.cumsum(ok.reshape(-1, COORDINATES).sum(1))))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(t[ok]))

    some = materialise(d.withColumn("tokens", shared("tokens")).where(F.size("tokens") >= matches))
    ranked = (some.select("node", "low", F.explode("tokens").alias("token")).join(common, "token")
              .groupBy("node", "low").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t")))
    short = ranked.where(F.size("t") >= matches).select(
        "node", "low", F.slice(F.col("t.token"), F.lit(1), F.size("t") - (matches - 1)).alias("tokens"))
    out = materialise(some.drop("tokens").join(short, ["node", "low"]))
    discard(common), discard(some)
    return out


def _few(rows: DataFrame) -> DataFrame:
    """A written table of few short rows goes to every executor; a longer one is left to the planner."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def _matches(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _pair(a: str, b: str) -> list[Column]:
    """The two nodes of a pair with their set keys, the smaller first."""
    x, y = F.struct(F.col(f"{a}.node"), F.col(f"{a}.low")), F.struct(F.col(f"{b}.node"), F.col(f"{b}.low"))
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, matches: int) -> DataFrame:
    """Pairs (a, b: struct<node, low>) that collide often enough and whose full sets are similar enough."""
    pairs = pairs.distinct()
    sig = nodes.select(F.struct("node", "low").alias("key"), "sig", "raw")
    counted = (pairs.join(sig.select(F.col("key").alias("a"), F.col("sig").alias("sa"), F.col("raw").alias("ra")), "a")
               .join(sig.select(F.col("key").alias("b"), F.col("sig").alias("sb"), F.col("raw").alias("rb")), "b")
               .where(_matches(F.col("sa"), F.col("sb")) >= matches).select("a", "b", "ra", "rb"))
    counted = materialise(counted)
    wanted = materialise(counted.select(F.col("a").alias("k"), F.col("ra").alias("raw"))
                         .union(counted.select("b", "rb")).distinct()
                         .select("k", F.col("k.node").alias("__id"), F.col("raw").alias("__raw")))
    sets = _sets(docs, wanted)
    both = (counted.select("a", "b").join(sets.select(F.col("k").alias("a"), F.col("s").alias("x")), "a")
            .join(sets.select(F.col("k").alias("b"), F.col("s").alias("y")), "b")
            .withColumn("common", F.size(F.array_intersect("x", "y")))
            .where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))))
    links = materialise(both.select("a", "b"))
    for used in (counted, wanted, sets):
        discard(used)
    return links


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, s): the full shingle set of each wanted row (k, __id, __raw), from its whole text.

    A bit map of the wanted identifiers keeps other texts out of the shuffle.
    """
    words, bits = _bit_map(wanted.select(F.xxhash64("__id").alias("h")))
    d = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).join(F.broadcast(words), _word(F.col("h"), bits) == F.col("word"))
    d = d.where("(shiftright(bits, cast(h & 63L AS int)) & 1L) = 1")
    texts = d.select("doc_id", row_key().alias("raw"), "text").groupBy("doc_id", "raw").agg(F.first("text").alias("text"))
    one = texts.join(wanted, (F.col("doc_id") == F.col("__id")) & (F.col("raw") == F.col("__raw")))
    return materialise(one.select("k", arrow_udf(_shingle_set, "array<long>")("text").alias("s")))


def components(links: DataFrame) -> DataFrame:
    """(node, component): connected components of (u, v) links; component is the smallest node.

    Alternates two contractions, each of which points nodes at a smaller neighbour, until nothing changes; every
    round is written, and a node of any degree is only ever aggregated and joined.
    """
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .where("u <> v").distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                                F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges, before = materialise(small.select("e.*").where("u <> v").distinct()), edges
        discard(before)


def near_links(docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, component) over the links between different shingle sets, without making all pairs of a group.

    1. The postings of each document's rarest coordinates pair their members with their smallest one. What these
       links join needs no more pairs: from here on only postings count that hold several components.
    2. Members of such postings are compared inside tasks, block against block, and no pair leaves a task: first
       their signatures, which tells who has a partner in another component, then the full sets of those.
    """
    matches = match_threshold(percent)
    near = 100 * F.least("l.n_shingles", "r.n_shingles") >= percent * F.greatest("l.n_shingles", "r.n_shingles")
    prefix = rare_prefix(nodes, matches)
    posts = prefix.select("node", "low", "n_shingles", F.posexplode("tokens").alias("place", "token"))
    first = posts.where(F.col("place") < STAR)
    heads = (first.groupBy("token").agg(F.min(F.struct("node", "low", "n_shingles")).alias("head"),
                                        F.count("*").alias("members")).where("members > 1"))
    l, r = first.alias("l"), heads.select("token", "head.*").alias("r")
    star = l.join(r, (F.col("l.token") == F.col("r.token")) & (F.col("l.low") != F.col("r.low")) & near).select(*_pair("l", "r"))
    links = confirmed(star, prefix, docs, percent, matches)
    joined = components(_node_links(links))
    held = _unsettled(posts.select("token", "node", "low", "n_shingles"), joined)
    if not held.isEmpty():
        blocks = _blocks(held)
        carried = prefix.select("node", "low", "raw", "sig", "tokens")
        more = _block_links(blocks, carried, docs, percent, matches)
        settled = components(_node_links(links.union(more)))
        for used in (blocks, more, joined):
            discard(used)
        joined = settled
    for used in (prefix, links, held):
        discard(used)
    return joined


def _blocks(held: DataFrame) -> DataFrame:
    """Members of postings with the task group they meet in: (gate, i, j), where ``block`` is i or j.

    Small postings share a gate by hash. A large posting is cut into blocks, and every two of its blocks meet in a
    group of their own, so no group outgrows two blocks.
    """
    sizes = held.groupBy("token").agg(F.count("*").alias("members"))
    d = held.join(sizes, "token").withColumn("parts", F.ceil(F.col("members") / BLOCK).cast("int"))
    gates = F.lit(-(-held.count() // (2 * BLOCK)) or 1)
    d = d.withColumn("block", F.pmod(F.xxhash64("low"), F.col("parts")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    gate = F.when(F.col("parts") == 1, F.pmod(F.col("token"), gates)).otherwise(F.col("token"))
    return materialise(d.select("token", "node", "low", "n_shingles", "component", "block", gate.alias("gate"),
                                F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))


def _alike(p: pd.DataFrame, percent: int, matches: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (per posting) of different components whose signatures collide often enough, each pair only in
    the posting of the rarest coordinate it shares."""
    low, n, comp = (p[c].to_numpy() for c in ("low", "n_shingles", "component"))
    token, block, i, j = (p[c].to_numpy() for c in ("token", "block", "i", "j"))
    sig = np.stack(p["sig"].to_numpy())
    size = p["tokens"].str.len().to_numpy()
    real = np.arange(size.max()) < size[:, None]
    tokens = np.zeros(real.shape, np.int64)
    tokens[real] = np.concatenate(p["tokens"].to_numpy())
    order = np.argsort(token, kind="stable")
    out = []
    for rows in np.split(order, np.flatnonzero(np.diff(token[order])) + 1):
        same = i[rows[0]] == j[rows[0]]
        x = rows if same else rows[block[rows] == i[rows[0]]]
        y = rows if same else rows[block[rows] == j[rows[0]]]
        ok = comp[x][:, None] != comp[y]
        ok &= 100 * np.minimum(n[x][:, None], n[y]) >= percent * np.maximum(n[x][:, None], n[y])
        if same:
            ok &= low[x][:, None] < low[y]
        a, b = np.nonzero(ok)
        a, b = x[a], y[b]
        for k in range(0, len(a), 1 << 14):
            u, v = a[k:k + (1 << 14)], b[k:k + (1 << 14)]
            good = (sig[u] == sig[v]).sum(1) >= matches
            u, v = u[good], v[good]
            if len(u):
                # the order of coordinates is one for all, so the first common one of either list is the rarest
                common = ((tokens[u][:, :, None] == tokens[v][:, None, :]) & real[v][:, None, :]).any(2) & real[u]
                first = tokens[u, common.argmax(1)] == token[u]
                out.append((u[first], v[first]))
    return out


def _block_links(blocks: DataFrame, carried: DataFrame, docs: DataFrame, percent: int, matches: int) -> DataFrame:
    """Links (a, b) between components that meet in postings; enough of them to join what is linked.

    ``carried`` has signature and coordinates of each node; what the first comparison leaves gets them anew."""
    def partners(p: pd.DataFrame) -> pd.DataFrame:
        hit = [np.concatenate(pair) for pair in _alike(p, percent, matches)]
        rows = np.unique(np.concatenate(hit)) if hit else []
        return p.iloc[rows].drop(columns=["sig", "tokens"])

    def links(p: pd.DataFrame) -> pd.DataFrame:
        sets, comp = p["s"].to_numpy(), p["component"].to_numpy()
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        found = []
        for u, v in _alike(p, percent, matches):
            sizes = _common(sets, u, v)
            total = np.array([len(sets[k]) for k in u]) + np.array([len(sets[k]) for k in v])
            for k in np.flatnonzero(100 * sizes >= percent * (total - sizes)):
                x, y = top(comp[u[k]]), top(comp[v[k]])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    found.append((u[k], v[k]))
        a, b = (np.array([f[k] for f in found], int) for k in (0, 1))
        return pd.DataFrame({"an": p["node"].to_numpy()[a], "al": p["low"].to_numpy()[a], "bn": p["node"].to_numpy()[b],
                             "bl": p["low"].to_numpy()[b]})

    base = ("node long, low long, token long, n_shingles long, component long, block int, gate long, i int, j int, raw long")
    columns = [c.split()[0] for c in base.split(", ")]
    met = blocks.join(carried, ["node", "low"]).select(*columns, "sig", "tokens")
    needed = materialise(met.groupBy("gate", "i", "j").applyInPandas(partners, base))
    wanted = materialise(needed.select("node", "low", "raw").distinct().select(
        F.struct("node", "low").alias("k"), F.col("node").alias("__id"), F.col("raw").alias("__raw")))
    sets = _sets(docs, wanted).select("k.node", "k.low", "s")
    full = needed.join(carried.drop("raw"), ["node", "low"]).join(sets, ["node", "low"])
    got = full.groupBy("gate", "i", "j").applyInPandas(links, "an long, al long, bn long, bl long")
    found = materialise(got.select(F.struct(F.col("an").alias("node"), F.col("al").alias("low")).alias("a"),
                                   F.struct(F.col("bn").alias("node"), F.col("bl").alias("low")).alias("b")))
    for used in (needed, wanted, sets):
        discard(used)
    return found


def _common(sets: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Size of the intersection of the sets of each pair; many pairs of few documents go through a matrix product."""
    rows = np.unique(np.concatenate((u, v)))
    if len(u) < 2 * len(rows):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(u, v)], np.int64)
    lengths = [len(sets[k]) for k in rows]
    _, place, times = np.unique(np.concatenate([sets[k] for k in rows]), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[place]
    owner = np.repeat(np.arange(len(rows)), lengths)[column >= 0]
    column = column[column >= 0]
    both = np.zeros((len(rows), len(rows)), np.float32)
    for start in range(0, int(shared.sum()), 4096):
        part = (column >= start) & (column < start + 4096)
        m = np.zeros((len(rows), 4096), np.float32)
        m[owner[part], column[part] - start] = 1
        both += m @ m.T
    return both[np.searchsorted(rows, u), np.searchsorted(rows, v)].astype(np.int64)


def _unsettled(posts: DataFrame, joined: DataFrame) -> DataFrame:
    """Members of postings that hold several components: token, node, low, n_shingles, component."""
    named = posts.join(_few(joined), "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = materialise(named.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"))
                          .where("a <> b").select("token"))
    held = materialise(named.join(_few(several), "token", "left_semi"))
    discard(several)
    return held


def _node_links(links: DataFrame) -> DataFrame:
    return links.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def _marked(docs: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``near_duplicates`` and the written tables they are read from."""
    sigs = signatures(docs)
    classes, nodes = representatives(sigs)
    joined = near_links(docs, nodes, percent)
    label = classes.join(joined, "node", "left").select("low", "high", "n_shingles",
                                                        F.coalesce("component", "node").alias("component"))
    d = sigs.select("doc_id", "raw", "low", "high", "n_shingles").join(label, ["low", "high", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    d = d.select("doc_id", "raw", "n_shingles", component.alias("component_id"))
    marks = d.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return marks, [sigs, nodes, joined]


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, raw, n_shingles, component_id, kept), one row per row of ``docs``.

    Words are lower-cased (A-Z) runs without ASCII blanks; a document's set holds its distinct 5-word shingles, or
    its whole sequence when it is shorter. Two sets link when 100 * common >= percent * union, checked on the full
    sets. component_id is the smallest doc_id that links reach. Documents without words link with nothing. A null
    identifier links with nothing, has a null component and is kept. Rows that repeat an identifier with another text
    are judged each by its own text. An empty table gives no rows.
    """
    return _marked(docs, percent)[0]


def drop_near(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; all rows of the document that stays are kept."""
    marks, used = _marked(docs, percent)
    marks = materialise(marks.select("doc_id", "raw", "kept"))
    for table in used:
        discard(table)
    return keep_rows(docs, marks)
