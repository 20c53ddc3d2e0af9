"""Recurring lines: a fixed-depth template tree over token counts and leading tokens."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tapeworks.llm.common import row_key, whole_text
from tapeworks.llm.words import mixed, text_chunks, word_bounds, word_hashes
from tapeworks.session import materialise

LEAD = 3  # most leading tokens on the path to a leaf; shorter lines have a third of their tokens there, at least one
LEAST_DOCS = 2  # documents that make a line recurring; one more where a token is a variable field
OPEN_TOKENS = 4  # lines from this length on may have open positions
FIXED = (2, 3)  # least share of fixed tokens in a template with open positions
LEAF_BITS = 25  # size of the map of wanted leaves, as a power of two: 4 MB; it only spares shuffling, joins decide
_STEP, _VARIABLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)
_FIELD = np.zeros(256, bool)
_FIELD[[*range(48, 58), 64]] = True  # digits and @


def _parsed(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Every line with tokens: text, line, leaf (token count and leading tokens), key (all tokens), field, and its tokens.

    Tokens with a digit or an @ are variable fields; all of them count as one token, 0 in ``tokens``.
    """
    starts, counts = word_bounds(raw, off)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return dict(doc=none, line=none, at=none, size=none, lead=none, leaf=none, key=none, field=none.astype(bool), tokens=none)
    h, _ = word_hashes(raw, off)
    varies = np.add.reduceat(_FIELD[raw].astype(np.int32), starts) > 0
    h = np.where(varies, _VARIABLE, h)
    breaks = np.flatnonzero(raw == 10)
    owner = np.repeat(np.arange(len(counts)), counts)
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, off[owner])
    n = len(h)
    new = np.ones(n, bool)
    new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, n))
    place = np.arange(n) - np.repeat(at, size)
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(h + place.astype(np.uint64) * _STEP), dtype=np.uint64)))
    lead = np.clip(size // 3, 1, LEAD)
    path = size.astype(np.uint64) * _VARIABLE
    return dict(doc=owner[at], line=line[at], at=at, size=size, lead=lead, leaf=mixed(upto[at + lead] - upto[at] + path).view(np.int64),
                key=mixed(upto[at + size] - upto[at] + path + np.uint64(1)).view(np.int64),
                field=np.add.reduceat(varies.astype(np.int32), at) > 0,
                tokens=np.where(varies, 0, (h >> np.uint64(33)).astype(np.int32) + 1))


def _structs(texts: pa.Array, rows) -> pa.Array:
    """One list of structs per text; ``rows`` makes (text numbers, struct columns) of a stretch of texts."""
    sizes, parts = [np.zeros(1, np.int64)], []
    for _, raw, off in text_chunks(texts):
        doc, made = rows(raw, off)
        sizes.append(np.bincount(doc, minlength=len(off) - 1))
        parts.append(made)
    if not parts:
        parts.append(rows(np.zeros(0, np.uint8), np.zeros(1, np.int64))[1])
    ends = np.cumsum(np.concatenate(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(parts))


def _line_rows(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    x = _parsed(raw, off)
    order = np.lexsort((x["line"], x["key"], x["doc"]))
    doc, key = x["doc"][order], x["key"][order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return doc, pa.StructArray.from_arrays(
        [pa.array(x["line"][order].astype(np.int32)), pa.array(key), pa.array(x["leaf"][order]),
         pa.array(x["size"][order].astype(np.int32)), pa.array(x["field"][order]), pa.array(fresh)],
        ["line", "key", "leaf", "size", "field", "fresh"])


def _leaf_map(wanted: DataFrame) -> np.ndarray:
    """A bit for every leaf of ``wanted``; leaves of equal low bits share one."""
    slot = F.col("leaf").bitwiseAND(F.lit((1 << LEAF_BITS) - 1))
    one = F.expr("shiftleft(1L, cast(leaf & 63L AS int))")
    rows = wanted.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (LEAF_BITS - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _token_rows(raw: np.ndarray, off: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Tokens below the leaf, of lines with a bit in the map of leaves."""
    x = _parsed(raw, off)
    slot = x["leaf"] & np.int64((1 << LEAF_BITS) - 1)
    held = (leaves[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
    take = np.flatnonzero((x["size"] >= OPEN_TOKENS) & (held > 0))
    first, rest = x["at"][take] + x["lead"][take], (x["size"] - x["lead"])[take]
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(rest)))
    spots = np.arange(ends[-1]) + np.repeat(first - ends[:-1], rest)
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x["tokens"][spots].astype(np.int32)))
    return x["doc"][take], pa.StructArray.from_arrays(
        [pa.array(x["key"][take]), pa.array(x["lead"][take].astype(np.int32)), lists], ["key", "lead", "tokens"])


def _lines(texts: pa.Array) -> pa.Array:
    return _structs(texts, _line_rows)


def _token_reader(leaves: Broadcast):
    def tokens(texts: pa.Array) -> pa.Array:
        return _structs(texts, lambda raw, off: _token_rows(raw, off, leaves.value))
    return tokens


def open_templates(docs: DataFrame, lines: DataFrame, least_docs: int) -> DataFrame:
    """(key, owner) of lines that recur once positions of their leaf are left open.

    ``lines`` are the distinct lines (leaf, key, size, n, owner). Values are counted per position of a leaf. One
    template of a line keeps the values that ``least_docs`` documents have there, the other those of at least half
    of the leaf's documents; both need a share FIXED of fixed tokens, fields not among them.
    """
    leaves = (lines.where(F.col("size") >= OPEN_TOKENS).groupBy("leaf").agg(F.sum("n").alias("docs"), F.count("*").alias("kinds"))
              .where((F.col("docs") >= least_docs) & (F.col("kinds") > 1)).select("leaf", "docs"))
    wanted = materialise(lines.join(leaves, "leaf"))
    kind = "array<struct<key:long,lead:int,tokens:array<int>>>"
    tokens = _token_reader(docs.sparkSession.sparkContext.broadcast(_leaf_map(wanted)))
    read = docs.select("doc_id", F.explode(arrow_udf(tokens, kind)("text")).alias("x")).select("doc_id", "x.*")
    same = (read["key"] == wanted["key"]) & read["doc_id"].eqNullSafe(wanted["owner"])
    held = read.join(wanted, same).select(wanted["key"], "leaf", "size", "n", "owner", "docs", "lead", "tokens")
    held = materialise(held.groupBy("key").agg(*(F.first(c).alias(c) for c in ("leaf", "size", "n", "owner", "docs", "lead", "tokens"))))
    spots = held.select("key", "leaf", "docs", "n", F.posexplode("tokens").alias("pos", "tok"))
    often = (spots.groupBy("leaf", "pos", "tok", "docs").agg(F.sum("n").alias("s")).where(F.col("s") >= least_docs)
             .select("leaf", "pos", "tok", (2 * F.col("s") >= F.col("docs")).alias("main")))
    found = spots.join(often, ["leaf", "pos", "tok"])
    one = F.xxhash64("pos", "tok")
    sides = {"a": F.lit(True), "b": F.col("main")}
    shape = found.groupBy("key").agg(*(f for k, c in sides.items() for f in (
        F.count(F.when(c & (F.col("tok") != 0), 1)).alias(f"fixed_{k}"), F.bit_xor(F.when(c, one)).alias(f"hash_{k}"))))
    few, of = FIXED
    enough = lambda k: of * (F.col("lead") + F.col(f"fixed_{k}")) >= few * F.col("size")
    keys = F.array_distinct(F.array_compact(F.array(*(F.when(enough(k), F.xxhash64("leaf", f"hash_{k}")) for k in sides))))
    each = materialise(held.join(shape, "key").select("key", "n", "owner", F.explode(keys).alias("shape")))
    good = (each.groupBy("shape").agg(F.sum("n").alias("docs"), F.count("*").alias("kinds"), F.min("owner").alias("first"))
            .where((F.col("docs") >= least_docs) & (F.col("kinds") > 1)).select("shape", "first"))
    return each.join(good, "shape").groupBy("key").agg(F.min("first").alias("owner"))


def recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, raw, gone: sorted line numbers from 0) for documents with lines to be dropped.

    A line recurs when ``least_docs`` documents hold it, one more where it has variable fields or open positions; it
    stays in the document with the smallest identifier. Lines of every length count, blank ones never. Rows are
    counted as they come, so a document in many copies loses its lines in all but one. Texts are read in whole.
    """
    kind = "array<struct<line:int,key:long,leaf:long,size:int,field:boolean,fresh:boolean>>"
    rows = (docs.select("doc_id", row_key().alias("raw"), F.explode(arrow_udf(_lines, kind)("text")).alias("x"))
            .select("doc_id", "raw", "x.*"))
    lines = materialise(rows.where("fresh").groupBy("leaf", "key", "size", "field")
                        .agg(F.count("*").alias("n"), F.min("doc_id").alias("owner")))
    whole = lines.where(F.col("n") >= least_docs + F.col("field").cast("int")).select("key", "owner")
    seen = whole.unionByName(open_templates(docs, lines.drop("field"), least_docs + 1)).groupBy("key").agg(F.min("owner").alias("owner"))
    hits = rows.select("doc_id", "raw", "line", "key").join(materialise(seen), "key").where(~F.col("owner").eqNullSafe(F.col("doc_id")))
    return hits.groupBy("doc_id", "raw").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def _without(docs: DataFrame, least_docs: int) -> DataFrame:
    """``docs`` as struct ``d``, with ``lines``, ``gone`` and the clean text."""
    gone = materialise(recurring_lines(docs, least_docs)).select(F.col("doc_id").alias("__id"), F.col("raw").alias("__raw"), "gone")
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), row_key().alias("raw"))
    d = d.join(gone, F.col("d.doc_id").eqNullSafe(F.col("__id")) & (F.col("raw") == F.col("__raw")), "left")
    lines = F.split(whole_text(F.col("d.text")), "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("gone", i))
    clean = F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n"))
    return d.select("d", F.size(lines).alias("n_lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"),
                    clean.alias("clean"))


def drop_recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text``; a null text stays null."""
    own = [F.col("clean").alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]
    return _without(docs, least_docs).select(*own)


def line_report(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped, clean_chars, clean_sha256), one row per row of ``docs``.

    Lines end at line feeds; a null text counts as one empty line. ``dropped`` are line numbers from 0, comma-joined.
    Ties for the smallest identifier (repeated rows) all keep their lines; among rows with and without identifiers
    those without one lose theirs. An empty table gives no rows; other columns play no part.
    """
    clean = F.coalesce("clean", F.lit(""))
    return _without(docs.select("doc_id", "text"), least_docs).select(
        "d.doc_id", "n_lines", F.size("gone").alias("n_dropped"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("dropped"),
        F.char_length(clean).alias("clean_chars"), F.sha2(clean.cast("binary"), 256).alias("clean_sha256"))
