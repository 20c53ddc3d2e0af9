"""Secret scan: known shapes, and a battery of randomness tests with false-discovery control by length."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeworks.llm.common import LOWER, whole_text
from tapeworks.session import materialise

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RUN = r"[A-Za-z0-9+/_=-]{12,}"
ONE_CASE = r"^([A-Z]?[a-z]+|[A-Z]+)$"
LONG_HEX = r"[0-9a-f]{16,}"  # the same maximal runs as HEX, less those that are too short to count
KINDS = ("assign", "access", "hex", "random")
#: What readable text looks like: chance that two of its letters agree, that neighbouring characters differ in class
#: (lower, upper, digit, other), and the correlation of vowels with the next character.
TEXT_MATCH, TEXT_TURN, TEXT_SERIAL = 0.066, 0.08, -0.15
WEIGHTS = (1.0, 0.7, 0.4)  # of uniformity, runs and serial correlation in the combined score
RATE = 0.001  # tolerated share of readable strings among the reported ones
LETTER_WEIGHTS = (1.0, 0.5, 0.4)  # strings of one case: of unusual letters, uniformity and serial correlation
LETTER_SPREAD = 1.5  # letters of a word hang together, so their sum spreads wider than that of independent ones
STRATA = (12, 16, 20, 32, 64, 128)  # lengths; strings of one case have strata of their own
BLOCK = 64


def spans(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start, end, match>> of the leftmost non-overlapping matches, in code points, end exclusive.

    ``found`` are the matches; together with the pieces between them their lengths give the places.
    """
    kind = "array<struct<start:int,end:int,match:string>>"
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    parts = F.zip_with(gaps, found, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("len"), m.alias("match")))
    place = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["len"]).alias("end"), x["match"].alias("match"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    step = lambda s, x: F.struct((s["at"] + x["gap"] + x["len"]).alias("at"), F.concat(s["out"], F.array(place(s["at"], x))).alias("out"))
    moved = lambda out, by: F.transform(out, lambda y: F.struct((y["start"] + by).alias("start"), (y["end"] + by).alias("end"), y["match"].alias("match")))
    # Growing arrays are copied, so places are added up in blocks first and the blocks moved to their own places.
    blocks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")),
                                   lambda b: F.aggregate(F.slice(p, b * BLOCK + 1, F.lit(BLOCK)), none, step))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    join = lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["out"], F.array(moved(x["out"], s["at"]))).alias("out"))
    all_ = F.get(F.transform(F.array(parts), lambda p: F.flatten(F.aggregate(blocks(p), start, join, lambda s: s["out"]))), F.lit(0))
    return F.when(F.size(found) > 0, all_).otherwise(F.array().cast(kind))


def _occurrences(s: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)))


def letters(s: Column) -> Column:
    """A string without the marks that also join words."""
    return F.regexp_replace(s, "[-_/+=]", "")


def alphabet(s: Column) -> Column:
    """Number of characters of the encoding that a string seems to be in."""
    sizes = ((r"^[0-9]+$", 10), (r"^[0-9a-f]+$", 16), (r"^[0-9A-F]+$", 16), (r"^[a-z]+$", 26), (r"^[A-Z]+$", 26),
             (r"^[A-Z2-7=]+$", 32), (r"^[0-9a-z]+$", 36), (r"^[0-9A-Z]+$", 36), (r"^[A-Za-z]+$", 52), (r"^[A-Za-z0-9]+$", 62))
    out = F.lit(64)
    for pattern, size in reversed(sizes):
        out = F.when(s.rlike(pattern), F.lit(size)).otherwise(out)
    return out


def letter_table(docs: DataFrame) -> list[float]:
    """Logarithms of the shares of a to z in all texts: 26 numbers, whatever the corpus."""
    low = F.lower(whole_text())
    row = docs.agg(*(F.sum(F.char_length(low) - F.char_length(F.replace(low, F.lit(c), F.lit("")))).alias(c) for c in LOWER)).first()
    counts = [float(row[c] or 0) + 1.0 for c in LOWER]
    return [math.log(n / sum(counts)) for n in counts]


def evidence(s: Column, table: list[float]) -> Column:
    """Combined normal score against "this is readable text"; large for strings that look random in their encoding.

    * Uniformity: the chi-squared statistic over the inferred alphabet, compared with its mean and spread for text.
    * Runs: changes of character class, compared with the rate of text (signed root of the binomial deviance, which
      holds for short strings too).
    * Serial correlation of vowels with their neighbours, which alternate in text.
    * Strings of one case have no classes to change: the likelihood of their letters in the corpus takes the runs' place.

    Strings without two letters or digits score as text.
    """
    n = F.greatest(F.char_length(s), F.lit(2)).cast("double")
    a = alphabet(s).cast("double")
    squares = F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0),
                          lambda acc, c: acc + F.when(c == "", 0.0).otherwise(F.pow(n - F.char_length(F.replace(s, c, F.lit(""))), F.lit(2.0))))
    chi = a * squares / n - n
    mean = a * (TEXT_MATCH * (n - 1) + 1) - n
    spread = a * F.sqrt(2 * TEXT_MATCH * (1 - TEXT_MATCH) * (n - 1) / n) * 1.5
    uniform = (mean - chi) / spread
    rate = (_occurrences(s, r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+") - 1) / (n - 1)
    part = lambda x, y: F.when(x > 0, x * F.log(F.greatest(x, F.lit(1e-9)) / y)).otherwise(F.lit(0.0))
    deviance = 2 * (n - 1) * (part(rate, TEXT_TURN) + part(1 - rate, 1 - TEXT_TURN))
    runs = F.signum(rate - TEXT_TURN) * F.sqrt(F.greatest(deviance, F.lit(0.0)))
    p = (n - F.char_length(F.regexp_replace(s, "[aeiouAEIOU]", ""))) / n
    swaps = _occurrences(s, "[aeiouAEIOU]+|[^aeiouAEIOU]+") - 1
    serial = F.when((p > 0) & (p < 1), 1 - swaps / ((n - 1) * 2 * p * (1 - p))).otherwise(F.lit(0.0))
    serial = (serial - TEXT_SERIAL) * F.sqrt(n)
    mu = sum(math.exp(x) * x for x in table)
    sigma = math.sqrt(max(sum(math.exp(x) * (x - mu) ** 2 for x in table), 1e-6))
    logs = F.array(*map(F.lit, table))
    likely = F.aggregate(F.split(F.lower(s), ""), F.lit(0.0), lambda acc, c: acc + F.coalesce(F.get(logs, F.ascii(c) - ord("a")), F.lit(0.0)))
    unusual = (n * mu - likely) / (F.sqrt(n) * sigma * LETTER_SPREAD)
    cap = lambda z: F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    total = lambda weights, zs: sum(w * cap(z) for w, z in zip(weights, zs)) / sum(w * w for w in weights) ** 0.5
    score = F.when(s.rlike(ONE_CASE), total(LETTER_WEIGHTS, (unusual, uniform, serial))).otherwise(total(WEIGHTS, (uniform, runs, serial)))
    return F.when(F.char_length(s) < 2, F.lit(-8.0)).otherwise(score)


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic approximation."""
    return 1 / (1 + F.exp(F.least(F.lit(600.0), 1.5976 * z + 0.070566 * F.pow(z, F.lit(3.0)))))


def scan(docs: DataFrame, table: list[float]) -> DataFrame:
    """One row per row of ``docs`` with its known spans and the strings of 12 and more characters, tested."""
    text = whole_text()
    d = docs.select("doc_id", text.alias("t"))
    matches = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    d = d.select("doc_id", "t", matches(ASSIGN).alias("ma"), matches(ACCESS).alias("mk"), matches(LONG_HEX).alias("mh"),
                 matches(RUN).alias("mr"))
    long_value = lambda x: F.char_length(F.regexp_extract(x["match"], ASSIGN, 1)) >= 12
    known = {"assign": F.filter(spans(F.col("t"), ASSIGN, F.col("ma")), long_value),
             "access": F.filter(spans(F.col("t"), ACCESS, F.col("mk")), lambda x: x["end"] - x["start"] >= 18),
             "hex": spans(F.col("t"), LONG_HEX, F.col("mh"))}
    d = d.select("doc_id", *(F.transform(v, lambda x: x.dropFields("match")).alias(k) for k, v in known.items()),
                 spans(F.col("t"), RUN, F.col("mr")).alias("tried"))
    tried = F.transform("tried", lambda x: F.struct(x["start"], x["end"], letters(x["match"]).alias("core")))
    d = d.select("doc_id", "assign", "access", "hex", tried.alias("tried"))
    tested = F.transform("tried", lambda x: F.struct(x["start"], x["end"], _stratum(x["end"] - x["start"], x["core"]).alias("stratum"),
                                                     evidence(x["core"], table).alias("z")))
    return materialise(d.select("doc_id", "assign", "access", "hex", tested.alias("tested")))


def _stratum(length: Column, core: Column) -> Column:
    """Length class, twice as many for strings of several classes and for those of one case or digits alone."""
    plain = core.rlike(ONE_CASE) | core.rlike("^[0-9]*$")
    return 2 * sum(((length >= s).cast("int") for s in STRATA[1:]), F.lit(0)) + plain.cast("int")


def discovery_limits(found: DataFrame, rate: float = RATE) -> DataFrame:
    """(stratum, least): the score from which strings of a length class are reported (Benjamini and Hochberg).

    Tails are counted in steps of a twentieth of a decade over all strings, so the table has a fixed size.
    """
    each = found.select(F.explode("tested").alias("x")).select("x.stratum", "x.z")
    decade = F.least(F.lit(400), F.floor(-F.log10(tail(F.col("z"))) * 20)).cast("int")
    counts = each.groupBy("stratum", decade.alias("step")).agg(F.count("*").alias("n"), F.min("z").alias("z"))
    down = Window.partitionBy("stratum").orderBy(F.desc("step"))
    all_ = F.sum("n").over(Window.partitionBy("stratum"))
    good = counts.withColumn("k", F.sum("n").over(down)).withColumn("m", all_)
    return good.where(F.pow(F.lit(10.0), -F.col("step") / 20) <= rate * F.col("k") / F.col("m")).groupBy("stratum").agg(F.min("z").alias("least"))


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans), one row per row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, ordered by start and then kind, comma-joined; strings
    that the battery reports come as ``random`` unless they overlap a known span. Every string of 12 characters is tested,
    of one case or several. Null and empty texts have no spans
    (and the digest of the empty string). An empty table gives no rows; other columns play no part.
    """
    found = scan(docs, letter_table(docs))
    limits = {r["stratum"]: r["least"] for r in discovery_limits(found, rate).collect()}  # at most twice len(STRATA) rows
    limit = lambda x: F.coalesce(*(F.when(x["stratum"] == k, F.lit(float(v))) for k, v in limits.items()), F.lit(1e9))
    marked = lambda c, k: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"), x["end"].alias("end")))
    base = F.array_sort(F.concat(marked("assign", "assign"), marked("access", "access"), marked("hex", "hex")))
    d = found.withColumn("base", base)
    new = F.filter("tested", lambda x: (x["z"] >= limit(x)) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    d = d.withColumn("new", marked(new, "random")).withColumn("all", F.array_sort(F.concat("base", "new")))
    words = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(words, x["kind"]), x["start"], x["end"])), ",")
    size = lambda c: F.size(c).cast("long")
    return d.select("doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"),
                    size("new").alias("n_random"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
                    joined("all").alias("spans"))
