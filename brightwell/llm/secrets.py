"""Secret scans: three fixed forms, and a battery of randomness tests for what has no form.

Base spans (assign, access, hex) are all matches of three patterns. The battery looks at every
other run of at least TOKEN characters that encodings use. The encoding is inferred from the
characters (hex, base32, lower case, base64); with its alphabet of k symbols a token is tested
for uniform use of the alphabet (chi-squared, Wilson-Hilferty tail), for runs above and below
the middle of the alphabet, and for correlation of neighbours about its mean. Middle, mean and
variance are those of a uniform draw, and alphabets begin with the symbols that ordinary strings
use most, so strings of words have few and long runs and neighbours that go together. The three
p-values are combined by Fisher's method: a token that is not random at RANDOM_LEVEL is out.

Being random is not yet a discovery, as short ordinary strings pass too. So each token also
gets a p-value under the hypothesis that it is ordinary: the combined evidence h against
randomness, as ln(1 + h), is held against its mean and deviation in ordinary strings of that
encoding and length. Short tokens cannot reach small p-values, which makes the control
length-aware. Within each encoding and band of lengths, Benjamini-Hochberg at FALSE_SHARE turns
these p-values into a cutoff, so many ordinary tokens of one kind do not hide the secrets of
another.

All is DataFrame functions: no Python runs on the executors. Texts are read once; what goes
on is spans and tokens. The cutoffs come from counts by bins of log p, a table of fixed size.

Edge cases: null is an empty text without spans. Spans count code points, ends are exclusive.
Tokens that overlap a base span are not added. Rows are kept as they are, repeated or not.
Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightwell.llm.common import id_and_text, materialize, read

# fixed values: the three forms
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# with their least lengths of 20 and 24: a match takes the whole run, so one that is too short hides no other
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = 20
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN
RANDOM_LEVEL = 0.001
FALSE_SHARE = 0.01
BINS = 50  # of ln p, for one unit
BANDS = (28, 36, 48)  # lengths at which strata begin
MOST = 48  # length beyond which a mean of ordinary strings is not taken to grow
CHUNK = 256  # matches whose places are summed up at once
BY_USE = "etaoinsrhdlucmfywgpbvkxqjz"  # letters, the commonest first
# by encoding: pattern, alphabet, and of ln(1 + h) in ordinary strings of n characters the slope and shift of the mean,
# slope * sqrt(n) + shift, and the deviation; fitted to 62000 runs of 20 to 48 characters in Python sources (base64), to
# joined words of their names (lower case, base32) and to decimal digits (hex)
ENCODINGS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.305, 0.878, 0.37),
    ("base32", "^[A-Z2-7]+=*$", BY_USE.upper() + "234567", 0.334, 1.503, 0.42),
    ("lower", "^[a-z]+$", BY_USE, 0.308, 1.05, 0.55),
    ("base64", "", BY_USE + BY_USE.upper() + "0123456789+/", 0.402, 1.377, 0.45),
)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal Z, by a rational approximation of erfc (error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.greatest(F.when(z >= 0, half).otherwise(1 - half), F.lit(1e-300))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches; value is a group's text.

    Places are running sums of the lengths of matches and of what lies between; they are made chunk by chunk, so their cost does not grow with the square of a text's matches."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    item = "struct<start: bigint, end: bigint, value: string>"
    none = F.array().cast(f"array<{item}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["value"].alias("value")))).alias("out"))

    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("match"), values.alias("value"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")), lambda i: F.slice(zipped, i * CHUNK + 1, CHUNK))
    sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.length(x["gap"]) + F.length(x["match"])))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    starts = F.aggregate(sizes, begin, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    placed = F.zip_with(chunks, starts, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"]))
    return F.when(F.size(found) > 0, F.flatten(placed)).otherwise(none)


def _if_any(text: Column, quick: str, of: Column) -> Column:
    return F.when(text.rlike(quick), of).otherwise(F.array().cast("array<struct<start: bigint, end: bigint, value: string>>"))


def _pick(x: Column, values: list) -> Column:
    """The value of the token's encoding."""
    out = F.lit(values[-1])
    for (_, pattern, *_), v in list(zip(ENCODINGS, values, strict=True))[-2::-1]:
        out = F.when(x.rlike(pattern), F.lit(v)).otherwise(out)
    return out


def battery(tokens: Column) -> Column:
    """Each token's span and stratum (alphabet and band of lengths) with the p-values p_random (Fisher over three tests) and p_ordinary."""
    clean = F.transform(tokens, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.translate(F.regexp_replace(x["value"], "=+$", ""), "-_", "+/").alias("t")))
    clean = F.transform(clean, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["t"].rlike("^[0-9A-F]+$"), F.lower(x["t"])).otherwise(x["t"]).alias("t")))
    clean = F.filter(clean, lambda x: F.length(x["t"]) >= 8)
    coded = F.transform(clean, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["t"].alias("t"), _pick(x["t"], [e[2] for e in ENCODINGS]).alias("alphabet"), *(_pick(x["t"], [e[i] for e in ENCODINGS]).alias(c) for i, c in enumerate(("slope", "shift", "deviation"), 3))))

    def numbers(x: Column) -> Column:
        index = F.transform(F.filter(F.split(x["t"], ""), lambda c: c != ""), lambda c: F.greatest(F.instr(x["alphabet"], c) - 1, F.lit(0)).cast("double"))
        counts = F.transform(F.filter(F.split(x["alphabet"], ""), lambda c: c != ""), lambda c: (F.length(x["t"]) - F.length(F.replace(x["t"], c, F.lit("")))).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        return F.struct(*(x[c].alias(c) for c in ("start", "end", "slope", "shift", "deviation")), F.length(x["t"]).cast("double").alias("n"), F.length(x["alphabet"]).cast("double").alias("k"), index.alias("index"), squares.alias("squares"))

    def tests(x: Column) -> Column:
        n, k, df = x["n"], x["k"], x["k"] - 1
        middle, mean = k / 2, (k - 1) / 2
        begin = F.struct(F.lit(0.0).alias("turns"), F.lit(0.0).alias("sum"), F.element_at(x["index"], 1).alias("last"))
        walk = F.aggregate(
            F.slice(x["index"], F.lit(2), F.size(x["index"]) - 1), begin,
            lambda a, v: F.struct((a["turns"] + F.when((a["last"] >= middle) != (v >= middle), 1.0).otherwise(0.0)).alias("turns"), (a["sum"] + (a["last"] - mean) * (v - mean)).alias("sum"), v.alias("last")),
        )
        chi = x["squares"] * k / n - n
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - F.lit(2 / 9) / df)) / F.sqrt(F.lit(2 / 9) / df)
        z_runs = (walk["turns"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        z_serial = walk["sum"] / ((k * k - 1) / 12 * F.sqrt(n - 1))
        usual = x["slope"] * F.sqrt(F.least(n, F.lit(float(MOST)))) + x["shift"]
        stratum = (k * 10 + sum(F.when(n >= b, 1).otherwise(0) for b in BANDS)).cast("int")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), stratum.alias("stratum"), z_chi.alias("chi"), z_runs.alias("runs"), z_serial.alias("serial"), usual.alias("usual"), x["deviation"].alias("deviation"))

    def combined(x: Column) -> Column:
        two_sided = lambda z: F.ln(F.least(2 * upper_tail(F.abs(z)), F.lit(1.0)))
        logs = F.ln(upper_tail(x["chi"])) + two_sided(x["runs"]) + two_sided(x["serial"])
        return F.struct(*(x[c].alias(c) for c in ("start", "end", "stratum", "usual", "deviation")), (-logs).alias("h"))

    def judged(x: Column) -> Column:
        p_random = F.exp(-x["h"]) * (1 + x["h"] + x["h"] * x["h"] / 2)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["stratum"].alias("stratum"), p_random.alias("p_random"), upper_tail((x["usual"] - F.log1p(x["h"])) / x["deviation"]).alias("p_ordinary"))

    out = coded
    for f in (numbers, tests, combined, judged):
        out = F.transform(out, f)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, arrays of base spans by kind, and tested tokens; no texts."""
    text = F.col("text")
    found = id_and_text(docs).select(
        "doc_id",
        F.filter(_if_any(text, ASSIGN, spans(text, ASSIGN, 2)), lambda x: F.length(x["value"]) >= 6).alias("assign"),
        _if_any(text, ACCESS, spans(text, ACCESS)).alias("access"),
        _if_any(text, HEX, spans(text, HEX)).alias("hex"),
        _if_any(text, RUN, spans(text, RUN)).alias("runs"),
    )
    base = F.concat("assign", "access", "hex")
    free = F.filter("runs", lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return found.select("doc_id", "assign", "access", "hex", F.when(F.size(free) > 0, battery(free)).otherwise(F.array().cast("array<struct<start: bigint, end: bigint, stratum: int, p_random: double, p_ordinary: double>>")).alias("tested"))


def cutoffs(scanned: DataFrame, false_share: float = FALSE_SHARE) -> dict[int, float]:
    """By stratum, the largest p that Benjamini-Hochberg admits, on bins of ln p (each bin counts as its upper end); none where it admits none."""
    p = scanned.select(F.explode("tested").alias("t")).select("t.stratum", F.ceil(F.ln("t.p_ordinary") * BINS).alias("bin"))
    bins = p.groupBy("stratum", "bin").agg(F.count("*").alias("n"))  # at most 700 * BINS rows a stratum
    own = Window.partitionBy("stratum")
    ranked = bins.select("stratum", "bin", F.sum("n").over(own.orderBy("bin")).alias("rank"), F.sum("n").over(own).alias("m"))
    top = ranked.select("stratum", F.exp(F.col("bin") / BINS).alias("p"), "rank", "m").where(F.col("p") * F.col("m") <= false_share * F.col("rank")).groupBy("stratum").agg(F.max("p").alias("p"))
    return {r["stratum"]: r["p"] for r in top.collect()}  # a row for each of 16 strata at most


def secrets(docs: DataFrame, random_level: float = RANDOM_LEVEL, false_share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, base and added spans (kind, start, end), each sorted by start and kind."""
    scanned = materialize(scan(docs), "secrets")
    most = cutoffs(scanned, false_share)

    def admitted(x: Column) -> Column:
        out = F.lit(False)
        for stratum, p in most.items():
            out = out | ((x["stratum"] == stratum) & (x["p_ordinary"] <= p))
        return out

    def as_kind(column: Column, kind: str) -> Column:
        return F.transform(column, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), x["end"].alias("end")))

    added = F.filter("tested", lambda x: (x["p_random"] >= random_level) & admitted(x))
    base = F.concat(*(as_kind(F.col(k), k) for k in KINDS[:3]))
    return scanned.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.size(added).cast("long").alias("n_random"), F.array_sort(base).alias("base"), F.array_sort(F.concat(base, as_kind(added, "random"))).alias("all"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["order"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    found = secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written("base"), 256).alias("base_sha256"), written("all").alias("spans"), "n_random")
