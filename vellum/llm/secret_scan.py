"""Secret scans: known shapes, and a battery of randomness tests on long tokens.

A token of 20 or more characters with a letter gets an encoding, inferred from its own characters: an alphabet of
the classes that it uses (lower and upper case, digits, each separator for itself; fewer letters or digits for
hexadecimal, base 32 and base 58). A battery asks whether it could be a random string of that encoding: chi-squared uniformity
over the alphabet, runs of character classes, and serial correlation at lags 1 to 4, joined by Bonferroni.
Tokens in which randomness is rejected are never reported.

The false-discovery control is of what is reported, so its null is that a token is ordinary text. Ordinary
tokens change their character class seldom and have the letters of prose; a token's p-value is the chance
that an ordinary one of its length has as many runs, as many turns between letters and digits, or as unusual letters, the rarest of the three
counted three times (1 if the battery has rejected randomness); few runs don't make strange letters more ordinary. The Benjamini-Hochberg rule over these, within bands of length, chooses the reports: a short
token gives too little evidence where most tokens of its length are ordinary.

Everything here is built-in column expressions. Texts are read once; what is found is written, and the
p-values meet as a small histogram.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import materialise

#: The patterns of the known kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 8
#: One of these is in every text with a match of ASSIGN, in lower case.
ASSIGN_WORDS = ("passw", "secret", "token", "api")
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Every match of TOKEN or HEX has this.
LONG_RUN = "[A-Za-z0-9+/_-]{20}"
CLASSES = ("digits", "upper", "lower", "other")
_LOWER, _UPPER, _DIGITS, _OTHER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-"
#: Letters a to z per thousand letters of English prose.
PROSE = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: Share of neighbours of different classes in ordinary tokens of one case, and in those of both cases or with separators.
CHANGES, MORE_CHANGES = 0.15, 0.35
#: Share of neighbouring letters and digits (separators left out) of which one is a letter, the other a digit, in ordinary tokens.
TURNS = 0.12
#: Letters and runs of ordinary tokens come in words; their counts vary by so much more than independent ones.
CLUSTERING = 2.0
LAGS = (1, 2, 3, 4)
#: The battery rejects randomness below this.
LEAST_RANDOM = 0.01
BANDS = (20, 24, 32, 40, 64, 128, 256)
BINS_EACH = 20
MOST_BINS = 1000
FALSE_DISCOVERY = 0.05
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _places(text: Column, pattern: str, kind: int, guard: Column, value: int | None = None) -> Column:
    """Code-point spans of the leftmost non-overlapping matches; with ``value``, only those whose group is long enough.

    ``guard`` is true for every text with a match. What lies between matches and the matches alternate, so their
    lengths add up to the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value or 0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    sizes = F.zip_with(F.zip_with(between, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"))), values, lambda x, v: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), (F.length(v) >= (LEAST_VALUE if value else 0)).alias("ok")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = (acc["at"] + x["gap"]).cast("long")
        end = (start + x["n"]).cast("long")
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(guard, F.aggregate(sizes, zero, step, lambda acc: acc["out"])).otherwise(F.expr(f"cast(array() as {SPAN})"))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, by a rational approximation of the error function."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _of_letters(values: list[float]) -> Column:
    """A constant of each letter, as an array."""
    return F.array(*[F.lit(float(v)) for v in values])


def _alphabet(t: Column) -> dict[str, Column]:
    """The parts of a token's alphabet by class, each empty where the token has nothing of it."""
    has = lambda pattern: t["token"].rlike(pattern)
    lower, upper, digits, other = has("[a-z]"), has("[A-Z]"), has("[0-9]"), has("[+/_-]")
    base58 = lower & upper & digits & ~other & ~has("[0OIl]")
    pick = lambda used, *cases: F.when(~used, "").otherwise(F.coalesce(*[F.when(when, chars) for when, chars in cases]))
    always = F.lit(True)
    return {
        "digits": pick(digits, (base58, _DIGITS[1:]), (upper & ~lower & ~has("[0189]"), _DIGITS[2:8]), (always, _DIGITS)),
        "upper": pick(upper, (base58, _UPPER.replace("I", "").replace("O", "")), (digits & ~lower & ~has("[G-Z]"), _UPPER[:6]), (always, _UPPER)),
        "lower": pick(lower, (base58, _LOWER.replace("l", "")), (digits & ~upper & ~has("[g-z]"), _LOWER[:6]), (always, _LOWER)),
        "other": F.concat(*[F.when(t["token"].contains(c), c).otherwise("") for c in _OTHER]),
    }


def _prose() -> tuple[list[float], float, float]:
    """ln(chance in random letters / chance in prose) of each letter; its mean and variance in prose."""
    q = [x / sum(PROSE) for x in PROSE]
    odds = [math.log(1 / 26 / x) for x in q]
    mean = sum(x * o for x, o in zip(q, odds, strict=True))
    return odds, mean, sum(x * (o - mean) ** 2 for x, o in zip(q, odds, strict=True))


def judged(tokens: DataFrame | None, name: str = "_tokens") -> DataFrame:
    """Replace ``name``, an array<struct<start, end, token>>, by array<struct<start, end, band, bin, random, ordinary>>.

    random is the battery's p-value, ordinary the p-value under the null of ordinary text, bin grows as the latter
    falls. Tokens without a letter are left out. Each step is a column of its own, so that expressions stay small.
    """

    def add(df: DataFrame, **new) -> DataFrame:
        return df.withColumn(name, F.transform(name, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), *[f(t).alias(k) for k, f in new.items()])))

    keep = lambda *names: {k: (lambda t, k=k: t[k]) for k in names}
    both = _LOWER + _UPPER + _DIGITS + _OTHER
    shape = lambda t: F.translate(F.regexp_replace(t["token"], "=+$", ""), both, "a" * 26 + "A" * 26 + "0" * 10 + "-" * 4)
    df = add(tokens, token=lambda t: F.regexp_replace(t["token"], "=+$", ""), shape=shape)
    df = df.withColumn(name, F.filter(name, lambda t: F.lower(t["shape"]).contains("a")))

    changes = lambda shape: (F.length(F.regexp_replace(shape, r"(.)\1*+", "$1")) - 1).cast("double")
    df = add(df, **keep("token", "shape"), parts=lambda t: F.struct(*[v.alias(k) for k, v in _alphabet(t).items()]))
    df = add(
        df, **keep("token", "shape"), alphabet=lambda t: F.concat(*[t["parts"][c] for c in CLASSES]), sizes=lambda t: F.array(*[F.length(t["parts"][c]).cast("double") for c in CLASSES]),
        n=lambda t: F.length(t["token"]).cast("double"), changes=lambda t: changes(t["shape"]), turns=lambda t: changes(F.translate(t["shape"], "A-", "a")), plain=lambda t: F.length(F.translate(t["shape"], "-", "")).cast("double"),
    )
    df = add(df, **keep("token", "shape", "alphabet", "n", "changes", "turns", "plain"), k=lambda t: F.length(t["alphabet"]).cast("double"), shares=lambda t: F.transform(t["sizes"], lambda x: x / F.length(t["alphabet"])))
    characters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    odds, mean, variance = _prose()
    df = add(
        df, **keep("shape", "shares", "n", "changes", "turns", "plain", "k"),
        pairs=lambda t: F.aggregate(characters(t["alphabet"]), F.lit(0.0), lambda acc, c: acc + F.pow(F.length(t["token"]) - F.length(F.replace(t["token"], c, F.lit(""))), F.lit(2.0))),
        codes=lambda t: F.transform(characters(t["token"]), lambda c: F.instr(t["alphabet"], c).cast("double")),
        letters=lambda t: F.length(F.regexp_replace(t["token"], "[^A-Za-z]", "")).cast("double"),
        odd=lambda t: F.aggregate(characters(F.regexp_replace(F.lower(t["token"]), "[^a-z]", "")), F.lit(0.0), lambda acc, c: acc + F.element_at(_of_letters(odds), F.instr(F.lit(_LOWER), c))),
    )
    df = add(df, **keep("shape", "shares", "n", "changes", "turns", "plain", "k", "pairs", "codes", "letters", "odd"), mid=lambda t: F.aggregate(t["codes"], F.lit(0.0), lambda acc, c: acc + c) / t["n"])
    df = add(df, **keep("shape", "shares", "n", "changes", "turns", "plain", "k", "pairs", "letters", "odd"), off=lambda t: F.transform(t["codes"], lambda c: c - t["mid"]))

    def serial(t: Column, lag: int) -> Column:
        size = F.greatest(F.size(t["off"]) - lag, F.lit(0))
        lagged = F.zip_with(F.slice(t["off"], F.lit(1), size), F.slice(t["off"], F.lit(lag + 1), size), lambda x, y: x * y)
        total = F.aggregate(t["off"], F.lit(0.0), lambda acc, x: acc + x * x)
        return F.aggregate(lagged, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(total, F.lit(1e-9))

    def chi_z(t: Column) -> Column:
        df_ = t["k"] - 1
        chi = F.greatest(t["pairs"] * t["k"] / t["n"] - t["n"], F.lit(0.0))
        return (F.pow(chi / df_, F.lit(1 / 3)) - (1 - 2 / (9 * df_))) / F.sqrt(2 / (9 * df_))

    def runs_z(t: Column) -> Column:
        # Of a random string: chance that neighbours differ in class, its variance, and the covariance of neighbouring pairs.
        total = lambda f: F.aggregate(t["shares"], F.lit(0.0), lambda acc, x: acc + f(x))
        p = 1 - total(lambda x: x * x)
        v, c = p * (1 - p), total(lambda x: x * (1 - x) * (1 - x)) - p * p
        spread = F.sqrt(F.greatest((t["n"] - 1) * v + 2 * (t["n"] - 2) * c, F.lit(1e-9)))
        return F.when(p > 1e-9, F.abs(t["changes"] - (t["n"] - 1) * p) / spread).otherwise(0.0)

    split_up = lambda t: t["shape"].contains("-") | (t["shape"].contains("a") & t["shape"].contains("A"))
    rate = lambda t: F.when(split_up(t), F.lit(MORE_CHANGES)).otherwise(CHANGES)
    more = lambda number, n, rate: (number - (n - 1) * rate) / F.sqrt(F.greatest(n - 1, F.lit(1.0)) * rate * (1 - rate) * CLUSTERING)
    df = add(
        df, **keep("n", "changes", "turns", "plain"),
        chi=chi_z, runs=runs_z, serial=lambda t: F.greatest(*[F.abs(serial(t, lag) + 1 / t["n"]) for lag in LAGS]) * F.sqrt(t["n"]),
        runs0=lambda t: more(t["changes"], t["n"], rate(t)), turns0=lambda t: more(t["turns"], t["plain"], F.lit(TURNS)), letters0=lambda t: (t["odd"] - t["letters"] * mean) / F.sqrt(t["letters"] * variance * CLUSTERING),
    )
    tests = 2 + len(LAGS)
    # Chi-squared uniformity is one-sided; a single class of characters has no runs to go by.
    random = lambda t: F.least(F.lit(1.0), tests * F.least(upper_tail(t["chi"]), 2 * upper_tail(t["runs"]), 2 * upper_tail(t["serial"])))
    ordinary = lambda t: F.when(t["changes"] > 0, F.least(F.lit(1.0), 3 * F.least(upper_tail(t["runs0"]), upper_tail(t["turns0"]), upper_tail(t["letters0"])))).otherwise(upper_tail(t["letters0"]))
    df = add(df, **keep("n"), random=random, ordinary=ordinary)

    def band(t: Column) -> Column:
        out = F.lit(0)
        for i, least in enumerate(BANDS[1:], 1):
            out = F.when(t["n"] >= least, i).otherwise(out)
        return out

    bin_ = lambda t: F.when(t["random"] < LEAST_RANDOM, 0).otherwise(F.least(F.lit(MOST_BINS), F.floor(-F.log(F.greatest(t["ordinary"], F.lit(1e-60))) * BINS_EACH)).cast("int"))
    return add(df, band=band, bin=bin_, **keep("random", "ordinary"))


def _scan(docs: DataFrame, kept: list[str]) -> DataFrame:
    """The columns ``kept`` with _known and _tokens (see ``judged``) of every row, from one pass over its text, written."""
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    named = low.contains(ASSIGN_WORDS[0])
    for word in ASSIGN_WORDS[1:]:
        named = named | low.contains(word)
    rows = docs.withColumns({"_named": named & text.rlike(ASSIGN), "_long": text.rlike(LONG_RUN)})
    known = F.concat(_places(text, ASSIGN, 0, F.col("_named"), 2), _places(text, ACCESS, 1, text.contains("AKIA")), _places(text, HEX, 2, F.col("_long")))
    tokens = F.zip_with(_places(text, TOKEN, 3, F.col("_long")), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), t.alias("token")))
    rows = rows.withColumn("_known", known).withColumn("_tokens", F.when(F.col("_long"), tokens).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,token:string>>)")))
    return materialise(judged(rows.select(*kept, "_known", "_tokens")), "scanned")


def report_bins(scanned: DataFrame, rate: float = FALSE_DISCOVERY) -> dict[int, int]:
    """For each band of length, the least bin that is reported (Benjamini-Hochberg at ``rate``).

    The histogram has at most bands x bins rows, whatever the corpus.
    """
    tokens = scanned.select(F.explode("_tokens").alias("t")).groupBy("t.band", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    band = Window.partitionBy("band")
    ranked = tokens.select("band", "bin", F.sum("n").over(band.orderBy(F.desc("bin"))).alias("k"), F.sum("n").over(band).alias("m"))
    return {r.band: r.bin for r in ranked.filter(F.exp(-F.col("bin") / BINS_EACH) <= F.col("k") / F.col("m") * rate).groupBy("band").agg(F.min("bin").alias("bin")).collect()}


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY, kept: list[str] | None = None) -> DataFrame:
    """Add ``secrets`` to the columns ``kept`` (default: all): array<struct<start, kind, end>> by start, then kind
    (numbers of KINDS), in code points.

    Known shapes always count; random tokens are added where no known shape overlaps them. A null or empty
    text has none. Rows repeat as they do in ``docs``; a column named ``secrets`` is replaced.
    """
    scanned = _scan(docs, [c for c in kept or docs.columns if c != "secrets"])
    bins = report_bins(scanned, rate)
    cut = F.array(*[F.lit(bins.get(b, MOST_BINS + 1)) for b in range(len(BANDS))])
    free = lambda t: ~F.exists("_known", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    random = F.transform(F.filter("_tokens", lambda t: (t["bin"] > 0) & (t["bin"] >= F.element_at(cut, t["band"] + 1)) & free(t)), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return scanned.withColumn("secrets", F.array_sort(F.concat("_known", random))).drop("_known", "_tokens")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """Replace every span of ``secrets`` in ``text`` by ``mark``; overlapping spans get one mark."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("secrets", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return docs.withColumn("text", F.when(F.size("secrets") > 0, clean).otherwise(text))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; a null text has no spans, rows repeat as they do
    in ``docs``, an empty table gives an empty one, and other columns are left out."""
    found = find_secrets(docs.select("doc_id", "text"), kept=["doc_id"])
    number = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = _joined(F.filter("secrets", lambda s: s["kind"] < 3))
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
