"""Secret scans with a randomness test battery (DataFrame functions only).

Three fixed patterns find assignments, access keys and hexadecimal keys.
Beyond them a token of twenty or more key characters is a candidate if it has
a digit, a small letter before two capitals, or twenty capitals in a row (names
strung together in capitals and small letters have none of these; of random
keys of twenty characters 3 in a thousand have none in base 62 or 64, 2 in a
thousand in base 36, and longer ones fewer).  Its
encoding is inferred from its characters (hexadecimal, base 32, base 62 or
base 64) and three tests compare it with that encoding's uniform noise and
with written text: chi-squared uniformity over the alphabet, the number of
runs of character classes, and the serial correlation of code values.

Two combined values decide.  ``p_noise`` (Fisher's combination of the three
two-sided values) must not reject noise.  ``p_text`` is the same combination
of one-sided values under a model of written text; candidates are accepted by
the Benjamini-Hochberg rule at a false-discovery rate of 1 %, separately for
each length class, because short tokens have little power and many false
candidates.  The rule works on a histogram of rounded values (never rounded
down), so only a table of bounded size (classes x 1,201 cells) is gathered.

Defined results: null text is empty; an empty text has no spans and the hash
of the empty string; matches of a kind never overlap, matches of different
kinds may; candidates that overlap a match of a fixed pattern are left to it;
repeated rows are scanned like any other; a long text is scanned whole, a long
token measured whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from ._common import materialize

# Patterns and least lengths of the three kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the same spans as AKIA[A-Z0-9]+ of 16 or more characters: a match takes its whole run
HEX = r"[0-9a-f]{32,}"  # likewise
KINDS = ("assign", "access", "hex", "random")

# The battery.  A candidate is a whole run of the widest alphabet that does not look like one word or a list of such, with its padding.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*?(?:[0-9]|[a-z][A-Z]{2}|[A-Z]{20}))[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Model of written text: chance that two characters agree and its spread, chance that neighbours
#: change class, serial correlation of code values.
TEXT_AGREE, TEXT_SPREAD, TEXT_CHANGE, TEXT_SERIAL = 0.065, 0.0011, 0.15, 0.5
NOISE_LEVEL, FALSE_DISCOVERIES = 0.001, 0.01
#: Lower bounds of the length classes.
LENGTH_CLASSES = (20, 28, 40, 64, 128, 512)
#: Cells of the histogram: hundredths of -log10 p, up to 12.
CELLS_PER_DECADE, DECADES = 100, 12



_SPAN = "struct<s:int,e:int,m:string>"
#: Spans gathered before they are put aside, so that a text with many matches is not copied once for each.
_RUN = 512


def matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, m): the leftmost non-overlapping matches, in code points, end exclusive.

    Positions follow from the lengths of the matches and of what lies between them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("between"), found.alias("found"))
    empty = f"cast(array() as array<{_SPAN}>)"
    start = F.expr(f"named_struct('at', 0, 'run', {empty}, 'runs', cast(array() as array<array<{_SPAN}>>))")

    def step(acc: Column, pair: Column) -> Column:
        s = acc["at"] + F.char_length(pair["between"])
        e = s + F.coalesce(F.char_length(pair["found"]), F.lit(0))
        one = F.array(F.struct(s.alias("s"), e.alias("e"), pair["found"].alias("m")))
        full = F.size(acc["run"]) >= _RUN
        return F.struct(
            e.alias("at"),
            F.when(pair["found"].isNull(), acc["run"]).when(full, one).otherwise(F.concat(acc["run"], one)).alias("run"),
            F.when(full & pair["found"].isNotNull(), F.concat(acc["runs"], F.array(acc["run"]))).otherwise(acc["runs"]).alias("runs"),
        )

    spans = F.aggregate(pairs, start, step, lambda acc: F.concat(F.flatten(acc["runs"]), acc["run"]))
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(empty))


def _upper_tail(z: Column) -> Column:
    """Chance that a standard normal value exceeds z, in closed form (relative error of a few percent), within (0, 1)."""
    a = F.least(F.greatest(F.abs(z), F.lit(1e-6)), F.lit(37.0))
    q = (1 - F.exp(-1.4 * a)) * F.exp(-a * a / 2) / (1.135 * 2.5066282746310002 * a)
    return F.least(F.greatest(F.when(z >= 0, q).otherwise(1 - q), F.lit(1e-300)), F.lit(1.0))


def _fisher(p: list[Column]) -> Column:
    """Fisher's combination of three values: the tail of chi-squared with six degrees of freedom."""
    half = -(F.ln(p[0]) + F.ln(p[1]) + F.ln(p[2]))
    return F.greatest(F.exp(-half) * (1 + half + half * half / 2), F.lit(1e-300))


#: Digits, capitals, small letters, signs: code values follow this order.
_CODES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_"


def battery(span: Column) -> Column:
    """(s, e, encoding, n, p_noise, p_text) of one candidate (s, e, m)."""
    token = F.regexp_replace(span["m"], "=+$", "")
    encoding = (
        F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+$"), "base32")
        .when(token.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), "base36")
        .when(token.rlike("^[0-9A-Za-z]+$"), "base62")
        .otherwise("base64")
    )
    return F.transform(
        F.array(F.struct(span["s"].alias("s"), span["e"].alias("e"), token.alias("m"), encoding.alias("encoding"))), _measured
    )[0]


def _measured(x: Column) -> Column:
    chars = F.split(x["m"], "")
    codes = F.transform(chars, lambda c: F.instr(F.lit(_CODES), c).cast("double"))
    size = F.char_length(x["m"]).cast("double")
    k = F.when(x["encoding"] == "hex", 16.0).when(x["encoding"] == "base32", 32.0).when(x["encoding"] == "base36", 36.0).when(x["encoding"] == "base62", 62.0).otherwise(64.0)
    counts = F.transform(F.array_distinct(chars), lambda d: F.size(F.filter(chars, lambda c: c == d)).cast("double"))
    squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
    classes = F.array(*[F.char_length(F.regexp_replace(x["m"], keep, "")).cast("double") for keep in ("[^0-9]", "[^A-Z]", "[^a-z]", "[0-9A-Za-z]")])
    runs = F.size(F.regexp_extract_all(x["m"], F.lit("[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+"), F.lit(0))).cast("double")
    power = lambda e: F.aggregate(classes, F.lit(0.0), lambda a, c: a + F.pow(c, F.lit(float(e))))
    mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / size
    moments = F.aggregate(
        codes,
        F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("p")),
        lambda a, c: F.struct(
            (a["v"] + (c - mean) * (c - mean)).alias("v"),
            (a["w"] + F.coalesce((a["p"] - mean) * (c - mean), F.lit(0.0))).alias("w"),
            c.alias("p"),
        ),
        lambda a: F.when(a["v"] > 0, a["w"] / a["v"]).otherwise(F.lit(1.0)),
    )
    facts = F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["encoding"].alias("encoding"), size.alias("n"), k.alias("k"), squares.alias("q"),
        runs.alias("r"), power(2).alias("c2"), power(3).alias("c3"), moments.alias("rho"),
    )
    return F.transform(F.array(facts), _judged)[0]


def _judged(f: Column) -> Column:
    n, k = f["n"], f["k"]
    # noise: chi-squared uniformity, runs of classes given their counts, serial correlation
    chi = (k / n * f["q"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    runs_mean = 1 + (n * n - f["c2"]) / n
    runs_var = F.greatest((f["c2"] * (f["c2"] + n * (n + 1)) - 2 * n * f["c3"] - n * n * n) / (n * n * (n - 1)), F.lit(1e-9))
    runs = F.when(runs_var > 1e-6, (f["r"] - runs_mean) / F.sqrt(runs_var)).otherwise(F.lit(0.0))
    serial = (f["rho"] + 1 / n) * F.sqrt(n)
    two_sided = [F.least(2 * _upper_tail(F.abs(z)), F.lit(1.0)) for z in (chi, runs, serial)]
    # text: characters agree more often, classes change less, neighbours are alike
    agree = (f["q"] - n) / (n * (n - 1))
    spread = F.sqrt(2 * TEXT_AGREE * (1 - TEXT_AGREE) / (n * (n - 1)) + 4 * TEXT_SPREAD * (n - 2) / (n * (n - 1)))
    change = (f["r"] - 1 - TEXT_CHANGE * (n - 1)) / F.sqrt(TEXT_CHANGE * (1 - TEXT_CHANGE) * (n - 1))
    alike = (TEXT_SERIAL - f["rho"]) * F.sqrt(n) / (1 - TEXT_SERIAL**2)
    one_sided = [_upper_tail(z) for z in ((TEXT_AGREE - agree) / spread, change, alike)]
    return F.struct(
        f["s"].alias("s"), f["e"].alias("e"), f["encoding"].alias("encoding"), n.cast("long").alias("n"),
        _fisher(two_sided).alias("p_noise"), _fisher(one_sided).alias("p_text"),
    )


def _length_class(n: Column) -> Column:
    return sum(((n >= least).cast("int") for least in LENGTH_CLASSES), F.lit(0))


def _cell(p: Column) -> Column:
    """Cell of -log10 p; the value a cell stands for, 10^(-cell/100), is never below p."""
    return F.least(F.floor(-F.log10(p) * CELLS_PER_DECADE), F.lit(CELLS_PER_DECADE * DECADES)).cast("int")


def thresholds(scanned: DataFrame, level: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Least accepted cell by length class, by the Benjamini-Hochberg rule over all candidates.

    What is gathered is a histogram of at most 7 x 1,201 cells, whatever the input.
    """
    cells = scanned.select(F.explode("candidates").alias("c")).groupBy(_length_class(F.col("c.n")).alias("class"), _cell(F.col("c.p_text")).alias("cell")).count().collect()
    out: dict[int, int] = {}
    for cls in {r["class"] for r in cells}:
        own = sorted(((r["cell"], r["count"]) for r in cells if r["class"] == cls), reverse=True)
        everything, so_far = sum(c for _, c in own), 0
        for cell, count in own:
            so_far += count
            if 10 ** (-cell / CELLS_PER_DECADE) * everything <= level * so_far:
                out[cls] = cell
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``base`` array of (s, k, e) in order, ``found`` array of (s, k, e, encoding, p_noise, p_text).

    k is the place of the kind in KINDS.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    raw = text.select(
        "doc_id",
        F.filter(matches(F.col("_text"), ASSIGN), lambda x: F.char_length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_LEAST).alias("_assign"),
        matches(F.col("_text"), ACCESS).alias("_access"),
        matches(F.col("_text"), HEX).alias("_hex"),
        matches(F.col("_text"), CANDIDATE).alias("_wide"),
    )
    of = lambda c, k: F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    based = raw.select("doc_id", F.array_sort(F.concat(of("_assign", 0), of("_access", 1), of("_hex", 2))).alias("base"), "_wide")
    free = F.filter("_wide", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    scanned = based.select("doc_id", "base", free.alias("_free")).select("doc_id", "base", F.transform("_free", battery).alias("candidates"))
    scanned = materialize(scanned, "secret-candidates")
    least = thresholds(scanned)

    def is_secret(c: Column) -> Column:
        hit = F.lit(False)
        for cls, cell in sorted(least.items()):
            hit = hit | ((_length_class(c["n"]) == cls) & (_cell(c["p_text"]) >= cell))
        return hit & (c["p_noise"] >= NOISE_LEVEL)

    found = F.transform(
        F.filter("candidates", is_secret),
        lambda c: F.struct(c["s"].alias("s"), F.lit(3).alias("k"), c["e"].alias("e"), c["encoding"].alias("encoding"), c["p_noise"].alias("p_noise"), c["p_text"].alias("p_text")),
    )
    return scanned.select("doc_id", "base", found.alias("found"))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    narrow = F.transform("found", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.array_sort(F.concat("base", narrow))).alias("spans"),
    )
