"""The battery against a plain version of its tests, and planted random strings in written text."""

import math
import random
import string

from pyspark.sql import functions as F

from oddsmill.llm import secret_scan as S

ALPHABETS = {"hex": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/"}
WORDS = "the of and to in is that for it was on are with they be at one have this from word but what all were when your can said there use each which she how their will other about out many then them these some her would make like him into time has look two more write see number way could people".split()


def tail(z):
    """Chance that a standard normal value exceeds z."""
    return math.erfc(z / math.sqrt(2)) / 2


def fisher(ps):
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    return math.exp(-half) * (1 + half + half * half / 2)


def plain(token, k):
    """(p_noise, p_text) by the textbook."""
    codes = [S._CODES.index(c) + 1 for c in token]
    n, counts = len(token), [token.count(c) for c in set(token)]
    q = sum(c * c for c in counts)
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in token]
    runs = 1 + sum(a != b for a, b in zip(kind, kind[1:]))
    c2, c3 = (sum(kind.count(x) ** e for x in set(kind)) for e in (2, 3))
    mean = sum(codes) / n
    v = sum((c - mean) ** 2 for c in codes)
    rho = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / v if v else 1.0
    chi = (k / n * q - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    var = max((c2 * (c2 + n * (n + 1)) - 2 * n * c3 - n**3) / (n * n * (n - 1)), 1e-9)
    z_runs = (runs - 1 - (n * n - c2) / n) / math.sqrt(var) if var > 1e-6 else 0.0
    noise = fisher([min(1.0, 2 * tail(abs(z))) for z in (chi, z_runs, (rho + 1 / n) * math.sqrt(n))])
    agree, p = (q - n) / (n * (n - 1)), S.TEXT_AGREE
    spread = math.sqrt(2 * p * (1 - p) / (n * (n - 1)) + 4 * S.TEXT_SPREAD * (n - 2) / (n * (n - 1)))
    change = (runs - 1 - S.TEXT_CHANGE * (n - 1)) / math.sqrt(S.TEXT_CHANGE * (1 - S.TEXT_CHANGE) * (n - 1))
    alike = (S.TEXT_SERIAL - rho) * math.sqrt(n) / (1 - S.TEXT_SERIAL**2)
    return noise, fisher([tail(z) for z in ((p - agree) / spread, change, alike)])


def corpus(seed=11, n=400):
    """(id, text, planted spans): written text with paths and long words, a random key in every fourth."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        say = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(5, 30)))
        text, spans = say(), []
        text += " " + "/".join(rnd.choice(WORDS) for _ in range(8)) + " " + "".join(rnd.choice(WORDS).title() for _ in range(6)) + " " + "-".join(rnd.choice(WORDS) for _ in range(7)) + "-2024 "
        if i % 4 == 0:
            alphabet = ALPHABETS[list(ALPHABETS)[i // 4 % len(ALPHABETS)]]
            key = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(24, 64)))
            spans.append((len(text), len(text) + len(key)))
            text += key + " "
        rows.append((i, text + say(), spans))
    return rows


def test_battery_agrees_with_a_plain_version(spark):
    rnd = random.Random(12)
    tokens = [("".join(rnd.choice(a) for _ in range(n)), name) for name, a in ALPHABETS.items() for n in (20, 33, 64)] + [("getElementsByClassNameOfTheDocument", "base62"), ("some/long/path/of/words/2024", "base64")]
    df = spark.createDataFrame([(t,) for t, _ in tokens], "t string")
    out = df.select("t", S.battery(F.struct(F.lit(0).alias("s"), F.lit(1).alias("e"), F.col("t").alias("m"))).alias("b")).collect()
    size = {"hex": 16, "base32": 32, "base36": 36, "base62": 62, "base64": 64}
    for r in out:
        noise, text = plain(r.t, size[r.b.encoding])
        # the closed form of the normal tail is within a few percent, so combined values are within a quarter in the exponent's scale
        assert abs(math.log10(r.b.p_noise) - math.log10(noise)) < 0.25, (r.t, r.b.p_noise, noise)
        assert abs(math.log10(r.b.p_text) - math.log10(text)) < 0.25, (r.t, r.b.p_text, text)


def test_planted_keys_are_found_and_text_is_left(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    found = {r.doc_id: {(x.s, x.e) for x in [*r.base, *r.found]} for r in S.scan(df).collect()}
    want = {i: set(s) for i, _, s in rows if s}
    caught = sum(bool(want[i] & found[i]) for i in want)
    assert caught >= 0.95 * len(want), caught
    false = [rows[i][1][a:b] for i in found for a, b in found[i] - want.get(i, set())]
    assert len(false) <= 0.02 * len(want), false


def test_accepted_candidates_are_those_of_the_step_up_rule(spark):
    df = spark.createDataFrame([(i, t) for i, t, _ in corpus(13, 200)], "doc_id long, text string")
    rows = S.scan(df).collect()
    scanned = df.select("doc_id", F.transform(S.matches(F.col("text"), S.CANDIDATE), S.battery).alias("candidates"))
    every = [c for r in scanned.collect() for c in r.candidates]
    assert every
    bound = lambda c: min(math.floor(-math.log10(c.p_text) * S.CELLS_PER_DECADE), S.CELLS_PER_DECADE * S.DECADES)
    least = S.thresholds(scanned)
    of = lambda n: sum(n >= x for x in S.LENGTH_CLASSES)
    for cls in {of(c.n) for c in every}:
        own = sorted((10 ** (-bound(c) / S.CELLS_PER_DECADE) for c in every if of(c.n) == cls))
        passing = [p for k, p in enumerate(own, 1) if p * len(own) <= S.FALSE_DISCOVERIES * k]
        if passing:
            assert abs(10 ** (-least[cls] / S.CELLS_PER_DECADE) - max(passing)) < 1e-12
        else:
            assert cls not in least
    assert any(r.found for r in rows)
