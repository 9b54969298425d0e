"""Secret scans in DataFrame expressions only.

Three fixed patterns give the base spans. The method adds long strings that look random: for each, the encoding is
inferred from its signs; a chi-squared statistic of the alphabet's uniformity and the number of runs of sign classes
are compared with what natural text of that length would give, and the lag-1 serial correlation has to be that of
independent signs. The combined p-values are cut by the Benjamini-Hochberg rule within length bands, so short strings,
for which the tests are weak, need the same proof as long ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.session import written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
SIGNS = "A-Za-z0-9+/_=-"
LEAST_LENGTH = 20
CANDIDATE = f"(?<![{SIGNS}])(?=[{SIGNS}]*(?:[0-9]|[a-z][A-Z]))[{SIGNS}]{{{LEAST_LENGTH},}}"
BAND_STARTS = (20, 28, 40, 64, 128)
Q = 0.01
BINS = 400
BINS_PER_DECADE = 20
#: Natural text: the chance that two of its signs agree, the same where only hexadecimal signs occur, and the share of
#: neighbouring signs of different class (case, digit or other).
COINCIDENCE, HEX_COINCIDENCE, CHANGES = 0.06, 0.12, 0.2
SERIAL_Z = 3.3
#: Matches of a text whose places are found together.
STRETCH = 256


def _given(value: Column, body) -> Column:
    """`body(value)`, with `value` computed once also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, pattern: str, gate: Column) -> Column:
    """Array of (start, end, match) of all matches, in code points; `gate` says cheaply whether there can be any.

    Gaps and matches alternate, so running sums of both lengths give the places. First the stretches of `STRETCH` matches
    are added up, then the matches inside each, so no array that grows with the text is copied match by match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("match"))
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def step(done, pair):
        start = done["at"] + pair["gap"]
        end = start + F.length(pair["match"])
        item = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.when(pair["match"].isNull(), done["list"]).otherwise(F.array_append(done["list"], item)).alias("list"))

    def walk(stretch, start):
        return F.aggregate(stretch, F.struct(start.alias("at"), empty.alias("list")), step, lambda done: done["list"])

    def covered(stretch):
        return F.aggregate(stretch, F.lit(0), lambda n, pair: n + pair["gap"] + F.coalesce(F.length(pair["match"]), F.lit(0)))

    def starts(stretches):
        ends = F.aggregate(stretches, F.array(F.lit(0)), lambda done, part: F.array_append(done, F.element_at(done, -1) + covered(part)))
        return _given(ends, lambda e: F.slice(e, F.lit(1), F.size(e) - 1))

    def places(all_pairs):
        firsts = F.sequence(F.lit(1), F.size(all_pairs), F.lit(STRETCH))
        stretches = F.transform(firsts, lambda first: F.slice(all_pairs, first, F.lit(STRETCH)))
        return _given(stretches, lambda parts: F.flatten(F.zip_with(parts, starts(parts), walk)))

    return F.when(gate, _given(pairs, places)).otherwise(empty)


def _phi(z: Column) -> Column:
    """Normal distribution function (logistic form, fine to 2e-4)."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def randomness(value: Column) -> Column:
    """Combined p-value of a string under natural text: small for strings that look random; 1 where signs are correlated."""
    signs = F.split(value, "")
    n = F.length(value).cast("double")
    counts = F.transform(F.array_distinct(signs), lambda c: F.length(value) - F.length(F.replace(value, c, F.lit(""))))
    squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
    size = (F.when(value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$"), 16.0)
            .when(value.rlike("^[A-Z2-7]+=*$"), 32.0).when(value.rlike("^[a-z0-9]+$") | value.rlike("^[A-Z0-9]+$"), 36.0)
            .when(value.rlike("^[A-Za-z0-9]+$"), 62.0).otherwise(64.0))
    excess = size * F.when(size == 16.0, HEX_COINCIDENCE).otherwise(COINCIDENCE) - 1
    statistic = size / n * squares - n
    uniform = _phi((statistic - (size - 1) - n * excess) / F.sqrt(2 * (size - 1) + 4 * n * excess))
    classes = F.translate(value, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", "a" * 26 + "A" * 26 + "0" * 10 + "+" * 5)
    changes = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1
    runs = 1 - _phi((changes - 0.5 - (n - 1) * CHANGES) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES)))
    codes = F.transform(signs, lambda c: F.ascii(c).cast("double"))
    mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n
    spread = F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean))
    length = F.length(value) - 1
    products = F.zip_with(F.slice(codes, F.lit(1), length), F.slice(codes, F.lit(2), length), lambda a, b: (a - mean) * (b - mean))
    serial = F.abs(F.aggregate(products, F.lit(0.0), lambda a, c: a + c)) / spread * F.sqrt(n)
    # Fisher's combination of two tests in closed form.
    joint = -(F.ln(F.greatest(uniform, F.lit(1e-12))) + F.ln(F.greatest(runs, F.lit(1e-12))))
    return F.when((spread > 0) & (serial <= SERIAL_Z), F.exp(-joint) * (1 + joint)).otherwise(1.0)


def _band(length: Column) -> Column:
    band = F.lit(0)
    for i, start in enumerate(BAND_STARTS[1:], 1):
        band = F.when(length >= start, i).otherwise(band)
    return band


def _cuts(scanned: DataFrame) -> dict[int, int]:
    """Least bin of each length band that the Benjamini-Hochberg rule accepts (at most bands x bins counts are gathered)."""
    counted = scanned.select(F.explode("_candidates").alias("c")).groupBy("c.band", "c.bin").count().collect()
    cuts = {}
    for band in range(len(BAND_STARTS)):
        bins = {r["bin"]: r["count"] for r in counted if r["band"] == band}
        total, above = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if total * 10 ** (-b / BINS_PER_DECADE) / above <= Q:
                cuts[band] = b
    return cuts


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` with `secrets`: an array of (start, kind, end), by start and kind, in code points with the end exclusive.

    kind is the place in `KINDS`. A null or empty text has no secrets. One row per input row, so repeated rows and null ids
    stay. Candidates inside a base span add nothing. Only `keep` and the text are read. What is found, not the texts, is
    written to the shared folder before the cut of the p-values is known.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    worded = F.lit(False)
    for word in KEYWORDS:
        worded = worded | F.contains(low, F.lit(word))
    span = "struct<start:int,kind:int,end:int>"

    def base(found: Column, kind: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    assign = F.filter(_matches(t, ASSIGN, worded), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 8)
    access = F.filter(_matches(t, ACCESS, F.contains(t, F.lit("AKIA"))), lambda m: F.length(m["match"]) >= 16)
    hexes = _matches(t, HEX, t.rlike(HEX))

    def judged(m):
        value = F.rtrim(m["match"], F.lit("="))
        score = F.floor(F.least(F.lit(float(BINS)), -F.log10(F.greatest(randomness(value), F.lit(1e-30))) * BINS_PER_DECADE)).cast("int")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), _band(F.length(value)).alias("band"), score.alias("bin"))

    candidates = F.transform(_matches(t, CANDIDATE, t.rlike(CANDIDATE)), judged)
    scanned = docs.select(*keep, F.concat(base(assign, 0), base(access, 1), base(hexes, 2)).cast(f"array<{span}>").alias("_base"),
                          candidates.alias("_candidates"))
    scanned = written(scanned, "secrets")
    cuts = _cuts(scanned)
    least = F.lit(BINS + 1)
    chosen = lambda c: F.coalesce(*[F.when(c["band"] == band, c["bin"] >= cut) for band, cut in cuts.items()], F.lit(False)) if cuts else least < 0
    free = lambda c: ~F.exists("_base", lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"]))
    added = F.transform(F.filter("_candidates", lambda c: chosen(c) & free(c)),
                        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.select(*keep, F.array_sort(F.concat("_base", added.cast(f"array<{span}>"))).alias("secrets"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """All rows and columns with every found span replaced by `mark`; null texts stay null.

    Columns get plain numbers as names on the way, so none can clash with what the scan adds.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, spot = f"c{names.index(text)}", "secrets"
    found = scan(inner, text, tuple(inner.columns))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def join(done, s):
        last = F.element_at(done, -1)
        item = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] > s["start"]),
                      F.array_append(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(F.array_append(done, item))

    merged = F.aggregate(spot, empty, join)
    cut = F.aggregate(F.reverse(merged), F.col(text), lambda t, s: F.concat(
        F.substring(t, F.lit(1), s["start"]), F.lit(mark), F.substring(t, s["end"] + 1, F.length(t))))
    return found.withColumn(text, F.when(F.size(spot) > 0, cut).otherwise(F.col(text))).select(*inner.columns).toDF(*names)
