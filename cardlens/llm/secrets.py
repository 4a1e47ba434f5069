"""Secret scan with DataFrame functions only: three fixed patterns and a randomness test battery.

Match positions come from the pieces between the matches: a split by the pattern gives the gaps, an extraction by the
same pattern gives the matches, and running sums of their lengths give starts and ends in code points.

The battery looks at long tokens. Each is read in the narrowest encoding that holds its characters, and three tests ask
whether it may still be ordinary structured text: chi-squared uniformity over the encoding's alphabet, runs of character
classes, and serial correlation of neighbouring symbols. Their scores are added after each is set against its mean and
spread in structured text of that encoding and length (Stouffer's method with weights). False discoveries are controlled over all tokens of the table (Benjamini-Hochberg on
rounded p-values), separately for classes of token length, as short tokens carry little evidence.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardlens.session import cut_lineage

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]
# Alphabets from narrow to wide, with the sum of squared symbol shares of structured text in them.
ENCODINGS = [
    ("hex", "0123456789abcdef", r"^[0-9a-f]+$", 0.115),
    ("hex_upper", "0123456789ABCDEF", r"^[0-9A-F]+$", 0.115),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+$", 0.066),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789", r"^[a-z0-9]+$", 0.064),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", r"^.+$", 0.060),
]
# Fitted on simulated structured text (words joined in several ways, with numbers between; numbers; 20 to 90 characters): (mean, spread) of the
# scores of uniformity, runs and serial correlation, then the stretch of their sum to a normal tail, each as a, b of
# a + b * sqrt(length).
_HEX_NULL = [((0.36, -0.52), (-0.37, 0.87)), ((-0.04, -0.23), (0.06, 0.26)), ((-0.67, 0.44), (-0.06, 0.25)), (0.6, 0.1)]
STRUCTURED = [
    _HEX_NULL, _HEX_NULL,
    [((0.62, -0.23), (0.93, 0.04)), ((-0.06, -0.13), (1.03, 0.0)), ((-1.15, 0.71), (0.68, 0.0)), (0.95, 0.0)],
    [((-0.1, 0.1), (0.06, 0.26)), ((-0.37, 0.2), (0.13, 0.37)), ((-0.51, 0.54), (0.37, 0.08)), (1.26, 0.035)],
    [((1.2, -0.35), (0.09, 0.24)), ((-0.16, 0.37), (0.26, 0.39)), ((-0.93, 0.64), (0.8, 0.0)), (0.97, 0.05)],
]
WEIGHTS = (1.0, 1.0, 0.5)
SHARED = 0.3          # correlation of uniformity and runs in structured text
LEAST_SPREAD = 0.7
FITTED_LENGTH = 90    # the stretch does not grow beyond
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
SPANS = "array<struct<start:int,end:int>>"
TOKENS = "array<struct<start:int,end:int,size:int,step:int>>"
BLOCK = 256
MASK = "[SECRET]"
FALSE_DISCOVERIES = 0.01
CLASS_CHANGES = 0.15  # share of neighbours of different character class in structured text
CORRELATION = 0.6     # lag-one correlation of structured text
P_STEPS = 20          # rounding of p-values: steps per decade
P_DECADES = 12


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(F.struct(value.alias("v"))), lambda s: use(s["v"]))[0]


def _in_blocks(items: Column) -> Column:
    """An array cut into arrays of ``BLOCK`` items; none for an empty one."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))


def _running(values: Column, step) -> Column:
    """What ``step`` has made of all values before each one, from 0; for few values."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(values, start, lambda acc, v: F.struct(step(acc["at"], v).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")))["all"]


def _located(text: str, matches: str, pattern: str) -> Column:
    """array<struct<start,end>> of the matches in code points.

    Running sums are folded in blocks of ``BLOCK`` matches and the blocks moved by the lengths before them, so the work is
    linear in the matches.
    """
    gaps = F.split(F.col(text), pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), F.col(matches),
                       lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("len")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def within(acc, x):
        start = acc["at"] + x["gap"]
        return F.struct((start + x["len"]).alias("at"), F.array_append(acc["spans"], F.struct(
            start.alias("start"), (start + x["len"]).alias("end"))).alias("spans"))

    def moved(blocks: Column) -> Column:
        offsets = _running(F.transform(blocks, lambda b: b["at"]), lambda a, x: a + x)
        return F.flatten(F.zip_with(blocks, offsets, lambda b, at: F.transform(b["spans"], lambda s: F.struct(
            (s["start"] + at).alias("start"), (s["end"] + at).alias("end")))))

    folded = _once(pairs, lambda p: F.transform(_in_blocks(p), lambda block: F.aggregate(block, empty, within)))
    return F.when(F.size(matches) > 0, _once(folded, moved)).otherwise(F.array().cast(SPANS))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a rational approximation (error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _by_encoding(token: Column, values: list) -> Column:
    pick = values[-1] if isinstance(values[-1], Column) else F.lit(values[-1])
    for (_, _, pattern, _), value in reversed(list(zip(ENCODINGS[:-1], values))):
        pick = F.when(token.rlike(pattern), value).otherwise(pick)
    return pick


def battery(token: Column) -> Column:
    """p-value of a token as structured text, from uniformity, runs and serial correlation together."""
    n = F.char_length(token).cast("double")
    alphabet = _by_encoding(token, [e[1] for e in ENCODINGS])
    kappa = _by_encoding(token, [e[3] for e in ENCODINGS])
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda acc, ch: acc + F.when(ch == "", 0.0).otherwise(
        F.pow(n - F.char_length(F.replace(token, ch, F.lit(""))), 2)))
    size = F.char_length(alphabet).cast("double")
    # Chi-squared over the alphabet against its mean and spread in structured text, where symbols meet with share kappa.
    chi2 = size / n * squares - n
    mean = size * (1 + (n - 1) * kappa) - n
    pairs_var = n * (n - 1) / 2 * kappa * (1 - kappa) + n * (n - 1) * (n - 2) * 0.2 * kappa * kappa
    uniformity = (mean - chi2) / (2 * size / n * F.sqrt(pairs_var))
    # Runs of lower case, upper case, digits and the rest.
    classes = F.translate(token, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
                          "A" * 26 + "a" * 26 + "0" * 10 + "-" * 4)
    changes = F.char_length(F.regexp_replace(classes, r"(.)\1*", "x")).cast("double") - 1
    runs = (changes - CLASS_CHANGES * (n - 1)) / F.sqrt(CLASS_CHANGES * (1 - CLASS_CHANGES) * (n - 1))
    # Lag-one correlation of the symbols' places in the alphabet.
    codes = F.transform(F.filter(F.split(token, ""), lambda ch: ch != ""), lambda ch: F.instr(alphabet, ch).cast("double"))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("last", "s", "ss", "sp")])
    sums = F.aggregate(codes, zero, lambda a, x: F.struct(
        x.alias("last"), (a["s"] + x).alias("s"), (a["ss"] + x * x).alias("ss"), (a["sp"] + a["last"] * x).alias("sp")))
    centred = lambda q: q["ss"] - q["s"] * q["s"] / n
    r = F.transform(F.array(sums), lambda q: F.when(centred(q) <= 0, 0.999).otherwise(F.least(F.lit(0.999), F.abs(
        (q["sp"] - (n - 1) * (q["s"] / n) * (q["s"] / n)) / centred(q)))))[0]
    serial = (math.atanh(CORRELATION) - F.atanh(r)) * F.sqrt(n - 3)

    spread = math.sqrt(sum(w * w for w in WEIGHTS) + 2 * SHARED * WEIGHTS[0] * WEIGHTS[1])
    root = F.sqrt(n)
    # Arrays of one element bind what is used more than once, so that it is worked out once.
    flat = [[x for pair in (*e[0], *e[1], *e[2], e[3]) for x in pair] for e in STRUCTURED]
    chosen = _by_encoding(token, [F.array(*[F.lit(float(x)) for x in e]) for e in flat])

    def together(p: Column) -> Column:
        line = lambda i, at: p[i] + p[i + 1] * at
        scores = [w * (z - line(4 * k, root)) / F.greatest(F.lit(LEAST_SPREAD), line(4 * k + 2, root))
                  for k, (w, z) in enumerate(zip(WEIGHTS, (uniformity, runs, serial)))]
        return (scores[0] + scores[1] + scores[2]) / spread * line(12, F.least(root, F.lit(math.sqrt(FITTED_LENGTH))))

    total = F.transform(F.array(chosen), together)
    return F.transform(total, upper_tail)[0]


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``_base`` (spans of the fixed patterns) and ``_tokens`` (spans with length class and p-value step).

    A NULL text is scanned as an empty one.
    """
    df = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns({
        "_m0": _matches(F.col("_t"), ASSIGN), "_v0": _matches(F.col("_t"), ASSIGN, 2), "_m1": _matches(F.col("_t"), ACCESS),
        "_m2": _matches(F.col("_t"), HEX), "_m3": _matches(F.col("_t"), TOKEN)})
    df = df.withColumns({f"_s{i}": _located("_t", f"_m{i}", p) for i, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))})

    def of_kind(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    long_enough = F.filter("_s0", lambda s, i: F.char_length(F.get("_v0", i)) >= 8)
    step = lambda t: F.least(F.lit(P_STEPS * P_DECADES), F.floor(-F.log10(F.greatest(battery(t), F.lit(1e-300))) * P_STEPS)).cast("int")
    tokens = F.zip_with("_s3", "_m3", lambda s, t: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.floor(F.log2(F.char_length(t).cast("double"))).cast("int").alias("size"), step(t).alias("step")))
    return df.withColumns({
        "_base": F.array_sort(F.concat(of_kind(long_enough, 0), of_kind(F.col("_s1"), 1), of_kind(F.col("_s2"), 2))),
        "_tokens": F.when(F.size("_m3") > 0, tokens).otherwise(F.array().cast(TOKENS)),
    }).drop("_t", "_v0", *[f"_{c}{i}" for i in range(4) for c in "ms"])


def discoveries(scanned: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """(size, least step) for each length class with accepted tokens: the Benjamini-Hochberg limit from counts per step.

    At most a few thousand rows, whatever the size of the table, as steps and classes are bounded.
    """
    counts = scanned.select(F.explode("_tokens").alias("t")).groupBy("t.size", "t.step").agg(F.count("*").alias("n"))
    falling = W.partitionBy("size").orderBy(F.col("step").desc())
    ranked = counts.select("size", "step", F.sum("n").over(falling).alias("found"), F.sum("n").over(W.partitionBy("size")).alias("m"))
    fits = F.pow(F.lit(10.0), -F.col("step") / P_STEPS) <= rate * F.col("found") / F.col("m")
    return ranked.where(fits).groupBy("size").agg(F.min("step").alias("least"))


def accept(scanned: DataFrame, limits: DataFrame) -> DataFrame:
    """``_all``: base spans and accepted tokens, by start, kind and end."""
    one = limits.agg(F.map_from_entries(F.collect_list(F.struct("size", "least"))).alias("m"))
    df = scanned.withColumn("_limits", one.scalar())
    kept = F.filter("_tokens", lambda t: t["step"] >= F.coalesce(F.try_element_at(F.col("_limits"), t["size"]), F.lit(1 << 30)))
    random = F.transform(kept, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return df.withColumn("_all", F.array_sort(F.concat("_base", random))).drop("_limits", "_tokens")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    ``spans`` lists kind:start:end of whole matches in code points, end exclusive, by start, then kind as listed. NULL
    and empty texts give no spans; repeated rows are judged alike and each returned; an empty table gives an empty result; other
    columns are not looked at.
    """
    scanned = cut_lineage(scan(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_x")), "_x").drop("_x"))
    found = accept(scanned, discoveries(scanned))
    count = lambda kind: F.size(F.filter("_all", lambda s: s["kind"] == kind)).cast("long")
    return found.select(F.col("_id").alias(id_col), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), _listed(F.col("_all")).alias("spans"))


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """The same rows and columns; each maximal range of overlapping spans in the text is replaced by ``mask``.

    Rows without spans, NULL texts among them, keep their text.
    """
    limits = discoveries(scan(docs.select(F.col(text_col).alias("_x")), "_x"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_x"))
    found = accept(scan(rows, "_x"), limits)
    text = F.col("_x")

    def block(spans: Column, begin: Column, end: Column) -> Column:
        """Text from ``begin`` to ``end`` with its spans masked; cut from the whole text once."""
        def fold(local: Column) -> Column:
            def step(acc, s):
                between = F.concat(local.substr(acc["at"] - begin + 1, s["start"] - acc["at"]), F.lit(mask))
                return F.struct(F.concat(acc["out"], F.when(s["start"] >= acc["at"], between).otherwise("")).alias("out"),
                                F.greatest(acc["at"], s["end"]).alias("at"))

            return F.aggregate(spans, F.struct(F.lit("").alias("out"), begin.alias("at")), step)["out"]

        return _once(text.substr(begin + 1, end - begin), fold)

    def rebuilt(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
        begins = _running(ends, lambda a, x: F.greatest(a, x))
        edges = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("begin"), F.greatest(a, b).alias("end")))
        joined = F.array_join(F.zip_with(blocks, edges, lambda b, e: block(b, e["begin"], e["end"])), "")
        return F.concat(joined, text.substr(F.array_max(ends) + 1, F.char_length(text)))

    new = F.when(F.size("_all") > 0, _once(_in_blocks(F.col("_all")), rebuilt)).otherwise(text)
    return found.withColumn("_new", new).select(
        *[F.col("_new").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
