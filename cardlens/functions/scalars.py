"""Scalar expressions: typing, cleaning, calendar, masks and repeatable imputation. All native columns."""
from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
EPOCH_DAY = dt.date(1970, 1, 1)
DATE_FORMATS = ["yyyy-MM-dd", "dd.MM.yyyy", "yyyy/MM/dd", "dd/MM/yyyy"]
CARD_FACTOR, CARD_SHIFT = 48271, 12345678901  # of the map of card numbers; the factor shares no divisor with 10
DAY_BASES = ["1899-12-30", "1900-01-01", "1970-01-01", "2000-01-01"]
TRUE_WORDS = ["1", "true", "yes"]
REGION_IP_PREFIX = {
    "Tashkent": "185.74.5.", "Samarkand": "185.74.6.", "Bukhara": "185.74.7.", "Namangan": "185.74.8.",
    "Andijan": "185.74.9.", "Fergana": "185.74.10.", "Nukus": "185.74.11.", "Urgench": "185.74.12.",
    "Karshi": "185.74.13.", "Termez": "185.74.14.",
}
ANY_IP_PREFIX = "185.74."


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: Column | str) -> Column:
    """NULL and the empty string both count as missing."""
    return col(c).isNull() | (col(c).cast("string") == "")


def ratio(top: Column, bottom: Column) -> Column:
    """Double division; NULL when the bottom is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(top: Column, bottom: Column) -> Column:
    return ratio(top, bottom) * 100


def mean_of(amount: Column | str) -> Column:
    """Mean as exact decimal sum over count, so the result does not depend on row order."""
    return ratio(F.sum(col(amount)), F.count(col(amount)))


def sum_if(condition: Column, amount: Column | str) -> Column:
    return F.coalesce(F.sum(F.when(condition, col(amount))), F.lit(0))


# ---- typing --------------------------------------------------------------------------------------------------

def parse_date(c: Column | str, fmt: str = "dd.MM.yyyy") -> Column:
    return F.try_to_date(col(c), fmt)


def parse_date_multi(c: Column | str, default: dt.date | None = EPOCH_DAY) -> Column:
    """The known day formats, alone or followed by a time, then compact digits; else the default."""
    text = F.trim(col(c))
    head = F.when(text.rlike(r"^\S{10}([ T]\d{1,2}:\d{2}.*)?$"), F.substring(text, 1, 10))
    tries = [F.try_to_date(head, fmt) for fmt in DATE_FORMATS]
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
    return F.coalesce(*tries, compact, F.lit(default).cast("date"))


def to_float(c: Column | str, default: float | None = 0.0) -> Column:
    number = F.translate(F.trim(col(c).cast("string")), ",", ".").try_cast("double")
    return F.coalesce(number, F.lit(default).cast("double"))


def to_int(c: Column | str, default: int | None = 0) -> Column:
    whole = F.trim(col(c).cast("string")).try_cast("double").try_cast("bigint")
    return F.coalesce(whole, F.lit(default).cast("bigint"))


def to_money(c: Column | str) -> Column:
    """Exact money from text with either decimal mark; NULL when it is no number."""
    return F.translate(F.trim(col(c).cast("string")), ",", ".").try_cast("decimal(18,2)")


def cast_or_null(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    return df.withColumns({name: F.col(name).try_cast(kind) for name, kind in spec.items()})


def cast_or_default(df: DataFrame, spec: Mapping[str, tuple[str, object]]) -> DataFrame:
    return df.withColumns({
        name: F.coalesce(F.col(name).try_cast(kind), F.lit(default).cast(kind))
        for name, (kind, default) in spec.items()
    })


def clean_mcc(c: Column | str) -> Column:
    """First run of digits as a code; 0 when there is none."""
    return F.coalesce(F.regexp_extract(col(c).cast("string"), r"(\d+)", 1).try_cast("int"), F.lit(0))


def bool_to_flag(c: Column | str) -> Column:
    return F.when(F.lower(F.trim(col(c).cast("string"))).isin(*TRUE_WORDS), 1).otherwise(0)


# ---- filling -------------------------------------------------------------------------------------------------

def impute_median_unknown(df: DataFrame, numbers: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Missing numbers become the exact median of their column, missing texts ``Unknown``.

    The columns are the groups of one quantile job.
    """
    from cardlens.functions.distributed import wide_percentiles, with_scalars

    out = df
    if numbers:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], list(numbers), "column", "v")
        medians = wide_percentiles(long, ["column"], "v", {"median": 0.5})
        row = medians.agg(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in numbers])
        out = with_scalars(out, "_median", row).withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.col("_median")[c]) for c in numbers}).drop("_median")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in texts})


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constant per column; a missing text is also the empty string."""
    kinds = dict(df.dtypes)
    fills = {}
    for name, value in values.items():
        blank = is_missing(name) if kinds[name] == "string" else F.col(name).isNull()
        fills[name] = F.when(blank, F.lit(value).cast(kinds[name])).otherwise(F.col(name))
    return df.withColumns(fills)


def normalize_strings(df: DataFrame, upper: Sequence[str] = (), trim: Sequence[str] = ()) -> DataFrame:
    """Trim all named columns, upper-case some, and turn a value that is wholly ``nan`` into ''."""
    def tidy(name: str) -> Column:
        text = F.trim(F.col(name))
        text = F.when(F.lower(text) == "nan", "").otherwise(text)
        return F.upper(text) if name in upper else text

    return df.withColumns({name: tidy(name) for name in dict.fromkeys([*upper, *trim])})


def hash_number(key: Column | str, salt: str = "") -> Column:
    """A number below 2^32 that depends on the key (and salt) only."""
    text = F.concat(col(key).cast("string"), F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_impute(c: Column | str, allowed: Sequence, key: Column | str, missing: Column | None = None) -> Column:
    """Replace missing values by a choice from the allowed set that depends on the row key only."""
    options = F.array(*[F.lit(a) for a in allowed])
    pick = F.element_at(options, (hash_number(key) % len(allowed) + 1).cast("int"))
    return F.when(is_missing(c) if missing is None else missing, pick).otherwise(col(c))


def region_ip_fill(ip: Column | str, region: Column | str, key: Column | str, missing: Column | None = None) -> Column:
    """Missing address from the region's prefix, or the general prefix; last parts are hashed from the key."""
    prefixes = F.create_map(*[F.lit(x) for pair in REGION_IP_PREFIX.items() for x in pair])
    octet = lambda salt: (hash_number(key, salt) % 254 + 1).cast("string")
    general = F.concat(F.lit(ANY_IP_PREFIX), octet("a"), F.lit("."), octet("b"))
    known = F.concat(F.try_element_at(prefixes, col(region)), octet("b"))
    return F.when(is_missing(ip) if missing is None else missing, F.coalesce(known, general)).otherwise(col(ip))


def luhn_digit(body: Column) -> Column:
    """The check digit that makes a text of digits pass ``luhn_valid``."""
    digits = F.reverse(F.filter(F.split(body, ""), lambda d: d != ""))
    weigh = lambda d, i: F.when(i % 2 == 1, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.transform(digits, lambda d, i: weigh(d.cast("int"), i)), F.lit(0), lambda acc, d: acc + d)
    return ((10 - total % 10) % 10).cast("string")


def hash_card(key: Column | str, prefix: str = "8600", other_prefix: str = "8601") -> Column:
    """A repeatable 16-digit stand-in with a valid check digit for an unusable card number; equal keys keep equal cards.

    Whole numbers below 10^11 are spread by a one-to-one map, so different ones never meet. Other keys get eleven hashed
    digits behind a prefix of their own.
    """
    text = col(key).cast("string")
    number = F.when(text.rlike(r"^(0|[1-9]\d{0,10})$"), text.try_cast("bigint"))
    spread = F.lpad(((number * CARD_FACTOR + CARD_SHIFT) % 10 ** 11).cast("string"), 11, "0")
    hashed = F.concat(F.lpad(hash_number(key, "x").cast("string"), 10, "0"), (hash_number(key, "y") % 10).cast("string"))
    body = F.when(number.isNotNull(), F.concat(F.lit(prefix), spread)).otherwise(F.concat(F.lit(other_prefix), hashed))
    return F.transform(F.array(body), lambda b: F.concat(b, luhn_digit(b)))[0]


def unique_txn_code(stamp: Column | str, card: Column | str, row_id: Column | str) -> Column:
    """TXN-<time>-<last four of the card>-<row id>; the row id makes it unique and repeatable."""
    last4 = F.coalesce(F.right(col(card), F.lit(4)), F.lit("0000"))
    return F.concat_ws("-", F.lit("TXN"), F.date_format(col(stamp), "yyyyMMddHHmmss"), last4,
                       F.substring(F.sha2(col(row_id).cast("string"), 256), 1, 16))


# ---- calendar ------------------------------------------------------------------------------------------------

def day_number_to_date(c: Column | str, base: str = "1900-01-01") -> Column:
    return F.date_add(F.lit(base).cast("date"), col(c).cast("int"))


def epoch_weekend_flag(c: Column | str) -> Column:
    return (F.weekday(F.timestamp_seconds(col(c))) >= 5).cast("int")


def truncate_time(c: Column | str, unit: str) -> Column:
    """minute, hour, day, week (Monday), month, year, or ``yyyymm`` as text."""
    if unit == "yyyymm":
        return F.date_format(col(c), "yyyyMM")
    cut = F.date_trunc(unit, col(c))
    return cut.cast("date") if unit in ("day", "week", "month", "year") else cut


def day_diff(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(col(later), col(earlier))


def add_days(c: Column | str, days: int) -> Column:
    return F.date_add(col(c), days)


def is_night(hour: Column | str = "hour_num") -> Column:
    return (col(hour) >= 22) | (col(hour) <= 6)


def is_weekend(day: Column | str = "transaction_date") -> Column:
    return F.weekday(col(day)) >= 5


def calendar_flags(df: DataFrame, risky_mcc: Sequence[int], capital: str) -> DataFrame:
    return df.withColumns({
        "is_weekend": is_weekend().cast("int"),
        "is_night": is_night().cast("int"),
        "is_capital": F.coalesce((F.col("emitent_region") == capital).cast("int"), F.lit(0)),
        "is_risky_mcc": F.coalesce(F.col("mcc").isin(*risky_mcc).cast("int"), F.lit(0)),
    })


# ---- choices by what the frame offers ------------------------------------------------------------------------

def hour_expr(df: DataFrame) -> Column:
    """``hour_num`` where it parses, else the hour of the timestamp."""
    choices = []
    if "hour_num" in df.columns:
        choices.append(F.col("hour_num").try_cast("int"))
    if "transaction_time" in df.columns:
        choices.append(F.hour("transaction_time"))
    if not choices:
        raise ValueError("the frame has neither hour_num nor transaction_time")
    return F.coalesce(*choices)


def merchant_key(df: DataFrame) -> Column:
    """Merchant id where there is one, else the lower-cased name: one key for both sides of a join."""
    names = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in ("merchant", "merchant_id") if n in df.columns][:1]
    if "merchant_name" in df.columns:
        names.append(F.lower("merchant_name"))
    return F.coalesce(*names)


def mcc_label(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join to (mcc, label); codes without a label read ``MCC <code>``."""
    named = df.join(labels.select("mcc", F.col("label").alias("_label")), "mcc", "left")
    text = F.coalesce(F.col("_label"), F.concat(F.lit("MCC "), F.col("mcc").cast("string")))
    return named.withColumn("mcc_label", text).drop("_label")


# ---- others --------------------------------------------------------------------------------------------------

def log_amount(c: Column | str) -> Column:
    return F.log10(col(c).cast("double") + 1)


def split_rfm_code(c: Column | str = "rfm_score") -> list[Column]:
    return [F.substring(col(c), 1, 1).alias("R"), F.substring(col(c), 2, 1).alias("F")]


def luhn_valid(c: Column | str) -> Column:
    """Check digit test: from the right, every second digit is doubled and its digits are summed."""
    text = col(c)
    digits = F.reverse(F.transform(F.split(text, ""), lambda d: d.try_cast("int")))
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    weighed = F.transform(digits, lambda d, i: F.when(i % 2 == 1, doubled(d)).otherwise(d))
    total = F.aggregate(weighed, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0)))
    return F.coalesce(text.rlike(r"^\d{2,}$") & (total % 10 == 0), F.lit(False))


def filter_transactions(df: DataFrame, *, banks: Sequence[str] | None = None, mccs: Sequence[int] | None = None,
                        not_mccs: Sequence[int] | None = None, p2p: bool | None = None, company: str | None = None,
                        date_from=None, date_to=None, not_empty: Sequence[str] = ()) -> DataFrame:
    """Optional filters joined by AND; each becomes one pushable predicate."""
    tests: list[Column] = []
    if banks:
        tests.append(F.col("emitent_bank").isin(*banks))
    if mccs:
        tests.append(F.col("mcc").isin(*mccs))
    if not_mccs:
        tests.append(~F.col("mcc").isin(*not_mccs))
    if p2p is not None:
        tests.append(F.col("p2p_flag") == int(p2p))
    if company:
        tests.append(F.col("company_id") == company)
    if date_from is not None:
        tests.append(F.col("transaction_date") >= day(date_from))
    if date_to is not None:
        tests.append(F.col("transaction_date") <= day(date_to))
    tests += [~is_missing(name) for name in not_empty]
    return df.where(reduce(and_, tests)) if tests else df


def day(value) -> Column:
    """A day given as a column, a date or ISO text."""
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def newest_day(df: DataFrame, as_of=None, date_col: str = "transaction_date") -> Column:
    """The anchor day: the given one, else the newest day of the frame as a scalar subquery."""
    return df.agg(F.max(date_col)).scalar() if as_of is None else day(as_of)


def anchored_filter(df: DataFrame, days: int, end=None, date_col: str = "transaction_date") -> DataFrame:
    """Rows from ``end - days`` to ``end``, both included."""
    last = newest_day(df, end, date_col)
    return df.where(F.col(date_col).between(F.date_sub(last, days), last))
