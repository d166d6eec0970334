"""String, number and time clean-up as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no identity in a company name, and words that tell places apart.
NAME_STOPWORDS = (
    "the inc incorporated corp corporation co company ltd limited plc group holdings holding sa ag nv se spa s a p l trust reit lp "
    "llc and of class ordinary shares common stock de cv ab asa oyj"
).split()
PLACE_WORDS = (
    "america american americas canada canadian usa australia australian asia pacific europe european uk britain british africa african "
    "mexico brazil latin"
).split()


def clean_ticker(c: Column) -> Column:
    return F.upper(F.trim(c))


def to_number(c: Column) -> Column:
    """``"$1,234.50"`` to 1234.5; NULL when it is not a number."""
    return F.regexp_replace(c, "[$,\\s]", "").try_cast("double")


def symbol_candidates(c: Column) -> Column:
    """Market symbols to try for a listing, in order."""
    s = clean_ticker(c)
    s = F.when(s.endswith(".CSE"), F.regexp_replace(s, "\\.CSE$", ".CN")).otherwise(s)
    many = F.array(*[F.concat(s, F.lit(x)) for x in (".TO", ".V", ".CN", "")])
    return F.when(s.contains("."), F.array(s)).otherwise(many)


def share_class(c: Column) -> Column:
    """Dots of a share class become dashes."""
    return F.replace(F.btrim(c, F.lit(".")), F.lit("."), F.lit("-"))


def split_title(c: Column) -> tuple[Column, Column]:
    """Company and headline around the first " - "."""
    at = F.locate(" - ", c)
    return (F.trim(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)),
            F.trim(F.when(at > 0, F.substring(c, at + 3, F.length(c))).otherwise("")))


def alert_name(c: Column) -> Column:
    """Last part of a subscription name."""
    return F.trim(F.element_at(F.split(F.substring_index(c, " - ", -1), ","), -1))


def compact(c: Column) -> Column:
    """Large numbers as 1.2K, 3.4M or 5.6B."""
    short = lambda d, s: F.concat(F.format_string("%.1f", F.floor(c / d * 10 + 0.5000001) / 10), F.lit(s))
    return F.when(c >= 1e9, short(1e9, "B")).when(c >= 1e6, short(1e6, "M")).when(c >= 1e3, short(1e3, "K")).otherwise(
        F.format_string("%.0f", F.floor(c + 0.5000001)))


def closed_vocabulary(c: Column, allowed: list[str], fallback: str) -> Column:
    """A supplied label if it is in the vocabulary, after trimming and lower-casing."""
    v = F.lower(F.trim(c))
    return F.when(v.isin(allowed), v).otherwise(fallback)


def parse_published(c: Column) -> Column:
    """RFC-822 text to a timestamp; NULL when unreadable.  The weekday is dropped before parsing."""
    body = F.regexp_replace(F.trim(c), "^[A-Za-z]{3},\\s*", "")
    return F.coalesce(F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm Z")))


def toronto_time(instant: Column) -> Column:
    """Wall-clock time in Toronto, whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("America/Toronto"), instant.cast("timestamp_ntz"))


def clock_time(day: Column, text: Column, as_of: Column) -> Column:
    """A 12-hour clock reading on a day, moved to the day before when it is later than ``as_of``."""
    h, m, half = (F.regexp_extract(text, "(\\d{1,2}):(\\d{2})([ap])m", i) for i in (1, 2, 3))
    hour = h.cast("int") % 12 + F.when(half == "p", 12).otherwise(0)
    at = F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), hour, m.cast("int"), F.lit(0).cast("decimal(16,6)"))
    return F.when(at > as_of, at - F.expr("INTERVAL 1 DAY")).otherwise(at)


def name_tokens(c: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin(*NAME_STOPWORDS))


def names_match(a: Column, b: Column) -> Column:
    """Token sets agree: same first token, no differing place word, and enough shared tokens."""
    sa, sb = F.array_distinct(a), F.array_distinct(b)
    differ = F.array_union(F.array_except(sa, sb), F.array_except(sb, sa))
    place = F.arrays_overlap(differ, F.array(*[F.lit(w) for w in PLACE_WORDS]))
    shared, shorter = F.size(F.array_intersect(sa, sb)), F.least(F.size(sa), F.size(sb))
    enough = (shared / F.nullif(shorter, F.lit(0)) >= 0.5) & ((shared >= 2) | (shorter == 1))
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.get(a, F.lit(0)) == F.get(b, F.lit(0))) & ~place & enough


EXCHANGES = "US CN LN AU GR IM SM SW FP BB NA ID PL NO SS DC FH JP JT HK AB AV NZ".split()  # fixed values


def listed_pairs(c: Column) -> Column:
    """Ordered, distinct (symbol, exchange) pairs of ``"LTH AW CN BROS US"``; a symbol without a code has none."""
    tokens = F.filter(F.split(F.trim(c), "\\s+"), lambda w: (w != "...") & (w != ""))
    code = lambda w: w.isin(*EXCHANGES)
    # A token is a code only right after a symbol; two codes in a row make the second a symbol.
    pair = F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.struct(F.get(tokens, i).alias("t"), F.get(tokens, i + 1).alias("n"), i.alias("i")))
    start = F.struct(F.lit(False).alias("used"), F.array().cast("array<struct<symbol:string,exchange:string>>").alias("out"))

    def step(acc, p):
        has = p["n"].isNotNull() & code(p["n"])
        item = F.struct(p["t"].alias("symbol"), F.when(has, p["n"]).otherwise("").alias("exchange"))
        took = F.struct(has.alias("used"), F.concat(acc["out"], F.array(item)).alias("out"))
        return F.when(acc["used"], F.struct(F.lit(False).alias("used"), acc["out"].alias("out"))).otherwise(took)

    return F.array_distinct(F.when(F.size(tokens) > 0, F.aggregate(pair, start, step)["out"]).otherwise(F.array().cast("array<struct<symbol:string,exchange:string>>")))
