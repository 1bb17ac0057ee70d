"""Functions of dates, numbers, hashes, arrays and JSON as Column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def spanish_date(ts: Column) -> Column:
    """6 agosto 2026"""
    return F.concat_ws(" ", F.day(ts).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(ts)), F.year(ts).cast("string"))


def day_renderings(ts: Column, zone: str) -> Column:
    """The day as it can be searched, three ways in UTC (the session's zone) and three in a local zone."""
    both = (ts, F.from_utc_timestamp(ts, zone))
    return F.concat_ws(" ", *[x for at in both for x in (F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "dd/MM/yyyy"), spanish_date(at))])


def date_renderings(ts: Column, zone: str) -> Column:
    """All seven renderings of a time: with its offset, and its day in both zones."""
    return F.concat_ws(" ", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx"), day_renderings(ts, zone))


def day_bucket(ts: Column, today: dt.date) -> Column:
    """today, yesterday, week, month, or the month with its number from 0."""
    days = F.datediff(F.lit(today), F.to_date(ts))
    month = F.concat(F.lit("month:"), F.year(ts).cast("string"), F.lit("-"), (F.month(ts) - 1).cast("string"))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, "week").when(days < 30, "month").otherwise(month)


def in_days(ts: Column, today: dt.date, days: int) -> Column:
    """Within the last ``days`` days, today included; the end is exclusive midnight."""
    first = today - dt.timedelta(days=days - 1)
    return (ts >= F.lit(dt.datetime.combine(first, dt.time()))) & (ts < F.lit(dt.datetime.combine(today + dt.timedelta(days=1), dt.time())))


def month_grid(first: Column) -> Column:
    """42 days from the Monday on or before the first of a month."""
    start = F.date_sub(first, F.weekday(first))
    return F.sequence(start, F.date_add(start, 41))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    length = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x / length)


def root_mean_square(v: Column) -> Column:
    return F.when(F.size(v) > 0, F.sqrt(dot(v, v) / F.size(v))).otherwise(F.lit(0.0))


def peak(v: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0))


def downmixed(channels: Column) -> Column:
    """The mean of channels (array of arrays of one length)."""
    summed = F.aggregate(F.slice(channels, 2, 1 << 20), F.transform(channels[0], lambda x: x.cast("double")), lambda s, c: F.zip_with(s, c, lambda x, y: x + y))
    return F.transform(summed, lambda x: x / F.size(channels))


def resampled(v: Column, rate: Column | int, to: int) -> Column:
    """Linear interpolation to another rate."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    n = F.floor(F.size(v) * to / rate).cast("int")
    at = lambda i: F.get(v, F.least(i, F.size(v) - 1)).cast("double")

    def one(i: Column) -> Column:
        where = i * rate / to
        low = F.floor(where).cast("int")
        return at(low) + (at(low + 1) - at(low)) * (where - low)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<double>"))


def polynomial_hash(text: Column, modulus: int = 100000007, buckets: int = 8) -> Column:
    """h = (31 h + code point) mod modulus over the characters, then mod buckets."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % modulus) % buckets


def fnv1a(text: Column) -> Column:
    """FNV-1a of 64 bits over the UTF-8 bytes, in hex. Halves of 32 bits keep the products in a long."""
    codes = F.transform(F.filter(F.split(F.hex(text.cast("binary")), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("long"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(s: Column, c: Column) -> Column:
        lo = s["lo"].bitwiseXOR(c)
        product = lo * 0x1B3
        hi = (s["hi"] * 0x1B3 + F.shiftright(product, 32) + lo * 256) % (1 << 32)
        return F.struct(hi.alias("hi"), (product % (1 << 32)).alias("lo"))

    return F.aggregate(codes, start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0"))))


def sanitized_tags(tags: Column, chars: int = 24, most: int = 12) -> Column:
    """Collapsed, cut, blanks dropped, each once whatever its case (the first spelling stays), the first ``most``."""
    clean = F.filter(F.transform(tags, lambda t: F.trim(F.left(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(chars)))), lambda t: t != "")
    kept = F.aggregate(clean, F.array().cast("array<string>"), lambda out, t: F.when((F.size(out) >= most) | F.exists(out, lambda o: F.lower(o) == F.lower(t)), out).otherwise(F.array_append(out, t)))
    return kept


def first_field(variant: Column, names: list[str]) -> Column:
    """The first of several field names that an object has, even if its value is blank."""
    return F.coalesce(*[F.get_json_object(variant, f"$.{n}") for n in names])


def blank_to_null(text: Column) -> Column:
    return F.when(~F.lower(F.trim(text)).isin("", "null"), text)


#: Ids of people in a browser have this in their upper 16 bits (a fixed value).
BROWSER_TAG = 0x5745


def is_browser_identifier(user_id: Column) -> Column:
    return F.shiftrightunsigned(user_id, 48) == BROWSER_TAG


def version_key(version: Column) -> Column:
    """Numbers of a version, so that arrays of them sort as versions do; what is no number counts 0."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(F.try_to_number(p, F.lit("999999999")).cast("long"), F.lit(0)))


def relative_day(ts: Column, today: dt.date) -> Column:
    """Hoy or Ayer with the time, else the day."""
    days = F.datediff(F.lit(today), F.to_date(ts))
    return F.when(days > 1, F.date_format(ts, "dd/MM/yyyy")).otherwise(F.concat(F.when(days == 0, "Hoy").otherwise("Ayer"), F.lit(", "), F.date_format(ts, "HH:mm")))


def picked_range(first: Column, last: Column, day: Column) -> Column:
    """(first, last) of a range after a day is picked: the first pick opens, the second closes, a third starts over."""
    opens = first.isNull() | last.isNotNull()
    none = F.lit(None).cast("date")
    return F.when(opens, F.struct(day.alias("first"), none.alias("last"))).otherwise(F.struct(F.least(first, day).alias("first"), F.greatest(first, day).alias("last")))


def calendar_cells(month: Column, first: Column, last: Column, today: dt.date) -> Column:
    """The month's 42 cells, Monday first: (day, outside, edge, inside, is_today, disabled). An open range runs to today."""
    end = F.coalesce(last, F.lit(today))

    def cell(day: Column) -> Column:
        edge = F.coalesce((day == first) | (day == last), F.lit(False))
        inside = F.coalesce((day > first) & ((day < end) | (last.isNull() & (day == F.lit(today)))), F.lit(False))
        return F.struct(day.alias("day"), (F.trunc(day, "month") != F.trunc(month, "month")).alias("outside"), edge.alias("edge"), inside.alias("inside"), (day == F.lit(today)).alias("is_today"), (day > F.lit(today)).alias("disabled"))

    return F.transform(month_grid(F.trunc(month, "month")), cell)


def parsed_time(text: Column, default: Column) -> Column:
    """An RFC 3339 time; where it is none, the default."""
    return F.coalesce(F.try_to_timestamp(text), default)


RATE = 16_000


def to_samples(ms: Column) -> Column:
    return F.floor(ms * RATE / 1000).cast("long")


def to_ms(samples: Column) -> Column:
    return F.floor(samples * 1000 / RATE).cast("long")


def to_float(pcm: Column) -> Column:
    return F.transform(pcm, lambda x: x / F.lit(32768.0))


def to_pcm(v: Column) -> Column:
    """16-bit samples: clamped to -1..1, times 32767, cut towards zero."""
    return F.transform(v, lambda x: (F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) * 32767).cast("int"))


def quietest_split(v: Column, window: int = 160, search: int = 8000) -> Column:
    """Where to cut: the end of the quietest window, of several the first, among those of the last ``search`` samples.

    All samples where there are no more than a window and the search. One array of windows is made and its least
    (energy, place) taken.
    """
    n = F.size(v)
    starts = F.sequence(n - search, n - window - 1, F.lit(window))
    energy = lambda s: F.aggregate(F.slice(v, s + 1, window), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    best = F.array_min(F.transform(starts, lambda s: F.struct(energy(s).alias("energy"), (s + window).alias("end"))))
    return F.when(n <= window + search, n).otherwise(best["end"])


def saturating_minus(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def remaining(elapsed: Column, done: Column, left: Column) -> Column:
    return F.when(done > 0, elapsed / done * left)


def palette_index(user_id: Column, colors: int = 8) -> Column:
    """The upper half of the id times 2^64 / golden ratio, modulo 2^64, modulo the palette; halves keep products in a long.

    The multiplier's halves are fixed values.
    """
    high, low = 0x9E3779B9, 0x7F4A7C15
    a, b = F.shiftrightunsigned(user_id, 32), user_id.bitwiseAND(F.lit(0xFFFFFFFF))
    # b * low is cut into 16-bit steps, as 32 by 32 bits may pass a signed long.
    part = lambda x, y: (F.shiftrightunsigned(x, 16) * y, x.bitwiseAND(F.lit(0xFFFF)) * y)
    top, bottom = part(b, F.lit(low))
    carry = F.shiftrightunsigned(top + F.shiftrightunsigned(bottom, 16), 16)
    modular = lambda x, y: (((F.shiftrightunsigned(x, 16) * y) % (1 << 32)) * 65536 + x.bitwiseAND(F.lit(0xFFFF)) * y) % (1 << 32)
    return ((carry + modular(b, F.lit(high)) + modular(a, F.lit(low))) % (1 << 32) % colors).cast("long")


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA256 in base64 of binary key (64 bytes at most) and message: two hashes over the padded key, as Spark has no such function."""
    codes = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.coalesce(F.conv(F.hex(F.substring(key, i, F.lit(1))), 16, 10).cast("int"), F.lit(0)))
    padded = lambda x: F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(x)).cast("long")), 2, "0")), ""))
    inner = F.unhex(F.sha2(F.concat(padded(0x36), message), 256))
    return F.base64(F.unhex(F.sha2(F.concat(padded(0x5C), inner), 256)))


def upserted(items: Column, item: Column, key: str) -> Column:
    """The array with the item in place of that of its key, or at the end."""
    known = F.exists(items, lambda x: x[key] == item[key])
    return F.when(known, F.transform(items, lambda x: F.when(x[key] == item[key], item).otherwise(x))).otherwise(F.array_append(items, item))


def unique_roster(roster: Column) -> Column:
    """Entries (id, name), the first of each id, or of each name without an id, whatever its case; empty ones go."""
    key = lambda e: F.when(F.trim(e["id"]) != "", F.concat(F.lit("id:"), F.trim(e["id"]))).otherwise(F.concat(F.lit("name:"), F.lower(F.trim(e["name"]))))
    some = F.filter(roster, lambda e: (F.coalesce(F.trim(e["id"]), F.lit("")) != "") | (F.coalesce(F.trim(e["name"]), F.lit("")) != ""))
    return F.filter(some, lambda e, i: F.array_position(F.transform(some, key), key(e)) == i + 1)


def reserved_channel(index: Column) -> Column:
    """The names of the full mix and the local microphone; null for others."""
    return F.when(index == 999, "Sala").when(index == 1000, "Tú")


def frame_channel(slot: Column, local: Column) -> Column:
    """A channel across frames; null out of bounds."""
    return F.when((slot >= 0) & (local >= 0) & (local < 2048), slot * 2048 + local)
