"""Column expressions: patterns, binary fields, formatting, times. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB_8 = 8 * 1024 * 1024


def glob_regex(pattern: str) -> str:
    """A Java regular expression for a shell pattern over a whole path: * and ? cross /, [seq] and [!seq] are classes.

    An opening bracket that is never closed stands for itself; a ] right after the opening belongs to the class.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            first = i + (pattern[i : i + 1] == "!")
            end = pattern.find("]", first + (pattern[first : first + 1] == "]"))
            if end < 0:
                out.append(r"\[")
                continue
            out.append(_char_class(pattern[first:end], negated=first > i))
            i = end + 1
        else:
            out.append(c if c.isalnum() or c in "/_ " else "\\" + c if c.isascii() else c)
    return rf"(?s)\A{''.join(out)}\z"


def _char_class(body: str, negated: bool) -> str:
    items, i = [], 0
    quoted = lambda c: c if c.isalnum() else "\\" + c if c.isascii() and not c.isspace() else c
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            if body[i] <= body[i + 2]:  # an inverted range holds nothing
                items.append(f"{quoted(body[i])}-{quoted(body[i + 2])}")
            i += 3
        else:
            items.append(quoted(body[i]))
            i += 1
    if not items:
        return "." if negated else r"[^\x{0}-\x{10FFFF}]"
    return f"[{'^' if negated else ''}{''.join(items)}]"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def contains_folded(path: Column, part: str) -> Column:
    """Case-insensitive substring; an empty part matches everything."""
    return F.lower(path).contains(part.lower())


def path_filter(path: Column, pattern: str) -> Column:
    """A glob if the pattern has any of * ? [, else a case-insensitive substring."""
    return glob_match(path, pattern) if any(c in pattern for c in "*?[") else contains_folded(path, pattern)


def be_u32(data: Column, at: int) -> Column:
    """Unsigned big-endian 32 bits from 1-based byte `at`."""
    return F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("long")


def be_i32(data: Column, at: int) -> Column:
    u = be_u32(data, at)
    return F.when(u >= 2**31, u - 2**32).otherwise(u).cast("int")


def be_i64(data: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(data, at, 8)), 16, -10).cast("long")


def to_be_i64(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value), 16, "0"))


def pointer(value: Column) -> tuple[Column, Column]:
    """(family, offset) of a packed pointer: 16 and 48 bits."""
    return F.shiftright(value, 48), value.bitwiseAND(F.lit(2**48 - 1))


def bucket_path(bucket: Column) -> Column:
    """Folder and file of a bucket: 2048 buckets to a folder."""
    return F.concat(F.shiftright(bucket, 11).cast("string"), F.lit("/"), bucket.bitwiseAND(F.lit(2047)).cast("string"))


def is_directory(mode: Column) -> Column:
    return F.coalesce(mode, F.lit(0)).bitwiseAND(F.lit(61440)) == 16384


def is_regular(mode: Column) -> Column:
    return F.coalesce(mode, F.lit(0)).bitwiseAND(F.lit(61440)) == 32768


#: Fixed names of the store's side files.
SIDECAR_FOLDER, SIDECAR_ENDINGS = "@eaDir", ("@SynoEAStream", "@SynoResource")


def is_sidecar(name: Column) -> Column:
    out = name == SIDECAR_FOLDER
    for ending in SIDECAR_ENDINGS:
        out = out | name.endswith(ending)
    return out


def human(n: Column) -> Column:
    """Bytes by powers of 1024: whole bytes, else one digit and a unit, T at most; null is 0; less than none by its size."""
    n = F.coalesce(n, F.lit(0)).cast("double")
    size = F.abs(n)
    out = F.concat(F.format_number(n / 1024.0**4, 1), F.lit("T"))
    for power, unit in ((3, "G"), (2, "M"), (1, "K")):
        out = F.when(size < 1024.0 ** (power + 1), F.concat(F.format_number(n / 1024.0**power, 1), F.lit(unit))).otherwise(out)
    return F.when(size < 1024, F.concat(F.format_string("%.0f", n), F.lit("B"))).otherwise(out)


def rate(bps: Column) -> Column:
    """Bytes a second by powers of 1000, with thousands separators, and one digit from 1 to 10 MB/s; null is 0."""
    bps = F.coalesce(bps, F.lit(0)).cast("double")
    fixed = lambda digits, by, unit: F.concat(F.format_number(bps / by, digits), F.lit(f" {unit}"))
    return (
        F.when(bps >= 1e7, fixed(0, 1e6, "MB/s")).when(bps >= 1e6, fixed(1, 1e6, "MB/s")).when(bps >= 1e3, fixed(0, 1e3, "KB/s")).otherwise(fixed(0, 1.0, "B/s"))
    )


def hms(seconds: Column) -> Column:
    """h:mm:ss from an hour on, else mm:ss; never negative; --:-- if unknown."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600).cast("long"), two(F.floor(s % 3600 / 60).cast("long")), two(s % 60)
    known = seconds.isNotNull() & ~F.isnan(seconds.cast("double")) & (F.abs(seconds.cast("double")) != float("inf"))
    return F.when(known, F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), m, F.lit(":"), r)).otherwise(F.concat(m, F.lit(":"), r))).otherwise("--:--")


def grouped(n: Column, width: int = 13) -> Column:
    """A right-aligned number with thousands separators; null is 0."""
    return F.format_string(f"%{width}s", F.format_number(F.coalesce(n, F.lit(0)), 0))


def ellipsis(name: Column, most: int = 44) -> Column:
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 1), F.lit("…"))).otherwise(name)


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def safe_name(name: Column) -> Column:
    """Letters, digits and - . _ stay, anything else becomes _; nothing becomes archive."""
    out = F.regexp_replace(name, r"[^\p{L}\p{N}\-._]", "_")
    return F.when(F.coalesce(out, F.lit("")) == "", "archive").otherwise(out)


#: Fixed codec numbers.
CODECS = {"0": "none", "1": "lz4", "2": "lz4-hc", "4": "zlib"}


def codec_name(kind: Column) -> Column:
    out = F.when(kind.isNull(), "?").otherwise(F.concat(F.lit("unknown("), kind.cast("string"), F.lit(")")))
    for number, name in CODECS.items():
        out = F.when(kind.cast("string") == number, name).otherwise(out)
    return out


def moment_bound(text: Column) -> Column:
    """The last second that a date, minute or second covers, as unix seconds in the session's time zone; null if malformed.

    A day, and after a blank or a T hours and minutes, with or without seconds. A date ends a second before the next local
    midnight, so that days of 23 and 25 hours come out right.
    """
    parts = F.split(F.trim(text), "[ T]", 2)
    day, clock = F.get(parts, 0), F.get(parts, 1)
    date = F.try_to_timestamp(F.when(day.rlike("^[0-9]{4}(-[0-9]{2}){2}$"), day), F.lit("yyyy-MM-dd"))
    whole_day = F.unix_timestamp(F.date_add(F.to_date(date), 1).cast("timestamp")) - 1
    second = F.when(clock.rlike("^[0-9]{2}:[0-9]{2}$"), F.concat(clock, F.lit(":59"))).when(clock.rlike("^([0-9]{2}:){2}[0-9]{2}$"), clock)
    moment = F.unix_timestamp(F.try_to_timestamp(F.concat(day, F.lit(" "), second), F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.when(date.isNotNull(), F.when(clock.isNull(), whole_day).otherwise(moment))


def when_text(seconds: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit("?"))


def iso_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ssxxx")


def unpadded(data: Column) -> Column:
    """PKCS#7 padding of 1 to 16 equal bytes taken off; data without valid padding as it is."""
    n = F.conv(F.hex(F.substring(data, -1, 1)), 16, 10).cast("int")
    size = F.length(data)
    tail = F.hex(F.substring(data, -1, 1))
    padded = (n >= 1) & (n <= 16) & (n <= size) & F.hex(data).endswith(F.repeat(tail, n))
    return F.when(padded, F.substring(data, F.lit(1), size - n)).otherwise(data)
