"""Timestamps of mixed formats, precisions and zones to one UTC instant.

A text is read by anchored patterns into wall time, offset and zone name (Arrow batches); zones are applied in the JVM. A text's own zone or offset wins over everything. A text without
one is wall time of the row's zone history; `estimate_zones` finds that history where no valid zone is declared: it learns from
the texts that name their instant how late rows are loaded, converts the local times of a group by every history of the time
zone database, and chooses the one whose lateness fits best, with the violations that are left.

Defined results: null, blank and unreadable texts, impossible dates (month 13, 31 June), dates or times alone, and wall times
skipped by a zone change give null; 24:00:00 is the next midnight; finer digits than microseconds are cut; a wall time that
occurs twice is the earlier instant; an unknown zone name gives null; ties between candidates go to the first named.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Month names (English, German, French, Spanish, Portuguese, Italian, Dutch), each spelling with its month.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene janeiro gennaio gen januari",
    2: "february feb februar février fevrier févr fevr febrero fevereiro fev febbraio februari",
    3: "march mar märz maerz mrz mars marzo março marco mrt maart",
    4: "april apr avril avr abril abr aprile",
    5: "may mai mayo maio maggio mag mei",
    6: "june jun juni juin junio junho giugno giu",
    7: "july jul juli juillet juil julio julho luglio lug",
    8: "august aug août aout agosto ago augustus",
    9: "september sept sep septembre septiembre setembro set settembre",
    10: "october oct oktober okt octobre octubre outubro out ottobre ott",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember dez décembre déc decembre diciembre dic dezembro dicembre",
}
# Zone letters and their offsets in minutes (usual US, European and Japanese ones).
ZONE_LETTERS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "WET": 0, "WEST": 60, "BST": 60, "CET": 60,
    "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540,
}
#: Unix times are read as such if they lie within these years.
PLAUSIBLE = ("1980-01-01", "2100-01-01")
DAY_US = 86_400_000_000

_ZONE = r"\s*(Z|z|[A-Za-z]{2,5}|[A-Za-z]+/[A-Za-z0-9_+/-]+|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?)?(?:\s*\[([A-Za-z0-9_+/-]+)\])?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_AP = r"(?:\s*([AaPp])\.?[Mm]\b\.?)?"
_WD = r"(?:[^\W\d_]{2,10}\.?,?\s+)?"
_MON = r"([^\W\d_]{3,10})\.?"
_LONG = r"(?:(?:à|a|at|um|às|alle|om)\s+(?:las\s+)?)?"
#: (pattern, (unused, places)): places are the groups of year, month, day, hour, minute, second, digits, am-pm, zone, bracketed
#: zone; a pair puts a marker before a group (`d` day of the year, `w` ISO week).
_SHAPES = [
    (rf"(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})[Tt ] ?{_TIME}{_AP}{_ZONE}$", ("", (1, 2, 3, 4, 5, 6, 7, 8, 9, 10))),
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})[Tt]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE}$", ("", (1, 2, 3, 4, 5, 6, 7, None, 8, 9))),
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}}):?(\d{{2}}){_ZONE}$", ("", (1, 2, 3, 4, 5, None, None, None, 6, 7))),
    (rf"(\d{{4}})-?(\d{{3}})[Tt ]{_TIME}{_ZONE}$", ("d", (1, "=", 2, 3, 4, 5, 6, None, 7, 8))),
    (rf"(\d{{4}})-?[Ww](\d{{2}})-?(\d)[Tt ]{_TIME}{_ZONE}$", ("", (1, ("w", 2), 3, 4, 5, 6, 7, None, 8, 9))),
    (rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? (?:at )?{_TIME}{_AP}{_ZONE}$", ("", (3, 1, 2, 4, 5, 6, 7, 8, 9, 10))),
    (rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? (?:um )?{_TIME}(?: ?Uhr)?{_ZONE}$", ("", (3, 2, 1, 4, 5, 6, 7, None, 8, 9))),
    (rf"{_WD}(\d{{1,2}})(?:\.|er|º|st|nd|rd|th)? (?:de )?{_MON},? (?:de )?(\d{{4}}),? {_LONG}(\d{{1,2}})(?::| ?h ?)(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?{_AP}(?: ?Uhr)?{_ZONE}$", ("", (3, 2, 1, 4, 5, 6, 7, 8, 9, 10))),
    (rf"{_WD}{_MON} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}),? (?:at )?{_TIME}{_AP}{_ZONE}$", ("", (3, 1, 2, 4, 5, 6, 7, 8, 9, 10))),
]


def zone_names(spark: SparkSession) -> list[str]:
    """Names that the JVM converts by; a fixed list of some hundreds, used as a set literal."""
    try:
        return sorted(str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())
    except Exception:  # a client without a JVM
        import zoneinfo

        return sorted(zoneinfo.available_timezones() - {"Factory", "localtime"})


def _reader():
    """text -> (wall_us, unix_us, offset_min, zone); built once per Python worker."""
    import re
    from datetime import date

    shapes = [(re.compile(p), order) for p, order in _SHAPES]
    months = {n: m for m, names in MONTHS.items() for n in names.split()}
    trim, blanks = re.compile("^[\\s\u200b\ufeff]+|[\\s\u200b\ufeff]+$"), re.compile(r"\s+")
    digits, offset = re.compile(r"(\d{9,20})(?:[.,](\d+))?$"), re.compile(r"(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?$")
    epoch = date(1970, 1, 1).toordinal()
    lo, hi = ((date.fromisoformat(d).toordinal() - epoch) * DAY_US for d in PLAUSIBLE)
    none = (None, None, None, None)

    def day_number(y: int, mo: str, d: int):
        if mo == "d":
            at = date(y, 1, 1).toordinal() + d - 1
            return at if 1 <= d and at < date(y + 1, 1, 1).toordinal() else None
        if mo.startswith("w"):
            return date.fromisocalendar(y, int(mo[1:]), d).toordinal()
        m = int(mo) if mo.isdigit() else months.get(mo.lower())
        return m and date(y, m, d).toordinal()

    def read(text):
        s = blanks.sub(" ", trim.sub("", text)).translate({0x2212: "-", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-"})
        if not s.isascii() and not any(c.isdigit() for c in s):
            return none
        m = digits.match(s)
        if m and (len(m[1]) != 14 or m[2]):
            n, frac = len(m[1]), ((m[2] or "") + "000000")[:6]
            us = int(m[1]) * 10**6 + int(frac) if n <= 11 else int(m[1]) * 1000 + int(frac[:3]) if n <= 13 else int(m[1]) if n <= 17 else int(m[1]) // 1000
            return (None, us, None, None) if lo <= us < hi else none
        for pattern, order in shapes:
            if m := pattern.match(s):
                break
        else:
            return none
        y, mo, d, h, mi, sec, frac, ap, z, bracket = (None if k is None else order[0] if k == "=" else (m[k] if isinstance(k, int) else k[0] + (m[k[1]] or "")) for k in order[1])
        try:
            day = day_number(int(y), mo, int(d))
        except ValueError:
            return none
        h, mi, sec, us = int(h), int(mi), int(sec or 0), int(((frac or "") + "000000")[:6])
        if ap:
            h = h % 12 + (12 if ap in "pP" else 0) if 1 <= h <= 12 else 99
        if not day or mi > 59 or sec > 59 or h > 23 and (h, mi, sec, us, ap) != (24, 0, 0, 0, None):
            return none
        wall = (day - epoch) * DAY_US + ((h * 60 + mi) * 60 + sec) * 10**6 + us
        if not z:
            return (wall, None, None, bracket)
        if o := offset.match(z):
            minutes = int(o[2]) * 60 + int(o[3] or 0)
            return (wall, None, -minutes if o[1] == "-" else minutes, None) if minutes <= 1080 else none
        if "/" in z:
            return (wall, None, None, z)
        letters = ZONE_LETTERS.get(z.upper())
        return none if letters is None else (wall, None, letters, None)

    return read


def read_text(df: DataFrame, text: str, out: str = "t") -> DataFrame:
    """Adds struct `out`: wall_us (microseconds of the wall time as if UTC), unix_us, offset_min, zone; all null if unreadable.

    Arrow batches in Python: as built-in expressions the nine shapes outgrow generated code. No shuffle; distinct texts of a
    batch are read once.
    """
    state: list = []

    @F.pandas_udf("wall_us long, unix_us long, offset_min int, zone string")
    def parse(texts: pd.Series) -> pd.DataFrame:
        if not state:
            state.append(_reader())
        seen = {t: state[0](t) for t in texts.dropna().unique()}
        none = (None, None, None, None)
        rows = [seen[t] if isinstance(t, str) else none for t in texts]
        cols = list(zip(*rows)) or [[], [], [], []]
        return pd.DataFrame({"wall_us": pd.array(cols[0], dtype="Int64"), "unix_us": pd.array(cols[1], dtype="Int64"), "offset_min": pd.array(cols[2], dtype="Int32"), "zone": pd.Series(cols[3], dtype="object")})

    # Not declared deterministic, else a filter on the result would run it a second time.
    return df.withColumn(out, parse.asNondeterministic()(F.col(text)))


def wall_to_utc(wall_us: Column, zone: Column, known: list[str]) -> Column:
    """UTC microseconds of a wall time in a named zone: the earlier of two, null if skipped or the zone is unknown."""
    ok = F.when(zone.isin(known), zone)
    local = F.timestamp_micros(wall_us)
    utc = F.to_utc_timestamp(local, ok)
    return F.when(F.unix_micros(F.from_utc_timestamp(utc, ok)) == wall_us, F.unix_micros(utc))


def normalise(df: DataFrame, text: str, zone: str, default_zone: str = "UTC", out: str = "utc_us", estimates: DataFrame | None = None) -> DataFrame:
    """Adds `out`, the instant in microseconds UTC. `zone` is the column with the row's declared zone.

    A row whose declared zone is no name of the time zone database takes the zone of its group in `estimates` (from
    `estimate_zones`, grouped by columns of `df`), if given; else it gets null.
    """
    known = zone_names(df.sparkSession)
    df = read_text(df, text, "__t")
    name = F.coalesce(F.col("__t.zone"), F.when(F.trim(zone) != "", F.trim(zone)), F.lit(default_zone))
    if estimates is not None:
        by = [c for c in estimates.columns if c not in ("zone", "n", "violations")]
        e = estimates.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("zone").alias("__zone"))
        cond = [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in by]
        df = df.join(e, cond, "left").drop(*[f"__{c}" for c in by])
        name = F.when(F.col("__t.zone").isNull() & ~name.isin(known), F.coalesce("__zone", name)).otherwise(name)
    us = F.coalesce(
        F.col("__t.unix_us"),
        F.when(F.col("__t.offset_min").isNotNull(), F.col("__t.wall_us") - F.col("__t.offset_min").cast("bigint") * 60_000_000)
        .otherwise(F.when(name == "UTC", F.col("__t.wall_us")).otherwise(wall_to_utc(F.col("__t.wall_us"), name, known))),
    )
    return df.withColumn(out, us).drop("__t", "__zone")


def histories(first_year: int, last_year: int, prefer: tuple[str, ...] = ()) -> list[tuple[str, list[int], list[int]]]:
    """The different offset histories of the time zone database between two years: (name, changes, offsets), in microseconds.

    Zones that agree throughout are one history, under the first of `prefer` among them, else the first in the alphabet; UTC is one.
    """
    import zoneinfo
    from datetime import datetime, timedelta, timezone

    def offset(zone, at: int) -> int:
        return int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=at)).astimezone(zone).utcoffset().total_seconds())

    lo, hi = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (first_year, last_year + 1))
    rank = {n: i for i, n in enumerate(prefer)}
    names = sorted((n for n in zoneinfo.available_timezones() if "/" in n and not n.startswith(("Etc/", "SystemV/", "posix", "right")) or n == "UTC"), key=lambda n: (rank.get(n, len(rank)), n != "UTC", n))
    seen: dict[tuple, tuple] = {}
    for n in names:
        zone = zoneinfo.ZoneInfo(n)
        changes, offsets = [], [offset(zone, lo)]
        for day in range(lo, hi, 10 * 86_400):
            end = min(hi, day + 10 * 86_400)
            if offset(zone, end) != offsets[-1]:
                x, y = day, end
                while y - x > 1:
                    mid = (x + y) // 2
                    x, y = (mid, y) if offset(zone, mid) == offsets[-1] else (x, mid)
                changes.append(y)
                offsets.append(offset(zone, y))
        seen.setdefault((tuple(changes), tuple(offsets)), (n, [c * 10**6 for c in changes], [o * 10**6 for o in offsets]))
    return list(seen.values())


def _to_utc(wall: np.ndarray, changes: list[int], offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(instants, which are real): the earlier of two, unreal in a gap."""
    edges = [-(1 << 62), *changes, 1 << 62]
    out, ok = np.zeros_like(wall), np.zeros(len(wall), bool)
    for k, o in enumerate(offsets):
        us = wall - o
        fits = ~ok & (us >= edges[k]) & (us < edges[k + 1])
        out[fits], ok = us[fits], ok | fits
    return out, ok


_HOUR, _BINS = 3_600_000_000, 24 * 45
#: Log chances: of a wall time that its zone skips, and of a history that is none of the preferred ones.
_GAP, _RARE = -6.0, -4.0


def _bin(lag_us: np.ndarray) -> np.ndarray:
    """Half hours of lateness up to 45 days either way, all beyond in the outermost."""
    return np.clip(np.floor_divide(lag_us, _HOUR // 2), -2 * _BINS, 2 * _BINS).astype(np.int64)


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Batches with what their texts say: wall_us, unix_us, offset_min, zone; rows without a text or load time left out."""
    read = _reader()
    for b in batches:
        b = b[b["t"].notna() & b["l"].notna()]
        said = {t: read(t) for t in b["t"].unique()}
        yield b, pd.DataFrame([said[t] for t in b["t"]], columns=["wall", "unix", "offset", "zone"], index=b.index)


def estimate_zones(df: DataFrame, group: list[str], text: str, loaded_at: str, source: list[str], prefer: tuple[str, ...] = (), years: tuple[int, int] | None = None) -> DataFrame:
    """The offset history of each group that its load times fit best: (group..., zone, n, violations).

    How late rows of a `source` (a few columns of `group`) are loaded is learned from its texts that name their instant themselves,
    with an offset or in Unix time. Every history of the time zone database converts the texts without zone of a group; the one
    under which the resulting lateness is likeliest is chosen, and `violations` counts the texts that fall into a gap of it or
    are loaded earlier or later than all but one in a hundred. Both passes count within each task first, so a group with a third
    of all rows is no hot task; candidates are the some hundred different histories of the years at hand.
    """
    src = df.select(*group, F.col(text).alias("t"), F.unix_micros(F.col(loaded_at).cast("timestamp")).alias("l"))
    if years is None:
        lo, hi = src.agg(F.min("l"), F.max("l")).first()
        if lo is None:
            years = (2000, 2000)
        else:
            years = tuple(1970 + int(x / (365.2425 * DAY_US)) + d for x, d in ((lo, -1), (hi, 1)))
    found = histories(*years, prefer)
    keyed = src.select(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in source]).alias("s"), F.to_json(F.struct(*group), {"ignoreNullFields": "false"}).alias("g"), "t", "l")

    def late(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, said in _batches(batches):
            us = said["unix"].astype("Float64").fillna(said["wall"].astype("Float64") - said["offset"].astype("Float64") * 60_000_000)
            sure = us.notna().to_numpy()
            bins = _bin(b["l"].to_numpy(np.int64)[sure] - us[sure].to_numpy(np.float64).astype(np.int64))
            yield pd.DataFrame({"s": b["s"][sure], "bin": bins}).groupby(["s", "bin"]).size().rename("n").reset_index()

    known = keyed.mapInPandas(late, "s string, bin long, n long").groupBy("s", "bin").agg(F.sum("n").alias("n"))
    seen: dict[str, np.ndarray] = {}
    for r in known.collect():  # at most the half hours of 90 days per source
        seen.setdefault(r.s, np.zeros(4 * _BINS + 1))[r.bin + 2 * _BINS] += r.n

    def learn(n: np.ndarray, width: int = 3) -> tuple[np.ndarray, int, int]:
        smooth = np.convolve(n, np.ones(width) / width, mode="same") + 0.01 * n.sum() / len(n) + 1e-3
        share = np.cumsum(n) / n.sum()
        return np.log(smooth / smooth.sum()), int(np.searchsorted(share, 0.005)) - 2 * _BINS, int(np.searchsorted(share, 0.995)) - 2 * _BINS

    # Without any sure text a source is taken to be loaded the likelier the sooner, half of it within eight hours.
    plain = np.zeros(4 * _BINS + 1)
    plain[2 * _BINS :] = 0.5 ** (np.arange(2 * _BINS + 1) / 16)
    sent = df.sparkSession.sparkContext.broadcast(({s: learn(n) for s, n in seen.items()}, learn(plain, 1), found))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lateness, default, zones = sent.value
        for b, said in _batches(batches):
            open_ = (said["wall"].notna() & said["offset"].isna() & said["zone"].isna()).to_numpy()
            if not open_.any():
                continue
            b, wall = b[open_], said["wall"][open_].astype("Int64").to_numpy(np.int64)
            load, out = b["l"].to_numpy(np.int64), []
            for i, (_, changes, offsets) in enumerate(zones):
                us, real = _to_utc(wall, changes, offsets)
                bins = _bin(load - us)
                fit, bad = np.full(len(b), _GAP), ~real
                for s in b["s"].unique():
                    mine = (b["s"] == s).to_numpy()
                    logs, lo, hi = lateness.get(s, default)
                    at = mine & real
                    fit[at] = logs[bins[at] + 2 * _BINS]
                    bad |= mine & ((bins < lo) | (bins > hi))
                out.append(pd.DataFrame({"g": b["g"].to_numpy(), "i": i, "fit": fit, "bad": bad}).groupby(["g", "i"]).agg(n=("fit", "size"), fit=("fit", "sum"), bad=("bad", "sum")).reset_index())
            yield pd.concat(out)

    total = keyed.mapInPandas(score, "g string, i long, n long, fit double, bad long").groupBy("g", "i").agg(F.sum("n").alias("n"), F.sum("fit").alias("fit"), F.sum("bad").alias("bad"))
    rare = F.when(F.col("i").isin([i for i, (n, _, _) in enumerate(found) if n in prefer]), 0.0).otherwise(_RARE)
    best = total.groupBy("g").agg(F.max_by(F.struct("n", "bad", "i"), F.struct(F.round(F.col("fit") + rare, 6), -F.col("i"))).alias("b"))
    names = F.array(*[F.lit(n) for n, _, _ in found])
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*group).dtypes)
    return best.select(F.from_json("g", schema).alias("g"), names[F.col("b.i").cast("int")].alias("zone"), F.col("b.n").alias("n"), F.col("b.bad").alias("violations")).select("g.*", "zone", "n", "violations")


def time_texts(calls: DataFrame, cases: DataFrame, mock: DataFrame) -> DataFrame:
    """The four kinds of time text as (src, record_key, text, zone, loaded_at)."""
    a = calls.select(F.lit("raw_calls.started").alias("src"), F.col("delivery_id").cast("string").alias("record_key"), F.col("call_data.metaData.started").alias("text"), F.col("source_tz").alias("zone"), "loaded_at")
    b = cases.select(F.lit("raw_cases.CreatedDate").alias("src"), F.col("row_no").cast("string").alias("record_key"), F.col("case_data.CreatedDate").alias("text"), F.col("source_tz").alias("zone"), "loaded_at")
    c = cases.select("row_no", "source_tz", "loaded_at", F.posexplode(F.transform("comments", lambda x: x.CreatedDate)).alias("i", "text")).select(
        F.lit("raw_cases.comments.CreatedDate").alias("src"), F.concat_ws(":", F.col("row_no").cast("string"), F.col("i").cast("string")).alias("record_key"), "text", F.col("source_tz").alias("zone"), "loaded_at")
    d = mock.select(F.lit("mock.occurred_at").alias("src"), F.col("entry_no").cast("string").alias("record_key"), F.col("occurred_at").alias("text"), F.col("source_tz").alias("zone"), "loaded_at")
    return a.unionByName(b).unionByName(c).unionByName(d).where(F.col("text").isNotNull())
