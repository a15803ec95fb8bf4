"""Scalar functions over catalogue columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (inclusive) of the camera facets and their keys; beyond the last, the last key.
CAMERA_BUCKETS = {
    "focal_mm": [(19.5, "lt20"), (35.5, "20to35"), (70.5, "36to70"), (135.5, "71to135"), (None, "gt135")],
    "iso": [(400, "le400"), (1600, "to1600"), (6400, "to6400"), (None, "gt6400")],
    "exposure_s": [(1 / 1000 * 1.05, "fast"), (1 / 250 * 1.05, "action"), (1 / 60 * 1.05, "normal"), (0.99, "slow"), (None, "long")],
    "fnumber": [(2.0, "wide"), (4.0, "mid"), (8.0, "small"), (None, "tiny")],
}
# Half-open ranges of clip lengths in seconds.
DURATIONS = [("lt10", 0, 10), ("10to30", 10, 30), ("30to120", 30, 120), ("gt120", 120, None)]
SLOW_FPS = 100
EARTH_KM = 6371.0088


def falsy(c: Column) -> Column:
    """Null or zero."""
    return c.isNull() | (c == 0)


def when_of(taken: Column, mtime: Column) -> Column:
    """Time taken, else the file's time, as text; empty if neither is known."""
    return F.coalesce(taken, F.date_format(F.timestamp_seconds(mtime), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def parsed_time(taken: Column) -> Column:
    """The first 19 characters as a timestamp, or null."""
    return F.try_to_timestamp(F.substring(taken, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def basename(rel: Column) -> Column:
    return F.element_at(F.split(rel, "/"), -1)


def parent(rel: Column) -> Column:
    """Folder of a path, empty at the top."""
    return F.regexp_replace(rel, "/?[^/]*$", "")


def stem(rel: Column) -> Column:
    return F.regexp_replace(basename(rel), r"(?<=.)\.[^.]*$", "")


def suffix(rel: Column) -> Column:
    return F.lower(F.regexp_extract(basename(rel), r"(?<=.)(\.[^.]*)$", 1))


def frame_number(rel: Column) -> Column:
    """The last run of digits in the file's stem; null without one."""
    return F.regexp_extract(stem(rel), r"(\d+)\D*$", 1).try_cast("long")


def ev100(fnumber: Column, exposure_s: Column, iso: Column) -> Column:
    """Exposure value at ISO 100; null unless all three are known."""
    known = ~(falsy(fnumber) | falsy(exposure_s) | falsy(iso))
    return F.when(known, F.log2(fnumber * fnumber / exposure_s) - F.log2(iso / 100.0))


def brightness(fnumber: Column, exposure_s: Column, iso: Column, ev_bias: Column) -> Column:
    return F.coalesce(-ev100(fnumber, exposure_s, iso), ev_bias)


def ev_label(stops: Column) -> Column:
    """Signed stops to the nearest third."""
    third = F.bround(stops * 3, 0) / 3
    return F.when(F.abs(third) < 1e-9, "0").otherwise(F.format_string("%+.1f", third))


def bucket(axis: str, value: Column) -> Column:
    """Facet bucket of a camera value, upper bounds inclusive; `unknown` for null and zero. Flash goes by its fired bit."""
    if axis == "flash":
        return F.when(value.isNull() | (value < 0), "unknown").when(value.bitwiseAND(1) == 1, "fired").otherwise("none")
    out = F.when(falsy(value), "unknown")
    for top, name in CAMERA_BUCKETS[axis]:
        out = out.when(value <= top, name) if top is not None else out.otherwise(name)
    return out


def duration_bucket(seconds: Column) -> Column:
    """Name of the half-open range of a length; null for an unknown one."""
    out = None
    for name, low, high in DURATIONS:
        test = (seconds >= low) & (seconds < high) if high is not None else seconds >= low
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def is_log(gamma: Column) -> Column:
    return F.coalesce(F.lower(gamma).startswith("s-log"), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def dms_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column, most: float) -> Column:
    """Signed decimal degrees; null if not a number or out of range."""
    value = degrees + minutes / 60 + seconds / 3600
    signed = F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)
    return F.when(~F.isnan(signed) & (F.abs(signed) <= most), signed)


def iso6709(text: Column) -> Column:
    """Struct(lat, lon) of text such as +12.5-003.25/; null fields if it isn't."""
    pattern = r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)"
    return F.struct(F.regexp_extract(text, pattern, 1).try_cast("double").alias("lat"), F.regexp_extract(text, pattern, 2).try_cast("double").alias("lon"))


def fraction(text: Column) -> Column:
    """Value of `a/b` or of a plain number; null where it has none."""
    parts = F.split(text, "/")
    return F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double"))


def exif_iso(text: Column) -> Column:
    """`Y:m:d H:M:S` as ISO text; null otherwise."""
    found = F.regexp_extract(text, r"^(\d{4}):(\d\d):(\d\d) (\d\d:\d\d:\d\d)", 0)
    return F.when(found != "", F.regexp_replace(found, r"^(\d{4}):(\d\d):(\d\d) ", "$1-$2-$3T"))


def safe_segment(name: Column) -> Column:
    """One folder's name: runs of separators and colons become _, dots and blanks at the ends go, `export` if nothing is left;
    null for . and .., which name other folders."""
    cleaned = F.regexp_replace(F.regexp_replace(name, r"[\\/:]+", "_"), r"^[. ]+|[. ]+$", "")
    return F.when(~name.isin(".", ".."), F.when(cleaned == "", "export").otherwise(cleaned))


def safe_name(name: Column) -> Column:
    """A nested export name, made safe part by part; `export` if empty, null if absolute or with a part that is empty or illegal."""
    parts = F.transform(F.split(name, "/"), safe_segment)
    fits = ~name.rlike(r"^[/\\]|//|/$") & ~F.exists(parts, lambda x: x.isNull())
    return F.when(name == "", "export").when(fits, F.array_join(parts, "/"))


def file_segment(name: Column) -> Column:
    """A name that is safe as one file or folder: illegal and control characters go, dots and blanks at the ends too; at most 120."""
    cleaned = F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]+', "_"), r"^[. ]+|[. ]+$", "")
    return F.when(cleaned == "", "_").otherwise(F.substring(cleaned, 1, 120))


def formula_guard(text: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a quote before it."""
    return F.when(text.rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), text)).otherwise(text)


def elide_left(path: Column, n: int) -> Column:
    return F.when(F.length(path) > n, F.concat(F.lit("..."), F.right(path, F.lit(n - 3)))).otherwise(path)


def scrub(text: Column) -> Column:
    """Paths and quoted parts out of a message."""
    return F.regexp_replace(F.regexp_replace(text, r"(/[^\s'\"]+)+", "<path>"), r"'[^']*'|\"[^\"]*\"", "<text>")


def version_parts(text: Column) -> Column:
    """Numbers of a dotted version, for comparison as arrays."""
    return F.transform(F.split(F.regexp_replace(text, "^[vV]", ""), r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\d+", 0).try_cast("int"), F.lit(0)))


def camera_name(make: Column, model: Column) -> Column:
    """Make and model, NUL padding removed, the make only if the model does not hold it."""
    clean = lambda c: F.trim(F.regexp_replace(c, "\x00.*$", ""))
    make, model = F.coalesce(clean(make), F.lit("")), F.coalesce(clean(model), F.lit(""))
    whole = F.when(F.instr(F.lower(model), F.lower(make)) > 0, model).otherwise(F.trim(F.concat_ws(" ", make, model)))
    return F.nullif(whole, F.lit(""))


def segment_file_name(stem_: Column, number: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s_%02d_%.1f-%.1f.mp4", stem_, number, start, end)


def quick_hash(content: Column, size: Column, chunk: int = 65536) -> Column:
    """sha1 of the size and the first and last bytes of a file."""
    tail = F.when(size > chunk, F.substring(content, (F.greatest(size - chunk, F.lit(chunk)) + 1).cast("int"), F.lit(chunk))).otherwise(F.lit(b""))
    return F.sha1(F.concat(size.cast("string").cast("binary"), F.substring(content, 1, chunk), tail))


def discover_k(n: int) -> int:
    return min(24, max(4, round((n / 6) ** 0.5)))


def band_floor(min_sim: float) -> float:
    return min(min_sim, round(max(min_sim - 0.1, 0.4), 4))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def lab(red: Column, green: Column, blue: Column) -> Column:
    """Struct(l, a, b) of sRGB values 0 to 255, D65."""
    lin = lambda c: F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, 2.4))
    r, g, b = lin(red), lin(green), lin(blue)
    f = lambda t: F.when(t > 216.0 / 24389, F.cbrt(t)).otherwise((24389.0 / 27 * t + 16) / 116)
    x = f((0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047)
    y = f(0.2126729 * r + 0.7151522 * g + 0.0721750 * b)
    z = f((0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883)
    return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def flicker_alias(light_hz: Column | float, fps: Column) -> Column:
    """Frequency at which a light flickers in frames of a rate."""
    light = F.lit(float(light_hz)) if isinstance(light_hz, int | float) else light_hz
    return F.abs(light - F.bround(light / fps, 0) * fps)


def byte_size(n: Column) -> Column:
    """Bytes as text, in GB from a billion on and else in MB; half of the last digit goes to the even one."""
    big, small = F.format_string("%.1f GB", F.bround(n / 1e9, 1)), F.format_string("%.0f MB", F.bround(n / 1e6, 0))
    return F.when(n >= 1e9, big).when(n.isNotNull(), small)


def folder_id(link: Column) -> Column:
    """The folder's id of a share link (/folders/<id>, ?id=<id>) or of a bare id of ten characters or more; null for a link to
    a document or a file, and for anything else."""
    text, one = F.trim(link), "([A-Za-z0-9_-]+)"
    host = text.rlike(r"(drive|docs)\.google\.com") & ~text.rlike("/(document|spreadsheets|presentation|file/d)/")
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p + one, 1), F.lit("")) for p in ("/folders/", "[?&]id=")])
    return F.when(text.rlike("^[A-Za-z0-9_-]{10,}$"), text).when(host, found)


def json_map(text: Column) -> Column:
    """Fields of a JSON object as texts; an empty map for null and for anything that isn't an object."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def unnamed_group(name: Column) -> Column:
    """Whether a cluster still has its given name, such as `group 3`."""
    return F.coalesce(name.rlike(r"^group \d+$"), F.lit(False))


def shot_folder(kind: Column, model: Column, auto: Column, tagged: Column) -> Column:
    """`model` or `product`: where a frame of a live session goes. A product that was typed holds a frame whose model was only
    recognised."""
    has = F.coalesce(F.nullif(model, F.lit("")).isNotNull(), F.lit(False))
    held = has & F.coalesce(auto, F.lit(False)) & F.coalesce(tagged, F.lit(False))
    return F.when(~held & (has | F.coalesce(kind == "model", F.lit(False))), "model").otherwise("product")
