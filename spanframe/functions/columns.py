"""Column functions: times, texts, hashes, confidence and small statistics. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of text and agreement in a combined confidence.
TEXT_BOOST, AGREEMENT_BOOST = 0.12, 0.04
#: HTML entities by name.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&amp;": "&"}


def timecode_to_us(text: Column, strict: bool = False) -> Column:
    """HH:MM:SS[.fraction] to microseconds, rounded half up to milliseconds; null (or an error if strict) otherwise."""
    pattern = r"^\s*(\d+):([0-5]?\d):([0-5]?\d(?:\.\d+)?)\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    ms = F.round(part(3).try_cast("decimal(20,9)") * 1000, 0).cast("bigint")
    us = ((part(1).try_cast("bigint") * 60 + part(2).try_cast("bigint")) * 60_000 + ms) * 1000
    ok = F.regexp_like(text, F.lit(pattern))
    bad = F.raise_error(F.concat(F.lit("not a timecode: "), text)).cast("bigint") if strict else F.lit(None).cast("bigint")
    return F.when(text.isNull(), F.lit(None)).when(ok, us).otherwise(bad)


def us_to_timecode(us: Column) -> Column:
    """HH:MM:SS.mmm, rounded half up to milliseconds."""
    ms = F.floor((us + 500) / 1000).cast("bigint")
    whole = lambda n: F.floor(ms / n).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", whole(3_600_000), whole(60_000) % 60, whole(1000) % 60, ms % 1000)


def parse_fraction(text: Column) -> Column:
    """'num/den' or a number as a double; null for junk and for a zero denominator."""
    num, den = F.try_element_at(F.split(text, "/"), F.lit(1)), F.try_element_at(F.split(text, "/"), F.lit(2))
    value = F.try_divide(F.trim(num).try_cast("double"), F.when(den.isNull(), F.lit(1.0)).otherwise(F.trim(den).try_cast("double")))
    return F.when(F.size(F.split(text, "/")) <= 2, value)


def pts_to_us(pts: Column, num: Column, den: Column) -> Column:
    """pts * num / den seconds in microseconds, exactly, rounded half away from zero."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.round(big(pts) * big(num).cast("decimal(9,0)") * F.lit(1_000_000).cast("decimal(7,0)") / big(den).cast("decimal(9,0)"), 0).cast("bigint")


def excerpt(text: Column, n: int) -> Column:
    """White space collapsed; longer than n is cut to n - 1 and an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…")))


def clean_cue(text: Column) -> Column:
    r"""Subtitle text: \N as a line break, override blocks and tags removed, named entities decoded, trimmed."""
    out = F.regexp_replace(F.replace(text, F.lit("\\N"), F.lit("\n")), r"\{[^}]*\}|<[^>]*>", "")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(out)


def safe_id(text: Column, most: int = 96, fallback: str = "item") -> Column:
    """Letters, digits, '-' and '_' kept, others as '_', cut; the fallback if nothing is left."""
    kept = F.substring(F.regexp_replace(text, r"[^A-Za-z0-9_-]", "_"), 1, most)
    return F.coalesce(F.when(F.length(kept) > 0, kept), F.lit(fallback))


def suggestion_id(fingerprint: Column, start_us: Column, end_us: Column, category: Column) -> Column:
    text = F.format_string("%s|%.3f|%.3f|%s", fingerprint, start_us / 1e6, end_us / 1e6, category)
    return F.concat(F.lit("suggestion-"), F.substring(F.sha2(text, 256), 1, 20))


def combined_confidence(visual: Column, text: Column, agrees: Column) -> Column:
    """Text closes a small part of what the visual confidence leaves open."""
    rest = 1 - visual
    boost = rest * TEXT_BOOST * text + F.when(agrees, rest * AGREEMENT_BOOST).otherwise(0.0)
    return F.least(F.lit(1.0), visual + boost)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def difference_hash(luma: Column, width: int, height: int) -> Column:
    """Row by row, a bit for each value that exceeds its right neighbour; the first comparison is the highest bit. Up to 64
    comparisons."""
    n = width - 1
    if n * height > 64:
        raise ValueError("a hash has up to 64 comparisons")
    at = lambda i: (F.floor(i / n) * width + i % n).cast("int")
    bit = lambda i: F.when(F.get(luma, at(i)) > F.get(luma, at(i) + 1), 1).otherwise(0).cast("bigint")
    return F.aggregate(F.sequence(F.lit(0), F.lit(n * height - 1)), F.lit(0).cast("bigint"), lambda s, i: F.shiftleft(s, 1).bitwiseOR(bit(i)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0 or not finite."""
    return F.try_divide(_dot(a, b), F.nullif(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(0.0)))


def argmax(values: Column) -> Column:
    """Place of the first maximum, from 0."""
    return F.array_position(values, F.array_max(values)) - 1


def canonical(text: Column) -> Column:
    """Lower case, trimmed; null if empty."""
    return F.nullif(F.lower(F.trim(text)), F.lit(""))


def parse_events(text: Column) -> Column:
    """'start-end:category;...' as an array of structs; parts of another form are null."""
    p = r"^\s*(\d+)-(\d+):(\w+)\s*$"
    one = lambda x: F.when(F.regexp_like(x, F.lit(p)), F.struct(F.regexp_extract(x, p, 1).cast("bigint").alias("start"), F.regexp_extract(x, p, 2).cast("bigint").alias("end"), F.regexp_extract(x, p, 3).alias("category")))
    return F.transform(F.filter(F.split(text, ";"), lambda x: F.trim(x) != ""), one)


def parse_binary_answer(text: Column) -> Column:
    """True for a bare yes, false for a bare no (any case, a full stop allowed), else null."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"\.$", "")
    return F.when(bare == "yes", True).when(bare == "no", False)


def parse_bitmask(text: Column, categories: Sequence[str]) -> Column:
    """Categories whose digit is 1 in a string of exactly that many 0s and 1s; null for another form."""
    bits = F.trim(text)
    named = F.array_compact(F.array(*[F.when(F.substring(bits, i + 1, 1) == "1", F.lit(c)) for i, c in enumerate(categories)]))
    return F.when(F.regexp_like(bits, F.lit(f"^[01]{{{len(categories)}}}$")), named)


def first_json_object(text: Column) -> Column:
    """The first {...} that parses as JSON, with all that nests inside; null without one.

    Each opening brace is tried in turn: what follows is cut into strings, braces and the rest, so that braces and quotes inside of
    strings count for nothing, up to the brace that closes the first. Texts of up to _BRACES opening braces first go through one
    pattern that nests as deep; where its first object does not parse, or there are more braces, the braces are tried one by one."""
    few = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit(""))) <= _BRACES
    first = F.regexp_extract(text, _nested(_BRACES), 0)
    return F.when(few & (first == ""), F.lit(None).cast("string")).when(few & _parses(first), first).otherwise(_each_brace(text))


#: Opening braces of a text, and so objects inside each other, that one pattern covers.
_BRACES = 12


def _nested(depth: int) -> str:
    """A pattern of the first balanced {...} up to so deep that may be an object of JSON, which goes on with a string or ends."""
    inner = ""
    for _ in range(depth - 1):
        inner = rf'|\{{(?:{_STRING}|[^"{{}}]++|"{inner})*+\}}'
    return rf'(?s)\{{(?=[ \t\r\n]*+["}}])(?:{_STRING}|[^"{{}}]++|"{inner})*+\}}'


_STRING = r'"(?:[^"\\]|\\.)*+"'


def _parses(text: Column) -> Column:
    return F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false"}).isNotNull()


def _each_brace(text: Column) -> Column:
    tokens = F.lit(r'(?s)"(?:[^"\\]|\\.)*+"|[{}]|[^"{}]++|"')

    def closed(rest: Column) -> Column:
        """The balanced object at the start of rest, or null."""
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

        def step(s: Column, token: Column) -> Column:
            depth = s["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
            at = s["at"] + F.length(token)
            return F.when(s["end"] > 0, s).otherwise(F.struct(depth.alias("depth"), at.alias("at"), F.when(depth == 0, at).otherwise(0).alias("end")))

        end = F.aggregate(F.regexp_extract_all(rest, tokens, F.lit(0)), start, step, lambda s: s["end"])
        return F.substring(rest, F.lit(1), F.nullif(end, F.lit(0)))

    pieces = F.regexp_extract_all(text, F.lit(r"(?s)[^{]*+\{"), F.lit(0))
    none = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("found"))

    def attempt(s: Column, piece: Column) -> Column:
        at = s["at"] + F.length(piece)
        said = closed(F.substring(text, at, F.length(text)))
        return F.when(s["found"].isNotNull(), s).otherwise(F.struct(at.alias("at"), F.when(_parses(said), said).alias("found")))

    return F.aggregate(pieces, none, attempt, lambda s: s["found"])


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; null when n is 0."""
    n, p = n.cast("double"), F.try_divide(k.cast("double"), n.cast("double"))
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    some = n > 0
    return F.when(some, (centre - spread) / (1 + z * z / n)), F.when(some, (centre + spread) / (1 + z * z / n))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


#: The forms of keys, and of local paths with what follows them on their line, as paths hold blanks.
KEYS = r"(?i)\b(?:sk[-_][A-Za-z0-9_-]{10,}|lsv2_pt_[A-Za-z0-9_-]{10,}|ls__[A-Za-z0-9_-]{10,})\b"
WINDOWS_PATH = r"(?i)(?:(?<![a-z])[a-z]:[\\/]|\\\\)[^\r\n]*"
POSIX_PATH = r"(?i)(?<![\w.])/(?:home|users|root|tmp|var|private|mnt)/[^\r\n]*"


def redact(text: Column, most: int = 400) -> Column:
    """Values of secret-like assignments, keys of known forms, and local paths to the end of their line replaced; cut to most
    characters as the last step."""
    out = F.regexp_replace(text, r"(?i)\b(token|secret|password|api_key)\s*[=:]\s*\S+", "$1=[redacted]")
    out = F.regexp_replace(out, KEYS, "[redacted]")
    out = F.regexp_replace(F.regexp_replace(out, WINDOWS_PATH, "[path]"), POSIX_PATH, "[path]")
    return F.substring(out, 1, most)


def redact_map(m: Column, allowed: Sequence[str]) -> Column:
    """The entries of allowed names (whatever their case), texts redacted, and the text of an error not given at all."""
    kept = F.map_filter(m, lambda k, _: F.lower(F.trim(k)).isin([a.lower() for a in allowed]))
    return F.transform_values(kept, lambda k, v: F.when(F.lower(F.trim(k)) == "error", F.lit("[error]")).otherwise(redact(v, 1000)))


def gcd(a: Column, b: Column) -> Column:
    """Euclid over a fixed number of steps, enough for 64 bits."""
    pair = F.struct(a.cast("bigint").alias("x"), b.cast("bigint").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("bigint")).otherwise(F.try_mod(s["x"], s["y"])).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step)["x"]


def aspect_ratio(width: Column, height: Column, raw: Column | None = None) -> Column:
    """The raw ratio if given, else width:height reduced; null for a side of 0."""
    g = gcd(width, height)
    own = F.when((width > 0) & (height > 0), F.concat_ws(":", F.expr("1").cast("bigint") * F.floor(width / g), F.floor(height / g)))
    return own if raw is None else F.coalesce(F.nullif(F.trim(raw), F.lit("")), own)


def uid(*parts: Column) -> Column:
    """Parts joined by '::', white space as '-'."""
    return F.regexp_replace(F.concat_ws("::", *parts), r"\s+", "-")


def content_key(values: Mapping[str, Column]) -> Column:
    """SHA-256 of the values as a JSON object, names in order; null, an empty text and any text stay apart."""
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(values.items())]), {"ignoreNullFields": "false"}), 256)


def hash_draw(*parts: Column | str) -> Column:
    """A number below 2**32 from the SHA-256 of the parts joined by '|'; equal in any engine."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def frame_rate_mode(average: Column, real: Column) -> Column:
    """likely_cfr if both rates agree within half a percent, likely_vfr if not, undetermined without both."""
    off = F.try_divide(F.abs(average - real), real)
    return F.when(off.isNull(), "undetermined").when(off <= 0.005, "likely_cfr").otherwise("likely_vfr")


def band(value: Column, edges: Sequence[float]) -> Column:
    """Half-open band [edge, next edge) of a value: '<a', 'a-b', '>=z'."""
    out = F.when(value < edges[0], f"<{edges[0]:g}")
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out = out.when((value >= a) & (value < b), f"{a:g}-{b:g}")
    return out.when(value >= edges[-1], f">={edges[-1]:g}")
