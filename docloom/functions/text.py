"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.fixed import BOILERPLATE, PROFILES


#: Every character that Python counts as white space.
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """White space of any script off both ends; only the ends are looked at."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """P10: runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def estimate_tokens(c: Column) -> Column:
    """Four characters a token, rounded down."""
    return F.floor(F.length(c) / 4).cast("int")


def chunk_id(product: Column, page: Column, index: Column, content: Column) -> Column:
    """Product, page, index and the first eight digits of the content's md5."""
    return F.concat(product, F.lit("_p"), page.cast("string"), F.lit("_c"), index.cast("string"), F.lit("_"), F.substring(F.md5(content), 1, 8))


def alnum_ratio(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) / F.length(c)


def is_quality(c: Column, least: int = 20, ratio: float = 0.3, short: int = 100, boilerplate: tuple = BOILERPLATE) -> Column:
    """Long enough, letters and digits enough, and no short boilerplate."""
    s = strip(F.coalesce(c, F.lit("")))
    phrase = F.lit(False)
    for p in boilerplate:
        phrase = phrase | s.contains(p)
    return (F.length(s) >= least) & (alnum_ratio(s) >= ratio) & ~(phrase & (F.length(s) < short))


def threshold(model: Column, kind: str, profiles: tuple = PROFILES) -> Column:
    """The font threshold of the first profile whose prefix the model has; the last profile's prefix is empty."""
    out = F.lit(float(profiles[-1][1][kind]))
    for prefix, sizes in reversed(profiles[:-1]):
        out = F.when(model.startswith(prefix), F.lit(float(sizes[kind]))).otherwise(out)
    return out


def base_url(url: Column) -> Column:
    """U4: scheme, host and the path without its last segment."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_filename(url: Column) -> Column:
    """The path as a file name without .html; index if nothing is left."""
    flat = F.regexp_replace(F.replace(F.replace(url_path(url), F.lit("/"), F.lit("_")), F.lit(".html"), F.lit("")), "^_+|_+$", "")
    return F.when(flat == "", F.lit("index")).otherwise(flat)


def client_ip(forwarded: Column, real: Column, peer: Column) -> Column:
    """First forwarded address, else the real one, else the peer, else unknown."""
    first = blank_to_null(F.trim(F.split(forwarded, ",")[0]))
    return F.coalesce(first, blank_to_null(F.trim(real)), blank_to_null(peer), F.lit("unknown"))


def rate_key(ip: Column, session: Column) -> Column:
    """Ip, or ip:session where there is a session."""
    return F.concat_ws(":", ip, blank_to_null(session))
