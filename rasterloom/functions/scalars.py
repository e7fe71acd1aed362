"""Scalar column expressions: label recoding, intensity, dates, names and affine transforms."""
from __future__ import annotations

from itertools import chain
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .vectors import is_finite


# --- labels ---------------------------------------------------------------------------------
def reduce_zero_label(c: Column, ignore: int = 255) -> Column:
    """Class 0 becomes ignore, everything else moves down by one, ignore stays ignore."""
    return F.when((c == 0) | (c == ignore), F.lit(ignore)).otherwise(c - 1).cast("int")


def lookup(c: Column, mapping: Mapping[int, int], default: int | None = None) -> Column:
    """Recode by a small fixed map; ids outside the map keep their value or take ``default``."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    fallback = c if default is None else F.lit(default)
    return F.coalesce(F.try_element_at(table, c.cast("int")), fallback).cast("int")


def swap_pairs(c: Column, pairs: Sequence[tuple[int, int]]) -> Column:
    both = {a: b for a, b in pairs} | {b: a for a, b in pairs}
    return lookup(c, both)


def binarize(c: Column, threshold: int = 128) -> Column:
    return F.floor(c / F.lit(threshold)).cast("int")


def mask_ignore(c: Column, values: Sequence[int], ignore: int = 255) -> Column:
    return F.when(c.isin(list(values)), F.lit(ignore)).otherwise(c).cast("int")


# Grey level of a fundus mask -> class id (disc, cup, background).
FUNDUS_GREY = {0: 1, 128: 2, 255: 0}
# Abdominal organ id -> train id (aorta, gallbladder, left kidney, right kidney, liver,
# pancreas, spleen, stomach), all other organs become background.
ORGAN_IDS = {8: 1, 4: 2, 3: 3, 2: 4, 6: 5, 11: 6, 1: 7, 7: 8}


# --- numbers --------------------------------------------------------------------------------
def clip(c: Column, lo, hi) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.least(F.greatest(c, lo), hi)


def clip_rescale(c: Column, lo: float = -125.0, hi: float = 275.0, out: float = 255.0) -> Column:
    return (clip(c.cast("double"), lo, hi) - lo) / (hi - lo) * out


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c.cast("double"))


def percent(c: Column, digits: int = 2) -> Column:
    return F.round(c * 100, digits)


def adjust_gamma(c: Column, gamma: float) -> Column:
    """Gamma on 0..255, truncated to an integer."""
    return F.floor(F.pow(c.cast("double") / 255.0, F.lit(1.0 / gamma)) * 255.0).cast("int")


def linear_intensity(c: Column, alpha: float = 1.0, beta: float = 0.0) -> Column:
    return clip(c.cast("double") * alpha + beta, 0.0, 255.0).cast("int")


def scale_to_uint16(c: Column, factor: float) -> Column:
    """Depth to 16-bit integers, truncated."""
    return F.floor(c.cast("double") * factor).cast("bigint")


def token_index(p: Column, n_pixels, n_tokens) -> Column:
    """Feature-grid index of pixel ``p`` (pixel centres, clipped to the last token)."""
    n_pixels, n_tokens = (x if isinstance(x, Column) else F.lit(x) for x in (n_pixels, n_tokens))
    pos = F.floor((p + 0.5) * n_tokens / n_pixels)
    return F.least(pos, n_tokens - 1).cast("int")


# --- dates ----------------------------------------------------------------------------------
def month_to_days(c: Column) -> Column:
    """YYYYMM -> days since 1970-01-01; NULL when it is not a month."""
    day = F.try_to_timestamp(F.concat(c.cast("string"), F.lit("01")), F.lit("yyyyMMdd")).cast("date")
    day = F.when(c.cast("string").rlike("^[0-9]{6}$"), day)
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def parse_day(c: Column, pivot: int = 50) -> Column:
    """8-digit YYYYMMDD or 6-digit YYMMDD (years below ``pivot`` are 20xx); NULL when invalid."""
    s = c.cast("string")
    century = F.when(F.substring(s, 1, 2).try_cast("int") < pivot, F.lit("20")).otherwise(F.lit("19"))
    full = F.when(s.rlike("^[0-9]{8}$"), s).when(s.rlike("^[0-9]{6}$"), F.concat(century, s))
    return F.try_to_timestamp(full, F.lit("yyyyMMdd")).cast("date")


def dates_to_days(c: Column, reference: str) -> Column:
    """Array of date tokens -> array of day offsets from ``reference`` (NULL entries are bad tokens)."""
    ref = F.lit(reference).cast("date")
    return F.transform(c, lambda d: F.datediff(parse_day(d), ref))


def date_from_name(c: Column, sep: str, index: int) -> Column:
    """YYYYMMDD at the start of one separator-delimited token of a file name, as days since 1970-01-01."""
    token = F.try_element_at(F.split(basename(c), f"[{sep}]"), F.lit(index + 1))
    day = F.try_to_timestamp(F.regexp_extract(token, r"^([0-9]{8})", 1), F.lit("yyyyMMdd")).cast("date")
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


# --- names ----------------------------------------------------------------------------------
def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"\.[^.]*$", "")


def scene_prefix(c: Column) -> Column:
    """Leading part of a base name before its first digit, without the separator in front of the digit.

    NULL for names without a digit.
    """
    lead = F.regexp_extract(basename(c), r"^([^0-9]*)[0-9]", 1)
    return F.when(basename(c).rlike("[0-9]"), F.substring(lead, F.lit(1), F.greatest(F.length(lead) - 1, F.lit(0))))


def tile_indices(c: Column) -> Column:
    """All digit runs of a tile name as integers, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"([0-9]+)"), 1), lambda s: s.cast("bigint"))


def tile_pair(c: Column) -> Column:
    """Row and column token of names such as a_b_2_10_x.tif (third and fourth token)."""
    return F.array_join(F.slice(F.split(basename(c), "_"), 3, 2), "_")


def natural_key(c: Column, width: int = 20) -> Column:
    """String key under which plain ordering equals natural ordering (digit runs as numbers)."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(
        F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, width, "0")).otherwise(p)), "")


def clean_text(c: Column) -> Column:
    """Lower case, the five basic HTML entities unescaped, whitespace collapsed."""
    # fixed values: basic HTML entities and their characters
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


# --- affine transforms ------------------------------------------------------------------------
def center_xy(geo: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Centre of a raster whose transform is (x origin, dx/dcol, dx/drow, y origin, dy/dcol, dy/drow)."""
    col, row = (width - 1) / 2, (height - 1) / 2
    return geo[0] + col * geo[1] + row * geo[2], geo[3] + col * geo[4] + row * geo[5]


def scale_affine(affine: Column, sx: Column, sy: Column) -> Column:
    """Affine (a, b, c, d, e, f) of a grid whose cells are ``sx`` by ``sy`` source pixels."""
    return F.array(affine[0] * sx, affine[1] * sy, affine[2], affine[3] * sx, affine[4] * sy, affine[5])


# --- boxes ----------------------------------------------------------------------------------
def xyxy_to_xywh(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    return [x0, y0, x1 - x0, y1 - y0]


def xyxy_to_cxcywh(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    return [(x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0]


def cxcywh_to_xyxy(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]
