"""Contracts of values, shapes, settings and names as conditions on columns; a null condition counts as not met."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed vocabularies.
SEGMENTERS = ("P0-u2-cf", "P1-isnet-fast", "P2-tracer-fba", "P3-biref-vit", "P4-bria-vit")
TRIMAPS, REFINERS, FOREGROUNDS = ("none", "symmetric"), ("none", "closed-form", "vitmatte"), ("original", "multilevel", "fast", "fba")
PROVIDERS, CLOTHS, POLICIES = ("cpu", "coreml", "cuda", "openvino"), ("upper", "lower", "full"), ("multiply-predicted", "replace-source-alpha")
SCHEMAS = ("m1.pipeline.v1", "m2.pipeline.v1")


def holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != float("inf"))


def grid(width: Column, height: Column, values: Column) -> Column:
    """Positive sides whose product is the number of values."""
    return holds((width > 0) & (height > 0) & (width.cast("bigint") * height == F.size(values)))


def alpha_mask(width: Column, height: Column, values: Column) -> Column:
    return grid(width, height, values) & holds(F.forall(values, lambda v: finite(v) & (v >= 0) & (v <= 1)))


def colours(width: Column, height: Column, values: Column) -> Column:
    """Finite; any range."""
    return grid(width, height, values) & holds(F.forall(values, finite))


def trimap_codes(values: Column) -> Column:
    return holds(F.forall(values, lambda v: v.isin(0, 1, 2)))


def both_or_none(a: Column, b: Column) -> Column:
    return a.isNull() == b.isNull()


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Finite and ordered."""
    return holds(finite(x0) & finite(y0) & finite(x1) & finite(y1) & (x0 <= x1) & (y0 <= y1))


def box_inside(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    return box(x0, y0, x1, y1) & holds((x0 >= 0) & (y0 >= 0) & (x1 <= width) & (y1 <= height))


def geometry(policy: Column, inner: Column, target: Column, pad_low: Column, pad_high: Column, crop_low: Column, crop_high: Column) -> Column:
    """One axis: what is cropped makes the inner size of the target, what is padded the target of the inner size."""
    none = lambda a, b: (a == 0) & (b == 0)
    crops = none(pad_low, pad_high) & (crop_low + target + crop_high == inner)
    pads = none(crop_low, crop_high) & (pad_low + inner + pad_high == target)
    return holds((inner > 0) & (target > 0) & F.when(policy == "cover-crop", crops).otherwise(pads))


def pipeline_config(schema: Column, *names: Column) -> Column:
    out = schema.isin(*SCHEMAS)
    for n in names:
        out = out & (F.trim(n) != "")
    return holds(out)


def elements(shape: Column, most: int = (1 << 63) - 1) -> Column:
    """The product of a shape; null if a size isn't positive or the product is over `most`."""
    total = F.aggregate(shape, F.lit(1).cast("decimal(38,0)"), lambda s, d: F.when((d > 0) & (s <= most), (s * d.cast("decimal(19,0)")).cast("decimal(38,0)")))
    return F.when(total <= most, total.cast("bigint"))


def size_matches(static: Column, actual: Column) -> Column:
    """A static size equals; a symbolic one (null) is positive or -1."""
    return holds(F.when(static.isNotNull(), static == actual).otherwise((actual == -1) | (actual > 0)))


def output_contract(expected: Column, actual: Column, values: Column) -> Column:
    same = F.forall(F.zip_with(expected, actual, lambda e, a: (a > 0) & ((e < 0) | (e == a))), lambda ok: ok)
    return holds((F.size(expected) == F.size(actual)) & same & (elements(actual) == values))


def fast_foreground(coarse: Column, fine: Column, coarse_runs: Column, fine_runs: Column, scaled: Column, reference: Column, epsilon: Column) -> Column:
    return holds((coarse > 0) & (fine > 0) & coarse_runs.between(1, 64) & fine_runs.between(1, 64) & (~scaled | (reference > 0)) & finite(epsilon) & (epsilon > 0))


def multilevel_foreground(regularisation: Column, gradient_weight: Column, small: Column) -> Column:
    return holds(finite(regularisation) & (regularisation >= 0) & finite(gradient_weight) & (gradient_weight >= 0) & (small > 0))


def closed_form(epsilon: Column, radius: Column, tolerance: Column, limits: list[Column], base: Column) -> Column:
    """base: the working size, null for none."""
    out = finite(epsilon) & (epsilon > 0) & (radius <= 8) & finite(tolerance) & (tolerance > 0)
    for v in limits:
        out = out & (v > 0)
    return holds(out & F.coalesce(base.between(1, 4096), F.lit(True)))


def kernel_width(width: Column, scaled: Column, w: Column, h: Column, reference: Column) -> Column:
    """The kernel's width for an image, at least 1; scaled by the longer side over a reference size if asked."""
    by = F.greatest(F.greatest(w, h) / reference, 1 / reference)
    return F.greatest(F.when(scaled, F.round(width * by)).otherwise(width).cast("int"), F.lit(1))


def radius(absolute: Column, relative: Column, w: Column, h: Column) -> Column:
    """Pixels: an absolute radius up to the longer side, or a part of the shorter one; null if out of bounds."""
    own = F.when(absolute <= F.greatest(w, h), absolute)
    part = F.when(finite(relative) & relative.between(0, 1), F.round(relative * F.least(w, h)).cast("int"))
    return F.when((w > 0) & (h > 0), F.when(absolute.isNotNull(), own).otherwise(part))


def fallback(requested: Column, active: Column, allowed: Column) -> Column:
    """Whether another provider stands in; null if names are empty or that isn't allowed."""
    return F.when((requested != "") & (active != ""), F.when(requested == active, False).when(allowed, True))


def eligibility(mode: Column, declared: Column) -> Column:
    return F.when(mode.isin("manual", "centre-default"), "assisted-non-automatic").when((mode == "auto-derived") & declared, "automatic-derived")


def provider(v: Column) -> Column:
    return F.when(F.lower(v).isin(*PROVIDERS), F.lower(v))


def one_of(v: Column, names: tuple[str, ...]) -> Column:
    return F.when(v.isin(*names), v)


def strict_pipeline(v: Column) -> Column:
    """Four parts of closed vocabularies, joined by +."""
    parts = F.split(v, r"\+")
    kinds = (SEGMENTERS, TRIMAPS, REFINERS, FOREGROUNDS)
    out = F.size(parts) == 4
    for k, names in enumerate(kinds, 1):
        out = out & F.try_element_at(parts, F.lit(k)).isin(*names)
    return holds(out)
