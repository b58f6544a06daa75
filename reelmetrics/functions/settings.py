"""Settings maps: hashing, merging, modifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

L = F.lit


def config_hash(settings: Column) -> Column:
    """16 characters of the SHA-256 of the map as JSON with sorted keys."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(settings)))
    return F.substring(F.sha2(F.to_json(ordered), 256), 1, 16)


def merge_settings(base: Column, overlay: Column, forced: Sequence[str] = (), hardware: Sequence[str] = (), min_merge: Sequence[str] = (), max_merge: Sequence[str] = ()) -> Column:
    """Overlay wins, except forced keys and keys merged by minimum or maximum."""

    def pick(k, a, b):
        keep = k.isin(*forced) if forced else L(False)
        hard = k.isin(*hardware) if hardware else L(False)
        low = k.isin(*min_merge) if min_merge else L(False)
        high = k.isin(*max_merge) if max_merge else L(False)
        return (
            F.when(keep, a).when(hard, F.coalesce(b, a)).when(low, F.least(a, b)).when(high, F.greatest(a, b)).otherwise(F.coalesce(b, a))
        )

    merged = F.map_zip_with(base, overlay, pick)
    only_forced = (lambda k, v: ~(k.isin(*forced) & v.isNull())) if forced else (lambda k, v: L(True))
    return F.map_filter(merged, only_forced)


def apply_modifiers(settings: Column, modifiers: Column) -> Column:
    """``x_multiplier`` scales and ``x_cap`` limits an existing ``x``; other keys are set."""
    is_mod = lambda k: k.endswith("_multiplier") | k.endswith("_cap")
    plain = F.map_filter(modifiers, lambda k, v: ~is_mod(k))
    scaled = F.transform_values(settings, lambda k, v: v * F.coalesce(F.element_at(modifiers, F.concat(k, L("_multiplier"))), L(1.0)))
    capped = F.transform_values(scaled, lambda k, v: F.least(v, F.element_at(modifiers, F.concat(k, L("_cap")))))
    return F.map_zip_with(capped, plain, lambda k, a, b: F.coalesce(b, a))
