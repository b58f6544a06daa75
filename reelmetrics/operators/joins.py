"""Joins (family J): incremental work lists, as-of, tolerance, interval, box and rate joins.

Large-by-large joins are equi joins on a key plus a bucket of time or space, so that no pair is
formed outside a neighbourhood.  No side is broadcast by hint: Catalyst broadcasts what its size
estimate or AQE proves small, and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dims
from ..session import durable_checkpoint
from .sequence import TARGET_ROWS, Seq, adjacent, number_rows, segments, surrounding

C, L = F.col, F.lit


# --- incremental work --------------------------------------------------------------------------
def remaining_frames(frames: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames without a finished counterpart."""
    return frames.join(done.select(*keys), list(keys), "left_anti")


def cascade_delete(frames: DataFrame, deleted_jobs: DataFrame, key: str) -> DataFrame:
    """Frames that stay after their jobs are deleted."""
    return frames.join(deleted_jobs.select(key), key, "left_anti")


def checkpoint_validity(manifest: DataFrame, files: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    """A checkpoint is valid when every processed frame exists and matches its checksum.

    ``manifest``: keys, frame, processed, checksum (nullable).  ``files``: keys, frame, md5.
    """
    j = manifest.where(C("processed")).join(files.select(*keys, frame, C("md5").alias("_actual")), [*keys, frame], "left")
    missing = C("_actual").isNull()
    wrong = ~missing & C("checksum").isNotNull() & (C("checksum") != C("_actual"))
    return j.groupBy(*keys).agg(
        F.count(F.when(missing, 1)).alias("missing"),
        F.count(F.when(wrong, 1)).alias("mismatched"),
        F.bool_and(~missing & ~wrong).alias("is_valid"),
    )


def verify_sidecars(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Size and checksum issues of every file with or without a sidecar.

    ``manifest``: key, file_size, md5, sha256 (nullable).  ``files``: key, length, content.
    """
    actual = files.select(key, "length", F.md5("content").alias("_md5"), F.sha2("content", 256).alias("_sha"), L(True).alias("_f"))
    side = manifest.select(key, "file_size", "md5", "sha256", L(True).alias("_m"))
    j = actual.join(side, key, "full")
    both = C("_f").isNotNull() & C("_m").isNotNull()
    issues = F.array_compact(
        F.array(
            F.when(C("_f").isNull(), "file_missing"),
            F.when(C("_m").isNull(), "sidecar_missing"),
            F.when(both & (C("file_size") != C("length")), "size_mismatch"),
            F.when(both & (C("md5") != C("_md5")), "md5_mismatch"),
            F.when(both & (C("sha256") != C("_sha")), "sha256_mismatch"),
        )
    )
    return j.select(key, issues.alias("issues"), (F.size(issues) == 0).alias("valid"))


def cache_split(work: DataFrame, cache: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of a work list against the cache index."""
    index = cache.select(*keys)
    return work.join(index, list(keys), "left_semi"), work.join(index, list(keys), "left_anti")


def route_events(events: DataFrame, endpoints: DataFrame, event: str = "event_type") -> DataFrame:
    """One row per event and enabled endpoint that listens to it."""
    wanted = endpoints.where("enabled").select("endpoint", F.explode(F.array_distinct("events")).alias(event))
    return events.join(wanted, event)


# --- as-of -------------------------------------------------------------------------------------
def _around(frames: DataFrame, anchors: DataFrame, seq: Seq, payload: Sequence[str]) -> DataFrame:
    """Frames with the struct of the anchor at or before them and of the one after them."""
    pos = seq.first
    anchor = F.struct(C(pos).alias("pos"), *payload)
    left = frames.withColumn("_kind", L(1)).withColumn("_a", L(None).cast(anchors.select(anchor).schema[0].dataType))
    right = anchors.select(*seq.keys, pos, L(0).alias("_kind"), anchor.alias("_a"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Seq(seq.keys, (pos, "_kind", *seq.order[1:]), seq.width)
    return surrounding(both, order, C("_a"), "_prev", "_next").where("_kind = 1").drop("_kind", "_a")


def nearest_anchor(frames: DataFrame, anchors: DataFrame, seq: Seq, payload: Sequence[str]) -> DataFrame:
    """The nearest anchor of every frame; the earlier one wins ties.  Anchors are unique per position."""
    out = _around(frames, anchors, seq, payload)
    pos = C(seq.first)
    take_next = C("_prev").isNull() | (C("_next.pos") - pos < pos - C("_prev.pos"))
    pick = F.when(C("_next").isNull() | ~take_next, C("_prev")).otherwise(C("_next"))
    return out.withColumn("_pick", pick).select(*frames.columns, C("_pick.pos").alias("anchor_pos"), *[C(f"_pick.{p}") for p in payload])


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Element-wise linear interpolation of two arrays."""
    return F.zip_with(a, b, lambda x, y: x * (L(1.0) - t) + y * t)


def interpolate_anchors(frames: DataFrame, anchors: DataFrame, seq: Seq, array: str) -> DataFrame:
    """Array payload interpolated between the bracketing anchors, clamped at the ends."""
    out = _around(frames, anchors, seq, [array])
    t = (C(seq.first) - C("_prev.pos")) / F.greatest(L(1), C("_next.pos") - C("_prev.pos"))
    exact = C("_prev.pos") == C(seq.first)
    value = (
        F.when(C("_prev").isNull(), C(f"_next.{array}"))
        .when(C("_next").isNull() | exact, C(f"_prev.{array}"))
        .otherwise(lerp(C(f"_prev.{array}"), C(f"_next.{array}"), t))
    )
    return out.select(*frames.columns, value.alias(array))


def reconstruct_sequence(mapping: DataFrame, enhanced: DataFrame, seq: Seq, unique: str = "unique_frame") -> DataFrame:
    """The enhanced frame that stands for every frame: its unique frame, else the nearest one."""
    wanted = mapping.select(*seq.keys, C(unique).alias(seq.first)).distinct()
    found = nearest_anchor(wanted, enhanced.select(*seq.keys, seq.first), Seq(seq.keys, (seq.first,), seq.width), [])
    found = found.select(*seq.keys, C(seq.first).alias(unique), C("anchor_pos").alias("source_frame"))
    return mapping.join(found, [*seq.keys, unique], "left")


# --- tolerance ---------------------------------------------------------------------------------
def best_offset(
    audio: DataFrame,
    video: DataFrame,
    keys: tuple[str, ...],
    t: str,
    max_ms: int = 500,
    step_ms: int = 1,
    tolerance_ms: int = 50,
    include_end: bool = False,
    width_us: int = 3_600_000_000,
) -> DataFrame:
    """The constant offset that matches most audio events to a video event.

    Times are BIGINT microseconds.  Video events closer than twice the tolerance are merged into
    one interval first, so an audio event meets at most ``max / tolerance`` intervals, and every
    match becomes one +1 / -1 pair on the offset grid instead of a row per offset.
    """
    tol, reach, step = tolerance_ms * 1000, max_ms * 1000, step_ms * 1000
    v = video.select(*keys, C(t).alias("_t")).distinct()
    seq = Seq(keys, ("_t",), width_us)
    v = adjacent(v, seq, {"_before": "_t"}, -1)
    apart = C("_before").isNull() | (C("_t") - C("_before") >= 2 * tol)
    islands = segments(v, seq, apart, {"_last": ("max", C("_t"))}, "_first").select(
        *keys, (C("_first") - tol).alias("_lo"), (C("_last") + tol).alias("_hi")
    )
    bucket = 4 * reach
    cells = lambda lo, hi: F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))
    a = audio.select(*keys, C(t).alias("_a"))
    left = a.select("*", F.explode(cells(C("_a") - reach, C("_a") + reach)).alias("_cell"))
    right = islands.select("*", F.explode(cells(C("_lo"), C("_hi"))).alias("_cell"))
    home = F.greatest(F.floor((C("_a") - reach) / bucket), F.floor(C("_lo") / bucket))
    pairs = left.join(right, [*keys, "_cell"]).where(
        (C("_cell") == home) & (C("_lo") < C("_a") + reach) & (C("_hi") > C("_a") - reach)
    )
    low, high = -(max_ms // step_ms), max_ms // step_ms - (0 if include_end else 1)
    first = F.greatest(F.floor((C("_lo") - C("_a")) / step) + 1, L(low))
    last = F.least(F.ceil((C("_hi") - C("_a")) / step) - 1, L(high))
    marks = pairs.select(*keys, first.alias("_i"), last.alias("_j")).where("_i <= _j")
    steps = marks.select(*keys, F.inline(F.array(F.struct(C("_i").alias("_k"), L(1).alias("_d")), F.struct((C("_j") + 1).alias("_k"), L(-1).alias("_d")))))
    grid = steps.groupBy(*keys, "_k").agg(F.sum("_d").alias("_d"))
    # One key has at most 2 * max / step + 1 grid rows.
    score = grid.withColumn("_n", F.sum("_d").over(W.partitionBy(*keys).orderBy("_k")))
    best = score.groupBy(*keys).agg(F.max(F.struct(C("_n"), (-C("_k")).alias("k"))).alias("_b"))
    total = a.groupBy(*keys).agg(F.count(L(1)).alias("_audio"))
    hit = C("_b._n") > 0
    return total.join(best, list(keys), "left").select(
        *keys,
        F.when(hit, -C("_b.k") * step_ms).otherwise(0).cast("double").alias("offset_ms"),
        F.when(hit, C("_b._n") / C("_audio")).otherwise(0.0).alias("score"),
    )


def progressive_drift(audio: DataFrame, video: DataFrame, keys: tuple[str, ...], t: str, durations: DataFrame, **search) -> DataFrame:
    """Does the best offset of the first half differ from that of the second by more than 20 ms.

    ``durations`` has ``duration_us`` per key; keys with fewer than ten events on a side are not progressive.
    """

    def halved(df: DataFrame) -> DataFrame:
        return df.join(durations, list(keys)).select(*keys, t, (C(t) * 2 >= C("duration_us")).cast("int").alias("half"))

    found = best_offset(halved(audio), halved(video), (*keys, "half"), t, **search)
    by_half = found.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(C("half") == h, C("offset_ms"))), L(0.0)).alias(n) for h, n in ((0, "first_ms"), (1, "second_ms"))]
    )
    n = durations.select(*keys)
    for side, name in ((audio, "_na"), (video, "_nv")):
        n = n.join(side.groupBy(*keys).agg(F.count(L(1)).alias(name)), list(keys), "left")
    out = n.join(by_half, list(keys), "left").fillna(0, ["_na", "_nv", "first_ms", "second_ms"])
    enough = (C("_na") >= 10) & (C("_nv") >= 10)
    change = F.abs(C("second_ms") - C("first_ms"))
    return out.select(*keys, F.when(enough, change).otherwise(0.0).alias("drift_change_ms"), (enough & (change > 20.0)).alias("is_progressive"))


# --- intervals and boxes -----------------------------------------------------------------------
def _levels(sizes: DataFrame, size: Column, keys: Sequence[str]) -> DataFrame:
    """Distinct size classes per key: few, as a class spans a factor of two."""
    return sizes.select(*keys, size_class(size).alias("_level")).distinct()


def size_class(size: Column) -> Column:
    """k such that ``size <= 2**k``, at least 0."""
    return F.ceil(F.log2(F.greatest(size.cast("double"), L(1.0)))).cast("int")


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, start: str, end: str, bucket: float) -> DataFrame:
    """Points with the half-open intervals that contain them.

    An interval of length up to ``bucket * 2**k`` stands in the two cells of that width it can touch; a
    point asks once on every class that occurs in its key. Neither side grows with an interval's length.
    """
    length = (C(end) - C(start)) / bucket
    right = intervals.where(C(end) > C(start)).withColumn("_level", size_class(length))
    width = lambda: F.pow(L(2.0), C("_level")) * bucket
    right = right.withColumn("_cell", F.explode(F.array_distinct(F.array(F.floor(C(start) / width()), F.floor(C(end) / width())))))
    left = points.join(_levels(intervals.where(C(end) > C(start)), length, keys), list(keys)).withColumn("_cell", F.floor(C(t) / width()))
    return left.join(right, [*keys, "_level", "_cell"]).where((C(t) >= C(start)) & (C(t) < C(end))).drop("_cell", "_level")


def _sided(boxes: DataFrame, side: str) -> DataFrame:
    return boxes.select(*[C(c).alias(f"{side}_{c}" if c in ("x", "y", "w", "h", "box_id") else c) for c in boxes.columns])


def _corners(side: str, width: Column) -> Column:
    """The cells of a width that a box of at most that size touches: up to four."""
    x, y, w, h = (C(f"{side}_{c}") for c in "xywh")
    ends = lambda a, n: F.array_distinct(F.array(F.floor(a / width), F.floor((a + n) / width)))
    return F.flatten(F.transform(ends(x, w), lambda i: F.transform(ends(y, h), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def _meeting(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: int) -> DataFrame:
    """Pairs of boxes that share a cell, each pair once.

    A box belongs to the class of its longer edge. For every class of either side, boxes of that class
    and smaller ones of the other side meet in the cells of that class, of which a box touches four at
    most. A pair counts on the larger of its two classes and in its first common cell.
    """
    own = lambda side: size_class(F.greatest(f"{side}_w", f"{side}_h") / cell)
    left, right = _sided(a, "a").withColumn("_la", own("a")), _sided(b, "b").withColumn("_lb", own("b"))
    levels = left.select(*keys, C("_la").alias("_level")).unionByName(right.select(*keys, C("_lb").alias("_level"))).distinct()
    width = F.pow(L(2.0), C("_level")) * cell

    def spread(boxes: DataFrame, side: str, level: str) -> DataFrame:
        return boxes.join(levels, list(keys)).where(C(level) <= C("_level")).withColumn("_cell", F.explode(_corners(side, width)))

    j = spread(left, "a", "_la").join(spread(right, "b", "_lb"), [*keys, "_level", "_cell"]).where(F.greatest("_la", "_lb") == C("_level"))
    first = lambda axis: F.floor(F.greatest(C(f"a_{axis}"), C(f"b_{axis}")) / width)
    return j.where((C("_cell.cx") == first("x")) & (C("_cell.cy") == first("y"))).drop("_la", "_lb", "_level", "_cell")


def box_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: int = 64) -> DataFrame:
    """Touching boxes of two detection tables (``keys``, box_id, x, y, w, h) with IoU and both hulls."""
    left, top = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    right, bottom = F.least(C("a_x") + C("a_w"), C("b_x") + C("b_w")), F.least(C("a_y") + C("a_h"), C("b_y") + C("b_h"))
    inter = (right - left) * (bottom - top)
    union = C("a_w") * C("a_h") + C("b_w") * C("b_h") - inter
    hull = F.struct(
        F.least("a_x", "b_x").alias("x"),
        F.least("a_y", "b_y").alias("y"),
        (F.greatest(C("a_x") + C("a_w"), C("b_x") + C("b_w")) - F.least("a_x", "b_x")).alias("w"),
        (F.greatest(C("a_y") + C("a_h"), C("b_y") + C("b_h")) - F.least("a_y", "b_y")).alias("h"),
    )
    return (
        _meeting(a, b, keys, cell)
        .where((right > left) & (bottom > top))
        .withColumn("iou", F.when(union != 0, inter / union).otherwise(0.0))
        .withColumn("intersection_area", inter)
        .withColumn("hull", hull)
    )


def box_containment(outer: DataFrame, inner: DataFrame, keys: Sequence[str], cell: int = 64) -> DataFrame:
    """Pairs where the outer box contains the inner one (edges may touch)."""
    return _meeting(outer, inner, keys, cell).where(
        (C("a_x") <= C("b_x")) & (C("a_y") <= C("b_y")) & (C("a_x") + C("a_w") >= C("b_x") + C("b_w")) & (C("a_y") + C("a_h") >= C("b_y") + C("b_h"))
    )


# --- profiles, rates, offers -------------------------------------------------------------------
def stock_matches(profile: DataFrame) -> DataFrame:
    """Every film stock with its match confidence, best first, as an array column ``matches``.

    ``profile`` is the output of ``film_colour_profile``.  The fixed stock table is an expression,
    so there is no join and no row growth.
    """
    one, grain = L(1.0), C("grain_detected")
    rows = []
    for i, (name, (r, g, b, sat, gr)) in enumerate(dims.FILM_STOCKS.items()):
        colour = one - F.least(one, (F.abs(C("r_shift") - r) + F.abs(C("g_shift") - g) + F.abs(C("b_shift") - b)) / 0.6)
        tone = one - F.least(one, F.abs(C("saturation") - sat * 0.5) / 0.3)
        texture = one - F.least(one, F.abs(C("grain_intensity") - gr * 0.1) / 0.05)
        score = F.when(grain, (colour * 2 + tone + texture) / 4).otherwise((colour * 2 + tone) / 3)
        rows.append(F.struct((-score).alias("order"), L(i).alias("pos"), L(name).alias("stock"), score.alias("confidence")))
    ranked = F.sort_array(F.array(*rows))
    return profile.withColumn("matches", F.transform(ranked, lambda m: F.struct(m["stock"].alias("stock"), m["confidence"].alias("confidence"))))


def rate_lookup(df: DataFrame, rates: DataFrame, provider: str, gpu: str) -> DataFrame:
    """Hourly rate by exact name, else by the first rate whose name contains the GPU or is contained in it.

    ``rates``: provider, gpu_name, usd_hour, pos (dictionary order).  Names are compared once per
    distinct (provider, gpu) of the input, then joined back.
    """
    wanted = df.select(provider, gpu).where(C(provider).isNotNull() & C(gpu).isNotNull()).distinct()
    j = wanted.join(rates.withColumnRenamed("provider", "_p"), C(provider) == C("_p"))
    exact = C("gpu_name") == C(gpu)
    close = C("gpu_name").contains(C(gpu)) | C(gpu).contains(C("gpu_name"))
    found = j.where(exact | close).groupBy(provider, gpu).agg(F.min_by("usd_hour", F.struct((~exact).cast("int"), C("pos"))).alias("usd_hour"))
    return df.join(found, [provider, gpu], "left")


def value_lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: float) -> DataFrame:
    """Dimension lookup with a default."""
    return df.join(table.select(key, value), key, "left").fillna(default, [value])


#: What a job may ask of an offer: ``min_<name>`` of the job against ``<name>`` of the offer.
OFFER_NEEDS = ("gb", "disk_gb", "up_mbps", "down_mbps")


def cheapest_offers(wanted: DataFrame, offers: DataFrame, keys: list[str], needs: list[str], k: int, block: int = 64) -> DataFrame:
    """The ``k`` cheapest offers of each set of minima ``wanted`` (keys and ``_<need>``, all set): rows
    (keys, minima, offer_id, price, offer_rank).

    Offers stand in order of price in blocks of ``block``, with the maximum of each need, and the maxima
    of ``block`` blocks make a page.  A set turns page after page, skips the blocks in which some maximum
    is too small, reads the others in order and stops when it has ``k`` offers; pages and blocks a round
    grow as long as it has not.  So a set meets about ``k / block`` blocks and those that only seem to fit.
    """
    sets = [f"_{n}" for n in needs]
    own, on_set = list(keys), [*keys, *sets]
    numbered = number_rows(offers.select(*own, "offer_id", "price", *needs), Seq(tuple(own), ("price", "offer_id"), rows=TARGET_ROWS), "_at", 0)
    offer = F.struct("_at", "offer_id", "price", *(C(n).cast("double").alias(n) for n in needs))
    blocks = numbered.groupBy(*own, F.expr(f"_at div {block}").alias("_b")).agg(F.sort_array(F.collect_list(offer)).alias("_offers"), *[F.max(C(n).cast("double")).alias(n) for n in needs])
    blocks = durable_checkpoint(blocks)
    pages = blocks.groupBy(*own, F.expr(f"_b div {block}").alias("_page")).agg(F.sort_array(F.collect_list(F.struct("_b", *needs))).alias("_index"))
    last = pages.groupBy(*own).agg(F.max("_page").alias("_last"))
    fits = lambda row: reduce(lambda x, y: x & y, (row[n] >= C(f"_{n}") for n in needs), L(True))
    got_type = "array<struct<_at:bigint,offer_id:%s,price:%s>>" % tuple(offers.schema[c].dataType.simpleString() for c in ("offer_id", "price"))
    state = wanted.select(*on_set).distinct()
    state = state.join(last, own) if own else state.crossJoin(last)  # one row on the right
    state = state.select(*on_set, "_last", L(0).cast("long").alias("_page"), L(-1).cast("long").alias("_after"), F.array().cast(got_type).alias("_got"))
    found, turn = None, 0
    while True:
        pages_now, blocks_now = 8**turn, 8**turn
        end = F.least(C("_page") + pages_now, C("_last") + 1)
        look = state.select(*on_set, "_after", F.explode(F.sequence("_page", end - 1)).alias("_page")).join(pages, [*own, "_page"])
        seen = F.transform(F.filter("_index", lambda x: (x["_b"] > C("_after")) & fits(x)), lambda x: x["_b"])
        listed = look.groupBy(*on_set).agg(F.array_sort(F.flatten(F.collect_list(seen))).alias("_all"))
        plan = state.join(listed, on_set).withColumn("_read", F.slice("_all", 1, blocks_now)).withColumn("_end", end)
        plan = durable_checkpoint(plan.withColumn("_left", F.size("_all") > blocks_now).drop("_all"))
        read = plan.select(*on_set, F.explode("_read").alias("_b")).join(blocks.select(*own, "_b", "_offers"), [*own, "_b"])
        good = F.transform(F.filter("_offers", fits), lambda x: F.struct(x["_at"].alias("_at"), x["offer_id"].alias("offer_id"), x["price"].alias("price")))
        new = read.groupBy(*on_set).agg(F.flatten(F.collect_list(good)).alias("_new"))
        merged = plan.join(new, on_set, "left").withColumn("_got", F.slice(F.array_sort(F.concat("_got", F.coalesce("_new", F.array().cast(got_type)))), 1, k))
        after = F.when(C("_left"), F.element_at("_read", -1)).otherwise(C("_after"))
        # With blocks left to read the page of the last one is looked at again.
        nxt = merged.select(*on_set, "_last", F.when(C("_left"), F.floor(after / block)).otherwise(C("_end")).cast("long").alias("_page"), after.alias("_after"), "_got")
        nxt = durable_checkpoint(nxt)
        open_ = (F.size("_got") < k) & (C("_page") <= C("_last"))
        done = nxt.where(~open_).select(*on_set, "_got")
        found = done if found is None else found.unionByName(done)
        state = nxt.where(open_)
        if state.isEmpty():
            break
        turn += 1
    flat = found.select(*on_set, F.posexplode("_got").alias("_rank", "_o"))
    return flat.select(*on_set, "_o.offer_id", "_o.price", (C("_rank") + 1).cast("int").alias("offer_rank"))


def suitable_offers(jobs: DataFrame, offers: DataFrame, k: int = 10) -> DataFrame:
    """Cheapest ``k`` offers per job; jobs without any offer of their model may take any model.

    ``jobs``: job_id, model, max_price and any of ``min_gb, min_disk_gb, min_up_mbps, min_down_mbps``;
    ``offers``: offer_id, model, price, the same names without ``min_`` and any of the flags verified,
    rentable, external (true, true, false to count). A null requirement asks for nothing, an offer with a
    null where something is asked for does not fit.

    The cheapest offers are looked for once per distinct set of requirements (:func:`cheapest_offers`);
    a price limit only shortens that list. Runs jobs while the plan is built.
    """
    needs = [n for n in OFFER_NEEDS if f"min_{n}" in jobs.columns and n in offers.columns]
    for flag, wanted in (("verified", True), ("rentable", True), ("external", False)):
        if flag in offers.columns:
            offers = offers.where(C(flag) == wanted)
    lowest = float("-inf")
    offers = offers.select("offer_id", "model", "price", *(F.coalesce(C(n).cast("double"), L(lowest)).alias(n) for n in needs))
    asked = jobs.select("job_id", "model", "max_price", *[F.coalesce(C(f"min_{n}").cast("double"), L(0.0)).alias(f"_{n}") for n in needs])
    sets = [f"_{n}" for n in needs]

    def affordable(takers: DataFrame, keys: list[str], any_model: bool) -> DataFrame:
        best = cheapest_offers(takers.select(*keys, *sets), offers, keys, needs, k)
        met = takers.join(best, [*keys, *sets]) if keys or sets else takers.crossJoin(best)  # k rows on the right
        met = met.where(C("max_price").isNull() | (C("price") <= C("max_price")))
        return met.select("job_id", "offer_id", "price", "offer_rank", L(any_model).alias("any_model"))

    own = affordable(asked, ["model"], False)
    return own.unionByName(affordable(asked.join(own.select("job_id").distinct(), "job_id", "left_anti"), [], True))


# Fixed values: (degradation, processor, priority, minimum severity, strength factor).
PROCESSOR_RULES = (
    ("interlacing", "interlace_handler", 1, None, None),
    ("telecine", "telecine", 2, None, None),
    ("scratches", "defect_repair", 3, None, None),
    ("dust", "defect_repair", 4, None, None),
    ("motion_blur", "stabilization", 5, None, None),
    ("vhs_artifacts", "vhs_restoration", 6, None, None),
    ("tracking_errors", "vhs_restoration", 7, None, None),
    ("compression_artifacts", "qp_artifact_removal", 8, None, 1.0),
    ("blocking", "qp_artifact_removal", 8, None, 1.0),
    ("mosquito_noise", "qp_artifact_removal", 9, None, None),
    ("noise", "temporal_denoise", 10, None, 1.0),
    ("gaussian_noise", "temporal_denoise", 10, None, 1.0),
    ("noise", "tap_denoise", 11, 0.5, 1.0),
    ("gaussian_noise", "tap_denoise", 11, 0.5, 1.0),
    ("chroma_bleeding", "vhs_restoration", 12, None, None),
    ("flicker", "temporal_denoise", 13, None, None),
    ("film_grain", "grain_manager", 15, None, 0.5),
    ("blur", "realesrgan", 20, None, None),
    ("out_of_focus", "realesrgan", 20, None, None),
    ("banding", "perceptual_tuning", 25, None, None),
    ("color_cast", "film_stock_corrector", 28, None, None),
    ("color_fade", "colorization", 30, None, None),
    ("vignette", "adaptive_enhance", 35, None, None),
)


def processor_recommendations(found: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Processors for the degradations of a video, each once with its most urgent reason."""
    from .timeline import first_by_priority

    rules = F.array(
        *[
            F.struct(
                L(d).alias("t"), L(p).alias("processor"), L(pr).alias("priority"), L(ms).cast("double").alias("ms"), L(f).cast("double").alias("f")
            )
            for d, p, pr, ms, f in PROCESSOR_RULES
        ]
    )
    fits = F.filter(rules, lambda r: (r["t"] == C("type")) & (r["ms"].isNull() | (C("severity") > r["ms"])))
    hits = found.select(*keys, "type", "severity", position, F.inline(fits))
    hits = hits.select(*keys, "processor", "priority", (C("severity") * C("f")).alias("strength"), C("type").alias("reason"), position)
    return first_by_priority(hits, [*keys, "processor"], [C("priority"), C(position)]).drop(position)


def media_comparison(output: DataFrame, source: DataFrame, key: str, duration_tolerance: float = 1.0, frame_tolerance: int = 5) -> DataFrame:
    """Issues of an output against its source (duration, frames, size, rate, audio)."""
    names = ("duration", "frames", "audio")
    src = source.select(key, *[C(c).alias(f"s_{c}") for c in names], L(True).alias("_s"))
    issue = lambda cond, code, sev: F.when(cond, F.struct(L(code).alias("code"), L(sev).alias("severity")))
    found = F.array_compact(
        F.array(
            issue(F.abs(C("duration") - C("s_duration")) > duration_tolerance, "duration_mismatch", "warning"),
            issue(F.abs(C("frames") - C("s_frames")) > frame_tolerance, "frame_count_mismatch", "warning"),
            issue((C("width") < 16) | (C("height") < 16), "resolution_mismatch", "error"),
            issue(C("_s").isNotNull() & ((C("fps") < 1) | (C("fps") > 240)), "fps_mismatch", "error"),
            issue(C("s_audio") & ~C("audio"), "audio_missing", "warning"),
        )
    )
    return output.join(src, key, "left").select(key, F.inline(found))


# --- vectors -----------------------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), L(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), L(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for zero norms or unequal lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def identity_match(faces: DataFrame, face_id: str, identities: DataFrame, vec: str, limit: float = 0.6, chunk: int = 256, spread: int = 32) -> DataFrame:
    """Most similar known identity of every embedding (lowest label wins ties), when similar enough.

    Faces and identities are packed into blocks (of about ``chunk`` identities; faces by ``spread``
    salts), and a block of identities meets every block of faces once: the work spreads over
    face blocks times identity blocks, no pair rows are formed, and a face keeps a running best.
    """
    n = F.broadcast(identities.agg(F.greatest(F.ceil(F.count(L(1)) / chunk), L(1)).cast("int").alias("_parts")))
    label = F.xxhash64("label")
    book = identities.crossJoin(n).withColumn("_slot", F.pmod(label, C("_parts")).cast("int"))
    book = book.groupBy("_slot").agg(F.collect_list(F.struct("label", "reference")).alias("_book"))
    book = book.withColumn("_salt", F.explode(F.sequence(L(0), L(spread - 1))))
    asked = faces.select(face_id, vec, F.pmod(F.xxhash64(face_id), L(spread)).cast("int").alias("_salt"))
    scored = F.transform("_book", lambda i: F.struct(cosine(C(vec), i["reference"]).alias("similarity"), (-i["label"]).alias("n"), i["label"].alias("label")))
    best = asked.join(book, "_salt").select(face_id, F.array_max(scored).alias("_s")).groupBy(face_id).agg(F.max("_s").alias("_b"))
    return best.select(face_id, C("_b.similarity").alias("similarity"), F.when(C("_b.similarity") >= limit, C("_b.label")).alias("identity"))


def palette_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Weighted distance of two palettes (colors, white, black, saturation, temperature)."""
    nearest = F.transform(a["colors"], lambda x: F.array_min(F.transform(b["colors"], lambda y: l2_distance(x, y))))
    colour = F.aggregate(nearest, L(0.0), lambda s, x: s + x) / F.nullif(F.size(nearest), L(0)) / 255.0
    full = 255.0 * 3**0.5
    return (
        colour * 0.4
        + l2_distance(a["white"], b["white"]) / full * 0.2
        + l2_distance(a["black"], b["black"]) / full * 0.1
        + F.abs(a["saturation"] - b["saturation"]) * 0.2
        + F.abs(a["temperature"] - b["temperature"]) / 10000.0 * 0.1
    )


def grain_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Similarity 0-1 of two grain profiles (mean and std arrays, size, colour ratio)."""

    def apart(x: Column, y: Column) -> Column:
        d = F.zip_with(x, y, lambda p, q: F.abs(p - q))
        return F.aggregate(d, L(0.0), lambda s, v: s + v) / F.nullif(F.size(d), L(0))

    one = L(1.0)
    score = (
        (one - apart(a["mean"], b["mean"]) / 50.0) * 0.3
        + (one - apart(a["std"], b["std"]) / 30.0) * 0.3
        + (one - F.abs(a["size"] - b["size"]) / 5.0) * 0.2
        + (one - F.abs(a["ratio"] - b["ratio"])) * 0.2
    )
    return F.greatest(L(0.0), F.least(one, score))
