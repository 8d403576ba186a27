"""Column -> Column helpers; all stay inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.schemas import FLOW_KINDS, VIEW_LABELS, VISIBILITIES

INF = float("inf")
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_NOT_FINITE = r"^[+-]?(nan|inf|infinity)$"


def finite(c: Column) -> Column:
    """NaN and infinities become NULL (Spark orders NaN above every number)."""
    return F.when(F.abs(c) < F.lit(INF), c)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_text(*cols: Column) -> Column:
    """First non-empty text among aliases."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def parse_number(text: Column, default: float | None = None) -> Column:
    """Lenient double: blank or garbage gives the default, nan/inf gives NULL."""
    t = F.trim(text)
    fallback = F.lit(default).cast("double")
    return (
        F.when(t.rlike(_NUMBER), finite(t.try_cast("double")))
        .when(F.lower(t).rlike(_NOT_FINITE), F.lit(None).cast("double"))
        .otherwise(fallback)
    )


def parse_integer(text: Column, default: int = 0) -> Column:
    value = parse_number(text)
    return F.coalesce(F.when(F.abs(value) < 9.0e18, value.cast("bigint")), F.lit(default).cast("bigint"))


def file_stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    name = F.regexp_replace(path, r"^.*/", "")
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def padded(text: Column, width: int) -> Column:
    """Zeros in front up to ``width``; longer text stays whole (lpad would cut it)."""
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def frame_number(text: Column) -> Column:
    """Last digit group of the text, whole, as a key; 0 if there is none."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+)"), 1)
    return F.coalesce(F.try_element_at(groups, F.lit(-1)).try_cast("bigint"), F.lit(0).cast("bigint"))


def frame_index_last6(text: Column) -> Column:
    """All digits of the text joined, last six kept; 0 if there are none."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9]", "")
    return F.coalesce(blank_to_null(F.right(digits, F.lit(6))).cast("int"), F.lit(0))


def frame_index_last_group(path: Column) -> Column:
    """Last digit group of the stem, NULL if there is none."""
    groups = F.regexp_extract_all(file_stem(path), F.lit(r"([0-9]+)"), 1)
    return F.try_element_at(groups, F.lit(-1)).try_cast("bigint")


def frame_index_trailing(path: Column) -> Column:
    """Digits that end the stem, else NULL."""
    return blank_to_null(F.regexp_extract(file_stem(path), r"([0-9]+)$", 1)).try_cast("bigint")


def frame_index_field(frame_idx: Column, frame: Column, stem: Column) -> Column:
    """First non-empty of three fields read as a number, else 0."""
    return parse_integer(first_text(frame_idx, frame, stem), 0)


def entity_of(stem: Column, given: Column | None = None) -> Column:
    found = blank_to_null(F.regexp_extract(stem, r"^(swing_[0-9]+)_(.+)$", 1))
    return found if given is None else F.coalesce(found, blank_to_null(given))


def frame_of(stem: Column) -> Column:
    found = blank_to_null(F.regexp_extract(stem, r"^(swing_[0-9]+)_(.+)$", 2))
    return F.coalesce(found, stem)


def image_stem_of(stem: Column, given: Column) -> Column:
    """Prefix a bare frame stem with the supplied sequence id."""
    matched = stem.rlike(r"^swing_[0-9]+_.+$")
    return F.when(matched | F.coalesce(given, F.lit("")).eqNullSafe(""), stem).otherwise(
        F.concat_ws("_", given, stem))


def view_key(view_id: Column, camera_id: Column, camera_name: Column, mirror: Column) -> Column:
    view = F.coalesce(first_text(view_id, camera_id, camera_name), F.lit("view_0"))
    mirrored = (mirror != "") & (mirror != "none")
    return F.when(mirrored, F.concat_ws("__", view, mirror)).otherwise(view)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def direction_degrees(hx: Column, hy: Column, tx: Column, ty: Column) -> Column:
    dx, dy = hx - tx, hy - ty
    return F.when((dx != 0) | (dy != 0), F.degrees(F.atan2(dy, dx)))


def angle_delta(a: Column, b: Column) -> Column:
    """Circular difference up to 180 degrees; 0 when either side is undefined."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.coalesce(F.least(d, 360.0 - d), F.lit(0.0))


def observed(x: Column, y: Column, conf: Column, exists: Column | None = None) -> Column:
    """Finite point with positive confidence (and the exists flag if there is one)."""
    ok = finite(x).isNotNull() & finite(y).isNotNull() & (finite(conf) > 0)
    ok = F.coalesce(ok, F.lit(False))
    return ok if exists is None else ok & F.coalesce(exists, F.lit(False))


def batter_side(text: Column) -> Column:
    return F.when(F.lower(F.trim(text)).startswith("l"), "left").otherwise("right")


def batter_hand(text: Column) -> Column:
    return F.when(F.upper(F.trim(text)).startswith("L"), "L").otherwise("R")


def view_label(camera: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(camera, F.lit(""))))
    return (
        F.when(t.contains("1b") | t.contains("first"), "1b_side")
        .when(t.contains("3b") | t.contains("third"), "3b_side")
        .when(t.contains("front"), "front")
        .when(t.contains("home"), "home_side")
        .otherwise("random")
    )


def swap_side(label: Column) -> Column:
    return F.when(label == "1b_side", "3b_side").when(label == "3b_side", "1b_side").otherwise(label)


def canonical_view(view: Column, side: Column) -> Column:
    """View after the left-handed player is mirrored to the right-handed side."""
    t = F.lower(F.trim(F.coalesce(view, F.lit(""))))
    left = batter_side(side) == "left"
    near, far = F.lit("1b_side"), F.lit("3b_side")
    label = (
        F.when(t == "side", F.when(left, far).otherwise(near))
        .when(t == "back", F.when(left, near).otherwise(far))
        .otherwise(view_label(t))
    )
    return F.when(left, swap_side(label)).otherwise(label)


def view_one_hot(label: Column) -> dict[str, Column]:
    known = F.when(label.isin(*VIEW_LABELS), label).otherwise("random")
    return {f"view_{name}": (known == name).cast("double") for name in VIEW_LABELS}


def mirrored_x(x: Column, flip: Column) -> Column:
    return F.when(flip, 1.0 - x).otherwise(x)


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Clamp; NULL stays NULL although greatest/least skip NULLs."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def flow_feature(name: str, value: Column, clip: float) -> Column:
    """A flow column by its kind: flags become 0 or 1, the others shares of ``clip``; missing is 0."""
    if not (0.0 < clip < INF):
        raise ValueError(f"the clip length must be a positive number of pixels, not {clip}")
    known = F.coalesce(value, F.lit(0.0))
    by_kind = {
        "flag": lambda: F.when(known > 0, 1.0).otherwise(0.0),
        "magnitude": lambda: clamp(known / clip, 0.0, 1.0),
        "signed": lambda: clamp(known / clip, -1.0, 1.0),
    }
    return by_kind[FLOW_KINDS[name]]()


def known_visibility(text: Column) -> Column:
    return F.when(text.isin(*VISIBILITIES), text).otherwise("fully_visible")


def visibility_weight(label: Column, weights: tuple[float, float, float, float]) -> Column:
    full, partial, hidden, ignored = weights
    return (
        F.when(label == "partially_occluded", partial)
        .when(label == "fully_occluded", hidden)
        .when(label == "ignore", ignored)
        .otherwise(full)
    ).cast("double")


def status_from_visibility(label: Column, seen: Column) -> Column:
    return (
        F.when((label == "ignore") & seen, "ignore_with_prediction")
        .when(label == "ignore", "ignore_no_prediction")
        .when(seen, "matched")
        .otherwise("missing_prediction")
    )


def error_bucket(err: Column) -> Column:
    e = finite(err)
    return (
        F.when(e.isNull(), -1).when(e < 5, 0).when(e < 10, 1).when(e < 20, 2).otherwise(3)
    )


def error_frame_weight(err: Column, visibility: Column, seen: Column, target_valid: Column) -> Column:
    base = F.when(err < 5, 0.3).when(err < 10, 1.0).when(err < 20, 2.0).otherwise(4.0)
    hard = (visibility != "fully_visible") | ~seen
    return F.when(hard, 4.0).otherwise(base) * target_valid.cast("double")


def quality_target(err: Column, good: float = 5.0, bad: float = 10.0) -> Column:
    return clamp((bad - err) / max(bad - good, 1e-6), 0.0, 1.0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def axis_components(px, py, hx, hy, tx, ty) -> tuple[Column, Column, Column]:
    """(u across, v along, Euclidean) of a head error on the true head->tail axis.

    u and v are rounded to 1e-9 px, so that the quality limits do not turn on the last bit.
    """
    ax, ay = tx - hx, ty - hy
    length = F.hypot(ax, ay)
    ok = (length > 1e-6) & finite(px).isNotNull() & finite(py).isNotNull()
    dx, dy = px - hx, py - hy
    u = F.when(ok, F.round((dx * -ay + dy * ax) / length, 9))
    v = F.when(ok, F.round((dx * ax + dy * ay) / length, 9))
    return u, v, F.when(ok, F.hypot(dx, dy))


def axis_quality(u: Column, v: Column) -> tuple[Column, Column, Column]:
    a = F.abs(u)
    uq = F.when(a < 2, "ok").when(a < 5, "slightly_bad").when(a < 10, "bad").when(a >= 10, "very_bad")
    vq = (
        F.when((v >= -3) & (v <= 5), "ok")
        .when((v >= -7) & (v <= 10), "slightly_bad")
        .when(v.isNotNull(), "bad")
    )
    both = (
        F.when(uq == "very_bad", "very_bad")
        .when((uq == "bad") | (vq == "bad"), "bad")
        .when((uq == "slightly_bad") | (vq == "slightly_bad"), "slightly_bad")
        .when(uq.isNotNull() & vq.isNotNull(), "ok")
    )
    return uq, vq, both


def trust_target(dx, dy, ox, oy, min_delta=0.5, min_gain=0.5, good_gain=3.0, eps=1e-6) -> Column:
    """Best share of the step (dx, dy) towards the wanted correction (ox, oy)."""
    norm2 = dx * dx + dy * dy
    t = clamp((ox * dx + oy * dy) / F.greatest(norm2, F.lit(eps)), 0.0, 1.0)
    gain = F.hypot(ox, oy) - F.hypot(t * dx - ox, t * dy - oy)
    quality = clamp((gain - min_gain) / max(good_gain - min_gain, eps), 0.0, 1.0)
    return F.when(norm2 >= min_delta ** 2, t * quality).otherwise(0.0)


def safe_name(text: Column) -> Column:
    kept = F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_")
    return F.coalesce(blank_to_null(F.regexp_replace(kept, r"^_+|_+$", "")), F.lit("view"))


def hand_from_name(stem: Column) -> Column:
    return F.upper(F.regexp_extract(stem, r"(?i)_(R|L)_", 1))



def fixed_text(value: Column, digits: int) -> Column:
    """Decimal text of a finite double: its exact binary value rounded half to even.

    Each value is formatted once; spelled out as arithmetic, the parts of the number would be computed again wherever they are used.
    From 2**53 on a double is a whole number, and its digits come from the whole number.
    """
    v = value.cast("double") + F.lit(0.0)  # no negative zero
    near = F.call_function("format_number", v, F.lit("0." + "0" * digits))
    far = F.concat(v.cast("bigint").cast("string"), F.lit("." + "0" * digits))
    text = F.when(F.abs(v) < 2.0 ** 53, near).otherwise(far)
    return F.when(finite(v).isNotNull(), text).when(v.isNotNull(), v.cast("string"))


def fixed6(value: Column) -> Column:
    return F.coalesce(fixed_text(value, 6), F.lit(""))


def array_quantile(sorted_values: Column, p: float) -> Column:
    """Linear-interpolated quantile of an ascending array; NULL when empty."""
    n = F.size(sorted_values)
    h = (n - 1) * F.lit(p)
    lo = F.floor(h).cast("int")
    hi = F.ceil(h).cast("int")
    a, b = F.get(sorted_values, lo), F.get(sorted_values, hi)
    return F.when(n > 0, a + (b - a) * (h - lo))


def array_median(sorted_values: Column) -> Column:
    """Mean of the middle element(s), as the sequential code takes it."""
    n = F.size(sorted_values)
    a = F.get(sorted_values, ((n - 1) / 2).cast("int"))
    b = F.get(sorted_values, (n / 2).cast("int"))
    return F.when(n > 0, F.when(n % 2 == 1, b).otherwise((a + b) / 2.0))
