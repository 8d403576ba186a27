"""Column lists, vocabularies and default settings of the data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

IMAGE_WIDTH = 1920.0
IMAGE_HEIGHT = 1080.0
WINDOW_SIZE = 31
WINDOW_STRIDE = 5

# Names and orders below are part of the data format.
FEATURE_SCHEMA_VERSION = "clean-observation-v1"
VIEW_LABELS = ("1b_side", "front", "3b_side", "home_side", "random")
FEATURES_25 = (
    "head_x_norm", "head_y_norm", "tail_x_norm", "tail_y_norm", "head_conf", "tail_conf", "head_valid", "tail_valid",
    "bat_dx_norm", "bat_dy_norm",
    "bat_length_over_image_diagonal", "bat_length_change_over_image_diagonal", "bat_unit_x", "bat_unit_y",
    "bat_direction_change_1_minus_cos", "head_speed_over_image_diagonal", "tail_speed_over_image_diagonal",
    "head_acceleration_over_image_diagonal", "tail_acceleration_over_image_diagonal",
    "window_time_minus1_to_plus1",
    "view_1b_side", "view_front", "view_3b_side", "view_home_side", "view_random",
)
FLOW_REGIONS = ("head", "tail", "bbox")
FLOW_SOURCE_COLUMNS = (
    "has_prev_flow", "head_valid", "tail_valid", "bbox_valid",
    "head_flow_x_mean", "head_flow_y_mean", "head_flow_mag_mean", "head_flow_mag_p95",
    "tail_flow_x_mean", "tail_flow_y_mean", "tail_flow_mag_mean", "tail_flow_mag_p95",
    "bbox_flow_x_mean", "bbox_flow_y_mean", "bbox_flow_mag_mean", "bbox_flow_mag_p95",
    "global_flow_x_mean", "global_flow_y_mean", "global_flow_mag_mean", "global_flow_mag_p95",
)
FLOW_FEATURES = (
    "has_prev_flow", "head_flow_region_valid", "tail_flow_region_valid", "bbox_flow_region_valid",
    "head_flow_x_mean_clipped_norm", "head_flow_y_mean_clipped_norm", "head_flow_mag_mean_clipped_norm", "head_flow_mag_p95_clipped_norm",
    "tail_flow_x_mean_clipped_norm", "tail_flow_y_mean_clipped_norm", "tail_flow_mag_mean_clipped_norm", "tail_flow_mag_p95_clipped_norm",
    "bbox_flow_x_mean_clipped_norm", "bbox_flow_y_mean_clipped_norm", "bbox_flow_mag_mean_clipped_norm", "bbox_flow_mag_p95_clipped_norm",
    "global_flow_x_mean_clipped_norm", "global_flow_y_mean_clipped_norm", "global_flow_mag_mean_clipped_norm", "global_flow_mag_p95_clipped_norm",
)
# What each flow column is: a yes-or-no flag, a length, or a signed component.
FLOW_KINDS = dict(zip(FLOW_SOURCE_COLUMNS, ("flag",) * 4 + ("signed", "signed", "magnitude", "magnitude") * 4, strict=True))
FEATURES_45 = FEATURES_25 + FLOW_FEATURES

KEYPOINTS = ("head", "tail")
AUX_KEYPOINT = "tail_visible_aux"
VISIBILITIES = ("fully_visible", "partially_occluded", "fully_occluded", "ignore")
OBSERVED_STATUSES = (
    "matched", "missing_prediction", "ignore_with_prediction", "ignore_no_prediction",
)
SCORE_PARTS = (
    "bbox_conf_score", "temporal_tail_jump", "temporal_head_jump", "length_jump",
    "direction_change", "bbox_center_jump", "anchor_cost",
)
DETAIL_COLUMNS = (
    "image_stem", "swing_id", "view", "batter_side", "frame", "keypoint", "visibility",
    "gt_x", "gt_y", "pred_x", "pred_y", "pred_conf", "bbox_conf", "detection_rank",
    "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "dx", "dy", "error_px", "status",
)
DETAIL_NUMBERS = (
    "gt_x", "gt_y", "pred_x", "pred_y", "pred_conf", "bbox_conf",
    "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "dx", "dy", "error_px",
)
PREDICTION_COLUMNS = (
    "swing_id", "image_stem", "frame_idx", "keypoint", "visibility", "target_valid",
    "obs_valid", "raw_x", "raw_y", "filled_x", "filled_y", "prior_x", "prior_y",
    "final_x", "final_y", "corrected_x", "corrected_y", "gt_x", "gt_y", "pred_conf",
    "trust", "yolo_quality", "raw_error_px", "filled_error_px", "prior_error_px",
    "final_error_px", "corrected_error_px", "final_shift_px",
)
IMAGE_EXTENSIONS = ("bmp", "jpg", "jpeg", "png", "tif", "tiff", "webp")
BAT_MARKERS = ("MARKER1", "MARKER2", "MARKER3")
BODY_MARKERS = (
    "LFHD", "RFHD", "LBHD", "RBHD", "C7", "CLAV", "STRN", "T10", "LSHO", "RSHO",
    "LELB", "RELB", "LWRA", "RWRA", "LFIN", "RFIN", "LASI", "RASI", "LPSI", "RPSI",
    "LKNE", "RKNE", "LANK", "RANK", "LTOE", "RTOE",
)
RECORD_COLUMNS = (
    "prediction_stem", "image_stem", "swing_id", "frame_no", "frame_name", "detections",
)
DETECTION_FIELDS = ("bbox_conf", "bbox", "head", "tail", "detection_rank")
GLOBAL_FLOW_STATS = (
    "flow_x_mean", "flow_y_mean", "flow_x_std", "flow_y_std", "flow_mag_mean",
    "flow_mag_std", "flow_mag_max", "flow_mag_p50", "flow_mag_p90", "flow_mag_p95",
    "flow_mag_p99",
)
REGION_FLOW_STATS = tuple(s for s in GLOBAL_FLOW_STATS if s != "flow_mag_p50")

DETECTION_TYPE = T.StructType([
    T.StructField("detection_rank", T.IntegerType()),
    T.StructField("bbox_conf", T.DoubleType()),
    T.StructField("bbox", T.StructType(
        [T.StructField(n, T.DoubleType()) for n in ("xc", "yc", "w", "h")])),
    T.StructField("head", T.StructType(
        [T.StructField(n, T.DoubleType()) for n in ("x", "y", "conf")])),
    T.StructField("tail", T.StructType(
        [T.StructField(n, T.DoubleType()) for n in ("x", "y", "conf")])),
])
RECORD_TYPE = T.StructType([
    T.StructField("prediction_stem", T.StringType()),
    T.StructField("image_stem", T.StringType()),
    T.StructField("swing_id", T.StringType()),
    T.StructField("frame_no", T.IntegerType()),
    T.StructField("frame_name", T.StringType()),
    T.StructField("detections", T.ArrayType(DETECTION_TYPE)),
])


@dataclass(frozen=True)
class SelectionSettings:
    """Weights of the sequential candidate choice (pixels, defaults of the tool)."""

    width: float = IMAGE_WIDTH
    height: float = IMAGE_HEIGHT
    bbox_conf_weight: float = 100.0
    anchor_radius: float = 300.0
    anchor_weight: float = 1.0


@dataclass(frozen=True)
class ScreenSettings:
    """Limits of the local outlier screen."""

    window: int = 5
    min_neighbors: int = 3
    min_length_ratio: float = 0.35
    max_length_ratio: float = 2.2
    center_base: float = 300.0
    center_spread_weight: float = 2.5


@dataclass(frozen=True)
class WindowSettings:
    """Row windows over a sequence and the image they refer to."""

    size: int = WINDOW_SIZE
    stride: int = WINDOW_STRIDE
    include_first: bool = True
    width: float = IMAGE_WIDTH
    height: float = IMAGE_HEIGHT
    flow_clip_px: float = 50.0

    def __post_init__(self) -> None:
        if self.size <= 0 or self.stride <= 0:
            raise ValueError("window size and stride must be positive")
        for name in ("width", "height"):
            value = getattr(self, name)
            if not (0.0 < value < float("inf")):
                raise ValueError("image width and height must be finite and positive")
        if not (0.0 < self.flow_clip_px < float("inf")):
            raise ValueError("flow_clip_px must be finite and positive")
