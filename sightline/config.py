"""Every tunable of the engine in one place.

The numbers below are fixed values: they decide which rows qualify, so results
only agree with the documented behaviour when they are left as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

UNKNOWN = "unknown"


@dataclass(frozen=True)
class Scoring:
    # fixed values
    margin_ratio: float = 5.0 / 1080.0
    weights: dict = field(default_factory=lambda: {
        "cut_off": 0.25,
        "area_ratio": 0.20,
        "aspect_ratio": 0.15,
        "det_conf": 0.10,
        "overlap": 0.30,
    })
    good: float = 0.7
    mid: float = 0.4


@dataclass(frozen=True)
class Sampling:
    # fixed values
    drop_overlap: float = 0.5
    force_confidence: float = 0.55
    force_visibility: float = 0.72
    force_max_overlap: float = 0.35
    force_min_cutoff: float = 0.6
    force_min_area: float = 0.0075
    floor: float = 0.15
    stale_frames: int = 30
    rates: dict = field(default_factory=lambda: {"good": 2, "mid": 3, "bad": 5})
    skip_with_boxes: int = 5
    skip_without_boxes: int = 30
    change_level: float = 25.5


@dataclass(frozen=True)
class Tracklets:
    # fixed values
    min_entries: int = 6
    max_entries: int = 60
    window_frames: int = 90
    stale_frames: int = 150
    min_quality_frames: int = 3
    quality_frame: float = 0.55
    good_frame: float = 0.6
    min_consistency: float = 0.35
    top_k: int = 5
    min_gap: int = 3
    overlap_penalty: float = 0.3
    consensus: float = 0.66
    gamma: float = 0.5
    outlier: float = 0.5
    max_overlap: float = 0.40
    split_below: float = 0.55
    split_min_v: float = 0.6
    split_interval: int = 6
    split_memory: int = 16


@dataclass(frozen=True)
class Static:
    # fixed values
    max_width: float = 130.0
    max_height: float = 260.0
    max_path: float = 0.05
    max_endpoint: float = 0.02
    min_size_stability: float = 0.97
    min_position_stability: float = 0.97
    min_entries: int = 6
    boundary_skip: float = 0.3
    spread_ratio: float = 1.5
    min_tracklets: int = 2
    zero_motion_x: float = 150.0
    zero_motion_y: float = 45.0
    zero_motion_tracklets: int = 1
    pretrack_frames: int = 4
    pretrack_drift: float = 6.0
    edge_px: float = 2.0


@dataclass(frozen=True)
class Matching:
    # fixed values
    threshold: float = 0.73
    low_visibility: float = 0.65
    low_visibility_threshold: float = 0.75
    margin: float = 0.06
    consensus_weight: float = 0.5
    top_k: int = 5
    min_consistency: float = 0.55
    certain: float = 0.92
    blocked: float = 0.90
    continuity: float = 0.50
    switch_score: float = 0.78
    switch_margin: float = 0.18
    switch_current: float = 0.70
    certain_margin: float = 0.22
    spatial_reuse: float = 0.62
    soft: float = 0.73
    eager: float = 0.73
    capped: float = 0.57
    near: float = 0.60
    near_mint_below: float = 0.64
    aux: float = 0.66
    aux_margin: float = 0.03
    aux_support: float = 0.62
    aux_top_k: int = 3
    mint_v: float = 0.6
    mint_consistency: float = 0.65
    mint_entries: int = 6
    mint_quality_frames: int = 3
    max_attempts: int = 5
    update_v: float = 0.6
    update_consistency: float = 0.7
    update_entries: int = 5
    update_score: float = 0.50
    update_max_overlap: float = 0.25
    update_overall: float = 0.80
    aux_v: float = 0.70
    aux_consistency: float = 0.80
    aux_entries: int = 5
    aux_max_overlap: float = 0.35
    provisional: float = 0.75
    provisional_margin: float = 0.03
    provisional_reentry: float = 0.55
    provisional_max_overlap: float = 0.40
    gallery_size: int = 8
    reuse_seconds: float = 2.5
    reuse_frames: int = 75
    reuse_iou: float = 0.2
    reuse_centre: float = 0.75
    recent_seconds: float = 4.0
    recent_frames: int = 120
    recent_iou: float = 0.1
    recent_centre: float = 0.9
    active_seconds: float = 0.6
    active_frames: int = 18
    duplicate_iou: float = 0.5
    distinct_iou: float = 0.15
    distinct_centre: float = 0.55
    memory_frames: int = 180
    memory_centre: float = 1.25
    reentry_entries: int = 8
    reentry_frames: int = 120
    reentry_centre: float = 2.0


@dataclass(frozen=True)
class Labels:
    # task names: the caller's own
    stable: tuple = ("carried", "headwear", "lower", "upper")
    scale_stable: tuple = ("headwear", "lower", "upper", "eyewear")
    # fixed values
    strong: float = 0.85
    moderate: float = 0.60
    accept: float = 0.7
    flip: float = 0.85
    hard_flip: float = 0.65
    committed: float = 0.80
    committed_runs: int = 2
    tracklet_floor: float = 0.55
    tracklet_strong: float = 0.88
    ready_confidence: float = 0.80
    ready_support: int = 2
    mask_tracklet: float = 0.70
    mask_entity: float = 0.80
    bridge_hard: float = 0.70
    bridge: float = 0.70
    high: float = 0.65
    scale: float = 0.65
    clothing: float = 0.70
    singleton_hard: float = 0.80
    singleton_unknown: float = 0.88
    unreliable_overlap: float = 0.35


@dataclass(frozen=True)
class Descriptors:
    # fixed values
    min_visibility: float = 0.5
    max_overlap: float = 0.30
    min_frames: int = 3
    max_frames: int = 12
    conflict_below: float = 0.83


@dataclass(frozen=True)
class Clusters:
    # fixed values
    min_confidence: float = 0.25
    min_visibility: float = 0.35
    max_track_iou: float = 0.20
    max_gap: int = 60
    max_centre: float = 0.95
    min_similarity: float = 0.62
    similarity_min_v: float = 0.55
    max_entries: int = 30
    flush_after: int = 36
    promote_entries: int = 6
    promote_v: float = 0.65
    fast_entries: int = 5
    fast_v: float = 0.85
    fast_overall: float = 0.83
    lastresort_v: float = 0.85
    lastresort_entries: int = 6
    persist_steps: tuple = (2, 3, 5, 8, 12, 16, 22, 30, 40, 55, 75, 100)
    candidate_entries: int = 2
    candidate_v: float = 0.45
    fragment_gap: int = 180
    fragment_centre: float = 1.8
    fragment_similarity: float = 0.62
    fragment_min: int = 2
    fragment_entries: int = 5


@dataclass(frozen=True)
class Merging:
    # fixed values
    min_score: float = 0.90
    established: float = 0.78
    weak: int = 2
    singleton_score: float = 0.90
    singleton_support: int = 3
    margin: float = 0.10
    bridge_margin: float = 0.12
    cross_score: float = 0.50
    cross_margin: float = 0.12
    cross_max: int = 8
    candidate_floor: float = 0.50
    retries: int = 3
    passes: int = 3
    attribute_override: float = 0.80
    cooccur_override: float = 0.85
    reentry_centre: float = 2.0


SCORING = Scoring()
SAMPLING = Sampling()
TRACKLETS = Tracklets()
STATIC = Static()
MATCHING = Matching()
LABELS = Labels()
DESCRIPTORS = Descriptors()
CLUSTERS = Clusters()
MERGING = Merging()
