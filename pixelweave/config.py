"""Named parameter sets.

The numbers below are fixed values: results depend on them, so they are stated
plainly and kept together.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---- fixed values shared by several operators -------------------------------
MAD_TO_SIGMA = 1.4826
LUMA = (0.2126, 0.7152, 0.0722)
CFA_PATTERNS = {  # colour of (y odd, x odd): 0 red, 1 green, 2 blue
    "RGGB": {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 2},
    "BGGR": {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 0},
    "GRBG": {(0, 0): 1, (0, 1): 0, (1, 0): 2, (1, 1): 1},
    "GBRG": {(0, 0): 1, (0, 1): 2, (1, 0): 0, (1, 1): 1},
}
DITHER_4X4 = (
    (-8, 0, -6, 2),
    (4, -4, 6, -2),
    (-5, 3, -7, 1),
    (7, -1, 5, -3),
)
PIXEL_FORMATS = {  # name: (bytes per sample, largest value)
    "Rgb8": (1, 255),
    "Rgb16": (2, 65535),
    "Rgb16Be": (2, 65535),
    "Bayer8": (1, 255),
    "Bayer16": (2, 65535),
    "Bayer16Be": (2, 65535),
}


@dataclass(frozen=True)
class Stats:
    max_samples: int | None = None  # a number asks for the strided sample
    min_samples: int = 0


@dataclass(frozen=True)
class Detection:
    sigma_threshold: float = 5.0
    search_radius: int = 3
    centroid_radius: int = 5
    hot_pixel_threshold: float = 0.9
    min_star_pixels: int = 3
    border_margin: int = 10
    max_stars: int | None = None
    min_snr: float = 5.0


DETECTION = {
    "default": Detection(),
    "sensitive": Detection(3.0, 3, 5, 0.85, 2, 10, None, 2.0),
    "aggressive": Detection(2.5, 2, 4, 0.80, 2, 8, None, 1.5),
    "fast": Detection(4.0, 2, 3, 0.85, 2, 10, None, 3.0),
}


@dataclass(frozen=True)
class Registration:
    max_stars: int | None = None  # first attempt only; `register` goes on to the remaining stars
    min_triangles: int = 3
    descriptor_tolerance: float = 0.05
    max_residual: float = 8.0
    min_matches: int = 4
    max_triangle_side: float = 600.0
    min_triangle_side: float = 10.0
    use_ransac: bool = True
    ransac_iterations: int = 150
    ransac_threshold: float = 6.0


REGISTRATION = {
    "default": Registration(50),
    "wide_field": Registration(30, 3, 0.04, 8.0, 3, 800.0, 20.0, True, 50, 6.0),
    "narrow_field": Registration(40, 3, 0.02, 3.0, 3, 300.0, 3.0, True, 50, 3.0),
    "robust": Registration(25, 2, 0.05, 10.0, 3, 600.0, 5.0, True, 80, 8.0),
    "permissive": Registration(20, 2, 0.08, 15.0, 3, 1000.0, 3.0, False, 30, 10.0),
    "fast": Registration(15, 2, 0.05, 10.0, 3, 600.0, 5.0, False, 0, 8.0),
}
CASCADE = ("fast", "robust")
CASCADE_THOROUGH = ("default", "wide_field", "narrow_field", "robust", "permissive")


@dataclass(frozen=True)
class Hints:
    """What is known about a session before it is registered."""

    field_of_view: str = "standard"  # wide | standard | narrow
    obstructions: bool = False
    satellites: bool = False
    brightness: str = "stable"  # stable | moderate | high

    def registration(self) -> Registration:
        base = REGISTRATION[{"wide": "wide_field", "narrow": "narrow_field"}.get(self.field_of_view, "default")]
        if self.obstructions or self.satellites:
            base = replace(
                base,
                use_ransac=True,
                ransac_iterations=200,
                ransac_threshold=base.ransac_threshold * 1.5,
                descriptor_tolerance=base.descriptor_tolerance * 1.5,
            )
        if self.brightness == "moderate":
            base = replace(base, max_residual=base.max_residual * 1.5)
        if self.brightness == "high":
            base = replace(base, max_residual=base.max_residual * 2.0, min_matches=max(3, base.min_matches - 1))
        return base


@dataclass(frozen=True)
class Weighting:
    fwhm_weight: float = 0.5
    snr_weight: float = 0.5
    min_weight: float = 0.1
    power: float = 1.0

    @property
    def disabled(self) -> bool:
        return (self.fwhm_weight == 0.0 and self.snr_weight == 0.0) or self.min_weight >= 1.0


WEIGHTING = {
    "balanced": Weighting(),
    "galaxies": Weighting(0.8, 0.2, 0.1, 1.5),
    "nebulae": Weighting(0.2, 0.8, 0.1, 1.0),
    "fwhm_only": Weighting(1.0, 0.0, 0.1, 1.0),
    "snr_only": Weighting(0.0, 1.0, 0.1, 1.0),
    "disabled": Weighting(0.0, 0.0, 1.0, 1.0),
}


@dataclass(frozen=True)
class Rejection:
    method: str = "none"  # none | sigma_clip | winsorized | min_max
    sigma_low: float = 2.5
    sigma_high: float = 2.5
    max_iterations: int = 3
    min_frames: int = 3


@dataclass(frozen=True)
class DeepSky:
    detection: Detection | None = None  # None: the adaptive cascade
    weighting: Weighting = field(default_factory=Weighting)
    rejection: Rejection = field(default_factory=Rejection)
    cascade: tuple[str, ...] = ("default",)
    hints: Hints | None = None
    min_stars: int = 3


DEEP_SKY = {
    "default": DeepSky(),
    "fast": DeepSky(cascade=("fast",)),
    "quality": DeepSky(
        cascade=("robust",),
        rejection=Rejection("winsorized", 2.0, 2.0),
        min_stars=5,
    ),
}

STACKING_TYPES = {  # uses star registration, aggressive stretch, sensor mode
    "deep_sky": (True, True, "low_readout_noise"),
    "planetary": (False, False, "normal"),
    "comet": (False, True, "low_readout_noise"),
}


@dataclass(frozen=True)
class Lucky:
    selection: float = 0.1
    min_frames: int = 10
    max_frames: int = 0
    search_radius: int = 50
    auto_tracking: bool = True
    method: str = "percentile"  # mean | median | percentile | weighted_mean
    percentile: float = 0.5
    metric: str = "laplacian"  # laplacian | sobel | tenengrad | stddev
    subpixel_factor: int = 2
    roi: tuple[int, int, int, int] | None = None


LUCKY = {
    "default": Lucky(),
    "lunar": Lucky(selection=0.05, min_frames=50, search_radius=30, metric="laplacian"),
    "planetary": Lucky(selection=0.10, min_frames=100, search_radius=50, metric="sobel"),
    "solar": Lucky(selection=0.15, min_frames=30, search_radius=40, metric="laplacian"),
}


@dataclass(frozen=True)
class Background:
    cols: int = 16
    rows: int = 16
    star_rejection_sigma: float = 2.5
    gradient_only: bool = True
    reference_percentile: float = 0.1
    aggressiveness: float = 1.0  # below zero: derived from the nodes


BACKGROUND = {
    "default": Background(),
    "nebulae": Background(12, 12, 2.5, True, 0.1, 0.7),
    "galaxies": Background(12, 12, 2.5, True, 0.1, 0.7),
    "star_field": Background(16, 16, 2.5, True, 0.1, 0.8),
    "light_pollution": Background(16, 16, 2.5, True, 0.1, 1.0),
    "adaptive": Background(12, 12, 2.0, True, 0.1, -1.0),
}
BACKGROUND_BY_STRETCH = {"high": "nebulae", "medium": "galaxies", "low": "star_field"}

# Node extraction and pruning, fixed values.
NODE_BOX_FRACTION = 0.015
NODE_BOX_MIN = 9
NODE_CLIP_ROUNDS = 3
NODE_CLIP_SIGMA = 3.0
PRUNE_SIGMA = 2.5
PRUNE_NEIGHBOUR_FACTOR = 1.05
MIN_VALID_NODES = 4


@dataclass(frozen=True)
class Stretch:
    target_background: float = 0.10
    black_point_sigma: float = 2.8
    min_stretch: float = 0.1
    max_stretch: float = 100.0
    tolerance: float = 0.001
    max_iterations: int = 50
    per_channel_black_point: bool = False
    tone: str = "asinh"  # asinh | mtf
    color_intensity: float = 1.0


# rules of the automatic stretch, fixed values
STRONG_SIGNAL, SOME_SIGNAL = 0.4, 0.2  # shares of samples above the background
STRONG_SIGMA, STRONG_SIGMA_LEAST, SOME_SIGMA = 0.6, 1.5, 0.8  # factors on the black point's sigmas, and their least
STRONG_TARGET, STRONG_TARGET_MOST = 1.3, 0.20  # factor on the target background, and its most
FAINT_LEVEL, LEAST_LEVEL = 0.001, 1e-6  # a background that near the black point keeps its level; the least level

STRETCH = {
    "default": Stretch(),
    "dark_sky": Stretch(0.10, 2.5),
    "preserve_faint": Stretch(0.20, 1.5),
    "light_polluted": Stretch(0.12, 3.0),
    "classic_live": Stretch(0.08, 3.0),
    "planetary": Stretch(0.05, 3.0, 0.1, 2.0),
    "low": Stretch(0.10, 1.5, 1.0, 20.0),
    "medium": Stretch(0.08, 1.5, 0.01, 0.5, tone="mtf"),
    "high": Stretch(0.11, 2.2, 0.001, 0.5, tone="mtf"),
}


@dataclass(frozen=True)
class Contrast:
    strength: float = 0.8
    midpoint: float = 0.2

    @property
    def disabled(self) -> bool:
        return self.strength < 1e-6


CONTRAST = {
    "default": Contrast(),
    "subtle": Contrast(0.3, 0.5),
    "moderate": Contrast(0.5, 0.5),
    "strong": Contrast(0.7, 0.5),
}


@dataclass(frozen=True)
class Saturation:
    strength: float = 0.5
    shadow_peak: float = 0.15
    upper_limit: float = 0.4


@dataclass(frozen=True)
class Render:
    background: Background | None = None
    stretch: Stretch | None = field(default_factory=Stretch)
    saturation: Saturation | None = None
    contrast: Contrast | None = field(default_factory=Contrast)

    def darkened(self, intensity: float) -> "Render":
        """Pull the sky towards black by 0.4 x intensity (clamped to [0, 1])."""
        k = min(max(intensity, 0.0), 1.0) * 0.4
        if k <= 0.0 or self.stretch is None:
            return self
        contrast = self.contrast or Contrast()
        return replace(
            self,
            stretch=replace(
                self.stretch,
                target_background=self.stretch.target_background * (1 - k) + 0.01 * k,
                black_point_sigma=self.stretch.black_point_sigma * (1 - k) + 1.0 * k,
            ),
            contrast=replace(contrast, strength=contrast.strength * (1 - k) + 1.0 * k),
        )


RENDER = {
    "default": Render(),
    "preview": Render(),
    "deep_sky": Render(background=Background(), saturation=Saturation()),
    "planetary": Render(stretch=STRETCH["planetary"], contrast=CONTRAST["subtle"]),
}
