"""Fixed names and parameters of the data model."""

from __future__ import annotations

from dataclasses import dataclass

# The twenty numeric features of a cell, in the order of the features table.
FEATURES = [
    "dmvec1", "dmvec2", "dmvec3", "dmvec4", "dmvec5", "dmvec6", "dmvec7", "dmvec8", "dmvec9", "dmvec10",
    "area", "height", "horiz_std", "mean", "padded_size", "rotation", "rotation_confidence", "std", "vert_std", "width",
]


@dataclass(frozen=True)
class Parameters:
    """Fixed values of the reference's parameter file and scripts."""

    min_std: float = 10.0
    min_area: int = 10
    size_classes: tuple[int, ...] = (15, 51, 201)
    window: int = 224
    stride: int = 56
    microns_per_pixel: float = 0.46
    shift_step: int = 43
    shift_half_range: int = 20
    shift_margin: float = 200 / 0.46


PARAMETERS = Parameters()
