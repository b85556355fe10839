"""Names of settings, usable wherever their plain strings are."""

from __future__ import annotations

from enum import StrEnum


class WindowFunction(StrEnum):
    NONE = "none"
    HAMMING = "hamming"
    HANNING = "hanning"
    BARTLETT = "bartlett"
    BLACKMAN = "blackman"


class SpectralTransform(StrEnum):
    RAW_COMPLEX = "raw_complex"
    REAL = "real"
    IMAG = "imag"
    REL_POWER = "rel_power"
    REL_DB = "rel_db"


class SpectralOutput(StrEnum):
    FULL = "full"
    POSITIVE = "positive"
    NEGATIVE = "negative"


class Anchor(StrEnum):
    BEGINNING = "beginning"
    MIDDLE = "middle"
    END = "end"


class FilterbankMode(StrEnum):
    CONV = "conv"
    FFT = "fft"
    AUTO = "auto"


class MinPhase(StrEnum):
    NONE = "none"
    HILBERT = "hilbert"
    HOMOMORPHIC = "homomorphic"


class CancelMethod(StrEnum):
    NOTCH = "notch"
    SUBTRACT = "subtract"
    PASSTHROUGH = "passthrough"
