"""Survey settings: thresholds, bands and the columns that follow from them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Parameter names of the per-band source tables.
MATCHED_PARAMS = (
    "FWHM_WORLD", "SNR_WIN", "MAG_AUTO", "MAGERR_AUTO", "MAG_WIN", "MAGERR_WIN",
    "FLUX_AUTO", "FLUXERR_AUTO", "FLUX_WIN", "FLUXERR_WIN", "FLUX_APER", "FLUXERR_APER",
)
UNMATCHED_PARAMS = ("FWHM_WORLD", "SNR_WIN", "MAG_AUTO", "MAGERR_AUTO")

# Columns of the morphology table.
MORPHOLOGY_COLUMNS = (
    "id", "gal_mag", "gal_mag_err", "gal_flux", "gal_flux_err", "gal_g1", "gal_g1_err",
    "gal_g2", "gal_g2_err", "gal_gini", "gal_sb", "gal_rho4", "gal_sigma",
    "gal_resolution", "psf_sigma",
)


@dataclass(frozen=True)
class SurveyConfig:
    """Everything that differs between surveys.

    ``bands`` lists the photometric bands in table order; the first one carries the
    object number and is exempt from the magnitude sentinel and the zero-point shift.
    ``snr_max=None`` leaves the signal-to-noise range open at the top.
    """

    bands: tuple[str, ...]
    detection_band: str = "R"
    detection_cut: bool = True
    snr_min: float = 10.0
    snr_max: float | None = None
    fwhm_min_arcsec: float = 0.8
    mag_max: float = 30.0
    magerr_max: float = 0.5
    morph_magerr_max: float | None = None
    zero_point_shift: float = 0.0
    tolerance_arcsec: float = 0.3
    mag_sentinel_above: float = 98.0
    weight_bands: tuple[str, ...] = field(default=("r", "u", "i", "z"))

    @classmethod
    def open_range(cls, bands, **changes) -> "SurveyConfig":
        """Survey without an upper signal-to-noise limit and without a zero-point shift."""
        return replace(cls(bands=tuple(bands)), **changes)

    @classmethod
    def capped_range(cls, bands, **changes) -> "SurveyConfig":
        """Survey with SNR below 500, a morphology error cut and a -5 mag zero-point shift."""
        base = cls(
            bands=tuple(bands), snr_max=500.0, morph_magerr_max=0.5,
            zero_point_shift=-5.0, weight_bands=("r", "u", "i", "z", "g"),
        )
        return replace(base, **changes)

    @classmethod
    def uncut(cls, bands, **changes) -> "SurveyConfig":
        """Survey without a detection cut; the per-band cut still applies."""
        return replace(cls(bands=tuple(bands), detection_cut=False), **changes)
