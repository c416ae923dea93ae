"""Sky catalogues and photometric redshifts on Spark DataFrames."""

from skylattice.config import SurveyConfig

__all__ = ["SurveyConfig"]
