"""Column expressions (JVM-side, codegen friendly) shared by the operators."""

from semweave.functions.text import (
    year_from_date, strip_text, word_count, first_line, clean_title, tau_tag,
    WS_CLASS,
)
from semweave.functions.vector import l2_normalize, dot, cosine_distance
from semweave.functions.binning import (
    HIST_LO, HIST_HI, HIST_BINS, hist_step, bin_edge, distance_bin,
)
from semweave.functions.stats import exact_quantiles

__all__ = [
    "year_from_date", "strip_text", "word_count", "first_line", "clean_title",
    "tau_tag", "WS_CLASS", "l2_normalize", "dot", "cosine_distance",
    "HIST_LO", "HIST_HI", "HIST_BINS", "hist_step", "bin_edge", "distance_bin",
    "exact_quantiles",
]
