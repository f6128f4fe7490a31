"""Operations by name, for programs that choose them from parameters."""

from __future__ import annotations

from collections.abc import Callable

from .functions import pixels
from .operators import binning, fits, grids, harmonics, joins, kernels, mapalgebra, masking, matrices, painting, splits, timeseries, validation

MAP: dict[str, Callable] = {
    "single": mapalgebra.single, "pair": mapalgebra.combine, "weighted_sum": mapalgebra.weighted_sum, "mean_and_stddev": mapalgebra.mean_and_deviation, "blend": mapalgebra.blended, "stats": mapalgebra.statistics, "index": mapalgebra.index_map,
    "smooth_pixels": mapalgebra.smoothed, "mask_edge": mapalgebra.mask_edge, "fill": mapalgebra.filled, "pol_angle": mapalgebra.best_angle, "remove_md": mapalgebra.remove_monopole_dipole, "map2mask": mapalgebra.row_index,
    "degrade": binning.degraded, "upgrade": binning.upgraded, "degrade_noise": binning.degraded_noise, "paint": painting.paint, "sources": painting.source_map, "clusters": painting.add_clusters, "find_patch": painting.calmest_patch, "sun_mask": painting.sun_mask,
    "angles": painting.angle_moments, "analyse": harmonics.refined, "synthesise": harmonics.synthesise, "smooth": harmonics.windowed, "multipoles": harmonics.degree_range, "merge": harmonics.merged, "spectrum": harmonics.spectrum, "transfer": harmonics.transfer, "order": pixels.nested_to_ring,
}
MATRIX: dict[str, Callable] = {
    "multiply": matrices.multiply, "apply": matrices.apply, "sum": matrices.total, "pair": matrices.elementwise, "rms": matrices.rms, "from_rms": matrices.from_rms, "correlation": matrices.correlation, "mask": matrices.masked, "concat": matrices.block_diagonal, "compare": matrices.compare,
    "up_add": matrices.up_add, "power": kernels.matrix_power, "cutoff": kernels.without_weak_modes, "swap": kernels.swapped_weak_modes, "solve": kernels.conjugate_gradient, "weighted_sum": kernels.weighted_map_sum,
}
FIT: dict[str, Callable] = {
    "line": fits.line, "polynomial": fits.polynomial, "amplitude": fits.amplitude_grid, "scatter": fits.median_slope, "line_grid": grids.zoomed_line, "gaussian": grids.fit_gaussians, "template": grids.fit_template, "orthogonal": grids.orthogonal_slope, "noise": kernels.noise_fits, "metropolis": kernels.metropolis,
}
STREAM: dict[str, Callable] = {n: getattr(timeseries, n) for n in ("white_noise", "fill_isolated", "running", "runs", "sessions", "unwrapped", "turnarounds", "decimated", "azimuth_bins", "baselines", "spikes", "jumps", "weather", "best_lag")}
CHECK: dict[str, Callable] = {"stream": validation.stream_statistics, "bands": validation.band_chi2, "static": validation.static_cuts, "adaptive": validation.adaptive_cuts, "summary": validation.season_summary, "knife": splits.assign, "pte": splits.pte, "accept": masking.accept_sidebands, "mask": joins.wildcard_masked}
ALL = {"map": MAP, "matrix": MATRIX, "fit": FIT, "stream": STREAM, "check": CHECK}


def find(name: str) -> Callable:
    """The operation ``group.name``."""
    group, _, rest = name.partition(".")
    try:
        return ALL[group][rest]
    except KeyError:
        raise KeyError(f"no operation {name}; groups: " + ", ".join(f"{g} ({', '.join(sorted(o))})" for g, o in ALL.items())) from None
