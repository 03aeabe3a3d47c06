"""Driver-side readers and writers: configuration S9, feature lists S10, parameters S11, S12, K11, isotope tables S14."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

#: Configuration keys and their defaults. A list is repeatable.
DEFAULTS: dict[str, float | list] = {
    "lambda": 0.01, "ionization_mode": 1, "em_converge_thresh": 0.001, "ga_converge_thresh": 0.0001, "update_bias_first": 0, "model_depth": 2, "spectrum_depth": [], "spectrum_weight": [],
    "abs_mass_tol": 0.01, "ppm_mass_tol": 10.0, "num_em_restarts": 3, "starting_step_size": 0.001, "ending_step_size": -0.001, "decay_rate": 0.1, "fg_depth": 2, "allow_frag_detours": 1,
    "max_ring_breaks": 2, "include_isotopes": 0, "isotope_thresh": 1.0, "ga_method": 2, "param_init_type": 3, "use_lower_energy_params_for_init": 0, "theta_function": 1,
    "theta_nn_hlayer_num_nodes": [], "theta_nn_layer_act_func_ids": [], "nn_layer_dropout_probs": [], "nn_layer_freeze": [], "ga_minibatch_nth_size": 1, "ga_max_iterations": 20,
    "ga_momentum": 0.9, "ga_adam_beta_1": 0.9, "ga_adam_beta_2": 0.999, "ga_adam_eps": 1e-8, "ga_adamw_w": 0.01, "ga_adam_ga_adam_use_amsgrad": 0, "ga_adadelta_rho": 0.95,
    "ga_decay_method": 0, "exp_decay_k": 0.001, "step_decay_drop": 0.5, "step_decay_epochs_drop": 10, "obs_function": 1, "include_h_losses": 0, "include_precursor_h_losses_only": 0,
    "fragraph_compute_timeout_in_secs": -1, "ga_use_best_q": 0, "ga_sampling_method": 0, "ga_sampling_method2": 0, "ga_reset_sampling": 0, "ga_sampling_max_selection": 100,
    "ga_diff_sampling_peak_num": 30, "ga_diff_sampling_difference": 0.1, "disable_cross_val_metrics": 0, "disable_training_metrics": 0, "disable_cpu_usage_metrics": 1,
    "em_no_progress_count": 2, "ga_no_progress_count": 3, "collected_all_used_idx": 0, "em_max_iterations": 100, "allow_intermediate_peak": 0, "allow_cyclization": 0,
    "use_log_scale_peak": 0, "use_iterative_fg_gen": 0, "default_predicted_peak_min": 1, "default_predicted_peak_max": 30, "default_predicted_min_intensity": 0.0,
    "default_postprocessing_energy": 80.0, "default_mz_decimal_place": 5, "intensity_msg_weight": 0.01,
}


def _lines(text: str | Iterable[str]) -> list[str]:
    return text.splitlines() if isinstance(text, str) else list(text)


def config(text: str | Iterable[str]) -> dict[str, float | list]:
    """``name value`` lines. # lines and lines under three characters are skipped; the last scalar wins, lists grow; an unknown key warns."""
    out = {k: list(v) if isinstance(v, list) else v for k, v in DEFAULTS.items()}
    for line in _lines(text):
        if len(line) < 3 or line.startswith("#"):
            continue
        key, _, value = line.strip().partition(" ")
        if key not in out:
            warnings.warn(f"unknown configuration key {key}", stacklevel=2)
        elif isinstance(out[key], list):
            out[key].append(float(value))
        else:
            out[key] = float(value) if isinstance(DEFAULTS[key], float) else int(float(value))
    if not out["spectrum_depth"]:
        out["spectrum_depth"] = [out["model_depth"]]
    return out


def feature_list(text: str | Iterable[str], known: Iterable[str]) -> list[str]:
    """Names up to the first of one character or none; an unknown name or an empty list is an error."""
    out = []
    for line in _lines(text):
        name = line.strip()
        if len(name) <= 1:
            break
        if name not in known:
            raise ValueError(f"unknown feature {name}")
        out.append(name)
    if not out:
        raise ValueError("no features")
    return out


@dataclass
class Parameters:
    features: list[str]
    energies: int
    weights: np.ndarray
    layers: list[tuple[int, int, float, int]] = field(default_factory=list)  # nodes, activation, dropout, frozen


def write_parameters(p: Parameters) -> str:
    """Sparse if under a quarter of the weights is not 0."""
    at = np.flatnonzero(p.weights)
    sparse = len(at) < 0.25 * len(p.weights)
    out = [*(["SPARSE"] if sparse else []), str(len(p.features)), " ".join(p.features), str(p.energies), str(len(p.weights))]
    if sparse:
        out.append(str(len(at)))
        out += [" ".join(f"{i} {float(p.weights[i])!r}" for i in at[k:k + 20]) for k in range(0, len(at), 20)]
    else:
        out += [" ".join(repr(float(x)) for x in p.weights[k:k + 50]) for k in range(0, len(p.weights), 50)]
    if p.layers:
        out += ["Neural Net Config", str(len(p.layers)), *(" ".join(map(str, layer)) for layer in p.layers)]
    return "\n".join(out) + "\n"


def read_parameters(text: str, network: bool = False) -> Parameters:
    """A network must have its block."""
    lines = iter(text.splitlines())
    first = next(lines)
    sparse = first == "SPARSE"
    n = int(next(lines) if sparse else first)
    names = next(lines).split()
    if len(names) != n:
        raise ValueError(f"{n} features announced, {len(names)} given")
    energies, size = int(next(lines)), int(next(lines))
    weights, got = np.zeros(size), 0
    if sparse:
        wanted = int(next(lines))
        while got < wanted:
            words = next(lines).split()
            for i, v in zip(words[::2], words[1::2], strict=True):
                weights[int(i)] = float(v)
                got += 1
    else:
        while got < size:
            row = np.array(next(lines).split(), float)
            weights[got:got + len(row)] = row
            got += len(row)
    layers = []
    for line in lines:
        if line == "Neural Net Config":
            for _ in range(int(next(lines))):
                a, b, p, f = next(lines).split()
                layers.append((int(a), int(b), float(p), int(f)))
    if network and not layers:
        raise ValueError("no network block")
    return Parameters(names, energies, weights, layers)


def isotope_table(text: str | Iterable[str]) -> dict[str, list[tuple[float, float]]]:
    """(mass, abundance) by element; gaps in nominal mass become entries of no abundance."""
    out: dict[str, list[tuple[float, float]]] = {}
    name = None
    for line in [*_lines(text), ""]:
        words = line.split()
        if not words:
            name = None
        elif name is None:
            name = words[0]
            out[name] = []
        else:
            mass, share = float(words[0]), float(words[1])
            rows = out[name]
            while rows and round(mass) - round(rows[-1][0]) > 1:
                rows.append((rows[-1][0] + 1, 0.0))
            rows.append((mass, share))
    return out


