"""A recurrent variational auto-encoder with soft clusters, run forward in numpy on the executors.

Weights are a mapping of names to arrays in the usual layout of GRU, linear and norm layers (gates in the order
reset, update, new; `_reverse` for the backward direction), for instance an exported state dict as .npz. Windows are
scored where they are, in Arrow batches; a model is loaded once a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwell.operators.features import window_arrays

NORM_EPSILON = 1e-5
LOG_EPSILON = 1e-10


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Network:
    """encode, decode and assign for a batch of windows (n, steps, features)."""

    def __init__(self, weights: Mapping[str, np.ndarray], prefix: str = "xvae.", centers: str = "dec_layer.centroids", alpha: float = 1.0) -> None:
        self.w = {k.removeprefix(prefix): np.asarray(v, np.float64) for k, v in weights.items()}
        self.centers, self.alpha = self.w.get(centers), alpha
        self.categorical = "categorical_encoder.gru.weight_ih_l0" in self.w

    def _linear(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ self.w[f"{name}.weight"].T + self.w[f"{name}.bias"]

    def _pass(self, name: str, x: np.ndarray, suffix: str) -> np.ndarray:
        """One direction of one GRU layer."""
        w_in, w_h = self.w[f"{name}.weight_ih_{suffix}"], self.w[f"{name}.weight_hh_{suffix}"]
        b_in, b_h = self.w[f"{name}.bias_ih_{suffix}"], self.w[f"{name}.bias_hh_{suffix}"]
        d = w_h.shape[1]
        h, out, inputs = np.zeros((len(x), d)), np.empty((*x.shape[:2], d)), x @ w_in.T + b_in
        steps = range(x.shape[1])
        for t in reversed(steps) if suffix.endswith("_reverse") else steps:
            a, g = inputs[:, t], h @ w_h.T + b_h
            reset, update = _sigmoid(a[:, :d] + g[:, :d]), _sigmoid(a[:, d : 2 * d] + g[:, d : 2 * d])
            h = (1 - update) * np.tanh(a[:, 2 * d :] + reset * g[:, 2 * d :]) + update * h
            out[:, t] = h
        return out

    def _gru(self, name: str, x: np.ndarray) -> np.ndarray:
        layer = 0
        while f"{name}.weight_ih_l{layer}" in self.w:
            both = [self._pass(name, x, f"l{layer}")]
            if f"{name}.weight_ih_l{layer}_reverse" in self.w:
                both.append(self._pass(name, x, f"l{layer}_reverse"))
            x, layer = np.concatenate(both, 2), layer + 1
        return x

    def _encoded(self, name: str, x: np.ndarray) -> np.ndarray:
        h = self._gru(f"{name}.gru", x)
        h = (h - h.mean(2, keepdims=True)) / np.sqrt(h.var(2, keepdims=True) + NORM_EPSILON) * self.w[f"{name}.layer_norm.weight"] + self.w[f"{name}.layer_norm.bias"]
        score = self._linear(f"{name}.attention.attention", h)
        share = np.exp(score - score.max(1, keepdims=True))
        return (h * share / share.sum(1, keepdims=True)).sum(1)

    def encode(self, numerical: np.ndarray, categorical: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and log-variance of each window's latent distribution."""
        h = self._encoded("numerical_encoder", numerical)
        if self.categorical:
            h = np.concatenate([h, self._encoded("categorical_encoder", categorical)], 1)
        return self._linear("fc_mu", h), self._linear("fc_logvar", h)

    def _decoded(self, name: str, z: np.ndarray, steps: int) -> np.ndarray:
        h = np.maximum(self._linear(f"{name}.fc_in", z), 0)
        return self._linear(f"{name}.fc_out", self._gru(f"{name}.gru", np.repeat(h[:, None], steps, 1)))

    def decode(self, z: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Numerical windows, and categorical ones as probabilities."""
        numerical = self._decoded("numerical_decoder", z, steps)
        return numerical, _sigmoid(self._decoded("categorical_decoder", z, steps)) if self.categorical else np.zeros((len(z), steps, 0))

    def assign(self, z: np.ndarray) -> np.ndarray:
        """Shares of each cluster, by Student's t similarity to its centre."""
        near = ((z[:, None] - self.centers[None]) ** 2).sum(2)
        q = (1 + near / self.alpha) ** (-(self.alpha + 1) / 2)
        return q / q.sum(1, keepdims=True)

    def errors(self, numerical: np.ndarray, categorical: np.ndarray) -> np.ndarray:
        """Mean squared error of the numerical windows rebuilt from their latent means."""
        mu, _ = self.encode(numerical, categorical)
        return ((numerical - self.decode(mu, numerical.shape[1])[0]) ** 2).mean((1, 2))


def load_npz(path: str) -> Network:
    with np.load(path) as f:
        return Network(dict(f))


def _stacked(windows: pd.Series, n: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([np.stack(w) for w in windows], np.float64)
    return x[:, :, :n], x[:, :, n:]


SCORED = "resource_id string, window_id long, end_time timestamp, error double, mu array<double>, cluster_id int, confidence double"


def score_arrays(windows: DataFrame, n_numerical: int, load: Callable[[], Network]) -> DataFrame:
    """Windows (resource_id, window_id, end_time, x: steps of numerical, then categorical values) to reconstruction error, latent mean, cluster and confidence; the first of equal clusters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = load()
        for b in batches:
            if not len(b):
                continue
            x_num, x_cat = _stacked(b.x, n_numerical)
            mu, _ = net.encode(x_num, x_cat)
            error = ((x_num - net.decode(mu, x_num.shape[1])[0]) ** 2).mean((1, 2))
            known = net.centers is not None
            q = net.assign(mu) if known else np.full((len(b), 1), np.nan)
            yield b[["resource_id", "window_id", "end_time"]].assign(error=error, mu=list(mu), cluster_id=pd.array(q.argmax(1) if known else [None] * len(b), "Int32"), confidence=q.max(1) if known else None)

    return windows.select("resource_id", "window_id", "end_time", "x").mapInPandas(run, SCORED)


def score_windows(rows: DataFrame, numerical: Sequence[str], categorical: Sequence[str], load: Callable[[], Network]) -> DataFrame:
    """score_arrays of window rows: normalised ones of `numerical`, encoded ones of `categorical`."""
    return score_arrays(window_arrays(rows, [*numerical, *categorical]), len(numerical), load)


def scorer(load: Callable[[], Network], categorical: Sequence[str] = ()) -> Callable:
    """A scorer of windows for suites and thresholds."""

    def score(rows: DataFrame, features: Sequence[str]) -> DataFrame:
        return score_windows(rows, features, categorical, load).select("resource_id", "window_id", "end_time", "error")

    return score


def losses(net: Network, numerical: np.ndarray, categorical: np.ndarray, p: np.ndarray | None = None, beta: float = 1.0, cluster: float = 0.0, balance: float = 0.0) -> dict[str, float]:
    """The terms of the training loss of a batch, at the latent means: squared error, cross-entropy, divergence from a unit normal, and with targets p the divergence of the clusters from them and the entropy of their sizes."""
    mu, logvar = net.encode(numerical, categorical)
    x_num, x_cat = net.decode(mu, numerical.shape[1])
    out = {"recon_num": float(((numerical - x_num) ** 2).mean())}
    safe = np.clip(x_cat, 1e-12, 1 - 1e-12)
    out["recon_cat"] = float(-(categorical * np.log(safe) + (1 - categorical) * np.log(1 - safe)).mean()) if x_cat.size else 0.0
    out["kl_vae"] = float((-0.5 * (1 + logvar - mu**2 - np.exp(logvar)).sum(1)).mean())
    out["loss"] = out["recon_num"] + out["recon_cat"] + beta * out["kl_vae"]
    if p is not None:
        q = net.assign(mu)
        out["kl_cluster"] = float((p * np.log((p + LOG_EPSILON) / (q + LOG_EPSILON))).sum(1).mean())
        out["loss"] += cluster * out["kl_cluster"]
        if balance > 0:
            size = q.mean(0)
            out["balance_entropy"] = float(-(size * np.log(size + LOG_EPSILON)).sum())
            out["loss"] -= balance * out["balance_entropy"]
    return out


def random_network(numerical: int, categorical: int, hidden: int = 8, latent: int = 4, clusters: int = 5, layers: int = 2, seed: int = 0) -> Network:
    """Seeded weights of the right shapes: a stand-in where no trained ones are at hand."""
    draw = partial(np.random.default_rng(seed).normal, 0, 0.3)
    w: dict[str, np.ndarray] = {}

    def linear(name: str, out: int, into: int) -> None:
        w[f"{name}.weight"], w[f"{name}.bias"] = draw((out, into)), draw(out)

    def gru(name: str, into: int, both: bool) -> None:
        for layer in range(layers):
            for end in ("", "_reverse") if both else ("",):
                width = into if layer == 0 else hidden * (1 + both)
                for kind, size in (("weight_ih", (3 * hidden, width)), ("weight_hh", (3 * hidden, hidden)), ("bias_ih", 3 * hidden), ("bias_hh", 3 * hidden)):
                    w[f"{name}.{kind}_l{layer}{end}"] = draw(size)

    merged = 0
    for name, n in (("numerical", numerical), ("categorical", categorical)):
        if n:
            gru(f"{name}_encoder.gru", n, True)
            w[f"{name}_encoder.layer_norm.weight"], w[f"{name}_encoder.layer_norm.bias"] = np.ones(2 * hidden), np.zeros(2 * hidden)
            linear(f"{name}_encoder.attention.attention", 1, 2 * hidden)
            linear(f"{name}_decoder.fc_in", hidden, latent)
            gru(f"{name}_decoder.gru", hidden, False)
            linear(f"{name}_decoder.fc_out", n, hidden)
            merged += 2 * hidden
    linear("fc_mu", latent, merged)
    linear("fc_logvar", latent, merged)
    w["dec_layer.centroids"] = draw((clusters, latent))
    return Network(w)


def predictions(scored: DataFrame) -> DataFrame:
    """Per resource its last window's cluster: name, action, priority and confidence."""
    from brightwell.operators.clustering import describe_clusters

    last = scored.groupBy("resource_id").agg(F.max_by(F.struct("cluster_id", "confidence", "end_time"), F.struct("end_time", "window_id")).alias("l")).select("resource_id", "l.*")
    return describe_clusters(last)
