"""Two published image networks in NumPy, from their weights or seeded, and the tails that follow their local layers.

googlenet (Szegedy et al. 2015): local descriptors are the positions of one inception block, the global vector the average pool.
vit (Dosovitskiy et al. 2021): local descriptors are the patch tokens after the last norm, the global vector the class token.

Weights are an .npz of arrays, named as the usual public state dictionaries name them; without a file they are drawn by the
seed, which is for tests and dry runs only. A network is made once in each worker process. Images are bytes in order blue, green,
red, of any size.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable

import numpy as np

# Mean and spread of the channels red, green, blue that the public weights were fitted with.
MEAN, SPREAD = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)
# The inception blocks' channels by branch (1x1; 3x3 reduced, 3x3; second 3x3 reduced, second 3x3; pooled).
BLOCKS = {
    "inception3a": (64, 96, 128, 16, 32, 32), "inception3b": (128, 128, 192, 32, 96, 64),
    "inception4a": (192, 96, 208, 16, 48, 64), "inception4b": (160, 112, 224, 24, 64, 64), "inception4c": (128, 128, 256, 24, 64, 64), "inception4d": (112, 144, 288, 32, 64, 64), "inception4e": (256, 160, 320, 32, 128, 128),
    "inception5a": (256, 160, 320, 32, 128, 128), "inception5b": (384, 192, 384, 48, 128, 128),
}
ORDER = ("conv1", "maxpool1", "conv2", "conv3", "maxpool2", "inception3a", "inception3b", "maxpool3", "inception4a", "inception4b", "inception4c", "inception4d", "inception4e", "maxpool4", "inception5a", "inception5b", "avgpool")


def resize_linear(img: np.ndarray, size: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""

    def along(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    x = img.astype(np.float32)
    a, b, f = along(x.shape[0])
    x = x[a] * (1 - f)[:, None, None] + x[b] * f[:, None, None]
    a, b, f = along(x.shape[1])
    return x[:, a] * (1 - f)[None, :, None] + x[:, b] * f[None, :, None]


def prepared(images: list[np.ndarray], size: int) -> np.ndarray:
    """images x channels x rows x columns; grey images get three equal channels."""
    rows = []
    for img in images:
        img = img[:, :, None] if img.ndim == 2 else img
        img = np.repeat(img, 3, axis=2) if img.shape[2] == 1 else img[:, :, 2::-1]
        rows.append(((np.rint(resize_linear(img, size)) / 255 - MEAN) / SPREAD).transpose(2, 0, 1))
    return np.stack(rows).astype(np.float32)


def patches(x: np.ndarray, k: int, stride: int, pad: int, fill: float = 0.0, ceil: bool = False) -> np.ndarray:
    """images x channels x rows x columns x k x k, a view. ceil: a last window that begins inside may end outside."""
    n = x.shape[2]
    out = (n + 2 * pad - k) / stride + 1
    out = math.ceil(out) if ceil else math.floor(out)
    if ceil and (out - 1) * stride >= n + pad:
        out -= 1
    after = max(pad, (out - 1) * stride + k - n - pad)
    x = np.pad(x, ((0, 0), (0, 0), (pad, after), (pad, after)), constant_values=fill)
    return np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(2, 3))[:, :, : out * stride : stride, : out * stride : stride][:, :, :out, :out]


def max_pool(x: np.ndarray, k: int, stride: int, pad: int = 0) -> np.ndarray:
    return patches(x, k, stride, pad, -np.inf, ceil=True).max(axis=(4, 5))


class _Weights:
    """Arrays by name, or seeded ones where there is no file."""

    def __init__(self, path: str | None, seed: int):
        self.found = dict(np.load(path)) if path else None
        self.seed = seed

    def __call__(self, name: str, shape: tuple[int, ...], fill: float | None = None) -> np.ndarray:
        if self.found is not None:
            if name not in self.found or self.found[name].shape != shape:
                raise ValueError(f"weights hold no {name} of shape {shape}")
            return self.found[name].astype(np.float32)
        if fill is not None:
            return np.full(shape, fill, np.float32)
        r = np.random.default_rng([self.seed, zlib.crc32(name.encode())])
        return (r.normal(size=shape) * math.sqrt(2 / max(1, math.prod(shape[1:])))).astype(np.float32)


class GoogLeNet:
    """narrow divides all channels, for small seeded networks."""

    def __init__(self, weights: str | None = None, seed: int = 0, size: int = 224, narrow: int = 1, local: str = "inception4e"):
        if local not in ORDER or not local.startswith("inception"):
            raise ValueError(f"no layer {local!r}; there are {[n for n in ORDER if n.startswith('inception')]}")
        self.size, self.local = size, local
        w, c = _Weights(weights, seed), lambda n: max(1, n // narrow)
        self.layers: dict[str, Callable[[np.ndarray], np.ndarray]] = {}
        wide = 3
        for name, out, k, stride, pad in (("conv1", 64, 7, 2, 3), ("conv2", 64, 1, 1, 0), ("conv3", 192, 3, 1, 1)):
            self.layers[name] = self._conv(w, name, wide, c(out), k, stride, pad)
            wide = c(out)
        for name, branch in BLOCKS.items():
            a, b1, b2, d1, d2, e = map(c, branch)
            own = (
                [self._conv(w, f"{name}.branch1", wide, a, 1)],
                [self._conv(w, f"{name}.branch2.0", wide, b1, 1), self._conv(w, f"{name}.branch2.1", b1, b2, 3, 1, 1)],
                [self._conv(w, f"{name}.branch3.0", wide, d1, 1), self._conv(w, f"{name}.branch3.1", d1, d2, 3, 1, 1)],
                [lambda x: max_pool(x, 3, 1, 1), self._conv(w, f"{name}.branch4.1", wide, e, 1)],
            )
            self.layers[name] = functools.partial(self._block, own)
            wide = a + b2 + d2 + e
        for name, k, stride in (("maxpool1", 3, 2), ("maxpool2", 3, 2), ("maxpool3", 3, 2), ("maxpool4", 2, 2)):
            self.layers[name] = functools.partial(max_pool, k=k, stride=stride)
        self.layers["avgpool"] = lambda x: x.mean(axis=(2, 3))

    @staticmethod
    def _conv(w: _Weights, name: str, wide: int, out: int, k: int, stride: int = 1, pad: int = 0) -> Callable[[np.ndarray], np.ndarray]:
        kernel, (gain, bias, mean, var) = w(f"{name}.conv.weight", (out, wide, k, k)), (w(f"{name}.bn.{p}", (out,), f) for p, f in (("weight", 1.0), ("bias", 0.0), ("running_mean", 0.0), ("running_var", 1.0)))
        scale = gain / np.sqrt(var + 1e-3)
        flat, shift = (kernel * scale[:, None, None, None]).reshape(out, -1), bias - mean * scale

        def run(x: np.ndarray) -> np.ndarray:
            p = patches(x, k, stride, pad)
            n, _, rows, columns = p.shape[:4]
            got = p.transpose(0, 2, 3, 1, 4, 5).reshape(n * rows * columns, -1) @ flat.T + shift
            return np.maximum(got, 0).reshape(n, rows, columns, out).transpose(0, 3, 1, 2)

        return run

    @staticmethod
    def _block(branches: tuple, x: np.ndarray) -> np.ndarray:
        return np.concatenate([functools.reduce(lambda y, f: f(y), b, x) for b in branches], axis=1)

    def _run(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        for name in names:
            x = self.layers[name](x)
        return x

    def features(self, images: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """images x positions x channels of the local layer, and images x channels of the pool."""
        cut = ORDER.index(self.local) + 1
        x = self._run(prepared(images, self.size), ORDER[:cut])
        return x.reshape(*x.shape[:2], -1).transpose(0, 2, 1), self._run(x, ORDER[cut:])

    def tail(self, made: np.ndarray) -> np.ndarray:
        """images x positions x channels as the local layer would give them -> the pool. Only the usual local layer has a tail
        that public results rest on, and positions must be a square grid."""
        if self.local != "inception4e":
            raise ValueError(f"the tail follows inception4e, not {self.local}")
        side = math.isqrt(made.shape[1])
        if side * side != made.shape[1]:
            raise ValueError(f"{made.shape[1]} positions are not a square grid")
        x = made.astype(np.float32).transpose(0, 2, 1).reshape(len(made), made.shape[2], side, side)
        return self._run(x, ORDER[ORDER.index(self.local) + 1 :])


def _erf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26, off by 1.5e-7 at most."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    return np.sign(x) * (1 - t * np.exp(-x * x) * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))))


class VisionTransformer:
    def __init__(self, weights: str | None = None, seed: int = 0, size: int = 224, patch: int = 16, dim: int = 768, layers: int = 12, heads: int = 12, hidden: int = 3072):
        self.size, self.patch, self.heads, self.tokens = size, patch, heads, (size // patch) ** 2
        w = _Weights(weights, seed)
        self.conv = w("conv_proj.weight", (dim, 3, patch, patch)).reshape(dim, -1), w("conv_proj.bias", (dim,), 0.0)
        self.cls, self.pos = w("class_token", (1, 1, dim), 0.0), w("encoder.pos_embedding", (1, self.tokens + 1, dim))
        shapes = {"ln_1.weight": ((dim,), 1.0), "ln_1.bias": ((dim,), 0.0), "self_attention.in_proj_weight": ((3 * dim, dim), None), "self_attention.in_proj_bias": ((3 * dim,), 0.0), "self_attention.out_proj.weight": ((dim, dim), None), "self_attention.out_proj.bias": ((dim,), 0.0), "ln_2.weight": ((dim,), 1.0), "ln_2.bias": ((dim,), 0.0), "mlp.0.weight": ((hidden, dim), None), "mlp.0.bias": ((hidden,), 0.0), "mlp.3.weight": ((dim, hidden), None), "mlp.3.bias": ((dim,), 0.0)}
        self.layers = [{n: w(f"encoder.layers.encoder_layer_{i}.{n}", s, f) for n, (s, f) in shapes.items()} for i in range(layers)]
        self.norm = w("encoder.ln.weight", (dim,), 1.0), w("encoder.ln.bias", (dim,), 0.0)

    @staticmethod
    def _ln(x: np.ndarray, gain: np.ndarray, bias: np.ndarray) -> np.ndarray:
        x = x - x.mean(axis=-1, keepdims=True)
        return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + 1e-6) * gain + bias

    def _attend(self, x: np.ndarray, p: dict) -> np.ndarray:
        n, t, dim = x.shape
        q, k, v = (x @ p["self_attention.in_proj_weight"].T + p["self_attention.in_proj_bias"]).reshape(n, t, 3, self.heads, -1).transpose(2, 0, 3, 1, 4)
        s = q @ k.transpose(0, 1, 3, 2) / math.sqrt(dim // self.heads)
        s = np.exp(s - s.max(axis=-1, keepdims=True))
        out = (s / s.sum(axis=-1, keepdims=True)) @ v
        return out.transpose(0, 2, 1, 3).reshape(n, t, dim) @ p["self_attention.out_proj.weight"].T + p["self_attention.out_proj.bias"]

    def _encode(self, patch_tokens: np.ndarray) -> np.ndarray:
        x = np.concatenate((np.repeat(self.cls, len(patch_tokens), axis=0), patch_tokens), axis=1) + self.pos
        for p in self.layers:
            x = x + self._attend(self._ln(x, p["ln_1.weight"], p["ln_1.bias"]), p)
            y = self._ln(x, p["ln_2.weight"], p["ln_2.bias"]) @ p["mlp.0.weight"].T + p["mlp.0.bias"]
            x = x + (0.5 * y * (1 + _erf(y / math.sqrt(2)))) @ p["mlp.3.weight"].T + p["mlp.3.bias"]
        return self._ln(x, *self.norm)

    def features(self, images: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """images x patches x dim, and images x dim."""
        p = patches(prepared(images, self.size), self.patch, self.patch, 0).transpose(0, 2, 3, 1, 4, 5).reshape(len(images), self.tokens, -1)
        x = self._encode(p @ self.conv[0].T + self.conv[1])
        return x[:, 1:], x[:, 0]

    def tail(self, made: np.ndarray) -> np.ndarray:
        """images x patches x dim in the place of the patches' embeddings -> the class token."""
        if made.shape[1] != self.tokens:
            raise ValueError(f"{made.shape[1]} patches where the network has places for {self.tokens}")
        return self._encode(made.astype(np.float32))[:, 0]


NETWORKS = {"cnn": GoogLeNet, "vit": VisionTransformer}


@functools.cache
def _loaded(kind: str, settings: tuple):
    return NETWORKS[kind](**dict(settings))


def network(kind: str, **settings):
    """The network, made once per process and setting."""
    if kind not in NETWORKS:
        raise ValueError(f"no network {kind!r}; there are {sorted(NETWORKS)}")
    return _loaded(kind, tuple(sorted(settings.items())))


def extractor(kind: str, part: str, batch: int = 32, **settings) -> Callable[[list[np.ndarray]], list[np.ndarray]]:
    """images -> (positions, channels) of each (part: local), or (1, channels) (global), `batch` images at a time. What
    travels to the workers are the settings."""
    if part not in ("local", "global"):
        raise ValueError(f"a network gives local or global features, not {part!r}")

    def run(images: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for at in range(0, len(images), batch):
            local, whole = network(kind, **settings).features(images[at : at + batch])
            out += list(local) if part == "local" else [v[None] for v in whole]
        return out

    return run
