"""Wavelet names and filters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each family is called, after lower-casing and dropping spaces, hyphens and dots.
ALIASES = {
    "haar": ("haar", "db1", "daubechies1"),
    "db4": ("db4", "daubechies4"),
    "c3": ("c3", "coif3", "coiflet3", "coif6"),
    "s8": ("s8", "sym8", "symmlet8", "symlet8"),
    "bior4.4": ("bior44", "biorthogonal44", "cdf97"),
}
#: Published low-pass filters and lifting steps.
TAPS = {
    "db4": (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278),
    "c3": (-3.459977283621256e-05, -7.098330313814125e-05, 0.0004662169601128863, 0.0011175187708906016, -0.0025745176887502236, -0.00900797613666158, 0.015880544863615904, 0.03455502757306163, -0.08230192710688598, -0.07179982161931202, 0.42848347637761874, 0.7937772226256206, 0.4051769024096169, -0.06112339000267287, -0.0657719112818555, 0.023452696141836267, 0.007782596427325418, -0.003793512864491014),
    "s8": (-0.0033824159510061256, -0.0005421323317911481, 0.03169508781149298, 0.007607487324917605, -0.1432942383508097, -0.061273359067658524, 0.4813596512583722, 0.7771857517005235, 0.3644418948353314, -0.05194583810770904, -0.027219029917056003, 0.049137179673607506, 0.003808752013890615, -0.01495225833704823, -0.0003029205147213668, 0.0018899503327594609),
}
LIFTING = (-1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971)
LIFTING_SCALE = 1.230174104914001
MANDATORY = ("db4", "c3", "s8", "bior4.4")


def canonical(name: str) -> str:
    """The family of a name in any of its spellings."""
    key = name.strip().lower().translate({ord(c): None for c in " -."})
    for family, names in ALIASES.items():
        if key in names:
            return family
    raise ValueError(f"unknown wavelet {name!r}")


def canonical_column(name: Column) -> Column:
    """The family of each name of a column in any of its spellings; null for an unknown one."""
    key = F.regexp_replace(F.lower(F.trim(name)), "[ .-]", "")
    out = F.lit(None).cast("string")
    for family, names in ALIASES.items():
        out = F.when(key.isin(*names), family).otherwise(out)
    return out


def baseline_list(names: str) -> list[str]:
    """Families of a comma-separated list, each once, and then the mandatory ones."""
    return list(dict.fromkeys([canonical(n) for n in names.split(",") if n.strip()] + list(MANDATORY)))


def filters(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass and high-pass taps of an orthogonal family."""
    family = canonical(name)
    h = np.array([math.sqrt(0.5)] * 2 if family == "haar" else TAPS[family])
    return h, quadrature_mirror(h)


def quadrature_mirror(h: np.ndarray) -> np.ndarray:
    """The high-pass filter that belongs to a low-pass filter: reversed, with alternating signs."""
    return h[::-1] * np.where(np.arange(len(h)) % 2, -1.0, 1.0)


def levels_of(n: int) -> int:
    """How often a length can be halved."""
    return (n & -n).bit_length() - 1


def analyze(x: np.ndarray, family: str) -> tuple[np.ndarray, np.ndarray]:
    """One level, for windows in rows, with circular ends: approximation and detail."""
    if family == "bior4.4":
        s, d = x[:, 0::2].copy(), x[:, 1::2].copy()
        for i, c in enumerate(LIFTING):
            if i % 2 == 0:
                d += c * (s + np.roll(s, -1, axis=1))
            else:
                s += c * (d + np.roll(d, 1, axis=1))
        return s * LIFTING_SCALE, d / LIFTING_SCALE
    h, g = filters(family)
    if len(h) == 2:  # no library's product, which may round otherwise: equal coefficients stay equal
        return tuple(x[:, 0::2] * f[0] + x[:, 1::2] * f[1] for f in (h, g))
    n = x.shape[1]
    at = (2 * np.arange(n // 2)[:, None] + np.arange(len(h))) % n
    return x[:, at] @ h, x[:, at] @ g


def synthesize(a: np.ndarray, d: np.ndarray, family: str) -> np.ndarray:
    """The inverse of analyze()."""
    out = np.zeros((a.shape[0], 2 * a.shape[1]))
    if family == "bior4.4":
        s, d = a / LIFTING_SCALE, d * LIFTING_SCALE
        for i, c in reversed(list(enumerate(LIFTING))):
            if i % 2 == 0:
                d = d - c * (s + np.roll(s, -1, axis=1))
            else:
                s = s - c * (d + np.roll(d, 1, axis=1))
        out[:, 0::2], out[:, 1::2] = s, d
        return out
    h, g = filters(family)
    k = 2 * np.arange(a.shape[1])
    for m in range(len(h)):
        out[:, (k + m) % out.shape[1]] += h[m] * a + g[m] * d
    return out
