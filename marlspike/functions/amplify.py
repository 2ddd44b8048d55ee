"""Expected amplitude amplification in closed form.

A search over ``count`` items with ``marked`` ones runs on n qubits for k iterations;
item i is measured with probability sin²((2k+1)θ)/M if it is amplified and
cos²((2k+1)θ)/(N-M) otherwise, θ = asin(sqrt(M/N)), N = 2^n.  By default the item
amplified for a marked position is the one at the position's bit reversal
(``bit_order="reference"``); ``bit_order="document"`` amplifies the position itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings


@dataclass(frozen=True)
class Amplification:
    count: int
    marked: int
    qubits: int
    iterations: int
    theta: float
    on_marked: float
    on_others: float

    @classmethod
    def of(cls, count: int, marked: int, settings: Settings = DEFAULTS) -> Amplification:
        """Parameters and expected probabilities; nothing is amplified without marked items."""
        qubits = math.ceil(math.log2(max(count, 2)))
        states = 2**qubits
        if not marked:
            return cls(count, 0, qubits, 0, 0.0, 0.0, 0.0)
        iterations = max(1, min(int(math.pi / 4 * math.sqrt(count / marked)), settings.max_iterations))
        theta = math.asin(math.sqrt(marked / states))
        turned = (2 * iterations + 1) * theta
        others = states - marked
        return cls(count, marked, qubits, iterations, theta, math.sin(turned) ** 2 / marked, math.cos(turned) ** 2 / others if others else 0.0)

    def sampled(self, amplified: list[int], shots: int = DEFAULTS.shots, seed: int = 0) -> dict[int, float]:
        """One seeded measurement: shares of ``shots`` by item, invalid states left out."""
        p = np.full(2**self.qubits, self.on_others)
        p[amplified] = self.on_marked
        hits = np.random.default_rng(seed).multinomial(shots, p / p.sum())
        return {i: int(n) / shots for i, n in enumerate(hits[: self.count]) if n}


def reversed_bits(position: Column, qubits: int) -> Column:
    """The position with its ``qubits`` bits in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(position), qubits, "0")), 2, 10).cast("long")


def target(position: Column, qubits: int, bit_order: str = "reference") -> Column:
    """The item that is amplified when ``position`` is marked."""
    if bit_order not in ("reference", "document"):
        raise ValueError(f"bit_order {bit_order!r}")
    return reversed_bits(position, qubits) if bit_order == "reference" else position.cast("long")


def boosted(score: Column, probability: Column, boost: float = DEFAULTS.boost) -> Column:
    return score * (F.lit(1.0) + F.coalesce(probability, F.lit(0.0)) * F.lit(boost))
