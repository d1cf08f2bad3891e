"""Numbers that a key and a seed decide: the same in every run, on every cluster, and in any engine with 64-bit integers.

All is arithmetic modulo a prime: a step multiplies, adds and takes the fifth power, which is a bijection of the residues.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime; products of two residues fit 64 bits. Five divides no order in its group, so the fifth power is a bijection.
PRIME = 2**31 - 1


def constants(seed: int, n: int) -> list[tuple[int, int]]:
    """n pairs of a multiplier and an addend."""
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(n)]


def step(x: Column, pair: tuple[int, int]) -> Column:
    y = (x * F.lit(pair[0]).cast("long") + F.lit(pair[1]).cast("long")) % PRIME
    return F.transform(F.array(y), lambda v: (((v * v) % PRIME) * ((v * v) % PRIME) % PRIME) * v % PRIME)[0]


def residue(key: Column, seed: int) -> Column:
    """0 to PRIME - 1 for a whole-number key of any size."""
    a, b, c = constants(seed, 3)
    k = key.cast("long")
    low, high = F.pmod(k, F.lit(PRIME)), F.pmod(F.floor((k - F.pmod(k, F.lit(PRIME))) / F.lit(PRIME)).cast("long"), F.lit(PRIME))
    return step(step((step(low, a) + high) % PRIME, b), c)


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1)."""
    return (residue(key, seed) + 0.5) / float(PRIME)


def normal(key: Column, seed: int) -> Column:
    """A standard normal deviate."""
    return F.sqrt(-2.0 * F.ln(uniform(key, 2 * seed))) * F.cos(2.0 * math.pi * uniform(key, 2 * seed + 1))
